"""BPE encoding and decoding with a distinct-word table.

Texts are normalised and split into words in Spark tasks. The corpus's distinct words are counted by a grouped aggregate, and each is
encoded exactly once: the word table, stored in buckets by word. Ids are decoded by a join with the id-to-piece table, which has the
vocabulary's rows and is broadcast. Ids and pieces return to the texts by position, in a join in two parts:

* words with at least 1 / ``SHARE`` of all occurrences, and ``MOST_FREQUENT`` of them at most, so a bounded table whatever the corpus, are
  broadcast and ranked. A text becomes its words' ranks, one to three bytes each, 0 where the word is not among them, compressed;
* the rest, a share of all occurrences and so in proportion to the input, is a row (text, position, word) each. These are exchanged by word,
  joined with the buckets of the word table, and gathered for each text. Only their ids are exchanged: they meet their pieces in the task
  that assembles the text.

Equal texts are filled once and their result joins all rows that hold them, by 96 bits of the text's digest (``KEY`` bytes: ten billion
texts share one with a probability below 1e-9). A text's gap rows are made for each copy,
but are equal, so they collapse in the set of each task before anything is exchanged by text: the work is linear in the copies.

The vocabulary file is a parameter; executors load it from the same path, as a tokenizer's files are installed on each.

Defined results: null or empty text: no ids, hence the digests of the empty string; special tokens in a text are encoded
as such; repeated rows each get their own result; null ids pass through; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain, compress, count, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, stored, stored_by

#: Words with this share of all occurrences are broadcast, up to so many and of up to so many characters; all others take the exchange.
SHARE, MOST_FREQUENT, LONGEST = 5_000_000, 1_000_000, 32
#: Bytes of a text's digest that name it in exchanges; a gap's tag is its position in four bytes, then these.
KEY = 12

# Fixed values of the tokenizer file's kind: special tokens and, below, the split pattern.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")

# Up to U+024F nothing composes or decomposes; but for U+0130, str.lower() and plain classes do what the library does. Other texts take its own rules.
_LATIN_ONLY = re.compile(r"[\x00-įı-ɏ]*")


def _pattern(below: int) -> re.Pattern:
    kinds = {k: "".join(chr(i) for i in range(below) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^\t\n\x0b\x0c\r \x85\xa0{kinds['L']}{kinds['N']}]+")


_LATIN_1_LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
_LATIN_1_SPLIT, _LATIN_SPLIT = _pattern(0x100), _pattern(0x250)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def split_words(text: str | None, path: str) -> list[str]:
    """The words that are encoded one by one, special tokens among them."""
    if not text:
        return []
    if "<|" in text and _SPECIAL.search(text):
        return [w for part in _SPECIAL.split(text) for w in ([part] if part in SPECIALS else split_words(part, path))]
    try:
        return _LATIN_1_SPLIT.findall(text.encode("latin-1").translate(_LATIN_1_LOWER).decode("latin-1"))
    except UnicodeEncodeError:  # other characters than U+0000 to U+00FF
        pass
    if _LATIN_ONLY.fullmatch(text):
        return _LATIN_SPLIT.findall(text.lower())
    text = tokenizer(path).normalizer.normalize_str(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def encode_words(words: list[str], path: str) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch(words, add_special_tokens=False)]


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n): distinct words; each task pre-aggregates what it reads, up to a bounded number of words at a time."""

    def scan(batches):
        tally: Counter[str] = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                tally.update(split_words(text.as_py(), path))
                if len(tally) > 200_000:
                    yield table()
                    tally.clear()
        yield table()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=2)
def vocabulary_rows(path: str) -> pa.Table:
    """(id, piece) of the vocabulary, special tokens included."""
    with open(path, encoding="utf-8") as file:
        loaded = json.load(file)
    rows = {i: p for p, i in loaded["model"]["vocab"].items()} | {t["id"]: t["content"] for t in loaded["added_tokens"]}
    return pa.table({"id": pa.array(rows.keys(), pa.int32()), "piece": pa.array(rows.values(), pa.string())})


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): a row for each id of the vocabulary."""
    return spark.createDataFrame(vocabulary_rows(path))


def word_table(counts: DataFrame, path: str) -> DataFrame:
    """(word, n, ids: array) stored in buckets by word: every distinct word encoded once."""

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = pa.array(encode_words(part.column("word").to_pylist(), path), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), ids], names=["word", "n", "ids"])

    return stored_by(counts.mapInArrow(encode, "word string, n long, ids array<int>"), "words", "word", dealt=True)


def decoded(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids, pieces) of a word table: ids joined with their pieces, both in order and joined by spaces. Buckets by word make it free of exchanges."""
    found = words.select("word", "n", F.posexplode_outer("ids").alias("at", "id")).join(broadcast_if_small(piece_table(words.sparkSession, path)), "id", "left")
    gathered = found.groupBy("word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id", "piece")))).alias("o"))
    return gathered.select("word", "n", F.array_join(F.transform("o.id", lambda i: i.cast("string")), " ").alias("ids"), F.array_join("o.piece", " ").alias("pieces"))


def pack(ranks: list[int], sizes: list[int]) -> list[bytes]:
    """Ranks of texts, one after another, as bytes of 7 bits, the lowest first, the last without its high bit; one value for each text."""
    x = np.array(ranks, np.uint32)
    size = 1 + (x > 0x7F) + (x > 0x3FFF) + (x > 0x1FFFFF)
    ends = np.concatenate([[0], np.cumsum(size)])
    out, start = np.empty(ends[-1], np.uint8), ends[:-1]
    for at in range(4):
        out[start + at] = (x >> 7 * at & 127) | (size > at + 1) * 128
        more = size > at + 1
        x, size, start = x[more], size[more], start[more]
    packed = out.tobytes()
    ends = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].tolist()
    return [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unpack(packed: list[bytes]) -> tuple[list[int], list[int]]:
    """(all ranks, where each text's begin, and the end)."""
    b = np.frombuffer(b"".join(packed), np.uint8)
    last = b < 128
    ends = np.concatenate([[0], np.cumsum([len(x) for x in packed], dtype=np.int64)])
    begins = np.concatenate([[0], np.cumsum(last, dtype=np.int64)])[ends].tolist()
    if not len(b):
        return [], begins
    start = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    ranks, place = (b[start] & 127).astype(np.uint32), np.flatnonzero(~last[start])
    for at in range(1, 4):
        byte = b[start[place] + at]
        ranks[place] |= (byte & 127).astype(np.uint32) << 7 * at
        place = place[byte >= 128]
    return ranks.tolist(), begins


def ranks_of(words: list[str]) -> dict[str, int]:
    """Word to rank, from 1."""
    return {w: i for i, w in enumerate(words, 1)}


def frequent_words(words: DataFrame, path: str, share: int = SHARE, most: int = MOST_FREQUENT) -> tuple[pa.Table, DataFrame]:
    """((word, ids, pieces) of the words that are broadcast, most frequent first: ``most`` rows of ``LONGEST`` characters at most; a table that holds all others)."""
    total = words.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") * share >= total) & (F.length("word") <= LONGEST)
    known = decoded(words.where(often), path).orderBy(F.desc("n"), "word").limit(most).toArrow()
    return known, words.where(~often) if len(known) < most else words


def encode(docs: DataFrame, vocabulary: str | None = None, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of ``docs``; ``full`` adds ids and decoded, both text."""
    path = vocabulary or default_vocabulary()
    context = docs.sparkSession.sparkContext
    words = word_table(word_counts(docs, path, text_col), path)
    known, others = frequent_words(words, path, share)
    shared = context.broadcast({c: known.column(c).to_pylist() for c in ("word", "ids", "pieces")})
    table = piece_table(docs.sparkSession, path).toArrow()
    piece_of = context.broadcast(dict(zip(map(str, table.column("id").to_pylist()), table.column("piece").to_pylist(), strict=True)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.md5(text)), 1, KEY).alias("key")
    rows = docs.select(F.col(id_col).alias("doc_id"), key)
    texts = docs.select(key, text.alias("text"))

    def gaps(batches):
        rank = ranks_of(shared.value["word"])
        for batch in batches:
            tags, found = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                own = split_words(text.as_py(), path)
                here = list(compress(count(), map(not_, map(rank.__contains__, own))))
                tags += [at.to_bytes(4) + key for at in here]
                found += [own[at] for at in here]
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.binary()), pa.array(found, pa.string())], names=["tag", "word"])

    def ranked(batches):
        rank, squeeze = ranks_of(shared.value["word"]).get, zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in batches:
            codes = []
            for at in range(0, batch.num_rows, 200):
                own = [split_words(text.as_py(), path) for text in batch.column("text").slice(at, 200)]
                codes += map(squeeze, pack(list(map(rank, chain.from_iterable(own), repeat(0))), [len(w) for w in own]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(codes, pa.binary())], names=["key", "codes"])

    rare = texts.mapInArrow(gaps, "tag binary, word string").join(others.select("word", F.array_join("ids", " ").alias("ids")), "word")
    at = F.conv(F.hex(F.substring("tag", 1, 4)), 16, 10)
    entries = rare.select(F.substring("tag", 5, KEY).alias("key"), F.concat_ws("\t", at, "ids").alias("gap"))  # one string takes half of a struct's bytes
    filled = entries.groupBy("key").agg(F.collect_set("gap").alias("filled"))
    coded = texts.mapInArrow(ranked, "key binary, codes binary").groupBy("key").agg(F.first("codes").alias("codes"))

    def assemble(batches):
        ids_of, pieces_of = (["", *shared.value[c]] for c in ("ids", "pieces"))
        piece, expand = piece_of.value.__getitem__, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, taken = [], 0
            gaps = [g.split("\t") for g in batch.column("filled").flatten().to_pylist()]
            many = pa.compute.fill_null(pa.compute.list_value_length(batch.column("filled")), 0).to_pylist()
            codes = batch.column("codes").to_pylist()
            for at in range(0, len(codes), 200):
                ranks, begins = unpack(list(map(expand, codes[at : at + 200])))
                for i, (begin, end) in enumerate(zip(begins[:-1], begins[1:], strict=True), at):
                    own = ranks[begin:end]
                    ids, pieces = list(map(ids_of.__getitem__, own)), list(map(pieces_of.__getitem__, own))
                    for place, own_ids in gaps[taken : taken + many[i]]:
                        ids[int(place)], pieces[int(place)] = own_ids, " ".join(map(piece, own_ids.split()))
                    taken += many[i]
                    ids, pieces = " ".join(filter(None, ids)), " ".join(filter(None, pieces))
                    out.append((ids.count(" ") + (ids != ""), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(pieces.encode()).hexdigest(), *((ids, pieces) if full else ())))
            columns = list(zip(*out, strict=True)) if out else [()] * (5 if full else 3)
            arrays = [batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.string()] * 4)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays)])

    schema = "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * full
    done = coded.join(filled, "key", "left").select("key", "codes", "filled").mapInArrow(assemble, schema)
    return rows.join(done, "key").drop("key")


def op10_bpe(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
