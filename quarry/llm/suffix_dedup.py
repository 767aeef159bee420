"""Removal of every byte that a repeated string of ``WIDTH`` bytes covers, by suffix arrays over shards that are dealt by content.

A window is ``WIDTH`` bytes of a text. Windows are dealt by the least hash among their ``gram`` byte strings, so equal windows meet in one shard
wherever they stand, and neighbouring windows with the same least hash travel as one piece: a shard is a set of pieces. Shards of a
single piece that doesn't repeat its hash hold no repeat and end there. Equal pieces of a shard are kept once with their number: of those that
occur twice every window repeats. All other shards get a suffix array of their distinct pieces by induced sorting, and permuted common
prefixes of ``WIDTH`` bytes or more mark the windows that occur again, inside a piece or in another one (``quarry.llm.suffix_arrays``).

A shard of more than ``MOST_PIECES`` distinct pieces is not sorted as a whole: its pieces are dealt again by longer byte strings, and at last by whole
windows, where a shard holds equal windows only. So no task ever holds an unbounded shard, whatever a passage's frequency. Occurrences are counted
in tables: copies of a text collapse in each task before they are exchanged.

Pieces are told apart by two 64-bit hashes, of the string that deals them and of themselves, texts by two 64-bit hashes.

Defined results: a null text is an empty one; texts of fewer than ``WIDTH`` bytes keep everything; repeated rows repeat each other's windows,
whatever their ids; null ids are ids like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, discard, stored
from quarry.llm.suffix_arrays import common_prefixes, suffix_arrays
from quarry.llm.textscan import mix64

#: Length of the strings that must not occur twice.
WIDTH = 200
#: Lengths of the strings that deal windows to shards: the first for all texts, the others for pieces of overfull shards.
GRAMS = (64, 120, 170, 200)
#: Distinct pieces that a shard may have to be sorted.
MOST_PIECES = 32
#: Windows of a piece at most; longer runs of one hash are several pieces.
MOST_WINDOWS = 512
#: Bytes scanned at once: part of a text, or several texts.
CHUNK = 1 << 16
#: Window starts in a part of a long text.
PART = 49_152
#: Bytes of shards that a task holds to sort those of about the same length together, and characters that are sorted at once.
HELD, BATCH = 16 << 20, 2_000_000
#: A side of two longs in a row is broadcast up to so many rows.
NARROW_ROWS = 1 << 20

_BASE = 0xD1342543DE82EF95
_ONE = np.ones(1, np.uint64)
_POWER = np.multiply.accumulate(np.append(_ONE, np.full(CHUNK - 1, _BASE, np.uint64)))
_INVERSE = np.multiply.accumulate(np.append(_ONE, np.full(CHUNK - 1, pow(_BASE, -1, 1 << 64), np.uint64)))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(CHUNK - 1)

RUNS = "k1 long, k2 long, start int, windows int, gram long, piece long, again boolean"
MARKS = "gram long, piece long, begin int, end int"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values)
    blocks = np.full((-(-n // width), width), np.iinfo(np.uint64).max, np.uint64)
    blocks.ravel()[:n] = values
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _chunk_runs(data: bytes, starts: np.ndarray, gram: int, width: int):
    """(part, first window from the part's start, windows, hash, hash of the piece, whether the hash occurs again in the piece) for texts that begin at ``starts``."""
    array = np.frombuffer(data, np.uint8)
    n, wide = len(array), width - gram + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[array] * _POWER[:n], out=sums[1:])
    hashes = mix64((sums[gram:] - sums[:-gram]) * _INVERSE[: n - gram + 1])
    place, high = np.arange(len(hashes), dtype=np.uint64), hashes & ~_LOW
    first = (_least(high | place, wide) & _LOW).astype(np.int64)
    last = CHUNK - 1 - (_least(high | (_LOW - place), wide) & _LOW).astype(np.int64)
    windows = np.arange(n - width + 1)
    part = np.searchsorted(starts, windows, side="right") - 1
    whole = windows + width <= np.append(starts[1:], n)[part]
    value = hashes[first]
    cut = np.ones(len(value), bool)
    cut[1:] = (value[1:] != value[:-1]) | (part[1:] != part[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(value))
    begin, end = begin[whole[begin]], end[whole[begin]]
    pieces = -(-(end - begin) // MOST_WINDOWS)
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + number * MOST_WINDOWS
    end = np.minimum(np.repeat(end, pieces), begin + MOST_WINDOWS)
    view, more = memoryview(data), width - 1
    own = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + more]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))
    of = part[begin]
    return of, begin - starts[of], end - begin, value[begin].view(np.int64), own.view(np.int64), first[begin] != last[end - 1]


def _scan(gram: int, width: int):
    """Runs of windows with the same least hash, for batches of (k1, k2, text)."""

    def parts(batches):
        for batch in batches:
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(text) - width + 1, PART):
                    yield k1, k2, at, text[at : at + PART + width - 1]

    def runs(held):
        sizes = np.array([len(h[3]) for h in held])
        of, start, windows, value, own, again = _chunk_runs(b"".join(h[3] for h in held), np.cumsum(sizes) - sizes, gram, width)
        k1, k2, at = (np.array([h[i] for h in held], np.int64)[of] for i in range(3))
        return [k1, k2, (at + start).astype(np.int32), windows.astype(np.int32), value, own, again]

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=[f.split()[0] for f in RUNS.split(", ")])

    def scan(batches):
        held, size, found, rows = [], 0, [], 0
        for part in parts(batches):
            if held and size + len(part[3]) > CHUNK:
                found.append(runs(held))
                rows += len(found[-1][0])
                held, size = [], 0
                if rows > 20_000:
                    yield batch(found)
                    found, rows = [], 0
            held.append(part)
            size += len(part[3])
        if held:
            found.append(runs(held))
        if found:
            yield batch(found)

    return scan


def _sort_shards(width: int):
    """Windows that occur again, from batches of (gram, piece, single, data) ordered by gram; answers for single pieces."""

    def sort(shards):
        """shards: lists of (gram, piece, single, data)."""
        sizes = np.array([sum(len(r[3]) + 1 for r in shard) + 1 for shard in shards])
        text = np.zeros((int(sizes.max()), len(shards)), np.int16)
        for column, shard in enumerate(shards):
            joined = np.concatenate([np.append(np.frombuffer(r[3], np.uint8).astype(np.int16) + 2, np.int16(1)) for r in shard])
            text[: len(joined), column] = joined
        array = suffix_arrays(text, sizes)
        before, shared = common_prefixes(text, sizes, array, width)
        position, column = np.nonzero(shared >= width)
        repeats = np.zeros(text.shape, bool)
        repeats[position, column] = repeats[before[position, column], column] = True
        out = []
        for column, shard in enumerate(shards):
            at = 0
            for gram, piece, single, data in shard:
                if single:
                    flags = np.zeros(len(data) - width + 3, np.int8)
                    flags[1:-1] = repeats[at : at + len(data) - width + 1, column]
                    edges = np.diff(flags)
                    out += [(gram, piece, b, e) for b, e in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True)]
                at += len(data) + 1
        return out

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gram", "piece", "begin", "end"])

    def drained(shards):
        """Shards of about the same length are sorted together."""
        shards.sort(key=lambda s: sum(len(r[3]) for r in s))
        held, out = [], []
        for shard in shards:
            size = sum(len(r[3]) + 1 for r in shard) + 1
            if held and (len(held) + 1) * size > BATCH:
                out += sort(held)
                held = []
            held.append(shard)
        return out + (sort(held) if held else [])

    def marks(batches):
        shards, size, gram = [], 0, None
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if row[0] != gram:
                    if size > HELD:
                        yield batch(drained(shards))
                        shards, size = [], 0
                    shards.append([])
                    gram = row[0]
                shards[-1].append(row)
                size += len(row[3])
        if shards:
            yield batch(drained(shards))

    return marks


def joined(ranges: DataFrame, more: int = 0) -> DataFrame:
    """(k1, k2, begin, end): ranges that overlap or touch as one, after each has grown by ``more`` at its end."""
    ordered = Window.partitionBy("k1", "k2").orderBy("begin", "end")
    covered = ranges.select("k1", "k2", "begin", (F.col("end") + more).alias("end"))
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = covered.withColumn("opens", (F.coalesce(before, F.lit(-1)) < F.col("begin")).cast("int"))
    return marked.withColumn("run", F.sum("opens").over(ordered)).groupBy("k1", "k2", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def spans(ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """(k1, k2, spans: array of (begin, end)): the bytes that repeated windows cover, as maximal runs in order."""
    return joined(ranges, width - 1).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def repeated_windows(texts: DataFrame, grams: tuple[int, ...] = GRAMS, width: int = WIDTH, most_pieces: int = MOST_PIECES) -> DataFrame:
    """(k1, k2, text binary) -> (k1, k2, begin, end) stored: ranges of window starts in each text whose windows occur elsewhere too."""
    runs = stored(texts.where(F.length("text") >= width).mapInArrow(_scan(grams[0], width), RUNS), "runs")
    live = stored(runs.groupBy("gram").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).where("n > 1").select("gram"), "grams")
    counted = stored(
        runs.join(broadcast_if_small(live, NARROW_ROWS), "gram", "left_semi").groupBy("k1", "k2", "start", "windows", "gram", "piece", "again").agg(F.count(F.lit(1)).alias("n")), "counted"
    )
    discard(runs, live)
    pieces = stored(
        counted.groupBy("gram", "piece").agg(F.sum("n").alias("n"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "start", "windows")).alias("at")), "pieces"
    )
    single = F.col("n") == 1
    shards = stored(
        pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("distinct"), F.max(single).alias("open"), F.max(single & F.col("again")).alias("inner"))
        .where("open AND (distinct > 1 OR inner)").select("gram", "distinct"), "shards"
    )
    wanted = stored(pieces.join(broadcast_if_small(shards, NARROW_ROWS), "gram").select("gram", "piece", single.alias("single"), "distinct", "at.*"), "wanted")
    cut = F.expr(f"substring(text, start + 1, windows + {width - 1})")
    cuts = stored(
        texts.join(broadcast_if_small(wanted, NARROW_ROWS), ["k1", "k2"]).select("gram", "piece", "single", "distinct", cut.alias("text"))
        .groupBy("gram", "piece", "single", "distinct").agg(F.min("text").alias("text")), "cuts"
    )
    last = len(grams) == 1
    small = cuts if last else cuts.where(F.col("distinct") <= most_pieces)
    marks = small.select("gram", "piece", "single", "text").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_shards(width), MARKS)
    marks = marks.union(pieces.where(~single).select("gram", "piece", F.lit(0), F.col("at.windows")))
    if not last and not (large := cuts.where(F.col("distinct") > most_pieces)).isEmpty():
        deeper = repeated_windows(large.select(F.col("gram").alias("k1"), F.col("piece").alias("k2"), "text"), grams[1:], width, most_pieces)
        marks = marks.union(joined(deeper))
    marks = stored(marks, "marks")
    ranges = stored(counted.join(marks, ["gram", "piece"]).select("k1", "k2", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end")), "ranges")
    discard(counted, pieces, shards, wanted, cuts, marks)
    return ranges


def _kept(batches):
    """Adds what is left of each text, its digest and how much went."""
    for batch in batches:
        out = []
        for doc_id, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, kept = 0, []
            for cut in cuts or ():
                kept.append(text[at : cut["begin"]])
                at = cut["end"]
            left = b"".join([*kept, text[at:]])
            out.append((doc_id, len(text), len(text) - len(left), len(cuts or ()), hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: tuple[int, ...] = GRAMS, width: int = WIDTH, most_pieces: int = MOST_PIECES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary): a row for each row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2"), text.cast("binary").alias("text"))
    found = stored(spans(repeated_windows(keyed.select("k1", "k2", "text"), grams, width, most_pieces), width), "spans")
    joined = keyed.join(broadcast_if_small(found.select("k1", "k2", "spans"), NARROW_ROWS), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)[id_col]
    return joined.mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op13_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).drop("kept")
