r"""Quality rules: per-document counts and cross-document line frequency.

A line is normalised (lower case, digits to 0, white space to one space, trimmed) and hashed. For each host the
distinct documents that hold a line are counted, copies of a text once. A line that more than ``share`` of a host's
documents, and more than ``least`` of them, hold is boilerplate of that host and is removed (``cleaned`` gives the texts without). A
document that then keeps fewer than ``min_left`` of its words is depleted and rejected.

Counting is a grouped sum with map-side combine, so one host or line with a third of all rows stays cheap. Texts are read once for
their lines and once more to drop those that a join of (text, line) with the boilerplate lines names; sides are broadcast only if they are
counted to be few.

Defined results: null text: no words, hence ``base_failed``, and a null clean text; a null host is one host; rows that repeat an id are judged
each by its own text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan as ts
from quarry.llm.common import broadcast_if_small, stored

SHARE = 0.01
LEAST = 10
MIN_LEFT = 0.3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    found: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for _, _, data, offsets in ts.pieces(texts):
        words = ts.words(data, offsets)
        found["n_words"].append(np.diff(words.first))
        found["word_chars"].append(ts.counts(ts.char_starts(data) & ~ts._SPACE[data], offsets))
        found["n_symbols"].append(ts.counts(_SYMBOL[data], offsets))
        rows = ts.lines(data, offsets)
        has_word = np.searchsorted(words.start, rows.start + rows.length) > np.searchsorted(words.start, rows.start)
        earlier, _ = ts.repeated(rows.doc, rows.hash)
        found["n_dup_lines"].append(np.bincount(rows.doc[earlier & has_word], minlength=len(offsets) - 1))
        # 3-word windows inside one text
        triple = ts.windows(words.hash, 3)
        own = words.doc[: len(triple)] == words.doc[2:] if len(triple) else np.zeros(0, bool)
        where = np.flatnonzero(own)
        _, twice = ts.repeated(words.doc[where], triple[where])
        covered = np.zeros(len(words.start) + 2, bool)
        for i in range(3):
            covered[where[twice] + i] = True
        found["n_repeat_words"].append(np.bincount(words.doc[covered[: len(words.doc)]], minlength=len(offsets) - 1))
    return {k: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for k, v in found.items()}


def line_words(texts: pa.Array) -> tuple[list, list, np.ndarray]:
    """For each text the hashes of its normalised lines that hold words, in order, how many words each holds, and the text's own hash.

    A normalised line is the sequence of its folded words, so its hash is made of theirs.
    """
    hashes, weights, whole = [], [], []
    for _, _, data, offsets in ts.pieces(texts):
        words = ts.words(_FOLD[data], offsets)
        rows = ts.lines(data, offsets)
        a = np.searchsorted(words.start, rows.start)
        b = np.searchsorted(words.start, rows.start + rows.length)
        keep = b > a
        a, b, doc = a[keep], b[keep], rows.doc[keep]
        place = np.arange(len(words.hash)) - np.repeat(a, b - a) if len(a) else np.zeros(0, np.int64)
        power = np.full(max(1, int((b - a).max(initial=1))), ts.BASE, np.uint64)
        power[0] = 1
        value = words.hash * np.multiply.accumulate(power)[place]
        line = ts.mix64(np.add.reduceat(value, a) + (b - a).astype(np.uint64)) if len(a) else np.zeros(0, np.uint64)
        # the text itself: the sequence of its lines
        for i in range(len(offsets) - 1):
            mine = slice(*np.searchsorted(doc, [i, i + 1]))
            hashes.append(line[mine].view(np.int64))
            weights.append((b - a)[mine])
            power = np.full(max(1, mine.stop - mine.start), ts.BASE, np.uint64)
            power[0] = 1
            whole.append(int((line[mine] * np.multiply.accumulate(power)[: mine.stop - mine.start]).sum(dtype=np.uint64).view(np.int64)))
    return hashes, weights, np.array(whole, np.int64)


def _lists(rows: list) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, text, text_key): equal texts have equal keys."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def measured(keyed: DataFrame) -> DataFrame:
    """(host, text_key, text_hash, lines: array of the distinct lines' hashes), a row for each row of ``keyed``."""

    def scan(batches):
        for batch in batches:
            hashes, _, whole = line_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("text_key"), pa.array(whole), _lists([np.unique(x) for x in hashes])], names=["host", "text_key", "text_hash", "lines"]
            )

    return keyed.select("host", "text_key", "text").mapInArrow(scan, "host string, text_key long, text_hash long, lines array<long>")


def boilerplate(measures: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, hash): lines that too many distinct documents of a host hold."""
    # A text's copies are one document. A group is spread by its hash, and one row for each text and task is exchanged.
    distinct = stored(measures.groupBy("host", "text_hash").agg(F.first("lines").alias("lines")), "distinct-lines")
    limits = distinct.groupBy("host").agg(F.greatest(F.lit(least), F.count(F.lit(1)) * share).alias("most"))
    held = distinct.select("host", F.explode("lines").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return held.join(broadcast_if_small(stored(limits, "line-limits")), "host").where("n > most").select("host", "hash")


def without_lines(texts: pa.Array, dropped: list) -> tuple[pa.Array, np.ndarray]:
    """The texts without those of their lines whose hashes ``dropped`` has for each (None: none), and the words left in them; other texts are as they were."""
    hashes, weights, _ = line_words(texts)
    out, left = texts.to_pylist(), np.array([int(w.sum()) for w in weights], np.int64)
    for i, gone in enumerate(dropped):
        if gone:
            keep = iter(~np.isin(hashes[i], np.array(gone, np.int64)))
            clean = b"\n".join(x for x in out[i].encode().split(b"\n") if not x.strip() or next(keep))
            out[i], left[i] = clean.decode(), len(clean.split())
    return pa.array(out, pa.string()), left


def cleaned(
    docs: DataFrame, share: float = SHARE, least: int = LEAST, min_left: float = MIN_LEFT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """(doc_id, clean_text, n_words, base counts, base_failed, words_left, kept), a row for each row of ``docs``: the texts without boilerplate."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    measures = stored(measured(keyed), "line-measures")
    common = stored(boilerplate(measures, share, least), "boilerplate")
    # Boilerplate is joined once for each distinct text of a host; its lines then go back to all copies. Texts are exchanged only if many hold some.
    held = measures.select("host", "text_key", F.explode("lines").alias("hash")).join(broadcast_if_small(common), ["host", "hash"])
    held = stored(held.groupBy("host", "text_key").agg(F.collect_set("hash").alias("dropped")), "boilerplate-of-texts")

    def scan(batches):
        for batch in batches:
            base = base_counts(batch.column("text"))
            texts, left = without_lines(batch.column("text"), batch.column("dropped").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, *(pa.array(v) for v in base.values()), pa.array(left)], names=["doc_id", "clean_text", *base, "words_left"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, clean_text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, words_left long"
    done = keyed.join(broadcast_if_small(held), ["host", "text_key"], "left").select("doc_id", "text", "dropped").mapInArrow(scan, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return done.select(
        "doc_id", "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "words_left", (~failed & (F.col("words_left") >= min_left * F.col("n_words"))).alias("kept"),
    )


def quality_rules(
    docs: DataFrame, share: float = SHARE, least: int = LEAST, min_left: float = MIN_LEFT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """(doc_id, n_words, base counts, base_failed, words_left, kept) of the cleaned texts, a row for each row of ``docs``."""
    return cleaned(docs, share, least, min_left, id_col, text_col, host_col).drop("clean_text")


def op6_quality_rules(spark, sf_dir):
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), triples AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM triples) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), rows_ AS (
  SELECT r, host, line, string_agg(x, ' ' ORDER BY j) AS norm, count(*) AS n FROM (
    SELECT r, host, line, k, unnest(ws) AS x, unnest(range(len(ws))) AS j FROM (
      SELECT r, host, line, k, regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM (
        SELECT r, host, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d))) GROUP BY r, host, line, k
), dup AS (
  SELECT r, sum(c - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS c FROM rows_ GROUP BY r, line) GROUP BY r
), same AS (
  SELECT r, host, string_agg(norm, chr(10) ORDER BY line_no) AS body FROM (
    SELECT r, host, norm, k AS line_no FROM (
      SELECT r, host, k, string_agg(x, ' ' ORDER BY j) AS norm FROM (
        SELECT r, host, k, unnest(ws) AS x, unnest(range(len(ws))) AS j FROM (
          SELECT r, host, k, regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+') AS ws FROM (
            SELECT r, host, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d))) GROUP BY r, host, k)) GROUP BY r, host
), bodies AS (SELECT d.r, d.host, coalesce(body, '') AS body FROM d LEFT JOIN same USING (r)
), limits AS (SELECT host, greatest(10, count(DISTINCT body) * 0.01) AS most FROM bodies GROUP BY host
), held AS (
  SELECT rows_.host, norm, count(DISTINCT body) AS n FROM rows_ JOIN bodies USING (r) GROUP BY rows_.host, norm
), common AS (SELECT host, norm FROM held JOIN limits USING (host) WHERE n > most
), lost AS (SELECT r, sum(n) AS words_lost FROM rows_ JOIN common USING (host, norm) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(words_lost, 0))::BIGINT AS words_left
  FROM d LEFT JOIN covered USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.3 * n_words AS kept FROM m
"""
