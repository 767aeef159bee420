"""Divergence between the sources of a language, and the terms that tell a source from its language, in exact arithmetic.

Terms are counted in each task and the counts meet once, dealt by language and term; there the terms of fewer than ``LEAST_DOCS`` documents go.
A source gives a term the parts in a thousand million ``p = 1 + floor(10^9 * (count + 1) / (N + V))``, and ``f(p, q) = floor((p - q)^2 / q)``.

Pairs are sparse: as if no term occurred, two sources have ``V * f(p0, q0)`` with the parts of an absent term. Each term of one source corrects
that by ``f(p, q0) - f(p0, q0)``, and of the other by ``f(p0, q) - f(p0, q0)``; both depend on the count alone, so they are added up by the number of
terms of each count. Terms that both have are corrected once more, by ``f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)``, in blocks of ``BLOCK`` by
``BLOCK`` sources: a task holds the rows of one term and block pair and hands on one sum for each pair of sources.

The first ``TOP`` terms come by radix select. Histograms over the next bits of the values, counted where the rows lie, tell for every
source which bucket holds the last wanted rank; the next round looks into that bucket only. Where equal values are left, the same rounds go on over the bytes of
the terms. A source is settled when at most ``REST`` rows are left undecided; those are ranked with the rows above them.

Defined results: null texts, languages and sources are empty ones; a source without terms, or a language without kept terms, has all its pairs
and no terms; documents are rows, so repeated rows count again; ids aren't read; a text of any length is counted in cuts between
terms; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, discard, stored

LEAST_DOCS = 3
TOP = 200
PARTS = 1_000_000_000
#: Sources in a block.
BLOCK = 64
#: Bits, or bytes of terms, that a round of the radix select looks at.
BITS, BYTES = 9, 2
#: Rows left undecided that are ranked at once.
REST = 1000
#: Terms that a task counts before it hands them on, bytes split at once, pairs computed at once.
HELD, CUT, PAIRS = 300_000, 1 << 20, 1 << 20

#: All bytes but letters and those of characters beyond ASCII part terms; A-Z are lower-cased.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()

COUNTS = "lang string, source string, term string, n long, docs long"
SHARED = "lang string, a int, b int, value long"


def _words(text: bytes):
    """Lists of terms, each of about ``CUT`` bytes."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = len(text) if len(text) - at <= CUT else text.find(b" ", at + CUT)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches):
    """(lang, source, text binary) -> counts and numbers of documents by term."""
    names = [f.split()[0] for f in COUNTS.split(", ")]
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def drained():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                columns = [pa.array([x] * len(part), pa.string()) for x in (lang, source)] + [pa.array([t.decode() for t in part], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[t] for t in part], pa.int64()) for c in (n, docs))], names=names)
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _words(text):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from drained()
                size = 0
    yield from drained()


def parts(count: str, total: str, terms: str) -> str:
    """1 + floor(10^9 * (count + 1) / (total + terms)) in SQL, divided in steps of a thousand, so that no product leaves a long."""
    left, whole, quotient = f"({count} + 1)", f"({total} + {terms})", "1L"
    for scale in (1_000_000, 1000, 1):
        quotient += f" + {scale} * (({left} * 1000) div {whole})"
        left = f"(({left} * 1000) % {whole})"
    return f"CASE WHEN {terms} > 0 THEN {quotient} END"


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, whole, lead) stored: counts of kept terms, those of the whole language, and one marked row for each term."""
    counts = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, COUNTS)
    met = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    alike = Window.partitionBy("lang", "term")
    told = met.select(
        "lang", "source", "term", "n", F.sum("docs").over(alike).alias("docs"), F.sum("n").over(alike).alias("whole"), (F.row_number().over(alike.orderBy("source")) == 1).alias("lead")
    )
    return stored(told.where(F.col("docs") >= least_docs).drop("docs"), "kept")


def source_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, whole_total, terms, place, p0) stored: every source of every language, ``place`` its number among them."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("whole_total"), F.sum(F.col("lead").cast("long")).alias("terms"))
    zero = F.lit(0).cast("long")
    found = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    found = found.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "whole_total", "terms")])
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return stored(found.withColumn("p0", F.expr(parts("0", "total", "terms"))), "sources")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared(batches):
    """Corrections for terms that two sources have, from rows (lang, i, j, term, side, place, p, p0) in order of the first four.

    ``side`` tells whether a row's source lies in block i (0), in block j (1), or in both (2).
    """

    def add(rows: pa.Table, sums: dict) -> None:
        """Adds whole terms to the sums of their block pair."""
        term, side = rows.column("term").combine_chunks(), rows.column("side").to_numpy()
        block = np.stack([rows.column(c).to_numpy() for c in ("i", "j")])
        lang = rows.column("lang").combine_chunks()
        other = np.ones(len(rows), bool)
        other[1:] = (block[:, 1:] != block[:, :-1]).any(axis=0) | pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
        new = other.copy()
        new[1:] |= pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        group, starts = np.cumsum(new) - 1, np.append(np.flatnonzero(other), len(rows))
        place, p, p0 = (rows.column(c).to_numpy() for c in ("place", "p", "p0"))
        right = np.flatnonzero(side > 0)
        many = np.bincount(group[right], minlength=group[-1] + 1)
        first = np.cumsum(many) - many
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            key = (lang[begin].as_py(), int(block[0, begin]), int(block[1, begin]))
            total = sums.setdefault(key, np.zeros(BLOCK * BLOCK, np.int64))
            left = begin + np.flatnonzero(side[begin:end] != 1)
            ends = np.cumsum(many[group[left]])
            at = 0
            while at < len(left):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                some = left[at:to]
                width = many[group[some]]
                a = np.repeat(some, width)
                step = np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)
                b = right[first[group[a]] + step]
                fix = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
                np.add.at(total, place[a] % BLOCK * BLOCK + place[b] % BLOCK, fix)
                at = to

    def batch(sums: dict):
        out = []
        for (lang, i, j), total in sums.items():
            slot = np.flatnonzero(total)
            out.append([pa.array([lang] * len(slot), pa.string()), pa.array((i * BLOCK + slot // BLOCK).astype(np.int32)), pa.array((j * BLOCK + slot % BLOCK).astype(np.int32)), pa.array(total[slot])])
        return [pa.RecordBatch.from_arrays(c, names=[f.split()[0] for f in SHARED.split(", ")]) for c in out]

    held, sums = None, {}
    for rows in batches:
        table = pa.Table.from_batches([rows])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        end = table.slice(len(table) - 1).to_pylist()[0]
        same = pc.equal(table.column("term"), end["term"])
        for c in ("lang", "i", "j"):
            same = pc.and_(same, pc.equal(table.column(c), end[c]))
        whole = len(table) - int(pc.sum(same).as_py())
        if whole:
            add(table.slice(0, whole), sums)
            now = (end["lang"], end["i"], end["j"])
            yield from batch({k: v for k, v in sums.items() if k != now})
            sums = {k: v for k, v in sums.items() if k == now}
        held = table.slice(whole)
    if held is not None and len(held):
        add(held, sums)
    yield from batch(sums)


def pair_values(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every source from each other source of its language."""
    by_source = broadcast_if_small(sources)
    rows = kept.join(by_source, ["lang", "source"]).withColumn("p", F.expr(parts("n", "total", "terms")))
    block, blocks = F.floor(F.col("place") / BLOCK).cast("int"), F.floor((F.col("sources") - 1) / BLOCK).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks), lambda c: c != block)
    entry = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    meets = F.concat(F.array(entry(block, block, 2)), F.transform(others, lambda c: entry(block, c, 0)), F.transform(others, lambda c: entry(c, block, 1)))
    many = broadcast_if_small(stored(sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "langs"))
    placed = rows.join(many, "lang").select("lang", "term", "place", "p", "p0", F.explode(meets).alias("meet")).select("lang", "meet.i", "meet.j", "term", "meet.side", "place", "p", "p0")
    keys = ("lang", "i", "j", "term")
    shared = placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_shared, SHARED).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = sources.select("lang", *[F.col(c).alias(f"a_{c}") for c in ("source", "place", "p0")], "terms")
    two = sources.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("source", "place", "p0")])
    pairs = one.join(two, "lang").where("a_place <> b_place")
    levels = stored(rows.groupBy("lang", "place", "p", "p0").agg(F.count(F.lit(1)).alias("many")), "levels")
    left = levels.join(two, "lang").where("place <> b_place")
    left = left.select("lang", F.col("place").alias("a"), F.col("b_place").alias("b"), F.expr(f"many * ({gap('p', 'b_p0')} - {gap('p0', 'b_p0')})").alias("value"))
    right = levels.join(one, "lang").where("place <> a_place")
    right = right.select("lang", F.col("a_place").alias("a"), F.col("place").alias("b"), F.expr(f"many * ({gap('a_p0', 'p')} - {gap('a_p0', 'p0')})").alias("value"))
    summed = stored(left.union(right).union(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("fixed")), "fixed")
    joined = pairs.join(broadcast_if_small(summed.withColumnsRenamed({"a": "a_place", "b": "b_place"})), ["lang", "a_place", "b_place"], "left")
    base = F.when(F.col("terms") > 0, F.expr(f"terms * {gap('a_p0', 'b_p0')}")).otherwise(F.lit(0))
    return joined.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), (base + F.coalesce("fixed", F.lit(0))).alias("value"))


def _settled(state: DataFrame, wanted: int, rest: int) -> DataFrame:
    """Adds whether the rows left in the bucket, with those above, are few enough to be ranked."""
    return state.withColumn("done", F.col("inside") <= F.col("need") + rest)


def top_values(values: DataFrame, wanted: int = TOP, rest: int = REST) -> DataFrame:
    """The rows of ``values`` (lang, source, term, value) that can be among the first ``wanted`` of their source, ``wanted + rest`` of each at most."""
    key = ["lang", "source"]
    values = values.withColumn("bytes", F.col("term").cast("binary"))
    first = values.groupBy(*key).agg(F.count(F.lit(1)).alias("inside"), F.length(F.bin(F.max("value"))).alias("shift"))
    first = first.select(*key, F.lit(0).cast("long").alias("prefix"), "shift", F.lit(wanted).cast("long").alias("need"), "inside", F.lit(b"").alias("stem"))
    state = stored(_settled(first, wanted, rest), "radix")
    while True:
        open_bits, open_bytes = state.where("NOT done AND shift > 0"), state.where("NOT done AND shift = 0")
        by_bits = not open_bits.isEmpty()
        if not by_bits and open_bytes.isEmpty():
            break
        if by_bits:
            looked = values.join(broadcast_if_small(open_bits), key).where("shiftright(value, shift) = prefix")
            step = F.greatest(F.col("shift") - BITS, F.lit(0))
            looked = looked.withColumn("to", step).withColumn("bucket", F.expr("shiftright(value, to)"))
            order = F.col("bucket").desc()
        else:
            looked = values.join(broadcast_if_small(open_bytes), key).where("value = prefix AND substring(bytes, 1, length(stem)) = stem")
            looked = looked.withColumn("to", F.lit(0)).withColumn("bucket", F.expr(f"substring(bytes, 1, length(stem) + {BYTES})"))
            order = F.col("bucket").asc()
        histogram = looked.groupBy(*key, "prefix", "to", "need", "stem", "bucket").agg(F.count(F.lit(1)).alias("inside"))
        above = F.sum("inside").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        found = histogram.withColumn("above", F.coalesce(above, F.lit(0))).where("above < need AND above + inside >= need")
        prefix, stem = ("bucket", "stem") if by_bits else ("prefix", "bucket")
        found = found.select(*key, F.col(prefix).alias("prefix"), F.col("to").alias("shift"), (F.col("need") - F.col("above")).alias("need"), "inside", F.col(stem).alias("stem"))
        rest_of = state.where("done OR shift = 0") if by_bits else state.where("done")
        after = stored(rest_of.unionByName(_settled(found, wanted, rest)), "radix")
        discard(state)
        state = after
    near = values.join(broadcast_if_small(state), key)
    return near.where("shiftright(value, shift) > prefix OR (shiftright(value, shift) = prefix AND substring(bytes, 1, length(stem)) <= stem)").select(*key, "term", "bytes", "value")


def term_values(kept: DataFrame, sources: DataFrame, top: int = TOP, rest: int = REST) -> DataFrame:
    """(lang, source, item, value, rank): the first ``top`` terms that a source has relatively more often than its language."""
    rows = kept.join(broadcast_if_small(sources), ["lang", "source"])
    rows = rows.withColumns({"p": F.expr(parts("n", "total", "terms")), "q": F.expr(parts("whole", "whole_total", "terms"))}).where("p > q")
    values = stored(rows.select("lang", "source", "term", F.expr(gap("p", "q")).alias("value")), "values")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "bytes"))
    return top_values(values, top, rest).withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, rest: int = REST) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language."""
    columns = {"text": text_col, "lang": lang_col, "source": source_col}
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for name, c in columns.items()])
    kept = kept_counts(docs, least_docs)
    sources = source_table(docs, kept)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").cast("binary")))
    pairs = pair_values(kept, sources).withColumn("rank", rank)
    out = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(term_values(kept, sources, top, rest).withColumn("part", F.lit("term")).select(*out))


def op11_source_divergence(spark, sf_dir):
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
l AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1) // (s.n + l.v))::BIGINT AS p,
         (1 + 1000000000 * (k.whole + 1) // (l.n + l.v))::BIGINT AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every QUALIFY part = 'pair' OR rank <= 200
"""
