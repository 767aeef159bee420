"""Mixing sources to target weights by entropy balancing.

Rates w of documents minimise the relative entropy sum(size * (w log w - w + 1)) with w <= 3 under overlapping token constraints:

* one for each source, sum(size * w) = target, which holds exactly;
* one for all documents together, that the mix keeps the corpus's lengths: sum(size * w * z) = 0, where z is the standardised logarithm of the
  size (over words). It is soft, with the price ``RIDGE``, as targets may leave no room for it.

The convex dual has one multiplier for each source and one for length, and its optimum is the exponential tilt
w = min(3, exp(lambda(source) + mu * z)), so documents of one source have different rates. Newton's method finds it. Documents of equal source and
size are one cell with a count; each step joins the cells with the multipliers and takes gradient and Hessian in one grouped aggregate. The
Hessian is an arrow, diagonal in the sources and bordered by length, so mu's step needs a handful of sums, which come to the driver, and the
sources' steps are a column expression over the table of sources. Steps end when all constraints hold to ``TOLERANCE``.

Rates become copies by carrying the error. A source's documents are dealt by hash into items of one size class, each of about 1 / ``ITEMS`` of the
source's words, so ``ITEMS`` and the size classes bound their number. In order of their words, most first, an item's documents get
their rates rounded down, or one copy more if that brings the words taken so far nearer to the words owed. All documents follow this one rule. It
depends on the rows alone (multipliers are rounded, words owed are whole thousandths), so reruns agree.

Defined results: a null text has size 0 and its document takes 0 words; a null source is a source of its own,
last in order; a source without words has target 0; repeated rows are mixed alike, each counted; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import WORD, broadcast_if_small, stored

CAP = 3.0
ITEMS = 4096
#: Size classes for each doubling of the size.
CLASSES = 4
RIDGE = 0.1
TOLERANCE = 1e-8
MOST_STEPS = 100


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of each text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"))


def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table``, a row for each source; null is a source."""
    other = broadcast_if_small(table).withColumnRenamed("source", "_of")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, by code point, null last: ranges are counted, and rows numbered within each."""
    dealt = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    before, total = {}, 0
    for row in dealt.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        before[row["part"]] = total
        total += row["count"]
    first = F.lit(0)
    if before:
        first = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
    nth = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("place", (nth - 1 + first).cast("int")).drop("part")


def water_fill(sources: DataFrame, weights: tuple = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """(source, source_size) stored with target: shares by repeating weights, at most ``cap`` x size, excess reshared.

    Each round is one aggregate: what the capped sources leave, over the weight of the others, is the level; sources that it would lift
    above their cap are capped. Levels only rise, so the rounds end.
    """
    row = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(numbered(sources).withColumn("weight", F.element_at(row, F.col("place") % len(weights) + 1)).drop("place"), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, None
    while True:
        over = level * F.col("weight") > cap * F.col("source_size")
        found = weighed.agg(
            F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(over).alias("n")
        ).first()
        if found["n"] == capped or not found["weight"]:
            break
        level, capped = (total - cap * found["fixed"]) / found["weight"], found["n"]
    return stored(weighed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), cap * F.col("source_size").cast("double")).alias("target")), "targets")


def rate(multiplier: Column, tilt: float, z: Column, cap: float = CAP) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(multiplier + tilt * z, F.lit(50.0))))


def length(size: Column, centre: float, width: float) -> Column:
    """The standardised logarithm of a size; 0 for none."""
    return F.when(size > 0, F.round((F.ln(size) - centre) / width, 6)).otherwise(F.lit(0.0))


def balance(cells: DataFrame, targets: DataFrame, cap: float = CAP, ridge: float = RIDGE) -> tuple[DataFrame, dict[str, float]]:
    """((source, source_size, target, multiplier) stored, {tilt, centre, width}): the dual's optimum.

    ``cells``: (source, size, n). A source with target 0 has no multiplier (rate 0), one whose target is its cap has one that caps all rates.
    """
    moments = cells.agg(*[F.sum(F.col("n") * F.col("size") * F.pow(F.ln("size"), F.lit(k))).alias(f"m{k}") for k in (0, 1, 2)]).first()
    total = moments["m0"] or 0.0
    centre = round(moments["m1"] / total, 6) if total else 0.0
    width = round(max((moments["m2"] / total - (moments["m1"] / total) ** 2) ** 0.5 if total else 1.0, 1e-3), 6) if total else 1.0
    ratio = F.col("target") / F.col("source_size")
    start = F.when(F.col("target") <= 0, F.lit(None)).when(ratio >= cap * (1 - 1e-12), F.lit(99.0)).otherwise(F.ln(ratio)).cast("double")
    state = stored(targets.withColumn("multiplier", start), "multipliers")
    z = length(F.col("size"), centre, width)
    tilt = 0.0
    for _ in range(MOST_STEPS):
        words = F.col("n") * F.col("size") * rate(F.col("multiplier"), tilt, z, cap)
        loose = F.when(F.col("multiplier") + tilt * z < F.log(F.lit(cap)), words).otherwise(0.0)
        step = stored(
            with_source(cells, state.where("multiplier IS NOT NULL"))
            .groupBy("source").agg(
                F.sum(words).alias("taken"), F.sum(words * z).alias("taken_z"), F.sum(loose).alias("h"), F.sum(loose * z).alias("hz"), F.sum(loose * z * z).alias("hzz"),
                *[F.first(c).alias(c) for c in ("source_size", "target", "multiplier")],
            ).withColumn("gap", F.when(F.col("multiplier") < 50, F.col("taken") - F.col("target")).otherwise(0.0)),
            "newton",
        )
        own = F.col("h") > 1e-12 * F.col("target")
        s = step.agg(
            F.max(F.abs(F.col("gap")) / F.col("target")).alias("gap"), F.sum("taken_z").alias("g"), F.sum("hzz").alias("hzz"), F.sum(F.when(own, F.pow("hz", F.lit(2)) / F.col("h"))).alias("seen"),
            F.sum(F.when(own, F.col("hz") * F.col("gap") / F.col("h"))).alias("moved"),
        ).first()
        if s["gap"] is None:
            break
        slope = s["g"] + ridge * total * tilt
        if s["gap"] < TOLERANCE and abs(slope - (s["moved"] or 0.0)) < TOLERANCE * total:
            break
        move = -(slope - (s["moved"] or 0.0)) / (s["hzz"] + ridge * total - (s["seen"] or 0.0))
        move = max(-0.5, min(0.5, move))
        newton = F.when(own, -(F.col("gap") + F.col("hz") * move) / F.col("h")).otherwise(F.when(F.col("gap") > 0, -1.0).otherwise(0.0))
        moved = step.select("source", F.when(F.col("multiplier") < 50, F.col("multiplier") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), newton))).otherwise(F.col("multiplier")).alias("after"))
        state = stored(
            targets.join(moved.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")), "left").select("source", "source_size", "target", F.col("after").alias("multiplier")),
            "multipliers",
        )
        tilt += move
    else:
        raise RuntimeError("entropy balancing did not converge")
    return stored(state.withColumn("multiplier", F.round("multiplier", 8)), "multipliers"), {"tilt": round(tilt, 8), "centre": centre, "width": width}


def size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * CLASSES)).otherwise(-1).cast("int")


def item(bins: Column) -> Column:
    """The item of a document within its source and size class."""
    return F.pmod(F.xxhash64("doc_id", "size", F.lit("mix")), bins).cast("int")


def plans(sized: DataFrame, weights: tuple = (1.0, 2.0, 3.0), cap: float = CAP) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(sources with their multipliers, items: source, class, bins, bin, more), both stored, and the length's tilt: all that rounding needs."""
    cells = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = water_fill(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap)
    full = cells.where("size > 0")
    sources, tilt = balance(full, targets, cap)
    classes = with_source(
        full.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum(F.col("n") * F.col("size")).alias("words")), sources.select("source", "source_size")
    ).select("source", "class", F.ceil(ITEMS * F.col("words") / F.col("source_size")).cast("int").alias("bins"))
    classes = stored(classes, "classes")
    dealt = rated(binned(sized.where("size > 0"), classes), sources, tilt, cap)
    owed = F.round(F.col("rate") * F.col("size") * 1000).cast("long")
    items = dealt.groupBy("source", "class", "bins", "bin").agg(
        F.sum("size").alias("words"), F.sum(owed - 1000 * F.col("size") * F.col("base")).alias("owed"), F.max(F.col("base") < cap).alias("open")
    )
    # One row for each source, of ITEMS and the size classes at most.
    each = items.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("words", "class", "bin", "bins", "owed", "open")), asc=False).alias("items"))
    due = lambda acc, x: acc["due"] + x["owed"]
    more = lambda acc, x: x["open"] & (2 * due(acc, x) >= 1000 * x["words"])
    carried = F.aggregate(
        "items",
        F.struct(F.lit(0).cast("long").alias("due"), F.array().cast("array<boolean>").alias("more")),
        lambda acc, x: F.struct(
            (due(acc, x) - F.when(more(acc, x), 1000 * x["words"]).otherwise(0)).alias("due"), F.array_append(acc["more"], more(acc, x)).alias("more")
        ),
        lambda acc: acc["more"],
    )
    chosen = each.select("source", F.inline(F.arrays_zip("items", carried.alias("more")))).select("source", "items.class", "items.bins", "items.bin", "more")
    return sources, stored(chosen, "items"), tilt


def binned(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with size class and bin."""
    other = broadcast_if_small(classes).withColumnsRenamed({"source": "_of", "class": "_class"})
    placed = rows.withColumn("class", size_class(F.col("size")))
    return placed.join(other, F.col("source").eqNullSafe(F.col("_of")) & (F.col("class") == F.col("_class"))).drop("_of", "_class").withColumn("bin", item(F.col("bins")))


def rated(rows: DataFrame, sources: DataFrame, tilt: dict[str, float], cap: float = CAP) -> DataFrame:
    """``rows`` with source_size, target, rate and ``base``, the rate rounded down."""
    value = F.coalesce(rate(F.col("multiplier"), tilt["tilt"], length(F.col("size"), tilt["centre"], tilt["width"]), cap), F.lit(0.0))
    return with_source(rows, sources).withColumn("rate", F.when(F.col("size") > 0, value).otherwise(0.0)).withColumn("base", F.floor("rate").cast("long")).drop("multiplier")


def with_copies(rows: DataFrame, plan: tuple[DataFrame, DataFrame, dict[str, float]], cap: float = CAP) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with rate, target and copies, how often the mix takes them."""
    sources, items, tilt = plan
    other = broadcast_if_small(items).withColumnsRenamed({"source": "_of", "class": "_class", "bin": "_bin"}).drop("bins")
    classes = items.select("source", "class", "bins").distinct()
    placed = rows.withColumn("class", size_class(F.col("size")))
    known = broadcast_if_small(classes).withColumnsRenamed({"source": "_s", "class": "_c"})
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left").withColumn("bin", item(F.col("bins"))).drop("_s", "_c")
    same = F.col("source").eqNullSafe(F.col("_of")) & (F.col("class") == F.col("_class")) & (F.col("bin") == F.col("_bin"))
    decided = rated(placed.join(other, same, "left").drop("_of", "_class", "_bin"), sources, tilt, cap)
    return decided.withColumn("copies", F.col("base") + F.when(F.coalesce("more", F.lit(False)) & (F.col("base") < cap), 1).otherwise(0))


def mix(
    docs: DataFrame, weights: tuple = (1.0, 2.0, 3.0), cap: float = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken), a row for each row of ``docs``."""
    sized = stored(sizes(docs, id_col, text_col, source_col), "sizes")
    return with_copies(sized, plans(sized, weights, cap), cap).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeat_documents(docs: DataFrame, weights: tuple = (1.0, 2.0, 3.0), cap: float = CAP) -> DataFrame:
    """The mix itself: each row of ``docs`` (doc_id, text, source and any others) as often as the mix takes it."""
    plan = plans(stored(sizes(docs), "sizes"), weights, cap)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", words_of(F.col("text")).alias("size"))
    taken = with_copies(row, plan, cap).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")


def op7_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "source", "copies")
