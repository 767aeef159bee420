"""Connected components of a link table by alternating large-star and small-star rounds.

Links stay tables throughout: a round is a grouped minimum and a join, a hub's links are dealt out by adaptive
execution, and each round's table is written to the shared folder, so lineage stays short and lost executors are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: link the larger neighbours of u to the least one. Small: the smaller ones and u itself."""
    if large:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    else:
        around = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), F.col("m")))
    return out.where("a <> b").distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the least node of its component for each node that has a link."""
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _state(links)
    for _ in range(MOST_ROUNDS):
        links = stored(_star(stored(_star(links, True), "large"), False), "small")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b"), F.col("b")).distinct()
    )
