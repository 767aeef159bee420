"""Exact deduplication by a tree-merge of sorted digest runs.

Each task sorts its digests and keeps one row of each: a sorted run. Runs meet in binomial rounds: a round drops the lowest bits of the
run number, so ``fan_in`` runs are exchanged, sorted into one and merged, and of equal digests only the winner, the smallest or
largest id, goes on with its count. A run is itself dealt out by digest, so no task ever holds a whole run; a digest contributes one row per run
at most, which makes a text that a third of all rows share as cheap as any other. Merging aggregates structs, which Spark does by sorting, so the
runs' order is what each level works on.

Winners are verified by the texts themselves: digests with more than one row are joined with their texts, and the least and the greatest
text of each must be equal (one text for each task and digest is exchanged). Should texts of one digest differ, their rows are told apart by
text and merged again, so a collision of digests costs time but never a row.

Defined results: a null text counts as empty; a null id loses to every other id; rows with the same
id and text are one document, share a verdict, and ``drop_duplicates`` keeps one of them; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def merge_runs(digests: DataFrame, keep: str = "smallest", runs: int = 16, fan_in: int = 4) -> DataFrame:
    """(digest, variant, id) -> one row for each digest and variant: keep_id and group_size, after log(runs) rounds."""
    best = F.min if keep == "smallest" else F.max
    last = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    key = ["run", "digest", "variant"]
    merged = (
        digests.withColumn("run", F.spark_partition_id() % F.lit(runs))
        .groupBy(*key)
        .agg(best(F.struct(last.alias("last"), "id")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("int"))
            .repartition(*key)
            .groupBy(*key)
            .agg(best("winner").alias("winner"), F.sum("group_size").alias("group_size"))
        )
    return merged.select("digest", "variant", F.col("winner.id").alias("keep_id"), "group_size")


def collided(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest) stored: digests that different ``texts`` (digest, text) share; only those with several rows in ``groups`` are looked at."""
    several = stored(groups.where("group_size > 1").select("digest"), "several")
    seen = texts.join(broadcast_if_small(several), "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return stored(seen.where("least <> most").select("digest"), "collided")


def verified_groups(docs: DataFrame, id_col: str, text_col: str, keep: str, runs: int, fan_in: int, digest) -> tuple[DataFrame, DataFrame]:
    """(rows: id, digest, variant; groups: digest, variant, keep_id, group_size), both stored; ``variant`` is empty but for texts whose digest another text has."""
    text = normalised(F.col(text_col))
    rows = stored(docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), F.lit("").alias("variant")), "digests")
    groups = stored(merge_runs(rows, keep, runs, fan_in), "groups")
    bad = collided(docs.select(digest(text).alias("digest"), text.alias("text")), groups)
    if bad.isEmpty():
        return rows, groups
    told = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), text.alias("text")).join(
        bad.withColumn("bad", F.lit(True)), "digest", "left"
    )
    rows = stored(told.select("id", "digest", F.when(F.col("bad"), F.col("text")).otherwise(F.lit("")).alias("variant")), "digests")
    return rows, stored(merge_runs(rows, keep, runs, fan_in), "groups")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = 16, fan_in: int = 4, digest=sha256
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_digest), a row for each row of ``docs``.

    ``keep``: whether the smallest or the largest id of equal texts stays. What is exchanged and joined is the stored table of ids and
    digests; texts are exchanged only to verify digests that several rows have.
    """
    rows, groups = verified_groups(docs, id_col, text_col, keep, runs, fan_in, digest)
    return rows.join(groups, ["digest", "variant"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_digest"),
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = 16, fan_in: int = 4, digest=sha256
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one."""
    _, groups = verified_groups(docs, id_col, text_col, keep, runs, fan_in, digest)
    text = normalised(F.col(text_col))
    row = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest(text).alias("of"), text.alias("text")
    )
    same = (F.col("of") == F.col("digest")) & (F.col("variant").isin("") | (F.col("variant") == F.col("text"))) & F.col("id").eqNullSafe(F.col("keep_id"))
    winners = row.join(groups, same)
    return winners.groupBy("digest", "variant").agg(F.first("row").alias("row")).select("row.*")


def op5_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="largest").withColumnRenamed("text_digest", "text_sha256")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
