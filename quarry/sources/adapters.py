"""The engine's entities over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, sf_dir) -> DataFrame:
    """Knowledge entries: id, title (first line), category, source_kind, content, summary, keywords."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("lang").alias("category"), F.col("source").alias("source_kind"),
        F.col("text").alias("content"), T.summary(F.col("text")).alias("summary"), F.array("lang", "source").alias("keywords"),
    )


def question_set(spark, sf_dir) -> DataFrame:
    """The stated query set: each whole benchmark passage, white space collapsed."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("query"))


def messages(spark, sf_dir) -> DataFrame:
    """conversation_id, seq, role, content; ``seq`` stands for the time of writing."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def tool_calls(spark, sf_dir) -> DataFrame:
    """id, tool_name, user_id, started_at, result (JSON)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"), "user_id", F.col("ts").alias("started_at"), F.col("props").alias("result"), "value"
    )


def feedback(spark, sf_dir) -> DataFrame:
    """message_id, helpful: a label is the feedback on a document."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), (F.col("quality") == 1).alias("helpful"), "toxic")
