"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.tables import broadcast_if_small, discard, shared_dir, stored, stored_by

__all__ = ["WORD", "broadcast_if_small", "discard", "shared_dir", "spread", "stored", "stored_by", "table"]

#: A word: bytes or characters other than space, tab, \\n, \\v, \\f and \\r.
WORD = r"[^\x20\x09-\x0D]+"


def spread(column: Column, ways: int) -> Column:
    """A salt from 0 to ``ways`` - 1 that depends on ``column`` alone, so that retries agree."""
    return F.pmod(F.xxhash64(column, F.lit("salt")), F.lit(ways)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
