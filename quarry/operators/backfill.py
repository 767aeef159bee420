"""Vectors for entries, made in steps that can stop anywhere and go on later.

What is done is a table of (id, checksum, vector), and an entry is pending while no row has its id and the checksum of its present payload. A run goes
through slices of the pending entries; each slice is one job that appends its rows when it ends, so a stopped run loses a slice at most, and the next one does the rest.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads that a provider gets at once.
BATCH = 32
SLICES = 16


def checked(entries: DataFrame) -> DataFrame:
    """Entries (id, payload) with the checksum of the payload."""
    return entries.withColumn("checksum", F.sha2(F.coalesce("payload", F.lit("")), 256))


def done(spark: SparkSession, root: str, kind: str = "long") -> DataFrame:
    """(id, checksum, vector, run) of all finished slices; empty before the first."""
    schema = f"id {kind}, checksum string, vector array<float>, run int"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


def pending(entries: DataFrame, finished: DataFrame) -> DataFrame:
    return checked(entries).join(finished.select("id", "checksum"), ["id", "checksum"], "left_anti")


def in_batches(embed: Callable[[list[str]], list[list[float]]], size: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A provider as a step: payloads in order of id, ``size`` to a call."""

    def step(todo: DataFrame) -> DataFrame:
        kind = dict(todo.dtypes)["id"]

        def scan(batches):
            held = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                while len(held) >= size:
                    yield from made(held.slice(0, size))
                    held = held.slice(size)
            if held is not None and len(held):
                yield from made(held)

        def made(rows: pa.Table):
            vectors = embed([p or "" for p in rows.column("payload").to_pylist()])
            if len(vectors) != len(rows):
                raise ValueError(f"{len(vectors)} vectors for {len(rows)} payloads")
            yield from pa.table({"id": rows.column("id"), "checksum": rows.column("checksum"), "vector": pa.array(vectors, pa.list_(pa.float32()))}).to_batches()

        return todo.sortWithinPartitions("id").mapInArrow(scan, f"id {kind}, checksum string, vector array<float>")

    return step


def backfill(entries: DataFrame, step: Callable[[DataFrame], DataFrame], root: str, run: int, slices: int = SLICES, slice_of: Column | None = None, stop_after: int | None = None) -> DataFrame:
    """Goes through the slices of what is pending, ``stop_after`` of them at most, and returns all that is done for the present entries.

    ``step`` makes (id, checksum, vector) of pending (id, payload, checksum); what it leaves out stays pending.
    """
    spark, kind = entries.sparkSession, dict(entries.dtypes)["id"]
    place = F.pmod(F.xxhash64("id"), F.lit(slices)) if slice_of is None else slice_of
    for number in range(slices if stop_after is None else min(slices, stop_after)):
        todo = pending(entries.where(place == number), done(spark, root, kind))
        step(todo).select("id", "checksum", F.col("vector").cast("array<float>").alias("vector"), F.lit(run).alias("run")).write.mode("append").parquet(root)
    present = checked(entries).select("id", "checksum")
    return done(spark, root, kind).join(present, ["id", "checksum"], "left_semi")
