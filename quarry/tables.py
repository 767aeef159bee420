"""Stored tables in the folder that driver and executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes in their text and arrays, that a side may have before it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this machine takes its place, but only if all tasks run here too.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_by(df: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    """As ``stored``, in buckets by ``key``, a file each: joins and groups by it need no exchange of this side. The catalog keeps no entry.

    ``dealt``: rows come from a grouping by ``key`` and lie by its hash already; others are dealt out first, else every task would write every bucket.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_dir(df.sparkSession)}/{table}"
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have ``rows`` rows and ``most_bytes`` bytes at most; give it a stored or small table.

    Beyond that the join shuffles, and adaptive execution splits its skewed keys.
    """
    wide = [F.octet_length(F.col(f"`{c}`")) if t in ("string", "binary") else 16 * F.size(F.col(f"`{c}`")) if t.startswith(("array", "map")) else F.lit(8) for c, t in df.dtypes]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)).cast("long")
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= most_bytes else df
