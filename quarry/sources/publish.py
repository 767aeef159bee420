"""Snapshots of several tables that readers see whole: written beside the old ones, then swapped in by one rename.

A snapshot is a folder of tables; the file ``CURRENT`` beside it names the one that counts. A writer that stops half-way leaves a folder that nothing names. A reader
resolves ``CURRENT`` once and reads that folder, which stays until ``clear_old``. One writer at a time; a writer that based its work on another snapshot than
the present one is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _hadoop(spark: SparkSession, root: str):
    """(Hadoop's file package, root as a path, its file system)."""
    fs = spark._jvm.org.apache.hadoop.fs
    path = fs.Path(root)
    return fs, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the snapshot that counts; null before the first."""
    fs, path, system = _hadoop(spark, root)
    pointer = fs.Path(path, POINTER)
    if not system.exists(pointer):
        return None
    stream = system.open(pointer)
    try:
        return bytes(stream.readNBytes(200)).decode()
    finally:
        stream.close()


def read(spark: SparkSession, root: str, *names: str, snapshot: str | None = None) -> dict[str, DataFrame]:
    """Tables of one snapshot, the present one unless named."""
    snapshot = snapshot or current(spark, root)
    if snapshot is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return {name: spark.read.parquet(f"{root}/{snapshot}/{name}") for name in names}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], based_on: str | None) -> str:
    """Writes all ``tables`` in their order, children before parents, and makes them the present snapshot; returns its name."""
    number = int(based_on.partition("-")[0]) + 1 if based_on else 1
    name = f"{number:06d}-{uuid.uuid4().hex[:12]}"
    for table, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/{table}")
    if (now := current(spark, root)) != based_on:
        raise RuntimeError(f"{now} was published meanwhile, not {based_on}")
    fs, path, system = _hadoop(spark, root)
    beside = fs.Path(path, f".{POINTER}-{name}")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, fs.Path(path, POINTER), overwrite)
    return name


def clear_old(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Removes what no reader of the last ``keep`` snapshots needs: older ones and those that were never finished; returns their names."""
    fs, path, system = _hadoop(spark, root)
    now = current(spark, root)
    names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())
    finished = [n for n in names if now and n.partition("-")[0] < now.partition("-")[0]] + ([now] if now else [])
    gone = [n for n in names if n not in finished[-keep:]]
    for n in gone:
        system.delete(fs.Path(path, n), True)
    return gone
