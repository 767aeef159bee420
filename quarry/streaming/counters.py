"""Windowed counters, admission and expiring state, in batch and as streams.

Batch and streaming forms of a counter are the same expression; a stream only adds the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tumbling_counts(events: DataFrame, width: str, key: str = "user_id", time: str = "ts", late: str | None = None) -> DataFrame:
    """(key, window_start, n); on a stream give ``late``, how long to wait for late events."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if late:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def admission(events: DataFrame, per_minute: int = 15, per_day: int = 1500, key: str = "user_id", time: str = "ts", order: str = "event_id") -> DataFrame:
    """Each event with admitted, remaining_minute and retry_after (seconds to the end of what denied it).

    Only admitted events count. With one event at a time that is a rank: an event passes its minute if it is among its first
    ``per_minute``, and its day if fewer than ``per_day`` of the day's earlier events passed theirs.
    """
    minute, day = F.date_trunc("minute", time), F.date_trunc("day", time)
    in_minute = W.partitionBy(key, minute).orderBy(time, order)
    rows = events.withColumn("_in_minute", F.row_number().over(in_minute)).withColumn("_fits", F.col("_in_minute") <= per_minute)
    before = W.partitionBy(key, day).orderBy(time, order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_used_today", F.coalesce(F.sum(F.col("_fits").cast("int")).over(before), F.lit(0)))
    seconds = lambda unit, length: F.lit(length) - (F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.date_trunc(unit, F.col(time)).cast("timestamp")))
    full_day = F.col("_used_today") >= per_day
    admitted = F.col("_fits") & ~full_day
    return rows.select(
        *events.columns, admitted.alias("admitted"), F.greatest(F.lit(0), per_minute - F.col("_in_minute")).cast("long").alias("remaining_minute"),
        F.when(admitted, 0).when(full_day, seconds("day", 86400)).otherwise(seconds("minute", 60)).cast("long").alias("retry_after"),
    )


def last_within(events: DataFrame, hours: int = 24, key: str = "user_id", time: str = "ts", value: str = "props", order: str = "event_id") -> DataFrame:
    """Each event with ``state``: the previous event's value if that is at most ``hours`` old."""
    w = W.partitionBy(key).orderBy(time, order)
    age = F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.lag(time).over(w).cast("timestamp"))
    return events.withColumn("state", F.when(age <= hours * 3600, F.lag(value).over(w)))


def once(calls: DataFrame, key: str = "tool_call_id", time: str = "ts", late: str | None = None) -> DataFrame:
    """Calls without repeats of a key; on a stream within the watermark ``late``."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if late else calls.dropDuplicates([key])


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that ``stream`` gives for what is there now, as a table in memory: for tests and small jobs."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
