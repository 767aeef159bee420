"""Keyed state that is read, merged, written, cleared and forgotten, and admission by counters, as streams and in batch.

Streams use ``transformWithState`` by event time: a key's rows of a micro-batch are taken in order of time, a timer drops the state once the watermark has
passed all that it holds, and rows later than the watermark are dropped by Spark. Both need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1)
#: What an operation does to its field: replace the value, add to what is still there, or end all fields of the key.
SAVE, APPEND, CLEAR = "save", "append", "clear"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _seconds(time) -> float:
    return (pd.Timestamp(time).tz_localize(None).to_pydatetime() - EPOCH) / dt.timedelta(seconds=1)


def _in_order(batches) -> pd.DataFrame:
    """A key's rows of one micro-batch."""
    return pd.concat(list(batches)).sort_values(["time", "id"])


class _Timed(StatefulProcessor):
    """State of a key with one timer, after which nothing of it holds any more."""

    def _until(self, end: float) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(int(end * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Remembered(_Timed):
    """Fields of a key, each forgotten ``ttl`` seconds after it was last written."""

    def __init__(self, fields: tuple[str, ...], ttl: float):
        self.fields, self.ttl = fields, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getMapState("fields", "field string", "value string, n long, until double")

    def handleInputRows(self, key, rows, timerValues):
        held = {k[0]: tuple(v) for k, v in self.state.iterator()}
        before, out = dict(held), []
        for row in _in_order(rows).itertuples(index=False):
            now = _seconds(row.time)
            held = {f: v for f, v in held.items() if now < v[2]}
            if row.action == CLEAR:
                held = {}
            elif row.action in (SAVE, APPEND):
                n = held[row.field][1] if row.action == APPEND and row.field in held else 0
                held[row.field] = (row.value, n + 1, now + self.ttl)
            out.append((key[0], row.id, *(x for f in self.fields for x in (held.get(f) or (None, 0))[:2])))
        for f in before.keys() - held.keys():
            self.state.removeKey((f,))
        for f, v in held.items():
            if before.get(f) != v:
                self.state.updateValue((f,), v)
        if held:
            self._until(max(v[2] for v in held.values()))
        yield pd.DataFrame(out, columns=["key", "id", *(c for f in self.fields for c in (f, f"{f}_n"))])


def remembered_stream(operations: DataFrame, fields: tuple[str, ...], ttl: float, late: str) -> DataFrame:
    """(key, id, and for each field its value and how many values it holds) after each operation (key, id, time, action, field, value) of a stream."""
    kinds = dict(operations.dtypes)
    schema = f"key {kinds['key']}, id {kinds['id']}, " + ", ".join(f"{f} string, {f}_n long" for f in fields)
    keyed = operations.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late).groupBy("key")
    return keyed.transformWithStateInPandas(Remembered(fields, ttl), schema, "Append", "EventTime")


def remembered(operations: DataFrame, fields: tuple[str, ...], ttl: float) -> DataFrame:
    """The same in batch, by running windows: a field's chain begins with a save, or with an append after a clear or when the last write is forgotten."""
    order = W.partitionBy("key").orderBy("time", "id")
    age = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
    rows = operations.withColumn("era", F.count_if(F.col("action") == CLEAR).over(order))
    in_era = W.partitionBy("key", "era").orderBy("time", "id")
    for f in fields:
        written = (F.col("field") == f) & F.col("action").isin(SAVE, APPEND)
        stamp = F.when(written, F.col("time"))
        before = F.last(stamp, ignorenulls=True).over(in_era.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("_last", F.last(stamp, ignorenulls=True).over(in_era))
        begins = written & ((F.col("action") == SAVE) | before.isNull() | (age(before, F.col("time")) >= ttl))
        rows = rows.withColumn("_chain", F.count_if(begins).over(in_era))
        chain = W.partitionBy("key", "era", "_chain").orderBy("time", "id")
        live = F.coalesce(age(F.col("_last"), F.col("time")) < ttl, F.lit(False))
        rows = rows.withColumn(f, F.when(live, F.last(F.when(written, F.col("value")), ignorenulls=True).over(chain)))
        rows = rows.withColumn(f"{f}_n", F.when(live, F.count_if(written).over(chain)).otherwise(0))
    return rows.select("key", "id", *(c for f in fields for c in (f, f"{f}_n")))


def admit(state: tuple[int, int, int, int], now: float, n: int, per_minute: int, per_day: int, weighed: bool) -> tuple[tuple, tuple]:
    """(state, answer) for a request of ``n``: state is (minute, used in it, day, used in it), answer (admitted, used_minute, used_day, retry_after).

    A request passes if both windows have room for ``n``; only then it counts, once or, if ``weighed``, ``n`` times. The answer has what was used before.
    """
    minute, day = int(now // 60), int(now // 86_400)
    used_minute, used_day = state[1] if state[0] == minute else 0, state[3] if state[2] == day else 0
    full_day, full_minute = used_day + n > per_day, used_minute + n > per_minute
    retry = 86_400 - int(now % 86_400) if full_day else 60 - int(now % 60) if full_minute else 0
    more = 0 if full_day or full_minute else n if weighed else 1
    return (minute, used_minute + more, day, used_day + more), (more > 0, used_minute, used_day, retry)


ADMITTED = "admitted boolean, used_minute int, used_day int, retry_after int"


class Admission(_Timed):
    def __init__(self, per_minute: int, per_day: int, weighed: bool):
        self.limits = (per_minute, per_day, weighed)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("used", "minute long, used_minute int, day long, used_day int")

    def handleInputRows(self, key, rows, timerValues):
        state, out = tuple(self.state.get()) if self.state.exists() else (-1, 0, -1, 0), []
        for row in _in_order(rows).itertuples(index=False):
            state, answer = admit(state, _seconds(row.time), int(row.n), *self.limits)
            out.append((key[0], row.id, *answer))
        self.state.update(state)
        self._until((state[2] + 1) * 86_400)
        yield pd.DataFrame(out, columns=["key", "id", *(c.split()[0] for c in ADMITTED.split(", "))])


def admission_stream(requests: DataFrame, per_minute: int, per_day: int, late: str, weighed: bool = False) -> DataFrame:
    """(key, id, admitted, used_minute, used_day, retry_after) for each request (key, id, time, n) of a stream."""
    kinds = dict(requests.dtypes)
    keyed = requests.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late).groupBy("key")
    return keyed.transformWithStateInPandas(Admission(per_minute, per_day, weighed), f"key {kinds['key']}, id {kinds['id']}, {ADMITTED}", "Append", "EventTime")


def day_of(time: Column) -> Column:
    return F.floor(F.unix_seconds(time.cast("timestamp")) / 86_400)


def admitted(requests: DataFrame, per_minute: int, per_day: int, weighed: bool = False) -> DataFrame:
    """The same in batch. Whether a request passes hangs on all before it on its day, so days of a key lie together in order, many to a batch; the counters start anew each day."""
    kinds = dict(requests.dtypes)

    def fold(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for key, day, micros, n in zip(*(batch.column(c).to_pylist() for c in ("key", "day", "micros", "n")), strict=True):
                if (key, day) != last:
                    last, state = (key, day), (-1, 0, -1, 0)
                state, answer = admit(state, micros / 1e6, n, per_minute, per_day, weighed)
                out.append(answer)
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.bool_(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), *columns], names=["key", "id", *(c.split()[0] for c in ADMITTED.split(", "))])

    rows = requests.select("key", "id", F.unix_micros(F.col("time").cast("timestamp")).alias("micros"), F.col("n").cast("int").alias("n"), day_of(F.col("time")).alias("day"))
    return rows.repartition("key", "day").sortWithinPartitions("key", "day", "micros", "id").mapInArrow(fold, f"key {kinds['key']}, id {kinds['id']}, {ADMITTED}")
