"""Streams with state against sequential models, and against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.streaming import counters, stateful

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocksdb(spark):
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, rows, schema, make, name, parts=3):
    """What ``make`` gives for a stream of ``rows``, which come in ``parts`` files in order of time, one for each micro-batch."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return sorted(tuple(r) for r in counters.run_available(make(stream), name, str(tmp_path / "checkpoint"), "append").collect())


def operations(n=300, seed=1):
    rng = random.Random(seed)
    times = sorted(rng.randrange(6 * 86_400) for _ in range(n))
    pick = lambda: rng.choice([("save", "subject"), ("append", "history"), ("append", "history"), ("save", "text"), ("clear", None), ("read", None)])
    return [(rng.randrange(3), i, START + timedelta(seconds=t), *pick(), f"v{i}") for i, t in enumerate(times)]


SCHEMA = "key int, id int, time timestamp_ntz, action string, field string, value string"
FIELDS = ("subject", "text", "history")


def remembered_plainly(rows, ttl):
    held, out = {}, []
    for key, id_, time, action, field, value in sorted(rows, key=lambda r: (r[2], r[1])):
        state = {f: v for f, v in held.get(key, {}).items() if (time - v[2]).total_seconds() < ttl}
        if action == "clear":
            state = {}
        elif action == "save":
            state[field] = (value, 1, time)
        elif action == "append":
            state[field] = (value, state.get(field, (None, 0))[1] + 1, time)
        held[key] = state
        out.append((key, id_, *(x for f in FIELDS for x in state.get(f, (None, 0))[:2])))
    return sorted(out)


@pytest.mark.parametrize("ttl", [3600 * 6, 86_400])
def test_remembered_in_batch(spark, ttl):
    rows = operations()
    assert sorted(tuple(r) for r in stateful.remembered(spark.createDataFrame(rows, SCHEMA), FIELDS, ttl).collect()) == remembered_plainly(rows, ttl)


def test_remembered_as_a_stream(rocksdb, tmp_path):
    rows = operations(seed=2)
    got = streamed(rocksdb, tmp_path, rows, SCHEMA, lambda s: stateful.remembered_stream(s, FIELDS, 3600 * 6, "1 day"), "remembered")
    assert got == remembered_plainly(rows, 3600 * 6)


def requests(n=400, seed=3):
    rng = random.Random(seed)
    at = lambda: timedelta(seconds=rng.randrange(2 * 86_400)) if rng.random() < 0.4 else timedelta(hours=5, seconds=rng.randrange(180))
    return [(rng.randrange(3), i, START + at(), rng.randint(1, 5)) for i in range(n)]


def admitted_plainly(rows, per_minute, per_day, weighed):
    minutes, days, out = {}, {}, []
    for key, id_, time, n in sorted(rows, key=lambda r: (r[2], r[1])):
        minute, day = (key, time.replace(second=0)), (key, time.date())
        used, today = minutes.get(minute, 0), days.get(day, 0)
        left_of_day = 86_400 - (time - datetime.combine(time.date(), datetime.min.time())).seconds
        retry = left_of_day if today + n > per_day else 60 - time.second if used + n > per_minute else 0
        if not retry:
            minutes[minute], days[day] = used + (n if weighed else 1), today + (n if weighed else 1)
        out.append((key, id_, not retry, used, today, retry))
    return sorted(out)


@pytest.mark.parametrize("weighed", [False, True])
def test_admission_of_several_at_once_in_batch(spark, weighed):
    rows = requests()
    got = stateful.admitted(spark.createDataFrame(rows, "key int, id int, time timestamp_ntz, n int"), 15, 40, weighed)
    assert sorted(tuple(r) for r in got.collect()) == admitted_plainly(rows, 15, 40, weighed)


@pytest.mark.parametrize("weighed", [False, True])
def test_admission_of_several_at_once_as_a_stream(rocksdb, tmp_path, weighed):
    rows = requests(seed=4)
    got = streamed(rocksdb, tmp_path, rows, "key int, id int, time timestamp_ntz, n int", lambda s: stateful.admission_stream(s, 15, 40, "2 days", weighed), f"admitted_{weighed}")
    assert got == admitted_plainly(rows, 15, 40, weighed)


def test_a_forgotten_key_leaves_the_store(rocksdb, tmp_path):
    """The timer of a key runs out when the watermark passes it; then the store is empty but for the keys that came last."""
    rows = [(k, k, START + timedelta(days=2 * k), "save", "subject", "x") for k in range(6)]
    spark = rocksdb
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        stateful.remembered_stream(stream, FIELDS, 3600, "1 hour").writeStream.outputMode("append").format("memory").queryName("forgotten")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("forgotten").count() == 6
    state = spark.read.format("statestore").option("stateVarName", "fields").load(str(tmp_path / "checkpoint"))
    assert state.where(F.col("key").isNotNull()).count() == 1
