"""Stateful streams in their batch form as queries, with their SQL: events stand for what is written to a conversation, and for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.sources import adapters as A
from quarry.streaming import stateful as S

TTL = 86_400
FIELDS = ("subject", "text", "history")
#: What an event does to the state of its user: action and field.
WRITES = {"view": (S.SAVE, "subject"), "purchase": (S.SAVE, "text"), "click": (S.APPEND, "history"), "error": (S.CLEAR, None), "signup": ("read", None)}
PER_MINUTE, PER_DAY = 4, 8


def conversation_state(spark, sf_dir):
    """The whole state of a user after each event: subject and text with the last value, history with the last of several, each for a day after it was written."""
    events = A.table(spark, sf_dir, "events")
    of = lambda i: F.element_at(F.create_map(*[x for name, w in WRITES.items() for x in (F.lit(name), F.lit(w[i]))]), F.col("event_type"))
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("time"), of(0).alias("action"), of(1).alias("field"), F.col("props").alias("value"))
    return S.remembered(rows, FIELDS, TTL)


def admission_of_several(spark, sf_dir):
    """Which requests of one to five pass, each that passes counted once."""
    events = A.table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("time"), (F.col("event_id") % 5 + 1).alias("n"))
    return S.admitted(rows, PER_MINUTE, PER_DAY)


def admission_weighed(spark, sf_dir):
    """As above, each that passes counted as often as it asks for."""
    events = A.table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("time"), (F.col("event_id") % 5 + 1).alias("n"))
    return S.admitted(rows, PER_MINUTE, PER_DAY, weighed=True)


def _field_sql(field):
    saves = " OR ".join(f"event_type = '{t}'" for t, (a, f) in WRITES.items() if f == field and a == S.SAVE) or "FALSE"
    writes = " OR ".join(f"event_type = '{t}'" for t, (_, f) in WRITES.items() if f == field)
    return f"""{field}_a AS (SELECT *, CASE WHEN {writes} THEN ts END AS wrote, last_value(CASE WHEN {writes} THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id, era ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM eras
), {field}_b AS (SELECT *, count(*) FILTER (WHERE wrote IS NOT NULL AND (({saves}) OR before IS NULL OR epoch_us(ts) - epoch_us(before) >= {TTL}000000)) OVER w AS chain, last_value(wrote IGNORE NULLS) OVER w AS latest
  FROM {field}_a WINDOW w AS (PARTITION BY user_id, era ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), {field}_c AS (SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(latest) < {TTL}000000 THEN last_value(CASE WHEN wrote IS NOT NULL THEN props END IGNORE NULLS) OVER w END AS {field},
    CASE WHEN epoch_us(ts) - epoch_us(latest) < {TTL}000000 THEN count(wrote) OVER w ELSE 0 END AS {field}_n
  FROM {field}_b WINDOW w AS (PARTITION BY user_id, era, chain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


_ENDS = " OR ".join(f"event_type = '{t}'" for t, (a, _) in WRITES.items() if a == S.CLEAR)
_STATE_SQL = f"""WITH eras AS (SELECT *, count(*) FILTER (WHERE {_ENDS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM events), {", ".join(map(_field_sql, FIELDS))}
SELECT user_id AS key, event_id AS id, {", ".join(f"{f}, {f}_n" for f in FIELDS)} FROM events {" ".join(f"JOIN {f}_c USING (event_id)" for f in FIELDS)}"""


def _admission_sql(more):
    return f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_id % 5 + 1 AS n, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT // 60 AS m, floor(epoch(ts))::BIGINT // 86400 AS d,
    row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 86400 ORDER BY ts, event_id) AS r FROM events
), f AS (
  SELECT user_id, d, r, m, event_id, n, s, 0::BIGINT AS used_minute, 0::BIGINT AS used_day, n <= {PER_MINUTE} AND n <= {PER_DAY} AS admitted FROM e WHERE r = 1
  UNION ALL
  SELECT user_id, d, r, m, event_id, n, s, a, b, b + n <= {PER_DAY} AND a + n <= {PER_MINUTE} FROM (
    SELECT e.user_id, e.d, e.r, e.m, e.event_id, e.n, e.s, CASE WHEN e.m = f.m THEN f.used_minute + CASE WHEN f.admitted THEN {more} ELSE 0 END ELSE 0 END AS a, f.used_day + CASE WHEN f.admitted THEN {more} ELSE 0 END AS b
    FROM f JOIN e ON e.user_id = f.user_id AND e.d = f.d AND e.r = f.r + 1)
) SELECT user_id AS key, event_id AS id, admitted, used_minute::INTEGER AS used_minute, used_day::INTEGER AS used_day,
  (CASE WHEN used_day + n > {PER_DAY} THEN 86400 - s % 86400 WHEN used_minute + n > {PER_MINUTE} THEN 60 - s % 60 ELSE 0 END)::INTEGER AS retry_after FROM f"""


QUERIES = {f.__name__: f for f in (conversation_state, admission_of_several, admission_weighed)}
ORACLES = {"conversation_state": _STATE_SQL, "admission_of_several": _admission_sql("1"), "admission_weighed": _admission_sql("f.n")}
