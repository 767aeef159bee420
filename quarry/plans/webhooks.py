"""Webhook deliveries as queries with their SQL: nations subscribe to what users do."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import webhooks as H
from quarry.plans import duck as D
from quarry.sources import adapters as A

#: What an event of the tables is called; "error" has no name among those that exist.
NAMES = {"signup": "user.created", "view": "item.updated", "click": "user.updated", "purchase": "item.created", "error": "user.error"}


def _deliveries(spark, sf_dir):
    named = F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.col("event_type"))
    events = A.table(spark, sf_dir, "events").select("event_id", named.alias("event_type"), F.col("props").alias("data"), F.col("ts").alias("at"), "value")
    two = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("user.created"), F.lit("item.created"))).otherwise(F.array(F.lit("item.updated"), F.lit("user.error")))
    hooks = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("webhook_id"), F.repeat("n_name", F.col("n_nationkey") % 12 + 1).alias("secret"), two.alias("events"), (F.col("n_regionkey") != 4).alias("is_active"))
    status = (F.floor("value") * 7 % 400 + 150).cast("int")
    answers = H.subscribed(events, hooks).where("value < 60").select(
        "webhook_id", "event_id", F.when(F.col("value") > 2, status).alias("status"), F.repeat("data", 2000).alias("body"), F.when(F.col("value") <= 2, "timed out").alias("error")
    )
    return events, hooks, answers


def webhook_history(spark, sf_dir):
    """The ten newest deliveries of each subscriber, their signatures verified, with totals."""
    events, hooks, answers = _deliveries(spark, sf_dir)
    page = H.verified(H.delivery_page(events, hooks, answers, limit=10).join(hooks.select("webhook_id", "secret"), "webhook_id"), "payload", "signature", "secret")
    return page.select("webhook_id", "event_id", "event_type", "payload", "signature", "verified", "response_status", F.length("response_body").alias("kept"), "success", "message", F.col("place").cast("bigint").alias("place"), "total", "delivered")


def webhook_outcomes(spark, sf_dir):
    """Deliveries by type and outcome, and events of types that don't exist."""
    events, hooks, answers = _deliveries(spark, sf_dir)
    log = H.delivery_log(H.dispatched(events, hooks), answers)
    counted = log.groupBy("event_type", "success", "message").agg(F.count(F.lit(1)).alias("n"))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.col("event_type"))
    odd = H.unknown_types(A.table(spark, sf_dir, "events").select(named.alias("event_type"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(odd.select("event_type", F.lit(False).alias("success"), F.lit("unknown type").alias("message"), "n"))


def _key_sql(pad):
    byte = f"printf('%02x', xor(CASE WHEN i <= length(key) // 2 THEN ('0x' || substr(key, 2 * i - 1, 2))::INTEGER ELSE 0 END, {pad}))"
    return f"unhex(array_to_string(list_transform(range(1, 65), lambda i: {byte}), ''))"


_NAMED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
_LOG_SQL = f"""e AS (SELECT event_id, {_NAMED} AS event_type, props AS data, ts AS "at", value FROM events
), k AS (SELECT n_nationkey AS webhook_id, CASE WHEN strlen(secret) > 64 THEN sha256(secret) ELSE lower(hex(encode(secret))) END AS key, CASE WHEN n_nationkey % 3 = 0 THEN ['user.created', 'item.created'] ELSE ['item.updated', 'user.error'] END AS events
  FROM (SELECT *, repeat(n_name, n_nationkey % 12 + 1) AS secret FROM nation) WHERE n_regionkey <> 4
), h AS (SELECT webhook_id, {_key_sql(0x36)} AS inside, {_key_sql(0x5C)} AS outside, unnest(events) AS event_type FROM k
), p AS (SELECT *, '{{"event": "' || event_type || '", "timestamp": "' || strftime("at", '%Y-%m-%dT%H:%M:%S.%f') || '+00:00", "data": ' || coalesce(data, 'null') || '}}' AS payload FROM e WHERE event_type IN ({D.words(H.EVENT_TYPES)})
), sent AS (SELECT *, (floor(value) * 7 % 400 + 150)::INTEGER AS code FROM p JOIN h USING (event_type)
), log AS (SELECT webhook_id, event_id, event_type, "at", payload, inside, outside, CASE WHEN value < 60 AND value > 2 THEN code END AS response_status, CASE WHEN value < 60 THEN least({H.BODY}, 2000 * length(data)) END AS kept,
    coalesce(value > 2 AND value < 60 AND code BETWEEN 200 AND 299, FALSE) AS success, CASE WHEN value <= 2 THEN 'timed out' WHEN value >= 60 THEN 'no answer' ELSE 'Delivered successfully' END AS message FROM sent)"""

QUERIES = {f.__name__: f for f in (webhook_history, webhook_outcomes)}
ORACLES = {
    "webhook_history": f"""WITH {_LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY webhook_id ORDER BY "at" DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY webhook_id) AS total, count(*) FILTER (WHERE success) OVER (PARTITION BY webhook_id) AS delivered FROM log)
SELECT webhook_id, event_id, event_type, payload, 'sha256=' || sha256(outside || unhex(sha256(inside || encode(payload)))) AS signature, TRUE AS verified, response_status, kept::INTEGER AS kept, success, message, place, total, delivered FROM r WHERE place <= 10""",
    "webhook_outcomes": f"WITH {_LOG_SQL} SELECT event_type, success, message, count(*) AS n FROM log GROUP BY ALL UNION ALL SELECT event_type, FALSE, 'unknown type', count(*) FROM e WHERE event_type NOT IN ({D.words(H.EVENT_TYPES)}) GROUP BY ALL",
}
