"""Analytics, streaming and windowed queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analytics as N
from quarry.sources import adapters as A
from quarry.streaming import counters as S


def feedback_summary(spark, sf_dir):
    return N.feedback_summary(A.feedback(spark, sf_dir))


def top_questions(spark, sf_dir):
    return N.top_questions(A.messages(spark, sf_dir))


def top_tools(spark, sf_dir):
    return N.top_values(A.tool_calls(spark, sf_dir), "tool_name")


def tool_call_count(spark, sf_dir):
    return A.tool_calls(spark, sf_dir).where("tool_name = 'click'").agg(F.count("*").alias("n"))


def intent_quality(spark, sf_dir):
    """Events as messages with their type as intent; the label of document event_id mod 1000 as feedback."""
    messages = A.tool_calls(spark, sf_dir).select((F.col("id") % 1000).alias("message_id"), F.col("tool_name").alias("intent"))
    return N.intent_quality(messages, A.feedback(spark, sf_dir).select("message_id", "helpful"))


def top_procedures_json(spark, sf_dir):
    """Tool results made of the events: some broken, some unmatched, titles missing at times."""
    k = F.get_json_object("result", "$.k").try_cast("int")
    made = F.when(k % 7 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct((k % 2 == 0).alias("matched"), F.when(k % 3 != 0, F.concat(F.lit(" "), "tool_name")).alias("title"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("procedure_id")))
    )
    return N.top_procedures(A.tool_calls(spark, sf_dir).select(made.alias("result")))


def overview(spark, sf_dir):
    return N.overview(A.messages(spark, sf_dir), A.feedback(spark, sf_dir), A.tool_calls(spark, sf_dir))


def status_histogram(spark, sf_dir):
    return N.histogram(A.table(spark, sf_dir, "orders"), "o_orderstatus")


def layer_counts(spark, sf_dir):
    return N.layer_counts(**{t: A.table(spark, sf_dir, t) for t in ("documents", "labels", "conversations", "orders", "lineitem", "customer", "supplier", "part", "nation", "region")})


def semester_summary(spark, sf_dir):
    """Nations as catalogues, parts as courses: track from the part's type, semester from its size, credits from the quantity sold."""
    courses = (
        A.table(spark, sf_dir, "lineitem").join(A.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(A.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("s_nationkey").alias("catalog_id"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("track"), F.when(F.col("p_size") <= 8, F.col("p_size")).alias("semester"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("l_quantity").alias("credits"),
        )
    )
    return N.semester_summary(courses)


def conversation_latest(spark, sf_dir):
    return N.conversation_latest(A.messages(spark, sf_dir))


def since_last_user(spark, sf_dir):
    return N.since_last_user(A.messages(spark, sf_dir)).select("conversation_id", "seq", "role", "user_seq")


def history_context(spark, sf_dir):
    return N.history_context(A.messages(spark, sf_dir)).select("conversation_id", "seq", "context")


def messages_per_user(spark, sf_dir):
    return A.tool_calls(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))


def pipeline_success(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") != "P").alias("processed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))
    return rows.select("o_orderpriority", "processed", "failed", F.round(N.success_rate(F.col("processed"), F.col("failed")), 6).alias("success_rate"))


def span_latency(spark, sf_dir):
    return N.spans(A.tool_calls(spark, sf_dir))


def duration_ms(spark, sf_dir):
    """Milliseconds between an event and the same user's next one."""
    from pyspark.sql import Window as W

    after = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = A.table(spark, sf_dir, "events").withColumn("later", after).where("later IS NOT NULL")
    return rows.select("event_id", F.expr("timestampdiff(MILLISECOND, ts, later)").alias("duration_ms"))


def tumbling_minute_counts(spark, sf_dir):
    return S.tumbling_counts(A.table(spark, sf_dir, "events"), "1 minute")


def tumbling_day_counts(spark, sf_dir):
    return S.tumbling_counts(A.table(spark, sf_dir, "events"), "1 day")


def rate_limit_admission(spark, sf_dir):
    return S.admission(A.table(spark, sf_dir, "events"), 1, 5).select("event_id", "admitted", "remaining_minute", "retry_after")


def ttl_last_state(spark, sf_dir):
    return S.last_within(A.table(spark, sf_dir, "events")).select("event_id", "state")


QUERIES = {
    f.__name__: f
    for f in (
        feedback_summary, top_questions, top_tools, tool_call_count, intent_quality, top_procedures_json, overview, status_histogram, layer_counts, semester_summary, conversation_latest, since_last_user,
        history_context, messages_per_user, pipeline_success, span_latency, duration_ms, tumbling_minute_counts, tumbling_day_counts, rate_limit_admission, ttl_last_state,
    )
}

_RATE = "CASE WHEN {t} > 0 THEN round_even({h} / {t} * 100, 2) ELSE 0.0 END"
ORACLES = {
    "feedback_summary": f"SELECT total, helpful, unhelpful, {_RATE.format(h='helpful', t='total')} AS helpful_rate FROM (SELECT count(quality) AS total, count(*) FILTER (quality = 1) AS helpful, count(*) FILTER (quality <> 1) AS unhelpful FROM labels)",
    "top_questions": "SELECT text AS content, count(*) AS n, max(turn) AS last_seq FROM conversations WHERE role = 'user' GROUP BY text ORDER BY n DESC, last_seq DESC, content LIMIT 10",
    "top_tools": "SELECT event_type AS tool_name, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, tool_name LIMIT 10",
    "tool_call_count": "SELECT count(*) AS n FROM events WHERE event_type = 'click'",
    "intent_quality": f"SELECT intent, total, helpful, unhelpful, {_RATE.format(h='helpful', t='total')} AS helpful_rate FROM (SELECT event_type AS intent, count(*) AS total, count(*) FILTER (quality = 1) AS helpful, count(*) FILTER (quality <> 1) AS unhelpful FROM events JOIN labels ON event_id % 1000 = doc_id GROUP BY 1)",
    "top_procedures_json": """WITH e AS (SELECT event_type, (props->>'$.k')::INT AS k FROM events), l AS (
      SELECT CASE WHEN k % 3 <> 0 THEN event_type ELSE 'p' || (k % 5) END AS label FROM e WHERE k % 7 <> 0 AND k % 2 = 0)
      SELECT label, count(*) AS n FROM l GROUP BY label ORDER BY n DESC, label LIMIT 10""",
    "overview": f"""SELECT messages, assistant_messages, conversations, total, helpful, unhelpful, {_RATE.format(h='helpful', t='total')} AS helpful_rate, tool_calls, tools FROM
      (SELECT count(*) AS messages, count(*) FILTER (role = 'assistant') AS assistant_messages, count(DISTINCT conv_id) AS conversations FROM conversations),
      (SELECT count(quality) AS total, count(*) FILTER (quality = 1) AS helpful, count(*) FILTER (quality <> 1) AS unhelpful FROM labels), (SELECT count(*) AS tool_calls, count(DISTINCT event_type) AS tools FROM events)""",
    "status_histogram": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "layer_counts": " UNION ALL ".join(f"SELECT '{t}' AS layer, count(*) AS n FROM {t}" for t in ("documents", "labels", "conversations", "orders", "lineitem", "customer", "supplier", "part", "nation", "region")),
    "semester_summary": """WITH c AS (SELECT s_nationkey AS catalog_id, coalesce(nullif(CASE WHEN p_partkey % 9 <> 0 THEN p_type END, ''), 'khac') AS track, coalesce((CASE WHEN p_size <= 8 THEN p_size END)::VARCHAR, 'Khong ro hoc ky') AS semester,
      l_orderkey, l_linenumber, l_partkey, p_name, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
      SELECT catalog_id, track, semester, count(*) AS courses, sum(l_quantity)::BIGINT AS credits, array_to_string(list_slice(list(p_name ORDER BY l_orderkey, l_linenumber, l_partkey, p_name), 1, 20), '; ') AS first_names FROM c GROUP BY ALL""",
    "conversation_latest": "SELECT conv_id AS conversation_id, count(*) AS messages, max(turn) AS last_seq, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_content FROM conversations GROUP BY 1",
    "since_last_user": "SELECT conv_id AS conversation_id, turn AS seq, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS user_seq FROM conversations",
    "history_context": """SELECT conv_id AS conversation_id, turn AS seq, concat_ws(chr(10), lag('- ' || substr(text, 1, 100), 2) OVER w, lag('- ' || substr(text, 1, 100), 1) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "messages_per_user": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "pipeline_success": "SELECT o_orderpriority, processed, failed, round(CASE WHEN processed + failed = 0 THEN 100.0 ELSE processed / (processed + failed) * 100 END, 6) AS success_rate FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'P') AS processed, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1)",
    "span_latency": "SELECT event_type AS tool_name, count(*) AS n, round(avg(value), 6) AS mean_value, count(*) FILTER (value < 0) AS errors FROM events GROUP BY 1 ORDER BY mean_value DESC, tool_name LIMIT 10",
    "duration_ms": "SELECT event_id, date_sub('millisecond', ts, later) AS duration_ms FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events) WHERE later IS NOT NULL",
    "tumbling_minute_counts": "SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2",
    "tumbling_day_counts": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1, 2",
    "rate_limit_admission": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM events),
      d AS (SELECT *, coalesce(sum(CASE WHEN r <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m)
      SELECT event_id, r <= 1 AND used < 5 AS admitted, greatest(0, 1 - r)::BIGINT AS remaining_minute,
        (CASE WHEN r <= 1 AND used < 5 THEN 0 WHEN used >= 5 THEN 86400 - (floor(epoch(ts)) - floor(epoch(date_trunc('day', ts)::TIMESTAMP))) ELSE 60 - (floor(epoch(ts)) - floor(epoch(date_trunc('minute', ts)))) END)::BIGINT AS retry_after FROM d""",
    "ttl_last_state": "SELECT event_id, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 86400 THEN lag(props) OVER w END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
}
