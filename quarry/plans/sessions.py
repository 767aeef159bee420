"""Conversations, sessions and previews as queries with their SQL: events stand for sessions, orders and lines for documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import entities as E
from quarry.sources import adapters as A


def conversation_titles(spark, sf_dir):
    """A conversation's title: the first 50 characters of its first user message."""
    asked = E.first_of(A.messages(spark, sf_dir).where("role = 'user'"), ["conversation_id"], "seq")
    return asked.select("conversation_id", F.substring("content", 1, 50).alias("title"))


def messages_with_conversation(spark, sf_dir):
    """Each message beside its conversation, which was last changed with its last message."""
    rows = A.messages(spark, sf_dir)
    return rows.join(rows.groupBy("conversation_id").agg(F.max("seq").alias("updated")), "conversation_id").select("conversation_id", "seq", "role", "updated")


def calls_in_order(spark, sf_dir):
    return E.page(A.tool_calls(spark, sf_dir), "started_at", "id", limit=100).select("id", "tool_name", "started_at")


def sessions_deactivated(spark, sf_dir):
    """How many active sessions (those with a value above 50) each user ends."""
    return A.tool_calls(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("ended"))


def sessions_valid(spark, sf_dir):
    """Active sessions that end, seven days after their start, later than 20 January, the last used first."""
    rows = A.tool_calls(spark, sf_dir).where((F.col("value") > 50) & (F.col("started_at") + F.expr("INTERVAL 7 DAYS") > F.lit("2024-01-20").cast("timestamp_ntz")))
    return rows.select("id", "user_id", "started_at").orderBy(F.desc("started_at"), "id")


def sessions_expired(spark, sf_dir):
    return A.tool_calls(spark, sf_dir).where(F.col("started_at") < F.lit("2024-01-10").cast("timestamp_ntz")).agg(F.count("*").alias("expired"))


def document_preview(spark, sf_dir):
    """The first four orders of each customer with the first four lines of each."""
    orders = E.numbered(A.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", name="table_no").where("table_no <= 4")
    lines = E.numbered(A.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey").where("row_order <= 4")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", F.col("table_no").cast("bigint").alias("table_no"), F.col("row_order").cast("bigint").alias("row_order"), "l_partkey")


QUERIES = {f.__name__: f for f in (conversation_titles, messages_with_conversation, calls_in_order, sessions_deactivated, sessions_valid, sessions_expired, document_preview)}
ORACLES = {
    "conversation_titles": "SELECT conv_id AS conversation_id, substr(arg_min(coalesce(text, ''), turn), 1, 50) AS title FROM conversations WHERE role = 'user' GROUP BY 1",
    "messages_with_conversation": "SELECT conv_id AS conversation_id, turn AS seq, role, max(turn) OVER (PARTITION BY conv_id) AS updated FROM conversations",
    "calls_in_order": "SELECT event_id AS id, event_type AS tool_name, ts AS started_at FROM events ORDER BY ts, event_id LIMIT 100",
    "sessions_deactivated": "SELECT user_id, count(*) FILTER (WHERE value > 50) AS ended FROM events GROUP BY 1",
    "sessions_valid": "SELECT event_id AS id, user_id, ts AS started_at FROM events WHERE value > 50 AND ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20'",
    "sessions_expired": "SELECT count(*) AS expired FROM events WHERE ts < TIMESTAMP '2024-01-10'",
    "document_preview": """SELECT o_custkey, o_orderkey, table_no, row_order, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS table_no FROM orders) o JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row_order FROM lineitem) l ON o_orderkey = l_orderkey WHERE table_no <= 4 AND row_order <= 4""",
}
