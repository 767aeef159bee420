"""Conversation, feedback and tool analytics as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import text as T

LONG = "bigint"


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, half-even rounded; 0 of nothing is 0."""
    return F.when(whole > 0, F.bround(part / whole * 100, digits)).otherwise(F.lit(0.0))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """total, helpful, unhelpful, helpful_rate in one pass."""
    out = feedback.agg(F.count("helpful").alias("total"), F.count_if("helpful").alias("helpful"), F.count_if(~F.col("helpful")).alias("unhelpful"))
    return out.withColumn("helpful_rate", rate(F.col("helpful"), F.col("total")))


def top_questions(messages: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent user texts; then the latest, then by text."""
    return messages.where("role = 'user'").groupBy("content").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq")).orderBy(F.desc("n"), F.desc_nulls_last("last_seq"), "content").limit(k)


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values that are not null; then by value."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def intent_quality(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """(intent, total, helpful, unhelpful, helpful_rate) of messages (message_id, intent) with feedback; most unhelpful first."""
    out = messages.where("intent IS NOT NULL").join(feedback, "message_id").groupBy("intent").agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("helpful"), 1).otherwise(0)).cast(LONG).alias("helpful"), F.sum(F.when(~F.col("helpful"), 1).otherwise(0)).cast(LONG).alias("unhelpful")
    )
    return out.withColumn("helpful_rate", rate(F.col("helpful"), F.col("total"))).orderBy(F.desc("unhelpful"), F.desc("total"), "intent")


def top_procedures(results: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent labels of JSON results whose ``matched`` is true: title, else procedure_id; broken JSON counts for nothing."""
    parsed = F.from_json("result", "matched boolean, title string, procedure_id string", {"mode": "PERMISSIVE"})
    label = F.coalesce(F.nullif(F.trim("r.title"), F.lit("")), F.nullif(F.trim("r.procedure_id"), F.lit("")))
    rows = results.select(parsed.alias("r")).where("r.matched").select(label.alias("label"))
    return top_values(rows, "label", k)


def overview(messages: DataFrame, feedback: DataFrame, calls: DataFrame) -> DataFrame:
    """Totals of all parts in one row, each part aggregated once."""
    m = messages.agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"), F.count_distinct("conversation_id").alias("conversations"))
    c = calls.agg(F.count("*").alias("tool_calls"), F.count_distinct("tool_name").alias("tools"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(m).join(one(feedback_summary(feedback)), "_one").join(one(c), "_one").drop("_one")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def layer_counts(**layers: DataFrame) -> DataFrame:
    """(layer, n) of several tables."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def semester_summary(courses: DataFrame, shown: int = 20) -> DataFrame:
    """(catalog_id, track, semester): courses, credits and the first ``shown`` names in order; courses have (ord, name, credits)."""
    keyed = courses.select(
        "catalog_id", F.coalesce(F.nullif("track", F.lit("")), F.lit("khac")).alias("track"), F.coalesce(F.col("semester").cast("string"), F.lit("Khong ro hoc ky")).alias("semester"), "ord", "name", "credits"
    )
    keys = ("catalog_id", "track", "semester")
    totals = keyed.groupBy(*keys).agg(F.count("*").alias("courses"), F.sum("credits").cast(LONG).alias("credits"))
    # A rank that is limited is cut by each task before the exchange, so no list grows with its group.
    first = keyed.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("ord", "name"))).where(F.col("rank") <= shown)
    names = first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), "; ").alias("first_names"))
    same = [totals[k].eqNullSafe(names[k]) for k in keys]
    return totals.join(names, same).select(*[totals[k] for k in keys], "courses", "credits", "first_names")


def success_rate(processed: Column, failed: Column) -> Column:
    return F.when(processed + failed == 0, F.lit(100.0)).otherwise(processed / (processed + failed) * 100)


def conversation_latest(messages: DataFrame) -> DataFrame:
    """(conversation_id, messages, last_seq, last_role, last_content)."""
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("messages"), F.max("seq").alias("last_seq"), F.max_by("role", "seq").alias("last_role"), F.max_by("content", "seq").alias("last_content")
    )


def since_last_user(messages: DataFrame) -> DataFrame:
    """Each message with ``user_seq``, the latest user message up to it."""
    w = W.partitionBy("conversation_id").orderBy("seq")
    return messages.withColumn("user_seq", F.last(F.when(F.col("role") == "user", F.col("seq")), True).over(w))


def history_context(messages: DataFrame, turns: int = 2, chars: int = 100) -> DataFrame:
    """Each message with ``context``: the ``turns`` messages before it, each cut, one to a line."""
    w = W.partitionBy("conversation_id").orderBy("seq").rowsBetween(-turns, -1)
    return messages.withColumn("context", F.concat_ws("\n", F.collect_list(F.concat(F.lit("- "), F.substring(F.coalesce("content", F.lit("")), 1, chars))).over(w)))


def keywords_once(keywords: Column) -> Column:
    """Keywords without case-insensitive repeats, first spelling and order kept."""
    spelt = F.filter(F.transform(keywords, lambda k, i: F.struct(F.lower(F.trim(k)).alias("low"), i.alias("i"), F.trim(k).alias("k"))), lambda x: x["k"] != "")
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["low"] != x["low"]))  # noqa: E731  of each run of equal ones
    places = lambda s: F.transform(first(s), lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k")))
    return F.transform(F.sort_array(T.let(F.sort_array(spelt), places)), lambda x: x["k"])


def spans(calls: DataFrame) -> DataFrame:
    """(tool_name, n, mean_value, errors): slowest first, ten of them."""
    return calls.groupBy("tool_name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") < 0).alias("errors")).orderBy(F.desc("mean_value"), "tool_name").limit(10)
