"""Entity operations: pages, upserts, cascades, filters, layers and quality checks.

Everything returns a new DataFrame; rows are never changed one at a time. Deletions are anti-joins, upserts a union and the latest row
of each key, and pages are ordered by a key so that they are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def page(rows: DataFrame, *order, skip: int = 0, limit: int = 100) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def page_with_total(rows: DataFrame, *order, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page whose rows also carry ``total``, the number of all rows: a one-row aggregate joined to the page's few rows."""
    total = rows.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    return page(rows, *order, skip=skip, limit=limit).withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def filtered(rows: DataFrame, archived: bool | None = None, **equal) -> DataFrame:
    """Rows that equal each given value; a value that is None or empty is no condition, and archived rows go unless asked for."""
    for column, value in equal.items():
        if value:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows if archived is not False else rows.where(~F.coalesce("is_archived", F.lit(False)))


def like_any(column: Column, *parts: str) -> Column:
    """Whether the text holds any of the parts, taken literally."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(column, F.lit(part))
    return out


def searchable_columns(rows: DataFrame, sensitive=("password", "token", "secret", "key", "hash")) -> list[str]:
    """Text columns whose names don't hold a sensitive word."""
    return [n for n, kind in rows.dtypes if kind == "string" and not any(s in n.lower() for s in sensitive)]


def search(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``text`` in any searchable column, sensitive ones removed."""
    columns = searchable_columns(rows)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(text.lower()))
    secret = [n for n, kind in rows.dtypes if kind == "string" and n not in columns]
    return rows.where(F.coalesce(hit, F.lit(False))).drop(*secret)


def upsert(old: DataFrame, new: DataFrame, key: list[str], newer: str) -> DataFrame:
    """One row of each key: the one with the greatest ``newer``; of equal ones the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_new"]
    return both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(newer, "_new")).alias("r")).select("r.*")


def patched(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with values of ``changes`` where these are not null."""
    changed = [c for c in changes.columns if c != key]
    right = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changed])
    kept = old.join(right, key, "left")
    return kept.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else c for c in old.columns])


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``: deletion, also of children of deleted parents."""
    return rows.join(keys.select(key), key, "left_anti")


def keep_only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``; with no keys nothing is left."""
    return rows.join(keys.select(key), key, "left_semi")


def first_of(rows: DataFrame, key: list[str], *order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in ``order``: a minimum that each task takes first, so a hot key sends one row for each task."""
    whole, place = F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order)
    best = F.max_by(whole, place) if last else F.min_by(whole, place)
    return rows.groupBy(*key).agg(best.alias("_row")).select("_row.*")


def numbered(rows: DataFrame, key: list[str], *order, name: str = "row_order") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def next_versions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions after a sync. current (source_id, version, checksum, is_active), incoming (source_id, checksum).

    An equal checksum keeps the active version; another one or a new source adds an active version and ends the old one; a source
    that is no longer there goes with all its versions.
    """
    active = current.where("is_active").select("source_id", F.col("version").alias("at"), F.col("checksum").alias("was"))
    state = incoming.join(active, "source_id", "left")
    changed = state.where(F.col("was").isNull() | (F.col("was") != F.col("checksum")))
    old = keep_only(current, incoming, "source_id").join(changed.select("source_id", F.lit(True).alias("_ends")), "source_id", "left").select(
        "source_id", "version", "checksum", (F.col("is_active") & F.col("_ends").isNull()).alias("is_active")
    )
    new = changed.select("source_id", (F.coalesce("at", F.lit(0)) + 1).alias("version"), "checksum", F.lit(True).alias("is_active"))
    return old.unionByName(new)


def nested(conversations: DataFrame, messages: DataFrame, calls: DataFrame, most: int = 1000) -> DataFrame:
    """(conversation_id, part, messages): each conversation with its messages in order, and each message with its tool calls in order.

    ``conversations`` (conversation_id), ``messages`` (conversation_id, seq, role, content), ``calls`` (conversation_id, seq, id, tool_name). Two aggregations, each keyed at its level, so a call
    meets its message before messages meet their conversation. A row holds ``most`` places of the order at most: a long conversation is several parts. One without messages is one empty part.
    """
    called = calls.groupBy("conversation_id", "seq").agg(F.sort_array(F.collect_list(F.struct("id", "tool_name"))).alias("calls"))
    whole = messages.join(called, ["conversation_id", "seq"], "left").withColumn("part", F.floor(F.col("seq") / most))
    message = F.struct("seq", "role", "content", F.coalesce("calls", F.array().cast("array<struct<id:bigint,tool_name:string>>")).alias("calls"))
    told = whole.groupBy("conversation_id", "part").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    return conversations.join(told, "conversation_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def cascade(parents: DataFrame, gone: DataFrame, key: str, **children: tuple[DataFrame, str, str]) -> dict[str, DataFrame]:
    """What stays of ``parents`` without those ``gone``, and of each child table: {name: (rows, its key, key of its parent)}, in order from the parents down.

    A child goes with its parent, and its own children with it; one whose parent's key is null stays.
    """
    out, lost, lost_key = {"parents": without(parents, gone, key)}, gone.select(key), key
    for name, (rows, own, parent) in children.items():
        keys = lost.withColumnRenamed(lost_key, parent)
        out[name] = without(rows, keys, parent)
        lost, lost_key = keep_only(rows, keys, parent).select(own), own
    return out


def rated(old: DataFrame, new: DataFrame, messages: DataFrame) -> DataFrame:
    """Feedback (message_id, user_id, helpful, at) after new ones: one row of each message and user, the last.

    ``new`` ones count only for messages (message_id, owner_id, role) of the assistant in the user's own conversations; others are refused.
    """
    allowed = new.join(messages.where("role = 'assistant'").select("message_id", F.col("owner_id").alias("user_id")), ["message_id", "user_id"], "left_semi")
    return upsert(old, allowed, ["message_id", "user_id"], "at")


def violations(**checks: DataFrame) -> DataFrame:
    """(rule, violations): the number of rows that each check gives."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
