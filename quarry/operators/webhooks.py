"""Webhooks: which subscriber gets which event, signed payloads, the log of deliveries and its pages.

Secrets become the two padded keys of an HMAC once for each subscriber; signing an event is then two hashes in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.tables import broadcast_if_small, stored

# The events that exist, how much of an answer is kept, and what precedes a signature.
EVENT_TYPES = ("user.created", "user.updated", "user.deleted", "item.created", "item.updated", "item.deleted")
BODY, PREFIX = 10_000, "sha256="


def padded(secret: Column, pad: int) -> Column:
    """A secret as an HMAC key of 64 bytes, xored with ``pad``; longer ones are hashed first."""
    key = F.when(F.octet_length(secret) > 64, F.sha2(secret, 256)).otherwise(F.lower(F.hex(secret.cast("binary"))))
    whole = F.rpad(key, 128, "0")
    byte = lambda i: F.conv(F.substring(whole, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(pad))), 2, "0")), ""))


def signature(payload: Column, inner: Column, outer: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, payload.cast("binary")), 256))), 256))


def verified(rows: DataFrame, payload: str, signed: str, secret: str) -> DataFrame:
    """Adds ``verified``: whether a signature belongs to payload and secret; false where any of them is missing."""
    right = signature(F.col(payload), padded(F.col(secret), 0x36), padded(F.col(secret), 0x5C))
    return rows.withColumn("verified", F.coalesce(right == F.col(signed), F.lit(False)))


def unknown_types(events: DataFrame) -> DataFrame:
    """Events of a type that doesn't exist."""
    return events.where(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)))


def iso(time: Column) -> Column:
    """ISO 8601 with microseconds; times without a zone are UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def dispatched(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """(webhook_id, event_id, event_type, at, payload, signature): each event of a known type for each active subscriber of it.

    ``events`` (event_id, event_type, data as JSON, at), ``hooks`` (webhook_id, secret, events: array, is_active). Subscribers are broadcast if they are counted to be few, so a frequent
    type stays where its events lie.
    """
    active = hooks.where("is_active").select("webhook_id", padded(F.col("secret"), 0x36).alias("inner"), padded(F.col("secret"), 0x5C).alias("outer"), F.explode(F.array_distinct("events")).alias("event_type"))
    payload = F.concat(F.lit('{"event": "'), F.col("event_type"), F.lit('", "timestamp": "'), iso(F.col("at")), F.lit('", "data": '), F.coalesce("data", F.lit("null")), F.lit("}"))
    known = events.where(F.col("event_type").isin(*EVENT_TYPES)).withColumn("payload", payload)
    return known.join(broadcast_if_small(active), "event_type").select("webhook_id", "event_id", "event_type", "at", "payload", signature(F.col("payload"), F.col("inner"), F.col("outer")).alias("signature"))


def delivery_log(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """``sent`` with what came back: ``answers`` (webhook_id, event_id, status, body, error). 2xx is success; an error, no answer or another status is none."""
    joined = sent.join(answers.withColumn("body", F.substring("body", 1, BODY)), ["webhook_id", "event_id"], "left")  # cut before it is exchanged
    success = F.coalesce(F.col("status").between(200, 299) & F.col("error").isNull(), F.lit(False))
    message = F.coalesce("error", F.when(F.col("status").isNull(), F.lit("no answer")).otherwise(F.lit("Delivered successfully")))
    return joined.select(*sent.columns, F.col("status").alias("response_status"), F.col("body").alias("response_body"), success.alias("success"), message.alias("message"))


def history(log: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of every subscriber's deliveries, the newest first, with the number of all of them. Ranks are cut in each task before rows are exchanged."""
    page = newest(log, skip, limit)
    totals = log.groupBy("webhook_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("delivered"))
    return page.join(broadcast_if_small(totals), "webhook_id")


def newest(rows: DataFrame, skip: int, limit: int) -> DataFrame:
    """``place`` of each subscriber's rows (webhook_id, event_id, at), the newest first, and of these a page."""
    place = F.row_number().over(W.partitionBy("webhook_id").orderBy(F.desc("at"), F.desc("event_id")))
    return rows.withColumn("place", place).where(F.col("place") <= skip + limit).where(F.col("place") > skip)


def subscribed(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Events of known types with ``webhook_id``, once for each active subscriber of their type."""
    active = hooks.where("is_active").select("webhook_id", F.explode(F.array_distinct("events")).alias("event_type"))
    return events.where(F.col("event_type").isin(*EVENT_TYPES)).join(broadcast_if_small(active), "event_type")


def delivery_page(events: DataFrame, hooks: DataFrame, answers: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """``history`` of the log of all deliveries, of which only those of the page are signed and bring their answers' bodies.

    Places and totals come from ids, times and outcomes alone. An ``event_id`` names one event, and a delivery has one answer at most.
    """
    every = subscribed(events.select("event_id", "event_type", "at"), hooks).select("webhook_id", "event_id", "at")
    shown = broadcast_if_small(stored(newest(every, skip, limit).select("webhook_id", "event_id", "place"), "page"))
    signed = dispatched(events.join(shown.select("event_id").distinct(), "event_id", "left_semi"), hooks).join(shown, ["webhook_id", "event_id"])
    totals = delivery_log(every, answers).groupBy("webhook_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("delivered"))
    page = delivery_log(signed, answers.join(shown, ["webhook_id", "event_id"], "left_semi"))
    return page.join(broadcast_if_small(stored(totals, "totals")), "webhook_id")
