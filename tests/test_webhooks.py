"""Signatures against Python's HMAC, and deliveries on small inputs."""

import hashlib
import hmac
from datetime import datetime

from pyspark.sql import functions as F

from quarry.operators import webhooks as H


def test_signatures_equal_hmac(spark):
    rows = [("s", "payload"), ("x" * 64, "ü漢"), ("y" * 65, ""), ("é" * 40, "{}"), ("", "a")]
    frame = spark.createDataFrame(rows, "secret string, payload string")
    signed = frame.withColumn("signed", H.signature(F.col("payload"), H.padded(F.col("secret"), 0x36), H.padded(F.col("secret"), 0x5C)))
    for r in H.verified(signed, "payload", "signed", "secret").collect():
        assert r.signed == "sha256=" + hmac.new(r.secret.encode(), r.payload.encode(), hashlib.sha256).hexdigest() and r.verified
    changed = signed.withColumn("payload", F.concat("payload", F.lit("!"))).union(spark.createDataFrame([(None, "p", "s")], "secret string, payload string, signed string"))
    assert not any(r.verified for r in H.verified(changed, "payload", "signed", "secret").collect())


def test_who_gets_what_and_how_it_ended(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    events = spark.createDataFrame([(1, "user.created", '{"a": 1}', at), (2, "user.error", "{}", at), (3, "item.updated", None, at), (4, None, "{}", at)], "event_id int, event_type string, data string, at timestamp_ntz")
    hooks = spark.createDataFrame([(7, "k", ["user.created", "user.created", "user.error"], True), (8, "k", ["item.updated"], False), (9, "k", ["item.updated", "user.created"], True)], "webhook_id int, secret string, events array<string>, is_active boolean")
    sent = H.dispatched(events, hooks)
    assert sorted((r.webhook_id, r.event_id) for r in sent.collect()) == [(7, 1), (9, 1), (9, 3)]
    assert {r.payload for r in sent.where("event_id = 1").collect()} == {'{"event": "user.created", "timestamp": "2024-01-02T03:04:05.000000+00:00", "data": {"a": 1}}'}
    answers = spark.createDataFrame([(7, 1, 204, "x" * 10_001, None), (9, 1, 300, None, None), (9, 3, None, None, "refused")], "webhook_id int, event_id int, status int, body string, error string")
    log = {(r.webhook_id, r.event_id): r for r in H.delivery_log(sent, answers.where("event_id = 1 OR error IS NOT NULL")).collect()}
    assert log[7, 1].success and len(log[7, 1].response_body) == 10_000 and not log[9, 1].success and (log[9, 3].success, log[9, 3].message) == (False, "refused")
    page = H.history(H.delivery_log(sent, answers.limit(0)), skip=1, limit=5).collect()
    assert [(r.webhook_id, r.event_id, r.place, r.total, r.delivered, r.message) for r in page] == [(9, 1, 2, 2, 0, "no answer")]
    assert [r.event_id for r in H.unknown_types(events).orderBy("event_id").collect()] == [2, 4]
