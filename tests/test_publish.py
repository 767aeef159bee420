"""Syncs of the source layer against a sequential model, and snapshots whose writers stop half-way."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalogue
from quarry.sources import publish

INCOMING = "relative_path string, title string, category string, status string, notes string, checksum string, size_bytes long"


def files(rows):
    return [(f"data/raw/{n}.pdf", f"T{n}", None, s, None, c, len(c)) for n, s, c in rows]


def plainly(deliveries):
    """(versions, files) after all deliveries: {(source, version): (checksum, status, active)}, {(source, version)}."""
    versions, held = {}, set()
    for delivery in deliveries:
        came = {f"src-data-raw-{n}-pdf": (s or "draft", c) for n, s, c in delivery}
        versions = {k: v for k, v in versions.items() if k[0] in came}
        held = {k for k in held if k[0] in came}
        for source, (status, checksum) in came.items():
            mine = {v: x for (s, v), x in versions.items() if s == source}
            active = next((v for v, x in mine.items() if x[2]), None)
            if active is None or mine[active][0] != checksum:
                if active is not None:
                    versions[source, active] = (*mine[active][:2], False)
                active = max(mine, default=0) + 1
            versions[source, active] = (checksum, status, True)
            held.add((source, active))
    return versions, held


def test_sync_equals_a_sequential_model(spark):
    rng = random.Random(5)
    deliveries = [[(n, rng.choice([None, "", "published", "draft"]), rng.choice("abc")) for n in range(12) if rng.random() < 0.7] for _ in range(4)]
    tables = catalogue.empty(spark)
    for delivery in deliveries:
        tables = catalogue.synced(tables, spark.createDataFrame(files(delivery), INCOMING))
    versions, held = plainly(deliveries)
    assert {(r.source_id, r.version): (r.checksum, r.status, r.is_active) for r in tables["versions"].collect()} == versions
    assert sorted((r.source_id, r.version) for r in tables["files"].collect()) == sorted(held)
    assert sorted(r.source_id for r in tables["sources"].collect()) == sorted({s for s, _ in versions})


def test_second_sync_changes_what_changed(spark):
    first = catalogue.synced(catalogue.empty(spark), spark.createDataFrame(files([(1, "published", "a"), (2, None, "b"), (3, None, "c")]), INCOMING))
    second = catalogue.synced(first, spark.createDataFrame(files([(1, "draft", "a"), (2, None, "x"), (4, None, "d")]), INCOMING))
    assert {r.source_id[-5:-4]: r.action for r in catalogue.changes(first, second).collect()} == {"1": "same", "2": "changed", "3": "removed", "4": "added"}
    assert catalogue.changes(second, catalogue.synced(second, spark.createDataFrame(files([(1, "draft", "a"), (2, None, "x"), (4, None, "d")]), INCOMING))).where("action <> 'same'").count() == 0
    rows = {r.source_id: r for r in second["sources"].collect()}
    assert rows["src-data-raw-1-pdf"].category == "Data / Raw" and rows["src-data-raw-1-pdf"].current_status == "draft"


def test_a_writer_that_stops_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path / "layer")
    tables = catalogue.synced(catalogue.empty(spark), spark.createDataFrame(files([(1, None, "a")]), INCOMING))
    first = publish.publish(spark, root, tables, None)
    assert publish.current(spark, root) == first
    broken = {**tables, "sources": tables["sources"].withColumn("title", F.raise_error(F.lit("stopped")).cast("string"))}
    with pytest.raises(Exception, match="stopped"):
        publish.publish(spark, root, broken, first)
    seen = publish.read(spark, root, "files", "versions", "sources")
    assert publish.current(spark, root) == first and [seen[t].count() for t in seen] == [1, 1, 1]
    assert len(publish.clear_old(spark, root)) == 1 and publish.current(spark, root) == first


def test_readers_keep_their_snapshot_and_writers_are_refused(spark, tmp_path):
    root = str(tmp_path / "layer")
    with pytest.raises(FileNotFoundError):
        publish.read(spark, root, "sources")
    one = catalogue.synced(catalogue.empty(spark), spark.createDataFrame(files([(1, None, "a")]), INCOMING))
    first = publish.publish(spark, root, one, None)
    held = publish.read(spark, root, "sources")["sources"]
    two = catalogue.synced(publish.read(spark, root, "files", "versions", "sources"), spark.createDataFrame(files([(2, None, "b"), (3, None, "c")]), INCOMING))
    second = publish.publish(spark, root, two, first)
    assert held.count() == 1 and publish.read(spark, root, "sources")["sources"].count() == 2
    with pytest.raises(RuntimeError, match="meanwhile"):
        publish.publish(spark, root, one, first)
    assert publish.current(spark, root) == second
    assert first in publish.clear_old(spark, root, keep=1) and publish.read(spark, root, "versions")["versions"].count() == 2
