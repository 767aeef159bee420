"""The source layer: sources, their versions and files, brought in line with what files there are now.

A sync is one full outer join of what is known with what came, by source; its result is three new tables, which ``quarry.sources.publish`` swaps in at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

SOURCES = "source_id string, source_type string, title string, category string, current_status string, notes string, trust_level string, language string"
VERSIONS = "source_id string, version int, checksum string, status string, is_active boolean"
FILES = "source_id string, version int, file_name string, file_type string, relative_path string, mime_type string, size_bytes long"
# What all sources of this catalogue have in common, and types by suffix.
TRUST, LANGUAGE = "official", "vi"
MIME = {
    "pdf": "application/pdf", "csv": "text/csv", "txt": "text/plain", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def source_id(relative_path: Column) -> Column:
    return F.concat(F.lit("src-"), T.slug(relative_path))


def empty(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in (("files", FILES), ("versions", VERSIONS), ("sources", SOURCES))}


def synced(old: dict[str, DataFrame], incoming: DataFrame) -> dict[str, DataFrame]:
    """New ``files``, ``versions`` and ``sources``, children first, after a sync with all files there are.

    ``incoming`` (relative_path, title, category, status, notes, checksum, size_bytes). An unchanged file keeps its active version, which takes the new status; a changed
    or new one adds an active version and ends the old one; sources that are gone go with their versions and files. Of files with one id the last path counts.
    """
    name = F.regexp_extract("relative_path", "([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    came = incoming.withColumn("source_id", source_id(F.col("relative_path")))
    came = came.groupBy("source_id").agg(F.max_by(F.struct("relative_path", "title", "category", "status", "notes", "checksum", "size_bytes"), "relative_path").alias("_f")).select("source_id", "_f.*")
    came = came.withColumns({"file_name": name, "file_type": suffix})
    known = old["versions"].groupBy("source_id").agg(F.max("version").alias("highest"), F.max_by(F.struct("version", "checksum"), F.when(F.col("is_active"), F.col("version"))).alias("active"))
    state = came.join(known, "source_id", "full_outer").withColumn("came", F.col("checksum").isNotNull())
    same = F.coalesce(F.col("active.checksum") == F.col("checksum"), F.lit(False))
    state = state.where("came").select(
        "*", same.alias("same"), F.when(same, F.col("active.version")).otherwise(F.coalesce("highest", F.lit(0)) + 1).alias("at"), F.col("highest").isNotNull().alias("known")
    )
    sources = state.select(
        "source_id", F.col("file_type").alias("source_type"), F.coalesce(F.nullif("title", F.lit("")), T.title_from_name(F.col("file_name"))).alias("title"),
        F.coalesce(F.nullif("category", F.lit("")), T.category_from_path(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1))).alias("category"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("draft")).alias("current_status"), "notes", F.lit(TRUST).alias("trust_level"), F.lit(LANGUAGE).alias("language"),
    )
    ended = old["versions"].join(state.select("source_id", F.col("at").alias("version"), "same"), ["source_id", "version"], "left")
    ended = ended.join(state.select("source_id"), "source_id", "left_semi").where("same IS NULL").select("source_id", "version", "checksum", "status", F.lit(False).alias("is_active"))
    active = state.select("source_id", F.col("at").cast("int").alias("version"), "checksum", F.coalesce(F.nullif("status", F.lit("")), F.lit("draft")).alias("status"), F.lit(True).alias("is_active"))
    kept = old["files"].join(state.select("source_id"), "source_id", "left_semi")
    mime = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), F.col("file_type")), F.lit("application/octet-stream"))
    made = state.select("source_id", F.col("at").cast("int").alias("version"), "file_name", "file_type", "relative_path", mime.alias("mime_type"), F.col("size_bytes").cast("long").alias("size_bytes"))
    made = made.join(kept.select("source_id", "version"), ["source_id", "version"], "left_anti")
    return {"files": kept.unionByName(made), "versions": ended.unionByName(active), "sources": sources}


def changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(source_id, action): added, changed, same or removed, by the active versions of two states."""
    side = lambda tables, name: tables["versions"].where("is_active").select("source_id", F.col("version").alias(name))
    joined = side(old, "was").join(side(new, "now"), "source_id", "full_outer")
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return joined.select("source_id", action.alias("action"))
