"""Readers and sinks of files: JSON knowledge folders, CSV with encoding fallback, manifests, binary scans and a registry by suffix.

Readers of PDF and Excel files need optional packages and say so when these are missing.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATIC = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "category", "summary", "content", "source_url")] + [T.StructField("keywords", T.ArrayType(T.StringType()))])
CHUNK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "section_title", "summary", "content")] + [T.StructField(n, T.IntegerType()) for n in ("page_from", "page_to")] + [T.StructField("keywords", T.ArrayType(T.StringType()))]
)
CHUNK_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("document_id", "title", "category", "source_url", "source_path", "status")] + [T.StructField("page_count", T.IntegerType()), T.StructField("chunks", T.ArrayType(CHUNK))])
TABLE_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("row_id", "label", "amount_text", "search_text")] + [T.StructField("amount_value", T.LongType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("track_tags", "basis_tags")] + [T.StructField("row_data", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField(n, T.IntegerType()) for n in ("page_from", "page_to")]
)
TABLE_FILE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("document_id", "title", "category", "source_path", "source_url")]
    + [T.StructField("tables", T.ArrayType(T.StructType([T.StructField("table_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("page_from", T.IntegerType()), T.StructField("page_to", T.IntegerType()), T.StructField("rows", T.ArrayType(TABLE_ROW))])))]
)
MANIFEST_COLUMNS = "file_name relative_path document_id title category page_count status source_office issued_date effective_date version source_url notes".split()


def json_folder(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All JSON files of a folder, one record each; broken ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def knowledge(spark: SparkSession, documents: str | None = None, chunks: str | None = None, tables: str | None = None) -> DataFrame:
    """One corpus of static documents, chunks and table rows, with what each kind lacks as null."""
    parts = []
    if documents:
        parts.append(json_folder(spark, documents, STATIC).withColumn("source_kind", F.lit("document")))
    if chunks:
        parts.append(
            json_folder(spark, chunks, CHUNK_FILE).select("document_id", "title", "category", "source_url", "source_path", F.explode("chunks").alias("c")).select(
                F.col("c.chunk_id").alias("id"), "title", "category", "c.summary", "c.content", "source_url", "c.keywords", F.lit("chunk").alias("source_kind"),
                F.col("document_id").alias("source_document_id"), "c.section_title", "c.page_from", "c.page_to", "source_path",
            )
        )
    if tables:
        parts.append(
            json_folder(spark, tables, TABLE_FILE).select("document_id", "title", "category", "source_url", "source_path", F.explode("tables").alias("t"))
            .select("document_id", "title", "category", "source_url", "source_path", F.col("t.title").alias("section_title"), F.explode("t.rows").alias("r"))
            .select(
                F.col("r.row_id").alias("id"), "title", "category", F.col("r.label").alias("summary"),
                F.coalesce(F.nullif(F.col("r.search_text"), F.lit("")), F.concat_ws(" ", "r.label", "r.amount_text")).alias("content"), "source_url",
                F.array_distinct(F.concat(F.coalesce("r.track_tags", F.array().cast("array<string>")), F.coalesce("r.basis_tags", F.array().cast("array<string>")))).alias("keywords"),
                F.lit("table_row").alias("source_kind"), F.col("document_id").alias("source_document_id"), "section_title", "r.page_from", "r.page_to", "source_path",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows, all text; of a repeated document_id the last row of the file stays."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_COLUMNS])
    rows = spark.read.schema(schema).option("header", True).csv(path).withColumn("_n", F.monotonically_increasing_id())
    return rows.groupBy("document_id").agg(F.max_by(F.struct(*MANIFEST_COLUMNS), "_n").alias("r")).select("r.*")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*[F.col(c).cast("string") for c in MANIFEST_COLUMNS]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


ENCODINGS = ("utf-8-sig", "utf-8", "cp1258", "latin-1")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_number, cells) of CSV files: the first encoding that fits each file, rows without any text left out. A file is read as one value."""

    def parse(batches):
        for pdf in batches:
            paths, numbers, cells = [], [], []
            for at, raw in zip(pdf["path"], pdf["content"], strict=True):
                for encoding in ENCODINGS:
                    try:
                        decoded = bytes(raw).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                kept = [r for r in csv.reader(io.StringIO(decoded)) if any(c.strip() for c in r)]
                paths += [at] * len(kept)
                numbers += range(1, len(kept) + 1)
                cells += kept
            yield type(pdf)({"path": paths, "row_number": numbers, "cells": cells})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row_number int, cells array<string>")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, text) of PDF files; needs the optional package pypdf on the executors."""

    def parse(batches):
        from pypdf import PdfReader

        for pdf in batches:
            rows = [(at, n, page.extract_text() or "") for at, raw in zip(pdf["path"], pdf["content"], strict=True) for n, page in enumerate(PdfReader(io.BytesIO(bytes(raw))).pages, 1)]
            yield type(pdf)(rows, columns=["path", "page_number", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, page_number int, text string")


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_number, cells) of workbooks; needs the optional package openpyxl on the executors."""

    def parse(batches):
        from openpyxl import load_workbook

        for pdf in batches:
            rows = []
            for at, raw in zip(pdf["path"], pdf["content"], strict=True):
                for sheet in load_workbook(io.BytesIO(bytes(raw)), data_only=True, read_only=True).worksheets:
                    kept = [["" if c is None else str(int(c)) if isinstance(c, float) and c.is_integer() else str(c).strip() for c in r] for r in sheet.iter_rows(values_only=True)]
                    rows += [(at, sheet.title, n, r) for n, r in enumerate((r for r in kept if any(r)), 1)]
            yield type(pdf)(rows, columns=["path", "sheet", "row_number", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, sheet string, row_number int, cells array<string>")


READERS = {".pdf": pdf_pages, ".csv": csv_rows, ".xlsx": sheet_rows}


def read_any(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """The reader of a suffix; an unknown one is an error."""
    if suffix not in READERS:
        raise ValueError(f"unsupported document type: {suffix}")
    return READERS[suffix](spark, path)


def documents_listing(files: DataFrame, manifest_rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Raw documents with metadata before manifest before derived values; empty text counts as missing. All keyed by relative_path."""
    m = manifest_rows.select("relative_path", *[F.col(c).alias(f"m_{c}") for c in ("title", "category", "status", "source_url")])
    d = metadata.select("relative_path", *[F.col(c).alias(f"d_{c}") for c in ("title", "category", "status", "source_url")])
    from quarry.functions import text as X

    derived = {"title": X.title_from_name(F.col("relative_path")), "category": X.category_from_path(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1)), "status": F.lit("published"), "source_url": F.lit(None).cast("string")}
    pick = lambda c: F.coalesce(F.nullif(F.col(f"d_{c}"), F.lit("")), F.nullif(F.col(f"m_{c}"), F.lit("")), derived[c]).alias(c)
    return files.join(m, "relative_path", "left").join(d, "relative_path", "left").select("relative_path", *[pick(c) for c in derived])
