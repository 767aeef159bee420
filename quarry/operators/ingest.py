"""From raw text to chunks and table rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Chunk sizes in characters.
TARGET, MOST, LEAST = 1100, 1500, 40
LECTURE_MOST, OVERLAP = 2000, 200


def paragraphs(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, paragraph, heading): lines of a text, tidied, noise left out. A line is tidied once, for all that is asked of it."""
    tidied = lambda line: F.trim(F.regexp_replace(F.regexp_replace(line, r"(?i)^\s*(STSV\s*\*\s*\d+|\d+\s*\*\s*STSV)\s*", ""), r"\s{2,}", " "))
    kept = lambda p: ~T.is_noise(p) & ~p.rlike(r"^\d{1,3}$")
    told = lambda line, i: T.let(tidied(line), lambda p: F.when(kept(p), F.struct(i.alias("position"), p.alias("paragraph"), T.is_heading(p).alias("heading"))))
    lines = F.array_compact(F.transform(F.split(T.tidy_space(F.col(text_col)), "\n"), told))
    return pages.select(F.col(id_col).alias("doc_id"), F.inline(lines))


def pack(paragraphs: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """(doc_id, chunk, content, section_title, first_position, last_position) from paragraphs (doc_id, position, paragraph, heading).

    In order, a paragraph opens a new chunk if it is a heading, if it would make the current one longer than ``most``, or if that has
    reached ``target``. Paragraphs of many documents lie together in order, and a task folds those of a batch; it holds a chunk, not a document.
    """
    kind = paragraphs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        done, current, size, doc, n = [], [], 0, None, 0

        def close():
            done.append((doc, n, "\n\n".join([r[1] for r in current]).strip(), next((r[1] for r in current if r[2]), None), current[0][0], current[-1][0]))

        for batch in batches:
            for i, *row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "position", "paragraph", "heading")], strict=True):
                if current and (i != doc or row[2] or size + len(row[1]) > most or size >= target):
                    close()
                    current, size = [], 0
                if not current:
                    doc, n = i, n + 1 if n and i == doc else 1
                current.append(row)
                size += len(row[1]) + 2
            if done:
                yield told(done, batch.schema.field("doc_id").type)
                done = []
        if current:
            close()
            yield told(done, batch.schema.field("doc_id").type)

    def told(chunks, doc_type):
        types = (doc_type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunks, strict=True), types, strict=True)], names=["doc_id", "chunk", "content", "section_title", "first_position", "last_position"])

    together = paragraphs.select("doc_id", "position", "paragraph", "heading").repartition("doc_id").sortWithinPartitions("doc_id", "position")
    packed = together.mapInArrow(scan, f"doc_id {kind}, chunk int, content string, section_title string, first_position int, last_position int")
    return packed.where((F.length("content") >= LEAST) & ~T.is_contents(F.col("content"))).withColumn("summary", T.summary(F.col("content")))


def overlapping(text: str, most: int = LECTURE_MOST, overlap: int = OVERLAP) -> list[str]:
    """Lecture chunks: paragraphs (long ones by sentence) up to ``most`` characters; each next chunk repeats the end of the last piece."""
    pieces = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        pieces += re.split(r"(?<=[.!?])\s+", paragraph) if len(paragraph) > most else [paragraph]
    chunks, current, size = [], [], 0
    for piece in pieces:
        if current and size + len(piece) > most:
            chunks.append("\n\n".join(current))
            current = [current[-1][-overlap:]]
            size = len(current[0])
        current.append(piece)
        size += len(piece)
    return [*chunks, "\n\n".join(current)] if current else chunks


#: Characters of chunks that a task gathers before it gives them on.
GATHERED = 1 << 20


def lecture_chunks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, content, chapter, style) of lecture texts. A task holds the chunks of one text and of ``GATHERED`` characters, not those of a whole batch."""

    def told(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([f"{r[0]}-{r[1]:04d}" for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "chunk_id", "content"]
        )

    def scan(batches):
        for batch in batches:
            rows, size = [], 0
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = overlapping(text.as_py() or "")
                rows += [(i.as_py(), n, c) for n, c in enumerate(found)]
                size += sum(map(len, found))
                if size >= GATHERED:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    cut = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, chunk_id string, content string")
    return cut.select("*", T.chapter(F.col("content")).alias("chapter"), T.style_hint(F.col("content")).alias("style"))


def fee_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines with an amount: label, amount_text, amount_value; others are left out."""
    amount = r"(?U)(\d{1,3}(?:\.\d{3})+|\d{5,})\s*(?:d[o6d]ng|đồng|đ6ng|vnd|đ)\b"
    n = T.amount_text(F.col(column))
    return lines.withColumn("amount_text", F.regexp_extract(n, f"(?i){amount}", 0)).where("amount_text <> ''").withColumns(
        {"amount_value": T.amount_value(F.col("amount_text")), "label": F.trim(F.regexp_replace(F.regexp_replace(n, f"(?i){amount}.*$", ""), r"^\s*\d{1,2}[.)]\s*|[:.\s-]+$", ""))}
    )


def sheet_records(rows: DataFrame) -> DataFrame:
    """(path, row_number, label, content) of sheet rows (path, row_number, cells): the first row names the columns, blank names are column_i.

    A label is the first two values that are not empty; content is "header: value" of those, joined by " | ".
    """
    headers = rows.groupBy("path").agg(F.min_by("cells", "row_number").alias("headers"), F.min("row_number").alias("head"))
    name = lambda h, i: F.coalesce(F.nullif(F.trim(h), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string")))
    joined = rows.join(headers, "path").where("row_number > head").withColumn("headers", F.transform("headers", name))
    pairs = F.filter(F.zip_with("headers", "cells", lambda h, c: F.struct(h.alias("h"), F.trim(c).alias("c"))), lambda p: F.coalesce(p["c"], F.lit("")) != "")
    return joined.withColumn("pairs", pairs).where(F.size("pairs") > 0).select(
        "path", "row_number", F.array_join(F.slice("pairs.c", 1, 2), " - ").alias("label"), F.array_join(F.transform("pairs", lambda p: F.concat(F.coalesce(p["h"], F.lit("column")), F.lit(": "), p["c"])), " | ").alias("content")
    )


def table_entry_id(document: Column, table: Column, row: Column) -> Column:
    return F.concat_ws("-", document.cast("string"), table.cast("string"), F.lpad(row.cast("string"), 2, "0"))
