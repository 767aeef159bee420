"""Folders of JSON files of seven kinds as one corpus: a Python data source, ``spark.read.format("knowledge_files")``.

An option for each kind names its folder: documents, chunks, tables, faqs, forms, lecturers, lectures. A file holds one JSON record, or one on each line. Files
are listed once, and each partition reads a group of them, ``files_per_partition`` and ``bytes_per_partition`` at most, so small files don't make a task each and large
ones with a record on each line are shared out by ranges of bytes. What isn't JSON, or isn't a record of its kind, is a row with ``error`` and the text that was there;
nothing is left out and nothing stops the scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "id string, title string, category string, summary string, content string, source_url string, keywords array<string>, source_kind string, source_document_id string, "
    "section_title string, page_from int, page_to int, source_path string, kind string, path string, error string"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
SUMMARY, CONTENT = FIELDS.index("summary"), FIELDS.index("content")
KINDS = ("documents", "chunks", "tables", "faqs", "forms", "lecturers", "lectures")
ARROW = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32()}.get(f.split()[1], pa.list_(pa.string()))) for f in SCHEMA.split(", ")])
FILES_PER_PARTITION, BYTES_PER_PARTITION = 64, 16 << 20
#: Bytes of a large file's start that tell whether it holds a record on each line; rows, and characters of their fields, that are given on at once.
LOOK, ROWS_AT_ONCE, CHARACTERS_AT_ONCE = 1 << 20, 10_000, 4 << 20


def _text(raw: dict, name: str, default: str = "") -> str:
    value = raw.get(name, default)
    return value if isinstance(value, str) or value is None else str(value)


def _words(values) -> list[str]:
    return [str(v) for v in values or ()]


def _plain(raw, kind, **more):
    return {
        "id": _text(raw, "id"), "title": _text(raw, "title"), "category": _text(raw, "category", "lecturer" if kind == "lecturers" else ""), "summary": _text(raw, "summary"),
        "content": _text(raw, "content"), "source_url": _text(raw, "source_url"), "keywords": _words(raw.get("keywords")), "source_kind": "document", **more,
    }


def _chunks(raw, kind):
    for c in raw.get("chunks", ()):
        more = {"section_title": c.get("section_title"), "page_from": c.get("page_from"), "page_to": c.get("page_to"), "source_document_id": raw.get("document_id"), "source_path": raw.get("source_path")}
        yield _plain({**raw, "id": c.get("chunk_id", ""), "summary": c.get("summary", ""), "content": c.get("content", ""), "keywords": c.get("keywords", raw.get("keywords"))}, kind, source_kind="chunk", **more)


def _table_rows(raw, kind):
    """A row is found by its table's title, its label, its amount and its tags."""
    common = _plain({**raw, "keywords": None}, kind, source_kind="table_row", source_document_id=raw.get("document_id"), source_path=raw.get("source_path"))
    named = [_text(raw, "category"), _text(raw, "title")]
    for t in raw.get("tables", ()):
        title, table = _text(t, "title"), _text(t, "table_id")
        for r in t.get("rows", ()):
            amount, value, label = _text(r, "amount_text"), r.get("amount_value"), _text(r, "label")
            said = f"{title}. {label}. Muc hoc phi: {amount}{f' ({value} dong)' if value else ''}."
            yield {
                **common, "id": f"{table}-{_text(r, 'row_id')}", "summary": said, "content": _text({"content": r.get("search_text") or said}, "content"), "section_title": t.get("title"),
                "keywords": _words([*named, title, label, amount, *_words(r.get("track_tags")), *_words(r.get("basis_tags"))]), "page_from": r.get("page_from", t.get("page_from")), "page_to": r.get("page_to", t.get("page_to")),
            }


def _faq(raw, kind):
    asked = _text(raw, "question")
    yield _plain({**raw, "summary": asked, "content": f"Cau hoi: {asked}\n\nTra loi: {_text(raw, 'answer')}"}, kind, source_kind="faq")


def _form(raw, kind):
    fields = ", ".join(f"{_text(f, 'label')} ({_text(f, 'name')}, {_text(f, 'type', 'text')})" for f in raw.get("fields", ()))
    content = f"Bieu mau: {_text(raw, 'title')}\n\nMo ta: {_text(raw, 'description')}\n\nCac truong: {fields or 'Khong co'}"
    yield _plain({**raw, "summary": raw.get("description", ""), "content": content}, kind, source_kind="form_template")


def _lecture(raw, kind):
    for c in raw.get("chunks", ()):
        yield _plain({**c, "id": c.get("chunk_id", ""), "title": c.get("chapter", ""), "category": raw.get("subject", c.get("subject", ""))}, kind, source_kind="lecture", source_document_id=c.get("document_id", raw.get("document_id")))


def _single(raw, kind):
    yield _plain(raw, kind, source_kind=raw.get("source_kind", "document") if kind == "lecturers" else "document")


ENTRIES = {"documents": _single, "lecturers": _single, "chunks": _chunks, "lectures": _lecture, "tables": _table_rows, "faqs": _faq, "forms": _form}


def on_lines(start: bytes) -> bool:
    """Whether a file that starts so has a record on each line: two lines have text, and whatever follows, all of it is no JSON value."""
    text = start.decode(errors="replace")
    if not text.strip().partition("\n")[2]:
        return False
    try:
        json.loads(text)
    except json.JSONDecodeError as why:
        return why.msg == "Extra data" or (not why.msg.startswith("Unterminated") and why.pos < len(text) - 16)  # else it may go on after the cut
    return False


def _row(found: dict, kind: str, path: str, error: str | None = None):
    found["kind"], found["path"], found["error"] = kind, path, error
    return tuple(map(found.get, FIELDS))


def _broken(text: str, why: Exception, kind: str, path: str):
    return _row({"content": text}, kind, path, f"{type(why).__name__}: {why}")


def _of(text: str, kind: str, path: str, raw=None):
    """Rows of one record."""
    try:
        raw = json.loads(text) if raw is None else raw
        if not isinstance(raw, dict):
            raise TypeError("a record is an object")
        return [_row(found, kind, path) for found in ENTRIES[kind](raw, kind)]
    except (ValueError, TypeError, AttributeError, KeyError) as why:
        return [_broken(text, why, kind, path)]


def line_entries(kind: str, path: str, data: bytes):
    """Rows, as tuples, of records on lines."""
    for line in data.split(b"\n"):
        try:
            text = line.decode()
        except UnicodeDecodeError as why:
            yield _broken(line.decode(errors="replace"), why, kind, path)
            continue
        if text.strip():
            yield from _of(text, kind, path)


def entries(kind: str, path: str, data: bytes):
    """Rows, as tuples, of one file."""
    if on_lines(data[:LOOK]):
        yield from line_entries(kind, path, data)
        return
    try:
        text = data.decode()
    except UnicodeDecodeError as why:
        yield _broken(data.decode(errors="replace"), why, kind, path)
        return
    try:
        yield from _of(text, kind, path, json.loads(text))
    except ValueError as whole:
        if len([line for line in text.split("\n") if line.strip()]) > 1:
            yield from line_entries(kind, path, data)
        else:
            yield _broken(text, whole, kind, path)


def _lines_of(stream, start: int, end: int) -> bytes:
    """The lines whose first byte lies from ``start`` to before ``end``."""
    stream.seek(max(0, start - 1))
    data = stream.read(end - max(0, start - 1))
    if start:
        first = data.find(b"\n", 0, -1) + 1
        if not first:
            return b""
        data = data[first:]
    parts = [data]
    while parts[-1] and not parts[-1].endswith(b"\n"):
        more = stream.read(1 << 16)
        ended = more.find(b"\n") + 1
        parts.append(more[:ended] if ended else more)
    return b"".join(parts)


@dataclass
class Files(InputPartition):
    """A group of (kind, path, first byte, end), without an end whole files."""

    files: list[tuple[str, str, int, int | None]]


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class KnowledgeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "knowledge_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options):
        self.folders = {k: options[k] for k in KINDS if k in options}
        self.most = int(options.get("files_per_partition", FILES_PER_PARTITION))
        self.most_bytes = int(options.get("bytes_per_partition", BYTES_PER_PARTITION))
        if not self.folders:
            raise ValueError(f"name the folder of at least one kind: {', '.join(KINDS)}")

    def partitions(self):
        from pyarrow import fs

        groups, bytes_ = [[]], 0
        for kind, folder in self.folders.items():
            system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            listed = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
            base = folder.partition("://")[0] if "://" in folder else "file"
            files = sorted((f.path, f.size) for f in listed if f.is_file and f.base_name.endswith((".json", ".jsonl", ".txt")) and not f.base_name.startswith(("_", ".")))
            for name, size in files:
                for start, end in self._ranges(system, name, size or 0):
                    length = size if end is None else end - start
                    if groups[-1] and (len(groups[-1]) >= self.most or bytes_ + length > self.most_bytes):
                        groups.append([])
                        bytes_ = 0
                    groups[-1].append((kind, f"{base}://{name}", start, end))
                    bytes_ += length
        return [Files(g) for g in groups]

    def _ranges(self, system, name: str, size: int):
        if size <= self.most_bytes:
            return [(0, None)]
        try:
            with system.open_input_stream(name) as stream:
                split = on_lines(stream.read(LOOK))
        except OSError:  # said by the task that reads it
            split = False
        return [(i, min(i + self.most_bytes, size)) for i in range(0, size, self.most_bytes)] if split else [(0, None)]

    def read(self, partition):
        rows, characters = [], 0
        for row in self._rows(partition):
            rows.append(row)
            characters += len(row[SUMMARY] or "") + len(row[CONTENT] or "")
            if len(rows) >= ROWS_AT_ONCE or characters >= CHARACTERS_AT_ONCE:
                yield _told(rows)
                rows, characters = [], 0
        if rows:
            yield _told(rows)

    def _rows(self, partition):
        from pyarrow import fs

        for kind, uri, start, end in partition.files:
            try:
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as stream:
                    data = stream.read() if end is None else _lines_of(stream, start, end)
            except OSError as why:
                yield _row({}, kind, uri, f"{type(why).__name__}: {why}")
                continue
            yield from (entries if end is None else line_entries)(kind, uri, data)


def knowledge_files(spark: SparkSession, files_per_partition: int = FILES_PER_PARTITION, bytes_per_partition: int = BYTES_PER_PARTITION, **folders: str) -> DataFrame:
    """The corpus of all named folders, broken files and records as rows with ``error``."""
    spark.dataSource.register(KnowledgeFiles)
    return spark.read.format("knowledge_files").options(files_per_partition=str(files_per_partition), bytes_per_partition=str(bytes_per_partition), **folders).load()
