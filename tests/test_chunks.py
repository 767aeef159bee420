"""Chunks of whole tables against plain Python."""

import re
import unicodedata

import pyarrow.parquet as pq
import pytest

from quarry.operators import ingest
from quarry.sources import adapters as A

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def plain_ascii(text):
    kept = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", " ", kept).strip(" ")


def noise(line):
    letters = sum(c.isalpha() for c in line)
    return not line or bool(re.match(r"(?i)^(stsv|\d+)(\s*\*\s*(stsv|\d+))*$", line)) or bool(re.match(r"^[\W\d_]+$", line)) or (letters < 4 and len(line) < 24)


def heading(line):
    letters, capitals = [c for c in line if c.isalpha()], [c for c in line if unicodedata.category(c) == "Lu"]
    loud = bool(letters) and len(capitals) >= 0.75 * len(letters) and len(line.split()) <= 18
    return len(line) <= 160 and (line.endswith(":") or loud or bool(re.match(r"^(chuong|ph[aà]n|muc|dieu|section|article)\b", line.lower())))


def contents(chunk):
    return "muc luc" in plain_ascii(chunk) or (len(re.findall(r"\.{4,}", chunk)) >= 2 and len(re.findall(r"\b\d{1,3}\b", chunk)) >= 2)


def paragraph_chunks(text):
    """One walk over the lines: a chunk is closed before a heading, before it grows beyond 1,500 characters, or once it has 1,100."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace(" ", " ").replace("\r\n", "\n").replace("\r", "\n"))).strip()
    open_, done, size = [], [], 0
    for line in text.split("\n"):
        line = re.sub(r"\s{2,}", " ", re.sub(r"(?i)^\s*(STSV\s*\*\s*\d+|\d+\s*\*\s*STSV)\s*", "", line)).strip(" ")
        if noise(line) or re.match(r"^\d{1,3}$", line):
            continue
        if open_ and (heading(line) or size + len(line) > 1500 or size >= 1100):
            done.append(open_)
            open_, size = [], 0
        open_.append(line)
        size += len(line) + 2
    done += [open_] if open_ else []
    out = []
    for n, lines in enumerate(done, 1):
        content = "\n\n".join(lines).strip()
        if len(content) >= 40 and not contents(content):
            out.append((n, content, next((x for x in lines if heading(x)), None)))
    return out


def test_paragraph_chunks_of_a_whole_table(spark, texts):
    docs = A.table(spark, SF, "documents")
    got = {}
    for r in ingest.pack(ingest.paragraphs(docs)).collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.content, r.section_title))
    want = {i: found for i, t in texts.items() if (found := paragraph_chunks(t or ""))}
    assert {i: sorted(c) for i, c in got.items()} == want and len(want) > 500


def lecture_chunks(text):
    """Pieces are paragraphs, or sentences of those over 2,000 characters; a full chunk hands its last piece's end on."""
    pieces = []
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph = paragraph.strip()
        if len(paragraph) > 2000:
            pieces += re.split(r"(?<=[.!?])\s+", paragraph)
        elif paragraph:
            pieces.append(paragraph)
    out, held = [], ""
    sizes = 0
    for piece in pieces:
        if held and sizes + len(piece) > 2000:
            out.append(held)
            held = tail = last[-200:]
            sizes = len(tail)
        held = f"{held}\n\n{piece}" if held else piece
        sizes += len(piece)
        last = piece
    return out + [held] if held else out


def test_lecture_chunks_of_a_whole_table(spark, texts):
    docs = A.table(spark, SF, "documents")
    got = {}
    for r in ingest.lecture_chunks(docs).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_id, r.content))
    want = {i: [(f"{i}-{n:04d}", c) for n, c in enumerate(found)] for i, t in texts.items() if (found := lecture_chunks(t or ""))}
    assert {i: sorted(c) for i, c in got.items()} == want and max(map(len, want.values())) > 5
