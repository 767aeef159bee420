"""Seven kinds of JSON files as one corpus, with broken files and records as rows."""

import json
from pathlib import Path

import pytest

from quarry.sources import knowledge_files as kf

RECORDS = {
    "documents": {"id": "d1", "title": "T", "category": "C", "summary": "S", "content": "X", "source_url": "u", "keywords": ["k"]},
    "chunks": {"document_id": "doc", "title": "T", "keywords": ["all"], "source_path": "p", "chunks": [{"chunk_id": "c1", "content": "one", "page_from": 1, "page_to": 2}, {"chunk_id": "c2", "keywords": ["own"], "section_title": "II"}]},
    "tables": {"document_id": "doc", "title": "T", "category": "C", "tables": [{"table_id": "t", "title": "Fees", "page_from": 3, "rows": [{"row_id": "1", "label": "L", "amount_text": "5 dong", "amount_value": 5, "track_tags": ["x"]}, {"row_id": "2", "search_text": "found", "page_from": 4}]}]},
    "faqs": {"id": "f1", "title": "F", "question": "Q?", "answer": "A."},
    "forms": {"id": "m1", "title": "M", "description": "D", "fields": [{"label": "Name", "name": "name"}, {"label": "Age", "name": "age", "type": "number"}]},
    "lecturers": {"id": "l1", "title": "Dr", "source_kind": "profile"},
    "lectures": {"document_id": "lec", "chunks": [{"chunk_id": "b-0001", "chapter": "One", "content": "text"}]},
}


@pytest.fixture
def folders(tmp_path):
    for kind, record in RECORDS.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "a.json").write_text(json.dumps(record, indent=1))
    return {kind: str(tmp_path / kind) for kind in RECORDS}


@pytest.mark.parametrize("most", [1, 3, 64])
def test_seven_kinds_give_one_corpus(spark, folders, most):
    rows = {r.id: r for r in kf.knowledge_files(spark, most, **folders).collect()}
    assert sorted(rows) == ["b-0001", "c1", "c2", "d1", "f1", "l1", "m1", "t-1", "t-2"] and not any(r.error for r in rows.values())
    assert rows["c1"].keywords == ["all"] and rows["c2"].keywords == ["own"] and rows["c1"].page_to == 2 and rows["c2"].source_document_id == "doc"
    assert rows["t-1"].content == rows["t-1"].summary == "Fees. L. Muc hoc phi: 5 dong (5 dong)." and rows["t-1"].keywords == ["C", "T", "Fees", "L", "5 dong", "x"] and rows["t-1"].page_from == 3
    assert rows["t-2"].content == "found" and rows["t-2"].page_from == 4
    assert rows["f1"].content == "Cau hoi: Q?\n\nTra loi: A." and rows["f1"].source_kind == "faq" and rows["f1"].summary == "Q?"
    assert rows["m1"].content == "Bieu mau: M\n\nMo ta: D\n\nCac truong: Name (name, text), Age (age, number)"
    assert rows["l1"].source_kind == "profile" and rows["l1"].category == "lecturer" and rows["b-0001"].title == "One"


def test_two_broken_files_are_two_rows(spark, folders):
    Path(folders["faqs"], "b.json").write_text('{"id": "f2", "question": ')
    Path(folders["lectures"], "b.json").write_bytes(b'\xff\xfe{"chunks": []}')
    rows = kf.knowledge_files(spark, 2, **folders).collect()
    broken = [r for r in rows if r.error]
    assert len(rows) == 11 and sorted(r.kind for r in broken) == ["faqs", "lectures"] and all(r.path.endswith("b.json") and r.id is None for r in broken)


def test_records_on_lines_and_shapes_that_do_not_fit(spark, tmp_path):
    lines = [json.dumps({"id": "1", "question": "q"}), "not json", json.dumps([1, 2]), json.dumps({"id": 2, "keywords": None})]
    (tmp_path / "part-0.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    rows = kf.knowledge_files(spark, faqs=str(tmp_path)).collect()
    assert [(r.id, r.content if r.error else None) for r in rows] == [("1", None), (None, "not json"), (None, "[1, 2]"), ("2", None)]


def test_no_folder_and_no_files(spark, tmp_path):
    assert kf.knowledge_files(spark, faqs=str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="at least one kind"):
        kf.knowledge_files(spark).count()


def test_large_files_of_lines_are_shared_out_by_ranges(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "question": "ă" * (i % 50), "answer": "x" * (i % 7) * 100}, ensure_ascii=False) for i in range(500)]
    lines[3], lines[77], lines[120] = "text no json", "", '{"id": "cut'
    whole, big = tmp_path / "whole", tmp_path / "big"
    for folder in (whole, big):
        folder.mkdir()
        (folder / "a.jsonl").write_bytes("\n".join(lines).encode() + b"\n\xff{}\n")
        (folder / "b.json").write_text(json.dumps({"id": "one", "question": "q", "answer": "y" * 9_000}, indent=1))
        (folder / "c.txt").write_text("text first\n" + lines[9])
    seen = lambda df: sorted(repr((r.id, r.summary, r.content, r.error)) for r in df.collect())
    many = kf.knowledge_files(spark, bytes_per_partition=1_000, faqs=str(big))
    assert many.rdd.getNumPartitions() > 50
    got = seen(many)
    assert got == seen(kf.knowledge_files(spark, faqs=str(whole))) and len(got) == 499 + 1 + 1 + 2


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_each_line_is_in_the_range_of_its_first_byte(tmp_path, step):
    import io

    data = b"ab\n\ncde\nf\n\n\nlast one"
    parts = [kf._lines_of(io.BytesIO(data), i, min(i + step, len(data))) for i in range(0, len(data), step)]
    assert b"".join(parts) == data


def test_what_tells_lines_from_one_record():
    assert kf.on_lines(b'{"a": 1}\n{"b": ') and kf.on_lines(b"text is none\n" + b" " * 20 + b"{}") and kf.on_lines(b'1\n2')
    assert not any(map(kf.on_lines, (b"", b"{}\n", b'{\n"a": [1,\n2', b'{\n "a": "bc', b"no json\n", b'{\n "a": tr', b'[\n"\\u00')))
