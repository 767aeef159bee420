"""Tables, catalogues, snapshots and runs on small inputs, against sequential models."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import backfill, classify, courses, entities, fee_tables, snapshot


def slug(text):
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "document"


def tables_plainly(lines):
    """(table, row, row_id, label, amount, pages, title) of ASCII lines (page, line), one after the other."""
    tables, table = [], None
    for page, line in lines:
        heading = re.match(r"(?i)^(?:[IVXLCDM]{1,6}|IL)\.?\s*(.+)$", line)
        if heading and len(heading[1].strip()) >= 8 and any(s in slug(heading[1]) for s in fee_tables.HEADING_SLUGS):
            table = {"title": [line], "rows": [], "to": page}
            tables.append(table)
            continue
        if table is None:
            continue
        table["to"] = page
        if re.match(r"(?i)^(ghi chu|phu luc)\b", line):
            table = None
            continue
        s = slug(line)
        if s in fee_tables.HEADER_SLUGS or any(p in s for p in fee_tables.HEADER_PARTS):
            continue
        number = re.match(r"(?i)^(\d+(?:\.\d+)?|i)\s+", line)
        if not table["rows"] and not number:
            words = [w for w in s.split("-") if w.isalpha()]
            if len(words) >= 2 and len("".join(words)) >= 6 and not any(p in s for p in fee_tables.TITLE_STOPS):
                table["title"].append(line)
            continue
        whole = re.match(fee_tables.ROW, line)
        inside = re.search(r"(?i)\d[\d.]*\s*(?:dong|ddng|d6ng)(?:/\s*(?:1|hoc))?", line[number.end() :]) if number else None
        if whole:
            table["rows"].append({"id": whole[1], "label": [whole[2].strip(" -")], "amount": [whole[3]], "pages": [page]})
        elif inside and len(re.sub(r"\D", "", inside[0])) >= 5:
            body = line[number.end() :]
            around = [x for x in (body[: inside.start()].strip(" -"), body[inside.end() :].strip(" -")) if x]
            table["rows"].append({"id": number[1], "label": around, "amount": [inside[0]], "pages": [page]})
        elif table["rows"]:
            row = table["rows"][-1]
            row["amount" if re.match(r"(?i)^(tin chi|hoc ky)$", line) else "label"].append(line)
            row["pages"].append(page)
    out = []
    for n, t in enumerate([t for t in tables if any(re.sub(r"^[ /-]+|[ /-]+$", "", " ".join(r["label"])) for r in t["rows"])], 1):
        kept = [r for r in t["rows"] if re.sub(r"^[ /-]+|[ /-]+$", "", " ".join(r["label"]))]
        for k, r in enumerate(kept, 1):
            amount = " ".join(r["amount"]).replace("d6ng", "dong").replace("ddng", "dong")
            out.append((n, k, r["id"], re.sub(r"^[ /-]+|[ /-]+$", "", " ".join(r["label"])), amount, min(r["pages"]), max(r["pages"]), " ".join(t["title"]), t["to"]))
    return out


PIECES = (
    "I. Hoc phi he dai hoc", "II Muc thu nganh tien tien", "V. Dao tao", "TT", "Khoa, khoi nganh", "hoc ky", "bo sung cho sinh vien", "ab", "1 Chinh quy 350.000 dong", "1.2 Lien thong  - 1.473.287 d6ng/1",
    "2 thu 300 dong moi ky", "3 - 250.000 ddng/ hoc them sau", "i Cao hoc 20.000.000 dong", "4 khong co tien", "tin chi", "Tin chi", "con lai cua hang", "Ghi chu them", "phu luc 1", "5 77.000 dong", "6 88.000 dong/1 - ",
)


def test_fee_tables_equal_a_sequential_model(spark):
    rng = random.Random(7)
    documents = {d: [(i // 4, rng.choice(PIECES)) for i in range(rng.randint(1, 40))] for d in range(60)}
    rows = [(d, page, i, line) for d, lines in documents.items() for i, (page, line) in enumerate(lines)]
    found = fee_tables.fee_table_rows(spark.createDataFrame(rows, "doc_id int, page int, position int, line string"))
    got = sorted((r.doc_id, r.table_order, r.row_order, r.row_id, r.label, r.amount_text, r.page_from, r.page_to, r.title, r.table_to) for r in found.collect())
    assert got == sorted((d, *row) for d, lines in documents.items() for row in tables_plainly(lines)) and len(got) > 100


def test_a_row_goes_on_on_the_next_page(spark):
    lines = [(1, 1, 0, "II. Hoc phi cao hoc"), (1, 1, 1, "1 Toan 5.000.000 dong"), (1, 2, 2, "va tin hoc"), (1, 2, 3, "Tin chi"), (1, 3, 4, "Ghi chu het"), (1, 3, 5, "2 Ly 6.000.000 dong")]
    (row,) = fee_tables.fee_table_rows(spark.createDataFrame(lines, "doc_id int, page int, position int, line string")).collect()
    assert (row.label, row.amount_text, row.amount_value, row.page_from, row.page_to, row.table_to) == ("Toan va tin hoc", "5.000.000 dong Tin chi", 5_000_000, 1, 2, 3)


SHEETS = "path string, sheet string, sheet_no int, row_number int, cells array<string>"
METADATA = "path string, title string, category string, version string, status string, canonical_sheet string"


def test_the_named_sheet_counts_before_the_first_that_fits(spark):
    fits = ["Tên học phần", "Mã học phần", "Số TC"]
    rows = [("a.xlsx", "One", 1, 1, fits), ("a.xlsx", "One", 1, 2, ["x", "X1", "3"]), ("a.xlsx", "Two", 2, 1, ["Số TC", *fits[:2], "Số TC"]), ("a.xlsx", "Two", 2, 2, ["9", "Chuyên e toán", "Y1", "2 tc"]), ("a.xlsx", "Two", 2, 3, ["1", "short"])]
    rows += [("b.xlsx", "One", 1, 1, fits), ("b.xlsx", "One", 1, 2, ["x", "X1", "3"])]
    named = spark.createDataFrame([("a.xlsx", "T", "Chương trình dao tao", "v", "", "Two")], METADATA)
    got = courses.courses(spark.createDataFrame(rows, SHEETS), named).collect()
    assert [(r.sheet, r.course_code, r.credits, r.normalized_course_name, r.aliases, r.semester_label, r.status) for r in got] == [("Two", "Y1", 2, "chuyen de toan", "chuyen de", "Khong ro hoc ky", "draft")]


def test_every_procedure_keeps_its_row(spark):
    procedures = spark.createDataFrame([("p1", "Xin bảo lưu", "đơn bảo lưu"), ("p2", "zzz", None), ("p3", "Xin bảo lưu", "đơn bảo lưu"), ("p4", None, None)], "procedure_id string, title string, form_topic string")
    forms = spark.createDataFrame([(2, "f2", "Đơn bảo lưu", None, None, ["bảo lưu"]), (1, "f1", "Đơn bảo lưu", "", "d", ["bảo lưu"])], "ord int, form_id string, title string, category string, description string, keywords array<string>")
    got = {r.procedure_id: (r.related_form_id, r.category) for r in snapshot.procedures_loaded(procedures, forms).collect()}
    none = (None, snapshot.NO_CATEGORY)
    assert got == {"p1": ("f1", snapshot.NO_CATEGORY), "p2": none, "p3": ("f1", snapshot.NO_CATEGORY), "p4": none}
    assert {r.related_form_id for r in snapshot.procedures_loaded(procedures, forms.where("FALSE")).collect()} == {None}


def test_observed_counts_need_no_second_scan(spark, tmp_path):
    faqs = spark.createDataFrame([(f"q{i}", "Q", "A", "c", ["k"]) for i in range(7)], "faq_id string, question string, answer string, category string, keywords array<string>")
    forms = spark.createDataFrame([("f1", "T", "c", None, None, None)], "form_id string, title string, category string, description string, keywords array<string>, fields array<struct<label:string,name:string,type:string>>")
    documents = spark.createDataFrame([("d1", "T", "c"), ("d2", "T", "c")], "document_id string, title string, category string")
    branches = {"faq": snapshot.faq_entries(faqs), "form": snapshot.form_entries(forms)}
    counts = snapshot.run(spark, branches, documents, str(tmp_path / "s"))
    assert counts == {"faq": {"entries": 7, "with_vector": 0, "documents": 7}, "form": {"entries": 1, "with_vector": 0, "documents": 1}, "source": {"entries": 0, "with_vector": 0, "documents": 2}}
    from quarry.sources import publish

    written = publish.read(spark, str(tmp_path / "s"), "entries", "documents")
    assert written["entries"].count() == 8 and written["documents"].count() == 10
    plan = written["entries"].where("source_kind = 'form_template'").first()
    assert plan.content.endswith("Cac truong: Khong co") and plan.summary == "T"


def chain_plainly(tool, outcomes, intent):
    chain = [tool] if tool else []
    while chain:
        count, matched = outcomes.get(chain[-1], (None, None))
        after = {"search_course_catalog": "search_student_knowledge" if count == 0 else None, "build_procedure_workflow": "search_student_knowledge" if matched is False else None,
                 "search_student_knowledge": "build_procedure_workflow" if count == 0 and intent == "tuition_lookup" else None}.get(chain[-1])
        if after is None or after in chain:
            break
        chain.append(after)
    return chain


def test_fallback_chains_over_all_tools_and_outcomes(spark):
    tools = (classify.CATALOGUE_TOOL, classify.KNOWLEDGE_TOOL, classify.PROCEDURE_TOOL, "generate_form", None)
    rows = [(t, {classify.CATALOGUE_TOOL: (a, None), classify.KNOWLEDGE_TOOL: (b, None), classify.PROCEDURE_TOOL: (None, m)}, i)
            for t, a, b, m, i in itertools.product(tools, (0, 2, None), (0, 3, None), (True, False, None), ("tuition_lookup", "knowledge_qa", None))]
    rows += [(t, {}, "tuition_lookup") for t in tools]
    frame = spark.createDataFrame(rows, "tool string, outcomes map<string, struct<result_count: bigint, matched: boolean>>, intent string")
    for r in classify.fallback_chain(frame).collect():
        assert r.chain == chain_plainly(r.tool, {k: tuple(v) for k, v in r.outcomes.items()}, r.intent)


def test_three_levels_and_parts(spark):
    messages = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", "c")], "conversation_id long, seq long, role string, content string")
    calls = spark.createDataFrame([(1, 1, 9, "t9"), (1, 1, 8, "t8"), (5, 0, 1, "lost")], "conversation_id long, seq long, id long, tool_name string")
    rows = {(r.conversation_id, r.part): r.messages for r in entities.nested(spark.createDataFrame([(1,), (2,)], "conversation_id long"), messages, calls, most=2).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)} and rows[2, 0] is None
    assert [(m.seq, [c.tool_name for c in m.calls]) for m in rows[1, 0]] == [(0, []), (1, ["t8", "t9"])] and [m.seq for m in rows[1, 1]] == [2]


def test_cascade_and_guarded_feedback(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(10, 1), (20, 2), (30, None)], "b int, a int")
    grand = spark.createDataFrame([(100, 10), (200, 20), (300, 30)], "c int, b int")
    left = entities.cascade(parents, parents.where("a = 1"), "a", child=(children, "b", "a"), grandchild=(grand, "c", "b"))
    assert [sorted(r[k] for r in left[t].collect()) for t, k in zip(left, "abc", strict=True)] == [[2], [20, 30], [200, 300]]
    turns = spark.createDataFrame([(1, 7, "assistant"), (2, 7, "user"), (3, 8, "assistant")], "message_id int, owner_id int, role string")
    schema = "message_id int, user_id int, helpful boolean, at int"
    old = spark.createDataFrame([(1, 7, True, 1)], schema)
    new = spark.createDataFrame([(1, 7, False, 2), (1, 7, True, 3), (2, 7, True, 2), (3, 7, True, 2), (3, 8, False, 2)], schema)
    assert sorted(tuple(r) for r in entities.rated(old, new, turns).collect()) == [(1, 7, True, 3), (3, 8, False, 2)]


def test_a_stopped_backfill_goes_on(spark, tmp_path):
    entries = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(100)], "id long, payload string")

    def embed(texts):
        if len(texts) > 32:
            raise ValueError("too many at once")
        return [[float(len(t)), float(len(texts))] for t in texts]

    step = backfill.in_batches(embed)
    stopped, whole = str(tmp_path / "stopped"), str(tmp_path / "whole")
    part = backfill.backfill(entries, step, stopped, run=1, slices=4, stop_after=2)
    assert 0 < part.count() < 100
    first = {r.id for r in part.collect()}
    resumed = {(r.id, r.checksum, r.vector[0]): r.run for r in backfill.backfill(entries, step, stopped, run=2, slices=4).collect()}
    once = {(r.id, r.checksum, r.vector[0]) for r in backfill.backfill(entries, step, whole, run=1, slices=4).collect()}
    assert set(resumed) == once and len(once) == 100 and {k[0] for k, run in resumed.items() if run == 1} == first
    changed = entries.withColumn("payload", F.when(F.col("id") == 5, "new").otherwise(F.col("payload")))
    again = backfill.backfill(changed, step, whole, run=3, slices=4)
    assert again.count() == 100 and [r.id for r in again.where("run = 3").collect()] == [5]
    with pytest.raises(Exception, match="vectors for"):
        backfill.backfill(entries, backfill.in_batches(lambda texts: []), str(tmp_path / "bad"), run=1, slices=1)
