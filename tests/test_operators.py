"""Operators on small fixtures: edge cases of text functions, vectors, entities, ingest, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import analytics, classify, entities, ingest, retrieval
from quarry.sources import readers
from quarry.streaming import counters


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "text, keep, fold, plain",
    [("Đại học", "đai hoc", "dai hoc", "ai hoc"), ("  QĐ 2004\t", "qđ 2004", "qd 2004", "q 2004"), (None, "", "", ""), ("Thủ tục XIN", "thu tuc xin", "thu tuc xin", "thu tuc xin"), ("é", "e", "e", "e")],
)
def test_normalisers(spark, text, keep, fold, plain):
    assert one(spark, T.keep_d(F.col("t")), t=text) == keep
    assert one(spark, T.fold_d(F.col("t")), t=text) == fold
    assert one(spark, T.ascii_only(F.col("t")), t=text) == plain


def test_tokens_and_phrases(spark):
    assert one(spark, T.tokens(F.col("t")), t="Học kỳ II, y 3 môn_1 của tôi") == ["ky", "ii", "mon_1", "toi"]
    assert one(spark, T.phrases(T.tokens(F.col("t"))), t="alpha beta gamma") == ["alpha beta", "beta gamma", "alpha beta gamma"]
    assert one(spark, T.phrases(T.tokens(F.col("t"))), t="alpha") == []


def test_text_functions(spark):
    assert one(spark, T.slug(F.col("t")), t="QĐ 2004 - Quy định!") == "q-2004-quy-inh"
    assert one(spark, T.slug(F.col("t")), t="đĐ") == "document"
    assert one(spark, T.tidy_space(F.col("t")), t="a  b\r\nc\r\n\r\n\r\nd ") == "a b\nc\n\nd"
    assert one(spark, T.summary(F.col("t"), 10), t="hello  wonderful world") == "hello..."
    assert one(spark, T.amount_value(T.amount_text(F.col("t"))), t="Phí 1.473.287 đ6ng") == 1473287
    assert one(spark, T.amount_value(F.col("t")), t="none") is None
    assert one(spark, T.is_heading(F.col("t")), t="CHƯƠNG MỘT") and one(spark, T.is_heading(F.col("t")), t="Muc 3 abc") and not one(spark, T.is_heading(F.col("t")), t="plain words")
    assert one(spark, T.is_noise(F.col("t")), t="12 * STSV") and one(spark, T.is_noise(F.col("t")), t="--- 3 ---") and not one(spark, T.is_noise(F.col("t")), t="some words")
    assert one(spark, T.is_contents(F.col("t")), t="MỤC LỤC") and one(spark, T.is_contents(F.col("t")), t="a ..... 1\nb ..... 2")
    assert one(spark, T.title_from_name(F.col("t")), t="raw/quyDinh_2004-hoc.pdf") == "quy Dinh 2004 hoc"
    assert one(spark, T.category_from_path(F.col("t")), t="hoc_phi/he-chinh") == "Hoc Phi / He Chinh"
    assert one(spark, T.clamp(F.col("t"), 1, 5, 3), t="x") == 3.0 and one(spark, T.clamp(F.col("t"), 1, 5, 3), t="9") == 5.0
    assert one(spark, T.course_code(F.col("t")), t="học it3011 nhé") == "IT3011"
    assert one(spark, T.chapter(F.col("t")), t="x\nChương 2: Ma trận\ny") == "Ma trận"
    assert one(spark, T.occurrences(F.col("t"), F.col("p")), t="aaaa", p="aa") == 2 and one(spark, T.occurrences(F.col("t"), F.col("p")), t="aaaa", p="") == 0


def test_cosine_edge_cases(spark):
    c = V.cosine(F.col("a"), F.col("b"))
    assert one(spark, c, a=[1.0, 0.0], b=[1.0, 0.0]) == 1.0
    assert one(spark, c, a=[0.0, 0.0], b=[1.0, 0.0]) == one(spark, c, a=[1.0], b=[1.0, 0.0]) == 0.0


def test_routes_in_order(spark):
    probes = {"Xin  chào": "casual", "phúc khảo bài giảng": "course_evaluation", "bài giảng": "lecture_qa", "tích phân": "exercise_solving", "lịch dạy": "lecturer_qa", "it3011": "course_catalog", "làm đơn bảo lưu": "form_fill", "bảo lưu": "procedure_workflow", "mức thu": "tuition_lookup", "tệp đính kèm": "attachment_qa", "ok?": "knowledge_qa", "ok": "casual"}
    got = spark.createDataFrame(list(probes.items()), "t string, want string").select("want", classify.route(F.col("t"))["intent"].alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_regular_track_beats_graduate_track_unless_named(spark):
    rows = [("regular", "Học phí chính quy", ["chinh_quy"]), ("graduate", "Học phí cao học", ["cao_hoc"])]
    corpus = spark.createDataFrame([(i, t, "fees", "table_row", t, t, ["fees"], tags, ["per_credit"]) for i, t, tags in rows], "id string, title string, category string, source_kind string, content string, summary string, keywords array<string>, tags array<string>, basis array<string>")
    asked = spark.createDataFrame([(1, "học phí một tín chỉ"), (2, "học phí cao học")], "query_id int, query string")
    best = retrieval.profiled_top_k(retrieval.corpus_features(corpus), asked, 1).collect()
    assert {r.query_id: r.id for r in best} == {1: "regular", 2: "graduate"}


def test_index_finds_parts_of_words_and_short_questions(spark):
    """Phrases that begin and end inside words, questions inside words, questions without tokens: points as counted by hand."""
    entries = [("a", "t", "xab cdef"), ("b", "t", "nothing here"), ("c", "ab cd", "ab cd"), ("d", "t", None), ("e", "t", "?!")]
    corpus = spark.createDataFrame([(i, t, "k", "s", c, "", []) for i, t, c in entries], "id string, title string, category string, source_kind string, content string, summary string, keywords array<string>")
    asked = spark.createDataFrame([(1, "ab cd"), (2, "othin"), (3, "?!"), (4, "")], "query_id int, query string")
    got = {(r.query_id, r.id): r.score for r in retrieval.lexical_points(retrieval.corpus_features(corpus), asked).collect()}
    # c: both tokens in title and content (12), cubed (8), the phrase (13), the whole question (17)
    assert got == {(1, "a"): 4 + 5, (1, "c"): 12 + 8 + 13 + 17, (2, "b"): 5, (3, "e"): 5}


def test_lexical_search_keeps_ids_that_are_texts(spark):
    """Equal points in order of the ids' code points, over several tasks, some of them without entries."""
    corpus = spark.createDataFrame([(i, "t", "k", "s", c, "", []) for i, c in (("b", "xab cdef"), ("é", "xab cdef"), ("B", "xab cdef"), ("10", "no"), ("9", "xab cdef"))], "id string, title string, category string, source_kind string, content string, summary string, keywords array<string>")
    asked = spark.createDataFrame([(1, "ab cd"), (2, "zzz")], "query_id int, query string")
    got = retrieval.lexical_top_k(corpus.repartition(8), asked, 3)
    assert dict(got.dtypes)["id"] == "string"
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect()) == [(1, 1, "9"), (1, 2, "B"), (1, 3, "b")]


def test_bonus_alone_can_win(spark):
    points = spark.createDataFrame([(1, "a", 3)], "query_id int, id string, score long")
    entries = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "z")], "id string, kind string")
    bonus = spark.createDataFrame([(1, "x", 0), (1, "y", 5), (2, "y", -1)], "query_id int, kind string, bonus long")
    got = sorted(map(tuple, retrieval.top_k_with_bonus(points, entries, bonus, 2).collect()))
    assert got == [(1, 1, "b", 5), (1, 2, "c", 5)]


def test_soft_filter_falls_back(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query_id int, v string")
    assert sorted(map(tuple, retrieval.soft_filter(rows, F.col("v") == "a").collect())) == [(1, "a"), (2, "b")]


def test_versions(spark):
    current = spark.createDataFrame([(1, 1, "x", True), (2, 1, "y", True), (3, 1, "z", True)], "source_id int, version int, checksum string, is_active boolean")
    incoming = spark.createDataFrame([(1, "x"), (2, "new"), (9, "n")], "source_id int, checksum string")
    assert sorted(map(tuple, entities.next_versions(current, incoming).collect())) == [(1, 1, "x", True), (2, 1, "y", False), (2, 2, "new", True), (9, 1, "n", True)]


def test_pages_and_filters(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0, "k") for i in range(10)], "id int, is_archived boolean, kind string")
    assert [r.id for r in entities.page(rows, "id", skip=3, limit=2).collect()] == [3, 4]
    assert entities.filtered(rows, archived=False, kind="k").count() == 5 and entities.filtered(rows, kind="").count() == 10
    assert entities.keep_only(rows, rows.where("false"), "id").count() == 0


def test_success_rate(spark):
    got = spark.createDataFrame([(10, 0), (8, 2), (0, 10), (0, 0)], "p int, f int").select(analytics.success_rate(F.col("p"), F.col("f")).alias("r")).collect()
    assert [r.r for r in got] == [100.0, 80.0, 0.0, 100.0]


def test_packing_opens_chunks(spark):
    lines = ["INTRODUCTION PART", "a" * 700, "b" * 700, "c" * 300, "NEXT PART", "d" * 50, "12"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(ingest.pack(ingest.paragraphs(docs)).select("doc_id", "chunk", "section_title", F.length("content").alias("n")).collect())
    assert [tuple(r) for r in got] == [(1, 1, "INTRODUCTION PART", 17 + 2 + 700 + 2 + 700), (1, 2, None, 300), (1, 3, "NEXT PART", 9 + 2 + 50)]


def test_overlap_repeats_the_last_piece():
    chunks = ingest.overlapping("\n\n".join(["x" * 1500, "y" * 900, "z" * 100]))
    assert chunks == ["x" * 1500, "x" * 200 + "\n\n" + "y" * 900 + "\n\n" + "z" * 100]
    assert ingest.overlapping("") == []


def test_readers(spark, tmp_path):
    for kind, body in {
        "d": {"id": "s1", "title": "T", "category": "C", "summary": "S", "content": "X", "keywords": ["k"]},
        "c": {"document_id": "d1", "title": "T", "category": "C", "chunks": [{"chunk_id": "c1", "content": "body", "page_from": 1, "keywords": []}]},
        "t": {"document_id": "d1", "title": "T", "category": "C", "tables": [{"table_id": "t1", "title": "Fees", "rows": [{"row_id": "r1", "label": "Row", "amount_text": "5"}]}]},
    }.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "a.json").write_text(json.dumps(body))
        (tmp_path / kind / "broken.json").write_text("{")
    rows = {r.id: r for r in readers.knowledge(spark, *(str(tmp_path / k) for k in "dct")).collect() if r.id}
    assert set(rows) == {"s1", "c1", "r1"} and rows["r1"].content == "Row 5" and rows["c1"].source_document_id == "d1"
    (tmp_path / "x.csv").write_bytes("ten,phi\nhọc,5\n,\n".encode("utf-8-sig"))
    cells = [r.cells for r in readers.read_any(spark, str(tmp_path), ".csv").collect()]
    assert cells == [["ten", "phi"], ["học", "5"]]
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path), ".odt")


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.pdf", "x/a.pdf", "d1", "Tên", "c", "3", "published", None, None, None, None, None, None)], ", ".join(f"{c} string" for c in readers.MANIFEST_COLUMNS))
    readers.write_manifest(rows, str(tmp_path / "m"))
    assert readers.manifest(spark, str(tmp_path / "m")).first().title == "Tên"


def test_stream_counts_equal_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    streamed = counters.run_available(counters.tumbling_counts(stream, "1 day", late="1 hour"), "day_counts", str(tmp_path / "c"))
    batch = counters.tumbling_counts(spark.read.parquet(f"{path}/events.parquet"), "1 day")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_admission_equals_a_sequential_model(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(1)
    rows = sorted((datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(86400 * 2)) if rng.random() < 0.3 else datetime(2024, 1, 1, 5, 0, rng.randrange(60)), rng.randrange(3), i) for i in range(400))
    events = spark.createDataFrame([(i, t, u) for t, u, i in rows], "event_id int, ts timestamp_ntz, user_id int")
    got = {r.event_id: r.admitted for r in counters.admission(events, 4, 20).collect()}
    minute, day = {}, {}
    for t, u, i in rows:
        m, d = (u, t.replace(second=0)), (u, t.date())
        fits = day.get(d, 0) < 20 and minute.get(m, 0) < 4
        assert got[i] == fits, i
        if fits:
            minute[m], day[d] = minute.get(m, 0) + 1, day.get(d, 0) + 1
