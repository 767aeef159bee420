"""Steps that once grew faster than their input, or differed from SQL on rare values."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import rules as U
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import analytics as N
from quarry.operators import fee_tables as FT
from quarry.operators import ingest as I
from quarry.operators import retrieval as R
from quarry.operators import webhooks as H
from quarry.streaming import stateful as S


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_tokenise_a_text_once(spark):
    words = [f"w{i}" for i in range(20_000)]
    frame = spark.createDataFrame([(" ".join(words),)], "t string").select(F.explode(T.phrases(T.tokens(F.col("t")))).alias("p"))
    assert frame._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert sorted(r["p"] for r in frame.collect()) == sorted([f"{a} {b}" for a, b in zip(words, words[1:])] + [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])])


def test_vector_literals_round_exact_values_ties_to_even(spark):
    rng = random.Random(2)
    ties = [n / 1024 for n in range(-2_000, 2_000)] + [0.1494140625, -0.0, 0.0, -1e-12, 4e-10, 2.0**23 - 0.5, 2.0**23, 2.0**31 + 256, 1.5e12, -9.0e18, float("nan"), float("inf"), float("-inf"), None]
    values = ties + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 6) for _ in range(20_000)]
    rows = [(i, values[i : i + 20]) for i in range(0, len(values), 20)] + [(-1, []), (-2, None)]
    frame = spark.createDataFrame(rows, "i int, v array<float>").select("i", U.vector_literal(F.col("v")).alias("s"))
    con = duckdb.connect()
    table = spark.createDataFrame(rows, "i int, v array<float>").toArrow()  # noqa: F841  DuckDB reads it by its name
    want = con.execute("SELECT i, '[' || array_to_string(list_transform(v, lambda x: printf('%.9f', x::DOUBLE)), ',') || ']' FROM \"table\"").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want)


def test_vector_search_compares_in_the_tasks_that_hold_the_rows(spark):
    rng = random.Random(3)
    odd = [None, [], [1.0, None], [0.0, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0], [1e30, 1e30, 1e30]]
    rows = [(i, rng.choice(odd) if i % 9 == 0 else [float(rng.randint(-3, 3)), rng.random(), rng.choice([0.0, 1.0])] if i % 2 else [1.0, 1.0, 0.5], rng.choice([None, 1, 2, 3])) for i in range(400)]
    rows += [(None, [1.0, 1.0, 0.5], 1), (7, [1.0, 1.0, 0.5], 2)]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int").repartition(3).cache()
    asked = vectors.where("vec_id % 10 = 0 OR vec_id IS NULL")
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"), F.col("label").alias("l"))
    plain = vectors.crossJoin(q).withColumn("similarity", V.cosine(F.col("embedding"), F.col("e")))
    other, fits = F.col("vec_id") != F.col("query_id"), F.col("l").isNull() | (F.col("l") == 3) | (F.col("l") == F.col("label"))
    for options, wanted in (({}, other), ({"itself": True}, F.lit(True)), ({"same": "label", "unless": 3}, other & fits)):
        for k in (4, None):
            frame = R.cosine_top_k(vectors, asked, k, **options)
            assert "Join" not in _plan(frame)
            pairs = plain.where(wanted).select("query_id", "vec_id", "similarity")
            want = pairs if k is None else R.top_k(pairs, k, "vec_id", score="similarity").select("query_id", "rank", "vec_id", "similarity")
            assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_a_page_of_deliveries_is_that_of_the_whole_log(spark):
    events = spark.range(300).select(
        F.col("id").alias("event_id"), F.element_at(F.array(*map(F.lit, ("user.created", "item.updated", "other"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), F.when(F.col("id") % 4 != 0, F.lit("{}")).alias("data"),
        F.timestamp_seconds(F.col("id") % 50).cast("timestamp_ntz").alias("at"),
    )
    hooks = spark.createDataFrame([(1, "k", ["user.created", "user.created", "item.updated"], True), (2, "l", ["item.updated"], True), (3, "m", ["user.created"], False), (4, "n", ["user.deleted"], True)], "webhook_id int, secret string, events array<string>, is_active boolean")
    answers = H.subscribed(events, hooks).where("event_id % 5 < 3").select("webhook_id", "event_id", (F.col("event_id") % 300 + 100).cast("int").alias("status"), F.repeat(F.lit("x"), 20_000).alias("body"), F.lit(None).cast("string").alias("error"))
    log = H.delivery_log(H.dispatched(events, hooks), answers)
    for skip, limit in ((0, 10), (7, 5), (0, 1_000)):
        page, want = H.delivery_page(events, hooks, answers, skip, limit), H.history(log, skip, limit)
        names = sorted(want.columns)
        assert sorted(page.columns) == names
        assert sorted(map(repr, page.select(names).collect())) == sorted(map(repr, want.select(names).collect()))
    read = _plan(H.delivery_page(events, hooks, answers, 0, 10))
    assert "Window" not in read  # places are known before anything is signed


def _slugs(spark, *columns):
    frame = spark.createDataFrame([("x",)], "line string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return frame._jdf.queryExecution().analyzed().toString().count("[^a-z0-9]+")


def test_tags_and_line_kinds_slug_a_text_once(spark):
    line = F.col("line")
    assert _slugs(spark, *U.tuition_tags(line, line, line)) == 2  # tracks and basis
    assert [_slugs(spark, f(line)) for f in (FT.is_header, FT.is_section, FT.is_title)] == [1, 1, 1]


def test_keywords_keep_the_first_spelling_in_time_that_grows_with_their_number(spark):
    many = [f"{'W' if i < 30_000 else 'w'}{i % 30_000}" for i in range(60_000)]
    odd = ["", " B ", "b", "a", None, "A ", "B", " ", "c"]
    rows = spark.createDataFrame([(1, many), (2, odd), (3, []), (4, None)], "i int, k array<string>")
    got = {r.i: r.u for r in rows.select("i", N.keywords_once(F.col("k")).alias("u")).collect()}
    assert got == {1: many[:30_000], 2: ["B", "a", "c"], 3: [], 4: None}
    assert "array_position" not in str(N.keywords_once(F.col("k")))


def test_many_days_of_many_keys_pass_in_one_batch(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 400_000)), rng.randint(1, 5)) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "key string, id int, time timestamp_ntz, n int")
    got = S.admitted(frame, 4, 8)
    assert "FlatMapGroups" not in _plan(got)
    state, want = {}, []
    for key, i, time, n in sorted(rows, key=lambda r: (r[2], r[1])):
        state[key], answer = S.admit(state.get(key, (-1, 0, -1, 0)), (time - datetime(1970, 1, 1)).total_seconds(), n, 4, 8, False)
        want.append((key, i, *answer))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_lecture_chunks_are_given_on_before_a_batch_ends(spark):
    texts = [(i, f"Text {i}. " * 2_000) for i in range(300)] + [(300, None), (301, "")]
    frame = spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)
    sizes = I.lecture_chunks(frame).select("doc_id", "content").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == sum(len(I.overlapping(t or "")) for _, t in texts)
    assert {(r.doc_id, r.chunk_id, r.content) for r in I.lecture_chunks(frame).where("doc_id >= 299").collect()} == {(299, f"299-{n:04d}", c) for n, c in enumerate(I.overlapping(texts[299][1]))}
    assert I.GATHERED <= 1 << 22


def _recorded(monkeypatch):
    sizes, stored = {}, R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: sizes.setdefault(name, stored(df, name)))
    monkeypatch.setattr(R, "stored_by", None)  # no table of entries by id
    return sizes


def _entries(spark, n=400):
    rng = random.Random(5)
    say = lambda k: " ".join(rng.choice(["tín", "chi", "hoc phi", "cao học", "x_1", "the", "Ωmega", "w1", "w2", "w3", "w4", "II", "q"]) for _ in range(k))
    rows = [(i, say(3), rng.choice(["en", None]), rng.choice(["table_row", "chunk", "faq", None]), None if i % 50 == 0 else say(rng.randint(0, 30)), say(5), [say(1), None, ""]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, category string, source_kind string, content string, summary string, keywords array<string>"), [(1, "hoc phi tín chỉ " + say(6)), (2, say(20)), (3, "w1"), (4, "none of it"), (5, None), (6, "cao học w1 w2"), (7, "")]


def test_lexical_search_stores_the_best_of_each_task_alone(spark, monkeypatch):
    entries, asked = _entries(spark)
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = R.top_k(R.lexical_points(R.corpus_features(entries), queries), 3, "id").select("query_id", "rank", "id", "score").collect()
    sizes = _recorded(monkeypatch)
    got = R.lexical_top_k(entries.repartition(5), queries, 3).drop("excerpt").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert set(sizes) == {"candidates"} and sizes["candidates"].count() <= 5 * 3 * len(asked)
    monkeypatch.setattr(R.lexical, "QUESTIONS_AT_ONCE", 2)
    monkeypatch.setattr(R.lexical, "ENTRIES_AT_ONCE", 7)
    assert sorted(map(tuple, R.lexical_top_k(entries, queries, 3).drop("excerpt").collect())) == sorted(map(tuple, want))


def test_profiled_search_stores_no_pairs(spark, monkeypatch):
    entries, asked = _entries(spark)
    queries = spark.createDataFrame(asked, "query_id int, query string")
    features = R.corpus_features(entries).withColumn("tags", F.when(F.col("id") % 3 == 0, F.array(F.lit("cao_hoc"), F.lit("chinh_quy"))))
    points = R.lexical_points(features, queries)
    sizes = _recorded(monkeypatch)
    got = sorted(map(tuple, R.profiled_top_k(features, queries, 3).collect()))
    assert "points" not in sizes and sizes["candidates"].count() <= 3 * len(asked) * sizes["entries"].rdd.getNumPartitions()
    kinds = sizes["entries"].select("id", "kind", "k.*")
    q = R.query_features(queries).select("query_id", "q_tokens", R.track_tags(F.col("q")).alias("asked"), T.any_of(F.col("q"), R.TUITION_PHRASES).alias("tuition"), (F.exists("q_tokens", lambda t: t.isin("tin", "chi")) | T.any_of(F.col("q"), R.CREDIT_PHRASES)).alias("credit"))
    bonus = R._kind_bonus(kinds.crossJoin(q).withColumn("kind", F.col("id"))).withColumnRenamed("kind", "id")
    every = bonus.join(points, ["query_id", "id"], "left").select("query_id", "id", (F.coalesce("score", F.lit(0)) + F.col("bonus")).alias("score")).where("score > 0")
    assert got == sorted(map(tuple, R.top_k(every, 3, "id").select("query_id", "rank", "id", "score").collect()))


def test_lecture_search_stores_the_best_of_each_batch_alone(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda k: rng.choice(["  ", " ", "\n"]).join(rng.choice(["prefixed", "fixed", "Mixed", "able", "tableau", "ă\x1cbcd", "of", "abcdabcd"]) for _ in range(k))
    rows = [(i, None if i == 9 else say(rng.randint(0, 60)), rng.choice(["src1", "src2", None]), rng.choice(["ví dụ", "lý thuyết"])) for i in range(300)]
    asked = [(1, "fixed able table"), (2, "of"), (3, "bcda"), (4, "mixed mixed"), (5, "absent"), (6, ""), (7, "ă\x1cbcd")]
    sizes = _recorded(monkeypatch)
    chunks = spark.createDataFrame(rows, "id long, content string, chapter string, style string").repartition(3)
    got = R.lecture_lexical_top_k(chunks, spark.createDataFrame(asked, "query_id int, query string"), F.contains("chapter", F.lit("src1")), 10.0, 4)
    want = []
    for q, query in asked:
        parts, scored = [w for w in query.split(" ") if len(w) > 3], []
        for i, content, chapter, style in rows:
            low = (content or "").lower()
            points = 10 * sum(p in low for p in parts) + (50 + 20 * low.count(query) if query and query in low else 0)
            total = points + (5 if style == "ví dụ" else 0) + (3 if len(content or "") > 200 else 0)
            scored.append((chapter == "src1" and points > 0 and total > 10, -total, i))
        hits = [s for s in scored if s[0]] or scored
        want += [(q, n, i, float(-t)) for n, (_, t, i) in enumerate(sorted(s[1:] for s in hits)[:4] and [(0, *s) for s in sorted(s[1:] for s in hits)[:4]], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert set(sizes) == {"found", "hits"} and sizes["found"].count() <= 2 * 4 * 3 * len(asked)


def test_paragraphs_of_many_documents_are_packed_in_one_batch(spark):
    rng = random.Random(7)
    rows = [(d, p, "x" * rng.randint(1, 900), rng.random() < 0.1) for d in [None, *range(300)] for p in range(rng.randint(1, 12))]
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, position int, paragraph string, heading boolean")
    packed = I.pack(frame)
    assert "FlatMapGroups" not in _plan(packed)
    want, last, size = [], None, 0
    for doc, place, text, heading in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        if doc != last or heading or size + len(text) > I.MOST or size >= I.TARGET or not want:
            n, size = (want[-1][1] + 1 if want and doc == last else 1), 0
            want.append([doc, n, [], None, place, place])
        last, size = doc, size + len(text) + 2
        want[-1][2].append(text)
        want[-1][3], want[-1][5] = want[-1][3] or (text if heading else None), place
    want = [(d, n, "\n\n".join(t), h, a, b) for d, n, t, h, a, b in want if len("\n\n".join(t)) >= I.LEAST]
    assert sorted(map(repr, map(tuple, packed.drop("summary").collect()))) == sorted(map(repr, want))


def test_a_line_is_tidied_once_for_all_that_is_asked_of_it(spark):
    frame = I.paragraphs(spark.createDataFrame([(1, "STSV * 3  Some  text here\n12\n\nKẾT LUẬN:")], "doc_id int, text string"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("STSV\\s") <= 2
    assert [tuple(r) for r in frame.collect()] == [(1, 0, "Some text here", False), (1, 3, "KẾT LUẬN:", True)]
