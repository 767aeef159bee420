"""Queries over the rule functions, and the snapshots that are made of several of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import rules as U
from quarry.functions import text as T
from quarry.operators import analytics as N
from quarry.operators import classify as C
from quarry.operators import retrieval as R
from quarry.plans import duck as D
from quarry.plans.retrieval import _near_questions, _route_sql, _subject_sql, router_intents
from quarry.sources import adapters as A

TITLES = ("Học phí cao học 1-2", "Đào tạo đại học hệ chính quy", "chatA luong cao CLC tiên tiến", "Liên thông bằng 2", "Vừa làm vừa học", "Giáo dục thể chất", "Khối ngành", "theo tín chỉ")


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _fees(spark, sf_dir):
    """Parts as tuition rows: a title by key, the name as label, the price times 10,000 as amount."""
    amount = F.concat((F.col("p_retailprice") * 10_000).cast("long").cast("string"), F.lit(" dong"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _pick(TITLES, F.col("p_partkey")).alias("title"), F.col("p_name").alias("label"), amount.alias("amount"))


def tuition_rows(spark, sf_dir):
    rows = _fees(spark, sf_dir)
    tracks, basis = U.tuition_tags(F.col("title"), F.col("label"), F.col("amount"))
    tagged = rows.withColumns({"tracks": tracks, "basis": basis})
    searched = U.tuition_text(F.col("title"), F.col("label"), F.col("amount"), F.col("tracks"), F.col("basis"))
    return tagged.select("id", F.array_join("tracks", ",").alias("tracks"), F.array_join("basis", ",").alias("basis"), searched.alias("searched"))


def _slug_sql(x):
    ascii_ = f"lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))"
    return f"coalesce(nullif(regexp_replace(regexp_replace({ascii_}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document')"


def _repaired_sql(x):
    for old, new in U.MISREAD:
        x = f"replace({x}, {D.words([old])}, {D.words([new])})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_TUITION_SQL = f"""WITH f AS (SELECT p_partkey AS id, ([{D.words(TITLES)}])[p_partkey % {len(TITLES)} + 1] AS title, p_name AS label, (p_retailprice * 10000)::BIGINT || ' dong' AS amount, (p_retailprice * 10000)::BIGINT AS value FROM part
), s AS (SELECT *, {_slug_sql("title || ' ' || label || ' ' || amount")} AS slug FROM f
), t AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {D.any_of('slug', w)} THEN '{t}' END" for t, w in U.TRACK_SLUGS)}], lambda x: x IS NOT NULL) AS named,
  {D.any_of('slug', U.CREDIT_SLUGS)} OR (contains(slug, 'cao-hoc') AND {D.any_of('slug', ('1-1', '1-2', '1-3'))}) AS credit FROM s
), g AS (SELECT *, CASE WHEN len(named) > 0 THEN named ELSE ['chinh_quy'] END AS tracks, CASE WHEN credit THEN ['per_credit'] WHEN contains(slug, 'cao-hoc') OR value >= {U.FULL_PROGRAM_FROM} THEN ['full_program'] ELSE [] END AS basis FROM t
), w AS (SELECT *, array_to_string(list_transform(list_concat(tracks, basis), lambda x: CASE x {" ".join(f"WHEN '{t}' THEN '{w}'" for t, w in U.TAG_WORDS)} END), ' ') AS words FROM g)
SELECT id, array_to_string(tracks, ',') AS tracks, array_to_string(basis, ',') AS basis, {_repaired_sql("title || ' ' || label || ' ' || amount || ' hoc phi ' || words")} AS searched FROM w"""

FILES = ("Toan cao cap.pdf", "Bai giang vat ly.pdf", "chem-1.docx", "Java core.pdf", "SQL.pptx", "Network.pdf", "AI.pdf", "mail.txt", "HTML.pdf", "x.pdf")
NAMES = (" Math ", "co hoc", "HOA", "C++", "dbms", "tcp/ip", "hoc may", "css", "music")


def subjects_named(spark, sf_dir):
    """Subjects of file names, subject names and talk."""
    rows = A.messages(spark, sf_dir).select("conversation_id", "seq", "content", (F.col("conversation_id") * 31 + F.col("seq")).alias("n"))
    said = F.concat_ws(" ", _pick(("hóa", "môn toán", "cơ sở dữ liệu", ""), F.col("n")), "content")
    return rows.select(
        "conversation_id", "seq", U.subject_of_file(_pick(FILES, F.col("n"))).alias("by_file"), U.subject_of_name(_pick(NAMES, F.col("n"))).alias("by_name"), U.spoken_subject(said, F.lit("lập trình")).alias("spoken"),
        U.sheet_role(_pick(("Dữ liệu", "TỔNG QUAN", "Kỹ sư", "Ghi chú", "Sheet1"), F.col("n"))).alias("role"),
    )


def _cases(x, table, otherwise, same):
    return "CASE " + " ".join("WHEN " + (f"{x} IN ({D.words(w)})" if same else D.any_of(x, w)) + f" THEN '{n}'" for n, w in table) + f" ELSE {otherwise} END"


_SUBJECTS_SQL = f"""WITH m AS (SELECT conv_id AS conversation_id, turn AS seq, text, conv_id * 31 + turn AS n FROM conversations), p AS (
  SELECT *, lower(([{D.words(FILES)}])[n % {len(FILES)} + 1]) AS file, lower(trim(([{D.words(NAMES)}])[n % {len(NAMES)} + 1])) AS name, lower((['hóa', 'môn toán', 'cơ sở dữ liệu', ''])[n % 4 + 1] || ' ' || coalesce(text, '') || ' lập trình') AS said,
    {D.fold_d("(['Dữ liệu', 'TỔNG QUAN', 'Kỹ sư', 'Ghi chú', 'Sheet1'])[n % 5 + 1]")} AS sheet FROM m)
SELECT conversation_id, seq, {_cases('file', U.FILE_SUBJECTS, "'khac'", False)} AS by_file, {_cases('name', U.NAMED_SUBJECTS, "'khac'", True)} AS by_name,
  {_cases('said', [(s, (s,)) for s in U.SPOKEN_SUBJECTS], 'NULL', False)} AS spoken, {_cases('sheet', U.SHEET_ROLES, "'generic_sheet'", True)} AS role FROM p"""

ASKED = ("môn học Kỹ sư học kỳ 3", "cử nhân học kỳ  12", "học kỳ hè", "môn gì")


def asked_tracks(spark, sf_dir):
    rows = A.messages(spark, sf_dir).where("role = 'user'").select("conversation_id", "seq", F.concat_ws(" ", _pick(ASKED, F.col("conversation_id")), "content").alias("query"))
    return rows.select("conversation_id", "seq", U.asked_track(F.col("query")).alias("track"), U.asked_semester(F.col("query")).alias("semester"))


_ASKED_SQL = f"""WITH q AS (SELECT conv_id AS conversation_id, turn AS seq, {D.fold_d(f"([{D.words(ASKED)}])[conv_id % {len(ASKED)} + 1] || ' ' || coalesce(text, '')")} AS n FROM conversations WHERE role = 'user')
SELECT conversation_id, seq, CASE WHEN contains(n, 'ky su') THEN 'ky_su' WHEN contains(n, 'cu nhan') THEN 'cu_nhan' END AS track, try_cast(nullif(regexp_extract(n, 'hoc ky\\s*(\\d+)', 1), '') AS INT) AS semester FROM q"""


def signed_messages(spark, sf_dir):
    return A.messages(spark, sf_dir).select("conversation_id", "seq", U.hmac_sha256(F.coalesce("content", F.lit("")), b"secret of the tests").alias("signature"))


def _pad_sql(pad):
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in b"secret of the tests".ljust(64, b"\0")) + "'::BLOB"


_SIGNED_SQL = f"SELECT conv_id AS conversation_id, turn AS seq, sha256({_pad_sql(0x5C)} || unhex(sha256({_pad_sql(0x36)} || encode(coalesce(text, ''))))) AS signature FROM conversations"


def embedding_payloads(spark, sf_dir):
    rows = A.corpus(spark, sf_dir).withColumn("section", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Mục "), F.col("id").cast("string"))))
    text = U.embedding_text(*[F.col(c) for c in ("title", "category", "source_kind", "section", "summary", "keywords", "content")])
    return rows.select("id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("md5"))


_PAYLOAD_SQL = f"""WITH {D.CORPUS}, p AS (SELECT id, trim(concat_ws(chr(10), 'Tieu de: ' || coalesce(title, ''), 'Danh muc: ' || coalesce(category, ''), 'Loai nguon: ' || coalesce(source_kind, ''), CASE WHEN id % 3 = 0 THEN 'Muc: Mục ' || id END,
  CASE WHEN summary <> '' THEN 'Tom tat: ' || summary END, CASE WHEN concat_ws(', ', keywords[1], keywords[2]) <> '' THEN 'Tu khoa: ' || concat_ws(', ', nullif(keywords[1], ''), nullif(keywords[2], '')) END, CASE WHEN content <> '' THEN 'Noi dung: ' || substr(content, 1, 6000) END), chr(10) || ' ' || chr(9)) AS t FROM corpus)
SELECT id, length(t)::BIGINT AS n_chars, md5(t) AS md5 FROM p"""


def vector_literals(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select("vec_id", F.md5(U.vector_literal(F.col("embedding"))).alias("md5"))


def listed_names(spark, sf_dir):
    rows = A.table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.array("n_name", F.col("n_regionkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("names"))
    return rows.select("n_nationkey", U.listed(F.col("names")).alias("listed"))


HEADERS = ("Họ tên", "", "Mã SV", "Họ  tên", "  ", "HO TEN", "Điểm")


def header_rows(spark, sf_dir):
    """Seven header cells for each region, rotated by its key."""
    cells = F.array(*[_pick(HEADERS, F.col("r_regionkey") + i) for i in range(len(HEADERS))])
    return A.table(spark, sf_dir, "region").select("r_regionkey", F.array_join(U.header_names(cells), ",").alias("names"))


_HEADERS_SQL = f"""WITH c AS (SELECT r_regionkey, unnest(range({len(HEADERS)})) AS i FROM region), v AS (SELECT r_regionkey, i, trim(regexp_replace(([{D.words(HEADERS)}])[(r_regionkey + i) % {len(HEADERS)} + 1], '[ \\t]+', ' ', 'g')) AS cell FROM c
), k AS (SELECT r_regionkey, i, replace({_slug_sql("CASE WHEN cell = '' THEN 'column_' || (i + 1) ELSE cell END")}, '-', '_') AS key FROM v
), n AS (SELECT *, row_number() OVER (PARTITION BY r_regionkey, key ORDER BY i) AS nth FROM k)
SELECT r_regionkey, string_agg(CASE WHEN nth > 1 THEN key || '_' || nth ELSE key END, ',' ORDER BY i) AS names FROM n GROUP BY 1"""


def subject_counts(spark, sf_dir):
    """Chunks of each subject that the words of their texts give, most first."""
    subject = C.subject(F.col("content"))
    return A.corpus(spark, sf_dir).select(subject.alias("subject")).groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject")


def routed_subjects(spark, sf_dir):
    """Routes with subjects: academic intents get the subject of the question's words."""
    content = A.messages(spark, sf_dir).where("role = 'user'").select("conversation_id", "seq", C.subject(F.col("content")).alias("found"))
    rows = router_intents(spark, sf_dir).join(content, ["conversation_id", "seq"])
    reason, subject = U.with_subject(F.col("intent"), F.col("reason"), F.col("found"))
    return rows.select("conversation_id", "seq", "intent", reason.alias("reason"), subject.alias("subject"))


def _subject_of(x):
    counts = ", ".join("{'hits': " + " + ".join(f"contains({x}, {D.words([w])})::INT" for w in words) + f", 'place': {-i}, 'name': '{n}'}}" for i, (n, words) in enumerate(C.SUBJECT_WORDS))
    return f"list_max([{counts}])"


_ROUTED_SQL = _route_sql() + f""", u AS (SELECT conv_id AS conversation_id, turn AS seq, {_subject_of('low')} AS best FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS low FROM conversations WHERE role = 'user')
), j AS (SELECT conversation_id, seq, intent, reason, CASE WHEN best.hits > 0 THEN best.name ELSE 'khac' END AS found, intent IN ({D.words(U.ACADEMIC)}) AS academic FROM routed JOIN u USING (conversation_id, seq))
SELECT conversation_id, seq, intent, CASE WHEN academic THEN reason || ' | Subject: ' || found ELSE reason END AS reason, CASE WHEN academic THEN found ELSE 'khac' END AS subject FROM j"""


def overview_composed(spark, sf_dir):
    """The overview with its lists: one row of totals beside the top questions, intents, tools and procedures, each "value:count" in order, and "intent:helpful/total", the most unhelpful first."""
    from quarry.plans import analytics as P

    messages, calls = A.messages(spark, sf_dir), A.tool_calls(spark, sf_dir)
    totals = N.overview(messages, A.feedback(spark, sf_dir), calls)

    def line(counts, value, k):
        best = counts.orderBy(F.desc("n"), value).limit(k)
        return best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v")))), lambda x: F.concat_ws(":", x["v"], (-x["o"]).cast("string"))), " | ").alias("line"))

    intents = router_intents(spark, sf_dir).groupBy("intent").agg(F.count("*").alias("n"))
    questions = messages.where("role = 'user'").groupBy(F.trim("content").alias("question")).agg(F.count("*").alias("n"))
    tools = calls.groupBy("tool_name").agg(F.count("*").alias("n"))
    judged = F.sort_array(F.collect_list(F.struct((-F.col("unhelpful")).alias("a"), (-F.col("total")).alias("b"), "intent", F.concat_ws("/", F.col("helpful").cast("string"), F.col("total").cast("string")).alias("v"))))
    quality = P.intent_quality(spark, sf_dir).agg(F.array_join(F.transform(judged, lambda x: F.concat_ws(":", x["intent"], x["v"])), " | ").alias("line"))
    out = totals
    lists = (("questions", line(questions, "question", 5)), ("intents", line(intents, "intent", 20)), ("top_tools", line(tools, "tool_name", 5)), ("procedures", line(P.top_procedures_json(spark, sf_dir), "label", 10)), ("quality", quality))
    for name, part in lists:
        out = out.crossJoin(part.withColumnRenamed("line", name))  # one row each
    return out


def lecturer_topk(spark, sf_dir):
    """Lecturer search: lexical points of all entries, similarity only of those in the lecturers' categories (here "fr" and "de")."""
    features = R.corpus_features(A.corpus(spark, sf_dir))
    allowed = features.where(F.contains("category", F.lit("fr")) | F.contains("category", F.lit("de"))).select("id")
    return R.hybrid_top_k(features, A.question_set(spark, sf_dir), _near_questions(spark, sf_dir, 12, allowed))


_LECTURER_SQL = "WITH " + D.FEATURES + """, near AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT query_id FROM questions) AND b.vec_id IN (SELECT id FROM corpus WHERE category LIKE '%fr%' OR category LIKE '%de%')
), top AS (SELECT query_id, id, greatest(round(similarity, 6), 0) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM near) WHERE r <= 12
), c AS (SELECT query_id, id, round_even(score + 60.0 * coalesce(similarity, 0), 0)::BIGINT AS score, score + 60.0 * coalesce(similarity, 0) AS combined FROM scored LEFT JOIN top USING (query_id, id))
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c WHERE combined > 0) WHERE rank <= 3"""

QUERIES = {
    f.__name__: f
    for f in (tuition_rows, subjects_named, asked_tracks, signed_messages, embedding_payloads, vector_literals, listed_names, header_rows, subject_counts, routed_subjects, overview_composed, lecturer_topk)
}


def _overview_sql():
    from quarry.plans.analytics import ORACLES as base

    top = lambda value, source, k: f"(SELECT string_agg(v || ':' || n, ' | ' ORDER BY n DESC, v) FROM (SELECT {value} AS v, count(*) AS n FROM {source} GROUP BY 1 ORDER BY n DESC, v LIMIT {k}))"
    return f"""{_route_sql()}, base AS ({base['overview']}) SELECT base.*, {top('trim(text)', "conversations WHERE role = 'user'", 5)} AS questions, {top('intent', 'routed', 20)} AS intents, {top('event_type', 'events', 5)} AS top_tools,
  (SELECT coalesce(string_agg(label || ':' || n, ' | ' ORDER BY n DESC, label), '') FROM ({base['top_procedures_json']})) AS procedures,
  (SELECT coalesce(string_agg(intent || ':' || helpful || '/' || total, ' | ' ORDER BY unhelpful DESC, total DESC, intent), '') FROM ({base['intent_quality']})) AS quality FROM base"""


ORACLES = {
    "tuition_rows": _TUITION_SQL,
    "subjects_named": _SUBJECTS_SQL,
    "asked_tracks": _ASKED_SQL,
    "signed_messages": _SIGNED_SQL,
    "embedding_payloads": _PAYLOAD_SQL,
    "vector_literals": "SELECT vec_id, md5('[' || array_to_string(list_transform(embedding, lambda x: printf('%.9f', x::DOUBLE)), ',') || ']') AS md5 FROM embeddings",
    "listed_names": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_name || '; ' || n_regionkey ELSE 'Khong co' END AS listed FROM nation",
    "header_rows": _HEADERS_SQL,
    "subject_counts": f"SELECT CASE WHEN best.hits > 0 THEN best.name ELSE 'khac' END AS subject, count(*) AS n FROM (SELECT {_subject_of('low')} AS best FROM (SELECT lower(coalesce(text, '')) AS low FROM documents)) GROUP BY 1",
    "routed_subjects": _ROUTED_SQL,
    "overview_composed": _overview_sql(),
    "lecturer_topk": _LECTURER_SQL,
}
