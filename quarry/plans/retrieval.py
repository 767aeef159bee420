"""Retrieval and classification queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import classify as C
from quarry.operators import retrieval as R
from quarry.plans import duck as D
from quarry.sources import adapters as A
from quarry.tables import broadcast_if_small

#: Invented procedures of a student office: order, id, title, keywords.
PROCEDURES = (
    (1, "doi_phong", "Quy trình đổi phòng ký túc xá", ["đổi phòng", "chuyển phòng ký túc"]),
    (2, "muon_sach", "Quy trình mượn sách liên thư viện", ["mượn sách", "thư viện", "phiếu mượn"]),
    (3, "cap_the", "Quy trình cấp lại thẻ gửi xe", ["cấp lại thẻ", "thẻ gửi xe", "mất thẻ"]),
    (4, "doi_nhom", "Quy trình đổi nhóm thực hành", ["đổi nhóm", "nhóm thực hành"]),
    (5, "dat_phong_hoc", "Quy trình đặt phòng tự học", ["đặt phòng", "phòng tự học"]),
    (6, "mo_tai_khoan", "Quy trình mở tài khoản máy chủ", ["tài khoản máy chủ", "mở tài khoản"]),
    (7, "hoan_thi", "Quy trình dời buổi kiểm tra", ["dời buổi kiểm tra", "kiểm tra bù"]),
)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def lexical_topk(spark, sf_dir):
    return R.lexical_top_k(A.corpus(spark, sf_dir), A.question_set(spark, sf_dir)).drop("excerpt")


def lexical_excerpts(spark, sf_dir):
    return R.lexical_top_k(A.corpus(spark, sf_dir), A.question_set(spark, sf_dir), 1).select("query_id", "id", F.length("excerpt").cast("long").alias("n_excerpt"), F.md5("excerpt").alias("excerpt_md5"))


KINDS = ("table_row", "chunk", "course_record", "faq")


def lexical_scores_profiled(spark, sf_dir):
    """Entries take kinds and tags by id; questions get tuition words in front, some a track."""
    corpus = A.corpus(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 4 + 1).cast("int"))
    tags = F.when(F.col("id") % 3 == 0, F.array(F.lit("chinh_quy"))).when(F.col("id") % 3 == 1, F.array(F.lit("cao_hoc"), F.lit("chinh_quy"))).otherwise(F.array().cast("array<string>"))
    corpus = corpus.withColumns({"source_kind": kind, "tags": tags, "basis": F.when(F.col("id") % 2 == 0, F.array(F.lit("per_credit"))).otherwise(F.array(F.lit("full_program")))})
    asked = A.question_set(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("học phí tín chỉ "), F.col("query"))).when(F.col("query_id") % 5 == 1, F.concat(F.lit("mức thu cao học "), F.col("query"))).otherwise(F.col("query")))
    return R.profiled_top_k(R.corpus_features(corpus), asked, 3)


_PROFILED_SQL = (
    "WITH " + D.FEATURES.replace("lang AS category, source AS source_kind", "lang AS category, ['table_row', 'chunk', 'course_record', 'faq'][doc_id % 4 + 1] AS source_kind").replace(
        "AS query FROM benchmark", "AS query0 FROM benchmark"
    ).replace("questions AS (\n  SELECT item_id", "questions AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'học phí tín chỉ ' || query0 WHEN query_id % 5 = 1 THEN 'mức thu cao học ' || query0 ELSE query0 END AS query FROM (\n  SELECT item_id").replace("FROM benchmark\n)", "FROM benchmark)\n)")
    + f""", p AS (
  SELECT *, CASE id % 3 WHEN 0 THEN ['chinh_quy'] WHEN 1 THEN ['cao_hoc', 'chinh_quy'] ELSE list_filter([{", ".join(f"CASE WHEN {D.any_of('blob', w)} THEN '{n}' END" for n, w in R.TRACKS)}], lambda x: x IS NOT NULL) END AS tags,
    CASE WHEN id % 2 = 0 THEN ['per_credit'] ELSE ['full_program'] END AS basis,
    list_filter([{", ".join(f"CASE WHEN {D.any_of('q', w)} THEN '{n}' END" for n, w in R.TRACKS)}], lambda x: x IS NOT NULL) AS asked_tracks,
    {D.any_of('q', R.TUITION_PHRASES)} AS tuition, list_has_any(q_tokens, ['tin', 'chi']) OR {D.any_of('q', R.CREDIT_PHRASES)} AS credit
  FROM (SELECT *, n_title || ' ' || n_summary || ' ' || n_content || ' ' || n_keywords AS blob FROM scored)
), b AS (
  SELECT *, len(list_intersect(tags, [{D.words(R.OTHER_TRACKS)}])) AS odd, len(list_filter(tags, lambda x: x IN ({D.words(R.OTHER_TRACKS)}) AND NOT list_contains(asked_tracks, x))) AS conflicts FROM p
), allowed AS (
  SELECT * FROM b WHERE NOT tuition OR source_kind <> 'table_row' OR len(tags) = 0 OR CASE WHEN len(asked_tracks) > 0 THEN list_has_any(tags, asked_tracks) ELSE odd = 0 END
), bonus AS (
  SELECT query_id, id, (score + CASE source_kind {" ".join(f"WHEN '{k}' THEN CASE WHEN list_has_any(q_tokens, [{D.words(w)}]) THEN {n} ELSE 0 END" for k, n, w in R.KIND_TOKENS)} WHEN 'chunk' THEN 2 ELSE 0 END
    + CASE WHEN tuition THEN
      CASE source_kind WHEN 'table_row' THEN 22 + CASE WHEN credit AND list_contains(basis, 'per_credit') THEN 18 ELSE 0 END - CASE WHEN credit AND list_contains(basis, 'full_program') THEN 10 ELSE 0 END WHEN 'chunk' THEN -10 ELSE 0 END
      + CASE WHEN len(asked_tracks) > 0 THEN CASE WHEN list_has_any(tags, asked_tracks) THEN 24 - 6 * conflicts WHEN source_kind = 'table_row' THEN -18 ELSE 0 END
        ELSE CASE WHEN list_contains(tags, 'chinh_quy') AND odd = 0 THEN 26 WHEN list_contains(tags, 'chinh_quy') THEN 10 ELSE 0 END - 14 * odd END
      ELSE 0 END)::BIGINT AS score FROM allowed
) SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bonus WHERE score > 0) WHERE rank <= 3"""
)


def _queries_of_vectors(vectors):
    """The stated query set of a vector search: every vector whose id 100 divides."""
    return vectors.where("vec_id % 100 = 0")


def cosine_topk(spark, sf_dir):
    vectors = A.table(spark, sf_dir, "embeddings")
    return _rounded(R.cosine_top_k(vectors, _queries_of_vectors(vectors)), "similarity")


def cosine_topk_filtered(spark, sf_dir):
    vectors = A.table(spark, sf_dir, "embeddings")
    asked = _queries_of_vectors(vectors).withColumn("label", F.when(F.col("vec_id") % 300 != 0, F.col("label")))  # some ask without a label
    return _rounded(R.cosine_top_k(vectors, asked, same="label"), "similarity")


_COSINE = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, a.label AS q_label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id {same})
SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def _near_questions(spark, sf_dir, k, allowed=None):
    """(query_id, id, similarity): question j takes vector j, entry i vector i; the ``k`` nearest entries that have vectors, of those ``allowed`` (id) if given."""
    vectors, asked = A.table(spark, sf_dir, "embeddings"), A.question_set(spark, sf_dir).select(F.col("query_id").alias("vec_id"))
    known = A.corpus(spark, sf_dir).select("id") if allowed is None else allowed
    entries = vectors.join(known.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    near = R.cosine_top_k(entries, vectors.join(F.broadcast(asked), "vec_id", "left_semi"), k, itself=True)
    return near.select("query_id", F.col("vec_id").alias("id"), F.round("similarity", 6).alias("similarity"))


def hybrid_topk(spark, sf_dir):
    """The twelve nearest entries bring 60 times their similarity."""
    return R.hybrid_top_k(R.corpus_features(A.corpus(spark, sf_dir)), A.question_set(spark, sf_dir), _near_questions(spark, sf_dir, 12))


_HYBRID_SQL = "WITH " + D.FEATURES + """, near AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT query_id FROM questions) AND b.vec_id IN (SELECT id FROM corpus)
), top AS (SELECT query_id, id, greatest(round(similarity, 6), 0) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM near) WHERE r <= 12
), c AS (SELECT query_id, id, round_even(score + 60.0 * coalesce(similarity, 0), 0)::BIGINT AS score, score + 60.0 * coalesce(similarity, 0) AS combined FROM scored LEFT JOIN top USING (query_id, id))
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c WHERE combined > 0) WHERE rank <= 3"""


def _lectures(spark, sf_dir):
    """Lecture chunks: subject = language, chapter = source, style from the text."""
    return A.corpus(spark, sf_dir).select("id", "content", F.col("category").alias("subject"), F.col("source_kind").alias("chapter"), T.style_hint(F.col("content")).alias("style"))


def lecture_score(spark, sf_dir):
    return R.lecture_top_k(_lectures(spark, sf_dir), A.question_set(spark, sf_dir))


def lecture_contexts(spark, sf_dir):
    """What a generator is told for each question."""
    chunks, asked = _lectures(spark, sf_dir), A.question_set(spark, sf_dir)
    return R.lecture_context(asked, R.lecture_top_k(chunks, asked), chunks)


def lecture_hybrid(spark, sf_dir):
    """Lecture search with vectors: every chunk that has one brings 50 times its similarity."""
    near = _near_questions(spark, sf_dir, None)
    scored = R.lecture_top_k(_lectures(spark, sf_dir), A.question_set(spark, sf_dir), near=near)
    return scored.withColumn("score", F.round("score", 5))


def _style_sql(x):
    low = f"lower(coalesce({x}, ''))"
    found = ", ".join(f"CASE WHEN {D.any_of(low, w)} THEN '{n}' END" for n, w in T.STYLES)
    return f"coalesce(nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ' → '), ''), 'lý thuyết')"


_LECTURE = f"""WITH {D.CORPUS}, {D.QUESTIONS}, l AS (SELECT id, content, category AS subject, source_kind AS chapter, {_style_sql('content')} AS style FROM corpus), w AS (
  SELECT id, lower(content) AS low, length(content) AS size, subject, chapter, style, list_distinct(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '')) AS words FROM l
), q AS (SELECT query_id, lower(query) AS q, list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '')) AS q_words, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: length(x) > 3) AS long_words FROM questions)"""
_LECTURE_SQL = _LECTURE + """, s AS (
  SELECT query_id, id, (CASE WHEN contains(q, lower(subject)) THEN 10 ELSE 0 END + CASE WHEN contains(q, lower(chapter)) THEN 8 ELSE 0 END + 2 * len(list_intersect(q_words, words))
    + CASE WHEN len(list_filter(string_split(lower(style), ' → '), lambda x: contains(q, x))) > 0 THEN 5 ELSE 0 END)::DOUBLE AS score FROM w, q)
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 4"""


_LECTURE_HYBRID_SQL = _LECTURE + """, s AS (
  SELECT query_id, id, (CASE WHEN contains(q, lower(subject)) THEN 10 ELSE 0 END + CASE WHEN contains(q, lower(chapter)) THEN 8 ELSE 0 END + 2 * len(list_intersect(q_words, words))
    + CASE WHEN len(list_filter(string_split(lower(style), ' → '), lambda x: contains(q, x))) > 0 THEN 5 ELSE 0 END)::DOUBLE AS score FROM w, q
), near AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b
), t AS (SELECT query_id, id, score + 50.0 * coalesce(similarity, 0) AS score FROM s LEFT JOIN near USING (query_id, id))
SELECT query_id, rank, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 4"""


def lecture_lexical(spark, sf_dir):
    """Lexical lecture search with the soft chapter filter: the chapter "src1" where any of its chunks scores, else all."""
    kept = R.lecture_lexical_top_k(_lectures(spark, sf_dir), A.question_set(spark, sf_dir), F.contains(F.lower("chapter"), F.lit("src1")))
    return kept.select("query_id", "rank", "id", "score", (F.col("score") >= 60).alias("confident"))


_LECTURE_LEXICAL_SQL = _LECTURE + """, s AS (
  SELECT query_id, id, chapter, (CASE WHEN contains(low, q) THEN 50 + 20 * ((length(low) - length(replace(low, q, ''))) // length(q)) ELSE 0 END + 10 * len(list_filter(long_words, lambda x: contains(low, x)))
    + CASE WHEN contains(lower(style), 'định nghĩa') OR contains(lower(style), 'ví dụ') OR contains(lower(style), 'bài tập') THEN 5 ELSE 0 END + CASE WHEN size > 200 THEN 3 ELSE 0 END)::DOUBLE AS score FROM w, q
), h AS (SELECT *, contains(lower(chapter), 'src1') AND score > 10 AS hit FROM s), k AS (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM h)
SELECT query_id, rank, id, score, score >= 60 AS confident FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k WHERE hit OR NOT any_hit) WHERE rank <= 4"""


STYLES_ASKED = ("bài tập", "ví dụ")


def lecture_by_style(spark, sf_dir):
    """Of each subject and asked style the four chunks that fit best: the style in the hint 20 points, in the content 10, over 500 characters 5."""
    asked = spark.createDataFrame([(s,) for s in STYLES_ASKED], "asked string")
    rows = _lectures(spark, sf_dir).withColumn("content", F.when(F.col("id") % 7 == 0, F.concat(F.lit("Ví dụ: "), F.col("content"))).when(F.col("id") % 5 == 0, F.concat(F.lit("exercise "), F.col("content"))).otherwise(F.col("content")))
    rows = rows.withColumn("style", T.style_hint(F.col("content"))).crossJoin(F.broadcast(asked))
    hinted, said = F.contains("style", F.col("asked")), F.contains(F.lower("content"), F.col("asked"))
    score = F.when(hinted, 20).otherwise(0) + F.when(said, 10).otherwise(0) + F.when(F.length("content") > 500, 5).otherwise(0)
    scored = rows.where(hinted | said).select("subject", "asked", "id", score.alias("score")).withColumn("by", F.struct("subject", "asked"))
    return R.top_k(scored, 4, "id", by="by").select("subject", "asked", "rank", "id", "score")


_BY_STYLE_SQL = f"""WITH l AS (SELECT doc_id AS id, lang AS subject, CASE WHEN doc_id % 7 = 0 THEN 'Ví dụ: ' || text WHEN doc_id % 5 = 0 THEN 'exercise ' || text ELSE text END AS content FROM documents
), h AS (SELECT *, {_style_sql('content')} AS style FROM l), a AS (SELECT unnest([{D.words(STYLES_ASKED)}]) AS asked), s AS (
  SELECT subject, asked, id, CASE WHEN contains(style, asked) THEN 20 ELSE 0 END + CASE WHEN contains(lower(content), asked) THEN 10 ELSE 0 END + CASE WHEN length(content) > 500 THEN 5 ELSE 0 END AS score FROM h, a
  WHERE contains(style, asked) OR contains(lower(content), asked))
SELECT subject, asked, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY subject, asked ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 4"""


def catalog_rerank(spark, sf_dir):
    """Parts as courses: name, code from the key, track = brand, semester = size; the queries name a code, a brand and a size."""
    parts = A.table(spark, sf_dir, "part")
    asked = spark.createDataFrame(
        [(1, "môn CS101 học kỳ", None, None, False), (2, "danh sach mon Brand#1", "Brand#1", 7, True), (3, "CS200A.1", None, 11, False)],
        "query_id int, query string, asked_track string, asked_semester int, list_question boolean",
    )
    courses = parts.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, "course_summary").otherwise("course_record").alias("kind"), F.lower("p_name").alias("name"),
        F.array(F.lower("p_brand")).alias("aliases"), F.concat(F.lit("CS"), F.col("p_partkey").cast("string")).alias("code"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("track"), F.col("p_size").alias("semester"),
    )
    scored = courses.crossJoin(R.query_set(asked)).withColumn(
        "score", R.catalogue_score(F.col("query"), F.lit(0), *[F.col(c) for c in ("kind", "name", "aliases", "code", "track", "semester", "asked_track", "asked_semester", "list_question")])
    )
    return R.top_k(scored.where("score IS NOT NULL").select("query_id", "id", "score"), 8, "id").select("query_id", "rank", "id", "score")


_CATALOG_SQL = f"""WITH q(query_id, query, asked_track, asked_semester, list_question) AS (VALUES (1, 'môn CS101 học kỳ', NULL, NULL, false), (2, 'danh sach mon Brand#1', 'Brand#1', 7, true), (3, 'CS200A.1', NULL, 11, false)), c AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'course_summary' ELSE 'course_record' END AS kind, lower(p_name) AS name, lower(p_brand) AS alias, 'CS' || p_partkey AS code, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS track, p_size AS semester FROM part
), s AS (
  SELECT query_id, id, (CASE kind WHEN 'course_record' THEN 25 ELSE 18 END + CASE WHEN code = nullif(regexp_extract(upper(query), '\\b[A-Z]{{2,}}[A-Z0-9]*\\d[\\dA-Z.]*\\b'), '') THEN 80 ELSE 0 END
    + CASE WHEN name <> '' AND contains({D.ascii_only('query')}, name) THEN 35 WHEN contains({D.ascii_only('query')}, alias) THEN 25 ELSE 0 END + CASE WHEN track = asked_track THEN 40 ELSE 0 END + CASE WHEN semester = asked_semester THEN 35 ELSE 0 END
    + CASE WHEN list_question AND kind = 'course_summary' THEN 28 WHEN list_question THEN -10 ELSE 0 END)::BIGINT AS score
  FROM c, q WHERE NOT coalesce(asked_track IS NOT NULL AND coalesce(track, '') <> '' AND track <> asked_track, false) AND NOT coalesce(asked_semester IS NOT NULL AND semester IS NOT NULL AND semester <> asked_semester, false))
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 8"""


def _procedures(spark):
    return spark.createDataFrame([(o, i, t, "", k) for o, i, t, k in PROCEDURES], "ord int, id string, title string, summary string, keywords array<string>")


def _user_questions(spark, sf_dir):
    """User turns, one in five with a procedure's keyword in front."""
    rows = A.messages(spark, sf_dir).where("role = 'user'").select((F.col("conversation_id") * 1000 + F.col("seq")).alias("query_id"), "content")
    words = F.array(*[F.lit(k[-1]) for _, _, _, k in PROCEDURES])
    return rows.select("query_id", F.when(F.col("query_id") % 5 == 0, F.concat_ws(" ", F.element_at(words, (F.col("query_id") / 5 % len(PROCEDURES) + 1).cast("int")), "content")).otherwise(F.col("content")).alias("query"))


def procedure_match(spark, sf_dir):
    return R.catalogue_match(_user_questions(spark, sf_dir), _procedures(spark))


def form_match(spark, sf_dir):
    forms = _procedures(spark).select("ord", F.concat(F.lit("form-"), "id").alias("id"), F.replace("title", F.lit("Quy trình"), F.lit("Đơn")).alias("title"), F.lit("biểu mẫu").alias("category"), F.lit("mẫu đơn sinh viên").alias("description"), "keywords")
    return R.catalogue_match(_user_questions(spark, sf_dir), forms, category=True)


def _match_sql(forms: bool) -> str:
    rows = ", ".join("(" + ", ".join([str(o), f"'form-{i}'" if forms else f"'{i}'", D.words([t.replace("Quy trình", "Đơn") if forms else t]), "[" + D.words(k) + "]"]) + ")" for o, i, t, k in PROCEDURES)
    last = "[" + D.words(k[-1] for _, _, _, k in PROCEDURES) + "]"
    extra = "'biểu mẫu' || ' ' || 'mẫu đơn sinh viên' || ' '" if forms else "''"
    more = " + CASE WHEN contains(n, 'bieu mau') THEN 4 ELSE 0 END + CASE WHEN contains(n, 'mau don sinh vien') THEN 2 ELSE 0 END" if forms else ""
    return f"""WITH p(ord, id, title, keywords) AS (VALUES {rows}), m AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'), u AS (
  SELECT query_id, CASE WHEN query_id % 5 = 0 THEN ({last})[(query_id // 5) % {len(PROCEDURES)} + 1] || ' ' || text ELSE text END AS query FROM m
), k AS (SELECT ord, id, {D.token_set("title || ' ' || " + extra + " || ' ' || array_to_string(keywords, ' ')")} AS c_tokens, {D.fold_d('title')} AS c_title, list_transform(keywords, lambda w: {D.fold_d('w')}) AS c_keywords FROM p
), a AS (SELECT query_id, {D.fold_d('query')} AS n, {D.token_set('query')} AS q_tokens FROM u), s AS (
  SELECT query_id, ord, id, (3 * len(list_intersect(q_tokens, c_tokens)) + CASE WHEN contains(n, c_title) THEN 12 ELSE 0 END{more}
    + coalesce(list_sum(list_transform(list_filter(c_keywords, lambda w: contains(n, w)), lambda w: CASE WHEN contains(w, ' ') THEN 8 ELSE 2 END)), 0))::BIGINT AS score FROM a, k)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS r FROM s WHERE score > 0) WHERE r = 1"""


def domain_filtered_topk(spark, sf_dir):
    features = R.corpus_features(A.corpus(spark, sf_dir))
    wide = R.top_k(R.lexical_best(features, A.question_set(spark, sf_dir), 12), 12, "id").drop("rank")  # the best 3 x 4
    scored = features.select("id", "category").join(broadcast_if_small(wide), "id")
    return R.domain_top_k(scored, F.col("category").isin("fr", "de"), 3, 4).select("query_id", "rank", "id", "score")


_DOMAIN_SQL = "WITH " + D.FEATURES + """, w AS (SELECT * FROM (SELECT query_id, id, score, category, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored WHERE score > 0) WHERE r <= 12),
h AS (SELECT *, category IN ('fr', 'de') AS hit, bool_or(category IN ('fr', 'de')) OVER (PARTITION BY query_id) AS any_hit FROM w)
SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h WHERE hit OR NOT any_hit) WHERE rank <= 3"""


_PROBES = ("Xin chào", "quy định đánh giá học phần", "bài giảng ma trận?", "tính tích phân", "lịch dạy giảng viên", "mon hoc IT3011", "tạo đơn bảo lưu", "thủ tục bảo lưu", "học phí bao nhiêu", "tệp đính kèm này", "học bổng", "ok?", "ok")


def router_intents(spark, sf_dir):
    """Routes of all user turns, some of which get a phrase in front."""
    return _routed(spark, sf_dir).select("conversation_id", "seq", "r.intent", "r.reason", "r.tool")


def _routed(spark, sf_dir):
    probes = F.array(*map(F.lit, _PROBES))
    rows = A.messages(spark, sf_dir).where("role = 'user'").select(
        "conversation_id", "seq", F.when(F.col("conversation_id") % 3 == 0, F.concat_ws(" ", F.element_at(probes, (F.col("conversation_id") % len(_PROBES) + 1).cast("int")), "content")).otherwise(F.col("content")).alias("content")
    )
    return rows.withColumn("r", C.route(F.col("content")))


def fallback_chains(spark, sf_dir):
    """All tools that each question tries, the first by its route; what a tool gives hangs on the length of the question."""
    size = F.length(F.coalesce("content", F.lit("")))
    outcome = lambda count, matched: F.struct(count.cast("long").alias("result_count"), matched.alias("matched"))
    outcomes = F.create_map(
        F.lit(C.CATALOGUE_TOOL), outcome(F.floor(size / 2) % 2, F.lit(None).cast("boolean")), F.lit(C.KNOWLEDGE_TOOL), outcome(size % 2, F.lit(None).cast("boolean")),
        F.lit(C.PROCEDURE_TOOL), outcome(F.lit(None), size % 3 != 0),
    )
    rows = _routed(spark, sf_dir).select("conversation_id", "seq", "r.intent", "r.tool", outcomes.alias("outcomes"))
    return C.fallback_chain(rows).select("conversation_id", "seq", F.array_join("chain", ">").alias("chain"))


def intent_counts(spark, sf_dir):
    return router_intents(spark, sf_dir).groupBy("intent").agg(F.count("*").alias("n"))


def _route_sql() -> str:
    n = "n"
    knowledge = D.any_of(n, C.KNOWLEDGE)
    attached = D.any_of(n, C.ATTACHED)
    rules = (
        f"regexp_replace(n, '\\s+', ' ', 'g') IN ({D.words(C.GREETINGS)})", D.any_of(n, C.EVALUATION), D.any_of(n, C.LECTURE), D.any_of(n, C.EXERCISE), D.any_of(n, C.LECTURER),
        f"({D.any_of(n, C.CATALOGUE)} OR regexp_matches(n, '{C.CODE}'))", f"({D.any_of(n, C.FORM)} AND ({D.any_of(n, C.PROCEDURE)} OR {knowledge}))", D.any_of(n, C.PROCEDURE), D.any_of(n, C.TUITION),
        f"({attached} AND NOT {knowledge})", f"({knowledge} OR contains(content, '?'))", attached, "true",
    )
    cases = [" ".join(f"WHEN {r} THEN " + ("NULL" if v[i] is None else D.words([v[i]])) for r, v in zip(rules, C.ROUTES, strict=True)) for i in range(3)]
    return f"""WITH m AS (SELECT conv_id AS conversation_id, turn AS seq, CASE WHEN conv_id % 3 = 0 THEN concat_ws(' ', ([{D.words(_PROBES)}])[conv_id % {len(_PROBES)} + 1], text) ELSE text END AS content FROM conversations WHERE role = 'user'),
t AS (SELECT *, {D.fold_d('content')} AS n FROM m), routed AS (SELECT conversation_id, seq, CASE {cases[0]} END AS intent, CASE {cases[1]} END AS reason, CASE {cases[2]} END AS tool FROM t)"""


_CHAINS_SQL = _route_sql().replace("WITH m AS", "WITH RECURSIVE m AS") + f""", start AS (SELECT r.*, length(coalesce(content, '')) AS size FROM routed r JOIN m USING (conversation_id, seq)
), chain AS (
  SELECT conversation_id, seq, intent, size, tool AS last, CASE WHEN tool IS NULL THEN [] ELSE [tool] END AS tools FROM start
  UNION ALL
  SELECT conversation_id, seq, intent, size, following, list_append(tools, following) FROM (SELECT *, CASE
    WHEN last = '{C.CATALOGUE_TOOL}' AND size // 2 % 2 = 0 THEN '{C.KNOWLEDGE_TOOL}' WHEN last = '{C.PROCEDURE_TOOL}' AND size % 3 = 0 THEN '{C.KNOWLEDGE_TOOL}'
    WHEN last = '{C.KNOWLEDGE_TOOL}' AND size % 2 = 0 AND intent = '{C.FEES_INTENT}' THEN '{C.PROCEDURE_TOOL}' END AS following FROM chain) WHERE following IS NOT NULL AND NOT list_contains(tools, following))
SELECT conversation_id, seq, array_to_string(arg_max(tools, len(tools)), '>') AS chain FROM chain GROUP BY ALL"""

_SUBJECT_PROBES = ("đạo hàm của hàm số", "SQL query", "python code class", "html css", "mạng http", "học máy", "lực và vận tốc", "không")


def subject_fallback(spark, sf_dir):
    probes = F.array(*map(F.lit, _SUBJECT_PROBES))
    rows = A.corpus(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, F.concat_ws(" ", F.element_at(probes, (F.col("id") / 4 % len(_SUBJECT_PROBES) + 1).cast("int")), "content")).otherwise(F.col("content")).alias("content"))
    return rows.select("id", C.subject(F.col("content")).alias("subject"))


def _subject_sql() -> str:
    counts = ", ".join("{'hits': " + " + ".join(f"contains(low, {D.words([w])})::INT" for w in words) + f", 'place': {-i}, 'name': '{n}'}}" for i, (n, words) in enumerate(C.SUBJECT_WORDS))
    return f"""WITH d AS (SELECT doc_id AS id, lower(CASE WHEN doc_id % 4 = 0 THEN concat_ws(' ', ([{D.words(_SUBJECT_PROBES)}])[(doc_id // 4) % {len(_SUBJECT_PROBES)} + 1], text) ELSE text END) AS low FROM documents),
s AS (SELECT id, list_max([{counts}]) AS best FROM d) SELECT id, CASE WHEN best.hits > 0 THEN best.name ELSE 'khac' END AS subject FROM s"""


def style_hints(spark, sf_dir):
    rows = A.corpus(spark, sf_dir).withColumn("content", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Ví dụ: câu hỏi. Theorem. "), F.col("content"))).otherwise(F.col("content")))
    return rows.select("id", T.style_hint(F.col("content")).alias("style"))


def chapters(spark, sf_dir):
    rows = A.corpus(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Intro\nChương 3. "), F.col("content"))).when(F.col("id") % 3 == 1, F.concat(F.lit("part II: "), F.col("content"))).otherwise(F.col("content")).alias("content"))
    return rows.select("id", T.chapter(F.col("content")).alias("chapter"))


def _chapter_sql() -> str:
    tries = [rf"(?i){w}\s+(?:\d+|[IVX]+)[.:\s]*([^\n]{{3,80}})" for w in T.CHAPTERS] + [rf"(?i){w}\s+(?:\d+[.\d]*)[.:\s]*([^\n]{{3,80}})" for w in T.SECTIONS]
    found = ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN regexp_extract(content, '{p}', 1) END" for p in tries)
    return f"""WITH d AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Intro' || chr(10) || 'Chương 3. ' || text WHEN 1 THEN 'part II: ' || text ELSE text END AS content FROM documents)
SELECT id, substr(trim(coalesce({found}, '')), 1, 80) AS chapter FROM d"""


_AGENTS = ("Mozilla/5.0 (iPad; CPU OS) Safari/604", "Mozilla/5.0 (Linux; Android 13) Chrome/120", "Mozilla/5.0 (X11) Firefox/119", "Edge/18", "curl/8", None)


def user_agents(spark, sf_dir):
    agents = F.array(*map(F.lit, _AGENTS))
    rows = A.tool_calls(spark, sf_dir).select("id", F.concat_ws(" ", F.element_at(agents, (F.col("id") % len(_AGENTS) + 1).cast("int")), "result").alias("agent"))
    name, kind = T.device(F.col("agent"))
    return rows.select("id", name.alias("browser"), kind.alias("device"))


_AGENTS_SQL = f"""WITH e AS (SELECT event_id AS id, lower(concat_ws(' ', ([{", ".join("NULL" if a is None else D.words([a]) for a in _AGENTS)}])[event_id % {len(_AGENTS)} + 1], props)) AS a FROM events)
SELECT id, CASE WHEN contains(a, 'chrome') THEN 'Chrome' WHEN contains(a, 'firefox') THEN 'Firefox' WHEN contains(a, 'safari') THEN 'Safari' WHEN contains(a, 'edge') THEN 'Edge' ELSE 'Unknown Browser' END AS browser,
  CASE WHEN contains(a, 'mobile') OR contains(a, 'android') THEN 'mobile' WHEN contains(a, 'tablet') OR contains(a, 'ipad') THEN 'tablet' ELSE 'desktop' END AS device FROM e"""

_SAID = [part.replace("\n", "' || chr(10) || '") for part in R.CONTEXT]

QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, lexical_excerpts, lexical_scores_profiled, cosine_topk, cosine_topk_filtered, hybrid_topk, lecture_score, lecture_contexts, lecture_hybrid, lecture_lexical, lecture_by_style, catalog_rerank, procedure_match, form_match,
        domain_filtered_topk, router_intents, intent_counts, fallback_chains, subject_fallback, style_hints, chapters, user_agents,
    )
}

ORACLES = {
    "lexical_topk": "WITH " + D.FEATURES + " SELECT query_id, rank, id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank <= 3",
    "lexical_excerpts": "WITH " + D.FEATURES + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score > 0) WHERE rank = 1), cut AS (
  SELECT query_id, id, coalesce(list_filter(list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), lambda s: len(list_filter(q_tokens, lambda t: contains({D.keep_d('s')}, t))) > 0)[1], summary, '') AS excerpt FROM best)
SELECT query_id, id, length(excerpt)::BIGINT AS n_excerpt, md5(excerpt) AS excerpt_md5 FROM cut""",
    "lexical_scores_profiled": _PROFILED_SQL,
    "cosine_topk": _COSINE.format(same=""),
    "cosine_topk_filtered": _COSINE.format(same="AND (a.label = b.label OR a.vec_id % 300 = 0)"),
    "hybrid_topk": _HYBRID_SQL,
    "lecture_score": _LECTURE_SQL,
    "lecture_contexts": f"""WITH best AS ({_LECTURE_SQL}), parts AS (SELECT query_id, rank, score, '{_SAID[0]}' || rank || '{_SAID[1]}' || lang || '{_SAID[2]}' || source || '{_SAID[3]}' || {_style_sql('text')} || '{_SAID[4]}' || printf('%.2f', score::DOUBLE)
  || '{_SAID[5]}' || substr(text, 1, {R.CONTEXT_CHARACTERS}) || '{_SAID[6]}' AS said FROM best JOIN documents ON doc_id = id WHERE rank <= {R.CONTEXT_CHUNKS})
SELECT item_id AS query_id, coalesce(string_agg(said, chr(10) ORDER BY rank), '') AS context, coalesce(bool_or(score >= {R.TRUSTED}), FALSE) AS confident FROM benchmark LEFT JOIN parts ON query_id = item_id GROUP BY 1""",
    "lecture_hybrid": _LECTURE_HYBRID_SQL,
    "lecture_lexical": _LECTURE_LEXICAL_SQL,
    "lecture_by_style": _BY_STYLE_SQL,
    "catalog_rerank": _CATALOG_SQL,
    "procedure_match": _match_sql(False),
    "form_match": _match_sql(True),
    "domain_filtered_topk": _DOMAIN_SQL,
    "router_intents": _route_sql() + " SELECT * FROM routed",
    "fallback_chains": _CHAINS_SQL,
    "intent_counts": _route_sql() + " SELECT intent, count(*) AS n FROM routed GROUP BY intent",
    "subject_fallback": _subject_sql(),
    "style_hints": f"SELECT doc_id AS id, {_style_sql('t')} AS style FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Ví dụ: câu hỏi. Theorem. ' || text ELSE text END AS t FROM documents)",
    "chapters": _chapter_sql(),
    "user_agents": _AGENTS_SQL,
}
