"""The retrieval snapshot and the runs around it as queries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import backfill as B
from quarry.operators import entities as E
from quarry.operators import fee_tables as FT
from quarry.operators import snapshot as S
from quarry.plans import duck as D
from quarry.plans import ingest as I
from quarry.plans.rules import _slug_sql
from quarry.sources import adapters as A
from quarry.tables import shared_dir

LONG = 400


def _procedures(spark, sf_dir):
    """Parts as procedures, and the names of the largest of one brand as forms."""
    part = A.table(spark, sf_dir, "part")
    listed = lambda *c: F.array(*map(F.col, c))
    procedures = part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("procedure_id"), F.col("p_name").alias("title"), F.col("p_type").alias("form_topic"), listed("p_type").alias("keywords"),
        listed("p_brand").alias("eligibility"), F.when(F.col("p_size") > 25, listed("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("required_documents"), listed("p_name").alias("steps"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("contact_office"),
    )
    forms = part.where("p_size >= 49 AND p_brand = 'Brand#1'").groupBy("p_name").agg(F.min("p_partkey").alias("ord"), F.min("p_type").alias("kind")).select(
        "ord", F.concat(F.lit("f"), F.col("ord").cast("string")).alias("form_id"), F.col("p_name").alias("title"), F.lit("mẫu").alias("category"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("Đơn "), F.col("p_name"))).alias("description"),
        F.array("p_name", "kind").alias("keywords"), F.array(F.struct(F.col("p_name").alias("label"), F.lit("ten").alias("name"), F.lit(None).cast("string").alias("type"))).alias("fields"),
    )
    return procedures, forms


def procedure_forms(spark, sf_dir):
    """Every procedure with the form that fits best, or none."""
    procedures, forms = _procedures(spark, sf_dir)
    return S.procedures_loaded(procedures, forms).select("procedure_id", "title", "related_form_id", "category")


def _source_documents(spark, sf_dir):
    """Documents of over 500 characters are published; their first line is the title."""
    rows = A.table(spark, sf_dir, "documents").where("n_chars > 500")
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("lang").alias("category"))


def _chunks(spark, sf_dir):
    """A page of layout lines is a chunk; its heading is its first section line, and only long ones have a summary."""
    line = F.col("line")
    heading = F.min_by("line", F.when(FT.is_section(line), F.col("position")))
    pages = I.layout_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("position", "line")))["line"], "\n").alias("content"), heading.alias("heading"))
    document = F.col("doc_id").cast("string")
    return pages.select(
        F.concat_ws("-", document, F.lit("chunk"), F.col("page").cast("string")).alias("chunk_id"), document.alias("document_id"), "heading", F.lit("").alias("section_title"), "content",
        F.when(F.length("content") > LONG, T.summary(F.col("content"))).alias("summary"), F.array(F.lit("page"), F.col("page").cast("string")).alias("keywords"), F.col("page").alias("page_from"), F.col("page").alias("page_to"),
    )


def branches(spark, sf_dir):
    documents = _source_documents(spark, sf_dir)
    fees = I.fee_tables(spark, sf_dir).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-table-"), F.lpad(F.col("table_order").cast("string"), 2, "0")).alias("table_id"), F.col("doc_id").cast("string").alias("document_id"),
        F.col("title").alias("table_title"), "row_id", "row_order", "label", "amount_text", "searched", F.split("tracks", ",").alias("tracks"), F.filter(F.split("basis", ","), lambda b: b != "").alias("basis"), "page_from", "page_to",
    )
    courses = I.loaded_courses(spark, sf_dir).withColumns({"category": F.lit("k"), "document_id": F.col("catalog_id")})
    faqs = A.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("faq_id"), F.substring("text", 1, 60).alias("question"), F.col("text").alias("answer"), F.lit("faq").alias("category"), F.array(F.lit("q")).alias("keywords"))
    procedures, forms = _procedures(spark, sf_dir)
    return {
        "chunk": S.chunk_entries(_chunks(spark, sf_dir), documents), "table_row": S.table_row_entries(fees, documents), "course": S.course_entries(courses), "course_summary": S.course_summaries(courses),
        "faq": S.faq_entries(faqs), "form": S.form_entries(forms), "procedure": S.procedure_entries(S.procedures_loaded(procedures, forms)),
    }


def knowledge_snapshot(spark, sf_dir):
    """Entries of all seven branches."""
    return S.union(branches(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", "|"))


def snapshot_counts(spark, sf_dir):
    """A whole run, published in the shared folder: what its writing jobs counted, by branch."""
    counted = S.run(spark, branches(spark, sf_dir), _source_documents(spark, sf_dir), f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")
    return spark.createDataFrame([(name, c["entries"], c["documents"]) for name, c in counted.items()], "branch string, entries long, documents long")


_FORMS = """part_names AS (SELECT p_name, min(p_partkey) AS ord, min(p_type) AS kind FROM part WHERE p_size >= 49 AND p_brand = 'Brand#1' GROUP BY 1
), forms AS (SELECT ord, 'f' || ord AS form_id, p_name AS title, 'mẫu' AS category, CASE WHEN ord % 2 = 0 THEN 'Đơn ' || p_name END AS description, [p_name, kind] AS keywords FROM part_names)"""
_PROCEDURES = f"""{_FORMS}, asked AS (SELECT *, 'p' || p_partkey AS procedure_id, {D.fold_d("p_type || ' ' || p_name")} AS n, {D.token_set("p_type || ' ' || p_name")} AS q_tokens FROM part
), known AS (SELECT *, {D.token_set("concat_ws(' ', title, category, description, array_to_string(keywords, ' '))")} AS c_tokens, {D.fold_d('title')} AS c_title, {D.fold_d('category')} AS c_category, {D.fold_d('description')} AS c_description,
    list_transform(keywords, lambda w: {D.fold_d('w')}) AS c_keywords FROM forms
), scored AS (SELECT procedure_id, form_id, known.category AS form_category, ord, 3 * len(list_intersect(q_tokens, c_tokens)) + CASE WHEN c_title <> '' AND contains(n, c_title) THEN 12 ELSE 0 END + CASE WHEN c_category <> '' AND contains(n, c_category) THEN 4 ELSE 0 END
    + CASE WHEN c_description <> '' AND contains(n, c_description) THEN 2 ELSE 0 END + coalesce(list_sum(list_transform(list_filter(c_keywords, lambda w: w <> '' AND contains(n, w)), lambda w: CASE WHEN contains(w, ' ') THEN 8 ELSE 2 END)), 0) AS points
  FROM asked, known
), best AS (SELECT * FROM scored WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY procedure_id ORDER BY points DESC, ord) = 1
), procedures AS (SELECT a.*, form_id AS related_form_id, coalesce(form_category, '{S.NO_CATEGORY}') AS category FROM asked a LEFT JOIN best USING (procedure_id))"""
_SECTION = f"regexp_matches(line, '{FT.HEADING}') AND length(trim(regexp_extract(line, '{FT.HEADING}', 1))) >= {FT.LEAST_HEADING} AND {D.any_of(_slug_sql(f'''trim(regexp_extract(line, '{FT.HEADING}', 1))'''), FT.HEADING_SLUGS)}"
_HOURS = " || '; ' || ".join(f"'{name}: ' || coalesce({c}, 0)" for name, c in (("LT", "lecture_hours"), ("TL/BT", "discussion_hours"), ("TKMH", "course_design_hours"), ("BTL", "project_hours"), ("TN", "lab_hours"), ("TH", "practice_hours"), ("THoc", "self_study_hours")))
_BRANCHES = f"""{I._LINES_SQL}, docs AS (SELECT doc_id, doc_id::VARCHAR AS document_id, string_split(text, chr(10))[1] AS title, lang AS category FROM documents WHERE n_chars > 500
), pages AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY position) AS content, arg_min(line, position) FILTER (WHERE {_SECTION}) AS heading FROM lines GROUP BY ALL
), fees AS ({I._FEE_SQL}), courses AS (SELECT *, regexp_extract(course_record_id, '^(.*)-row-', 1) AS catalog_id, 'k' AS category FROM ({I._COURSE_SQL})
), summaries AS (SELECT catalog_id, program_track, semester_label, count(*) AS n, sum(credits) AS credits, min(program_name) AS program_name,
    array_to_string(list_slice(list(course_code || ' - ' || course_name ORDER BY semester_number NULLS LAST, course_order NULLS LAST, course_record_id), 1, {S.LISTED}), '; ') AS said FROM courses GROUP BY ALL
), faqs AS (SELECT 'b' || item_id AS faq_id, substr(text, 1, 60) AS question, text AS answer FROM benchmark), {_PROCEDURES}, entries AS (
  SELECT doc_id || '-chunk-' || page AS external_id, document_id, title, category, 'chunk' AS source_kind, CASE WHEN length(content) > {LONG} THEN {D.summary('content')} ELSE content END AS summary, content, 'page|' || page AS keywords, heading AS section_title,
    page::INTEGER AS page_from, page::INTEGER AS page_to FROM pages JOIN docs USING (doc_id)
  UNION ALL SELECT f.doc_id || '-table-' || lpad(table_order::VARCHAR, 2, '0') || '-' || row_id || '-' || lpad(row_order::VARCHAR, 2, '0'), document_id, d.title, category, 'table_row', f.title || ' - ' || label, searched,
    category || '|' || d.title || '|' || f.title || '|' || label || '|' || replace(tracks, ',', '|') || CASE WHEN basis <> '' THEN '|' || replace(basis, ',', '|') ELSE '' END, f.title, page_from::INTEGER, page_to::INTEGER FROM fees f JOIN docs d USING (doc_id)
  UNION ALL SELECT course_record_id, catalog_id, course_name, category, 'course_record',
    concat_ws(' - ', course_name, 'Ma mon ' || course_code, credits || ' tin chi', semester_label, program_track, 'Tien quyet ' || prerequisite_text, 'Ngon ngu ' || teaching_language),
    concat_ws(chr(10), 'Hoc phan: ' || course_name, 'Ma hoc phan: ' || course_code, 'Chuong trinh: ' || program_track, 'Hoc ky: ' || semester_label, 'So tin chi: ' || credits, {_HOURS}, 'Hoc phan tien quyet: ' || coalesce(prerequisite_text, '{S.NOTHING}'),
      'Ngon ngu giang day: ' || coalesce(teaching_language, '{S.UNCLEAR}')),
    concat_ws('|', category, program_name, program_track, semester_label, course_code, course_name, nullif(aliases, ''), coalesce(teaching_language, '')), semester_label, NULL, NULL FROM courses
  UNION ALL SELECT catalog_id || '-' || program_track || '-' || {_slug_sql('semester_label')} || '-summary', catalog_id, name, 'k', 'course_summary', semester_label || ' (' || program_track || ') co ' || n || ' hoc phan, tong ' || credits || ' tin chi.',
    'Chuong trinh ' || name || '.' || chr(10) || 'So hoc phan: ' || n || '. Tong tin chi: ' || credits || '.' || chr(10) || 'Danh sach mon hoc: ' || said, 'k|' || program_name || '|' || program_track || '|' || semester_label || '|danh sach mon hoc|tong tin chi', semester_label, NULL, NULL
    FROM (SELECT *, program_name || ' - ' || program_track || ' - ' || semester_label AS name FROM summaries)
  UNION ALL SELECT faq_id || '-entry', faq_id, question, 'faq', 'faq', question, 'Cau hoi: ' || question || chr(10) || chr(10) || 'Tra loi: ' || answer, 'q', NULL, NULL, NULL FROM faqs
  UNION ALL SELECT form_id || '-entry', form_id, title, category, 'form_template', coalesce(description, title), 'Bieu mau: ' || title || chr(10) || chr(10) || 'Mo ta: ' || coalesce(description, '') || chr(10) || chr(10) || 'Cac truong: ' || title || ' (ten, text)',
    array_to_string(keywords, '|'), NULL, NULL, NULL FROM forms
  UNION ALL SELECT procedure_id || '-entry', procedure_id, p_name, category, 'procedure', p_name, concat_ws(chr(10) || chr(10), 'Thu tuc: ' || p_name, 'Dieu kien: ' || p_brand, 'Ho so: ' || CASE WHEN p_size > 25 THEN p_type || '; ' || p_brand ELSE '{S.NOTHING}' END,
    'Cac buoc: ' || p_name, 'Don vi lien he: ' || CASE WHEN p_size > 10 THEN p_brand ELSE '{S.UNCLEAR}' END), p_type, NULL, NULL, NULL FROM procedures)"""
_COUNTS_SQL = f"""WITH {_BRANCHES}, named AS (SELECT CASE source_kind WHEN 'course_record' THEN 'course' WHEN 'form_template' THEN 'form' ELSE source_kind END AS branch, count(*) AS entries FROM entries GROUP BY 1)
SELECT b.branch, coalesce(entries, 0) AS entries, CASE WHEN b.branch IN ({D.words(S.OWN_DOCUMENT)}) THEN coalesce(entries, 0) ELSE 0 END AS documents
FROM (SELECT unnest(['chunk', 'table_row', 'course', 'course_summary', 'faq', 'form', 'procedure']) AS branch) b LEFT JOIN named USING (branch)
UNION ALL SELECT 'source', 0, count(*) FROM docs"""

QUERIES = {f.__name__: f for f in (procedure_forms, knowledge_snapshot, snapshot_counts)}
ORACLES = {
    "procedure_forms": f"WITH {_PROCEDURES} SELECT procedure_id, p_name AS title, related_form_id, category FROM procedures",
    "knowledge_snapshot": f"WITH {_BRANCHES} SELECT * FROM entries",
    "snapshot_counts": _COUNTS_SQL,
}


def conversation_tree(spark, sf_dir):
    """Conversations, messages and their calls: an event is a call of the message whose turn is its day of the month, in the conversation with its user's number."""
    messages = A.messages(spark, sf_dir)
    calls = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("conversation_id"), F.dayofmonth("ts").cast("long").alias("seq"), F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"))
    told = E.nested(messages.select("conversation_id").distinct(), messages, calls, most=2)
    said = lambda m: F.concat(m["seq"].cast("string"), F.lit(":"), m["role"], F.lit("["), F.array_join(F.transform(m["calls"], lambda c: F.concat_ws(" ", c["id"].cast("string"), c["tool_name"])), ","), F.lit("]"))
    return told.select("conversation_id", "part", F.array_join(F.transform("messages", said), ";").alias("tree"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit("")))).alias("chars"))


def embedding_backfill(spark, sf_dir):
    """Documents get the vectors with their numbers: a run that stops after three of eight slices, then French texts change, then a run that ends."""
    vectors = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    step = lambda todo: todo.join(vectors, "id").select("id", "checksum", "vector")
    before = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"), "lang")
    after = before.withColumn("payload", F.when(F.col("lang") == "fr", F.concat(F.lit("Noi dung: "), "payload")).otherwise(F.col("payload")))
    root, at = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", F.pmod("id", F.lit(8))
    B.backfill(before.drop("lang"), step, root, run=1, slices=8, slice_of=at, stop_after=3)
    return B.backfill(after.drop("lang"), step, root, run=2, slices=8, slice_of=at).select("id", "checksum", "run", F.size("vector").alias("dims"))


def cascade_delete(spark, sf_dir):
    """What stays of customers, orders and lines when the customers of one segment go: keys by table."""
    customer, orders, lines = (A.table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    gone = customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    left = E.cascade(customer, gone, "c_custkey", orders=(orders, "o_orderkey", "o_custkey"), lines=(lines, "l_linenumber", "l_orderkey"))
    count = lambda name, key: left[name].groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "key", "n")
    return count("parents", "c_custkey").unionByName(count("orders", "o_orderkey")).unionByName(count("lines", "l_orderkey"))


def feedback_guarded(spark, sf_dir):
    """Feedback of users on turns of the conversation with their number: clicks and views first, then purchases; only assistant turns of one's own conversation count."""
    turns = A.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("owner_id"), "role").distinct()
    events = A.table(spark, sf_dir, "events")
    message = (F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")) * 100 + F.hour("ts") % 4).alias("message_id")
    rows = events.select(message, "user_id", (F.col("value") > 50).alias("helpful"), F.col("event_id").alias("at"), "event_type")
    first = E.rated(rows.where("FALSE").drop("event_type"), rows.where("event_type IN ('click', 'view')").drop("event_type"), turns)
    return E.rated(first, rows.where("event_type = 'purchase'").drop("event_type"), turns)


_TREE_SQL = """WITH c AS (SELECT user_id AS conv_id, day(ts) AS turn, string_agg(event_id || ' ' || event_type, ',' ORDER BY event_id, event_type) AS calls FROM events GROUP BY ALL)
SELECT conv_id AS conversation_id, turn // 2 AS part, string_agg(turn || ':' || role || '[' || coalesce(calls, '') || ']', ';' ORDER BY turn, role) AS tree, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations LEFT JOIN c USING (conv_id, turn) GROUP BY ALL"""
_BACKFILL_SQL = """SELECT doc_id AS id, sha256(CASE WHEN lang = 'fr' THEN 'Noi dung: ' ELSE '' END || text) AS checksum, CASE WHEN doc_id % 8 < 3 AND lang <> 'fr' THEN 1 ELSE 2 END AS run, len(embedding)::INTEGER AS dims FROM documents JOIN embeddings ON vec_id = doc_id"""
_CASCADE_SQL = """WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT o_orderkey FROM orders SEMI JOIN c ON c_custkey = o_custkey), l AS (SELECT l_orderkey FROM lineitem SEMI JOIN o ON o_orderkey = l_orderkey)
SELECT 'parents' AS level, c_custkey AS key, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'orders', o_orderkey, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'lines', l_orderkey, count(*) FROM l GROUP BY ALL"""
_FEEDBACK_SQL = """WITH t AS (SELECT DISTINCT conv_id * 100 + turn AS message_id, conv_id AS owner_id, role FROM conversations WHERE role = 'assistant'),
e AS (SELECT (CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE user_id END) * 100 + hour(ts) % 4 AS message_id, user_id, value > 50 AS helpful, event_id AS "at" FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT e.* FROM e JOIN t ON t.message_id = e.message_id AND t.owner_id = e.user_id QUALIFY row_number() OVER (PARTITION BY e.message_id, user_id ORDER BY "at" DESC) = 1"""
QUERIES |= {f.__name__: f for f in (conversation_tree, embedding_backfill, cascade_delete, feedback_guarded)}
ORACLES |= {"conversation_tree": _TREE_SQL, "embedding_backfill": _BACKFILL_SQL, "cascade_delete": _CASCADE_SQL, "feedback_guarded": _FEEDBACK_SQL}
