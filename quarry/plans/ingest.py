"""Ingest of tables and catalogues as queries over the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import rules as U
from quarry.operators import catalogue as K
from quarry.operators import courses as C
from quarry.operators import fee_tables as FT
from quarry.plans import duck as D
from quarry.plans.rules import _repaired_sql, _slug_sql
from quarry.sources import adapters as A
from quarry.sources import knowledge_files as KF
from quarry.tables import shared_dir

PAGE = 5


def layout_lines(spark, sf_dir):
    """Lines of all documents, ``PAGE`` to a page; by document and place they get what headings, rows, units and notes of fee tables start or end with."""
    split = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "raw"))
    line = F.trim(F.regexp_replace("raw", r"\s+", " "))
    turn, at = F.pmod(F.col("doc_id") + F.col("position"), F.lit(9)), F.col("position").cast("string")
    thousands = F.lpad((F.col("position") * 37 % 1000).cast("string"), 3, "0")
    made = (
        F.when((turn == 0) & (F.col("doc_id") % 4 != 0), F.concat(F.lit("II. Muc thu hoc phi "), line)).when(turn == 1, F.concat(F.lit("Khoa, khoi nganh "), line))
        .when((turn == 2) | (turn == 3), F.concat(at, F.lit(".1 "), line, F.lit(" 1."), thousands, F.lit(".000 d6ng"))).when((turn == 4) | (turn == 8), line)
        .when(turn == 5, F.concat(at, F.lit("  - he cao hoc 250.000 ddng/1 "), line)).when((turn == 6) & (F.col("doc_id") % 2 == 0), F.lit("Tin chi"))
        .when((turn == 7) & (F.col("doc_id") % 5 == 0), F.concat(F.lit("Ghi chu "), line)).otherwise(line)
    )
    return split.where(line != "").select("doc_id", F.floor(F.col("position") / PAGE).alias("page"), "position", made.alias("line"))


def fee_tables(spark, sf_dir):
    return FT.fee_table_rows(layout_lines(spark, sf_dir)).withColumns({c: F.col(c).cast("bigint") for c in ("table_order", "row_order")})


_AMOUNT_SQL = "trim(regexp_replace(replace(replace(replace(replace(trim({x}), 'd6ng', 'dong'), 'ddng', 'dong'), 'đ6ng', 'dong'), 'đồng', 'dong'), '\\s+', ' ', 'g'))"


def _tidy_sql(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' -')"


_LINES_SQL = f"""raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS position FROM documents
), tidy AS (SELECT doc_id, position, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line, (doc_id + position) % 9 AS turn FROM raw
), lines AS (SELECT doc_id, position // {PAGE} AS page, position, CASE
  WHEN turn = 0 AND doc_id % 4 <> 0 THEN 'II. Muc thu hoc phi ' || line WHEN turn = 1 THEN 'Khoa, khoi nganh ' || line
  WHEN turn IN (2, 3) THEN position || '.1 ' || line || ' 1.' || lpad((position * 37 % 1000)::VARCHAR, 3, '0') || '.000 d6ng' WHEN turn IN (4, 8) THEN line
  WHEN turn = 5 THEN position || '  - he cao hoc 250.000 ddng/1 ' || line WHEN turn = 6 AND doc_id % 2 = 0 THEN 'Tin chi' WHEN turn = 7 AND doc_id % 5 = 0 THEN 'Ghi chu ' || line ELSE line END AS line
  FROM tidy WHERE line <> '')"""
_HEADER_SQL = f"(slug IN ({D.words(FT.HEADER_SLUGS)}) OR {D.any_of('slug', FT.HEADER_PARTS)})"
_FEE_SQL = f"""WITH {_LINES_SQL}, slugs AS (SELECT *, {_slug_sql('line')} AS slug, trim(regexp_extract(line, '{FT.HEADING}', 1)) AS named, regexp_replace(line, '{FT.ROW_START}', '') AS body FROM lines
), marks AS (SELECT *, CASE WHEN regexp_matches(line, '{FT.HEADING}') AND length(named) >= {FT.LEAST_HEADING} AND {D.any_of(_slug_sql('named'), FT.HEADING_SLUGS)} THEN 'heading' WHEN regexp_matches(line, '{FT.NOTE}') THEN 'note' END AS mark,
  {_HEADER_SQL} AS header, list_filter(string_split(slug, '-'), lambda t: regexp_full_match(t, '[a-z]+')) AS words FROM slugs
), running AS (SELECT *, count(*) FILTER (WHERE mark = 'heading') OVER w AS table_no, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING)
), parsed AS (SELECT *, CASE WHEN mark IS NULL AND NOT header THEN CASE
    WHEN regexp_matches(line, '{FT.ROW}') THEN {{'id': regexp_extract(line, '{FT.ROW}', 1), 'label': {_tidy_sql(f"regexp_extract(line, '{FT.ROW}', 2)")}, 'amount': regexp_extract(line, '{FT.ROW}', 3)}}
    WHEN regexp_matches(line, '{FT.ROW_START}') AND length(regexp_replace(regexp_extract(body, '{FT.ROW_INSIDE}', 2), '\\D', '', 'g')) >= {FT.LEAST_DIGITS} THEN {{'id': regexp_extract(line, '{FT.ROW_START}', 1),
      'label': trim({_tidy_sql(f"regexp_extract(body, '{FT.ROW_INSIDE}', 1)")} || ' ' || {_tidy_sql(f"regexp_extract(body, '{FT.ROW_INSIDE}', 3)")}), 'amount': regexp_extract(body, '{FT.ROW_INSIDE}', 2)}} END END AS entry
  FROM running WHERE mark = 'heading' OR before = 'heading'
), numbered AS (SELECT *, count(entry) OVER (PARTITION BY doc_id, table_no ORDER BY position ROWS UNBOUNDED PRECEDING) AS row_no FROM parsed
), kinds AS (SELECT *, CASE WHEN mark IS NOT NULL THEN mark WHEN header THEN 'none' WHEN entry IS NOT NULL THEN 'row'
    WHEN row_no = 0 THEN CASE WHEN NOT regexp_matches(line, '{FT.ROW_START}') AND len(words) >= 2 AND length(array_to_string(words, '')) >= 6 AND NOT {D.any_of('slug', FT.TITLE_STOPS)} THEN 'title' ELSE 'none' END
    WHEN regexp_matches(line, '{FT.UNIT}') THEN 'unit' ELSE 'more' END AS kind FROM numbered
), tables AS (SELECT doc_id, table_no, {_repaired_sql("string_agg(line, ' ' ORDER BY position) FILTER (WHERE kind IN ('heading', 'title'))")} AS title, min(page) AS table_from, max(page) AS table_to FROM kinds GROUP BY ALL
), grouped AS (SELECT doc_id, table_no, row_no, max(entry.id) AS row_id, string_agg(coalesce(entry.label, line), ' ' ORDER BY position) FILTER (WHERE kind IN ('row', 'more')) AS said,
    string_agg(coalesce({_AMOUNT_SQL.format(x='entry.amount')}, line), ' ' ORDER BY position) FILTER (WHERE kind IN ('row', 'unit')) AS amount, min(page) AS page_from, max(page) AS page_to
  FROM kinds WHERE row_no > 0 AND kind IN ('row', 'unit', 'more') GROUP BY ALL
), clean AS (SELECT *, {_repaired_sql("trim(regexp_replace(said, '\\s+', ' ', 'g'), ' /-')")} AS label, {_AMOUNT_SQL.format(x='amount')} AS amount_text FROM grouped
), joined AS (SELECT *, regexp_extract(amount_text, '\\d[\\d.]*') AS number FROM clean JOIN tables USING (doc_id, table_no) WHERE label <> '' AND amount_text <> ''
), valued AS (SELECT *, replace(number, '.', '')::BIGINT AS amount_value, {_slug_sql("title || ' ' || label || ' ' || amount_text")} AS slug FROM joined
), tagged AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {D.any_of('slug', w)} THEN '{t}' END" for t, w in U.TRACK_SLUGS)}], lambda x: x IS NOT NULL) AS named,
  {D.any_of('slug', U.CREDIT_SLUGS)} OR (contains(slug, 'cao-hoc') AND {D.any_of('slug', ('1-1', '1-2', '1-3'))}) AS credit FROM valued
), tags AS (SELECT *, CASE WHEN len(named) > 0 THEN named ELSE ['chinh_quy'] END AS tracks, CASE WHEN credit THEN ['per_credit'] WHEN contains(slug, 'cao-hoc') OR amount_value >= {U.FULL_PROGRAM_FROM} THEN ['full_program'] ELSE [] END AS basis FROM tagged
), worded AS (SELECT *, array_to_string(list_transform(list_concat(tracks, basis), lambda x: CASE x {" ".join(f"WHEN '{t}' THEN '{w}'" for t, w in U.TAG_WORDS)} END), ' ') AS words FROM tags)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY table_no) AS table_order, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY row_no) AS row_order, title, table_from, table_to, row_id, label,
  amount_text, amount_value, array_to_string(tracks, ',') AS tracks, array_to_string(basis, ',') AS basis, {_repaired_sql("title || ' ' || label || ' ' || amount_text || ' hoc phi ' || words")} AS searched, page_from, page_to FROM worded"""

def _delivery(spark, sf_dir, text, wanted):
    """Documents as files of a delivery."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    status = F.when(F.col("n_chars") > 500, "published")
    return A.table(spark, sf_dir, "documents").where(wanted).select(
        path.alias("relative_path"), F.lit("").alias("title"), F.col("lang").alias("category"), status.alias("status"), F.lit(None).cast("string").alias("notes"), F.sha2(text, 256).alias("checksum"),
        F.octet_length(text).cast("long").alias("size_bytes"),
    )


def catalogue_sync(spark, sf_dir):
    """Versions and files after two deliveries of all documents: the first without French and with texts on one line, the second without one source."""
    first = K.synced(K.empty(spark), _delivery(spark, sf_dir, F.regexp_replace("text", "\n", " "), F.col("lang") != "fr"))
    second = K.synced(first, _delivery(spark, sf_dir, F.col("text"), F.col("source") != "src3"))
    joined = second["versions"].join(second["files"], ["source_id", "version"]).join(second["sources"], "source_id").join(K.changes(first, second), "source_id")
    return joined.select("source_id", "version", "checksum", "status", "is_active", "file_name", "mime_type", "size_bytes", "title", "current_status", "action")


_SYNC_SQL = """WITH d AS (SELECT *, 'src-' || source || '-' || lang || '-' || doc_id || '-txt' AS source_id, doc_id || '.txt' AS file_name, CASE WHEN n_chars > 500 THEN 'published' ELSE 'draft' END AS status FROM documents
), f AS (SELECT source_id, sha256(t) AS checksum, strlen(t) AS size_bytes FROM (SELECT source_id, replace(text, chr(10), ' ') AS t FROM d WHERE lang <> 'fr')
), s AS (SELECT d.*, sha256(text) AS now, strlen(text) AS now_size, f.checksum AS was, f.size_bytes AS was_size FROM d LEFT JOIN f USING (source_id) WHERE source <> 'src3'
), v AS (
  SELECT *, CASE WHEN was <> now THEN 2 ELSE 1 END AS version, now AS checksum, TRUE AS is_active, now_size AS size_bytes FROM s
  UNION ALL SELECT *, 1, was, FALSE, was_size FROM s WHERE was <> now)
SELECT source_id, version, checksum, status, is_active, file_name, 'text/plain' AS mime_type, size_bytes, doc_id::VARCHAR AS title, status AS current_status,
  CASE WHEN was IS NULL THEN 'added' WHEN was = now THEN 'same' ELSE 'changed' END AS action FROM v"""


def _records(spark, sf_dir):
    """Records of four kinds as lines of JSON: documents, those under 60 characters as bare text, passages as FAQs, parts as forms, orders as tables."""
    line = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    doc = line(id=F.concat(F.lit("d"), F.col("doc_id").cast("string")), title=F.col("source"), category=F.col("lang"), content=F.col("text"), keywords=F.array("lang", "source"))
    bare = F.concat(F.lit("text "), F.regexp_replace("text", "\\n", " "))
    faq = line(id=F.concat(F.lit("b"), F.col("item_id").cast("string")), question=F.substring("text", 1, 60), answer=F.col("text"))
    field = F.array(F.struct(F.col("p_brand").alias("label"), F.lit("brand").alias("name"), F.lit("text").alias("type")), F.struct(F.col("p_type").alias("label"), F.lit("size").alias("name"), F.lit("number").alias("type")))
    form = line(id=F.concat(F.lit("p"), F.col("p_partkey").cast("string")), title=F.col("p_name"), description=F.col("p_type"), fields=field)
    row = F.struct(
        F.col("l_linenumber").alias("row_id"), F.concat("l_returnflag", "l_linestatus").alias("label"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" dong")).alias("amount_text"),
        F.col("l_quantity").cast("int").alias("amount_value"), F.array(F.col("l_linestatus")).alias("track_tags"),
    )
    rows = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("rows"))
    orders = A.table(spark, sf_dir, "orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    fees = F.array(F.struct(F.col("o_orderkey").alias("table_id"), F.col("o_orderpriority").alias("title"), F.lit(1).alias("page_from"), F.col("rows")))
    table = line(document_id=F.col("o_custkey").cast("string"), title=F.lit("Orders"), category=F.col("o_orderstatus"), tables=fees)
    return {
        "documents": A.table(spark, sf_dir, "documents").select(F.when(F.length("text") < 60, bare).otherwise(doc).alias("value")), "faqs": A.table(spark, sf_dir, "benchmark").select(faq.alias("value")),
        "forms": A.table(spark, sf_dir, "part").select(form.alias("value")), "tables": orders.select(table.alias("value")),
    }


def knowledge_corpus(spark, sf_dir):
    """The tables written as files of records and read back as one corpus; what isn't JSON comes back as rows with an error."""
    root, folders = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", {}
    for kind, lines in _records(spark, sf_dir).items():
        folders[kind] = f"{root}/{kind}"
        lines.write.text(folders[kind])
    rows = KF.knowledge_files(spark, **folders)
    return rows.select("id", "kind", "source_kind", "title", "category", "summary", "content", F.array_join("keywords", "|").alias("keywords"), "source_document_id", "page_from", F.col("error").isNotNull().alias("broken"))


_CORPUS_SQL = """SELECT CASE WHEN length(text) >= 60 THEN 'd' || doc_id END AS id, 'documents' AS kind, CASE WHEN length(text) >= 60 THEN 'document' END AS source_kind, CASE WHEN length(text) >= 60 THEN source END AS title,
  CASE WHEN length(text) >= 60 THEN lang END AS category, CASE WHEN length(text) >= 60 THEN '' END AS summary, CASE WHEN length(text) >= 60 THEN text ELSE 'text ' || replace(text, chr(10), ' ') END AS content,
  CASE WHEN length(text) >= 60 THEN lang || '|' || source END AS keywords, NULL AS source_document_id, NULL::INTEGER AS page_from, length(text) < 60 AS broken FROM documents
UNION ALL SELECT 'b' || item_id, 'faqs', 'faq', '', '', substr(text, 1, 60), 'Cau hoi: ' || substr(text, 1, 60) || chr(10) || chr(10) || 'Tra loi: ' || text, '', NULL, NULL, FALSE FROM benchmark
UNION ALL SELECT 'p' || p_partkey, 'forms', 'form_template', p_name, '', p_type, 'Bieu mau: ' || p_name || chr(10) || chr(10) || 'Mo ta: ' || p_type || chr(10) || chr(10) || 'Cac truong: ' || p_brand || ' (brand, text), ' || p_type || ' (size, number)', '', NULL, NULL, FALSE FROM part
UNION ALL SELECT o_orderkey || '-' || l_linenumber, 'tables', 'table_row', 'Orders', o_orderstatus, said, said, o_orderstatus || '|Orders|' || o_orderpriority || '|' || l_returnflag || l_linestatus || '|' || q || ' dong|' || l_linestatus, o_custkey::VARCHAR, 1, FALSE
  FROM (SELECT *, l_quantity::INTEGER AS q, o_orderpriority || '. ' || l_returnflag || l_linestatus || '. Muc hoc phi: ' || l_quantity::INTEGER || ' dong (' || l_quantity::INTEGER || ' dong).' AS said FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


#: Three header layouts of course sheets; one without credits.
HEADERS = (
    ("TT", "Tên học phần", "Mã học phần", "Số TC", "LT", "TH", "Học kỳ", "Chương trình", "NNGD", "HP tiên quyết"),
    ("Mã học phần", "Số TC", "Tên  học phần", "Chương trình", "TL/BT", "TKMH", "Ghi chú", "LT"),
    ("Số-TC", "Học kỳ", "MÃ HỌC PHẦN", "ten hoc phan", "NNGD", "THoc", "BTL", ""),
)


def course_sheets(spark, sf_dir):
    """Parts as courses: a workbook for each brand, laid out in one of three ways, some without credits; every workbook has two more sheets."""
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    rows = A.table(spark, sf_dir, "part").withColumn("brand", brand).withColumn("layout", brand % 3)
    path = F.concat(F.when(F.col("layout") == 2, F.lit("ctdt/Danh sach mon hoc ")).otherwise(F.lit("ctdt/Khung ")), F.col("brand").cast("string"), F.lit(".xlsx"))
    sheet = F.when(F.col("layout") == 2, F.lit("Sheet1")).otherwise(F.lit("Dữ liệu"))
    text = lambda c: F.col(c).cast("string")
    name = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" ai so tuyen tinh"))).otherwise(F.col("p_name"))
    code, credits = F.when(F.col("p_size") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("IT"), text("p_partkey"))), F.when(F.col("p_size") % 7 == 0, F.lit("x")).otherwise(F.concat(text("p_size"), F.lit(" tc")))
    track, language = F.when(F.col("p_type") == "ECONOMY", "Kỹ sư").when(F.col("p_type") == "SMALL", "Cử-nhân").otherwise(""), F.when(F.col("p_size") % 2 == 0, "Tiếng Anh").otherwise("Khác")
    semester = F.concat(F.lit("Học kỳ "), (F.col("p_size") % 8).cast("string"))
    layouts = (
        F.array(text("p_partkey"), name, code, credits, F.lit("30"), F.lit("-"), semester, track, language, F.lit("IT1")), F.array(code, credits, name, track, F.lit("15"), F.lit("8 h"), F.lit("n")),
        F.array(credits, semester, code, name, language, F.lit("5"), F.lit("")),
    )
    place = (F.row_number().over(W.partitionBy("brand").orderBy("p_partkey")) + 1).alias("row_number")
    cells = F.when(F.col("layout") == 0, layouts[0]).when(F.col("layout") == 1, layouts[1]).otherwise(layouts[2])
    courses = rows.select("brand", path.alias("path"), sheet.alias("sheet"), F.lit(2).alias("sheet_no"), place, cells.alias("cells"))
    books = rows.select("brand", "layout", path.alias("path"), sheet.alias("sheet")).distinct()
    header = F.transform(F.get(F.array(*[F.array(*map(F.lit, h)) for h in HEADERS]), F.col("layout")), lambda h: F.when((F.col("brand") % 5 == 0) & h.startswith("Số"), F.lit("Tín")).otherwise(h))
    heads = books.select("brand", "path", "sheet", F.lit(2).alias("sheet_no"), F.lit(1).alias("row_number"), header.alias("cells"))
    more = [books.where("layout <> 2").select("brand", "path", F.lit(n).alias("sheet"), F.lit(i).alias("sheet_no"), F.lit(1).alias("row_number"), F.array(F.lit("Mục"), F.lit(n)).alias("cells")) for n, i in (("Tổng quan", 1), ("Ghi chú", 3))]
    return courses.unionByName(heads).unionByName(more[0]).unionByName(more[1])


def loaded_courses(spark, sf_dir):
    rows = course_sheets(spark, sf_dir)
    metadata = rows.select("path", "brand").distinct().select(
        "path", F.when(F.col("brand") % 4 != 0, F.concat(F.lit("Khung "), F.col("brand").cast("string"))).alias("title"), F.lit("k").alias("category"), F.lit("2024").alias("version"), F.lit("published").alias("status"),
        F.lit(None).cast("string").alias("canonical_sheet"),
    )
    return C.courses(rows.drop("brand"), metadata)


def course_catalogues(spark, sf_dir):
    return loaded_courses(spark, sf_dir).drop("catalog_id")


_NAME = "trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g'))"
_COURSE_SQL = f"""WITH p AS (SELECT *, regexp_extract(p_brand, '\\d+')::INTEGER AS brand, regexp_extract(p_brand, '\\d+')::INTEGER % 3 AS layout, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS row_number,
    CASE WHEN p_size % 3 = 0 THEN p_name || ' ai so tuyen tinh' ELSE p_name END AS name, 'IT' || p_partkey AS code, p_size AS credits,
    CASE p_type WHEN 'ECONOMY' THEN 'Kỹ sư' WHEN 'SMALL' THEN 'Cử-nhân' ELSE '' END AS track, CASE WHEN p_size % 2 = 0 THEN 'Tiếng Anh' ELSE 'Khác' END AS language, 'Học kỳ ' || p_size % 8 AS semester FROM part
), q AS (SELECT *, CASE WHEN layout = 2 THEN 'Danh sach mon hoc ' ELSE 'Khung ' END || brand AS stem, CASE WHEN layout <> 2 AND p_type = 'ECONOMY' THEN 'ky_su' WHEN layout <> 2 AND p_type = 'SMALL' THEN 'cu_nhan' ELSE 'khac' END AS program,
    replace({_NAME}, 'ai so tuyen tinh', 'dai so tuyen tinh') AS normal, CASE WHEN layout = 1 THEN 'Khong ro hoc ky' ELSE semester END AS label FROM p WHERE p_size % 10 <> 0 AND p_size % 7 <> 0 AND brand % 5 <> 0)
SELECT 'catalog-ctdt-' || replace(lower(stem), ' ', '-') || '-xlsx-row-' || lpad(row_number::VARCHAR, 4, '0') AS course_record_id, CASE WHEN brand % 4 <> 0 THEN 'Khung ' || brand ELSE stem END AS program_name,
  CASE WHEN layout = 2 THEN 'Sheet1' ELSE 'Dữ liệu' END AS sheet, CASE WHEN layout <> 2 THEN 'Tổng quan' END AS summary, CASE WHEN layout <> 2 THEN 'Ghi chú' END AS glossary, 'published' AS status, program AS program_track,
  nullif(program, 'khac') AS degree_level, CASE WHEN layout <> 1 THEN p_size % 8 END AS semester_number, label AS semester_label, CASE WHEN layout = 0 THEN p_partkey::INTEGER END AS course_order, name AS course_name,
  normal AS normalized_course_name, CASE WHEN p_size % 3 = 0 THEN 'dai so tuyen tinh' ELSE '' END AS aliases, code AS course_code, credits, CASE WHEN layout = 0 THEN 30 END AS lecture_hours,
  CASE WHEN layout = 1 THEN 15 END AS discussion_hours, CASE WHEN layout = 1 THEN 8 END AS course_design_hours, NULL::INTEGER AS project_hours, NULL::INTEGER AS lab_hours, NULL::INTEGER AS practice_hours,
  CASE WHEN layout = 2 THEN 5 END AS self_study_hours, CASE WHEN layout = 0 THEN 'IT1' END AS prerequisite_text, CASE WHEN layout <> 1 THEN CASE WHEN p_size % 2 = 0 THEN 'anh' ELSE 'khac' END END AS teaching_language,
  concat_ws(' ', CASE WHEN layout <> 2 THEN nullif(track, '') END, label, name, normal, code, credits, CASE WHEN layout <> 1 THEN language END, CASE WHEN layout = 0 THEN 'IT1' END) AS search_text FROM q"""


QUERIES = {f.__name__: f for f in (fee_tables, catalogue_sync, knowledge_corpus, course_catalogues)}
ORACLES = {"fee_tables": _FEE_SQL, "catalogue_sync": _SYNC_SQL, "knowledge_corpus": _CORPUS_SQL, "course_catalogues": _COURSE_SQL}
