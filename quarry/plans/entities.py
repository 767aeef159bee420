"""Joins, layers, pages, sets, text functions and ingest as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import entities as E
from quarry.operators import ingest as I
from quarry.plans import duck as D
from quarry.sources import adapters as A


def conversation_page(spark, sf_dir):
    """Second page of conversations, the last changed first."""
    rows = A.messages(spark, sf_dir).groupBy("conversation_id").agg(F.max("seq").alias("updated"))
    return E.page(rows, F.desc_nulls_first("updated"), "conversation_id", skip=20, limit=20)


def message_page(spark, sf_dir):
    return E.page(A.messages(spark, sf_dir), "conversation_id", "seq", skip=100, limit=100)


def page_with_total(spark, sf_dir):
    return E.page_with_total(E.filtered(A.table(spark, sf_dir, "customer"), c_mktsegment="BUILDING"), "c_custkey", skip=10, limit=25).select("c_custkey", "c_name", "total")


def sorted_nulls(spark, sf_dir):
    rows = A.table(spark, sf_dir, "supplier").withColumn("score", F.when(F.col("s_suppkey") % 4 != 0, F.round("s_acctbal", 0)))
    return E.page(rows, F.asc_nulls_last("score"), "s_suppkey", limit=60).select("s_suppkey", "score")


def active_versions(spark, sf_dir):
    """Each customer's latest order as its active version, with the order's lines as files."""
    orders = A.table(spark, sf_dir, "orders")
    active = E.first_of(orders, ["o_custkey"], "o_orderdate", "o_orderkey", last=True)
    files = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"))
    joined = A.table(spark, sf_dir, "customer").join(active, F.col("c_custkey") == F.col("o_custkey")).join(files, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select("c_custkey", "o_orderkey", F.coalesce("files", F.lit(0)).cast("bigint").alias("files"))


def published_snapshot(spark, sf_dir):
    """Lines of published (status F) active orders."""
    active = E.first_of(A.table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", last=True).where("o_orderstatus = 'F'")
    return A.table(spark, sf_dir, "lineitem").join(active, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", "l_quantity")


def table_row_entries(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(I.table_entry_id(F.col("o_custkey"), F.col("o_orderkey"), F.col("l_linenumber")).alias("entry_id"), F.col("l_extendedprice").alias("amount"))


def chunk_entries(spark, sf_dir):
    """Entries of documents that have a label, with the label's quality; others have no source and go."""
    return A.corpus(spark, sf_dir).join(A.table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id")).select("id", "category", "summary", "quality")


def snapshot_union(spark, sf_dir):
    """Entries of three kinds in one table; what a kind lacks is null."""
    a = A.corpus(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.lit("document").alias("kind"), "category")
    b = A.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.lit("chunk").alias("kind"), F.length("text").cast("bigint").alias("size"))
    c = A.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("table_row").alias("kind"), F.col("p_brand").alias("category"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def anti_missing_sources(spark, sf_dir):
    return E.without(A.table(spark, sf_dir, "customer"), A.table(spark, sf_dir, "orders").where("o_orderdate >= DATE '2001-06-01'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


def keep_set_delete(spark, sf_dir):
    return E.keep_only(A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")


def feedback_upsert_latest(spark, sf_dir):
    """The latest event of each user and type, with the event number as time."""
    events = A.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return E.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def partial_update(spark, sf_dir):
    suppliers = A.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = suppliers.where("s_suppkey % 5 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit("renamed")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return E.patched(suppliers, changes, "s_suppkey")


def source_versions(spark, sf_dir):
    """Orders' versions after a sync in which some prices changed, some customers are new and some gone."""
    orders = A.table(spark, sf_dir, "orders")
    ranked = E.numbered(orders, ["o_custkey"], "o_orderdate", "o_orderkey", name="version")
    top = orders.groupBy("o_custkey").agg(F.count("*").cast("int").alias("last"))
    current = ranked.join(top, "o_custkey").where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("source_id"), "version", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("checksum"), (F.col("version") == F.col("last")).alias("is_active"))
    latest = E.first_of(orders, ["o_custkey"], "o_orderdate", "o_orderkey", last=True)
    incoming = latest.where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("source_id"), F.sha2(F.when(F.col("o_custkey") % 3 == 0, F.lit("new")).otherwise(F.col("o_orderkey").cast("string")), 256).alias("checksum"))
    return E.next_versions(current, incoming)


def conversation_nested(spark, sf_dir):
    rows = A.messages(spark, sf_dir).groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("seq", "role"))).alias("m"))
    return rows.select("conversation_id", F.array_join(F.transform("m", lambda x: F.concat(x["seq"].cast("string"), F.lit(":"), x["role"])), ",").alias("roles"))


def array_contains_subscribers(spark, sf_dir):
    hooks = A.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("click"), F.lit("view"))).otherwise(F.array(F.lit("purchase"))).alias("events"))
    kinds = A.tool_calls(spark, sf_dir).groupBy(F.col("tool_name").alias("event")).agg(F.count("*").alias("n"))
    return hooks.select("s_suppkey", F.explode("events").alias("event")).join(kinds, "event").select("s_suppkey", "event", "n")


def like_disjunction(spark, sf_dir):
    return A.table(spark, sf_dir, "part").where(E.like_any(F.concat_ws(" ", F.when(F.col("p_partkey") % 4 == 0, "100%_free"), "p_name", "p_type"), "cold", "no such", "%_f")).select("p_partkey", "p_name")


def null_predicates(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("is_archived", F.col("toxic") == 1)
    return E.filtered(rows, archived=False, lang="en", source="").select("doc_id", F.col("quality").isNotNull().alias("judged"))


def admin_search(spark, sf_dir):
    return E.search(A.table(spark, sf_dir, "customer").withColumn("token_text", F.lit("BUILDING")), "building").select("c_custkey", "c_mktsegment")


def dup_keep_first(spark, sf_dir):
    """The first document of each first line."""
    rows = A.corpus(spark, sf_dir)
    return E.first_of(rows, ["title"], "id").select("id", F.md5("title").alias("title_md5"))


def row_ordinals(spark, sf_dir):
    return E.numbered(A.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", F.lpad(F.col("row_order").cast("string"), 3, "0").alias("ordinal"))


def dq_violations(spark, sf_dir):
    orders, parts = A.table(spark, sf_dir, "orders"), A.table(spark, sf_dir, "part")
    return E.violations(
        orphan_lines=E.without(A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), orders, "o_orderkey"), repeated_names=E.repeated_keys(parts, "p_name"), negative_balance=A.table(spark, sf_dir, "customer").where("c_acctbal < 0"),
        repeated_ids=E.repeated_keys(orders, "o_orderkey"), texts_repeated=E.repeated_keys(A.table(spark, sf_dir, "documents"), "text"),
    )


def normalizers(spark, sf_dir):
    rows = A.corpus(spark, sf_dir).select("id", F.concat(F.lit("Đại  học "), "title").alias("t"))
    return rows.select("id", T.keep_d(F.col("t")).alias("keep_d"), T.fold_d(F.col("t")).alias("fold_d"), T.ascii_only(F.col("t")).alias("ascii_only"))


def slugify(spark, sf_dir):
    return A.corpus(spark, sf_dir).select("id", T.slug(F.col("title")).alias("slug"))


def summarize(spark, sf_dir):
    return A.corpus(spark, sf_dir).select("id", "summary")


def sanitize_strings(spark, sf_dir):
    rows = A.corpus(spark, sf_dir).select("id", F.concat(F.lit(" \x01\x07"), "title", F.lit("\x7f ")).alias("t"))
    return rows.select("id", T.sanitise(F.col("t"), 40).alias("clean"), T.file_name(F.concat(F.lit("../a/"), "t")).alias("name"))


def html_escape(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped_md5"))


def parse_numbers_dates(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.lit("n/a"))
    price = F.concat(F.lit("fee "), F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), ",", "."), F.lit(" đồng"))
    return orders.select(
        "o_orderkey", T.parse_date(raw).alias("day"), T.amount_value(price).alias("amount"), T.digits_to_int(F.concat(F.lit("x-"), F.col("o_orderkey").cast("string"), F.lit("y"))).alias("number"), T.clamp(F.col("o_orderpriority"), 0, 10, 5).alias("clamped")
    )


def heading_noise_toc_flags(spark, sf_dir):
    lines = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", F.col("n").cast("bigint").alias("n"), T.is_heading(F.col("line")).alias("heading"), T.is_noise(F.col("line")).alias("noise"), T.is_contents(F.col("line")).alias("contents"))


def sha256_checksum(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


def token_stats(spark, sf_dir):
    rows = A.corpus(spark, sf_dir).select("id", T.tokens(F.col("content")).alias("t"), T.token_set(F.col("content")).alias("s"))
    return rows.select("id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.size("s").cast("bigint").alias("n_set"), F.size(F.array_intersect("t", "s")).cast("bigint").alias("n_shared"))


def ngram_counts(spark, sf_dir):
    rows = A.corpus(spark, sf_dir).select(F.explode(T.phrases(T.tokens(F.col("title")))).alias("phrase"))
    return rows.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(50)


def keywords_once(spark, sf_dir):
    from quarry.operators import analytics as N

    rows = A.corpus(spark, sf_dir).select("id", N.keywords_once(F.split("title", " ")).alias("k"))
    return rows.select("id", F.array_join("k", " ").alias("keywords"))


def chunk_pages(spark, sf_dir):
    chunks = I.pack(I.paragraphs(A.table(spark, sf_dir, "documents")))
    return chunks.select("doc_id", "chunk", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5"), "section_title", "first_position", "last_position")


def chunk_overlap(spark, sf_dir):
    return I.lecture_chunks(A.table(spark, sf_dir, "documents")).select("doc_id", "chunk_id", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5"), "style")


def parse_fee_rows(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 4 == 0, F.lit("no amount")).otherwise(F.concat(F.lit("1. Học phí "), "o_orderpriority", F.lit(": "), F.regexp_replace(F.format_number(F.floor("o_totalprice") + 1000, 0), ",", "."), F.lit(" d6ng")))
    return I.fee_rows(orders.select("o_orderkey", line.alias("line"))).select("o_orderkey", "amount_value", "label")


def sheet_rows(spark, sf_dir):
    nation = A.table(spark, sf_dir, "nation")
    body = nation.select(F.lit("n").alias("path"), (F.col("n_nationkey") + 2).alias("row_number"), F.array(F.col("n_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey").cast("string")), F.lit("x")).alias("cells"))
    head = spark.createDataFrame([("n", 1, ["Name", "Region", ""])], "path string, row_number int, cells array<string>")
    return I.sheet_records(head.union(body)).select("row_number", "label", "content")


QUERIES = {
    f.__name__: f
    for f in (
        conversation_page, message_page, page_with_total, sorted_nulls, active_versions, published_snapshot, table_row_entries, chunk_entries, snapshot_union, anti_missing_sources, keep_set_delete, feedback_upsert_latest,
        partial_update, source_versions, conversation_nested, array_contains_subscribers, like_disjunction, null_predicates, admin_search, dup_keep_first, row_ordinals, dq_violations, normalizers, slugify, summarize,
        sanitize_strings, html_escape, parse_numbers_dates, heading_noise_toc_flags, sha256_checksum, token_stats, ngram_counts, keywords_once, chunk_pages, chunk_overlap, parse_fee_rows, sheet_rows,
    )
}

_ACTIVE = "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1)"
_UPPER = "length(regexp_replace(c, '[^\\p{Lu}]', '', 'g'))"
_LETTER = "length(regexp_replace(c, '[^\\p{L}]', '', 'g'))"
ORACLES = {
    "conversation_page": "SELECT conv_id AS conversation_id, max(turn) AS updated FROM conversations GROUP BY 1 ORDER BY updated DESC, conversation_id LIMIT 20 OFFSET 20",
    "message_page": "SELECT conv_id AS conversation_id, turn AS seq, role, text AS content FROM conversations ORDER BY conv_id, turn LIMIT 100 OFFSET 100",
    "page_with_total": "SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 25 OFFSET 10",
    "sorted_nulls": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN round(s_acctbal, 0) END AS score FROM supplier ORDER BY score ASC NULLS LAST, s_suppkey LIMIT 60",
    "active_versions": f"WITH {_ACTIVE} SELECT c_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS files FROM customer JOIN a ON c_custkey = o_custkey",
    "published_snapshot": f"WITH {_ACTIVE} SELECT o_custkey, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN a ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    "table_row_entries": "SELECT o_custkey || '-' || o_orderkey || '-' || lpad(l_linenumber::VARCHAR, 2, '0') AS entry_id, l_extendedprice AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "chunk_entries": f"WITH {D.CORPUS} SELECT id, category, summary, quality FROM corpus JOIN labels ON id = doc_id",
    "snapshot_union": "SELECT 'd' || doc_id AS id, 'document' AS kind, lang AS category, NULL::BIGINT AS size FROM documents UNION ALL SELECT 'b' || item_id, 'chunk', NULL, length(text) FROM benchmark UNION ALL SELECT 'p' || p_partkey, 'table_row', p_brand, NULL FROM part",
    "anti_missing_sources": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-06-01')",
    "keep_set_delete": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "feedback_upsert_latest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "partial_update": "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "source_versions": f"""WITH {_ACTIVE}, v AS (SELECT o_custkey AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, sha256(o_orderkey::VARCHAR) AS checksum, count(*) OVER (PARTITION BY o_custkey) AS last FROM orders),
      cur AS (SELECT source_id, version, checksum, version = last AS is_active FROM v WHERE source_id % 7 <> 0), inc AS (SELECT o_custkey AS source_id, sha256(CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE o_orderkey::VARCHAR END) AS checksum FROM a WHERE o_custkey % 5 <> 0),
      s AS (SELECT inc.source_id, inc.checksum, cur.version AS prev FROM inc LEFT JOIN cur ON cur.source_id = inc.source_id AND is_active WHERE cur.checksum IS NULL OR cur.checksum <> inc.checksum)
      SELECT source_id, version::INT AS version, checksum, is_active AND source_id NOT IN (SELECT source_id FROM s) AS is_active FROM cur WHERE source_id IN (SELECT source_id FROM inc)
      UNION ALL SELECT source_id, (coalesce(prev, 0) + 1)::INT, checksum, true FROM s""",
    "conversation_nested": "SELECT conv_id AS conversation_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1",
    "array_contains_subscribers": "SELECT s_suppkey, event_type AS event, count(*) AS n FROM supplier JOIN events ON list_contains(CASE WHEN s_suppkey % 2 = 0 THEN ['click', 'view'] ELSE ['purchase'] END, event_type) GROUP BY 1, 2",
    "like_disjunction": "SELECT p_partkey, p_name FROM (SELECT *, concat_ws(' ', CASE WHEN p_partkey % 4 = 0 THEN '100%_free' END, p_name, p_type) AS t FROM part) WHERE contains(t, 'cold') OR contains(t, 'no such') OR contains(t, '%_f')",
    "null_predicates": "SELECT doc_id, quality IS NOT NULL AS judged FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND NOT coalesce(toxic = 1, false)",
    "admin_search": "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_name), 'building') OR contains(lower(c_mktsegment), 'building')",
    "dup_keep_first": "SELECT min(doc_id) AS id, md5(string_split(text, chr(10))[1]) AS title_md5 FROM documents GROUP BY 2",
    "row_ordinals": "SELECT l_orderkey, l_linenumber, lpad(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::VARCHAR, 3, '0') AS ordinal FROM lineitem",
    "dq_violations": """SELECT 'orphan_lines' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated_names', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'texts_repeated', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)""",
    "normalizers": f"WITH t AS (SELECT doc_id AS id, 'Đại  học ' || string_split(text, chr(10))[1] AS t FROM documents) SELECT id, {D.keep_d('t')} AS keep_d, {D.fold_d('t')} AS fold_d, {D.ascii_only('t')} AS ascii_only FROM t",
    "slugify": "SELECT doc_id AS id, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(string_split(text, chr(10))[1]), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS slug FROM documents",
    "summarize": f"SELECT doc_id AS id, {D.summary('text')} AS summary FROM documents",
    "sanitize_strings": """WITH t AS (SELECT doc_id AS id, ' ' || chr(1) || chr(7) || string_split(text, chr(10))[1] || chr(127) || ' ' AS t FROM documents)
      SELECT id, substr(trim(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')), 1, 40) AS clean, regexp_replace(regexp_replace(regexp_replace('../a/' || t, '^.*[/\\\\]', ''), '[^\\w.-]', '_', 'g'), '^\\.+|\\.+$', '', 'g') AS name FROM t""",
    "html_escape": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages""",
    "parse_numbers_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderdate::DATE END AS day, floor(o_totalprice)::BIGINT AS amount, (-o_orderkey)::INT AS number, 5.0::DOUBLE AS clamped FROM orders",
    "heading_noise_toc_flags": f"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), t AS (SELECT *, trim(line) AS c FROM l)
      SELECT doc_id, n, c <> '' AND length(c) <= 160 AND (ends_with(c, ':') OR regexp_matches(lower(c), '^(chuong|ph[aà]n|muc|dieu|section|article)(\\s|[[:punct:]]|$)') OR ({_LETTER} > 0 AND {_UPPER} >= 0.75 * {_LETTER} AND len(string_split_regex(c, '\\s+')) <= 18)) AS heading,
        c = '' OR regexp_matches(c, '(?i)^(stsv|\\d+)(\\s*\\*\\s*(stsv|\\d+))*$') OR regexp_matches(c, '^[^\\p{{L}}\\p{{M}}]+$') OR ({_LETTER} < 4 AND length(c) < 24) AS noise,
        contains({D.ascii_only('line')}, 'muc luc') OR (len(regexp_extract_all(line, '\\.{{4,}}')) >= 2 AND len(regexp_extract_all(line, '\\b\\d{{1,3}}\\b')) >= 2) AS contents FROM t""",
    "sha256_checksum": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "token_stats": f"WITH t AS (SELECT doc_id AS id, {D.tokens('text')} AS t, {D.token_set('text')} AS s FROM documents) SELECT id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(s) AS n_set, len(list_intersect(list_distinct(t), s)) AS n_shared FROM t",
    "ngram_counts": f"WITH t AS (SELECT {D.tokens('string_split(text, chr(10))[1]')} AS s FROM documents) SELECT phrase, count(*) AS n FROM (SELECT unnest({D.phrases('s')}) AS phrase FROM t) GROUP BY phrase ORDER BY n DESC, phrase LIMIT 50",
    "keywords_once": """WITH k AS (SELECT doc_id AS id, string_split(string_split(text, chr(10))[1], ' ') AS k FROM documents), e AS (SELECT id, unnest(k) AS w, unnest(range(len(k))) AS i FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY id, lower(trim(w)) ORDER BY i) AS r FROM e WHERE trim(w) <> '')
      SELECT k.id, coalesce((SELECT string_agg(trim(w), ' ' ORDER BY i) FROM f WHERE f.id = k.id AND r = 1), '') AS keywords FROM k""",
    "parse_fee_rows": "SELECT o_orderkey, floor(o_totalprice)::BIGINT + 1000 AS amount_value, 'Học phí ' || o_orderpriority AS label FROM orders WHERE o_orderkey % 4 <> 0",
    "sheet_rows": "SELECT n_nationkey + 2 AS row_number, n_name || ' - ' || CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::VARCHAR ELSE 'x' END AS label, 'Name: ' || n_name || CASE WHEN n_nationkey % 3 <> 0 THEN ' | Region: ' || n_regionkey ELSE '' END || ' | column_3: x' AS content FROM nation",
}
