"""The retrieval snapshot: entries of seven branches in one shape, the form that fits a procedure, and the run that publishes them with observed counts.

Branches stay separate plans until one union; a run writes them in one job each table, and its counts come from metrics that the same job gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import rules as U
from quarry.functions import text as T
from quarry.operators.retrieval import query_set
from quarry.sources import publish

COLUMNS = ("external_id", "document_id", "title", "category", "source_kind", "summary", "content", "keywords", "section_title", "page_from", "page_to")
# Category of a procedure without a form, what stands for nothing, and how many courses a summary lists.
NO_CATEGORY, NOTHING, UNCLEAR, LISTED = "Thủ tục hành chính", "Khong co", "Khong ro", 20


def _entries(rows: DataFrame, **columns: Column) -> DataFrame:
    """All columns of an entry; those not given are null, keywords an array without nulls."""
    kinds = {"keywords": "array<string>", "page_from": "int", "page_to": "int"}
    return rows.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def _text(column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _said(column) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def best_form(procedures: DataFrame, forms: DataFrame) -> DataFrame:
    """``procedures`` (procedure_id, title, form_topic, ...) with related_form_id and form_category, null where no form has a point.

    A lateral join: each procedure looks for its own best form, and stays without one. Three points for each shared token, 12 for the form's title in the
    topic and title asked for, 8 or 2 for each keyword by its number of words, 4 for the category, 2 for the description; of equal forms the first by ``ord``. The catalogue
    of forms is checked to be small.
    """
    known = forms.select(
        "ord", "form_id", F.col("category").alias("form_category"), T.token_set(F.concat_ws(" ", "title", "category", "description", F.array_join("keywords", " "))).alias("c_tokens"),
        T.fold_d(F.col("title")).alias("c_title"), T.fold_d(F.col("category")).alias("c_category"), T.fold_d(F.col("description")).alias("c_description"), F.transform("keywords", T.fold_d).alias("c_keywords"),
    )
    said = F.trim(F.concat_ws(" ", "form_topic", "title"))
    asked = procedures.withColumns({"_n": T.fold_d(said), "_tokens": T.token_set(said)})
    n, tokens = F.col("_n").outer(), F.col("_tokens").outer()
    has = lambda c, points: F.when((F.col(c) != "") & F.contains(n, F.col(c)), points).otherwise(0)
    keywords = F.aggregate(F.filter("c_keywords", lambda w: (w != "") & F.contains(n, w)), F.lit(0), lambda s, w: s + F.when(F.contains(w, F.lit(" ")), 8).otherwise(2))
    points = 3 * F.size(F.array_intersect(tokens, F.col("c_tokens"))) + has("c_title", 12) + keywords + has("c_category", 4) + has("c_description", 2)
    scored = query_set(known).select("form_id", "form_category", "ord", points.alias("points")).where("points > 0")
    best = scored.select(F.max_by(F.struct("form_id", "form_category"), F.struct("points", -F.col("ord"))).alias("form"))
    found = asked.lateralJoin(best, how="left")
    return found.withColumns({"related_form_id": F.col("form.form_id"), "form_category": F.col("form.form_category")}).drop("form", "_n", "_tokens")


def procedures_loaded(procedures: DataFrame, forms: DataFrame) -> DataFrame:
    """Procedures with their form and its category."""
    return best_form(procedures, forms).withColumn("category", F.coalesce(_said("form_category"), F.lit(NO_CATEGORY)))


def chunk_entries(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, document_id, heading, section_title, content, summary, keywords, pages) of published ``documents`` (document_id, title, category)."""
    rows = chunks.join(documents.select("document_id", "title", "category"), "document_id")
    return _entries(
        rows, external_id=F.col("chunk_id"), document_id=F.col("document_id"), title=F.col("title"), category=F.col("category"), source_kind=F.lit("chunk"),
        summary=F.coalesce(_said("summary"), _said("content"), F.col("title")), content=_text("content"), keywords=F.col("keywords"), section_title=F.coalesce(_said("section_title"), F.col("heading")),
        page_from=F.col("page_from"), page_to=F.col("page_to"),
    )


def table_row_entries(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """``rows`` (table_id, document_id, table_title, row_id, row_order, label, searched, tracks, basis, pages) of published documents."""
    joined = rows.join(documents.select("document_id", "title", "category"), "document_id")
    data = F.to_json(F.struct("row_id", "label", "amount_text"))
    return _entries(
        joined, external_id=F.concat_ws("-", "table_id", "row_id", F.lpad(F.col("row_order").cast("string"), 2, "0")), document_id=F.col("document_id"), title=F.col("title"), category=F.col("category"),
        source_kind=F.lit("table_row"), summary=F.regexp_replace(F.concat_ws(" - ", "table_title", _text("label")), "^[ -]+|[ -]+$", ""),
        content=F.coalesce(_said("searched"), F.concat(F.col("table_title"), F.lit(". "), _text("label"), F.lit(". Muc du lieu: "), data)),
        keywords=F.concat(F.array("category", "title", "table_title", _text("label")), "tracks", "basis"), section_title=F.col("table_title"), page_from=F.col("page_from"), page_to=F.col("page_to"),
    )


def course_entries(courses: DataFrame) -> DataFrame:
    """A record for each published course of ``quarry.operators.courses``, with ``category`` and ``document_id`` of its catalogue."""
    rows = courses.where("status = 'published'")
    hours = F.concat_ws("; ", *[F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit(0)).cast("string")) for name, c in (
        ("LT", "lecture_hours"), ("TL/BT", "discussion_hours"), ("TKMH", "course_design_hours"), ("BTL", "project_hours"), ("TN", "lab_hours"), ("TH", "practice_hours"), ("THoc", "self_study_hours"))])
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    prefixed = lambda word, c: F.when(_text(c) != "", F.concat(F.lit(f"{word} "), F.col(c)))
    parts = [_said("course_name"), prefixed("Ma mon", "course_code"), F.concat(F.col("credits").cast("string"), F.lit(" tin chi")), _said("semester_label"), _said("program_track"), prefixed("Tien quyet", "prerequisite_text"), prefixed("Ngon ngu", "teaching_language")]
    content = F.concat_ws(
        "\n", line("Hoc phan", F.col("course_name")), line("Ma hoc phan", F.col("course_code")), line("Chuong trinh", F.col("program_track")), line("Hoc ky", F.col("semester_label")),
        line("So tin chi", F.col("credits").cast("string")), hours, line("Hoc phan tien quyet", F.coalesce(_said("prerequisite_text"), F.lit(NOTHING))),
        line("Ngon ngu giang day", F.coalesce(_said("teaching_language"), F.lit(UNCLEAR))),
    )
    aliases = F.filter(F.split("aliases", "; "), lambda a: a != "")
    keywords = F.concat(F.array("category", "program_name", _text("program_track"), _text("semester_label"), "course_code", "course_name"), aliases, F.array(_text("teaching_language")))
    return _entries(rows, external_id=F.col("course_record_id"), document_id=F.col("document_id"), title=F.col("course_name"), category=F.col("category"), source_kind=F.lit("course_record"), summary=F.concat_ws(" - ", *parts), content=content, keywords=keywords, section_title=F.col("semester_label"))


def course_summaries(courses: DataFrame) -> DataFrame:
    """A summary for each catalogue, track and semester, with the first courses in catalogue order; ranks are limited before the list is made."""
    key = ["catalog_id", "program_track", "semester_label"]
    rows = courses.where("status = 'published'")
    totals = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("credits").alias("credits"), *[F.min(c).alias(c) for c in ("program_name", "category", "document_id")])
    order = (F.col("semester_number").asc_nulls_last(), F.col("course_order").asc_nulls_last(), F.col("course_record_id"))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("place") <= LISTED)
    listed = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" - ", "course_code", "course_name").alias("said")))).alias("said"))
    joined = totals.join(listed, key)
    name = F.concat_ws(" - ", "program_name", "program_track", "semester_label")
    n, credits = F.col("n").cast("string"), F.col("credits").cast("string")
    content = F.concat(F.lit("Chuong trinh "), name, F.lit(".\nSo hoc phan: "), n, F.lit(". Tong tin chi: "), credits, F.lit(".\nDanh sach mon hoc: "), F.array_join("said.said", "; "))
    return _entries(
        joined, external_id=F.concat_ws("-", "catalog_id", "program_track", T.slug(F.col("semester_label")), F.lit("summary")), document_id=F.col("document_id"), title=name, category=F.col("category"),
        source_kind=F.lit("course_summary"), summary=F.concat(F.col("semester_label"), F.lit(" ("), F.col("program_track"), F.lit(") co "), n, F.lit(" hoc phan, tong "), credits, F.lit(" tin chi.")), content=content,
        keywords=F.array("category", "program_name", "program_track", "semester_label", F.lit("danh sach mon hoc"), F.lit("tong tin chi")), section_title=F.col("semester_label"),
    )


def faq_entries(faqs: DataFrame) -> DataFrame:
    """An entry, under a document of its own, for each FAQ (faq_id, question, answer, category, keywords)."""
    content = F.concat(F.lit("Cau hoi: "), _text("question"), F.lit("\n\nTra loi: "), _text("answer"))
    return _entries(faqs, external_id=F.concat("faq_id", F.lit("-entry")), document_id=F.col("faq_id"), title=F.col("question"), category=F.col("category"), source_kind=F.lit("faq"), summary=F.col("question"), content=content, keywords=F.col("keywords"))


def form_entries(forms: DataFrame) -> DataFrame:
    """An entry for each form (form_id, title, category, description, keywords, fields of label, name and type)."""
    said = F.transform("fields", lambda f: F.concat(_text(f["label"]), F.lit(" ("), _text(f["name"]), F.lit(", "), F.coalesce(f["type"], F.lit("text")), F.lit(")")))
    fields = F.coalesce(F.nullif(F.array_join(said, ", "), F.lit("")), F.lit(NOTHING))
    content = F.concat(F.lit("Bieu mau: "), F.col("title"), F.lit("\n\nMo ta: "), _text("description"), F.lit("\n\nCac truong: "), fields)
    return _entries(forms, external_id=F.concat("form_id", F.lit("-entry")), document_id=F.col("form_id"), title=F.col("title"), category=F.col("category"), source_kind=F.lit("form_template"), summary=F.coalesce(_said("description"), F.col("title")), content=content, keywords=F.col("keywords"))


def procedure_entries(procedures: DataFrame) -> DataFrame:
    """An entry for each procedure (procedure_id, title, category, keywords, eligibility, required_documents, steps, contact_office)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    content = F.concat_ws(
        "\n\n", line("Thu tuc", F.col("title")), line("Dieu kien", U.listed(F.col("eligibility"))), line("Ho so", U.listed(F.col("required_documents"))), line("Cac buoc", U.listed(F.col("steps"))),
        line("Don vi lien he", F.coalesce(_said("contact_office"), F.lit(UNCLEAR))),
    )
    return _entries(procedures, external_id=F.concat("procedure_id", F.lit("-entry")), document_id=F.col("procedure_id"), title=F.col("title"), category=F.col("category"), source_kind=F.lit("procedure"), summary=F.col("title"), content=content, keywords=F.col("keywords"))


def union(branches: dict[str, DataFrame]) -> DataFrame:
    first, *rest = branches.values()
    for branch in rest:
        first = first.unionByName(branch)
    return first


#: Branches whose entries have a document each.
OWN_DOCUMENT = ("faq", "form", "procedure")


def run(spark: SparkSession, branches: dict[str, DataFrame], documents: DataFrame, root: str) -> dict[str, dict]:
    """Publishes ``entries`` and ``documents`` as one snapshot; {branch: {"entries", "documents", "with_vector"}} as the writing jobs counted them.

    Each branch and the table of source documents carries an ``Observation``; nothing is read a second time for the figures.
    """
    seen = {name: Observation(f"branch_{name}") for name in (*branches, "source")}
    own = {name: rows for name, rows in branches.items() if name in OWN_DOCUMENT}
    vector = F.count("vector") if all("vector" in rows.columns for rows in branches.values()) else F.lit(0).cast("long")
    watched = {name: rows.observe(seen[name], F.count(F.lit(1)).alias("entries"), vector.alias("with_vector")) for name, rows in branches.items()}
    base = documents.select("document_id", "title", "category").withColumn("source_kind", F.lit("document")).observe(seen["source"], F.count(F.lit(1)).alias("documents"))
    made = base
    for rows in own.values():
        made = made.unionByName(rows.select("document_id", "title", "category", "source_kind"))
    publish.publish(spark, root, {"entries": union(watched), "documents": made}, publish.current(spark, root))
    counts = {name: {"entries": int(seen[name].get["entries"]), "with_vector": int(seen[name].get["with_vector"]), "documents": int(seen[name].get["entries"]) if name in own else 0} for name in branches}
    return {**counts, "source": {"entries": 0, "with_vector": 0, "documents": int(seen["source"].get["documents"])}}
