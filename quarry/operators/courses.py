"""Course catalogues from workbooks: the header row says which sheet counts and where its columns are.

Rows come as (path, sheet, sheet_no, row_number, cells) with blank rows left out. Headers are looked at once for each sheet; rows meet their workbook's
column map in one join and are read through it, whatever the order and number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.tables import broadcast_if_small

# Headers that a course sheet has, sheets of a full workbook, names that tell a catalogue.
REQUIRED = ("ten hoc phan", "ma hoc phan", "so tc")
LAYOUT = ("tong quan", "du lieu", "ghi chu")
CATEGORY, STEM = "chuong trinh dao tao", "danh sach mon hoc"
SUMMARY, GLOSSARY = "tong quan", "ghi chu"
# Words that lost a letter, and the words.
ALIASES = (("ai so tuyen tinh", "dai so tuyen tinh"), ("tin hoc ai cuong", "tin hoc dai cuong"), ("chuyen e", "chuyen de"), ("mac le nin", "mac lenin"))
# Columns of hours by header, tracks and languages in the order in which they are looked for.
HOURS = (("lecture_hours", "lt"), ("discussion_hours", "tl bt"), ("course_design_hours", "tkmh"), ("project_hours", "btl"), ("lab_hours", "tn"), ("practice_hours", "th"), ("self_study_hours", "thoc"))
TRACKS = (("ky_su", "ky su"), ("cu_nhan", "cu nhan"), ("tich_hop", "tich hop"))
LANGUAGES = (("anh", "anh"), ("viet", "viet"), ("song_ngu", "song ngu"))
NO_SEMESTER = "Khong ro hoc ky"


def search_words(text: Column) -> Column:
    """ASCII letters and digits in lower case, all else single spaces."""
    plain = F.lower(F.regexp_replace(T.without_accents(text, True), r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def course_name(text: Column) -> tuple[Column, Column]:
    """(name in search words with misread words put right, what was put in, sorted)."""
    name, found = search_words(text), []
    for wrong, right in ALIASES:
        found.append(F.when(F.contains(name, F.lit(wrong)), F.lit(right)))
        name = F.replace(name, F.lit(wrong), F.lit(right))
    return name, F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda a: a.isNotNull() & (a != name))))


def _first(text: Column, table, otherwise: Column) -> Column:
    out = otherwise
    for value, word in reversed(table):
        out = F.when(F.contains(text, F.lit(word)), F.lit(value)).otherwise(out)
    return out


def sheet_heads(rows: DataFrame) -> DataFrame:
    """(path, sheet, sheet_no, headers, name, fits) for each sheet with rows: its first row in search words, and whether that holds all required headers."""
    first = rows.groupBy("path", "sheet", "sheet_no").agg(F.min_by("cells", "row_number").alias("cells"), F.min("row_number").alias("head"))
    headers = F.transform("cells", search_words)
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("headers"))
    return first.select("path", "sheet", "sheet_no", "head", headers.alias("headers"), search_words(F.col("sheet")).alias("name")).withColumn("fits", F.size(missing) == 0)


def workbooks(heads: DataFrame, metadata: DataFrame) -> DataFrame:
    """(path, workbook_type, canonical, summary, glossary, title, category, version, status) of all workbooks.

    ``metadata`` (path, title, category, version, status, canonical_sheet). A catalogue has a sheet that fits and the layout, the category or the file name of one. The sheet that
    metadata name counts before the first that fits.
    """
    on = heads.join(broadcast_if_small(metadata), "path", "left")
    names = F.collect_set("name")
    stem = search_words(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", ""))
    order = F.struct(F.coalesce(F.col("sheet") != F.col("canonical_sheet"), F.lit(True)), "sheet_no")
    choice = F.when((F.col("sheet") == F.col("canonical_sheet")) | F.col("fits"), order)
    of = lambda word: F.min_by("sheet", F.when(F.contains("name", F.lit(word)), F.col("sheet_no")))
    kept = ("title", "category", "version", "status")
    found = on.groupBy("path").agg(
        names.alias("names"), F.max("fits").alias("any"), F.min_by(F.struct("sheet", "sheet_no", "headers", "head", "fits"), choice).alias("canonical"), of(SUMMARY).alias("summary"),
        of(GLOSSARY).alias("glossary"), *[F.first(c).alias(c) for c in kept],
    )
    named = (F.size(F.array_except(F.array(*map(F.lit, LAYOUT)), "names")) == 0) | F.contains(search_words(F.coalesce("category", F.lit(""))), F.lit(CATEGORY)) | F.contains(stem, F.lit(STEM))
    kind = F.when(F.col("any") & named, "course_catalog").otherwise("generic_tabular")
    return found.select("path", kind.alias("workbook_type"), "canonical", "summary", "glossary", *kept)


def courses(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Courses of all catalogues; rows without name, code or credits are left out."""
    books = workbooks(sheet_heads(rows), metadata).where("workbook_type = 'course_catalog' AND canonical.fits")
    at = F.transform("canonical.headers", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    last = F.filter(at, lambda e: (e["h"] != "") & ~F.exists(F.slice("canonical.headers", e["i"] + 2, F.greatest(F.size("canonical.headers"), F.lit(1))), lambda h: h == e["h"]))
    books = books.select(
        "path", F.col("canonical.sheet").alias("sheet"), F.col("canonical.head").alias("head"), F.map_from_entries(last).alias("column"), F.concat(F.lit("catalog-"), T.slug(F.col("path"))).alias("catalog_id"),
        F.coalesce(F.nullif("title", F.lit("")), T.title_from_name(F.col("path"))).alias("program_name"), "category", "version", "summary", "glossary", F.coalesce(F.nullif("status", F.lit("")), F.lit("draft")).alias("status"),
    )
    joined = rows.join(broadcast_if_small(books), ["path", "sheet"]).where("row_number > head")
    cell = lambda header: F.trim(F.get("cells", F.element_at("column", F.lit(header)).cast("int")))
    number = lambda header: T.digits_to_int(cell(header))
    name, aliases = course_name(cell("ten hoc phan"))
    track, language = search_words(F.coalesce(cell("chuong trinh"), F.lit(""))), search_words(cell("nngd"))
    semester = F.coalesce(cell("hoc ky"), F.lit(NO_SEMESTER))
    program = _first(track, TRACKS, F.lit("khac"))
    parts = [cell("chuong trinh"), semester, cell("ten hoc phan"), name, cell("ma hoc phan"), number("so tc").cast("string"), cell("nngd"), cell("hp tien quyet")]
    return joined.where((cell("ten hoc phan") != "") & (cell("ma hoc phan") != "") & number("so tc").isNotNull()).select(
        "catalog_id", F.concat("catalog_id", F.lit("-row-"), F.lpad((F.col("row_number") - F.col("head") + 1).cast("string"), 4, "0")).alias("course_record_id"), "program_name", "sheet", "summary", "glossary", "status",
        program.alias("program_track"), F.when(program.isin("ky_su", "cu_nhan"), program).alias("degree_level"), F.nullif(F.regexp_extract(search_words(semester), r"\d+", 0), F.lit("")).cast("int").alias("semester_number"),
        semester.alias("semester_label"), number("tt").alias("course_order"), cell("ten hoc phan").alias("course_name"), name.alias("normalized_course_name"), F.array_join(aliases, "; ").alias("aliases"),
        cell("ma hoc phan").alias("course_code"), number("so tc").alias("credits"), *[number(h).alias(c) for c, h in HOURS], cell("hp tien quyet").alias("prerequisite_text"),
        _first(language, LANGUAGES, F.nullif(language, F.lit(""))).alias("teaching_language"), F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ").alias("search_text"),
    )
