"""Fee tables from layout lines: headings open tables, numbered lines open rows, what follows goes on with the open row, across pages too.

The fold over a document's lines is said as segments: running counts of headings and of rows number the lines, so every line knows its table and its row,
and rows are put together by grouping. Running windows look at one document at a time and keep no lines; a group is one row of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import rules as U
from quarry.functions import text as T

# Slugs of section headings and of header lines, words that a title of its own must not hold.
HEADING_SLUGS = ("muc-thu", "hoc-phi", "dao-tao", "chuong-trinh", "nganh")
HEADER_SLUGS, HEADER_PARTS = ("tt", "1-tin-chi", "hoc-ky"), ("khoa-khoi-nganh", "muc-hoc-phi")
TITLE_STOPS = ("tt", "khoa", "muc-hoc-phi", "1-tin-chi")
HEADING = r"(?i)^(?:[IVXLCDM]{1,6}|IL)\.?\s*(.+)$"
NOTE = r"(?i)^(ghi chu|phu luc)\b"
ROW_START = r"(?i)^(\d+(?:\.\d+)?|i)\s+"
AMOUNT = r"\d[\d.]*\s*(?:dong|ddng|d6ng)"
ROW = rf"(?i)^(\d+(?:\.\d+)?|i)\s+(.+?)\s+({AMOUNT}(?:/\s*(?:1|hoc))?)$"
ROW_INSIDE = rf"(?i)^(.*?)({AMOUNT}(?:/\s*(?:1|hoc))?)(.*)$"
UNIT = r"(?i)^(tin chi|hoc ky)$"
LEAST_HEADING, LEAST_DIGITS = 8, 5


def is_section(line: Column) -> Column:
    """A Roman number and a title of fees or courses."""
    title = F.trim(F.regexp_extract(line, HEADING, 1))
    return line.rlike(HEADING) & (F.length(title) >= LEAST_HEADING) & T.let(T.slug(title), lambda s: T.any_of(s, HEADING_SLUGS))


def is_header(line: Column) -> Column:
    return T.let(T.slug(line), _header)


def _header(slug: Column) -> Column:
    return slug.isin(*HEADER_SLUGS) | T.any_of(slug, HEADER_PARTS)


def is_title(line: Column) -> Column:
    """A line above a table's first row that goes on with its title: at least two words of six letters in all."""
    return T.let(T.slug(line), lambda slug: _title(line, slug))


def _title(line: Column, slug: Column) -> Column:
    letters = lambda words: F.aggregate(words, F.lit(0), lambda a, t: a + F.length(t))
    worded = T.let(F.filter(F.split(slug, "-"), lambda t: t.rlike("^[a-z]+$")), lambda words: (F.size(words) >= 2) & (letters(words) >= 6))
    return ~line.rlike(ROW_START) & worded & ~T.any_of(slug, TITLE_STOPS)


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ -]+|[ -]+$", "")


def parsed_row(line: Column) -> Column:
    """(row_id, label, amount) of a line that opens a row, else null: number, label, amount; or an amount of five digits anywhere, the label around it."""
    body = F.trim(F.regexp_replace(line, ROW_START, ""))
    around = F.concat_ws(" ", *[F.nullif(_tidy(F.regexp_extract(body, ROW_INSIDE, i)), F.lit("")) for i in (1, 3)])
    inside = F.regexp_extract(body, ROW_INSIDE, 2)
    digits = F.length(F.regexp_replace(inside, r"\D", ""))
    entry = lambda number, label, amount: F.struct(number.alias("row_id"), label.alias("label"), T.amount_text(amount).alias("amount"))
    whole = entry(F.regexp_extract(line, ROW, 1), _tidy(F.regexp_extract(line, ROW, 2)), F.regexp_extract(line, ROW, 3))
    part = entry(F.regexp_extract(line, ROW_START, 1), around, inside)
    return F.when(line.rlike(ROW), whole).when(line.rlike(ROW_START) & (digits >= LEAST_DIGITS), part)


def table_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, position, line) of open tables with ``table_no``, ``row_no`` (0 above the first row) and ``kind``: heading, title, row, unit, more, note or none."""
    order = W.partitionBy("doc_id").orderBy("page", "position")
    line = F.col("line")
    opens, ends = is_section(line), line.rlike(NOTE)
    marked = lines.select("doc_id", "page", "position", "line", F.when(opens, F.lit("heading")).when(ends, F.lit("note")).alias("mark"))
    running = marked.select(
        "*", F.count_if(F.col("mark") == "heading").over(order).alias("table_no"),
        F.last("mark", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
    )
    inside = running.where((F.col("mark") == "heading") | (F.col("before") == "heading")).drop("before")
    said = T.let(T.slug(line), lambda s: F.struct(_header(s).alias("header"), _title(line, s).alias("title")))
    row = inside.withColumn("said", said).withColumn("row", F.when(F.col("mark").isNull() & ~F.col("said.header"), parsed_row(line)))
    counted = row.withColumn("row_no", F.count("row").over(W.partitionBy("doc_id", "table_no").orderBy("page", "position")))
    above = F.col("row_no") == 0
    kind = (
        F.when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("said.header"), "none").when(F.col("row").isNotNull(), "row").when(above & F.col("said.title"), "title").when(above, "none")
        .when(line.rlike(UNIT), "unit").otherwise("more")
    )
    return counted.withColumn("kind", kind).drop("mark", "said")


def _joined(kinds, value: Column) -> Column:
    """The parts of some kinds in the order of their lines."""
    part = F.when(F.col("kind").isin(*kinds), F.struct("page", "position", value.alias("part")))
    return F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["part"]), " ")


def fee_table_rows(lines: DataFrame) -> DataFrame:
    """Rows of fee tables: document, table (numbered among those that have rows), its title and pages, and the row with amount, tags and search text.

    Rows without label or amount are left out, and so are tables without rows.
    """
    numbered = table_lines(lines)
    key = ["doc_id", "table_no"]
    tables = numbered.groupBy(*key).agg(_joined(("heading", "title"), F.col("line")).alias("title"), F.min("page").alias("table_from"), F.max("page").alias("table_to"))
    open_row = numbered.where("row_no > 0 AND kind IN ('row', 'unit', 'more')")
    first = lambda field: F.max(F.col(f"row.{field}"))  # noqa: E731  a group has one line that opens it
    rows = open_row.groupBy(*key, "row_no").agg(
        first("row_id").alias("row_id"), _joined(("row", "more"), F.coalesce("row.label", "line")).alias("label"), _joined(("row", "unit"), F.coalesce("row.amount", "line")).alias("amount"),
        F.min("page").alias("page_from"), F.max("page").alias("page_to"),
    )
    label = U.repaired(F.regexp_replace(F.regexp_replace("label", r"\s+", " "), "^[ /-]+|[ /-]+$", ""))
    rows = rows.withColumns({"label": label, "amount_text": T.amount_text(F.col("amount"))}).where("label <> '' AND amount_text <> ''")
    joined = rows.join(tables, key).withColumn("title", U.repaired(F.col("title")))
    tracks, basis = U.tuition_tags(F.col("title"), F.col("label"), F.col("amount_text"))
    tagged = joined.withColumns({"tracks": tracks, "basis": basis, "amount_value": T.amount_value(F.col("amount_text"))})
    in_document, in_table = W.partitionBy("doc_id").orderBy("table_no"), W.partitionBy(*key).orderBy("row_no")
    return tagged.select(
        "doc_id", F.dense_rank().over(in_document).alias("table_order"), F.row_number().over(in_table).alias("row_order"), "title", "table_from", "table_to", "row_id", "label",
        "amount_text", "amount_value", F.array_join("tracks", ",").alias("tracks"), F.array_join("basis", ",").alias("basis"),
        U.tuition_text(F.col("title"), F.col("label"), F.col("amount_text"), F.col("tracks"), F.col("basis")).alias("searched"), "page_from", "page_to",
    )
