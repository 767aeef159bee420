"""Text functions as Column expressions: normalisers, tokens, slugs, summaries, flags and parsers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that carry no meaning in a query, and one-letter tokens that do.
STOPWORDS = (
    "a an and bao cac can cho co cua da de den duoc hoc la lam mot nam nhung noi o quy se sinh tai the theo thu trong tu va ve vien voi"
).split()
ROMAN = "i ii iii iv v vi vii viii ix x".split()


@lru_cache(maxsize=4)
def accent_table(compatible: bool = False) -> tuple[str, str]:
    """Characters of the basic plane that decompose to one base and marks, and their bases."""
    form = "NFKD" if compatible else "NFD"
    source, target = [], []
    for code in range(0xC0, 0x10000):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize(form, char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_accents(text: Column, compatible: bool = False) -> Column:
    source, target = accent_table(compatible)
    bare = lambda t: F.regexp_replace(F.translate(t, source, target), r"\p{Mn}", "")
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(bare(t)))  # ASCII has none


def keep_d(text: Column) -> Column:
    """Accents off, lower case, trimmed; đ stays."""
    return _strip(F.lower(without_accents(text)))


def fold_d(text: Column) -> Column:
    """As ``keep_d``, and đ becomes d."""
    return _strip(F.lower(F.translate(without_accents(text, True), "đĐ", "dD")))


def ascii_only(text: Column) -> Column:
    """Accents off, what is then not ASCII dropped, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(without_accents(text, True), r"[^\x00-\x7F]", "")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words of letters, digits and _ of ``keep_d`` without stop words and, but for Roman numerals, single characters."""
    found = F.regexp_extract_all(keep_d(text), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda t: ((F.length(t) > 1) | t.isin(ROMAN)) & ~t.isin(STOPWORDS))


def token_set(text: Column) -> Column:
    """Distinct parts of ``fold_d`` between other characters than letters and digits."""
    return F.array_distinct(F.filter(F.split(fold_d(text), "[^a-z0-9]+"), lambda t: t != ""))


def phrases(sequence: Column) -> Column:
    """Distinct runs of two and of three tokens, joined by spaces. The tokens are computed once, not for each run."""

    def runs(s: Column, n: int) -> Column:
        starts = F.when(F.size(s) >= n, F.sequence(F.lit(1), F.size(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(s, i, n), " "))

    return let(sequence, lambda s: F.array_distinct(F.concat(runs(s, 2), runs(s, 3))))


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, all else one hyphen; "document" if nothing is left."""
    ascii_ = F.lower(F.regexp_replace(without_accents(text, True), r"[^\x00-\x7F]", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_, "[^a-z0-9]+", "-"), "^-+|-+$", ""), "^$", "document")


def tidy_space(text: Column) -> Column:
    r"""No-break spaces to spaces, \r\n and \r to \n, runs of blanks to one, three or more \n to two, trimmed."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    for pattern, by in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return _strip(out)


def summary(text: Column, limit: int = 240) -> Column:
    """White space collapsed; beyond ``limit`` cut before the last, partial word, with dots."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.trim(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", "")), F.lit("...")))


def title_from_name(name: Column) -> Column:
    """A readable title from a file name: no suffix, camel case and _ - apart."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "(?<=[a-z])(?=[A-Z])", " "), "[_-]+", " "), r"\s{2,}", " "))


def category_from_path(folder: Column) -> Column:
    """Folder names joined by " / ", title case; "Khac" without any."""
    parts = F.filter(F.split(F.coalesce(folder, F.lit("")), "/"), lambda p: ~p.isin("", "."))
    return F.initcap(F.trim(F.translate(F.coalesce(F.nullif(F.array_join(parts, " / "), F.lit("")), F.lit("khac")), "_-", "  ")))


def _letters(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, rf"[^\p{{{kind}}}]", ""))


def is_heading(text: Column) -> Column:
    """At most 160 characters and: a colon at the end, a section word at the start, or mostly capitals in 18 words or fewer."""

    def heading(clean: Column) -> Column:
        capitals = (F.size(F.split(clean, r"(?U)\s+")) <= 18) & let(_letters(clean, "L"), lambda n: (n > 0) & (_letters(clean, "Lu") >= 0.75 * n))
        section = F.lower(clean).rlike(r"(?U)^(chuong|ph[aà]n|muc|dieu|section|article)\b")
        return (clean != "") & (F.length(clean) <= 160) & (clean.endswith(":") | section | capitals)

    return let(_strip(F.coalesce(text, F.lit(""))), heading)


def is_noise(text: Column) -> Column:
    """Empty, page numbers and running heads, no letters, or very few in a short text."""

    def noise(clean: Column) -> Column:
        head = clean.rlike(r"(?i)^(stsv|\d+)(\s*\*\s*(stsv|\d+))*$")
        return (clean == "") | head | clean.rlike(r"(?U)^[\W\d_]+$") | ((F.length(clean) < 24) & (_letters(clean, "L") < 4))

    return let(_strip(F.coalesce(text, F.lit(""))), noise)


def is_contents(text: Column) -> Column:
    """A table of contents: says so, or has two dot leaders and two short numbers."""
    text = F.coalesce(text, F.lit(""))
    return F.contains(ascii_only(text), F.lit("muc luc")) | (
        (F.regexp_count(text, F.lit(r"\.{4,}")) >= 2) & (F.regexp_count(text, F.lit(r"\b\d{1,3}\b")) >= 2)
    )


def replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Variants of one word that text recognition makes.
AMOUNT_VARIANTS = (("d6ng", "dong"), ("ddng", "dong"), ("đ6ng", "dong"), ("đồng", "dong"))


def amount_text(text: Column) -> Column:
    return F.regexp_replace(replaced(_strip(F.coalesce(text, F.lit(""))), AMOUNT_VARIANTS), r"(?U)\s+", " ")


def amount_value(text: Column) -> Column:
    """The first number, dots left out; null if there is none."""
    return F.nullif(F.replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"\d[\d.]*", 0), F.lit("."), F.lit("")), F.lit("")).try_cast("bigint")


def digits_to_int(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9-]", "").try_cast("int")


def parse_date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(F.trim(text), "yyyy-MM-dd"), F.try_to_date(F.trim(text), "dd/MM/yyyy"))


def html_escape(text: Column) -> Column:
    return replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")))


def sanitise(text: Column, most: int | None = None) -> Column:
    """Control characters off (not tab and line ends), trimmed, cut to ``most``."""
    out = _strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return out if most is None else F.substring(out, 1, most)


def file_name(text: Column) -> Column:
    """A safe file name: no folders, other characters than word characters, dots and hyphens to _, no dots at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^.*[/\\]", ""), r"[^\w.-]", "_"), r"^\.+|\.+$", "")


def clamp(text: Column, low: float, high: float, default: float) -> Column:
    value = text.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(float(default))).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


COURSE_CODE = r"\b[A-Z]{2,}[A-Z0-9]*\d[\dA-Z.]*\b"


def course_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), COURSE_CODE, 0), F.lit(""))


# Keyword families of teaching style, and chapter words.
STYLES = (
    ("định nghĩa", ("định nghĩa", "dinh nghia", "definition", "là gì", "la gi")),
    ("ví dụ", ("ví dụ", "vi du", "example", "vd:", "eg:", "e.g.")),
    ("bài tập", ("bài tập", "bai tap", "exercise", "problem", "câu hỏi", "cau hoi")),
    ("lý thuyết/chứng minh", ("chứng minh", "chung minh", "proof", "định lý", "dinh ly", "theorem")),
)
CHAPTERS = ("Chương", "Chuong", "Chapter", "Phần", "Phan", "Part")
SECTIONS = ("Mục", "Muc")


def any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def style_hint(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat_ws(" → ", *[F.when(any_of(low, words), F.lit(name)) for name, words in STYLES])
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("lý thuyết"))


def chapter(text: Column) -> Column:
    """What follows the first chapter or section number, words tried in order; at most 80 characters."""
    text = F.coalesce(text, F.lit(""))
    tries = [rf"(?iuU){w}\s+(\d+|[IVX]+)[.:\s]*([^\n]{{3,80}})" for w in CHAPTERS] + [rf"(?iuU){w}\s+(\d+[.\d]*)[.:\s]*([^\n]{{3,80}})" for w in SECTIONS]
    found = F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, 2)) for p in tries], F.lit(""))
    return F.substring(_strip(found), 1, 80)


def device(agent: Column) -> tuple[Column, Column]:
    """(browser, kind of device) of a user agent, tests in order."""
    low = F.lower(F.coalesce(agent, F.lit("")))
    name = F.lit("Unknown Browser")
    for word, browser in reversed((("chrome", "Chrome"), ("firefox", "Firefox"), ("safari", "Safari"), ("edge", "Edge"))):
        name = F.when(F.contains(low, F.lit(word)), browser).otherwise(name)
    kind = F.when(any_of(low, ("mobile", "android")), "mobile").when(any_of(low, ("tablet", "ipad")), "tablet").otherwise("desktop")
    return name, kind


def excerpt(text: Column, query_tokens: Column, otherwise: Column) -> Column:
    """The first sentence that holds a query token anywhere, else ``otherwise``."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), _strip), lambda s: s != "")
    hit = F.filter(sentences, lambda s: let(keep_d(s), lambda n: F.exists(query_tokens, lambda t: F.contains(n, t))))
    return F.coalesce(F.get(hit, F.lit(0)), otherwise, F.lit(""))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("int")
