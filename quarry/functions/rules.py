"""Rules over short texts as Column expressions: repair of recognised text, tuition tags, subjects, tracks, signatures and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

# What text recognition makes of some words, and the words, replaced in this order.
MISREAD = (
    ("chatA luong", "chat luong"), ("vira", "vua"), ("ngw", "ngu"), ("mire", "muc"), ("tii", "tu"), ("ttr", "tu"), ("trdâ€™ve", "tro ve"), ("trd've", "tro ve"), ("giao due", "giao duc"),
)
# Track tags with the slugs that give them, and what basis slugs give.
TRACK_SLUGS = (
    ("cao_hoc", ("cao-hoc", "thac-si")), ("chat_luong_cao", ("chat-luong-cao", "clc", "tien-tien")), ("tien_tien", ("tien-tien",)), ("lien_thong", ("lien-thong",)),
    ("bang_2", ("bang-2",)), ("vua_lam_vua_hoc", ("vua-lam-vua-hoc",)), ("the_chat_quoc_phong", ("giao-duc-the-chat", "quoc-phong")),
)
CREDIT_SLUGS = ("theo-tin-chi", "dao-tao-dai-hoc-he-chinh-quy", "chat-luong-cao", "lien-thong", "bang-2")
FULL_PROGRAM_FROM = 10_000_000
# Words that a tag adds to the text that is searched.
TAG_WORDS = (
    ("chinh_quy", "chinh quy dai hoc"), ("chat_luong_cao", "chat luong cao clc"), ("tien_tien", "tien tien"), ("lien_thong", "lien thong"), ("bang_2", "bang 2"),
    ("vua_lam_vua_hoc", "vua lam vua hoc"), ("the_chat_quoc_phong", "giao duc the chat quoc phong"), ("cao_hoc", "cao hoc thac si"),
    ("per_credit", "tin chi 1 tin chi"), ("full_program", "toan khoa tron khoa"),
)
# Parts of a file name that give its subject, in order, and names of subjects.
FILE_SUBJECTS = (
    ("toan", ("toan", "math", "calculus", "algebra", "giai tich", "dai so")), ("vat_ly", ("vat ly", "physics", "co hoc", "dien", "quang")), ("hoa_hoc", ("hoa", "chemistry", "chem")),
    ("lap_trinh", ("lap trinh", "programming", "code", "python", "java", "c++", "javascript")), ("csdl", ("csdl", "database", "sql", "dbms")), ("mang", ("mang", "network", "networking", "tcp/ip")),
    ("ai", ("ai", "artificial intelligence", "machine learning", "ml", "deep learning")), ("web", ("web", "html", "css", "frontend", "backend")),
)
NAMED_SUBJECTS = (
    ("toan", ("toan", "math", "calculus", "algebra", "giai tich", "dai so")), ("vat_ly", ("vat ly", "physics", "co hoc")), ("hoa_hoc", ("hoa", "chemistry")),
    ("lap_trinh", ("lap trinh", "programming", "code", "python", "java", "c++")), ("csdl", ("csdl", "database", "sql", "dbms")), ("mang", ("mang", "network", "networking", "tcp/ip")),
    ("ai", ("ai", "artificial intelligence", "machine learning", "ml", "deep learning", "hoc may")), ("web", ("web", "html", "css", "frontend", "backend")),
)
# Subjects that are looked for in talk, and roles of sheets by their names.
SPOKEN_SUBJECTS = ("toán", "lý", "hóa", "lập trình", "cơ sở dữ liệu", "mạng máy tính")
SHEET_ROLES = (
    ("course_catalog_flat", ("du lieu",)), ("course_catalog_summary", ("tong quan",)), ("course_catalog_semester_layout", ("cu nhan", "ky su")), ("course_catalog_glossary", ("ghi chu",)),
)
ACADEMIC = ("lecture_qa", "exercise_solving", "knowledge_qa", "attachment_qa")


def repaired(text: Column) -> Column:
    """Words that recognition misread put right, white space collapsed."""
    return T._strip(F.regexp_replace(T.replaced(T._strip(F.coalesce(text, F.lit(""))), MISREAD), r"(?U)\s+", " "))


def _first_of(text: Column, table, otherwise: str | None, test) -> Column:
    out = F.lit(otherwise)
    for name, words in reversed(table):
        out = F.when(test(text, words), F.lit(name)).otherwise(out)
    return out


def tuition_tags(title: Column, label: Column, amount: Column) -> tuple[Column, Column]:
    """(tracks, basis) of a tuition row, arrays in the order of the rules; a row without a track is a regular one."""
    slug = T.slug(F.concat_ws(" ", title, label, amount))
    named = lambda s: F.array_compact(F.array(*[F.when(T.any_of(s, words), F.lit(tag)) for tag, words in TRACK_SLUGS]))
    tracks = T.let(T.let(slug, named), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("chinh_quy"))))

    def billed(s: Column) -> Column:
        graduate = F.contains(s, F.lit("cao-hoc"))
        credit = T.any_of(s, CREDIT_SLUGS) | (graduate & T.any_of(s, ("1-1", "1-2", "1-3")))
        whole = graduate | (F.coalesce(T.amount_value(amount), F.lit(0)) >= FULL_PROGRAM_FROM)
        return F.when(credit, F.lit("per_credit")).when(whole, F.lit("full_program"))

    return tracks, F.array_compact(F.array(T.let(slug, billed)))


def tuition_text(title: Column, label: Column, amount: Column, tracks: Column, basis: Column) -> Column:
    """What is searched of a tuition row: its texts, "hoc phi", and the words of its tags."""
    words = F.create_map(*[F.lit(x) for pair in TAG_WORDS for x in pair])
    tags = F.transform(F.concat(tracks, basis), lambda t: F.coalesce(F.element_at(words, t), F.lit("")))
    return repaired(F.concat_ws(" ", title, label, amount, F.lit("hoc phi"), F.array_join(F.filter(tags, lambda w: w != ""), " ")))


def header_names(cells: Column) -> Column:
    """Column names of a header row: slugs with _; ``column_i`` for blanks; repeats get _2, _3."""
    tidy = F.transform(cells, lambda c, i: F.coalesce(F.nullif(T.tidy_space(c), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    keys = F.transform(tidy, lambda c: F.replace(T.slug(c), F.lit("-"), F.lit("_")))
    nth = lambda key, i: F.size(F.filter(F.slice(keys, F.lit(1), i + 1), lambda k: k == key))
    return F.transform(keys, lambda key, i: F.when(nth(key, i) > 1, F.concat_ws("_", key, nth(key, i).cast("string"))).otherwise(key))


def subject_of_file(name: Column) -> Column:
    return _first_of(F.lower(F.coalesce(name, F.lit(""))), FILE_SUBJECTS, "khac", T.any_of)


def subject_of_name(name: Column) -> Column:
    return _first_of(F.lower(T._strip(F.coalesce(name, F.lit("")))), NAMED_SUBJECTS, "khac", lambda t, words: t.isin(*words))


def spoken_subject(said: Column, answer: Column) -> Column:
    """The first subject that a question and its answer name; null if none."""
    text = F.lower(F.concat_ws(" ", F.coalesce(said, F.lit("")), F.coalesce(answer, F.lit(""))))
    return _first_of(text, [(s, (s,)) for s in SPOKEN_SUBJECTS], None, T.any_of)


def sheet_role(name: Column) -> Column:
    return _first_of(T.fold_d(name), SHEET_ROLES, "generic_sheet", lambda t, words: t.isin(*words))


def asked_track(query: Column) -> Column:
    n = T.fold_d(query)
    return F.when(F.contains(n, F.lit("ky su")), "ky_su").when(F.contains(n, F.lit("cu nhan")), "cu_nhan")


def asked_semester(query: Column) -> Column:
    return F.nullif(F.regexp_extract(T.fold_d(query), r"hoc ky\s*(\d+)", 1), F.lit("")).try_cast("int")


def with_subject(intent: Column, reason: Column, subject: Column) -> tuple[Column, Column]:
    """(reason, subject) of a routed question: only academic intents have a subject."""
    academic = intent.isin(*ACADEMIC)
    return F.when(academic, F.concat(reason, F.lit(" | Subject: "), subject)).otherwise(reason), F.when(academic, subject).otherwise(F.lit("khac"))


def hmac_sha256(text: Column, secret: bytes) -> Column:
    """Signature in lower-case hex: two hashes over binary strings, all in built-in functions."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def embedding_text(title: Column, category: Column, kind: Column, section: Column, summary: Column, keywords: Column, content: Column, most: int = 6000) -> Column:
    """The payload that is embedded: labelled lines, empty ones left out, ``most`` characters of the content."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    always = [F.concat(F.lit(f"{n}: "), F.coalesce(v, F.lit(""))) for n, v in (("Tieu de", title), ("Danh muc", category), ("Loai nguon", kind))]
    named = F.array_join(F.filter(keywords, lambda k: k.isNotNull() & (k != "")), ", ")
    return T._strip(F.concat_ws("\n", *always, line("Muc", section), line("Tom tat", summary), line("Tu khoa", named), line("Noi dung", F.substring(content, 1, most))))


def nine_decimals(x: Column) -> Column:
    """A float as printf writes it with %.9f: by its exact value, ties to even. Java's formatter rounds the shortest digits that name a number, ties up.

    A float of 24 bits times 10^9 is exact in a double. From 2^23 on floats are whole, from 2^63 on they are left to Java; so are doubles that are no floats.
    """
    d = x.cast("double")
    size = F.abs(d)
    scaled = F.rint(size * 1e9).cast("long")
    small = F.concat(((scaled - F.pmod(scaled, F.lit(10**9))) / F.lit(10**9)).cast("long").cast("string"), F.lit("."), F.lpad(F.pmod(scaled, F.lit(10**9)).cast("string"), 9, "0"))
    digits = F.when(size < 2.0**23, small).when(size < 2.0**63, F.concat(size.cast("long").cast("string"), F.lit(".000000000")))
    sign = F.when(d.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    other = F.when(F.isnan(d), F.lit("nan")).when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(d.isNotNull(), F.format_string("%.9f", d))
    return F.coalesce(F.when(d == d.cast("float").cast("double"), F.concat(sign, digits)), other)


def vector_literal(vector: Column) -> Column:
    """[x,y,...] with nine decimals; null elements are left out."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, nine_decimals), ","), F.lit("]"))


def listed(values: Column) -> Column:
    """Values joined by "; ", or "Khong co" if there is none."""
    return F.coalesce(F.nullif(F.array_join(values, "; "), F.lit("")), F.lit("Khong co"))
