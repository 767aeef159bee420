"""Classification by ordered rules and by counted keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# Phrases that route a question, without accents.
GREETINGS = ("hi", "hello", "hey", "chao", "xin chao", "chao ban", "alo", "cam on", "thanks", "thank you")
EVALUATION = ("danh gia hoc phan", "quy dinh danh gia", "qd 2004", "quy dinh 2004", "diem thuong xuyen", "diem giua ky", "diem cuoi ky", "thi cuoi ky", "cham thi", "phuc khao", "danh gia diem", "thang diem")
LECTURE = ("bai giang", "tai lieu mon", "giai bai tap", "huong dan giai", "vi du", "cach lam", "bai tap ve nha", "on thi", "noi dung mon")
EXERCISE = (
    "giai bai", "tinh toan", "tinh", "chung minh", "tim", "xac dinh", "viet code", "lap trinh", "thuat toan", "cong thuc", "dao ham", "tich phan", "ma tran", "vector", "phuong trinh",
    "bat phuong trinh", "he phuong trinh", "cau hoi", "bai tap", "bai toan", "problem", "exercise", "calculate", "solve", "proof", "code",
)
LECTURER = ("giang vien", "giao vien", "can bo", "co van hoc tap", "lich coi thi", "lich day", "nghien cuu khoa hoc", "nckh", "de tai", "bai bao", "hoi thao")
CATALOGUE = ("mon hoc", "hoc phan", "chuong trinh dao tao", "tin chi", "tien quyet", "ngon ngu giang day", "hoc ky", "cu nhan", "ky su")
FORM = ("bieu mau", "mau don", "tao don", "lam don", "dien don", "tao bieu mau", "mau xac nhan", "mau giay")
PROCEDURE = ("thu tuc", "quy trinh", "ho so", "dieu kien", "cac buoc", "bao luu", "xac nhan sinh vien", "mien giam hoc phi", "rut hoc phan", "hoc lai", "cai thien diem", "thuc tap", "hoan nghia vu hoc tap")
KNOWLEDGE = ("dang ky hoc phan", "hoc bong", "hoc vu", "quy che", "so tay sinh vien", "giay xac nhan", "bao luu", "thuc tap", "mien giam hoc phi", "rut hoc phan", "hoc lai", "tuyen sinh")
TUITION = ("hoc phi", "muc thu", "tin chi", "khoi nganh", "cao hoc", "lien thong", "chat luong cao", "clc", "quy mo nho", "thanh toan hoc phi")
ATTACHED = ("tep dinh kem", "anh de ban phan tich")
CODE = r"\b[a-z]{2,}[a-z0-9]*\d[\d.a-z]*\b"

# Fixed values: (intent, reason, tool) in order of precedence.
ROUTES = (
    ("casual", "short greeting or conversational opener", None),
    ("course_evaluation", "course evaluation regulation lookup", "search_course_evaluation_rules"),
    ("lecture_qa", "lecture content or exercise solving request", "search_lecture_knowledge"),
    ("exercise_solving", "explicit exercise solving request", "search_lecture"),
    ("lecturer_qa", "lecturer-specific question", "search_lecturer_knowledge_base"),
    ("course_catalog", "curriculum or course catalog lookup", "search_course_catalog"),
    ("form_fill", "explicit form/template creation request", "generate_form"),
    ("procedure_workflow", "administrative procedure question", "build_procedure_workflow"),
    ("tuition_lookup", "tuition or tabular fee lookup request", "search_student_knowledge"),
    ("attachment_qa", "question primarily grounded in current-turn attachments", None),
    ("knowledge_qa", "school knowledge question", "search_student_knowledge"),
    ("attachment_qa", "generic attachment-driven query", None),
    ("casual", "fallback conversational route", None),
)


def route(text: Column, attachment: Column | None = None) -> Column:
    """struct(intent, reason, tool) of a question: the first rule that holds."""
    return T.let(T.fold_d(text), lambda n: _route(n, text, attachment))


def _route(n: Column, text: Column, attachment: Column | None) -> Column:
    attached = T.any_of(n, ATTACHED) if attachment is None else attachment | T.any_of(n, ATTACHED)
    knowledge = T.any_of(n, KNOWLEDGE)
    rules = (
        F.regexp_replace(n, r"(?U)\s+", " ").isin(*GREETINGS), T.any_of(n, EVALUATION), T.any_of(n, LECTURE), T.any_of(n, EXERCISE), T.any_of(n, LECTURER),
        T.any_of(n, CATALOGUE) | n.rlike(CODE), T.any_of(n, FORM) & (T.any_of(n, PROCEDURE) | knowledge), T.any_of(n, PROCEDURE), T.any_of(n, TUITION),
        attached & ~knowledge, knowledge | F.contains(F.coalesce(text, F.lit("")), F.lit("?")), attached, F.lit(True),
    )
    out = None
    for rule, (intent, reason, tool) in zip(rules, ROUTES, strict=True):
        value = F.struct(F.lit(intent).alias("intent"), F.lit(reason).alias("reason"), F.lit(tool).cast("string").alias("tool"))
        out = F.when(rule, value) if out is None else out.when(rule, value)
    return out


# Words that count for a subject, in the order in which ties are settled.
SUBJECT_WORDS = (
    ("toan", ("đạo hàm", "tích phân", "ma trận", "phương trình", "giới hạn", "hàm số", "đồ thị", "số phức")),
    ("vat_ly", ("cơ học", "điện trường", "mạch điện", "quang học", "nhiệt động", "sóng", "lực", "vận tốc")),
    ("hoa_hoc", ("phản ứng", "mol", "este", "anken", "ankhan", "điện phân", "acid", "base")),
    ("lap_trinh", ("python", "java", "c++", "code", "lập trình", "thuật toán", "hàm", "biến", "class")),
    ("csdl", ("sql", "query", "database", "bảng", "khóa chính", "select", "insert", "update")),
    ("mang", ("tcp/ip", "http", "routing", "switch", "firewall", "giao thức", "mạng")),
    ("ai", ("machine learning", "deep learning", "neural", "học máy", "mô hình", "training")),
    ("web", ("html", "css", "javascript", "frontend", "backend", "react", "api", "web")),
)


def subject(text: Column) -> Column:
    """The subject with the most words in the text, the first of equals; "khac" without any."""
    return T.let(F.lower(F.coalesce(text, F.lit(""))), _subject)


def _subject(low: Column) -> Column:
    counted = []
    for place, (name, words) in enumerate(SUBJECT_WORDS):
        hits = F.lit(0)
        for word in words:
            hits = hits + F.when(F.contains(low, F.lit(word)), 1).otherwise(0)
        counted.append(F.struct(hits.alias("hits"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*counted))
    return F.when(best["hits"] > 0, best["name"]).otherwise(F.lit("khac"))


# Tools whose empty answers lead on, and the intent without which an empty search doesn't.
CATALOGUE_TOOL, PROCEDURE_TOOL, KNOWLEDGE_TOOL, FEES_INTENT = "search_course_catalog", "build_procedure_workflow", "search_student_knowledge", "tuition_lookup"


def fallback_tool(tool: Column, results: Column, matched: Column, seen: Column, intent: Column) -> Column:
    """The tool to try after ``tool`` gave nothing; null if there is none, or if it is among those ``seen`` since the question.

    An empty catalogue or an unmatched procedure leads to the knowledge search, an empty search to the procedures if fees were asked for. Unknown results lead nowhere.
    """
    following = (
        F.when((tool == CATALOGUE_TOOL) & (results == 0), F.lit(KNOWLEDGE_TOOL)).when((tool == PROCEDURE_TOOL) & ~matched, F.lit(KNOWLEDGE_TOOL))
        .when((tool == KNOWLEDGE_TOOL) & (results == 0) & (intent == FEES_INTENT), F.lit(PROCEDURE_TOOL))
    )
    return F.when(~F.array_contains(seen, following), following)


def fallback_chain(rows: DataFrame, tool: str = "tool", outcomes: str = "outcomes", intent: str = "intent") -> DataFrame:
    """Adds ``chain``: all tools of a question in order, from the first to the one that leads nowhere.

    ``outcomes`` maps a tool to what it gives: struct(result_count, matched). A tool is tried once, so three steps reach every end; each is a projection of the row.
    """
    out = rows.withColumn("chain", F.when(F.col(tool).isNotNull(), F.array(tool)).otherwise(F.array().cast("array<string>")))
    for _ in range(2):
        last = F.try_element_at("chain", F.lit(-1))
        found = F.try_element_at(F.col(outcomes), last)
        following = F.when(F.size("chain") > 0, fallback_tool(last, found["result_count"], found["matched"], F.col("chain"), F.col(intent)))
        out = out.withColumn("chain", F.concat("chain", F.array_compact(F.array(following))))
    return out
