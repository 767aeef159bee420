"""Fragments of DuckDB SQL that say what the Column functions do."""

from __future__ import annotations

from quarry.functions.text import ROMAN, STOPWORDS


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def keep_d(x: str) -> str:
    return f"trim(lower(strip_accents(coalesce({x}, ''))))"


def fold_d(x: str) -> str:
    return f"trim(replace(lower(strip_accents(coalesce({x}, ''))), 'đ', 'd'))"


def ascii_only(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({keep_d(x)}, '[a-z0-9_]+'), lambda t: (length(t) > 1 OR t IN ({words(ROMAN)})) AND t NOT IN ({words(STOPWORDS)}))"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({fold_d(x)}, '[^a-z0-9]+'), lambda t: t <> ''))"


def phrases(t: str) -> str:
    pair = f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    triple = f"list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2])"
    return f"list_distinct(list_concat({pair}, {triple}))"


def summary(x: str, limit: int = 240) -> str:
    flat = f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE trim(regexp_replace(substr({flat}, 1, {limit}), ' [^ ]*$', '')) || '...' END"


def any_of(x: str, values) -> str:
    return "(" + " OR ".join(f"contains({x}, {words([v])})" for v in values) + ")"


CORPUS = f"""corpus AS (
  SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, lang AS category, source AS source_kind, text AS content, {summary('text')} AS summary, [lang, source] AS keywords FROM documents
)"""

QUESTIONS = """questions AS (
  SELECT item_id AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query FROM benchmark
)"""

FEATURES = f"""{CORPUS}, {QUESTIONS}, f AS (
  SELECT *, {keep_d('title')} AS n_title, {keep_d('summary')} AS n_summary, {keep_d('content')} AS n_content, array_to_string(list_transform(keywords, lambda k: {keep_d('k')}), ' ') AS n_keywords,
    {tokens('title')} AS s_title, {tokens('summary')} AS s_summary, {tokens('content')} AS s_content, list_distinct({tokens("array_to_string(keywords, ' ')")}) AS t_keywords, list_distinct({tokens('category')}) AS t_category FROM corpus
), g AS (
  SELECT *, list_distinct(s_title) AS t_title, list_distinct(s_summary) AS t_summary, list_distinct(s_content) AS t_content, array_to_string(s_title, ' ') AS p_title, array_to_string(s_summary, ' ') AS p_summary, array_to_string(s_content, ' ') AS p_content FROM f
), asked AS (
  SELECT query_id, query, {keep_d('query')} AS q, list_distinct(s) AS q_tokens, {phrases('s')} AS q_phrases FROM (SELECT *, {tokens('query')} AS s FROM questions)
), scored AS (
  SELECT g.*, asked.*,
    CASE WHEN q <> '' AND contains(n_title, q) THEN 12 ELSE 0 END + CASE WHEN q <> '' AND contains(n_keywords, q) THEN 10 ELSE 0 END + CASE WHEN q <> '' AND contains(n_summary, q) THEN 8 ELSE 0 END + CASE WHEN q <> '' AND contains(n_content, q) THEN 5 ELSE 0 END
    + 5 * len(list_intersect(q_tokens, t_title)) + 4 * len(list_intersect(q_tokens, t_category)) + 4 * len(list_intersect(q_tokens, t_keywords)) + 3 * len(list_intersect(q_tokens, t_summary)) + len(list_intersect(q_tokens, t_content))
    + (len(list_intersect(q_tokens, list_concat(t_title, t_category, t_keywords, t_summary, t_content))) ** 3)::BIGINT
    + 9 * len(list_filter(q_phrases, lambda p: contains(p_title, p))) + 6 * len(list_filter(q_phrases, lambda p: contains(p_summary, p))) + 4 * len(list_filter(q_phrases, lambda p: contains(p_content, p))) AS score
  FROM g, asked
)"""
