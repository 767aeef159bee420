r"""Chat formatting by schema fingerprint.

A record is JSON in any of several layouts. Its fingerprint is the hash of its set of nested field paths (``messages[].role``),
and selects a declarative mapping: the one with the most required paths among those whose required paths the record has. A mapping
names where turns are, or which fields are which turn. The outcome for a fingerprint is remembered, so records of one layout
are matched once for each task. Canonical turns are then laid out in a template whose marks cannot occur in texts:

    <|im_start|>role\n text <|im_end|>\n

Control strings inside texts get one backslash after their first character (and after backslashes that stand there), which
the reverse takes away, so every text comes back as it was. The loss mask holds the spans, in code points, of the assistants' texts.

Defined results: a null record or one that no mapping fits has no turns and an empty layout; null texts and roles are
empty; empty turns are kept; turns with the same number are ordered by role, then text; a row without conversation id is a
conversation of its own; an empty table gives an empty result; other columns are not read. A conversation is one output record, so its turns
meet in one row, and the longest one bounds a task's memory; all others are spread by id.

The registered query has rows by turn, so it first writes each conversation as a record in one of the declared layouts, by its id (``records_of``); the
fingerprint alone tells the formatter which.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts: ``turns`` says which list holds the turns and which fields role and text; ``fields`` lists (role, fields joined by a blank line).
MAPPINGS = (
    {"name": "messages", "needs": ["messages[].role", "messages[].content"], "turns": ("messages", "role", "content")},
    {"name": "message parts", "needs": ["messages[].role", "messages[].content", "messages[].content[].text"], "turns": ("messages", "role", "content")},
    {"name": "conversations", "needs": ["conversations[].from", "conversations[].value"], "turns": ("conversations", "from", "value"), "first": [("system", ["system"])], "roles": True},
    {"name": "dialogue", "needs": ["dialogue[].speaker", "dialogue[].text"], "turns": ("dialogue", "speaker", "text")},
    {"name": "turns", "needs": ["turns[].role", "turns[].text"], "turns": ("turns", "role", "text")},
    {"name": "instruction", "needs": ["instruction", "output"], "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "instruction, response", "needs": ["instruction", "response"], "fields": [("system", ["system"]), ("user", ["instruction", "context"]), ("assistant", ["response"])]},
    {"name": "prompt, completion", "needs": ["prompt", "completion"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt, response", "needs": ["prompt", "response"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "prompt, chosen", "needs": ["prompt", "chosen"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["chosen"])]},
    {"name": "question, answer", "needs": ["question", "answer"], "fields": [("system", ["system"]), ("user", ["context", "question"]), ("assistant", ["answer"])]},
    {"name": "prompt messages", "needs": ["prompt[].role", "prompt[].content", "completion[].content"], "lists": [("prompt", "role", "content"), ("completion", "role", "content")]},
)

#: Names of roles in layouts with ``roles``; others keep the names they have.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

START, END = "<|im_start|>", "<|im_end|>"
# The first characters and the rest of strings that chat templates use as controls.
_TAIL = r"(?=\||/?s>|/?INST\]|/?SYS>>|/?(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>)"
_CONTROL = re.compile(r"([<\[]\\*)" + _TAIL)
_ESCAPED = re.compile(r"([<\[]\\*)\\" + _TAIL)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def paths(value, at: str = "") -> set[str]:
    """Nested field paths; a list adds [] and the paths of all its items."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in ({f"{at}.{k}".lstrip(".")} | paths(v, f"{at}.{k}".lstrip(".")))}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")}
    return set()


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


@lru_cache(maxsize=10_000)
def _mapping(print_: str, found: frozenset) -> dict | None:
    fits = [m for m in MAPPINGS if found.issuperset(m["needs"])]
    return max(fits, key=lambda m: len(m["needs"]), default=None)


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(_text(v.get("text") if isinstance(v, dict) else v) for v in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def canonical(record: str | None) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(fingerprint, name of the mapping or None, turns as (role, text))."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    found = frozenset(paths(value))
    print_ = fingerprint(found)
    mapping = _mapping(print_, found) if isinstance(value, dict) else None
    if mapping is None:
        return print_, None, []
    turns = []
    for role, fields in [*mapping.get("first", []), *mapping.get("fields", [])]:
        parts = [_text(value[f]) for f in fields if value.get(f) is not None]
        if role == "system" and not any(parts):
            continue
        turns.append((role, "\n\n".join(p for p in parts if p) if len(parts) > 1 else "".join(parts)))
    for where, role, text in [mapping["turns"]] if "turns" in mapping else mapping.get("lists", []):
        for turn in value.get(where) or ():
            if isinstance(turn, dict):
                name = _text(turn.get(role))
                turns.append((ROLES.get(name, name) if mapping.get("roles") else name, _text(turn.get(text))))
    return print_, mapping["name"], turns


def lay_out(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, spans of the assistants' texts in code points)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(_role_in(r), unescape(t)) for r, t in _TURN.findall(formatted)]


FORMAT_SCHEMA = "fingerprint string, mapping string, formatted string, loss array<struct<start:int,end:int>>"


def format_chats(records: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """(conv_id, fingerprint, mapping, formatted, loss), a row for each row of ``records`` (id, JSON)."""

    def scan(batches):
        for batch in batches:
            rows = []
            for record in batch.column("record"):
                print_, name, turns = canonical(record.as_py())
                rows.append((print_, name, *lay_out(turns)))
            prints, names, formatted, loss = zip(*rows, strict=True) if rows else ((),) * 4
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in loss], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(prints, pa.string()), pa.array(names, pa.string()), pa.array(formatted, pa.string()), spans],
                names=["conv_id", "fingerprint", "mapping", "formatted", "loss"],
            )

    id_type = records.schema[id_col].dataType.simpleString()
    return records.select(F.col(id_col).alias("conv_id"), F.col(record_col).cast("string").alias("record")).mapInArrow(scan, f"conv_id {id_type}, {FORMAT_SCHEMA}")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, fingerprint, mapping), read back from the layout."""

    def scan(batches):
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = read_back(text)
                masked = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
                spoken = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column("fingerprint"), batch.column("mapping")],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fingerprint", "mapping"],
            )

    id_type = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(scan, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fingerprint string, mapping string")


#: Layouts in which ``records_of`` writes conversations, by id modulo their number; "prompt, completion" takes a question and its answer alone.
WRITTEN = ("messages", "message parts", "conversations", "dialogue", "turns", "prompt, completion")


def records_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, record): each conversation as JSON in the layout that its id says, turns in order."""
    said = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())  # no id: a group for each row
    talks = turns.groupBy("conv_id", own.alias("own")).agg(F.sort_array(F.collect_list(said)).alias("said"))
    items = lambda **fields: F.transform("said", lambda x: F.struct(*[value(x).alias(name) for name, value in fields.items()]))
    role, text = lambda x: x["role"], lambda x: x["text"]
    half = lambda x: F.floor(F.length(x["text"]) / 2).cast("int")
    parts = lambda x: F.array(F.struct(F.lit("text").alias("type"), F.substring(x["text"], F.lit(1), half(x)).alias("text")), F.struct(F.lit("text").alias("type"), F.substring(x["text"], half(x) + 1, F.length(x["text"])).alias("text")))
    speaker = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
    layout = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(WRITTEN)))
    one = lambda name, value: F.to_json(F.struct(value.alias(name)))
    record = (
        F.when(layout == 1, one("messages", items(role=role, content=parts)))
        .when((layout == 2) & ~F.exists("said", lambda x: x["role"].isin(*ROLES)), one("conversations", items(**{"from": speaker, "value": text})))
        .when(layout == 3, one("dialogue", items(speaker=role, text=text)))
        .when(layout == 4, one("turns", items(role=role, text=text)))
        .when((layout == 5) & (F.array_join("said.role", " ") == "user assistant") & (F.size("said") == 2), F.to_json(F.struct(F.col("said.text")[0].alias("prompt"), F.col("said.text")[1].alias("completion"))))
        .otherwise(one("messages", items(role=role, content=text)))
    )
    return talks.select("conv_id", record.alias("record"))


def op4_chat_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(records_of(rows.unionByName(more))))


_PRINTS = {
    name: fingerprint(paths(example))
    for name, example in {
        "messages": {"messages": [{"role": "", "content": ""}]}, "message parts": {"messages": [{"role": "", "content": [{"type": "", "text": ""}]}]}, "conversations": {"conversations": [{"from": "", "value": ""}]},
        "dialogue": {"dialogue": [{"speaker": "", "text": ""}]}, "turns": {"turns": [{"role": "", "text": ""}]}, "prompt, completion": {"prompt": "", "completion": ""},
    }.items()
}
_NAMED = ", ".join(f"'{r}'" for r in ROLES)

OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[]\\*)(\||/?s>|/?INST\]|/?SYS>>|/?(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>)', '\1!\2', 'g')) AS laid FROM c
), g AS (
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + laid + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  CASE ((coalesce(conv_id, 0) % 6) + 6) % 6 WHEN 1 THEN 'message parts' WHEN 2 THEN CASE WHEN bool_or(role IN (@named)) THEN 'messages' ELSE 'conversations' END WHEN 3 THEN 'dialogue' WHEN 4 THEN 'turns'
    WHEN 5 THEN CASE WHEN count(*) = 2 AND string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text) = 'user assistant' THEN 'prompt, completion' ELSE 'messages' END ELSE 'messages' END AS mapping
FROM e GROUP BY conv_id, own
) SELECT *, CASE mapping @prints END AS fingerprint FROM g
""".replace("@named", _NAMED).replace("@prints", " ".join(f"WHEN '{n}' THEN '{f}'" for n, f in _PRINTS.items()))
