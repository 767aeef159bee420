"""Stated questions against all entries, in numpy inside the tasks that hold the entries: shared tokens are counted for all questions at once, texts are compared only where a pair can still be among the best."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.functions.text import ROMAN, STOPWORDS
from quarry.operators.nearest import best

#: Questions of a block, and entries that are compared at once.
QUESTIONS_AT_ONCE, ENTRIES_AT_ONCE = 500, 2_000
NEVER = -(1 << 40)
#: White space as the Column functions have it.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_found = re.compile("[a-z0-9_]+").findall
_left_out = frozenset({*STOPWORDS, *"abcdefghijklmnopqrstuvwxyz0123456789_"} - ({*ROMAN} - {*STOPWORDS}))


def _sums(held: list[dict[int, float]], table: np.ndarray) -> np.ndarray:
    """For each entry's {line of ``table``: weight} the weighted sum of these lines, and their sum: (2, entries, columns). Sums are whole and below 2^24."""
    out = np.zeros((2, len(held), table.shape[1]), np.float32)
    for i, lines in enumerate(held):
        if lines:
            weights = np.ones((2, len(lines)), np.float32)
            weights[0] = list(lines.values())
            out[:, i] = weights @ table[list(lines)]
    return out


def points_scan(asked: pa.Table, k: int, tokens: dict[str, int], phrases: dict[str, int], whole: dict[str, int], bonus: dict[str, np.ndarray] | None = None):
    """A function for ``mapInArrow`` over entries (id, kind, normalised texts by field): (query_id, id, score) of the ``k`` best entries of a task for each question of
    ``asked`` (query_id, q, q_tokens, q_phrases), equal ones by id, with positive points alone.

    ``tokens``, ``phrases``, ``whole``: points by field; ``bonus``: further points of the questions by kind, NEVER where they may not meet. The points of tokens are a lower
    bound; with those that phrases and the whole question can bring they are an upper one.
    """

    def run(batches):
        ids_asked, questions = asked.column("query_id").combine_chunks(), asked.column("q").to_pylist()
        said, n = asked.column("q_phrases").to_pylist(), asked.num_rows
        sets = [set(t) for t in asked.column("q_tokens").to_pylist()]
        place = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        words, table = frozenset(place), np.zeros((len(place), n), np.float32)
        for j, wanted in enumerate(sets):
            table[[place[t] for t in wanted], j] = 1
        spare = np.array([sum(phrases.values()) * len(p) for p in said]) + np.array([sum(whole.values()) if q else 0 for q in questions])
        top: list[list[tuple]] = [[] for _ in range(n)]  # (-score, id)

        def meet(rows: pa.RecordBatch):
            texts = {f: rows.column(f).to_pylist() for f in tokens}
            ids, held = rows.column("id").to_pylist(), []
            for i in range(len(ids)):
                lines: dict[int, float] = {}
                for field, points in tokens.items():
                    for t in words.intersection(_found(texts[field][i])):
                        lines[place[t]] = lines.get(place[t], 0) + points
                held.append(lines)
            weighted, shared = _sums(held, table)
            shared = shared.astype(np.int64)
            base = weighted.astype(np.int64) + shared * shared * shared
            more = np.zeros_like(base) if bonus is None else np.stack([bonus.get(kind, np.full(n, NEVER)) for kind in rows.column("kind").to_pylist()])
            total = base + more

            texts_joined: dict[tuple[int, str], str] = {}

            def joined(i: int, field: str) -> str:
                if (i, field) not in texts_joined:
                    texts_joined[i, field] = " ".join([t for t in _found(texts[field][i]) if t not in _left_out])
                return texts_joined[i, field]

            least = np.partition(total, len(ids) - k, axis=0)[-k] if len(ids) >= k else np.full(n, NEVER)
            for j in range(n):
                floor = max(1, int(least[j]), -top[j][-1][0] if len(top[j]) == k else NEVER)
                likely = np.flatnonzero(total[:, j] + spare[j] >= floor)
                for i in likely[np.argsort(-total[likely, j], kind="stable")].tolist():
                    floor = max(floor, -top[j][-1][0] if len(top[j]) == k else NEVER)
                    if total[i, j] + spare[j] < floor:
                        break
                    score, left = int(total[i, j]), int(spare[j])
                    for field, points in whole.items():
                        score += points if questions[j] and questions[j] in texts[field][i] else 0
                    left -= sum(whole.values()) if questions[j] else 0
                    for field, points in phrases.items():  # short fields first, by PHRASE_POINTS
                        if score + left < floor:
                            break
                        text = joined(i, field)
                        score += points * sum([p in text for p in said[j]])
                        left -= points * len(said[j])
                    if score >= floor:
                        top[j] = sorted([*top[j], (-score, ids[i])])[:k]

        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for start in range(0, batch.num_rows, ENTRIES_AT_ONCE):
                meet(batch.slice(start, ENTRIES_AT_ONCE))
        found = [(j, -score, i) for j in range(n) for score, i in top[j]]
        if found:
            yield pa.RecordBatch.from_arrays([ids_asked.take(pa.array([j for j, _, _ in found], pa.int64())), pa.array([i for _, _, i in found], kind), pa.array([s for _, s, _ in found], pa.int64())], names=["query_id", "id", "score"])

    return run


def inside_scan(asked: pa.Table, k: int, least: float):
    """A function for ``mapInArrow`` over entries (id, body, own, fits): (query_id, hit, id, score) of the ``k`` best entries of a batch for each question of ``asked``
    (query_id, low, long_words), those that fit and have more than ``least`` points (hit), and all.

    Which long words a word of an entry holds is looked up once a task: a part is found by its first four characters.
    """

    def run(batches):
        ids_asked, lows, n = asked.column("query_id").combine_chunks(), asked.column("low").to_pylist(), asked.num_rows
        wanted = [w or [] for w in asked.column("long_words").to_pylist()]
        place = {p: i for i, p in enumerate(sorted({p for w in wanted for p in w}))}
        table, starts = np.zeros((len(place), 2 * n), np.float32), {}
        for j, parts in enumerate(wanted):
            for p in parts:
                table[place[p], j] += 10
                table[place[p], n + j] = 1
        for p in place:
            starts.setdefault(p[:4], []).append(p)
        needed = np.array([len(set(w)) for w in wanted])
        asks = np.array([low not in (None, "") for low in lows])

        @lru_cache(maxsize=1 << 18)
        def parts_of(word: str) -> tuple[int, ...]:
            return tuple({place[p] for i in range(len(word) - 3) for p in starts.get(word[i : i + 4], ()) if word.startswith(p, i)})

        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("id")))
            for start in range(0, batch.num_rows, ENTRIES_AT_ONCE):
                rows = batch.slice(start, ENTRIES_AT_ONCE)
                bodies = [b or "" for b in rows.column("body").to_pylist()]
                held = [dict.fromkeys((p for w in set(SPACE.split(b)) if len(w) > 3 for p in parts_of(w)), 1) for b in bodies]
                sums = _sums(held, table)[1].astype(np.float64)
                score, present = sums[:, :n], sums[:, n:]
                for i, j in np.argwhere((present == needed) & asks).tolist():
                    times = bodies[i].count(lows[j])
                    score[i, j] += 50 + 20 * times if times else 0
                own, fits = rows.column("own").to_numpy(zero_copy_only=False), rows.column("fits").to_numpy(zero_copy_only=False).astype(bool)
                total = score + own[:, None]
                for hit, allowed in ((True, (score > 0) & (total > least) & fits[:, None]), (False, np.ones(total.shape, bool))):
                    q, v = np.nonzero(best(total.T, allowed.T, k))
                    yield pa.RecordBatch.from_arrays([ids_asked.take(pa.array(q)), pa.array(np.full(len(q), hit)), rows.column("id").take(pa.array(v)), pa.array(total[v, q])], names=["query_id", "hit", "id", "score"])

    return run
