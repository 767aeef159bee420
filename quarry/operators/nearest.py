"""Stated query vectors against all rows, in numpy inside the tasks that hold the rows.

Products are summed component by component in doubles, in the order of ``vectors.dot``: the figures are those of the Column functions, to the last bit, and don't depend on how rows lie in batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and queries that are compared at once: what a step holds fits into a core's cache.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 1_000, 128


def by_length(vectors) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, components (transposed, as doubles) and norms by length of the vectors that are comparable: not null, without null components."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    offsets, values = lists.offsets.to_numpy(), lists.values
    missing = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (missing[offsets[1:]] == missing[offsets[:-1]])
    length, flat, out = np.diff(offsets), values.to_numpy(zero_copy_only=False), {}
    for n in np.unique(length[whole]):
        places = np.flatnonzero(whole & (length == n))
        parts = np.ascontiguousarray(flat[offsets[places][None, :] + np.arange(n)[:, None]])
        norms = np.zeros(len(places))
        for part in parts:
            norms += part * part
        out[int(n)] = places, parts, np.sqrt(norms)
    return out


def similarities(asked: dict, n_asked: int, rows: dict, n_rows: int) -> np.ndarray:
    """Cosine of each query with each row; 0 where one is missing or zero, or lengths differ."""
    out = np.zeros((n_asked, n_rows))
    for n, (q_places, q_parts, q_norms) in asked.items():
        if n not in rows:
            continue
        places, parts, norms = rows[n]
        for start in range(0, len(places), ROWS_AT_ONCE):
            near = slice(start, start + ROWS_AT_ONCE)
            total = np.zeros((len(q_places), len(places[near])))
            product = np.empty_like(total)
            for q, part in zip(q_parts, parts[:, near], strict=True):
                np.multiply(q[:, None], part[None, :], out=product)
                total += product
            size = q_norms[:, None] * norms[None, near]
            fits = (q_norms[:, None] != 0) & (norms[None, near] != 0)
            out[np.ix_(q_places, places[near])] = np.where(fits, np.divide(total, size, where=fits, out=product), 0.0)
    return out


def _equal(asked, rows) -> np.ndarray:
    """Where a query's value equals a row's; null equals nothing."""
    known = pc.unique(asked.drop_null()).cast(rows.type)
    code = lambda values, other: pc.fill_null(pc.index_in(values.cast(rows.type), value_set=known), other).to_numpy(zero_copy_only=False)
    return code(asked, -1)[:, None] == code(rows, -2)[None, :]


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Which allowed scores are the ``k`` largest of their line; NaN before all, equal ones from the left."""
    key = np.where(allowed, np.where(np.isnan(scores), np.inf, scores), -np.inf)
    if key.shape[1] <= k:
        return allowed
    least = np.partition(key, key.shape[1] - k, axis=1)[:, -k, None]
    above, level = key > least, key == least
    return allowed & (above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def scan(block: pa.Table, k: int | None, same: bool, unless, itself: bool):
    """A function for ``mapInArrow`` over (vec_id, embedding[, same]): the pairs (query_id, vec_id, similarity) of ``block`` (query_id, q_embedding[, q_same])
    and each batch, all of them or, with ``k``, those that can still be among a query's first ``k``."""

    def run(batches):
        parts = []
        for start in range(0, block.num_rows, QUERIES_AT_ONCE):
            part = block.slice(start, QUERIES_AT_ONCE).combine_chunks()
            column = lambda name, part=part: pa.concat_arrays(part.column(name).chunks)
            labels = column("q_same") if same else None
            free = None if labels is None else labels.is_null().to_numpy(zero_copy_only=False)
            if free is not None and unless is not None:
                free = free | pc.fill_null(pc.equal(labels, pa.scalar(unless, labels.type)), False).to_numpy(zero_copy_only=False)
            parts.append((column("query_id"), by_length(column("q_embedding")), labels, free))
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch.column("vec_id"), null_placement="at_start"))
            ids, rows = batch.column("vec_id"), by_length(batch.column("embedding"))
            for query_ids, asked, labels, free in parts:
                allowed = np.ones((len(query_ids), len(ids)), bool)
                if not itself:
                    allowed = ids.is_valid().to_numpy(zero_copy_only=False)[None, :] & query_ids.is_valid().to_numpy(zero_copy_only=False)[:, None] & ~_equal(query_ids, ids)
                if labels is not None:
                    allowed &= free[:, None] | _equal(labels, batch.column("same"))
                with np.errstate(all="ignore"):
                    scores = similarities(asked, len(query_ids), rows, len(ids))
                q, v = np.nonzero(allowed if k is None else best(scores, allowed, k))
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(v)), pa.array(scores[q, v])], names=["query_id", "vec_id", "similarity"])

    return run
