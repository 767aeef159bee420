"""Suffix arrays by induced sorting and permuted common prefixes, for many short strings at once.

A batch holds one string in each column of an array, padded below its end. Every step of the linear algorithm runs for all strings of the batch
together: suffixes are classified by comparison with their right neighbours, leftmost-smaller substrings are sorted by induction, named and,
where names repeat, sorted recursively, and the whole array is induced from their order. Numpy moves all columns one step at a time, so the cost
of a step is shared by the batch.
"""

from __future__ import annotations

import numpy as np


def _classify(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, leftmost): whether a suffix is smaller than its right neighbour, and whether it is the first of such a row."""
    longest, _ = text.shape
    smaller = np.zeros(text.shape, bool)
    last = sizes - 1
    right = np.zeros(text.shape[1], bool)
    for i in range(longest - 1, -1, -1):
        right = (text[i] < text[i + 1]) | ((text[i] == text[i + 1]) & right) if i + 1 < longest else right
        right = (right & (i < last)) | (i == last)
        smaller[i] = right
    leftmost = smaller.copy()
    leftmost[1:] &= ~smaller[:-1]
    leftmost[0] = False
    leftmost[last, np.arange(text.shape[1])] = True
    return smaller, leftmost


def _place(array: np.ndarray, text: np.ndarray, tails: np.ndarray, column: np.ndarray, position: np.ndarray) -> None:
    """Puts suffixes, given in ascending order by column and first character, at the ends of their buckets."""
    if not len(column):
        return
    width = text.shape[1]
    char = text[position, column].astype(np.int64)
    key = column.astype(np.int64) * (int(char.max()) + 1) + char
    change = np.flatnonzero(key[1:] != key[:-1])
    last = np.append(change, len(key) - 1)
    behind = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(len(key))
    slot = tails.ravel()[char * width + column] - 1 - behind
    array[slot, column] = position


def _induce(array: np.ndarray, text: np.ndarray, smaller: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> None:
    """From the leftmost-smaller suffixes in ``array`` all larger ones, left to right, then all smaller ones, right to left."""
    longest, width = text.shape
    flat, of, kind = array.ravel(), text.ravel(), smaller.ravel()
    columns = np.arange(width)
    for bucket, wanted, steps, move in ((heads.copy().ravel(), False, range(longest), 1), (tails.copy().ravel(), True, range(longest - 1, -1, -1), -1)):
        for i in steps:
            before = array[i]
            use = np.flatnonzero(before > 0)
            if not len(use):
                continue
            at = (before[use] - 1) * width + use
            right = kind[at] == wanted
            at, use = at[right], columns[use[right]]
            slot = of[at].astype(np.int64) * width + use
            to = bucket[slot] if move > 0 else bucket[slot] - 1
            flat[to * width + use] = at // width
            bucket[slot] += move


def _names(text: np.ndarray, leftmost: np.ndarray, column: np.ndarray, position: np.ndarray) -> np.ndarray:
    """For substrings sorted within each column: their rank, equal ones alike."""
    new = np.ones(len(column), bool)
    pair = np.flatnonzero(column[1:] == column[:-1]) + 1
    new[pair] = False
    longest = text.shape[0]
    step = 0
    while len(pair):
        a, b, c = position[pair - 1] + step, position[pair] + step, column[pair]
        inside = (a < longest) & (b < longest)
        a, b = np.minimum(a, longest - 1), np.minimum(b, longest - 1)
        end_a, end_b = leftmost[a, c] & (step > 0), leftmost[b, c] & (step > 0)
        differ = ~inside | (text[a, c] != text[b, c]) | (end_a != end_b)
        new[pair[differ]] = True
        pair = pair[~differ & ~end_a]
        step += 1
    total = np.cumsum(new)
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    return total - np.repeat(total[first], np.diff(np.append(first, len(column))))


def suffix_arrays(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``text`` (position, string): characters, each string ending in a 0 that occurs nowhere else in it; the arrays in the same shape, -1 below their ends."""
    longest, width = text.shape
    inside = np.arange(longest)[:, None] < sizes
    smaller, leftmost = _classify(text, sizes)
    alphabet = int(text.max()) + 1
    spot = np.flatnonzero(inside.ravel())
    counts = np.bincount(text.ravel()[spot].astype(np.int64) * width + spot % width, minlength=alphabet * width).reshape(alphabet, width)
    tails = np.cumsum(counts, axis=0)
    heads = tails - counts
    array = np.full(text.shape, -1, np.int64)
    column, position = np.nonzero(leftmost.T)
    order = np.argsort(column * alphabet + text[position, column], kind="stable")
    _place(array, text, tails, column[order], position[order])
    _induce(array, text, smaller, heads, tails)
    by_column = array.T
    lane, rank = np.nonzero((by_column >= 0) & leftmost[np.maximum(by_column, 0), np.arange(width)[:, None]])
    sorted_at = by_column[lane, rank]
    name = _names(text, leftmost, lane, sorted_at)
    many = np.bincount(column, minlength=width)
    first = np.cumsum(many) - many
    most = np.zeros(width, np.int64)
    np.maximum.at(most, lane, name + 1)
    if (most < many).any():
        named = np.zeros(text.shape, np.int64)
        named[sorted_at, lane] = name
        reduced = np.zeros((int(many.max()), width), np.int64)
        reduced[np.arange(len(column)) - first[column], column] = named[position, column]
        deeper = suffix_arrays(reduced, many).T
        lane, rank = np.nonzero(deeper >= 0)
        sorted_at = position[first[lane] + deeper[lane, rank]]
    array = np.full(text.shape, -1, np.int64)
    _place(array, text, tails, lane, sorted_at)
    _induce(array, text, smaller, heads, tails)
    return array


def common_prefixes(text: np.ndarray, sizes: np.ndarray, array: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, length) by text position: the suffix that precedes this one in the array, or -1, and the length of what they share, ``most`` at most."""
    width = text.shape[1]
    before, length = np.full(text.shape, -1, np.int64), np.zeros(text.shape, np.int64)
    rank, column = np.nonzero(array[1:] >= 0)
    before[array[rank + 1, column], column] = array[rank, column]
    flat, of, shared = before.ravel(), text.ravel(), length.ravel()
    column = np.arange(width)
    at, reach, ends = np.zeros(width, np.int64), np.zeros(width, np.int64), sizes.copy()
    while len(column):
        here = at * width + column
        left = flat[here]
        a, b = at + reach, left + reach
        same = (left >= 0) & (a < ends) & (b < ends) & (reach < most)
        same[same] = of[a[same] * width + column[same]] == of[b[same] * width + column[same]]
        stop = ~same
        shared[here[stop]] = reach[stop]
        reach = np.where(same, reach + 1, np.maximum(reach - 1, 0))
        at = at + stop
        live = at < ends
        if not live.all():
            column, at, reach, ends = column[live], at[live], reach[live], ends[live]
    return before, length
