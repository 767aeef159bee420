"""Words, lines and their hashes for whole Arrow batches of texts, in numpy.

The texts of a batch lie in one UTF-8 buffer; every step is a pass over that buffer, in pieces of about
``PIECE`` bytes so that a task's memory doesn't depend on batch size. A text longer than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BREAK = _SPACE
_LINE_BREAK = np.zeros(256, bool)
_LINE_BREAK[10] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


@dataclass
class Tokens:
    """Tokens (words or lines) of some texts, in order; ``doc`` holds the number of each token's text."""

    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # for each text the number of its first token, and one more


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in these and the end); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tokens(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _WORD_BREAK) -> Tokens:
    """Runs of bytes that are not breaks, within the texts that ``offsets`` delimits."""
    inside = ~breaks[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    at = np.cumsum(length) - length
    if len(start):
        pos = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
        power = np.full(int(length.max()), BASE, np.uint64)
        power[0] = 1
        value = _BYTE[data[inside]] * np.multiply.accumulate(power)[pos]
        hashed = mix64(np.add.reduceat(value, at) + length.astype(np.uint64) * GOLDEN)
    else:
        hashed = np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Tokens(start, length, hashed, doc, first)


def words(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    return tokens(data, offsets, _WORD_BREAK)


def lines(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    r"""Lines between \n that are not empty."""
    return tokens(data, offsets, _LINE_BREAK)


def counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``flags`` (one for each byte or token) in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def char_starts(data: np.ndarray) -> np.ndarray:
    """True where a code point starts."""
    return (data & 0xC0) != 0x80


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` consecutive tokens, ignoring where texts end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out = mix64(out * BASE + hashes[i : n + i])
    return out


def repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is an earlier equal hash in the same text, is any other) for each item; items are in text order."""
    key = mix64(hashes ^ (doc.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    earlier, any_other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order] = same
    follow = np.zeros(len(key), bool)
    follow[:-1] = same[1:]
    any_other[order] = same | follow
    return earlier, any_other
