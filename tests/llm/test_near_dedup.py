import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import near_dedup as nd


def brute(texts):
    """Classes by all pairs: multiset shingle similarity of 0.8 or more."""

    def shingles(text):
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if not union or sum((sets[i] & sets[j]).values()) >= 0.8 * union:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for size in (60, 150, 150, 400, 1200):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(12):
            copy = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, size // 100])):
                at = rng.randrange(len(copy))
                edit = rng.random()
                if edit < 0.5:
                    copy[at] = rng.choice(vocab)
                elif edit < 0.75:
                    copy.insert(at, rng.choice(vocab))
                else:
                    del copy[at]
            texts.append(" ".join(copy))
        texts.append(" ".join(rng.choice(vocab) for _ in range(size)))
    texts += [texts[0].upper(), texts[1], "a b", "a b", "a b c", "A  B", "", None, "x " * 300, "x " * 301, "x " * 100, "y" * 50_000]
    return texts


def test_equals_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s", b"k", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, key binary, node int")
    rows = {r.doc_id: r for r in nd.near_classes(docs).collect()}
    want = brute(texts)
    got = [rows[i].class_id for i in range(len(texts))]
    assert got == want
    sizes = Counter(want)
    assert all(rows[i].class_size == sizes[want[i]] and rows[i].kept == (want[i] == i) for i in range(len(texts)))


def test_short_texts_at_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for i in range(300):
        words = [f"{rng.choice('abc')}{i}.{j}" for j in range((9, 13, 53)[i % 3])]
        texts += [" ".join(words), " ".join(words[:-1] if i % 3 == 0 else words[: -((len(words) - 4) // 5)])]
    shared = [f"s{j}" for j in range(12)]  # common to all, but not enough to link them
    texts += [" ".join([f"x{i}", f"y{i}", f"z{i}", *shared, f"e{i}"]) for i in range(60)]
    rows = nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i - i % 2 if i < 600 else i for i in range(len(texts))}


@pytest.mark.parametrize(("low", "high", "least"), [(0.80, 0.82, 0.97), (0.85, 0.9, 0.995)])
def test_recall_of_planted_pairs(low, high, least):
    """The share of pairs of long texts, by similarity, that meet in a band."""
    rng = random.Random(int(high * 100))
    found = []
    while len(found) < 400:
        base = [f"w{rng.randrange(5_000)}" for _ in range(rng.randrange(120, 400))]
        copy = base[:]
        for _ in range(rng.randrange(1, max(2, len(base) // 30))):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(5_000)}"
        a, b = (set(zip(*[w[i:] for i in range(5)])) for w in (base, copy))
        if low <= len(a & b) / len(a | b) < high:
            _, _, keys, _ = nd.sketch(pa.array([" ".join(base), " ".join(copy)]))
            found.append(bool((keys[0] == keys[1]).any()))
    assert np.mean(found) >= least


def test_open_bucket_of_many_classes(spark):
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(400)]
    texts = [" ".join(shared + [f"own{i}.{j}" for j in range(160)]) for i in range(40)]
    texts += [t + f" end{i}" for i, t in enumerate(texts[:10])]
    rng.shuffle(texts)
    rows = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (7, None)], "doc_id long, text string")
    got = sorted(map(tuple, nd.near_classes(docs).collect()), key=str)
    assert got == sorted([(None, 5, 3, 1, False), (5, 5, 3, 1, True), (5, 5, 3, 1, True), (7, 7, 1, 1, True)], key=str)
    assert nd.near_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_alignment_counts_windows(edits):
    rng = random.Random(edits)
    a = np.array([rng.randrange(1 << 60) for _ in range(200)], np.uint64)
    b = a.copy()
    for i in range(edits):
        b[20 + 50 * i] = 7 + i
    assert nd.aligned_windows(a, b, 20) == 196 - 5 * edits
    moved = np.concatenate([a[100:], a[:100]])
    assert nd.aligned_windows(a, moved, 10) == -1
    assert nd.aligned_windows(a, moved, 200) == 96
