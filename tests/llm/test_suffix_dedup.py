import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import suffix_dedup as sd
from quarry.llm.suffix_arrays import common_prefixes, suffix_arrays


def plain(texts, width):
    """(n_bytes, n_removed, n_spans, digest) by counting all windows."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def found(docs, **how):
    return [tuple(r) for r in sd.suffix_dedup(docs, **how).drop("kept").orderBy("doc_id").collect()]


def test_suffix_arrays_and_prefixes_against_sorting():
    rnd = random.Random(1)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(30)]
    texts += [b"", b"a" * 40, b"abc" * 20, b"mississippi", bytes(range(256))]
    sizes = np.array([len(t) + 1 for t in texts])
    array = np.zeros((sizes.max(), len(texts)), np.int16)
    for g, t in enumerate(texts):
        array[: len(t), g] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
    order = suffix_arrays(array, sizes)
    before, shared = common_prefixes(array, sizes, order, 7)
    for g, t in enumerate(texts):
        z = [x + 1 for x in t] + [0]
        want = sorted(range(len(z)), key=lambda i: z[i:])
        assert order[: len(z), g].tolist() == want
        for a, b in zip(want, want[1:]):
            k = 0
            while k < 7 and a + k < len(z) and b + k < len(z) and z[a + k] == z[b + k]:
                k += 1
            assert (before[b, g], shared[b, g]) == (a, k)


def corpus():
    rnd = random.Random(3)
    some = lambda letters, low, high: "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
    passages = [some("abcde é", 150, 700) for _ in range(5)]
    texts = [None, "", " " * 500, "ab" * 300, "x" * 199, "y" * 200, "y" * 200, "z" * 201, "日本語" * 90]
    texts += [some("abcdefgh ", 0, 400) + rnd.choice(passages)[rnd.randint(0, 50) :] + some("abcdefgh ", 0, 400) for _ in range(60)]
    return [*texts, *texts[20:24], " " * 70_000]


@pytest.mark.parametrize("most_pieces", [32, 2])
def test_against_all_windows(spark, most_pieces):
    """2 pieces a shard send nearly all shards through every level of longer strings."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs, most_pieces=most_pieces) == [(i, *x) for i, x in enumerate(plain(texts, 200))]


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(sd, "NARROW_ROWS", 0)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == [(i, *x) for i, x in enumerate(plain(texts, 200))]


def test_long_text_is_scanned_in_parts(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefghij") for _ in range(180_000))
    texts = [long[:100_000] + long[49_000:49_400] + long[100_000:], long[98_200:98_500], long[49_152:49_351]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == [(i, *x) for i, x in enumerate(plain(texts, 200))]


def test_one_passage_in_most_texts(spark):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefghijk ") for _ in range(260))
    texts = ["".join(rnd.choice("lmnopqrst ") for _ in range(150)) + passage + str(i) * 3 for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == [(i, *x) for i, x in enumerate(plain(texts, 200))]


def test_edges(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "q" * 250, 1, "k"), (7, "r" * 3, 2, "k"), (7, None, 3, "k")], "doc_id long, text string, k1 int, spans string")
    rows = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.suffix_dedup(docs).collect()}
    assert rows == {(None, 250, 250, 1, b""), (7, 3, 0, 0, b"rrr"), (7, 0, 0, 0, b"")}


def test_query_on_the_table(spark):
    from __spark_entry__ import queries

    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op13_suffix_dedup"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: x for r, x in zip(rows, plain([r.text for r in rows], 200))}
