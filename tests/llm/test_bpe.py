import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe

PATH = bpe.default_vocabulary()
TRICKY = [
    None, "", " ", "Hello  WORLD", "it's 'twas can't ''s '!'d", "<|endoftext|>a<|startoftext|>", "<|endoftext|", "ÉÀ ñ ß Ǆ ŉ", "İstanbul ΣΑΣ",
    "é ạ̊", "１２ ½ ² x²y", "\x85a\xa0b c​d\x1ce\x00", "日本語テキスト 😀👍🏽", "ﬁ ﬂ ẞ", "_a_b__c", "a" * 3000, "the " * 500,
]


def reference(text):
    t = bpe.tokenizer(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("share", [1, 30, bpe.SHARE])
def test_equals_the_library(spark, share):
    rows = [(i, t) for i, t in enumerate(TRICKY * 2)] + [(None, "null id"), (0, "id repeated")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = sorted((tuple(r) for r in bpe.encode(docs, share=share).collect()), key=str)
    assert got == sorted(((i, *reference(t)) for i, t in rows), key=str)


def test_copies_with_rare_words_are_linear(spark):
    text = " ".join(f"rare{a}word" for a in "abcdefghijklm")
    took = {}
    for copies in (20, 2_000):
        docs = spark.createDataFrame([(i, text) for i in range(copies)], "doc_id long, text string")
        began = time.time()
        got = {tuple(r)[1:] for r in bpe.encode(docs, share=1).collect()}
        took[copies] = time.time() - began
        assert got == {reference(text)}
    assert took[2_000] < 5 * took[20] + 10


def test_full_gives_ids_and_decoded_text(spark):
    docs = spark.createDataFrame([(1, "Hello WORLD"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(docs, full=True).collect()}
    t = bpe.tokenizer(PATH)
    ids = t.encode("Hello WORLD", add_special_tokens=False).ids
    assert got == {1: (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)), 2: ("", "")}


def test_most_frequent_words_bound_the_broadcast(spark):
    docs = spark.createDataFrame([(1, "a a a b b c d"), (2, "a" * 40)], "doc_id long, text string")
    words = bpe.word_table(bpe.word_counts(docs, PATH), PATH)
    known, others = bpe.frequent_words(words, PATH, most=2)
    assert known.column("word").to_pylist() == ["a", "b"] and others.count() == 5
    known, others = bpe.frequent_words(words, PATH)
    assert known.num_rows == 4 and [r.word for r in others.collect()] == ["a" * 40]


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_split_words_then_encode_equals_the_library(text):
    got = [i for ids in bpe.encode_words(bpe.split_words(text, PATH), PATH) for i in ids]
    assert got == bpe.tokenizer(PATH).encode(text, add_special_tokens=False).ids


@given(st.lists(st.lists(st.integers(0, (1 << 28) - 1))))
def test_pack_round_trip(texts):
    ranks, begins = bpe.unpack(bpe.pack([r for t in texts for r in t], [len(t) for t in texts]))
    assert [ranks[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)] == texts
