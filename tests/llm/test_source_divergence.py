import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quarry.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """The contract with dense arrays of Python integers."""
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text)]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        share = {}
        for name, count in [*((s, counts[lang, s]) for s in sources), (None, sum((counts[lang, s] for s in sources), Counter()))]:
            total = sum(count[t] for t in kept)
            share[name] = {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(-sum(gap(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-gap(p, share[None][t]), t.encode(), t) for t, p in share[s].items() if counts[lang, s][t] and p > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, term string")
    return sorted(tuple(r) for r in sd.source_divergence(docs, **how).collect())


def corpus(sources=7, docs=120, seed=2):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé漢Z") for _ in range(rnd.randint(1, 5))) for _ in range(80)]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "de", None]), rnd.choice([f"s{i}" for i in range(sources)] + [None])) for _ in range(docs)]
    return [*rows, (None, "fr", "s1"), ("", "fr", "s2"), ("only once", "it", "s1"), *rows[:5]]


@pytest.mark.parametrize(("top", "rest"), [(200, 1000), (3, 0), (1, 2)])
def test_against_dense_arithmetic(spark, top, rest):
    """A small rest sends the ranking through all bits and through the bytes of equal values."""
    assert found(spark, corpus(), top=top, rest=rest) == plain(corpus(), top=top)


def test_pairs_in_several_blocks_and_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(sd, "broadcast_if_small", lambda df: df)
    rows = corpus(sources=150, docs=500, seed=4)
    assert found(spark, rows, top=5, rest=1) == plain(rows, top=5)


def test_ties_by_bytes(spark):
    words = [f"{a}{b}x" for a in "abé" for b in "cdefgh"] + ["q" * 300 + x for x in "abcd"]
    rows = [(" ".join(words), "en", "one")] * 3 + [("other words here", "en", "two")] * 3
    assert found(spark, rows, top=20, rest=0) == plain(rows, top=20)


def test_counts_in_cuts_and_repeated_hand_overs(spark, monkeypatch):
    text = " ".join(f"w{'abcdefghij'[i % 10] * (i % 7 + 1)}" for i in range(5000)).encode()
    monkeypatch.setattr(sd, "CUT", 100)
    assert Counter(t for part in sd._words(text) for t in part) == Counter(text.translate(sd._TABLE).split())


def test_large_counts_stay_exact(spark):
    n, total, terms = 10**12 + 7, 3 * 10**13 + 1, 10**7
    row = spark.range(1).selectExpr(f"{n}L AS n", f"{total}L AS total", f"{terms}L AS terms").selectExpr(sd.parts("n", "total", "terms") + " AS p").first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + terms)


def test_empty_table(spark):
    assert sd.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_query_against_sql(spark):
    from __spark_entry__ import queries

    sf_dir = "/root/testdata/sf0.001"
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = sorted(duck.sql(f"SELECT lang, source, part, item, value, rank FROM ({sd.OP11_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries()["op11_source_divergence"](spark, sf_dir).collect()) == want
