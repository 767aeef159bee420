"""The pipeline's stages, one after another over Parquet, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import mixing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    """Clean, junk, copied and edited documents."""
    words = [a + b for a in "ba de fi go lu ma ne pi ro su ta vi zo ka he".split() for b in "rin lot mar sen dil pov gat hul".split()]
    clean = [[rng.choice(words) for _ in range(120)] for _ in range(60)]
    text = lambda w: "\n".join(" ".join(w[i : i + 12]).capitalize() + "." for i in range(0, len(w), 12))
    rows = [(i, text(w)) for i, w in enumerate(clean)]
    rows += [(100 + i, text(clean[i]).upper()) for i in range(8)]
    for i in range(8, 14):
        edited = list(clean[i])
        edited[60] = "edited"
        rows.append((100 + i, text(edited)))
    rows += [(200 + i, "\n".join(["BUY NOW!!! $$$ ### click click click"] * (6 + i))) for i in range(20)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in rows]
    return rows, [(i, int(i < 200)) for i, *_ in rows]


def shingles(text):
    words = text.translate(LOWER).split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_classes(rows):
    of, bags = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}
    for a in bags:
        for b in bags:
            if a < b and (both := sum((bags[a] & bags[b]).values())) >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                old, new = of[b], of[a]
                of = {k: new if v == old else v for k, v in of.items()}
    return set(of.values())


def test_stages_against_plain_python(spark, tmp_path):
    rows, labels = corpus(random.Random(11))
    sf = str(tmp_path / "in")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs, after = spark.read.parquet(f"{sf}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(path)
        after.append(docs)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted("doc_id text lang source n_chars".split())
    kept = [sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for d in after[:4]]

    assert kept[0] == sorted((i, t) for i, t, *_ in rows if i < 200)
    groups = defaultdict(list)
    for i, t in kept[0]:
        groups[t.translate(LOWER)].append((i, t))
    assert kept[1] == sorted(max(g) for g in groups.values()) and len(kept[1]) == len(kept[0]) - 8
    assert {i for i, _ in kept[2]} == near_classes(kept[1]) and len(kept[2]) == len(kept[1]) - 6

    plan = {r.doc_id: r for r in mixing.mix(after[2]).collect()}
    assert Counter(i for i, _ in kept[3]) == Counter({i: r.copies for i, r in plan.items() if r.copies})
    for source in "abc":
        own = [r for r in plan.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) and max(r.copies for r in own) <= 3

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in kept[3]:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, after[4].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_nulls_repeats_clashing_columns_and_a_hot_text(spark, tmp_path):
    """A third of all rows is one text; nulls stand in every column; columns have the names that stages use themselves, and pass all stages but the last."""
    rng = random.Random(4)
    rows, labels = corpus(rng)
    hot = rows[3][1]
    rows += [(500 + i, hot, "en", "a", len(hot)) for i in range(60)]
    rows += [(900, None, "en", "b", None), (901, rows[5][1] + " tail words here", None, None, 5), (None, rows[7][1] + " other", "en", "c", 9), (902, "", "en", "b", 0), rows[9], rows[9]]
    rows += [(903, "word " * 30_000, "en", "a", 150_000), (904, "\x00퟿ ​", "en", "a", 4)]
    names = ["row", "key", "hash", "digest", "copies", "kept", "size", "word", "run", "node", "component", "target"]
    sf = str(tmp_path / "in")
    wide = [(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)]
    spark.createDataFrame(wide, COLUMNS + "".join(f", {n} string" for n in names)).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs, after = spark.read.parquet(f"{sf}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(path)
        after.append(docs.collect())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", *names])
    given = {tuple(r) for r in wide}
    assert all(tuple(r[c] for c in ["doc_id", "text", "lang", "source", "n_chars", *names]) in given for a in after[:4] for r in a)
    kept = Counter(r.doc_id for r in after[0])
    assert kept[None] == 1 and kept[9] == 3 and sum(kept[500 + i] for i in range(60)) == 60  # repeats and nulls are judged like others
    exact = {r.doc_id for r in after[1]}
    assert sum(500 + i in exact for i in range(60)) == 1 and 559 in exact and 3 not in exact
    assert len(after[1]) == len({(r.text or "").translate(LOWER) for r in after[0]})
    texts = Counter((r.text or "").translate(LOWER) for r in after[2])
    assert max(texts.values()) == 1 and sum(r.text == hot for r in after[2]) == 1
    assert all(n <= 3 for n in Counter((r.doc_id, r.text) for r in after[3]).values())
    assert len(after[4]) == len(after[3]) and Counter(r.doc_id for r in after[4]) == Counter(r.doc_id for r in after[3])
