"""Quality classifier: site posteriors against plain Python, held-out accuracy, and odd input."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"
CLASH = "doc_id long, text string, source string, lang string, row string, evidence double, prior long, host string, path string, label int"


def good(rng, n=90):
    return "\n".join(" ".join(rng.choice("river stone light garden window letter morning winter paper music table answer question summer".split()) + str(rng.randrange(400)) for _ in range(10)) + "." for _ in range(n // 10))


def junk(rng):
    return "\n".join(["BUY NOW!!! $$$ ### click click click"] * rng.randrange(6, 20))


def rows_of(rng):
    rows = [(i, junk(rng) if i % 4 == 0 else good(rng), rng.choice("abc"), rng.choice(["en", "de"])) for i in range(120)]
    rows += [(200, None, "a", "en"), (201, "", None, None), (202, good(rng), "sparse", None), (None, good(rng), "a", "en"), (1, rows[1][1], rows[1][2], rows[1][3]), (203, good(rng, 40_000), "a", "de")]
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(100)] + [(200, None), (None, 1), (999, 1)]
    return [(*r, "r", 1.5, 7, "h", "p", 3) for r in rows], labels


def site_priors(rows):
    """{(host, path): posterior mean} and the global mean, from (host, path, evidence)."""
    path, host, all_ = defaultdict(list), defaultdict(list), []
    for h, p, e in rows:
        for group in (path[h, p], host[h], all_):
            group.append(1 / (1 + math.exp(-e)))
    average = lambda v: sum(v) / len(v)
    mean, n = average(all_), len(all_)

    def weight(groups, parent_mean, freedom, spread):
        if n <= len(groups):
            return 1e6
        noise = sum((v - average(g)) ** 2 for g in groups.values() for v in g) / (n - len(groups))
        between = sum(len(g) * (average(g) - parent_mean(k)) ** 2 for k, g in groups.items())
        signal = (between - freedom * noise) / spread if spread > 0 else 0
        return min(max(noise / signal, 0.01), 1e6) if signal > 0 else 1e6

    m = weight(host, lambda _: mean, len(host) - 1, n - sum(len(g) ** 2 for g in host.values()) / n)
    k = weight(path, lambda key: average(host[key[0]]), len(path) - len(host), n - sum(len(g) ** 2 / len(host[key[0]]) for key, g in path.items()))
    of_host = {h: (sum(g) + m * mean) / (len(g) + m) for h, g in host.items()}
    return {(h, p): (sum(g) + k * of_host[h]) / (len(g) + k) for (h, p), g in path.items()}, mean


def test_posteriors_equal_plain_python(spark):
    rows, labels = rows_of(random.Random(3))
    docs, marks = spark.createDataFrame(rows, CLASH).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int")
    got = qc.quality(docs, marks).collect()
    assert len(got) == len(rows)
    priors, mean = site_priors([(r.host, r.path, r.evidence) for r in got])
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        assert abs(r.prior - priors[r.host, r.path]) < 1e-9
        odds = r.evidence + logit(r.prior) - logit(mean)
        assert abs(r.score - 1 / (1 + math.exp(-odds))) < 1e-9 and r.kept == (odds >= 0)
    verdict = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert not any(verdict[i] for i in range(0, 120, 4)) and all(verdict[i] for i in range(120) if i % 4) and verdict[202] and verdict[203]
    left = qc.keep_good(docs, marks)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)
    # a sparse site lies nearer the global mean than its own evidence says
    own = next(1 / (1 + math.exp(-r.evidence)) for r in got if r.doc_id == 202)
    assert abs(priors["sparse", ""] - mean) < abs(own - mean)


def plain_features(text):
    """The figures of one text, from its words and lines."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    letters, size = sum(chr(c).isalpha() for c in data if c < 128) + 1, len(data) + 1
    upper = sum(65 <= c <= 90 for c in data)
    share = lambda chars: math.sqrt(sum(c in chars for c in data) / size)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = lambda items: sum(v in items[:i] for i, v in enumerate(items))
    per = lambda n: n / (len(words) + 1)
    return [
        math.log1p(len(words)), math.log1p(len(lines)), math.log1p(len(words) / (len(lines) + 1)), per(sum(map(len, words))) / 10, upper / letters,
        share(b"#*$%&|<>=_~^{}[]\\@+"), share(b"!?"), share(b".,;:"), share(b"0123456789"), per(again(words)), per(sum(a == b for a, b in zip(words, words[1:]))),
        per(again(triples)), again(lines) / (len(lines) + 1), per(sum(len(w) == 1 for w in words)),
    ]


def test_features_equal_plain_python():
    rng = random.Random(8)
    texts = [None, "", " \n\n", "a", "Ab ab AB\nab ab ab\nAb ab AB", good(rng), junk(rng), "é ü! x x x y x x x?\r\n#1 {2}", "w " * 500]
    got = qc.features(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_features(t) for t in texts])


def test_sites_of_urls(spark):
    rng = random.Random(9)
    rows, labels = rows_of(rng)
    docs = spark.createDataFrame([(r[0], r[1], f"http://{r[2]}.Test/{r[3]}/p?q" if r[0] != 7 else None) for r in rows], "doc_id long, text string, url string")
    got = qc.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), url_col="url").collect()
    assert {(r.host, r.path) for r in got} == {(f"{h}.test", f"/{p}") for h in "abc" for p in ("en", "de")} | {("", ""), ("none.test", "/None"), ("sparse.test", "/None")}


def test_sampling_noise_is_no_variance_between_sites():
    assert qc.prior_weight(1000, 500, 50.0, 50.5, (499, 998.0)) > 100
    assert qc.prior_weight(1000, 2, 50.0, 100.0, (1, 500.0)) < 1


def test_without_labels_and_empty(spark):
    rows, _ = rows_of(random.Random(4))
    docs, none = spark.createDataFrame(rows, CLASH), spark.createDataFrame([], "doc_id long, quality int")
    assert qc.quality(docs, none).where("kept").count() == len(rows)
    one = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert qc.keep_good(docs, one).count() == len(rows)
    assert qc.quality(docs.limit(0), one).count() == 0 and qc.keep_good(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = qc.quality(docs, labels, where=~held).join(labels.where(held), "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    # clean documents stay
    clean = [r.kept for r in got if r.quality == 1]
    assert right >= 0.9 * len(got) and sum(clean) >= 0.95 * len(clean)
