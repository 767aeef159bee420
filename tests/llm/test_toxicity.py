import zlib

import numpy as np
import pyarrow as pa

from quarry.llm import textscan as ts
from quarry.llm import toxicity as tx


def lexicon(texts):
    data = [t.encode() for t in texts]
    return tx.Lexicon(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))


def test_windows_cover_and_overlap():
    for n in (0, 1, 47, 48, 49, 80, 81, 200):
        windows, doc = lexicon(["a", " ".join(f"w{i}" for i in range(n)), "b"]).windows()
        mine = windows[doc == 1]
        assert len(mine) == (0 if n == 0 else 1 + max(0, -(-(n - 48) // 32)))
        assert len(set(mine[mine >= 0].tolist())) == n


def test_edges_and_case_do_not_matter():
    assert (lexicon(["Word, ('word') WORD!!"]).sequence == 0).all()


def test_forward_equals_a_plain_loop():
    lex = lexicon(["one two three four", "five"])
    model = tx.start_model(4)
    windows, _ = lex.windows()
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    inputs = lex.inputs(model).astype(float)
    h_size = tx.HIDDEN

    def run(words, direction):
        h, out = np.zeros(h_size), []
        for w in words:
            x = inputs[w] @ model["in"][direction] + model["bias"][direction][0]
            gates = sigmoid(x[: 2 * h_size] + h @ model["gates"][direction])
            z, r = gates[:h_size], gates[h_size:]
            h = z * h + (1 - z) * np.tanh(x[2 * h_size :] + r * (h @ model["new"][direction]))
            out.append(h)
        return out

    want = []
    for window in windows:
        words = [w for w in window if w >= 0]
        seen = [np.concatenate([a, b]) for a, b in zip(run(words, 0), run(words[::-1], 1)[::-1], strict=True)]
        energy = np.array([np.tanh(s @ model["look"]) @ model["weigh"] for s in seen])
        weight = np.exp(energy - energy.max())
        pooled = sum(w * s for w, s in zip(weight / weight.sum(), seen, strict=True))
        want.append(pooled @ model["out"] + model["shift"][0])
    assert np.allclose(tx.forward(model, tx.project(model, lex.inputs(model)), windows), want, atol=1e-5)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    lex = lexicon(["one two three four five six", "seven eight"])
    model = {k: v.astype(np.float64) for k, v in tx.start_model(3).items()}
    windows, _ = lex.windows()
    used, local = np.unique(windows, return_inverse=True)
    local = local.reshape(windows.shape) - (used[0] < 0)
    used = used[used >= 0]
    labels = np.array([1.0, 0.0])

    def loss(m):
        z = tx.forward(m, tx.project(m, lex.inputs(m)), windows).astype(np.float64)
        return float((np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)).mean())

    grad = tx._gradients(model, lex, used, local, labels)
    for name, g in grad.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        for _ in range(2):
            eps = 1e-2
            up, down = dict(model), dict(model)
            up[name], down[name] = model[name].copy(), model[name].copy()
            up[name][at] += eps
            down[name][at] -= eps
            measured = (loss(up) - loss(down)) / (2 * eps)
            assert abs(measured - g[at]) < 2e-2 * max(1e-2, abs(g[at])) + 1e-4, name
            at = tuple(rng.integers(0, s) for s in g.shape)


def test_query_over_nulls_and_held_out_accuracy(spark):
    rng = np.random.default_rng(5)
    plain, bad = [f"word{i}" for i in range(60)], ["grolf", "grolfen", "snib"]
    rows, labels = [], []
    for i in range(500):
        words = list(rng.choice(plain, rng.integers(20, 150)))
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(bad)))
        rows.append((i, " ".join(words), i % 3))
        labels.append((i, toxic, 1))
    rows += [(None, "grolf snib grolf", 0), (1000, None, 0), (1001, "  \n", 0), (0, rows[0][1], 0), (1002, "grolf " * 20_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    truth = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = tx.train(*tx.training_rows(docs, truth, 300, 600, 100_000))
    got = tx.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 60 and np.mean([p == t for p, t in held]) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score == 0.0 and by_id[None].predicted == by_id[1002].predicted == 1
    assert tx.score(docs.limit(0), None).count() == 0
    assert {r.score for r in tx.score(docs, None).collect()} == {0.0, 0.5}


def test_pieces_agree_with_one_buffer():
    texts = [f"tok{i % 7} " * (i % 50) for i in range(300)]
    model = tx.start_model()
    whole, doc, _ = tx.window_scores(model, lexicon(texts))
    split = np.concatenate([tx.window_scores(model, tx.Lexicon(d, o))[0] for _, _, d, o in ts.pieces(pa.array(texts))])
    assert np.allclose(whole, split, atol=1e-5) and len(doc) == len(whole)


def test_cuts_have_the_windows_of_the_whole():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 64, 79, 80, 81, 96, 128, 129, 300, 301):
        text = "  " + " ".join(f"w{rng.integers(50)}" for _ in range(n)) + " \n"
        model = tx.start_model(5)
        whole, _, _ = tx.window_scores(model, lexicon([text]))
        data = np.frombuffer(text.encode(), np.uint8)
        parts = [tx.window_scores(model, tx.Lexicon(p, np.array([0, len(p)])))[0] for p in tx.cuts(data, 64)]
        assert np.allclose(np.concatenate(parts), whole, atol=1e-5), n


def test_very_long_text_scores_as_its_windows(spark, monkeypatch):
    words = " ".join(f"w{i % 977}" for i in range(300_000))
    texts = ["few words", words + " grolf snib " + words]
    model = tx.start_model(6)
    want = [float(tx.window_scores(model, lexicon([t]))[0].max()) for t in texts]
    got = tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert np.allclose([r.score for r in got], 1 / (1 + np.exp(-np.array(want))), atol=1e-5) and got[1].n_windows == 1 + -(-(600_002 - 48) // 32)


def test_training_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 1000) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts, _ = tx.training_rows(docs, labels, 30, 30, 100_000, most_bytes=52_000)
    assert len(texts) == 10
