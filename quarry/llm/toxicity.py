"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Words are runs without white space, A-Z in lower case, with ASCII punctuation at their ends cut off. A word's input is its word
embedding (by hash) beside the mean of the embeddings of its character 3-, 4- and 5-grams (by hash, with marks at both ends). Windows of
``WINDOW`` words start every ``STRIDE`` words, so every one overlaps the next, and cover the whole text. The network reads a window
in both directions, attention weighs its positions, and a text's score is that of its most toxic window.

Labels hold for texts, not windows, so training is by multiple instances: every few epochs each training text is represented by its
highest-scoring window under the current weights, beside random ones of clean texts. Embeddings start with the smoothed log-odds of
each word and n-gram in toxic texts as first channel. Training takes at most ``POSITIVES`` and ``NEGATIVES`` labelled texts of up
to ``LONGEST`` characters, in hash order of their ids, and of these no more than ``TRAINED`` bytes; only these come to the driver. Weights are a few MB of
fixed size and are broadcast; texts are scored where they lie, without a shuffle, and those of over 1 MB in cuts of ``CUT`` words that overlap so that the
windows are those of the whole text.

Defined results: null, empty and blank texts score 0; repeated rows score alike; rows with a null id score but are never learned
from and not held out; without labels of both kinds every text scores 0.5 (blank ones 0); an empty table gives an empty result; only
the text is an input of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import textscan as ts

WINDOW, STRIDE = 48, 32
HIDDEN = 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 15
WORD_DIM, CHAR_DIM = 6, 6
GRAMS = (3, 4, 5)
POSITIVES, NEGATIVES, LONGEST, TRAINED = 1000, 3000, 100_000, 16 << 20
#: Words that are hashed at once.
SOME = 100_000
#: Words of a very long text that are scored at once; a multiple of STRIDE.
CUT = 4096 * STRIDE
EPOCHS, PICK_EVERY, BATCH, RATE = 8, 2, 128, 0.01

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where words begin, where they end, number of each text's first word and one more); words don't cross the texts' ends."""
    inside = ~ts._WORD_BREAK[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] |= inside[borders]
    ends[borders - 1] |= inside[borders - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


class Lexicon:
    """The distinct words of some texts: their hashes, n-gram buckets, and the sequence of words as numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _FOLD[data]
        start, end, self.first = _bounds(data, offsets)
        for _ in range(3):  # up to three marks on either side
            full = end - start > 1
            start += full & _EDGE[data[np.minimum(start, len(data) - 1)]] if len(start) else 0
            full = end - start > 1
            end -= full & _EDGE[data[end - 1]] if len(end) else 0
        length = end - start
        hashes = np.concatenate([np.zeros(0, np.uint64), *(self._hashes(data, start[i : i + SOME], length[i : i + SOME]) for i in range(0, len(start), SOME))])
        self.hash, index, sequence = np.unique(hashes, return_index=True, return_inverse=True)
        self.sequence = sequence.astype(np.int32)
        self.word = (self.hash >> np.uint64(49)).astype(np.int64) % WORD_BUCKETS
        gram, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i in range(0, len(index), SOME // 5):
            some = index[i : i + SOME // 5]
            buffer, at = self._copy(data, start[some], length[some])
            grams, own = self._grams(buffer, at, length[some] + 2)
            gram.append(grams.astype(np.int32))
            owner.append((own + i).astype(np.int32))
        self.gram, self.gram_word = np.concatenate(gram), np.concatenate(owner)

    @classmethod
    def _hashes(cls, data, start, length):
        buffer, at = cls._copy(data, start, length)
        pos = np.arange(len(buffer)) - np.repeat(at, length + 2)
        power = np.full(int(length.max()) + 2, ts.BASE, np.uint64)
        power[0] = 1
        return ts.mix64(np.add.reduceat(ts._BYTE[buffer] * np.multiply.accumulate(power)[pos], at))

    @staticmethod
    def _copy(data, start, length):
        """Words one after another, each between two marks; and where each begins."""
        at = np.cumsum(length + 2) - (length + 2)
        buffer = np.full(int((length + 2).sum()), 2, np.uint8)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        buffer[np.repeat(at + 1, length) + place] = data[np.repeat(start, length) + place]
        if len(at):
            buffer[at] = 1
        return buffer, at

    @staticmethod
    def _grams(buffer, at, size):
        value = ts._BYTE[buffer]
        owner = np.repeat(np.arange(len(size)), size)
        grams, owners = [], []
        for n in GRAMS:
            if len(buffer) < n:
                continue
            inside = np.flatnonzero(owner[: len(buffer) - n + 1] == owner[n - 1 :])
            mixed = value[inside]
            for i in range(1, n):
                mixed = mixed * ts.BASE + value[inside + i]
            grams.append((ts.mix64(mixed + np.uint64(n)) >> np.uint64(49)).astype(np.int64) % CHAR_BUCKETS)
            owners.append(owner[inside])
        if not grams:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram, own = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(own, kind="stable")
        return gram[order], own[order]

    def inputs(self, model) -> np.ndarray:
        """A row for each distinct word."""
        return np.concatenate([model["words"][self.word], self.char_means(model["chars"])], axis=1)

    def char_means(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.word), table.shape[1]), np.float32)
        if len(self.gram):
            begin = np.flatnonzero(np.concatenate([[True], self.gram_word[1:] != self.gram_word[:-1]]))
            sums = np.add.reduceat(table[self.gram], begin)
            counts = np.diff(np.append(begin, len(self.gram)))
            out[self.gram_word[begin]] = sums / counts[:, None]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, -1 beyond the text; text of the window) for all windows of all texts."""
        sizes = np.diff(self.first)
        many = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out = np.full((len(doc), WINDOW), -1, np.int32)
        for at in range(WINDOW if len(self.sequence) else 0):
            place = nth * STRIDE + at
            valid = np.flatnonzero(place < sizes[doc])
            out[valid, at] = self.sequence[self.first[doc[valid]] + place[valid]]
        return out, doc


def start_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)
    dim = WORD_DIM + CHAR_DIM
    return {
        "words": draw(WORD_BUCKETS, WORD_DIM) * 4, "chars": draw(CHAR_BUCKETS, CHAR_DIM) * 4, "in": draw(2, dim, 3 * HIDDEN), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "gates": draw(2, HIDDEN, 2 * HIDDEN), "new": draw(2, HIDDEN, HIDDEN), "look": draw(2 * HIDDEN, HIDDEN), "weigh": draw(HIDDEN), "out": draw(2 * HIDDEN), "shift": np.full(1, -1.0, np.float32),
    }


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(model, projected: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Log-odds of each window; ``projected``: [direction, word (and a last row for none), 3 x hidden]."""
    n, steps = windows.shape
    mask = (windows >= 0).astype(np.float32)
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((steps, 2, n, HIDDEN), np.float32)
    trace = []
    both = np.arange(2)[:, None]
    for s in range(steps):
        at = np.stack([windows[:, s], windows[:, steps - 1 - s]])
        on = np.stack([mask[:, s], mask[:, steps - 1 - s]])[:, :, None]
        x = projected[both, at]
        gates = _sigmoid(x[:, :, : 2 * HIDDEN] + h @ model["gates"])
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        own = h @ model["new"]
        new = np.tanh(x[:, :, 2 * HIDDEN :] + r * own)
        after = h + on * (1 - z) * (new - h)
        if keep:
            trace.append((h, z, r, own, new, on, at))
        h = after
        states[s] = h
    # both directions' states at each position
    seen = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    look = np.tanh(seen @ model["look"])
    energy = look @ model["weigh"] + (mask.T - 1) * 1e4
    energy -= energy.max(axis=0)
    weight = np.exp(energy)
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * seen).sum(axis=0)
    logit = pooled @ model["out"] + model["shift"][0]
    return (logit, (trace, seen, look, weight, pooled)) if keep else logit


def backward(model, cache, d_logit: np.ndarray):
    """Gradients of the recurrent part, and of the projected inputs at each step."""
    trace, seen, look, weight, pooled = cache
    steps = len(trace)
    grad = {"out": pooled.T @ d_logit, "shift": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * model["out"]
    d_seen = weight[:, :, None] * d_pooled
    d_weight = (seen * d_pooled).sum(axis=2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["weigh"] = np.einsum("tnh,tn->h", look, d_energy)
    d_look = d_energy[:, :, None] * model["weigh"] * (1 - look * look)
    grad["look"] = np.einsum("tns,tnh->sh", seen, d_look)
    d_seen = d_seen + d_look @ model["look"].T
    grad["gates"], grad["new"] = np.zeros_like(model["gates"]), np.zeros_like(model["new"])
    d_h = np.zeros_like(trace[0][0])
    inputs = []
    for s in range(steps - 1, -1, -1):
        h, z, r, own, new, on, at = trace[s]
        d_h = d_h + np.stack([d_seen[s, :, :HIDDEN], d_seen[steps - 1 - s, :, HIDDEN:]])
        d_new = d_h * on * (1 - z) * (1 - new * new)
        d_z = -d_h * on * (new - h) * z * (1 - z)
        d_r = d_new * own * r * (1 - r)
        d_own = d_new * r
        d_gates = np.concatenate([d_z, d_r], axis=2)
        grad["gates"] += h.transpose(0, 2, 1) @ d_gates
        grad["new"] += h.transpose(0, 2, 1) @ d_own
        inputs.append((at, np.concatenate([d_gates, d_new], axis=2)))
        d_h = d_h * (1 - on * (1 - z)) + d_gates @ model["gates"].transpose(0, 2, 1) + d_own @ model["new"].transpose(0, 2, 1)
    return grad, inputs


def project(model, inputs: np.ndarray) -> np.ndarray:
    projected = inputs @ model["in"] + model["bias"]
    return np.concatenate([projected, np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)


def window_scores(model, lexicon: Lexicon, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    windows, doc = lexicon.windows()
    projected = project(model, lexicon.inputs(model))
    parts = [forward(model, projected, windows[i : i + chunk]) for i in range(0, len(windows), chunk)]
    return np.concatenate([np.zeros(0, np.float32), *parts]), doc, windows


def cuts(data: np.ndarray, size: int = CUT):
    """A text's bytes in parts of ``size`` words whose windows, one part after the other, are the windows of the whole text."""
    start, end, _ = _bounds(data, np.array([0, len(data)]))
    for at in range(0, max(len(start), 1), size):
        if at == 0 or len(start) - at > WINDOW - STRIDE:
            yield data[start[at] if at else 0 : end[min(at + size + WINDOW - STRIDE, len(end)) - 1] if len(end) else len(data)]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, prior: bool = True) -> dict[str, np.ndarray] | None:
    """The weights, or None without texts of both kinds. ``prior``: whether embeddings start with log-odds."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    data = [t.encode() for t in texts]
    lexicon = Lexicon(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    del data
    model = start_model(seed)
    windows, doc = lexicon.windows()
    if prior:
        _log_odds(model, lexicon, labels)
    hint = lexicon.char_means(model["chars"])[:, 0] + model["words"][lexicon.word, 0]
    score = np.where(windows >= 0, hint[windows] if len(hint) else 0, -9).max(axis=1) if len(windows) else np.zeros(0)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
    step = 0
    for epoch in range(epochs):
        if epoch % PICK_EVERY == 0:
            if epoch:
                score, _, _ = window_scores(model, lexicon)
            order = np.lexsort((score, doc))
            top = order[np.flatnonzero(np.concatenate([doc[order][1:] != doc[order][:-1], [True]]))] if len(doc) else order
        clean = np.flatnonzero(labels[doc] == 0)
        chosen = np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            picked = chosen[i : i + BATCH]
            step += 1
            used, local = np.unique(windows[picked], return_inverse=True)
            local = local.reshape(len(picked), WINDOW) - (used[0] < 0)
            used = used[used >= 0]
            grad = _gradients(model, lexicon, used, local, labels[doc[picked]])
            for name, g in grad.items():
                a, b = moments[name]
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                rate = RATE * (0.3 if name in ("words", "chars") else 1.0) * (1 - epoch / epochs)
                model[name] = (model[name] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return model


def _log_odds(model, lexicon: Lexicon, labels: np.ndarray) -> None:
    """First channels: how much more often toxic texts hold a word or n-gram, counted once for each text and word."""
    sizes = np.diff(lexicon.first)
    pair = np.repeat(np.arange(len(sizes)), sizes) * (len(lexicon.word) + 1) + lexicon.sequence
    pair.sort()
    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    word, toxic = pair % (len(lexicon.word) + 1), labels[pair // (len(lexicon.word) + 1)]
    bad, good = (np.bincount(word, w, minlength=len(lexicon.word)) for w in (toxic, 1 - toxic))
    prior = np.log(max(labels.sum(), 1) / max((1 - labels).sum(), 1))
    for name, bucket, owner, buckets in (("words", lexicon.word, np.arange(len(lexicon.word)), WORD_BUCKETS), ("chars", lexicon.gram, lexicon.gram_word, CHAR_BUCKETS)):
        p, n = np.bincount(bucket, bad[owner], minlength=buckets), np.bincount(bucket, good[owner], minlength=buckets)
        smooth = 0.5 * np.exp(prior)
        model[name][:, 0] = np.clip(np.log((p + smooth) / (n + 0.5)) - prior, -2, 4) / 2
        model[name][:, 1:] *= 0.05


def _gradients(model, lexicon: Lexicon, used, local, labels):
    inside = np.flatnonzero(np.isin(lexicon.gram_word, used))
    gram, owner = lexicon.gram[inside], np.searchsorted(used, lexicon.gram_word[inside])
    counts = np.maximum(np.bincount(owner, minlength=len(used)), 1).astype(np.float32)
    chars = np.zeros((len(used), CHAR_DIM), np.float32)
    np.add.at(chars, owner, model["chars"][gram])
    inputs = np.concatenate([model["words"][lexicon.word[used]], chars / counts[:, None]], axis=1)
    logit, cache = forward(model, project(model, inputs), local, keep=True)
    d_logit = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
    grad, steps = backward(model, cache, d_logit)
    d_projected = np.zeros((2, len(used) + 1, 3 * HIDDEN), np.float32)
    for direction in range(2):
        at = np.concatenate([a[direction] for a, _ in steps])
        np.add.at(d_projected[direction], at, np.concatenate([g[direction] for _, g in steps]))
    d_projected = d_projected[:, :-1]
    grad["in"] = inputs.T @ d_projected
    grad["bias"] = d_projected.sum(axis=1, keepdims=True)
    d_inputs = (d_projected @ model["in"].transpose(0, 2, 1)).sum(axis=0)
    grad["words"], grad["chars"] = np.zeros_like(model["words"]), np.zeros_like(model["chars"])
    np.add.at(grad["words"], lexicon.word[used], d_inputs[:, :WORD_DIM])
    np.add.at(grad["chars"], gram, (d_inputs[:, WORD_DIM:] / counts[:, None])[owner])
    return grad


def held_out_column(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, positives: int, negatives: int, longest: int, most_bytes: int = TRAINED) -> tuple[list[str], np.ndarray]:
    """Texts and labels: labelled rows that are not held out, bounded in number and in bytes."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_column("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.where("label = 1").orderBy(*order).limit(positives).union(rows.where("label = 0").orderBy(*order).limit(negatives))
    found = (
        docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text").between(1, longest))
        .join(F.broadcast(ids), "doc_id").withColumn("place", F.xxhash64("doc_id", "text")).orderBy("place").limit(positives + negatives)
    )
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).orderBy("place").select("text", "label").toArrow()
    return found.column("text").to_pylist(), np.array(found.column("label").to_pylist(), np.float32)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows), a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        weights = shared.value
        for batch in batches:
            out, many = [], []
            for first, end, data, offsets in ts.pieces(batch.column("text")):
                n = end - first
                if n == 1 and len(data) > ts.PIECE and weights is not None:
                    parts = [window_scores(weights, Lexicon(part, np.array([0, len(part)])))[0] for part in cuts(data)]
                    most = max((float(p.max()) for p in parts if len(p)), default=-np.inf)
                    out.append(np.array([1 / (1 + np.exp(-np.clip(most, -700, 700))) if most > -np.inf else 0.0]))
                    many.append(np.array([sum(map(len, parts))]))
                    continue
                lexicon = Lexicon(data, offsets)
                if weights is None:
                    blank = np.diff(lexicon.first) == 0
                    out.append(np.where(blank, 0.0, 0.5))
                    many.append(np.where(blank, 0, 1))
                    continue
                logit, doc, _ = window_scores(weights, lexicon)
                most = np.full(n, -np.inf)
                np.maximum.at(most, doc, logit)
                out.append(1 / (1 + np.exp(-np.clip(most, -700, 700))) * (most > -np.inf))
                many.append(np.bincount(doc, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate([np.zeros(0), *out])), pa.array(np.concatenate([np.zeros(0, np.int64), *many]).astype(np.int64))],
                names=["doc_id", "held_out", "score", "n_windows"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out_column(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        scan, f"doc_id {id_type}, held_out boolean, score double, n_windows long"
    )
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")


def op8_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(*training_rows(docs, labels, POSITIVES, NEGATIVES, LONGEST)))
