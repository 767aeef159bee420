"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic regression on counts of the whole text gives each document's evidence, a log-odds against the global prior. It is fitted
by Newton's method in numpy on at most ``sample`` labelled rows, taken in hash order of their ids. Evidence is summed over all
documents for each (host, path) in one grouped aggregation with map-side combine. The variance between hosts, less what sampling within them
explains, gives the strength M of the global prior, the variance between a host's paths, likewise, that of the host's, K (both as within / between
variance, in documents), so a sparse path is drawn to its host and a sparse host to the corpus:

    host = (sum_host + M * global) / (n_host + M)        path = (sum_path + K * host) / (n_path + K)
    log-odds = evidence + logit(path) - logit(global)

A document is kept if that is 0 or more. Host and path come from a URL column (``url_col``: its host and first path segment) or from two columns. The
table ``documents`` has no URLs, so there ``source`` stands for the host and ``lang`` for the path below it: a limitation of that table. Texts are
read once for their evidence, which is stored.

Defined results: a null text counts as empty; null host or path counts as the site ""; null or repeated ids are judged
row by row; unlabelled tables (no usable row of both classes) give evidence 0, so everything is kept; an empty table gives
an empty result; other columns, whatever their names, pass through ``keep_good`` and are not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm import textscan as ts
from quarry.llm.common import broadcast_if_small, stored
from quarry.llm.url_filter import host_of, path_of

SAMPLE = 20_000
RIDGE = 1.0


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER, _LOWER, _DIGIT = _bytes(bytes(range(65, 91))), _bytes(bytes(range(97, 123))), _bytes(b"0123456789")
_SYMBOL, _LOUD, _STOP = _bytes(b"#*$%&|<>=_~^{}[]\\@+"), _bytes(b"!?"), _bytes(b".,;:")


def features(texts: pa.Array) -> np.ndarray:
    """A row of shape and repetition figures for each text."""
    out = []
    for _, _, data, offsets in ts.pieces(texts):
        n = len(offsets) - 1
        words, rows = ts.words(data, offsets), ts.lines(data, offsets)
        size = np.diff(offsets) + 1.0
        n_words, n_lines = np.diff(words.first), np.diff(rows.first)
        letters = ts.counts(_UPPER[data] | _LOWER[data], offsets) + 1.0
        per_word = lambda flags: np.bincount(words.doc[flags], minlength=n) / (n_words + 1.0)  # noqa: E731, B023
        earlier, _ = ts.repeated(words.doc, words.hash)
        same = np.zeros(len(words.hash), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        triple = ts.windows(words.hash, 3)
        where = np.flatnonzero(words.doc[: len(triple)] == words.doc[2:]) if len(triple) else np.zeros(0, np.int64)
        again, _ = ts.repeated(words.doc[where], triple[where])
        line_again, _ = ts.repeated(rows.doc, rows.hash)
        out.append(
            np.column_stack([
                np.log1p(n_words), np.log1p(n_lines), np.log1p(n_words / (n_lines + 1.0)),
                ts.counts(words.length, words.first) / (n_words + 1.0) / 10,
                ts.counts(_UPPER[data], offsets) / letters,
                *(np.sqrt(ts.counts(t[data], offsets) / size) for t in (_SYMBOL, _LOUD, _STOP, _DIGIT)),
                per_word(earlier), per_word(same), np.bincount(words.doc[where][again], minlength=n) / (n_words + 1.0),
                np.bincount(rows.doc[line_again], minlength=n) / (n_lines + 1.0), per_word(words.length == 1),
            ])
        )
    return np.concatenate(out) if out else np.zeros((0, 14))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the bias last) of a ridge logistic regression, classes weighted as they come."""
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    weights = np.zeros(x.shape[1] + 1)
    if len(set(y.tolist())) < 2:
        return mean, scale, weights
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.full(len(weights), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge), z.T @ (y - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, weights


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality", where=None):
    """The model from at most ``sample`` labelled rows; only their figures come to the driver."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    ids = ids if where is None else ids.where(where)
    ids = ids.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def scan(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x array<double>")
        .orderBy(F.xxhash64("doc_id", "x"))
        .limit(sample)
        .toArrow()
    )
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, 14)
    return fit(x, np.array(found.column("label").to_pylist(), float))


def evidence(rows: DataFrame, model, text_field: str = "text") -> DataFrame:
    """``rows`` (a struct column ``row`` and others) with ``evidence``, the text's log-odds of good against the model's prior."""
    mean, scale, weights = model
    schema = StructType([*rows.schema.fields, StructField("evidence", DoubleType())])

    def scan(batches):
        for batch in batches:
            row = batch.column("row")
            x = (features(row.field(row.type.get_field_index(text_field)).cast(pa.large_string())) - mean) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x @ weights[:-1] + weights[-1])], names=[*batch.schema.names, "evidence"])

    return rows.mapInArrow(scan, schema)


def prior_weight(n: float, groups: float, within: float, between: float, spread: tuple[float, float]) -> float:
    """Within over between variance of nested groups, from 0.01 to 1,000,000 documents.

    ``within``: squares around the groups' means, with ``n`` - ``groups`` degrees of freedom. ``between``: squares of the groups' means around their
    parents'. ``spread``: its degrees of freedom, so that sampling's share can be taken off, and how often it then holds the variance between.
    """
    if n <= groups:
        return 1e6
    noise = within / (n - groups)
    signal = (between - spread[0] * noise) / spread[1] if spread[1] > 0 else 0.0
    return float(min(max(noise / signal, 0.01), 1e6)) if signal > 0 else 1e6


def sites(scored: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, prior), global mean) from all documents' evidence; ``prior`` is the path's posterior mean."""
    good = 1 / (1 + F.exp(-F.col("evidence")))
    path = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good"), F.sum(good * good).alias("squares")), "sites")
    host = stored(
        path.groupBy("host").agg(
            F.sum("n").alias("n_host"), F.sum("good").alias("good_host"), F.sum("squares").alias("squares_host"), F.count(F.lit(1)).alias("paths"), F.sum(F.col("n") * F.col("n")).alias("n2")
        ),
        "hosts",
    )
    by_host = host.agg(
        F.sum("n_host").alias("n"), F.sum("good_host").alias("good"), F.count(F.lit(1)).alias("hosts"), F.sum("paths").alias("paths"), F.sum(F.col("n_host") * F.col("n_host")).alias("n2"),
        F.sum(F.col("squares_host") - F.pow("good_host", F.lit(2)) / F.col("n_host")).alias("within"), F.sum(F.pow("good_host", F.lit(2)) / F.col("n_host")).alias("means2"), F.sum(F.col("n2") / F.col("n_host")).alias("n2_host"),
    ).first()
    n = by_host["n"]
    if not n:
        return path.select("host", "path", F.lit(0.5).alias("prior")), 0.5
    mean = min(max(by_host["good"] / n, 1e-6), 1 - 1e-6)
    by_path = path.agg(F.sum(F.col("squares") - F.pow("good", F.lit(2)) / F.col("n")).alias("within"), F.sum(F.pow("good", F.lit(2)) / F.col("n")).alias("means2")).first()
    m = prior_weight(n, by_host["hosts"], by_host["within"], by_host["means2"] - by_host["good"] ** 2 / n, (by_host["hosts"] - 1, n - by_host["n2"] / n))
    k = prior_weight(n, by_host["paths"], by_path["within"], by_path["means2"] - by_host["means2"], (by_host["paths"] - by_host["hosts"], n - by_host["n2_host"]))
    joined = path.join(host.select("host", ((F.col("good_host") + m * mean) / (F.col("n_host") + m)).alias("host_mean")), "host")
    return joined.select("host", "path", ((F.col("good") + k * F.col("host_mean")) / (F.col("n") + k)).alias("prior")), mean


def site_columns(host_col: str, path_col: str, url_col: str | None):
    """(host, path) of a row."""
    if url_col:
        return host_of(F.col(url_col)), F.regexp_extract(path_of(F.col(url_col)), r"^/[^/]*", 0)
    return F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.coalesce(F.col(path_col).cast("string"), F.lit(""))


def with_log_odds(scored: DataFrame) -> DataFrame:
    """``scored`` (host, path, evidence, ...), a stored table, with prior and log_odds."""
    priors, mean = sites(scored)
    logit = lambda p: F.log(p / (1 - p))
    prior = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("prior")))
    return scored.join(broadcast_if_small(stored(priors, "priors")), ["host", "path"]).withColumn("log_odds", F.col("evidence") + logit(prior) - logit(F.lit(mean)))


def quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, host_col: str = "source", path_col: str = "lang", url_col: str | None = None, where=None
) -> DataFrame:
    """(doc_id, host, path, evidence, prior, score, kept), a row for each row of ``docs``."""
    host, path = site_columns(host_col, path_col, url_col)
    rows = docs.select(F.struct("doc_id", "text").alias("row"), host.alias("host"), path.alias("path"))
    scored = stored(evidence(rows, train(docs.select("doc_id", "text"), labels, sample, where=where)).select(F.col("row.doc_id").alias("doc_id"), "host", "path", "evidence"), "evidence")
    return with_log_odds(scored).select(
        "doc_id", "host", "path", "evidence", "prior", (1 / (1 + F.exp(-F.col("log_odds")))).alias("score"), (F.col("log_odds") >= 0).alias("kept")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, host_col: str = "source", path_col: str = "lang", url_col: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    host, path = site_columns(host_col, path_col, url_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host.alias("host"), path.alias("path"))
    scored = stored(evidence(rows, train(docs.select("doc_id", "text"), labels, sample)), "evidence")
    return with_log_odds(scored).where("log_odds >= 0").select("row.*")


def op1_quality_classifier(spark, sf_dir):
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
