"""The corpus pipeline: stages over ``documents``, each working on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run`` writes what a
stage returns to the shared folder and reads it again before the next one, so a stage sees one state of its input; what the stage before it wrote
is removed then.

Defined results: null texts are empty texts, null sources a source of their own; documents with null ids are judged like others;
repeated rows are copies, of which one stays; without labels of both classes the classifier keeps all; an empty table gives an empty
result; columns beyond those of ``documents``, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from quarry.llm import bpe, exact_dedup, mixing, near_dedup, quality_classifier
from quarry.llm.common import discard, stored


def classify_quality(spark, docs, sf_dir):
    """Documents that the classifier, fitted on the labels of these documents, doesn't reject."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark, docs, sf_dir):
    """Of equal texts (A-Z lower-cased) the row with the largest id."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def drop_near_copies(spark, docs, sf_dir):
    """One document of each near-duplicate class, the one with the least id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.repeat_documents(docs)


def encode_texts(spark, docs, sf_dir):
    """Token counts and digests of ids and decoded text for each document, repeats included."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: A trained classifier, sketches and merges cannot be said in SQL; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        after = stored(stage(spark, docs, sf_dir), "stage")
        if number:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
