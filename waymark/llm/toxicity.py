"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes (of `bits` bits) of a text's words, word pairs and pairs with one word
between. Training is on-line, one text at a time, with per-coordinate learning rates and L1 sparsity; the few
weights that stay are broadcast to score every whole text.

The classifier is fitted on a bounded sample of the labelled rows: the `most` documents that come first by a
hash of their id (SAMPLE unless told otherwise), and of these the first whose texts have SAMPLE_BYTES together
(at least one text). Everything else covers all rows.

Defined results: null and empty texts have the intercept's score; repeated rows get the same score; a text of
any length is used whole; labels with a null are left out, a document with several is toxic if one says so; of
several texts of a labelled doc_id the one with the smallest hash is learnt from;
without any label the score is 0.5; doc_id, lang, source and labels are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blocks, bucket, text_of
from waymark.llm.words import ALNUM, combine, words

SAMPLE, SAMPLE_BYTES = 8192, 128 << 20


@dataclass(frozen=True)
class Params:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 10
    threshold: float = 0.7


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows (a row's may repeat) and each one's row."""
    h, rows, _, _ = words(data, off, ALNUM)
    n = np.diff(rows)
    parts, owner = [h], [np.repeat(np.arange(len(n)), n)]
    of = owner[0]
    for gaps in ((0, 1), (0, 2)):
        at = np.arange(max(0, len(h) - gaps[1]))
        at = at[of[at] == of[at + gaps[1]]]
        # the gap is part of the hash: a pair and a skip-gram of the same words differ
        parts.append(combine(h, at, gaps) + np.uint64(gaps[1] << 58))
        owner.append(of[at])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owner)


def unique_features(data, off, bits) -> list[np.ndarray]:
    f, of = features(data, off, bits)
    key = np.unique((of << bits) | f)
    cut = np.searchsorted(key >> bits, np.arange(len(off)))
    return [(key[a:b] & ((1 << bits) - 1)).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fit(rows: list[np.ndarray], labels: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, weights), the intercept at number 2**bits; only weights that aren't 0."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        w[np.abs(zz) <= p.l1] = 0
        return w

    for _ in range(p.epochs):
        for x, y in zip(rows, labels, strict=True):
            at = np.append(x, size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g2
    at = np.flatnonzero(np.abs(z) > p.l1)
    return at, weights(at)


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the first `most` labelled documents by hash, in one task of bounded input."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(most)
    # one text a document, so the sample stays within its bound and is the same in every run
    texts = text_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "turn", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        rows, marks, room = [], [], SAMPLE_BYTES
        for batch, data, off in blocks(batches):
            fits = max(int(np.searchsorted(off, room, "right")) - 1, not rows)
            marks += batch.column("toxic").to_pylist()[:fits]
            rows += unique_features(data, off, params.bits)[:fits]
            room -= off[-1]
            if fits < batch.num_rows:
                break
        at, w = fit(rows, np.array(marks, float), params) if rows else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["at", "w"])

    got = texts.repartition(1).sortWithinPartitions("turn", "doc_id").mapInArrow(run, "at long, w double").toPandas()
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], params: Params = Params(), *keep: str) -> DataFrame:
    """doc_id (and `keep` columns) with score and predicted of every whole text."""
    spark = docs.sparkSession
    at, w = model
    shared = spark.sparkContext.broadcast((at.astype(np.int64), w.astype(np.float64)))  # bounded: 2**bits numbers at most, a few thousand in practice

    def run(batches):
        at, w = shared.value
        dense = np.zeros((1 << params.bits) + 1)
        dense[at] = w
        active = dense[:-1] != 0
        for batch, data, off in blocks(batches):
            f, of = features(data, off, params.bits)
            hit = active[f]
            key = np.unique((of[hit] << params.bits) | f[hit])
            s = dense[-1] + np.bincount(key >> params.bits, dense[key & ((1 << params.bits) - 1)], batch.num_rows)
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            rest = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(s), pa.array((s >= params.threshold).astype(np.int32))], names=["doc_id", *keep, "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c for c in keep if c != "text"))
    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"doc_id long{kinds}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Scores by a model that never saw the fold crc32(doc_id) mod 3 = 1."""
    seen = labels.where(bucket(F.col("doc_id").cast("long"), 3) != 1)
    out = score(docs, train(docs, seen, params), params)
    return out.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs, all columns of documents, whose text the model doesn't call toxic."""
    out = score(docs, train(docs, labels.where(bucket(F.col("doc_id").cast("long"), 3) != 1), params), params, "text", "lang", "source", "n_chars")
    return out.where("predicted = 0").select("doc_id", "text", "lang", "source", "n_chars")
