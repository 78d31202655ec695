"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that a label confirms as toxic, a bounded number of them; the
unlabelled set is all training documents, whatever their label, so it hides positives in the
share of the class prior. A linear model over the presence of hashed byte n-grams is trained
with the non-negative PU risk
``prior * E_P[l(g, 1)] + max(0, E_U[l(g, -1)] - prior * E_P[l(g, -1)])``
(sigmoid loss); a step in which the bracket is negative goes up that bracket instead.

E_U is over all rows at every size. One pass counts in how many unlabelled documents each
of the positives' most frequent n-grams is; those that set the positives apart are the features.
A second pass writes the features of each unlabelled document. A step is a job on that table:
tasks add up the loss and its gradient, and the driver gets one number a feature.

Null and empty texts score as a text without any n-gram. With no positives at all
the model is a constant below 0.5. Repeated rows are scored alike, and columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, gram_hashes, in_blocks, packed_bytes, released, staged


@dataclass(frozen=True)
class NnPuParams:
    #: Confirmed toxic documents that are collected to fit, and n-grams of theirs that are counted in all documents.
    max_positive: int = 2000
    candidates: int = 1 << 16
    features: int = 1024
    bits: int = 20
    sizes: tuple[int, ...] = (5, 7)
    steps: int = 60
    rate: float = 0.15
    decay: float = 1e-4
    folds: int = 5
    held_out: int = 0


@dataclass(frozen=True)
class NnPuModel:
    """index[s, h]: the feature of hash h for n-gram size number s, or -1."""

    sizes: tuple[int, ...]
    bits: int
    index: np.ndarray
    weights: np.ndarray
    bias: float


def _grams(texts: list[str], p: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash + size number * 2**bits) of all n-grams inside each text."""
    data, ends = packed_bytes(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    docs, ids = [], []
    for s, n in enumerate(p):
        h = gram_hashes(data, n, bits)
        own = owner[: len(h)]
        inside = own == owner[n - 1 :]
        docs.append(own[inside])
        ids.append(h[inside].astype(np.int64) + (s << bits))
    return np.concatenate(docs), np.concatenate(ids)


def _document_counts(texts: list[str], params: NnPuParams) -> np.ndarray:
    """In how many of the texts each n-gram is."""
    size = len(params.sizes) << params.bits
    total = np.zeros(size, np.int64)
    for _, block in in_blocks(texts, 500_000):
        d, g = _grams(block, params.sizes, params.bits)
        total += np.bincount(np.unique(d * np.int64(size) + g) % size, minlength=size)
    return total


def _listed(texts: list[str | None], index: np.ndarray, params: NnPuParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of texts the distinct features of each text, one after the other, and how many each has."""
    size = int(index.max(initial=0)) + 1
    for _, block in in_blocks(texts, 500_000):
        d, g = _grams(block, params.sizes, params.bits)
        f = index[g]
        pairs = np.unique(d[f >= 0] * np.int64(size) + f[f >= 0])
        yield pairs % size, np.bincount(pairs // size, minlength=len(block))


def _index(params: NnPuParams, chosen: np.ndarray) -> np.ndarray:
    index = np.full(len(params.sizes) << params.bits, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    return index


def unlabelled_counts(docs: DataFrame, index: np.ndarray, k: int, params: NnPuParams) -> tuple[np.ndarray, int]:
    """In how many of all documents each indexed n-gram is, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the size of the table is set by bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(k, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for f, _ in _listed(batch.column("text").to_pylist(), shared.value, params):
                total += np.bincount(f, minlength=k)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["feature", "n"])

    rows = docs.select("text").mapInArrow(counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # candidates + 1 rows at most
    out, n = np.zeros(k, np.int64), 0
    for r in rows:
        if r.feature < 0:
            n = r.n
        else:
            out[r.feature] = r.n
    return out, n


def unlabelled_features(docs: DataFrame, index: np.ndarray, params: NnPuParams) -> DataFrame:
    """The features of all documents, a row for each few hundred: features, sizes."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, n in _listed(batch.column("text").to_pylist(), shared.value, params):
                yield pa.RecordBatch.from_arrays([pa.array([f.astype("<u2").tobytes()], pa.binary()), pa.array([n.astype("<u2").tobytes()], pa.binary())], ["features", "sizes"])

    return docs.select("text").mapInArrow(listed, "features binary, sizes binary")


def _unlabelled_loss(lists: DataFrame, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """Sum of the losses of label -1 over all documents, and its gradient by weights and bias."""
    k = len(w)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + 2)
        for batch in batches:
            for f, n in zip(batch.column("features").to_pylist(), batch.column("sizes").to_pylist()):
                f, n = np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(n, "<u2").astype(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                s = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[f], minlength=len(n)) + bias, -30, 30)))
                d = s * (1 - s)
                total[:k] += np.bincount(f, weights=d[owner], minlength=k)
                total[k:] += d.sum(), s.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 2)), pa.array(total)], ["at", "x"])

    out = np.zeros(k + 2)
    for r in lists.mapInArrow(summed, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # a row for each feature, and two
        out[r["at"]] = r.x
    return out[-1], out[:-1]


def fit(positive: list[str], docs: DataFrame, prior: float, params: NnPuParams = NnPuParams()) -> NnPuModel:
    """The model of confirmed toxic texts and of all of docs (text), unlabelled."""
    none = NnPuModel(params.sizes, params.bits, _index(params, np.zeros(0, np.int64)), np.zeros(0, np.float32), -3.0)
    if not positive:
        return none
    a = _document_counts(positive, params)
    some = np.argsort(-a, kind="stable")[: params.candidates]
    some = some[a[some] >= 2]
    b, n = unlabelled_counts(docs, _index(params, some), len(some), params)
    if not n:
        return none
    a = a[some]
    pa_, pb = (a + 0.5) / (len(positive) + 1), (b + 0.5) / (n + 1)
    z = (pa_ - pb) / np.sqrt(pa_ * (1 - pa_) / len(positive) + pb * (1 - pb) / n)
    best = np.argsort(-z, kind="stable")[: params.features]
    index = _index(params, some[best[z[best] > 2]])
    k = int((index >= 0).sum())
    lists = staged(unlabelled_features(docs, index, params), "features")
    xp = _presence(positive, index, k, params.sizes, params.bits)
    w, bias = np.zeros(k, np.float32), -1.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, params.steps + 1):
        sp = 1 / (1 + np.exp(-np.clip(xp @ w + bias, -30, 30)))  # the sigmoid loss of label -1
        dp = sp * (1 - sp)
        loss, slope = _unlabelled_loss(lists, w.astype(float), bias)
        up = np.append(-prior * (xp.T @ dp) / len(sp), -prior * dp.mean())
        rest = slope / n + up
        g = up + rest if loss / n - prior * sp.mean() >= 0 else -rest
        g[:-1] += params.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = (w - move[:-1]).astype(np.float32)
        bias -= float(move[-1])
    released(lists)
    return NnPuModel(params.sizes, params.bits, index, w, bias)


def _presence(texts: list[str], index: np.ndarray, k: int, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    x = np.zeros((len(texts), max(k, 1)), np.float32)[:, :k]
    for at, block in in_blocks(texts, 500_000):
        d, g = _grams(block, sizes, bits)
        f = index[g]
        hit = f >= 0
        x[d[hit] + at, f[hit]] = 1
    return x


def score_texts(model: NnPuModel, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), model.bias, np.float64)
    k = max(1, len(model.weights))
    for at, block in in_blocks(texts, 1_000_000):
        d, g = _grams(block, model.sizes, model.bits)
        f = model.index[g]
        hit = f >= 0
        pairs = np.unique(d[hit] * np.int64(k) + f[hit])
        if len(pairs):
            out[at : at + len(block)] += np.bincount(pairs // k, weights=model.weights[pairs % k], minlength=len(block))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, params: NnPuParams = NnPuParams()) -> NnPuModel:
    """Fits on at most max_positive confirmed and all training documents; the prior is the toxic share of all labelled training rows."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    labels = labels.where(fold(F.col("doc_id"), params.folds) != params.held_out)
    n, toxic = labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), params.folds) != params.held_out))
    confirmed = F.broadcast(bounded(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", params.max_positive))
    positive = [r.text for r in docs.join(confirmed, "doc_id").select("doc_id", "text").orderBy("doc_id", "text").limit(params.max_positive).collect()]
    return fit(positive, docs, min(0.5, max(0.001, toxic / n)) if n else 0.1, params)


def score(docs: DataFrame, model: NnPuModel, params: NnPuParams = NnPuParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of its table is set by bits

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(shared.value, texts.tolist()))

    udf = F.pandas_udf(scored, "double")
    return docs.select("doc_id", (fold(F.col("doc_id"), params.folds) == params.held_out).alias("held_out"), udf("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
