"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, linear over the
frequencies of hashed byte trigrams, predicts that bit. A document gets the
language whose codeword has the smallest loss, each bit weighted by how well its
classifier did in training. When the second codeword is about as near, or none is
near, the document is flagged ambiguous: both bounds come from the leads and losses of
the training texts and their cuts.

A text that is null or without a letter is `und` with score 0, and never ambiguous.
With a single language in training all other texts get that one; with none, `und`.
Repeated rows are predicted alike; columns beyond doc_id, text and lang are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, gram_hashes, in_blocks, packed_bytes

_LATIN = re.compile("[A-Za-z]")


@dataclass(frozen=True)
class EcocParams:
    #: Bound of the rows that are collected to fit.
    max_rows: int = 4000
    bits: int = 12
    steps: int = 200
    rate: float = 0.05
    decay: float = 1e-3
    #: Below this lead over the second codeword, in loss per bit, a document is ambiguous; more where training texts lead by more.
    margin: float = 0.01
    #: Share of the training texts that may lie beyond each of the two bounds.
    beyond: float = 0.001
    folds: int = 4
    held_out: int = 2
    seed: int = 3


@dataclass(frozen=True)
class EcocModel:
    languages: tuple[str, ...]
    codes: np.ndarray  # language x bit, -1 or 1
    tables: np.ndarray  # bit x hash
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit, sum 1
    bits: int
    margin: float
    far: float = np.inf  # above this loss no codeword is near


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """All splits in two for up to 5 languages; beyond, of 50 random draws the code with the largest least distance between rows."""
    if k <= 5:
        return np.array([(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, k - 1)) if -1 in rest], np.float32).reshape(-1, k).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        c = rng.choice(np.float32([-1, 1]), (k, int(np.ceil(10 * np.log2(k)))))
        c = c[:, abs(c.sum(0)) < k]
        near = ((c.shape[1] - c @ c.T) / 2 + np.eye(k) * 1e9).min()
        if near > far:
            best, far = c, near
    return best


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def _frequencies(texts: list[str], bits: int, x: np.ndarray) -> None:
    """Fills the rows of x."""
    for i, t in enumerate(texts):
        h = gram_hashes(packed_bytes([t])[0], 3, bits)
        if len(h):
            x[i] = np.bincount(h, minlength=1 << bits) / len(h)


def fit(texts: list[str], langs: list[str], params: EcocParams = EcocParams()) -> EcocModel:
    """Fits on the texts and on a short cut of each, so that short texts are known too."""
    languages = tuple(sorted(set(langs)))
    if len(languages) < 2:
        return EcocModel(languages, np.zeros((len(languages), 0), np.float32), np.zeros((0, 1 << params.bits), np.float32), np.zeros(0), np.zeros(0), params.bits, params.margin)
    codes = codewords(len(languages), params.seed)
    rng = np.random.default_rng(params.seed)
    cut = [t[(a := int(rng.integers(0, max(1, len(t) - 60)))) : a + int(rng.integers(10, 60))] for t in texts]
    x, n = np.zeros((2 * len(texts), 1 << params.bits), np.float32), len(texts)
    for rows, some in ((x[:n], texts), (x[n:], cut)):
        _frequencies(some, params.bits, rows)
    y = codes[[languages.index(l) for l in langs] * 2]
    mean = x.mean(0, dtype=np.float64).astype(np.float32)
    std = np.sqrt(np.maximum(0, np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean.astype(np.float64) ** 2)).astype(np.float32) + np.float32(1e-4)  # no copy of x
    x -= mean
    x /= std
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    for step in range(params.steps):
        f = x @ w + b
        slope = -y / (1 + np.exp(np.clip(y * f, -30, 30))) / len(x)
        rate = params.rate * 20 / (20 + step)
        w -= rate * (x.T @ slope + params.decay * w)
        b -= rate * 10 * slope.sum(0)
    right = ((x @ w + b) * y > 0).mean(0)
    trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    loss = np.sort((np.logaddexp(0, -(x @ w + b)[:, None, :] * codes[None]) * (trust / trust.sum())).sum(2), axis=1)
    far = float(np.quantile(loss[:, 0], 1 - params.beyond))
    margin = max(params.margin, float(np.quantile(loss[:, 1] - loss[:, 0], params.beyond)))
    w = w / std[:, None]
    return EcocModel(languages, codes, np.ascontiguousarray(w.T.astype(np.float32)), (b - mean @ w).astype(np.float64), trust / trust.sum(), params.bits, margin, far)


def predict_texts(model: EcocModel, texts: list[str | None]) -> pd.DataFrame:
    n, k = len(texts), len(model.languages)
    lang, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
    known = np.array([isinstance(t, str) and has_letter(t) for t in texts], bool)
    if k == 1:
        lang[known], score[known] = model.languages[0], 1.0
    elif k > 1:
        for at, block in in_blocks(texts):
            data, ends = packed_bytes(block)
            h = gram_hashes(data, 3, model.bits)
            # Grams that reach over the end of a text count for none.
            keep = np.ones(len(h) + 2, bool)
            keep[ends[1:-1] - 1] = keep[ends[1:-1] - 2] = False
            keep[len(h) :] = False
            count = np.maximum(1, np.add.reduceat(keep, ends[:-1], dtype=np.int64))
            h = np.append(h, np.uint32([0, 0]))
            f = np.empty((len(block), len(model.tables)))
            for j, table in enumerate(model.tables):
                v = table[h]
                v[~keep] = 0
                f[:, j] = np.add.reduceat(v, ends[:-1], dtype=np.float64) / count + model.bias[j]
            loss = (np.logaddexp(0, -f[:, None, :] * model.codes[None]) * model.trust).sum(2)
            order = np.sort(loss, axis=1)
            best = loss.argmin(1)
            odds = np.exp(-(loss - order[:, :1]) * len(model.trust))
            rows = slice(at, at + len(block))
            ok = known[rows]
            lang[rows] = np.where(ok, np.array(model.languages, object)[best], "und")
            score[rows] = np.where(ok, 1 / odds.sum(1), 0.0)
            unsure[rows] = ok & ((order[:, 1] - order[:, 0] < model.margin) | (order[:, 0] > model.far))
    return pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": unsure})


def train(docs: DataFrame, params: EcocParams = EcocParams()) -> EcocModel:
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), params.folds) != params.held_out))
    rows = [r for r in bounded(rows, "doc_id", params.max_rows).collect() if has_letter(r.text)]
    return fit([r.text for r in rows], [r.lang for r in rows], params)


def predict(docs: DataFrame, model: EcocModel, into: str = "ecoc") -> DataFrame:
    """docs with a struct column `into`, which is not to be one of docs, of lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits x 2**bits numbers, whatever the input

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield predict_texts(shared.value, texts.tolist())

    udf = F.pandas_udf(predicted, "lang_pred string, score double, ambiguous boolean")
    return docs.withColumn(into, udf("text"))
