"""Importance resampling towards a target, with Arrow kernels for the n-grams.

Texts have A-Z lowered and are split at what is neither an ASCII letter or digit nor
beyond ASCII. Features are all runs of 1 to `ngrams` words joined by a space, repeats
counted; a feature's bucket is its CRC-32 modulo `buckets`. A bucket's gain is the log
ratio of its smoothed shares in the target and in the documents, in thousandths, rounded
down. A document's weight is the sum of its features' gains, and its score that and Gumbel
noise drawn by doc_id, so that the highest scores are a sample without replacement.

In a task, `ascii_lower`, `split_pattern_regex`, `list_flatten` and `dictionary_encode` give
the words as indices; sums of shifted indices and of earlier n-grams' are longer n-grams, of
which only distinct ones get a CRC; `take` brings gains to all places, and a segment sum to
documents. Two passes over the texts: one adds up buckets, which is all that the driver
sees (`buckets` numbers a side), one scores. Ranks are places in range partitions of (score,
doc_id), and what the partitions before hold: no task and no driver has all documents.

Drawn are floor(percent * N / 100) of the N documents with `least_words` words or more. A null
text has no words, weight 0 and a score. Ties go to the smaller doc_id; a null doc_id has the
noise of an empty id and comes last among ties. Repeated rows take part each. With an empty
target or no documents the smoothing alone makes gains. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

#: What stands between words.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ResampleParams:
    ngrams: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    block_bytes: int = 4_000_000


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Slices of texts with about `most` bytes each, one text at least, and the place of the first."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.append(True, np.diff(runs) > 0)) if len(runs) else runs
    for a, b in zip(starts, np.append(starts[1:], len(runs))):
        yield int(a), texts.slice(a, b - a)


def features(texts: pa.Array, params: ResampleParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts the bucket of each feature, the text that it is from, and the words of each text."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _GAPS)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(words, "")
    words, owner = words.filter(real).dictionary_encode(), owner.filter(real).to_numpy().astype(np.int64)
    names = [x.encode() for x in words.dictionary.to_pylist()]
    first = words.indices.to_numpy().astype(np.int64)
    gram, buckets, owners = first, [], []
    for n in range(params.ngrams):
        if n:  # one word longer: only where it is from the same text
            size = max(0, len(first) - n)
            gram = gram[:size] * len(first_names) + first[n:]
            inside = owner[:size] == owner[n:]
            distinct, at = np.unique(gram, return_inverse=True)
            names = [names[g // len(first_names)] + b" " + first_names[g % len(first_names)] for g in distinct]
            gram = at
        else:
            first_names, inside = names, np.ones(len(first), bool)
        crc = pa.array(np.fromiter((zlib.crc32(x) % params.buckets for x in names), np.int64, len(names)))
        buckets.append(crc.take(pa.array(gram[inside])).to_numpy())
        owners.append(owner[: len(gram)][inside])
    return np.concatenate(buckets), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def bucket_counts(texts: DataFrame, params: ResampleParams) -> np.ndarray:
    """Features in each bucket, over all rows' text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(params.buckets, np.int64)
        for batch in batches:
            for _, block in _slices(batch.column("text"), params.block_bytes):
                total += np.bincount(features(block, params)[0], minlength=params.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(params.buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, from the features there in documents and target."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, params: ResampleParams) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    by_bucket = pa.array(gains)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in _slices(batch.column("text"), params.block_bytes):
                bucket, owner, n_words = features(block, params)
                gain, n = by_bucket.take(pa.array(bucket)).to_numpy(), len(block)
                total = np.zeros(n, np.int64)
                np.add.at(total, owner, gain)
                n_features = np.bincount(owner, minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(n_words), pa.array(n_features), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def _noise(params: ResampleParams) -> Column:
    """Gumbel noise in thousandths, rounded down, by a hash of the seed and the id."""
    text = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams()) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, 3… of the drawn, others null) and n_words of every row; target: any table with a column `text`."""
    gains = bucket_gains(bucket_counts(docs, params), bucket_counts(target, params))
    rows = weights(docs, gains, params).withColumn("score", F.col("weight") + _noise(params))
    order = [F.col("takes_part").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Staged, because the ranges' splitters read all rows once before.
    rows = staged(rows.withColumn("takes_part", F.col("n_words") >= params.least_words), "weights")
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
    ranged = staged(ranged.withColumn("run", F.spark_partition_id()), "resample")
    # One row a partition: what the partitions before hold, and how many are drawn of all.
    sizes = ranged.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.col("takes_part").cast("long")).alias("some"))
    whole = Window.orderBy("run")
    before = F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(params.percent * F.sum("some").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / 100)
    runs = F.broadcast(sizes.select("run", before.alias("before"), drawn.alias("drawn")))
    place = F.row_number().over(Window.partitionBy("run").orderBy(*order)) + F.col("before")
    # Only runs that the draw reaches are put in order.
    first = ranged.join(runs.where("before < drawn"), "run")
    first = first.withColumn("place", F.when(F.col("takes_part"), place)).withColumn("rank", F.when(F.col("place") <= F.col("drawn"), F.col("place")))
    rest = ranged.join(runs.where("before >= drawn").select("run"), "run").withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"), "n_words"]
    return first.select(*columns).union(rest.select(*columns))
