"""MinHash near-duplicates with odd sketches.

A document's set is its distinct word shingles, as 64-bit hashes of their bytes.
Documents of one set form a class. Each class has MinHash samples, cut into bands to
find candidates, and folded into a parity bitmap (odd sketch): the ones in the XOR of
two bitmaps estimate high similarities closely.

Members of a band bucket are compared by their sketches. Whatever comes within five
deviations of the threshold is joined into a candidate component; a task gives out a spanning
forest of what it found, not the pairs. All linked pairs that share a bucket are inside one
candidate component. There the full sets meet: pairs whose sketches are near are confirmed
exactly, unless they are already joined, and a task's forest goes on.

Groups of more members than a block, buckets and components alike, are first held against a few
of their own members, a row each. What the one of these with most edges is joined to is a tree,
mostly the whole group. Only the others meet in pairs of blocks, with each other and with the
tree, one pair to a task; inside the tree nothing is left to compare. So a group of n near
copies costs a few rows a member, and k that stay apart cost n rows for each block of them.

Null and empty texts have the empty set and are linked with nothing. Repeated rows,
and rows of one doc_id, are linked by their texts like others. A null doc_id never is
the smallest. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from .common import ascii_words, in_blocks, span_hashes, staged

_U = np.uint64


@dataclass(frozen=True)
class NearParams:
    #: Linked where 100 * intersection >= percent * union.
    percent: int = 85
    words: int = 5
    bands: int = 24
    rows: int = 5
    sketch_bits: int = 512
    seed: int = 9
    #: Members of a block; a task holds two.
    block: int = 256
    #: A bucket of at most so many members is compared by a join.
    small: int = 12
    #: Members of a large group that all others are held against.
    leaders: int = 4

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        return j - 5 * (j * (1 - j) / self.samples) ** 0.5


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, block in in_blocks(texts):
        h, counts = span_hashes([ascii_words(t) for t in block], words)
        at = 0
        for k in counts.tolist():
            yield np.unique(h[at : at + max(k - words + 1, min(k, 1))])
            at += k


def _samples(shingles: np.ndarray, params: NearParams) -> np.ndarray:
    rng = np.random.default_rng(params.seed)
    a = rng.integers(0, 1 << 31, params.samples, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, params.samples, dtype=np.uint32)[:, None]
    x = (shingles ^ (shingles >> _U(32))).astype(np.uint32)
    return np.min([(a * x[k : k + 4096] + b).min(1) for k in range(0, len(x), 4096)], axis=0)


def odd_sketch(samples: np.ndarray, bits: int) -> bytes:
    """Bit h(i, sample i) flips for every sample."""
    x = samples.astype(_U) * _U(0x9E3779B97F4A7C15) + np.arange(len(samples), dtype=_U) * _U(0xD1B54A32D192ED03)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return np.packbits(np.bincount((x >> _U(40)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1).tobytes()


def estimate(ones: np.ndarray, params: NearParams) -> np.ndarray:
    """Similarity from the number of ones in the XOR of two sketches."""
    n = params.sketch_bits
    return 1 + n / (4 * params.samples) * np.log(np.maximum(1 - 2 * ones / n, 1e-9))


def signatures(docs: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, n_shingles, key (the set), sketch, bands; key and the rest are null for an empty set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(params.seed + 1).integers(1, 1 << 62, (params.bands, params.rows), dtype=_U) | _U(1)
        for batch in batches:
            n, key, sketch, bands = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), params.words):
                n.append(len(s))
                if not len(s):
                    key.append(None), sketch.append(None), bands.append(None)
                    continue
                m = _samples(s, params)
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(odd_sketch(m, params.sketch_bits))
                h = ((m.reshape(params.bands, params.rows).astype(_U) + _U(1)) * weights).sum(1, dtype=_U)
                h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
                bands.append((h ^ np.arange(params.bands, dtype=_U)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(signed, "doc_id long, n_shingles long, key binary, sketch binary, bands array<long>")


class _Forest:
    """Union-find over a few places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def edges(self, names: np.ndarray) -> pd.DataFrame:
        """Each place's name with that of the first place of its tree. Names in order make the same edges in many tasks, which distinct then takes for one."""
        return pd.DataFrame([(names[self.find(x)], names[x]) for x in range(len(names)) if self.find(x) != x], columns=["a", "b"])


def _near_pairs(sketches: list[bytes], own: np.ndarray, i: int, j: int, params: NearParams) -> Iterator[tuple[int, int]]:
    """Places whose sketches come near the threshold: inside a block if i = j, else between the two."""
    bits = np.frombuffer(b"".join(sketches), _U).reshape(len(sketches), -1)
    right = np.flatnonzero(own == j)
    for x in np.flatnonzero(own == i).tolist():
        others = right[right > x] if i == j else right
        e = estimate(np.bitwise_count(bits[others] ^ bits[x]).sum(1, dtype=np.int64), params)
        for y in others[e >= params.least_estimate].tolist():
            yield x, y


def _in_blocks(rows: DataFrame, params: NearParams) -> DataFrame:
    """rows (with key, tree, and in_tree and apart, the members of their group in its main tree and outside) once for each pair of blocks that their own is part of: own, i, j. Blocks of the main tree do not meet each other."""
    blocks = lambda c: F.ceil(F.col(c) / params.block)
    hashed = lambda n: F.pmod(F.xxhash64("key"), F.greatest(n, F.lit(1)))
    sized = rows.withColumn("mains", blocks("in_tree")).withColumn("rests", blocks("apart")).where("rests > 0")
    sized = sized.withColumn("own", F.when(F.col("tree"), hashed(F.col("mains"))).otherwise(F.col("mains") + hashed(F.col("rests"))))
    first = F.when(F.col("tree"), F.col("mains")).otherwise(0)
    dealt = sized.withColumn("other", F.explode(F.sequence(first, F.col("mains") + F.col("rests") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "mains", "rests", "in_tree", "apart")


def _led(rows: DataFrame, group: str, payload: str, near: Callable[[pd.Series, pd.Series], pd.Series], params: NearParams) -> tuple[DataFrame | None, DataFrame]:
    """Of groups of members (group, key, n, payload): edges (a, b) of those near a leader, and rows with tree, in_tree, apart. A group's main tree is what its leader of most edges is joined to. Groups up to a block have no leaders, and all of them are apart."""
    small = rows.where(F.col("n") <= params.block).withColumns({"tree": F.lit(False), "in_tree": F.lit(0).cast("long"), "apart": F.col("n")}).drop("n")
    large = rows.where(F.col("n") > params.block)
    seat = F.pmod(F.xxhash64("key"), F.lit(params.leaders))
    lead = staged(large.groupBy(group, seat.alias("seat")).agg(F.min(F.struct("key", payload)).alias("lead")), "leaders")
    if lead.isEmpty():
        return None, small
    lead = lead.select(group, F.col("lead.key").alias("lead"), F.col(f"lead.{payload}").alias("lead_is"))
    met = large.select(group, "key", payload).join(lead, group).where(F.col("key") != F.col("lead")).where(F.pandas_udf(near, "boolean")(payload, "lead_is"))
    linked = staged(met.select(group, "lead", "key").distinct(), "led")  # rows of one id and text are there twice
    best = linked.groupBy(group, "lead").count().groupBy(group).agg(F.max(F.struct("count", "lead")).alias("m")).select(group, F.col("m.lead").alias("lead"), (F.col("m.count") + 1).alias("in_tree"))
    tree = linked.join(best, [group, "lead"]).select(group, "key", F.lit(True).alias("tree")).union(best.select(group, F.col("lead").alias("key"), F.lit(True)))
    told = large.join(tree, [group, "key"], "left").join(best.select(group, "in_tree"), group, "left").fillna({"tree": False, "in_tree": 0})
    told = told.withColumn("apart", F.col("n") - F.col("in_tree")).where("apart > 0")
    # An edge a member, to the first leader that it is near, and what joins leaders.
    first = linked.groupBy(group, "key").agg(F.min("lead").alias("a"), F.collect_set("lead").alias("leads"))
    edges = first.select("a", F.col("key").alias("b")).union(first.where("size(leads) > 1").select("a", F.explode("leads").alias("b")).where("a <> b")).distinct()
    return edges, small.unionByName(told.select(*small.columns))


def _candidates(buckets: DataFrame, classes: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares a bucket and looks similar. buckets: band, key, n."""
    least = params.least_estimate

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), _U).reshape(len(s), -1) for s in (x, y))
        return pd.Series(estimate(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), params))

    few = buckets.where(F.col("n") <= params.small).select("band", "key")
    pairs = few.toDF("band", "a").join(few.toDF("band", "b"), "band").where("a < b").select("a", "b").distinct()
    side = classes.select("key", "sketch")
    pairs = pairs.join(side.toDF("a", "x"), "a").join(side.toDF("b", "y"), "b").where(similar("x", "y") >= least).select("a", "b")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, forest = rows.sort_values("key"), _Forest(len(rows))
        for x, y in _near_pairs(list(rows["sketch"]), rows["own"].to_numpy(), key[1], key[2], params):
            forest.join(x, y)
        return forest.edges(rows["key"].to_numpy(object))

    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), _U).reshape(len(s), -1) for s in (x, y))
        return pd.Series(estimate(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), params) >= least)

    many = buckets.where(F.col("n") > params.small).join(side, "key").select("band", "key", "n", "sketch")
    edges, many = _led(many, "band", "sketch", near, params)
    if edges is not None:
        pairs = pairs.union(edges)
    many = _in_blocks(many, params).select("band", "i", "j", "own", "key", "sketch")
    return pairs.union(many.groupBy("band", "i", "j").applyInPandas(compare, "a binary, b binary"))


def _confirmed(groups: DataFrame, classes: DataFrame, docs: DataFrame, params: NearParams) -> DataFrame:
    """Edges (a, b) whose components are those of all links; links are confirmed on full sets. groups: node, label (the candidate component)."""
    size = groups.groupBy("label").agg(F.count("*").alias("n"))
    members = groups.join(size, "label").withColumnRenamed("node", "key").join(classes.select("key", "row", "sketch"), "key")
    members = staged(members, "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), params.words)]
            # A row's id can be shared by another text: only the set that the class has goes on.
            at = pa.array([i for i, (s, k) in enumerate(zip(found, batch.column("key").to_pylist())) if xxhash.xxh3_128_digest(s) == k], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("label", "key", "n", "sketch")] + [pa.array([found[i] for i in at.to_pylist()], pa.binary())], ["label", "key", "n", "sketch", "shingles"])

    def check(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("key").sort_values("key")  # rows of one id and text are there twice
        forest = _Forest(len(rows))
        own = [np.frombuffer(s, _U) for s in rows["shingles"]]
        for x, y in _near_pairs(list(rows["sketch"]), rows["own"].to_numpy(), key[1], key[2], params):
            a, b = own[x], own[y]
            if 100 * min(len(a), len(b)) >= params.percent * max(len(a), len(b)) and forest.find(x) != forest.find(y):
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= params.percent * (len(a) + len(b) - both):
                    forest.join(x, y)
        return forest.edges(rows["key"].to_numpy(object))

    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            a, b = np.frombuffer(a, _U), np.frombuffer(b, _U)
            both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= params.percent * max(len(a), len(b)) else 0
            out.append(both > 0 and 100 * both >= params.percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    # Both sides are dealt by the row's id whatever the size of one, so that cost stays in proportion.
    texts = docs.select(F.xxhash64("doc_id").alias("row"), "text").join(members.hint("merge"), "row").select("label", "key", "n", "sketch", "text")
    found = staged(texts.mapInArrow(sets, "label binary, key binary, n long, sketch binary, shingles binary"), "sets")
    edges, told = _led(found, "label", "shingles", linked, params)
    blocks = _in_blocks(told, params).select("label", "i", "j", "own", "key", "sketch", "shingles")
    out = blocks.groupBy("label", "i", "j").applyInPandas(check, "a binary, b binary")
    return out if edges is None else out.union(edges)


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = staged(signatures(docs, params), "signatures")
    some = rows.where("n_shingles > 0")
    # One row for each set, with a row that has its text.
    classes = some.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = staged(classes.withColumn("row", F.xxhash64("least")), "classes")
    buckets = classes.select("key", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = staged(buckets.join(sizes, "band"), "buckets")
    groups = connected_components(_candidates(buckets, classes, params))
    labels = connected_components(_confirmed(groups, classes, docs, params))

    named = classes.select("key", "least").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("key", "component_id")
    out = some.select("doc_id", "n_shingles", "key").join(named, "key").select("doc_id", "n_shingles", "component_id")
    out = out.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
