"""Language-model scoring with a log-frequency Bloom filter.

All n-grams (words and pairs of words) of the training documents are counted by hash. A
count c is kept as its level 1 + floor(log2 c), by entering the n-gram with each level up
to its own into a Bloom filter. A lookup probes level after level until one is missing. A
level stands for the middle of its counts, and a word's probability is what its level stands
for, plus one, over the sum of that over all words and one unknown word. A pair's is its part
of what the levels of all pairs after the same word stand for, and of what a filter so full
is expected to make up; it is interpolated with the second word's, which has all the weight
after a word that was never seen. So probabilities sum to one, but for chance in the filter.

The model is a table of segments: the filter's bits, the exact counts of the segment's words
(on which the base score rests), and the sums of what follows each. `bits_per_event` bits for
each level entered make it grow with the input, and its error rate not. A pair is in the
segment of its first word; those of a frequent one (a list bounded by the number of
segments) are dealt by their own hash to as many segments as its share asks for, so that no
word makes a segment large. Words are told apart
by 64-bit hashes, pairs after one word by 32-bit ones.

Texts go in blocks, written once as token numbers under a number each, so that neither other
file splits nor a lost executor gives a block other texts. A model of up to `broadcast_bytes` goes
to all workers. For a larger one a block asks each segment once for its distinct n-grams, and
the answers are joined to the blocks; a row of questions has at least one n-gram, so there
are never more rows than tokens. Texts that are at hand when the model is made (fit_score) are
answered in the exchange that makes it, which gives the same scores.

A null or empty text is the end token alone. Repeated rows are scored each. With an
empty training side every count is 0. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, fold, in_blocks, mixed, shuffle_partitions, span_hashes, staged

_U = np.uint64
#: What stands for the end token, which is also what stands before the first word.
_END_HASH = _U(0xA0761D6478BD642F)


@dataclass(frozen=True)
class LmParams:
    folds: int = 7
    held_out: int = 2
    bits_per_event: int = 24
    probes: int = 10
    levels: int = 40
    #: Weight of the pair's probability; the word's has the rest.
    pair_weight: float = 0.3
    least_segments: int = 256
    block_chars: int = 4_000_000
    #: Characters of a block that are hashed at a time, at some sixty bytes each.
    hash_chars: int = 500_000
    piece_bytes: int = 250_000
    broadcast_bytes: int = 8_000_000


@dataclass(frozen=True)
class LogFrequencyFilter:
    bits: np.ndarray  # packed
    size: int  # bits
    probes: int
    levels: int

    @property
    def false_rate(self) -> float:
        """The share of n-grams never entered that it is expected to have."""
        return float(np.unpackbits(self.bits, count=self.size).mean() ** self.probes) if self.bits.any() else 0.0


@dataclass(frozen=True)
class Model:
    """table: segment, words, counts, follows, bits, size, false_rate (see `fit`)."""

    table: DataFrame
    params: LmParams
    tokens: int  # in training
    types: int
    mass: float  # what the levels of all words stand for
    frequent: dict[int, tuple[float, int]]  # words whose pairs are in several segments: what follows them, and in how many
    false_rate: float  # mean over segments
    segments: int

    def save(self, path: str) -> None:
        self.table.write.parquet(f"{path}/segments")
        row = (self.tokens, self.types, self.mass, [int(np.uint64(x).view(np.int64)) for x in self.frequent], [x for x, _ in self.frequent.values()], [x for _, x in self.frequent.values()], self.false_rate, self.segments)
        self.table.sparkSession.createDataFrame([row], "tokens long, types long, mass double, words array<long>, follows array<double>, widths array<int>, false_rate double, segments int").coalesce(1).write.parquet(f"{path}/totals")


def load(spark: SparkSession, path: str, params: LmParams = LmParams()) -> Model:
    t = spark.read.parquet(f"{path}/totals").first()
    frequent = dict(zip((int(np.int64(x).view(_U)) for x in t.words), zip(t.follows, t.widths)))
    return Model(spark.read.parquet(f"{path}/segments"), params, t.tokens, t.types, t.mass, frequent, t.false_rate, t.segments)


def _positions(h: np.ndarray, level: int, i: int, size: int) -> np.ndarray:
    """Bit of probe i of a level."""
    step = mixed(h + _U(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    return ((step >> _U(32)) + _U(i) * (step & _U(0xFFFFFFFF) | _U(1))) % _U(size)


def build(h: np.ndarray, counts: np.ndarray, params: LmParams) -> LogFrequencyFilter:
    """The filter of n-grams and their counts; those of count 0 do not enter."""
    h, counts = h[counts > 0], counts[counts > 0]
    top = np.minimum((np.log2(counts) + 1e-9).astype(np.int64) + 1, params.levels)
    size = max(1 << 10, int(top.sum()) * params.bits_per_event)
    bits = np.zeros(size, np.uint8)
    for k in range(1, int(top.max(initial=0)) + 1):
        own = h[top >= k]
        for i in range(params.probes):
            bits[_positions(own, k, i, size).astype(np.int64)] = 1
    return LogFrequencyFilter(np.packbits(bits), size, params.probes, params.levels)


def levels(f: LogFrequencyFilter, h: np.ndarray) -> np.ndarray:
    """The level of each hash: the number of levels in a row, from 1, whose probes are all set."""
    out, live = np.zeros(len(h), np.uint8), np.arange(len(h))
    for k in range(1, f.levels + 1):
        for i in range(f.probes):
            at = _positions(h[live], k, i, f.size).astype(np.int64)
            live = live[(f.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
            if not len(live):
                return out
        out[live] = k
    return out


def stands_for(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of each level."""
    return np.where(level > 1, 0.75 * 2.0 ** level.astype(float), level.astype(float))


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, first all their low bytes, which compresses better."""
    return np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


_BLOCK = "block long, piece int, pieces int, data binary"


def encoded(docs: DataFrame, params: LmParams) -> DataFrame:
    """Blocks of texts: the documents, the distinct hashes of the tokens in order, and each token's place among them; in rows of `piece_bytes`, which Spark handles better than a large one. A task's file is one row group, so that no other task gets half of a block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in in_blocks(batch.column("text").to_pylist(), params.block_chars):
                hashed = [span_hashes([ascii_words(t) for t in some]) for _, some in in_blocks(texts, params.hash_chars)]
                h, n = _all([x for x, _ in hashed], _U), _all([x for _, x in hashed])
                tokens = np.full(len(h) + len(n), _END_HASH, _U)
                own = np.ones(len(tokens), bool)
                own[np.cumsum(n + 1) - 1] = False
                tokens[own] = h
                words, places = np.unique(tokens, return_inverse=True)
                some = batch.slice(at, len(texts))
                data = pickle.dumps({"doc_ids": some.column("doc_id").to_pylist(), "train": np.array(some.column("train").to_pylist(), bool), "sizes": n + 1, "words": words.astype("<u8").tobytes(), "places": _planes(places)})
                cut = [data[k : k + params.piece_bytes] for k in range(0, len(data), params.piece_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array([len(cut)] * len(cut), pa.int32()), pa.array(cut, pa.binary())], ["block", "piece", "pieces", "data"])
                block += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), params.folds) != params.held_out).alias("train"), "text")
    return staged(rows.mapInArrow(blocks, _BLOCK), "blocks", **{"parquet.block.size": str(1 << 30)})


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks from rows of pieces in order."""
    data: list[bytes] = []
    for batch in batches:
        for k in range(batch.num_rows):
            block, piece, pieces, part = (batch.column(c)[k].as_py() for c in range(4))
            if piece != len(data):
                raise ValueError(f"block {block} is in pieces")
            data.append(part)
            if len(data) == pieces:
                yield pickle.loads(b"".join(data)) | {"block": block}
                data = []
    if data:
        raise ValueError(f"block {block} is in pieces")


class _Block:
    """Distinct tokens and pairs of a block, in the order in which segments are asked for them."""

    def __init__(self, words: bytes, places: bytes, sizes: np.ndarray, frequent: np.ndarray, segments: int):
        self.bits = _U(64 - int(np.log2(segments)))
        self.words, self.places, self.sizes = np.frombuffer(words, "<u8").astype(_U), _unplaned(places), np.asarray(sizes, np.int64)
        n = len(self.words)
        before = np.roll(self.places, 1)  # the token before a text is the end token of the one before it
        if n:
            before[0] = np.searchsorted(self.words, _END_HASH)
        pairs, self.pair_of = np.unique(before * n + self.places, return_inverse=True)
        self.first = pairs // max(n, 1)
        h = mixed(self.words[self.first] * _U(0x9E3779B97F4A7C15) + self.words[pairs % max(n, 1)] + _U(0x2545F4914F6CDD1D))
        self.key = h >> _U(32)
        known, widths = frequent
        at = np.minimum(np.searchsorted(known, self.words), max(len(known) - 1, 0))
        often = (known[at] == self.words) if len(known) else np.zeros(n, bool)
        self.frequent_of = at[self.first]
        spread = often[self.first]
        segment = self.words[self.first] >> self.bits
        if spread.any():
            segment[spread] = (segment[spread] + mixed(h[spread]) % widths[self.frequent_of[spread]]) % _U(segments)
        segment = segment.astype(np.int64)
        # By segment, those of its own words first, in the order of words.
        self.order = np.lexsort((self.frequent_of * spread, spread, segment))
        self.spread = spread[self.order]
        edge = np.arange(segments + 1)
        self.word_edges = np.searchsorted((self.words >> self.bits).astype(np.int64), edge)
        self.pair_edges = np.searchsorted(segment[self.order], edge)

    def asked(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a segment: words; keys of pairs after each of them, and how many follow each; keys of pairs after frequent words, and the numbers of these."""
        a, b = self.word_edges[s : s + 2]
        own = self.order[self.pair_edges[s] : self.pair_edges[s + 1]]
        spread = self.spread[self.pair_edges[s] : self.pair_edges[s + 1]]
        near, far = own[~spread], own[spread]
        return self.words[a:b], self.key[near], np.bincount(self.first[near] - a, minlength=b - a), self.key[far], self.frequent_of[far]

    def asks(self, segments: int) -> np.ndarray:
        return np.flatnonzero((np.diff(self.word_edges) > 0) | (np.diff(self.pair_edges) > 0))


def _elements(word: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What stands for pairs in the filter: first word and key."""
    return mixed(word * _U(0xC2B2AE3D27D4EB4F) + key + _U(0x8EBC6AF09C88C6E3))


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, which the first byte tells."""
    kind = next(k for k in (1, 4, 8) if k == 8 or counts.max(initial=0) < 1 << (8 * k))
    return bytes([kind]) + counts.astype(f"<u{kind}").tobytes()


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], f"<u{data[0]}").astype(np.int64)


def _all(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


_ASKED = ["words", "keys", "followers", "far_keys", "far_words"]
_ASKS = "segment long, block long, words binary, keys binary, followers binary, far_keys binary, far_words binary, word_counts binary, pair_counts binary"
_TABLE = "words binary, counts binary, follows binary, bits binary, size long, false_rate double"
_ANSWERS = "block long, segment long, word_counts binary, word_levels binary, follows binary, pair_levels binary, false_rate double, digest long"


def _questions(blocks: DataFrame, frequent: np.ndarray, segments: int, counted: bool) -> DataFrame:
    """What each block asks each segment, with its training counts if `counted`."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _whole(batches):
            b = _Block(row["words"], row["places"], row["sizes"], frequent, segments)
            learn = np.repeat(row["train"], b.sizes) if counted else np.zeros(len(b.places), bool)
            wc, pc = np.bincount(b.places[learn], minlength=len(b.words)), np.bincount(b.pair_of[learn], minlength=len(b.key))[b.order]
            asks = b.asks(segments)
            for at in range(0, len(asks), 64):
                some, out = asks[at : at + 64], {n: [] for n in [*_ASKED, "word_counts", "pair_counts"]}
                for s in some:
                    words, keys, followers, far, far_words = b.asked(s)
                    for name, x in zip(_ASKED, (words.astype("<u8").tobytes(), keys.astype("<u4").tobytes(), _small(followers), far.astype("<u4").tobytes(), _planes(far_words))):
                        out[name].append(x)
                    out["word_counts"].append(_small(wc[b.word_edges[s] : b.word_edges[s + 1]]))
                    out["pair_counts"].append(_small(pc[b.pair_edges[s] : b.pair_edges[s + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(np.full(len(some), row["block"]), pa.int64()), *(pa.array(x, pa.binary()) for x in out.values())], ["segment", "block", *out])

    return blocks.mapInArrow(asked, _ASKS)


class _Asked:
    """The questions to one segment, of all blocks that have any."""

    def __init__(self, rows: pd.DataFrame, frequent: np.ndarray):
        self.words = [np.frombuffer(x, "<u8").astype(_U) for x in rows["words"]]
        self.keys = [np.frombuffer(x, "<u4").astype(_U) for x in rows["keys"]]
        followers = [_large(x) for x in rows["followers"]]
        self.firsts = [np.repeat(w, n) for w, n in zip(self.words, followers)]
        self.far_keys = [np.frombuffer(x, "<u4").astype(_U) for x in rows["far_keys"]]
        self.far_words = [frequent[0][_unplaned(x)] if len(frequent[0]) else np.zeros(0, _U) for x in rows["far_words"]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and key of all pairs, as they were asked for block by block."""
        first = _all([x for a, b in zip(self.firsts, self.far_words) for x in (a, b)], _U)
        return first, _all([x for a, b in zip(self.keys, self.far_keys) for x in (a, b)], _U)


def _digest(words: np.ndarray, keys: np.ndarray, far: np.ndarray) -> int:
    return zlib.crc32(far.astype("<u4").tobytes(), zlib.crc32(keys.astype("<u4").tobytes(), zlib.crc32(words.astype("<u8").tobytes())))


def _answers(segment: int, rows: pd.DataFrame, asked: _Asked, words: np.ndarray, counts: np.ndarray, follows: np.ndarray, f: LogFrequencyFilter, false_rate: float) -> pd.DataFrame:
    """For each block the counts, levels and followers' sums of its words, and the levels of its pairs."""
    all_words = _all(asked.words, _U)
    at = np.minimum(np.searchsorted(words, all_words), max(len(words) - 1, 0))
    known = words[at] == all_words if len(words) else np.zeros(len(all_words), bool)
    c = np.where(known, counts[at], 0) if len(words) else np.zeros(len(all_words), np.int64)
    s = np.where(known, follows[at], 0.0) if len(words) else np.zeros(len(all_words))
    wl, pl = levels(f, all_words), levels(f, _elements(*asked.pairs()))
    we = np.cumsum([0, *map(len, asked.words)])
    pe = np.cumsum([0, *(len(a) + len(b) for a, b in zip(asked.keys, asked.far_keys))])
    cut = lambda x, e, to: [to(x[i:j]) for i, j in zip(e[:-1], e[1:])]
    return pd.DataFrame({
        "block": rows["block"].to_numpy(), "segment": segment, "word_counts": cut(c, we, _small), "word_levels": cut(wl, we, np.ndarray.tobytes), "follows": cut(s, we, lambda x: x.astype("<f4").tobytes()),
        "pair_levels": cut(pl, pe, np.ndarray.tobytes), "false_rate": false_rate, "digest": [_digest(*x) for x in zip(asked.words, asked.keys, asked.far_keys)],
    })


_FITTED = f"segment long, {_TABLE}, tokens long, mass double, frequent array<long>, frequent_follows array<double>, answer struct<{', '.join(x.replace(' ', ': ') for x in _ANSWERS.split(', '))}>"


def _fitted(blocks: DataFrame, frequent: np.ndarray, segments: int, params: LmParams, answer: bool) -> DataFrame:
    """A row for each segment of the model, and if asked for one for each block and segment with its answers."""

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        asked = _Asked(rows, frequent)
        words, inverse = np.unique(_all(asked.words, _U), return_inverse=True)
        counts = np.bincount(inverse, weights=_all([_large(x) for x in rows["word_counts"]]), minlength=len(words)).astype(np.int64)
        seen = counts > 0
        first, pair_key = asked.pairs()
        n = _all([_large(x) for x in rows["pair_counts"]])
        first, pair_key, n = first[n > 0], pair_key[n > 0], n[n > 0]
        starts, at = np.unique(first, return_inverse=True)
        both, at = np.unique(at.astype(_U) << _U(32) | pair_key, return_inverse=True)
        n = np.bincount(at, weights=n, minlength=len(both)).astype(np.int64)
        first, pair_key = starts[(both >> _U(32)).astype(np.int64)], both & _U(0xFFFFFFFF)
        words, counts = words[seen], counts[seen]
        f = build(np.append(words, _elements(first, pair_key)), np.append(counts, n), params)
        worth = stands_for(levels(f, _elements(first, pair_key)))
        sums = np.bincount((both >> _U(32)).astype(np.int64), weights=worth, minlength=len(starts))
        place = np.minimum(np.searchsorted(starts, words), max(len(starts) - 1, 0))
        follows = np.where(starts[place] == words, sums[place], 0.0) if len(starts) else np.zeros(len(words))
        often = np.isin(starts, frequent[0])
        out = {
            "segment": key[0], "words": words.astype("<u8").tobytes(), "counts": _small(counts), "follows": follows.astype("<f4").tobytes(), "bits": f.bits.tobytes(), "size": f.size, "false_rate": f.false_rate,
            "tokens": int(counts.sum()), "mass": float(stands_for(levels(f, words)).sum()), "frequent": starts[often].astype(np.int64).tolist(), "frequent_follows": sums[often].tolist(), "answer": None,
        }
        out = pd.DataFrame([out])
        if answer:
            found = _answers(key[0], rows, asked, words, counts, follows, f, f.false_rate)
            out = pd.concat([out, pd.DataFrame({"segment": key[0], "answer": found.to_dict("records")})], ignore_index=True)
            out = out.reindex(columns=[x.split(" ")[0] for x in f"segment long, {_TABLE}, tokens long, mass double, frequent array<long>, frequent_follows array<double>, answer x".split(", ")]).astype(object)
            out = out.where(out.notna(), None)
        return out

    return _questions(blocks, frequent, segments, True).groupBy("segment").applyInPandas(fitted, _FITTED)


def _frequent(blocks: DataFrame, segments: int) -> np.ndarray:
    """Hashes of words whose share of the training tokens is a quarter of a segment's or more (4 * segments at most; of those that have half of that share in some task), and over how many segments their pairs are dealt: twice as many as their share, in all 8 * segments at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = {}, 0
        for row in _whole(batches):
            words, places = np.frombuffer(row["words"], "<u8"), _unplaned(row["places"])
            c = np.bincount(places[np.repeat(row["train"], row["sizes"])], minlength=len(words))
            n += int(c.sum())
            for k in np.flatnonzero(8 * segments * c >= max(1, c.sum())):
                total[int(words[k])] = total.get(int(words[k]), 0) + int(c[k])
        out = [(w, c) for w, c in total.items() if 8 * segments * c >= n]
        w, c = [x for x, _ in out] + [0], [x for _, x in out] + [n]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(w, _U).astype(np.int64)), pa.array(np.array(c, np.int64)), pa.array([False] * len(out) + [True])], ["word", "n", "whole"])

    found = staged(blocks.mapInArrow(counted, "word long, n long, whole boolean").groupBy("whole", "word").agg(F.sum("n").alias("n")), "frequent")
    n = max(1, found.where("whole").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = found.where(~F.col("whole") & (F.col("n") * 4 * segments >= n)).select("word", "n").collect()
    words, shares = np.array([r.word for r in rows], np.int64).view(_U), np.array([r.n * segments / n for r in rows])
    order = np.argsort(words)
    widths = np.minimum(segments, np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(2 * shares, 1)))))
    return np.stack([words[order], widths[order].astype(_U)]) if len(rows) else np.zeros((2, 0), _U)


def _model(rows: DataFrame, frequent: np.ndarray, segments: int, params: LmParams) -> Model:
    table = rows.where("answer is null")
    t = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0.0)), F.sum("false_rate"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    sums = table.select(F.inline(F.arrays_zip("frequent", "frequent_follows"))).groupBy("frequent").agg(F.sum("frequent_follows").alias("n")).collect()  # 4 * segments rows at most
    sums = {int(np.int64(r.frequent).view(_U)): r.n for r in sums}
    follows = {int(x): (sums.get(int(x), 0.0), int(k)) for x, k in frequent.T}
    return Model(table.select("segment", *(x.split(" ")[0] for x in _TABLE.split(", "))), params, t[0], t[3] // 8, t[1], follows, (t[2] or 0.0) / segments, segments)


def _segments(spark: SparkSession, params: LmParams) -> int:
    return max(params.least_segments, 1 << int(np.ceil(np.log2(8 * shuffle_partitions(spark)))))


def fit(docs: DataFrame, params: LmParams = LmParams()) -> Model:
    """The model of the training documents among docs."""
    segments, blocks = _segments(docs.sparkSession, params), encoded(docs, params)
    frequent = _frequent(blocks, segments)
    return _model(staged(_fitted(blocks, frequent, segments, params, False), "model"), frequent, segments, params)


def log_probabilities(model: Model, one: np.ndarray, two: np.ndarray, follows: np.ndarray, false_rate: np.ndarray) -> np.ndarray:
    """log10 probability of tokens, from their levels, those of the pairs with what is before them, and the sums and the filter's false rate of what can follow that."""
    word = (stands_for(one) + 1) / (model.mass + model.types + 1)
    pair = np.minimum(1, stands_for(two) / np.maximum(follows + false_rate * model.types, 1))
    weight = np.where(follows > 0, model.params.pair_weight, 0.0)
    return np.log10(weight * pair + (1 - weight) * word)


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def token_logs(model: Model, b: _Block, found: list[dict]) -> np.ndarray:
    """log10 probability of each of a block's tokens, from its answers, one for each segment that it asked, in order."""
    join = lambda name, kind: np.frombuffer(b"".join(x[name] for x in found), kind)
    one, follows = join("word_levels", "u1"), join("follows", "<f4").astype(float)
    two = np.zeros(len(b.key), np.uint8)
    two[b.order] = join("pair_levels", "u1")
    false = np.repeat([x["false_rate"] for x in found], [len(x["word_levels"]) for x in found])
    if model.frequent:
        keys = np.array(list(model.frequent), _U)
        order = np.argsort(keys)
        keys, sums = keys[order], np.array([x for x, _ in model.frequent.values()])[order]
        at = np.minimum(np.searchsorted(keys, b.words), len(keys) - 1)
        often = keys[at] == b.words
        follows, false = np.where(often, sums[at], follows), np.where(often, model.false_rate, false)
    first = b.first[b.pair_of]
    return log_probabilities(model, one[b.places], two[b.pair_of], follows[first], false[first])


def _scored(model: Model, b: _Block, doc_ids: list, found: list[dict]) -> pd.DataFrame:
    """Scores of a block's documents."""
    logs = token_logs(model, b, found)
    c = _all([_large(x["word_counts"]) for x in found])[b.places]
    starts = np.append(0, np.cumsum(b.sizes)[:-1])
    summed = lambda x: np.add.reduceat(x, starts)
    base = np.log10((c + 1) / (model.tokens + model.types + 1))
    return pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "n_tokens": b.sizes, "n_known": summed((c > 0).astype(np.int64)), "base_score": summed(base), "score": summed(logs)})


def _known(model: Model) -> np.ndarray:
    """Frequent words in order, and over how many segments their pairs are dealt."""
    rows = sorted((w, k) for w, (_, k) in model.frequent.items())
    return np.array(rows, _U).reshape(-1, 2).T.copy()


def _bare(model: Model) -> Model:
    return Model(None, model.params, model.tokens, model.types, model.mass, model.frequent, model.false_rate, model.segments)


def _joined(blocks: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    bare, frequent = _bare(model), _known(model)

    def scored(key: tuple, block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        (row,) = _whole([pa.RecordBatch.from_pandas(block.sort_values("piece")[["block", "piece", "pieces", "data"]], preserve_index=False)])
        b = _Block(row["words"], row["places"], row["sizes"], frequent, bare.segments)
        found = found.sort_values("segment").to_dict("records")
        asked = [b.asked(x["segment"]) for x in found]
        if [x["segment"] for x in found] != b.asks(bare.segments).tolist() or any(x["digest"] != _digest(a[0], a[1], a[3]) for x, a in zip(found, asked)):
            raise ValueError("answers of another block")
        return _scored(bare, b, list(row["doc_ids"]), found)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, _SCORES)


def _loaded(row: dict, params: LmParams) -> tuple:
    return np.frombuffer(row["words"], "<u8").astype(_U), _large(row["counts"]), np.frombuffer(row["follows"], "<f4").astype(float), LogFrequencyFilter(np.frombuffer(row["bits"], "u1"), row["size"], params.probes, params.levels), row["false_rate"]


def _empty(params: LmParams) -> tuple:
    """A segment without training text."""
    return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0), build(np.zeros(0, _U), np.zeros(0, np.int64), params), 0.0


def looked_up(model: Model, b: _Block, table: dict[int, tuple], frequent: np.ndarray) -> list[dict]:
    """A block's answers from segments at hand."""
    found, none = [], _empty(model.params)
    for s in b.asks(model.segments):
        words, keys, followers, far, far_words = b.asked(s)
        one = pd.DataFrame({"block": [0], "words": [words.astype("<u8").tobytes()], "keys": [keys.astype("<u4").tobytes()], "followers": [_small(followers)], "far_keys": [far.astype("<u4").tobytes()], "far_words": [_planes(far_words)]})
        found += _answers(int(s), one, _Asked(one, frequent), *table.get(s, none)).to_dict("records")
    return found


def _probed(blocks: DataFrame, model: Model) -> DataFrame:
    """Scores by a model that all workers have."""
    bare, frequent = _bare(model), _known(model)
    sent = blocks.sparkSession.sparkContext.broadcast({r.segment: r.asDict() for r in model.table.collect()})  # broadcast_bytes at most

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {s: _loaded(r, bare.params) for s, r in sent.value.items()}
        for row in _whole(batches):
            b = _Block(row["words"], row["places"], row["sizes"], frequent, bare.segments)
            yield pa.RecordBatch.from_pandas(_scored(bare, b, row["doc_ids"], looked_up(bare, b, table, frequent)), preserve_index=False)

    return blocks.mapInArrow(scored, _SCORES)


def _asked(blocks: DataFrame, model: Model) -> DataFrame:
    """Scores by a model of any size: blocks ask its segments."""
    bare, frequent = _bare(model), _known(model)

    def answered(key: tuple, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        own = _loaded(table.to_dict("records")[0], bare.params) if len(table) else _empty(bare.params)
        if not len(rows):
            return pd.DataFrame({x.split(" ")[0]: [] for x in _ANSWERS.split(", ")})
        rows = rows.sort_values("block")
        return _answers(key[0], rows, _Asked(rows, frequent), *own)

    asks = _questions(blocks, frequent, bare.segments, False)
    answers = asks.groupBy("segment").cogroup(model.table.groupBy("segment")).applyInPandas(answered, _ANSWERS)
    return _joined(blocks, answers, model)


def _named(rows: DataFrame, model: Model) -> DataFrame:
    held_out = (fold(F.col("doc_id"), model.params.folds) == model.params.held_out).alias("held_out")
    return rows.select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, by a model made before."""
    blocks = encoded(docs, model.params)
    size = model.table.agg(F.coalesce(F.sum(F.octet_length("bits") + F.octet_length("words") + F.octet_length("counts") + F.octet_length("follows")), F.lit(0))).first()[0]
    return _named(_probed(blocks, model) if size <= model.params.broadcast_bytes else _asked(blocks, model), model)


def fit_score(docs: DataFrame, params: LmParams = LmParams()) -> tuple[DataFrame, Model]:
    """The model of the training documents among docs, and what score() gives for all docs."""
    segments, blocks = _segments(docs.sparkSession, params), encoded(docs, params)
    frequent = _frequent(blocks, segments)
    rows = staged(_fitted(blocks, frequent, segments, params, True), "model")
    model = _model(rows, frequent, segments, params)
    answers = rows.where("answer is not null").select("answer.*")
    return _named(_joined(blocks, answers, model), model), model
