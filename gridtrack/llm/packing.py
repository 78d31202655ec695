"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most `capacity` tokens. The histogram of piece
lengths, at most `capacity` numbers whatever the corpus, is all that the driver sees.
Over length classes of `grid` tokens it solves the covering program

    least sum of x_j  so that  sum of a_jk x_j >= demand_k  for every class k

by multiplicative weights: each round prices the classes and asks a knapsack dynamic
program for the configuration of the highest price. The fractional solution is
rounded down to whole sequences of real lengths, and what is left goes, longest
first, to the sequence with the least room that it fits. Pieces find their place in
that plan by their rank among the pieces of their length, which is counted in
buckets of doc_id, so that no window holds all pieces of one length.

A null or empty text is one piece that holds the end token alone. Repeated rows are
packed once each. A null doc_id is carried along. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Pool, shuffle_partitions, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    capacity: int = 4096
    end_id: int = 1
    #: Width of a length class in the program, and its precision.
    grid: int = 16
    epsilon: float = 0.15
    max_rounds: int = 6000
    #: Bound of the words whose ids a worker remembers.
    cache: int = 1_600_000


#: Latin letters and digits of one byte in Latin-1, after lower-casing, and the tokenizer's word pattern for texts of such characters, with blanks.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_PLAIN = re.compile(r"[ -~\xa1-\xac\xae-\xff]+")
_PARTS = re.compile(rf" |'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
#: Bytes of text whose words are looked up together.
BLOCK = 6_000_000


class WordIds:
    """Ids of texts, each with the end token's behind.

    Words between blanks or line ends are encoded once; no rule of a tokenizer that
    splits at white space reaches over them. Texts are split into words, and words into
    distinct ones, as Arrow columns; only distinct words become Python strings, and ids are
    gathered from one pool. New words are encoded many in a call; the
    tokens that end a part of a word, counted against the parts that each word has, tell
    where its ids stop. Where the counts disagree, or a word has characters that the
    pattern of parts does not know, it is encoded alone.
    """

    def __init__(self, path: str, cache: int, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.end_id = Tokenizer.from_file(path), cache, end_id
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # For words of the pattern's characters; where the normalizer does no more than lower() to these, it is left out.
        self.quick, self.lower = Tokenizer.from_file(path), False
        every = "".join(c for c in map(chr, range(33, 256)) if _PLAIN.fullmatch(c))
        if self.quick.normalizer and self.quick.normalizer.normalize_str(f"{every} {every}") == f"{every} {every}".lower():
            self.quick.normalizer, self.lower = None, True
        self._forget()

    def _forget(self) -> None:
        """known: number of each word, in order of the numbers; 0 is the end token's. again: words met in a later block."""
        self.known: dict[str | None, int] = {None: 0, "": 1}
        self.ids, self.again = Pool(np.uint32), np.zeros(1 << 12, bool)
        self.ids.add(np.array([self.end_id], np.uint32), np.array([1, 0]))

    def _add(self, words: list[str], flat: list[np.ndarray], sizes: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.ids.add(np.concatenate(flat), sizes)
        if len(self.known) > len(self.again):
            self.again = np.append(self.again, np.zeros(len(self.known), bool))

    def _alone(self, words: list[str]) -> None:
        if words:
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            self._add(words, ids, np.array([len(x) for x in ids]))

    def _learn(self, words: list[str]) -> None:
        alone, plain = [], []
        for at in range(0, len(words), 256):
            group = words[at : at + 256]
            if not _PLAIN.fullmatch(text := " ".join(group)) or "<|" in text:
                other = {w for w in group if not _PLAIN.fullmatch(w) or "<|" in w}
                alone += other
                group = [w for w in group if w not in other]
            if group:
                plain.append(group)
        for at in range(0, len(plain), 40):
            groups = plain[at : at + 40]
            texts, done, flat, sizes = [" ".join(g) for g in groups], [], [], []
            low = [t.lower() for t in texts]
            for group, text, e in zip(groups, low, self.quick.encode_batch_fast(low if self.lower else texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                stops = np.flatnonzero(self.ends[ids]) + 1
                found = _PARTS.findall(text)
                parts = np.array([k for k, x in enumerate(found) if x == " "] + [len(found)]) - np.arange(len(group))
                if parts[-1] != len(stops) or stops[-1] != len(ids):
                    alone += group
                    continue
                done += group
                flat.append(ids)
                sizes.append(np.diff(stops[parts - 1], prepend=0))
            if done:
                self._add(done, flat, np.concatenate(sizes))
        for at in range(0, len(alone), 10_000):
            self._alone(alone[at : at + 10_000])

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of different words."""
        find = lambda words: np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        out = find(words)
        if len(self.known) + int((out < 0).sum()) > self.most:
            # Words met again are remembered, if they leave room; most others come once.
            known, ids, keep = list(self.known), self.ids, np.flatnonzero(self.again[: len(self.known)])
            keep = keep[keep > 1]
            self._forget()
            if len(keep) + len(words) < self.most and len(keep):
                self._add([known[k] for k in keep.tolist()], [ids.runs(keep)[0]], ids.sizes[keep])
            out = find(words)
        self.again[out[out >= 0]] = True
        new = np.flatnonzero(out < 0)
        if len(new):
            self._learn(some := [words[k] for k in new.tolist()])
            out[new] = find(some)
        return out

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Block by block: place of its first text, ids of all its texts, and how many each has."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
            split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.slice(at, to - at), ""), "\n", " "), " ")
            words = split.flatten().dictionary_encode()
            n = pc.list_value_length(split).to_numpy().astype(np.int64)
            # Numbers of all words, one after the other, each text's followed by the end token's.
            rows, last = np.zeros(len(words) + len(n), np.int64), np.zeros(len(words) + len(n), bool)
            last[np.cumsum(n + 1) - 1] = True
            rows[~last] = self._numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
            sums = np.cumsum(self.ids.sizes[rows])[last]
            yield at, self.ids.runs(rows)[0], np.diff(sums, prepend=0)
            at = to


_ids: dict[PackParams, WordIds] = {}


def tokenized(docs: DataFrame, params: PackParams) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    cap = params.capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids.get(params) or _ids.setdefault(params, WordIds(params.tokenizer, params.cache, params.end_id))
        for batch in batches:
            for at, ids, n in encode(batch.column("text")):
                many = (n + cap - 1) // cap
                of = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(of)) - (np.cumsum(many) - many)[of]
                start = piece * cap
                length = np.minimum(n[of] - start, cap)
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * k : 4 * (k + m)]) for k, m in zip(((np.cumsum(n) - n)[of] + start).tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at + of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def _knapsack(price: np.ndarray, room: int) -> Counter:
    """The multiset of classes (class k has size k + 1) that fits room at the highest price."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        k = min(c, len(price))
        gain = price[:k] + best[c - k : c][::-1]
        j = int(gain.argmax())
        best[c], pick[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
    out, c = Counter(), room
    while c > 0:
        j = pick[c]
        out[int(j)] += j >= 0
        c -= j + 1 if j >= 0 else 1
    out.pop(-1, None)
    return out


def fractional(demand: np.ndarray, room: int, params: PackParams) -> dict[tuple, float]:
    """Configurations ((class, number), ...) and how much of each, by multiplicative weights."""
    live = demand > 0
    if not live.any():
        return {}
    eta = max(1.0, np.log(live.sum() + 1) / params.epsilon)
    covered, x = np.zeros(len(demand)), Counter()
    safe = np.maximum(demand, 1)
    for _ in range(params.max_rounds):
        share = np.where(live, covered / safe, np.inf)
        least = share.min()
        if least >= 1:
            break
        config = _knapsack(np.where(live, np.exp(-eta * np.minimum(share - least, 50)) / safe, 0), room)
        step = min(demand[k] / n for k, n in config.items()) / eta
        for k, n in config.items():
            covered[k] += n * step
        x[tuple(sorted(config.items()))] += step
    scale = 1 / max(1e-9, np.where(live, covered / safe, np.inf).min())
    return {c: v * min(scale, 1e6) for c, v in x.items()}


def plan(lengths: dict[int, int], params: PackParams) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; all pieces, each sequence within capacity."""
    g, cap = params.grid, params.capacity
    left = Counter({k: n for k, n in lengths.items() if n > 0})
    classes = [[k for k in sorted(left, reverse=True) if (k - 1) // g == c] for c in range((cap + g - 1) // g)]
    demand = np.array([sum(left[k] for k in ks) for ks in classes], float)
    patterns: Counter = Counter()
    for config, amount in sorted(fractional(demand, cap // g, params).items(), key=lambda z: (-z[1], z[0])):
        want = int(min([amount, *(sum(left[k] for k in classes[c]) // n for c, n in config)]))
        while want > 0:
            one: Counter = Counter()
            for c, n in config:
                for k in classes[c]:
                    take = min(n, left[k])
                    if take:
                        one[k] += take
                        n -= take
                    if not n:
                        break
            times = min(want, *(left[k] // n for k, n in one.items()))
            for k, n in one.items():
                left[k] -= n * times
            patterns[tuple(sorted(one.elements(), reverse=True))] += times
            want -= times
    room: dict[int, Counter] = {}
    for p, n in patterns.items():
        room.setdefault(cap - sum(p), Counter())[p] += n
    for k in sorted(left, reverse=True):
        while left[k]:
            fits = min((r for r in room if r >= k), default=None)
            if fits is None:
                p, n, fits = (), (left[k] + (cap // k) - 1) // (cap // k), cap
                each = min(cap // k, left[k])
                n = left[k] // each
            else:
                p, n = next(iter(room[fits].items()))
                each = min(fits // k, left[k])
                n = min(n, left[k] // each)
                room[fits][p] -= n
                if not room[fits][p]:
                    del room[fits][p]
                if not room[fits]:
                    del room[fits]
            left[k] -= n * each
            new = tuple(sorted(p + (k,) * each, reverse=True))
            room.setdefault(fits - k * each, Counter())[new] += n
    return [(p, n) for r in sorted(room) for p, n in sorted(room[r].items(), reverse=True)]


def lookup(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows length << 40 | first rank, pieces per sequence, first sequence, offset; sorted."""
    rows, used, sequence = [], Counter(), 0
    for p, n in patterns:
        offset = 0
        for k, each in sorted(Counter(p).items(), reverse=True):
            rows.append((k << 40 | used[k], each, sequence, offset))
            used[k] += each * n
            offset += k * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(pieces: DataFrame, params: PackParams, partitions: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    lengths = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(lookup(plan(lengths, params)))  # a few rows for each length
    buckets = 4 * (partitions or shuffle_partitions(spark))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).join(first, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        t = table.value
        row = t[np.searchsorted(t[:, 0], k << 40 | r, side="right") - 1]
        nth = r - (row[:, 0] & ((1 << 40) - 1))
        return pd.DataFrame({"sequence_id": row[:, 2] + nth // row[:, 1], "offset": row[:, 3] + nth % row[:, 1] * k})

    return ranked.withColumn("at", place("length", F.col("rank") + F.col("first"))).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack(docs: DataFrame, params: PackParams) -> DataFrame:
    return packed(staged(tokenized(docs, params), "pieces"), params)
