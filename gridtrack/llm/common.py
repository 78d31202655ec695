"""Helpers shared by the document operators: folds, bounded samples, staged tables, n-gram hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import released, shared_dir, staged  # noqa: F401

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six characters that split words.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, nothing else; null counts as empty. lower() does the same, and is faster, in a text without other capitals."""
    text = F.coalesce(text, F.lit(""))
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, A_Z, a_z))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, chosen by a hash of the key: the same ones whatever the partitioning. A threshold on the hash comes first, so that tasks send about `rows` rows in all; where few keys hold all rows and none is below it, it does not."""
    h, n = F.pmod(F.xxhash64(key), F.lit(1 << 31)), df.count()
    some = df.where(h < int(min(1.0, 1.1 * rows / n) * (1 << 31))) if n > rows else df
    if n > rows and some.isEmpty():
        some = df
    return some.orderBy(h, key).limit(rows)


def in_blocks(texts: Sequence[str | None], most: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of texts with about `most` characters each (one text at least), with the place of the first; null becomes empty."""
    at, block, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if block and n + len(t) > most:
            yield at, block
            at, block, n = i, [], 0
        block.append(t)
        n += len(t)
    if block:
        yield at, block


class Pool:
    """Runs of numbers, one after the other."""

    def __init__(self, kind: type):
        self.data, self.starts, self.sizes, self.used = np.zeros(1 << 12, kind), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(flat) > len(self.data):
            self.data = np.append(self.data[: self.used], np.zeros(self.used + 2 * len(flat), self.data.dtype))
        self.data[self.used : self.used + len(flat)] = flat
        self.starts = np.append(self.starts, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.used += len(flat)

    def runs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of rows, and the place in rows that each number is of."""
        n = self.sizes[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return self.data[np.arange(len(of)) + (self.starts[rows] - np.cumsum(n) + n)[of]], of


def packed_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the lower-cased texts, each with a space on both sides and runs of spaces as one, and where each begins (one more at the end)."""
    parts = [b" %b " % b" ".join(t.lower().encode("utf-8", "replace").split()) for t in texts]
    ends = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends


def gram_hashes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash below 2**bits of the n bytes that begin at each place, but for the last n - 1 places."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(m, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= data[k : k + m]
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - bits)


_U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, to n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def ascii_words(text: str) -> list[bytes]:
    """The words between blanks, A-Z lowered, in UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def span_hashes(split: list[list[bytes]], words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the bytes of the `words` words that begin at each word (fewer at the end of a text), and the words of each text."""
    n = np.array([len(w) for w in split], np.int64)
    data = np.frombuffer(b"\n".join(b" ".join(w) for w in split if w), np.uint8)
    if not len(data):
        return np.zeros(0, _U), n
    power, inverse = _pow(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:-1], out=sums[1:])
    gap = np.flatnonzero((data == 32) | (data == 10))  # what joins words and texts; a word can hold other control characters
    start, end = np.append(0, gap + 1), np.append(gap, len(data))
    last = np.minimum(np.arange(len(start)) + words - 1, np.repeat(np.cumsum(n) - 1, n))
    return mixed((sums[end[last]] - sums[start]) * inverse[start]), n
