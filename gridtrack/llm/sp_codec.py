"""SentencePiece encoding and decoding with seeded merge-dropout.

Merge-type encoding takes, again and again, the best-scored pair of neighbouring
pieces whose join is a piece, leftmost first. With dropout a candidate merge is skipped
when a hash keyed by seed, document, the unit's place in the text and the candidate's
ends falls below the rate: each occurrence of a word is segmented anew, and the same call
always gives the same segmentation. A document's draw is a 64-bit hash of its id, or of
its text where the id is null. Blanks never stand inside a piece after other characters,
so a text is encoded unit by unit (blanks, then a word): many short units at once, as linked parts, each long
one along an agenda of its candidates.

Remembered of a unit are its ids without dropout and the candidates on the way there.
Where an occurrence skips none of these, they are its ids; all others are merged anew.

Characters without a piece, and the character that stands for a blank in pieces, go by
bytes; decoding always gives the text back. A null text is an empty one; an empty text
has no ids. Repeated rows are encoded alike. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pool, in_blocks, mixed

BLANK = "▁"
_UNITS = re.compile(r"\n| *[^ \n]+| +")
_U = np.uint64
_WORD = (1 << 64) - 1
#: Units of more code points are merged one by one, along an agenda.
LONG = 100


def _mixed(h: int) -> int:
    """mixed() of one number."""
    h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & _WORD
    return h ^ (h >> 32)


@dataclass(frozen=True)
class CodecParams:
    model: str
    dropout: float = 0.1
    seed: int = 10
    #: Bound of the units of which a worker remembers the ids without dropout.
    cache: int = 1_000_000


class Codec:
    def __init__(self, params: CodecParams):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=params.model)
        self.params, n = params, sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {self.pieces[i]: i for i in plain}
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = [byte[b] for b in range(256)]
        keys, joined = [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    joined.append(i)
        order = np.argsort(keys)
        self.keys, self.joined = np.array(keys, np.int64)[order], np.array(joined, np.int64)[order]
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        self.raw = [bytes([int(self.pieces[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else self.pieces[i].replace(BLANK, " ").encode() for i in range(n)]
        # Scores by rank, from 1; the pairs once more by a hash, each at its slot or the next free one.
        self.levels = (np.unique(self.scores[self.joined], return_inverse=True)[1] + 1).astype(np.int32)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.slots, self.slot_keys = np.full(1 << self.bits, -1, np.int32), np.full(1 << self.bits, -1, np.int64)
        rest = np.arange(len(keys))
        slot = self._slot(self.keys)
        while len(rest):
            free = np.flatnonzero(self.slots[slot] < 0)
            at, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.slots[at], self.slot_keys[at] = rest[put], self.keys[rest[put]]
            more = np.ones(len(rest), bool)
            more[put] = False
            rest, slot = rest[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        self.codes = -2 - np.arange(0x110000, dtype=np.int32)
        self.codes[[ord(c) for c in self.chars]] = list(self.chars.values())
        self.codes[ord(" ")], self.codes[ord(BLANK)] = self.chars.get(BLANK, -2 - ord(" ")), -2 - ord(BLANK)
        self.merges: dict[int, int] | None = None
        self.n, self.below = n, _U(min(int(params.dropout * 2.0**64), 2**64 - 1))
        self._forget()

    def _forget(self) -> None:
        """known: number of each unit; of each: ids without dropout, code points as symbols, candidates on the way to the ids."""
        self.known: dict[str, int] = {}
        self.plain: list[bytes] = []
        self.symbols, self.ends = Pool(np.int32), Pool(_U)

    def _skipped(self, key: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(key + ends * _U(0x9E3779B97F4A7C15)) < self.below

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(_U) * _U(0x9E3779B97F4A7C15) >> _U(64 - self.bits)).view(np.int64)

    def _found(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each pair in keys, or -1."""
        slot = self._slot(pairs)
        there, out = self.slot_keys[slot], self.slots[slot]
        rest = np.flatnonzero((there != pairs) & (there >= 0))
        out[rest] = -1
        slot, pairs = slot[rest], pairs[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.slot_keys[slot]
            hit = there == pairs
            out[rest[hit]] = self.slots[slot[hit]]
            on = ~hit & (there >= 0)
            rest, slot, pairs = rest[on], slot[on], pairs[on]
        return out

    def _merge(self, units: np.ndarray, keys: np.ndarray | None) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
        """Ids of each unit as bytes, and without keys (no dropout) the candidates met, by row; each round joins one pair in every unit that has a candidate left."""
        n, size = len(units), self.symbols.sizes[units]
        if size.min() > LONG:
            each = [self._merge_long(self.symbols.runs(units[r : r + 1])[0].tolist(), None if keys is None else int(keys[r])) for r in range(n)]
            return [x for x, _ in each], [(np.full(len(ends), r), ends) for r, (_, ends) in enumerate(each)]
        stride, met = int(size.max()) + 1, []
        # Places of all units in one row; what follows a unit, and codes of characters without a piece (below -1), join with nothing.
        start = np.arange(n) * stride
        flat, of = self.symbols.runs(units)
        at = np.arange(len(of)) + (start - np.cumsum(size) + size)[of]
        sym = np.full(n * stride, -1, np.int32)
        sym[at] = flat
        left, right = np.arange(-1, n * stride - 1), np.arange(1, n * stride + 1)
        best, piece = np.zeros(n * stride, np.int32), np.zeros(n * stride, np.int32)

        def candidates(rows: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
            """Level and joined piece of the pairs of parts that begin at p and q; no candidate has level 0."""
            a, b = sym[p], sym[q]
            pair = np.flatnonzero((a >= 0) & (b >= 0))
            found = self._found(a[pair] * np.int64(self.n) + b[pair])
            ok = np.flatnonzero(found >= 0)
            pair, found = pair[ok], found[ok]
            if self.below:
                r, to = rows[pair], q[pair]
                first = start[r]
                ends = p[pair] - first + ((to - first) << 21) + ((right[to] - first) << 42)
                ends = ends.view(_U)
                if keys is None:
                    met.append((r, ends))
                else:
                    ok = np.flatnonzero(~self._skipped(keys[r], ends))
                    pair, found = pair[ok], found[ok]
            best[p] = 0
            p = p[pair]
            best[p], piece[p] = self.levels[found], self.joined[found]

        candidates(of, at, at + 1)
        live, table = np.arange(n), best.reshape(n, stride)
        while True:
            p = start[live] + table[live].argmax(1)
            go = best[p] > 0
            live, p = live[go], p[go]
            if not len(live):
                break
            q = right[p]
            to = right[q]
            sym[p], sym[q], best[q] = piece[p], -1, 0
            right[p], left[to] = to, p
            candidates(np.concatenate([live, live]), np.concatenate([p, left[p]]), np.concatenate([to, p]))
        sym = sym.reshape(n, stride)
        mask = sym >= 0
        flat, to = sym[mask].astype("<u4").tobytes(), np.cumsum(mask.sum(1)) * 4
        out = [flat[i:j] for i, j in zip([0, *to[:-1].tolist()], to.tolist())]
        for r in np.flatnonzero((sym < -1).any(1)).tolist():
            ids = [[x] if x >= 0 else [self.bytes[b] for b in chr(-2 - x).encode("utf-8", "replace")] for x in sym[r].tolist() if x != -1]
            out[r] = np.array(list(itertools.chain.from_iterable(ids)), "<u4").tobytes()
        return out, met

    def _merge_long(self, sym: list[int], key: int | None) -> tuple[bytes, np.ndarray]:
        """As _merge, for one unit: an agenda of candidates, best score and leftmost first, and parts that know their ends; about linear in the unit's length."""
        if self.merges is None:
            self.merges = dict(zip(self.keys.tolist(), self.joined.tolist()))
        score, below, n = self.scores, int(self.below), len(sym)
        part, end, before = list(sym), list(range(1, n + 1)), list(range(-1, n))  # by start; before: the start of the part on the left
        met, agenda = [], []

        def candidate(a: int, b: int) -> None:
            if part[a] < 0 or part[b] < 0 or (joined := self.merges.get(part[a] * self.n + part[b])) is None:
                return
            ends = (a + (b << 21) + (end[b] << 42)) & _WORD
            if below:
                if key is None:
                    met.append(ends)
                elif _mixed((key + ends * 0x9E3779B97F4A7C15) & _WORD) < below:
                    return
            heapq.heappush(agenda, (-score[joined], a, b, end[b], joined))

        for a in range(n - 1):
            candidate(a, a + 1)
        while agenda:
            _, a, b, to, joined = heapq.heappop(agenda)
            if part[a] is None or part[b] is None or end[a] != b or end[b] != to:
                continue
            part[a], part[b], end[a] = joined, None, to
            if to < n:
                before[to] = a
                candidate(a, to)
            if a:
                candidate(before[a], a)
        ids = itertools.chain.from_iterable([x] if x >= 0 else [self.bytes[v] for v in chr(-2 - x).encode("utf-8", "replace")] for x in part if x is not None)
        return np.fromiter(ids, "<u4").tobytes(), np.array(met, _U)

    def _together(self, units: np.ndarray) -> Iterator[np.ndarray]:
        """Places in units, those of like length together."""
        size = self.symbols.sizes[units]
        order, at = np.argsort(size, kind="stable"), 0
        size = size[order]
        while at < len(order):
            most = int(np.searchsorted(size, size[at] + 2, "right"))
            to = min(most, at + max(1, min(4096, 100_000 // (int(size[at]) + 3))))
            yield order[at:to]
            at = to

    def _remember(self, units: list[str]) -> None:
        new = list(set(units) - self.known.keys())
        if len(self.known) + len(new) > self.params.cache:
            self._forget()
            new = list(set(units))
        if not new:
            return
        first = len(self.known)
        codes = self.codes[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4")]
        self.symbols.add(codes, np.fromiter(map(len, new), np.int64, len(new)))
        self.plain += [b""] * len(new)
        ends, of = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        number = np.arange(first, first + len(new))
        for places in self._together(number):
            ids, met = self._merge(number[places], None)
            for k, x in zip(places.tolist(), ids):
                self.plain[first + k] = x
            for r, e in met:
                ends.append(e), of.append(places[r])
        of = np.concatenate(of)
        self.ends.add(np.concatenate(ends)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(new)))
        self.known.update(zip(new, number.tolist()))

    def encode(self, text: str, draw: int = 0) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return next(self.encode_all([text], [draw]))

    def encode_all(self, texts: list[str], draws: list[int]) -> Iterator[bytes]:
        split = [_UNITS.findall(" " + t) if t else [] for t in texts]
        units = list(itertools.chain.from_iterable(split))
        self._remember(units)
        number = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        ids = list(map(self.plain.__getitem__, number.tolist()))
        n = np.array([len(x) for x in split], np.int64)
        if self.below:
            draw = np.array([xxhash.xxh3_64_intdigest(d.to_bytes(8, "little", signed=True), seed=self.params.seed) for d in draws], _U)
            place = np.arange(len(units)) - np.repeat(np.cumsum(n) - n, n)
            key = mixed(np.repeat(draw, n) + place.astype(_U) * _U(0xD6E8FEB86659FD93))
            anew = np.zeros(len(units), bool)
            for at in range(0, len(units), 100_000):
                ends, of = self.ends.runs(number[at : at + 100_000])
                anew[at + of[self._skipped(key[at + of], ends)]] = True
            anew = np.flatnonzero(anew)
            for places in self._together(number[anew]):
                rows = anew[places]
                for r, x in zip(rows.tolist(), self._merge(number[rows], key[rows])[0]):
                    ids[r] = x
        at = 0
        for k in n.tolist():
            yield b"".join(ids[at : at + k])
            at += k

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode("utf-8", "replace")


_codecs: dict[CodecParams, Codec] = {}


def encode_documents(docs: DataFrame, params: CodecParams) -> DataFrame:
    """doc_id, draw, ids (little-endian unsigned 32-bit) and the text that they decode to, for every row."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(params) or _codecs.setdefault(params, Codec(params))
        for batch in batches:
            draws = batch.column("draw").to_pylist()
            for at, texts in in_blocks(batch.column("text").to_pylist(), 1_000_000):
                ids = list(codec.encode_all(texts, draws[at : at + len(texts)]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(ids)), batch.column("draw").slice(at, len(ids)), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "draw", "ids", "decoded"])

    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), draw.alias("draw"), "text").mapInArrow(encoded, "doc_id long, draw long, ids binary, decoded string")


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
