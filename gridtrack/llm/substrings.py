"""Substring deduplication by level-wise doubling.

A window is `words` consecutive words of one document. A word goes if a window that covers
it also starts in a document with a smaller doc_id; windows are judged on the input.

Levels: windows of half that length come first, and of these only the one with the least
hash in each window of full length: equal windows have the same one, so that about one
place in thirteen is looked up and nothing is missed. Full windows are looked up only where
their short one occurs in two documents or more; windows of twice the length only where both
halves do, as a pair of the halves' hashes, without the text; and so on, until no candidates
survive. The first full level decides what goes, and the last one that a document reaches
says how long its repeats are.

Documents with the same words are one from here on, the one with the smallest doc_id: the
rest lose all they have. What is looked up is one row for each window and document; the
smallest and largest doc_id of a hash are found with map-side sums, so that a passage that
a third of all documents share is no single task's work. Windows are told apart by 64-bit
hashes; a full window takes another for itself only if its short one does at the same time.

A null text has no words. A row with a null doc_id keeps its words, and no other row loses
any for it. Rows of one doc_id lose nothing for each other, whatever their texts. Repeated
rows get a result each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_blocks, let, mixed, released, span_hashes, staged, unused

_U = np.uint64
_FOUND = "doc long, part int, pos int, h long"


@dataclass(frozen=True)
class SubstringParams:
    words: int = 50
    block_chars: int = 2_000_000


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` hashes from each place on, but for the last width - 1 places."""
    have = 1
    while 2 * have <= width:
        h, have = np.minimum(h[:-have], h[have:]), 2 * have
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def _windows(split: list[list[bytes]], params: SubstringParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the hashes of its full windows and of their short ones."""
    short = params.words // 2
    full, n = span_hashes(split, params.words)
    half, _ = span_hashes(split, short)
    at = 0
    for k in n:
        m = k - params.words + 1
        yield (full[at : at + m], _least(half[at : at + k - short + 1], params.words - short + 1)) if m > 0 else (full[:0], half[:0])
        at += k


def document_rows(docs: DataFrame, params: SubstringParams) -> DataFrame:
    """doc, n_words, sha (of the words joined by a space), and the distinct short windows to look up, of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc")
            for at, texts in in_blocks(batch.column("text").to_pylist(), params.block_chars):
                split = [_words(t) for t in texts]
                found = [np.unique(least).astype(np.int64) for _, least in _windows(split, params)]
                sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array([len(w) for w in split], pa.int64()), pa.array(sha), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], ["doc", "n_words", "sha", "short"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(rows, "doc long, n_words long, sha string, short array<long>")


def _repeated(found: DataFrame) -> DataFrame:
    """h and the smallest doc of the hashes that two documents or more have. Staged: a join of two exchanges can split what one hash has."""
    return staged(found.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("h", "least"), "substring-repeated")


def _candidates(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc, part, sha, text of documents with a short window that occurs in two documents, and these windows."""
    short = firsts.select("doc", "part", F.explode("short").alias("h"))
    repeated = _repeated(short)
    met = short.join(repeated, "h").groupBy("doc", "part").agg(F.collect_list("h").alias("short"))
    met = met.join(firsts.select("doc", "part", "sha"), ["doc", "part"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # rows of one id can have other texts
            keep = [hashlib.sha256(b" ".join(_words(t))).hexdigest() == s for t, s in zip(batch.column("text").to_pylist(), batch.column("sha").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["doc", "part", "sha", "text", "short"])

    out = staged(texts.join(met.hint("merge"), "doc").mapInArrow(same, "doc long, part int, sha string, text string, short array<long>"), "substring-texts")
    released(repeated)
    return out


def _first_level(candidates: DataFrame, params: SubstringParams) -> DataFrame:
    """Full windows whose short one occurs in two documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, short = batch.column("doc").to_numpy(), batch.column("part").to_numpy(), batch.column("short")
            for at, texts in in_blocks(batch.column("text").to_pylist(), params.block_chars):
                for i, (full, least) in enumerate(_windows([_words(t) for t in texts], params), at):
                    pos = np.flatnonzero(np.isin(least.astype(np.int64), short[i].values.to_numpy()))
                    yield _rows(ids[i], parts[i], pos, full[pos])

    return candidates.mapInArrow(rows, _FOUND)


def _rows(doc: int, part: int, pos: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    n = len(pos)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, part, np.int32)), pa.array(pos.astype(np.int32)), pa.array(h.astype(np.int64))], ["doc", "part", "pos", "h"])


def _doubled(level: DataFrame, length: int) -> DataFrame:
    """Windows of twice the length whose halves both occur in two documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, part, found in zip(batch.column("doc").to_pylist(), batch.column("part").to_pylist(), batch.column("found")):
                pos, h = _sorted(found)
                at = np.searchsorted(pos, pos + length)
                ok = np.flatnonzero(pos[np.minimum(at, len(pos) - 1)] == pos + length)
                yield _rows(doc, part, pos[ok], mixed(h[ok] * _U(0x9E3779B97F4A7C15) + mixed(h[at[ok]] + _U(length))))

    return level.select("doc", "part", "found").mapInArrow(rows, _FOUND)


def _sorted(found: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    rows = found.values
    pos, at = np.unique(rows.field("pos").to_numpy(), return_index=True)
    return pos, rows.field("h").to_numpy()[at].astype(_U)


def _survivors(found: DataFrame) -> DataFrame:
    """Of each document the windows that occur in two documents, and which of them start in an earlier one."""
    repeated = _repeated(found)
    window = F.struct("pos", "h", (F.col("least") < F.col("doc")).alias("earlier"))
    out = staged(found.join(repeated, "h").groupBy("doc", "part").agg(F.collect_list(window).alias("found")), "substring-level")
    released(repeated)
    return out


def _cut(rows: DataFrame, params: SubstringParams) -> DataFrame:
    """doc, part, spans (start, end in words, end exclusive), n_removed and kept_sha256 from texts and the windows that go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, removed, sha = [], [], []
            for text, pos in zip(batch.column("text").to_pylist(), batch.column("gone")):
                words = _words(text)
                pos = np.unique(pos.values.to_numpy())
                first = np.append(True, np.diff(pos) > params.words)
                last = np.append(first[1:], True)
                own = [(int(a), int(b) + params.words) for a, b in zip(pos[first], pos[last])] if len(pos) else []
                spans.append([{"start": a, "end": b} for a, b in own])
                removed.append(sum(b - a for a, b in own))
                edges = [0, *(x for s in own for x in s), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(spans, kind), pa.array(removed, pa.int64()), pa.array(sha)], ["doc", "part", "spans", "n_removed", "kept_sha256"])

    return rows.mapInArrow(cut, "doc long, part int, spans array<struct<start: int, end: int>>, n_removed long, kept_sha256 string")


def repeats(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by a space), longest (words of the longest level at which a window of the document occurs in another one, 0 if none) and spans (start and end in words of what goes) of every row."""
    if params.words < 2:
        raise ValueError("words: 2 at least")
    rows = staged(document_rows(docs, params), "substring-rows")
    base = staged(rows.select("doc", "n_words", "sha"), "substring-docs")
    groups = base.where((F.col("n_words") >= params.words) & F.col("doc").isNotNull()).groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    groups = staged(groups, "substring-groups")
    firsts = rows.join(groups.select("sha", F.col("first").alias("doc")), ["sha", "doc"], "left_semi").dropDuplicates(["doc", "sha"])
    firsts = firsts.withColumn("part", F.row_number().over(Window.partitionBy("doc").orderBy("sha")))
    firsts = staged(firsts.select("doc", "part", "sha", "short"), "substring-firsts")
    released(rows)
    texts = _candidates(docs, firsts)
    released(firsts)
    first = level = _survivors(_first_level(texts, params))
    reached, length = [], params.words
    while not level.isEmpty():
        reached.append(staged(level.select("doc", "part", F.lit(length).cast("long").alias("longest")), "substring-reached"))
        before, level, length = level, _survivors(_doubled(level, length)), 2 * length
        if before is not first:
            released(before)
    gone = first.select("doc", "part", F.transform(F.filter("found", lambda w: w["earlier"]), lambda w: w["pos"]).alias("gone")).where(F.size("gone") > 0)
    cut = _cut(texts.select("doc", "part", "text").join(gone, ["doc", "part"]).dropDuplicates(["doc", "part"]), params)
    longest = reduce(DataFrame.union, reached) if reached else first.select("doc", "part", F.lit(0).cast("long").alias("longest"))
    own = longest.groupBy("doc", "part").agg(F.max("longest").alias("longest")).join(cut, ["doc", "part"], "left")
    own = own.join(texts.select("doc", "part", "sha").distinct(), ["doc", "part"]).drop("part")
    copies = groups.where("first < last").select("sha", "first")
    return _joined(base, own, copies, params)


def _joined(base: DataFrame, own: DataFrame, copies: DataFrame, params: SubstringParams) -> DataFrame:
    rows = base.select("doc", "n_words", "sha").join(copies, "sha", "left").join(own, ["doc", "sha"], "left")
    copied = (F.col("n_words") >= params.words) & F.coalesce(F.col("first") < F.col("doc"), F.lit(False))
    n = F.col("n_words")
    level = F.lit(params.words) * F.pow(F.lit(2), F.floor(F.log2(n / params.words) + F.lit(1e-9)))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))
    none = F.array().cast("array<struct<start: int, end: int>>")

    def by(all_of_it: Column, some: Column) -> Column:
        return F.when(copied, all_of_it).otherwise(some)

    first_of_copies = F.when(F.col("first") == F.col("doc"), level.cast("long"))
    return rows.select(
        F.col("doc").alias("doc_id"), "n_words",
        by(n, F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        by(F.lit(hashlib.sha256(b"").hexdigest()), F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        by(level.cast("long"), F.coalesce(first_of_copies, F.col("longest"), F.lit(0).cast("long"))).alias("longest"),
        by(whole, F.coalesce("spans", none)).alias("spans"),
    )


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the text less the words in the spans of `repeats`, those that stay joined by one space; texts that lose nothing, and rows without an id, are as they were. Rows of one doc_id are to have one text here."""
    key, spans = unused(docs, "span_id"), unused(docs, "spans")
    own = found.where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    rows = docs.join(own.hint("merge"), F.col("doc_id") == F.col(key), "left")

    def kept(words: Column) -> Column:
        def between(i: Column) -> Column:
            start = F.when(i > 0, F.get(F.col(spans), i - 1)["end"]).otherwise(0)
            end = F.coalesce(F.get(F.col(spans), i)["start"], F.size(words))
            return F.slice(words, start + 1, end - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(let(words, kept), " "))
    return rows.withColumn("text", text).select(*docs.columns)
