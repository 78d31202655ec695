"""Vector code compression: product codes by means over anchors-hierarchy trees.

A vector's components become integers floor(scale * x). It is cut into equal parts, and each
part position has a codebook: at first the parts of the vectors with the least ids, and then
the rounded-down means of what is nearest, round after round. The code of a vector is its
nearest entries, part by part.

The vectors of a task go in chunks. In a chunk each part position gets a metric tree over its
distinct points, made from the middle out: about sqrt(n) anchors, each new one the point
farthest from its anchor, taking over what is nearer to it (no point nearer to its anchor than
half the anchors' distance is asked); anchors with many points are worked likewise inside;
anchors are then merged two by two, those first that make the smallest ball. Balls cache the
sum and number of their points. Trees are made once and staged, with the chunk's points.

A round goes down the trees with the codebook, a few numbers that all tasks get. A ball
inherits the entries that were left for the ball above, and drops those that are farther than
the best one from every point in it. With one left the ball is owned, and its sum and number
count at once; otherwise its children are asked, and at the end single points. Sums are
added up by Spark and only parts * entries rows reach the driver. Bounds are kept with
a margin for rounding, and ties and single points are settled in integers, so codes are exact.

Dropped are rows whose vector is null, empty or holds null or non-finite components, or has
another length than that of the least id. The length is to be a multiple of `parts`. Integers
are kept within 2**27 and less for very long vectors, so that distances fit 64 bits; components
beyond go to that bound. A null vec_id sorts last. Repeated rows count each, and with fewer rows
than entries the codebook is shorter. Null labels are one label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    #: Vectors that share trees, and distinct points below which a ball has no children.
    chunk: int = 4096
    leaf: int = 12


@dataclass
class Tree:
    """Balls over points in an order in which each ball's are neighbours. A ball's children are numbers of balls, -1 for none."""

    points: np.ndarray  # [n, width], distinct, in that order
    counts: np.ndarray  # rows that have each point
    of_row: np.ndarray  # the place of each row's point
    start: np.ndarray
    end: np.ndarray
    children: np.ndarray  # [balls, 2]
    pivot: np.ndarray  # [balls, width], floats
    radius: np.ndarray
    sums: np.ndarray
    sizes: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def _anchors(points: np.ndarray) -> list[np.ndarray]:
    """Places of the points of each of about sqrt(n) anchors."""
    n = len(points)
    pivots, owner = [0], np.zeros(n, np.int64)
    far = _squares(points, points[0])
    for k in range(1, max(2, isqrt(n))):
        new = int(far.argmax())
        if not far[new]:
            break
        # Points nearer to their anchor than half the way to the new one cannot move.
        away = _squares(points[pivots], points[new])
        asked = np.flatnonzero(4 * far >= away[owner])
        d = _squares(points[asked], points[new])
        moved = asked[closer := d < far[asked]]
        owner[moved], far[moved] = k, d[closer]
        pivots.append(new)
    order = np.argsort(owner, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)


class _Builder:
    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.order: list[np.ndarray] = []
        self.at = 0
        self.balls: list[tuple[int, int, int, int]] = []  # start, end, children

    def grown(self, places: np.ndarray) -> int:
        """A ball of these points; its number."""
        groups = _anchors(self.points[places]) if len(places) > self.leaf else []
        if len(groups) < 2:
            self.order.append(places)
            self.at += len(places)
            self.balls.append((self.at - len(places), self.at, -1, -1))
            return len(self.balls) - 1
        return self.laid([places[g] for g in groups], self.merged([self.points[places[g]] for g in groups]))

    def laid(self, groups: list[np.ndarray], tree: int | tuple) -> int:
        if isinstance(tree, int):
            return self.grown(groups[tree])
        left, right = self.laid(groups, tree[0]), self.laid(groups, tree[1])
        self.balls.append((self.balls[left][0], self.balls[right][1], left, right))
        return len(self.balls) - 1

    @staticmethod
    def merged(groups: list[np.ndarray]) -> int | tuple:
        """Anchors' numbers in pairs of pairs: the two that make the smallest ball first."""
        n = len(groups)
        trees: list[int | tuple] = list(range(n))
        sizes = np.array([len(g) for g in groups], float)
        means = np.array([g.mean(axis=0) for g in groups])
        radii = np.array([np.sqrt(_squares(g, m).max()) for g, m in zip(groups, means)])
        apart = np.sqrt(_squares(means[:, None], means[None]))
        joint = np.maximum(np.maximum(radii[:, None], radii[None]), (apart + radii[:, None] + radii[None]) / 2)
        np.fill_diagonal(joint, np.inf)
        for _ in range(n - 1):
            i, j = sorted(divmod(int(joint.argmin()), n))
            radii[i] = joint[i, j]
            means[i] = (means[i] * sizes[i] + means[j] * sizes[j]) / (sizes[i] + sizes[j])
            sizes[i] += sizes[j]
            trees[i] = (trees[i], trees[j])
            sizes[j] = 0
            d = np.sqrt(_squares(means, means[i]))
            new = np.maximum(np.maximum(radii, radii[i]), (d + radii + radii[i]) / 2)
            new[sizes == 0], new[i] = np.inf, np.inf
            joint[i], joint[:, i] = new, new
            joint[j], joint[:, j] = np.inf, np.inf
        return trees[0] if n == 1 else trees[i]


def grow(rows: np.ndarray, leaf: int) -> Tree:
    """The tree of rows of integers, [n, width]."""
    points, of_row, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    b = _Builder(points, leaf)
    b.grown(np.arange(len(points)))
    order = np.concatenate(b.order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    points, counts = points[order], counts[order]
    balls = np.array(b.balls, np.int64)
    start, end = balls[:, 0], balls[:, 1]
    before = np.vstack([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(points * counts[:, None], axis=0)])
    sums, sizes = before[end] - before[start], np.append(0, np.cumsum(counts))[end] - np.append(0, np.cumsum(counts))[start]
    pivot = sums / sizes[:, None]
    radius = np.array([np.sqrt(_squares(points[i:j], p).max()) for i, j, p in zip(start, end, pivot)])
    return Tree(points, counts, place[of_row.reshape(-1)], start, end, balls[:, 2:], pivot, radius, sums, sizes)


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each of the tree's points, and of each entry the sums and number of the rows that it owns."""
    k = len(book)
    owner = np.zeros(len(tree.points), np.int64)
    sums, sizes = np.zeros_like(book), np.zeros(k, np.int64)
    apart = np.sqrt(_squares(book[:, None], book[None]).astype(float))
    balls, left = np.array([len(tree.start) - 1]), np.ones((1, k), bool)
    while len(balls):
        d = np.where(left, _squares(tree.pivot[balls][:, None], book[None]), np.inf)
        best = d.argmin(axis=1)
        least = d[np.arange(len(balls)), best][:, None]
        # Beyond the plane between the best entry and this one for all of the ball, by more than rounding.
        margin = 2 * tree.radius[balls][:, None] * apart[best] * (1 + 1e-9) + 1e-9 * (least + np.where(left, d, 0)) + 1e-6
        left &= ~(d - least > margin)
        left[np.arange(len(balls)), best] = True
        owned = left.sum(axis=1) == 1
        np.add.at(sums, best[owned], tree.sums[balls[owned]])
        np.add.at(sizes, best[owned], tree.sizes[balls[owned]])
        for ball, e in zip(balls[owned], best[owned]):
            owner[tree.start[ball] : tree.end[ball]] = e
        leaf = ~owned & (tree.children[balls, 0] < 0)
        if leaf.any():
            n = (tree.end - tree.start)[balls[leaf]]
            at = np.repeat(tree.start[balls[leaf]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            far = np.where(np.repeat(left[leaf], n, axis=0), _squares(tree.points[at][:, None], book[None]), np.iinfo(np.int64).max)
            owner[at] = far.argmin(axis=1)  # the first of equals
            np.add.at(sums, owner[at], tree.points[at] * tree.counts[at][:, None])
            np.add.at(sizes, owner[at], tree.counts[at])
        deeper = ~owned & ~leaf
        balls, left = tree.children[balls[deeper]].reshape(-1), np.repeat(left[deeper], 2, axis=0)
    return owner, sums, sizes


_ARRAYS = {"points": "i8", "counts": "i8", "of_row": "i8", "start": "i8", "end": "i8", "children": "i8", "pivot": "f8", "radius": "f8", "sums": "i8", "sizes": "i8"}
_WIDE = {"points", "pivot", "sums"}
_TREES = "vec_ids array<long>, labels array<string>, trees array<struct<" + ", ".join(f"{name}: binary" for name in _ARRAYS) + ">>"


def _stored(tree: Tree) -> dict[str, bytes]:
    return {name: np.ascontiguousarray(getattr(tree, name), kind).tobytes() for name, kind in _ARRAYS.items()}


def _loaded(row: dict[str, bytes], width: int) -> Tree:
    arrays = {name: np.frombuffer(row[name], kind) for name, kind in _ARRAYS.items()}
    return Tree(**{name: x.reshape(-1, width if name in _WIDE else 2) if name in _WIDE or name == "children" else x for name, x in arrays.items()})


def integers(vectors: pa.ListArray, params: CodeParams, dims: int) -> np.ndarray:
    """floor(scale * x), within the bound that distances of `dims` components allow."""
    bound = isqrt((1 << 62) // dims) // 2
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return np.clip(np.floor(params.scale * x), -bound, bound).astype(np.int64)


def _valid(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


def first_books(valid: DataFrame, params: CodeParams) -> np.ndarray | None:
    """[parts, entries, width]: the parts of the vectors with the least ids; None without rows."""
    rows = valid.select("vec_id", "embedding")
    order = (F.col("vec_id").asc_nulls_last(), F.col("embedding"))
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dims = len(first[0].embedding)
    if dims % params.parts:
        raise ValueError(f"vectors of {dims} components do not have {params.parts} equal parts")
    some = rows.where(F.size("embedding") == dims).orderBy(*order).limit(params.entries).collect()
    whole = integers(pa.array([r.embedding for r in some], pa.list_(pa.float64())), params, dims)
    return whole.reshape(len(some), params.parts, -1).transpose(1, 0, 2).copy()


def trees(valid: DataFrame, params: CodeParams, dims: int) -> DataFrame:
    """A row for each chunk of vectors: ids, labels and a tree for each part position."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, params.chunk):
                rows = batch.slice(at, params.chunk)
                parts = integers(rows.column("embedding"), params, dims).reshape(rows.num_rows, params.parts, -1)
                own = [_stored(grow(parts[:, p], params.leaf)) for p in range(params.parts)]
                out = {"vec_ids": [rows.column("vec_id").to_pylist()], "labels": [rows.column("label").to_pylist()], "trees": [own]}
                kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.struct([(n, pa.binary()) for n in _ARRAYS]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds)], list(out))

    return valid.where(F.size("embedding") == dims).mapInArrow(grown, _TREES)


def moved(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: rounded-down means of what each entry owns; unused entries stay."""
    width = books.shape[2]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for p, tree in enumerate(row.as_py()):
                    _, s, n = assign(_loaded(tree, width), books[p])
                    sums[p] += s
                    sizes[p] += n
        p, e = np.nonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(sums[p, e].tolist(), pa.list_(pa.int64())), pa.array(sizes[p, e])], ["part", "entry", "sums", "n"])

    rows = forest.select("trees").mapInArrow(summed, "part long, entry long, sums array<long>, n long")
    rows = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(width)))
    out = books.copy()
    for r in rows.collect():  # parts * entries at most
        out[r.part, r.entry] = [r[f"s{c}"] // r.n for c in range(width)]
    return out


def coded(forest: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row."""
    width = books.shape[2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, row in zip(batch.column("vec_ids"), batch.column("labels"), batch.column("trees")):
                codes, error = [], 0
                for p, stored in enumerate(row.as_py()):
                    tree = _loaded(stored, width)
                    owner, _, _ = assign(tree, books[p])
                    codes.append(owner[tree.of_row])
                    error = error + _squares(tree.points, books[p][owner])[tree.of_row]
                text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return forest.mapInArrow(rows, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, params: CodeParams = CodeParams()) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (hex, two digits a part), error (squared distance to what the code stands for) of every kept row, and the codebooks [parts, entries, width]."""
    if not 1 <= params.entries <= 256:
        raise ValueError("entries: 1 to 256")
    valid = _valid(vectors)
    books = first_books(valid, params)
    if books is None:
        return valid.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((params.parts, 0, 1), np.int64)
    forest = staged(trees(valid, params, params.parts * books.shape[2]), "trees")
    for _ in range(params.rounds):
        books = moved(forest, books)
    return coded(forest, books), books


def books_text(books: np.ndarray) -> str:
    """sha256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows and label_error, the errors of all rows of the same label; nulls are one label."""
    total = rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
