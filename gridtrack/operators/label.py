"""Objects: connected components of cells, seam merges, bounding boxes, relabelling.

An object table has one row per cell of an object: segment, obj_id, t, iy, ix; the
background has none. An id is the least linear cell number t * ny * nx + iy * nx + ix
of the object, so it depends on nothing but the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..components import connected_components
from ..storage import released, staged

#: Nodes of all segments are labelled in one go: segment * 2**44 + linear cell number.
SEGMENT_SPAN = 1 << 44
#: (step in t, step in iy) of half the neighbours of a run of cells.
NEIGHBOURS_3D = ((0, 1), (1, -1), (1, 0), (1, 1))
NEIGHBOURS_2D = ((0, 1),)


def linear(ny: int, nx: int, t="t", iy="iy", ix="ix") -> Column:
    return F.col(t).cast("long") * (ny * nx) + F.col(iy) * nx + F.col(ix)


def runs(cells: DataFrame, ny: int, nx: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of neighbouring cells in a row: keys, segment, t, iy, x0, x1, node. Cells that come twice count once."""
    w = Window.partitionBy(*keys, "segment", "t", "iy").orderBy("ix")
    tagged = cells.withColumn("__g", F.col("ix") - F.dense_rank().over(w))
    out = tagged.groupBy(*keys, "segment", "t", "iy", "__g").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1")).drop("__g")
    return out.withColumn("node", F.col("segment") * F.lit(SEGMENT_SPAN) + linear(ny, nx, ix="x0"))


def touching(runs_of: DataFrame, others: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Pairs (a, b) of nodes whose runs touch: overlap, or are `reach` (0 or 1) columns apart; both: keys, x0, x1, node. The runs of one side with equal keys are apart from each other.

    Of two runs that touch, the one that begins later has the other as the last of its side that
    begins at its own start or before. So one pass over both sides in order of starts finds all
    pairs, as many at most as there are runs, whatever the number of runs in a row.
    """
    sides = [rows.select(*keys, "x0", "x1", "node", F.lit(side).alias("side")) for side, rows in enumerate((runs_of, others))]
    w = Window.partitionBy(*keys).orderBy("x0").rangeBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("side") == side, F.struct("x1", "node")), ignorenulls=True).over(w).alias(f"last_{side}") for side in (0, 1)]
    met = sides[0].union(sides[1]).select("x0", "node", "side", *last)
    other = F.when(F.col("side") == 0, F.col("last_1")).otherwise(F.col("last_0"))
    met = met.withColumn("other", other).where(F.col("other.x1") >= F.col("x0") - reach)
    mine, its = F.col("node"), F.col("other.node")
    return met.select(F.when(F.col("side") == 0, mine).otherwise(its).alias("a"), F.when(F.col("side") == 0, its).otherwise(mine).alias("b")).distinct()


def _contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the least node that each reaches along them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame, ny: int, nx: int, block_cells: int = 1 << 18) -> DataFrame:
    """(node, label) of nodes with an edge. Edges inside a block of steps (about block_cells cells of one segment) are contracted there, by tasks; only what is left between blocks goes through rounds."""
    depth = max(1, block_cells // (ny * nx)) * ny * nx
    block = lambda c: F.floor(F.col(c) / SEGMENT_SPAN) * F.lit(SEGMENT_SPAN // depth + 1) + F.floor(F.pmod(F.col(c), F.lit(SEGMENT_SPAN)) / depth)
    placed = staged(edges.select("a", "b", block("a").alias("block"), block("b").alias("other")), "touching")

    def contracted(group: pa.Table) -> pa.Table:
        node, near = _contracted(group["a"].to_numpy(), group["b"].to_numpy())
        return pa.table({"node": node, "near": near})

    inside = staged(placed.where("block = other").select("block", "a", "b").groupBy("block").applyInArrow(contracted, "node long, near long"), "near")
    between = placed.where("block <> other")
    if between.isEmpty():
        released(placed)
        return inside.withColumnRenamed("near", "label")
    name = lambda c: inside.select(F.col("node").alias(c), F.col("near").alias(f"near_{c}"))
    left = between.join(name("a"), "a", "left").join(name("b"), "b", "left")
    left = left.select(F.coalesce("near_a", "a").alias("a"), F.coalesce("near_b", "b").alias("b"))
    far = connected_components(left)
    released(placed)
    whole = inside.join(far.withColumnRenamed("node", "near"), "near", "left").select("node", F.coalesce("label", "near").alias("label"))
    # Nodes whose only edges leave their block are not inside it.
    return whole.union(far.join(inside.select("node"), "node", "left_anti").select("node", "label"))


def label(cells: DataFrame, ny: int, nx: int, diagonal: bool = True, through_time: bool = True, periodic: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """segment, obj_id, t, iy, ix (and keys: only cells of equal keys join). periodic: the last column touches the first.

    Rows of cells become runs, runs that touch become edges, and only those go through the components.
    """
    parts = staged(runs(cells.select(*keys, "segment", "t", "iy", "ix"), ny, nx, keys), "runs")
    reach, at = 1 if diagonal else 0, [*keys, "segment", "t", "iy", "way"]
    ways = NEIGHBOURS_3D if through_time else NEIGHBOURS_2D
    # Each run at its own place once for every way, and once where its neighbours on that way are.
    way = F.explode(F.array(*(F.struct(F.lit(k).alias("way"), F.lit(dt).alias("dt"), F.lit(dy).alias("dy")) for k, (dt, dy) in enumerate(ways))))
    all_ways = parts.withColumn("w", way).select(*parts.columns, "w.way", "w.dt", "w.dy")
    moved = all_ways.withColumn("t", F.col("t") + F.col("dt")).withColumn("iy", F.col("iy") + F.col("dy"))
    edges = touching(moved, all_ways, at, reach)
    if periodic:
        # The first run of a row and the last touch over the seam, in the row itself and on every way.
        west, east = all_ways.where("x0 = 0"), all_ways.where(F.col("x1") == nx - 1)
        name = lambda rows, c: rows.select(*at, F.col("node").alias(c))
        shifted = lambda rows: rows.withColumn("t", F.col("t") + F.col("dt")).withColumn("iy", F.col("iy") + F.col("dy"))
        for x, y in ((shifted(west), east), (shifted(east), west), (west, east)):
            edges = edges.union(name(x, "a").join(name(y, "b"), at).select("a", "b"))
    named = parts.join(components(edges, ny, nx), "node", "left").withColumn("obj_id", F.pmod(F.coalesce("label", "node"), F.lit(SEGMENT_SPAN)))
    named = named.select(*keys, "segment", "obj_id", "t", "iy", F.explode(F.sequence("x0", "x1")).alias("ix"))
    return named.select(*keys, "segment", "obj_id", "t", "iy", F.col("ix").cast("int").alias("ix"))


def seam_merge(objects: DataFrame, nx: int, per_step: bool = False) -> DataFrame:
    """Objects that meet over the seam (last column and first, in one row of one step) get the least of their ids, whatever the chain; per_step: only in the steps where they meet."""
    at = ["segment", "t", "iy"]
    east = objects.where(F.col("ix") == nx - 1).select(*at, F.col("obj_id").alias("e"))
    west = objects.where(F.col("ix") == 0).select(*at, F.col("obj_id").alias("w"))
    met = east.join(west, at).where("e <> w")
    scope = ["segment", "t"] if per_step else ["segment"]
    # Nodes are structs of scope and id: ids of different scopes never join.
    edges = met.select(F.struct(*scope, F.col("e").alias("id")).alias("a"), F.struct(*scope, F.col("w").alias("id")).alias("b"))
    labels = connected_components(edges).select(*(F.col(f"node.{c}").alias(c) for c in scope), F.col("node.id").alias("obj_id"), F.col("label.id").alias("__to"))
    return objects.join(labels, [*scope, "obj_id"], "left").withColumn("obj_id", F.coalesce("__to", "obj_id")).drop("__to").select(*objects.columns)


def bounding_boxes(objects: DataFrame, keys: tuple[str, ...] = ("segment", "obj_id")) -> DataFrame:
    return objects.groupBy(*keys).agg(*(f(c).alias(f"{c}{n}") for c in ("t", "iy", "ix") for f, n in ((F.min, 0), (F.max, 1))))


def numbered(ids: DataFrame, by: str, *then: str) -> DataFrame:
    """ids with obj_id_new: 1..n per segment in the order of `by` (a number of a cell) and then `then`. Each task ranks 2**20 numbers of `by`, and what comes before them is counted."""
    ids = ids.withColumn("__run", F.shiftright(by, 20))
    before = Window.partitionBy("segment").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    first = ids.groupBy("segment", "__run").count().select("segment", "__run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("segment", "__run").orderBy(by, *then))
    return ids.withColumn("__rank", rank).join(first, ["segment", "__run"]).withColumn("obj_id_new", (F.col("__first") + F.col("__rank")).cast("long")).drop("__run", "__first", "__rank")


def relabel(objects: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Ids 1..n per segment in the order of the old ids. ids (segment, obj_id, each once): the objects that stay, else all."""
    ids = numbered(objects.select("segment", "obj_id").distinct() if ids is None else ids.select("segment", "obj_id"), "obj_id")
    return objects.join(ids, ["segment", "obj_id"]).withColumn("obj_id", F.col("obj_id_new")).drop("obj_id_new").select(*objects.columns)
