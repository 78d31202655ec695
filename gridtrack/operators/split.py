"""Splitting labels whose parts are far apart, and following parts to the nearest one before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .forest import roots
from .label import label


def regions(objects: DataFrame, ny: int, nx: int) -> DataFrame:
    """The objects' cells with `part`: their 4-connected region in their step."""
    out = label(objects.withColumnRenamed("obj_id", "own"), ny, nx, diagonal=False, through_time=False, keys=("own",))
    return out.select("segment", F.col("own").alias("obj_id"), "t", "iy", "ix", F.col("obj_id").alias("part"))


def depths(inside: np.ndarray) -> np.ndarray:
    """Distance of each cell to the nearest cell that is not inside, 0 there; exact. Infinite where all cells are inside. inside: a grid, or many of one shape, each for itself.

    First along rows; then, of the parabolas that the rows' distances put over a column, the lower
    envelope, all columns of all grids at once: a row is entered once and leaves once, so time is linear in cells.
    """
    *many, ny, nx = inside.shape
    far = float(ny + nx)
    at = np.arange(nx, dtype=float)
    left = np.maximum.accumulate(np.where(inside, -np.inf, at), axis=-1)
    right = np.minimum.accumulate(np.where(inside, np.inf, at)[..., ::-1], axis=-1)[..., ::-1]
    along = np.minimum(np.minimum(at - left, right - at), far * 2) ** 2
    along = np.moveaxis(along, -2, 0).reshape(ny, -1)
    n = along.shape[1]
    columns = np.arange(n)
    rows, begins, last = np.zeros((ny, n), np.int64), np.full((ny + 1, n), np.inf), np.zeros(n, np.int64)
    begins[0] = -np.inf

    def meets(y: int, cols: np.ndarray) -> np.ndarray:
        """Where row y's parabola passes under the last one of the envelope."""
        p = rows[last[cols], cols]
        return (along[y, cols] + y * y - along[p, cols] - p * p) / (2.0 * (y - p))

    for y in range(1, ny):
        todo = columns
        while len(todo):  # each turn takes a parabola off
            x = meets(y, todo)
            off = x <= begins[last[todo], todo]
            fit = todo[~off]
            last[fit] += 1
            rows[last[fit], fit], begins[last[fit], fit] = y, x[~off]
            todo = todo[off]
            last[todo] -= 1
        begins[np.minimum(last + 1, ny), columns] = np.inf
    out, k = np.empty((ny, n)), np.zeros(n, np.int64)
    for y in range(ny):
        while (step := begins[k + 1, columns] < y).any():
            k += step
        p = rows[k, columns]
        out[y] = (y - p) ** 2 + along[p, columns]
    return np.moveaxis(np.where(out > far * far, np.inf, np.sqrt(out)).reshape(ny, *many, nx), 0, -2)


def cell_depths(objects: np.ndarray, iy: np.ndarray, ix: np.ndarray, ny: int, nx: int, most: int = 1 << 20) -> np.ndarray:
    """Depth of each cell in its object; objects: numbers from 0 on, in rising order. Boxes of like size are worked on together, some `most` cells at a time."""
    first = np.flatnonzero(np.append(True, np.diff(objects) != 0))
    y0, x0 = (np.maximum(np.minimum.reduceat(c, first) - 1, 0) for c in (iy, ix))
    h, w = (np.minimum(np.maximum.reduceat(c, first) + 2, n) - lo for c, n, lo in ((iy, ny, y0), (ix, nx, x0)))
    # Sides are rounded up to powers of two; what is added counts as inside, and so is nearest to nothing.
    sides = np.stack([1 << np.ceil(np.log2(s)).astype(np.int64) for s in (h, w)])
    out, count = np.empty(len(iy)), np.diff(np.append(first, len(iy)))
    for high, wide in np.unique(sides, axis=1).T.tolist():
        alike = np.flatnonzero((sides[0] == high) & (sides[1] == wide))
        each = max(1, most // (high * wide))
        for at in range(0, len(alike), each):
            some = alike[at : at + each]
            inside = (np.arange(high)[:, None] >= h[some, None, None]) | (np.arange(wide) >= w[some, None, None])
            n = count[some]
            cells = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = (np.repeat(np.arange(len(some)), n), iy[cells] - np.repeat(y0[some], n), ix[cells] - np.repeat(x0[some], n))
            inside[place] = True
            out[cells] = depths(inside)[place]
    return out


def interior(cells: DataFrame, ny: int, nx: int, block_cells: int = 1 << 16) -> DataFrame:
    """segment, t, obj_id, part, depth: the largest distance of a region's cell from the nearest cell of the grid outside its object; what lies beyond the grid is not outside. A task works on a block of steps, some block_cells cells (one step at least), many objects at once."""
    names, steps = ["segment", "t", "obj_id", "part"], max(1, block_cells // (ny * nx))

    def deepest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "obj_id"])
        new = np.append(False, (np.diff(rows["t"]) != 0) | (np.diff(rows["obj_id"]) != 0))
        rows = rows.assign(depth=cell_depths(np.cumsum(new), rows["iy"].to_numpy(), rows["ix"].to_numpy(), ny, nx))
        return rows.groupby(names, as_index=False)["depth"].max()

    rows = cells.select(*names, "iy", "ix", F.floor(F.col("t") / steps).alias("block"))
    return rows.groupBy("segment", "block").applyInPandas(deepest, "segment int, t int, obj_id long, part long, depth double")


def split_far(objects: DataFrame, ny: int, nx: int, distance: float) -> DataFrame:
    """Cells with `piece`: a region that lies more than distance from an earlier region of its label and step, or is deep as that one is, is a piece of its own; others keep the first region's."""
    cells = staged(regions(objects, ny, nx), "regions")
    mid = cells.groupBy("segment", "t", "obj_id", "part").agg(F.avg("iy").alias("cy"), F.avg("ix").alias("cx")).join(interior(cells, ny, nx), ["segment", "t", "obj_id", "part"])
    first = mid.select("segment", "t", "obj_id", F.col("part").alias("p"), F.col("cy").alias("py"), F.col("cx").alias("px"), F.col("depth").alias("pd"))
    far = F.sqrt(F.pow(F.col("cy") - F.col("py"), 2) + F.pow(F.col("cx") - F.col("px"), 2)) > distance
    deep = (F.col("depth") > distance) & (F.col("pd") > distance)
    own = mid.join(first, ["segment", "t", "obj_id"]).where("p < part").where(far | deep).select("segment", "t", "obj_id", "part").distinct().withColumn("apart", F.lit(True))
    lead = Window.partitionBy("segment", "t", "obj_id")
    named = mid.join(own, ["segment", "t", "obj_id", "part"], "left").withColumn("piece", F.when(F.col("apart"), F.col("part")).otherwise(F.min("part").over(lead)))
    return cells.join(named.select("segment", "t", "obj_id", "part", "piece"), ["segment", "t", "obj_id", "part"]).select("segment", "obj_id", "t", "iy", "ix", "piece")


def nearest_before(pieces: DataFrame, distance: float) -> DataFrame:
    """segment, t, piece, parent: the piece of the step before whose centre is nearest, if nearer than distance; the lowest on ties."""
    mid = pieces.groupBy("segment", "t", "piece").agg(F.avg("iy").alias("cy"), F.avg("ix").alias("cx"))
    # Centres meet in squares of the distance and the eight around, so that far ones never do.
    square = lambda c: F.floor(F.col(c) / max(distance, 1e-9))
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    last = mid.select("segment", (F.col("t") + 1).alias("t"), F.col("piece").alias("q"), F.col("cy").alias("qy"), F.col("cx").alias("qx"))
    last = last.withColumn("__dy", F.explode(around)).withColumn("__dx", F.explode(around)).withColumn("by", square("qy") + F.col("__dy")).withColumn("bx", square("qx") + F.col("__dx"))
    d = F.sqrt(F.pow(F.col("cy") - F.col("qy"), 2) + F.pow(F.col("cx") - F.col("qx"), 2))
    near = mid.withColumn("by", square("cy")).withColumn("bx", square("cx")).join(last, ["segment", "t", "by", "bx"]).withColumn("d", d).where(F.col("d") < distance)
    best = near.groupBy("segment", "t", "piece").agg(F.min(F.struct("d", "q")).alias("m")).select("segment", "t", "piece", F.col("m.q").alias("parent"))
    return mid.select("segment", "t", "piece").join(best, ["segment", "t", "piece"], "left")


def split_objects(objects: DataFrame, ny: int, nx: int, distance: float) -> DataFrame:
    """Objects whose far parts have ids of their own, followed from step to step by the nearest centre; many may follow one."""
    pieces = staged(split_far(objects, ny, nx, distance), "pieces")
    tree = roots(nearest_before(pieces, distance).select("segment", F.col("piece").alias("node"), "parent"))
    return pieces.join(tree.withColumnRenamed("node", "piece"), ["segment", "piece"]).select("segment", F.col("root").alias("obj_id"), "t", "iy", "ix")
