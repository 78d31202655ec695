"""Windows over the cells of a field: box and Gaussian means, local maxima, peaks.

A field has one row per cell: segment, t, iy, ix and values. Lines along an axis are
dense and begin at 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("segment", "t", "iy", "ix")
LINE = {"t": ("segment", "iy", "ix"), "iy": ("segment", "t", "ix"), "ix": ("segment", "t", "iy")}


def odd_window(size: float) -> int:
    """At least 1, rounded up to an odd number."""
    n = max(1, math.ceil(size))
    return n if n % 2 else n + 1


def _lengths(field: DataFrame, axis: str) -> DataFrame:
    """field with the length of each cell's line along axis, `__n`."""
    return field.withColumn("__n", (F.max(axis).over(Window.partitionBy(*LINE[axis])) + 1).cast("long"))


def padded(field: DataFrame, axis: str, reach: int, wrap: bool = False) -> DataFrame:
    """field with each line continued by reach cells on both sides (`__pos` is the place): mirrored with the edge cell repeated, again and again if need be, or going round. The lines' lengths are `__n`, if field has them."""
    rows = field if "__n" in field.columns else _lengths(field, axis)
    i, n = F.col(axis).cast("long"), F.col("__n")

    def places(first: Column, period: Column) -> Column:
        lo, hi = F.ceil((-reach - first) / period), F.floor((n + reach - 1 - first) / period)
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: first + period * k)).otherwise(F.array().cast("array<long>"))

    at = places(i, n) if wrap else F.concat(places(i, 2 * n), places(2 * n - 1 - i, 2 * n))
    # Cells that are not near an end stand for themselves alone.
    return rows.withColumn("__pos", F.explode(F.when((i >= reach) & (i < n - reach), F.array(i)).otherwise(at)))


def folded(width: int, n: int) -> tuple[int, int, int]:
    """(h, sign, periods): the sum over an odd width of a mirrored line of n cells is sign times that over h cells to both sides, and periods times the line's own sum. h is below n, however wide the window."""
    k, r = divmod(width, 2 * n)
    h = (r - 1) // 2
    return (h, 1, 2 * k) if k % 2 == 0 else (n - 1 - h, -1, 2 * (k + 1))


def _box_axis(field: DataFrame, axis: str, width: int, values: list[str], wrap: bool, size: int | None = None, block: int = 1 << 12) -> DataFrame:
    """Differences of running sums, taken from the line's first value on, so that large values cost no digits. size: the length of every line, for windows that are wider than lines. Lines along t (whose `__n` field has) are worked on in blocks of steps, each with what its windows reach on both sides."""
    if width <= 1:
        return field
    h, sign, periods = folded(width, size) if size and not wrap else (width // 2, 1, 0)
    if size:
        field = _lengths(field, axis)
        wrong = F.raise_error(F.format_string(f"a line along {axis} has %s cells, not {size}", "__n")).cast("long")
        field = field.withColumn("__n", F.when(F.col("__n") == size, F.col("__n")).otherwise(wrong))
    rows = padded(field, axis, h, wrap)
    keys, own = list(LINE[axis]), (F.col("__pos") >= 0) & (F.col("__pos") < F.col("__n"))
    if axis == "t":
        block = max(block, 4 * width)
        rows = rows.withColumn("__block", F.explode(F.sequence(F.floor((F.col("__pos") - h) / block), F.floor((F.col("__pos") + h) / block))))
        keys, own = [*keys, "__block"], own & (F.col("__block") == F.floor(F.col("__pos") / block))
    line = Window.partitionBy(*keys)
    order = line.orderBy("__pos")
    for v in values:
        rows = rows.withColumn(f"__base_{v}", F.first(v).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn(f"__sum_{v}", F.sum(F.col(v) - F.col(f"__base_{v}")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    for v in values:
        diff = sign * (F.lead(f"__sum_{v}", h).over(order) - F.lag(f"__sum_{v}", h + 1, 0.0).over(order))
        if periods:
            diff = diff + periods * F.sum(F.when(own, F.col(v) - F.col(f"__base_{v}"))).over(line)
        rows = rows.withColumn(f"__mean_{v}", diff / width + F.col(f"__base_{v}"))
    rows = rows.where(own)
    keep = [c for c in field.columns if c not in values and c != "__n"]
    # After padding a row's own place along the axis is __pos.
    return rows.select(*(F.col("__pos").cast(field.schema[axis].dataType).alias(c) if c == axis else F.col(c) for c in keep), *(F.col(f"__mean_{v}").alias(v) for v in values)).select(*keep, *values)


def _line_means(v: np.ndarray, there: np.ndarray, width: int, at: np.ndarray | None = None, wrap: bool = False) -> np.ndarray:
    """Means over an odd width along the last axis, of what is there; from each line's first value on. at: the places that the windows of all means hold, one after the other, else the line's own and what it is continued by."""
    n, h, sign, periods = v.shape[-1], width // 2, 1, 0
    if at is None:
        if not wrap:
            h, sign, periods = folded(width, n)
        at = np.arange(-h, n + h)
        at = at % n if wrap else np.where(at < 0, -1 - at, np.where(at >= n, 2 * n - 1 - at, at))

    def sums(x: np.ndarray) -> np.ndarray:
        run = np.cumsum(np.concatenate([np.zeros((*x.shape[:-1], 1)), x[..., at]], -1), -1)
        out = sign * (run[..., 2 * h + 1 :] - run[..., : -2 * h - 1])
        return out + periods * x.sum(-1, keepdims=True) if periods else out

    base = np.take_along_axis(v, there.argmax(-1)[..., None], -1)
    full = bool(there.all())
    out = sums(v - base if full else np.where(there, v - base, 0.0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / (width if full else np.round(sums(there.astype(float)))) + base


def box_means(field: DataFrame, windows: dict[str, tuple[float, float]], shape: tuple[int, int], value: str = "v", wrap_lon: bool = False, block_cells: int = 1 << 17) -> DataFrame | None:
    """The cells with a column for each window (time, space): box means of value, as box_mean's. A task has a block of steps, whole grids, with what its windows reach on both sides. None where blocks of some block_cells cells are short beside what they reach to.

    A mean is over the values that are there: a cell that is missing or null adds nothing. A step's line of another length than the grid's is an error.
    """
    ny, nx = shape
    sizes = {name: (odd_window(t), odd_window(s)) for name, (t, s) in windows.items()}
    reach, steps = max(t for t, _ in sizes.values()) // 2, block_cells // (ny * nx)
    if steps < max(1, 8 * reach):
        return None

    def means(group: pa.Table) -> pa.Table:
        t, iy, ix = (group[c].to_numpy().astype(np.int64) for c in ("t", "iy", "ix"))
        last, lo = group["n"][0].as_py(), group["block"][0].as_py() * steps
        for axis, i, n in (("iy", iy, ny), ("ix", ix, nx)):
            if i.max() >= n:
                raise ValueError(f"a line along {axis} has {i.max() + 1} cells, not {n}")
        first, hi = max(0, lo - reach), min(last, lo + steps)
        x = group["v"].to_numpy()
        v = np.full((min(last, lo + steps + reach) - first, ny, nx), np.nan)
        cells, there = np.zeros(v.shape, bool), np.zeros(v.shape, bool)
        cells[t - first, iy, ix], there[t - first, iy, ix], v[t - first, iy, ix] = True, group["v"].is_valid().to_numpy(), x
        for axis, n, short in (("ix", nx, cells.any(2) & ~cells[:, :, -1]), ("iy", ny, cells.any(1) & ~cells[:, -1])):
            if short.any():
                raise ValueError(f"a line along {axis} has fewer cells than {n}")
        own = (t >= lo) & (t < hi)
        at, out = (t[own] - first, iy[own], ix[own]), {}
        for name, (wt, ws) in sizes.items():
            m, some = v, there
            if ws > 1:
                m = _line_means(m, some, ws, wrap=wrap_lon)
                some = ~np.isnan(m) if not there.all() else some
                m = np.swapaxes(_line_means(np.swapaxes(m, 1, 2), np.swapaxes(some, 1, 2), ws), 1, 2)
                some = ~np.isnan(m) if not there.all() else some
            if wt > 1:
                place = np.arange(lo - wt // 2, hi + wt // 2) % (2 * last)
                place = np.where(place < last, place, 2 * last - 1 - place) - first
                late = lambda a: np.moveaxis(a, 0, -1)
                m = _line_means(late(m), late(some), wt, place)
                # Means begin at the block's first own step.
                got = m[at[1], at[2], at[0] + first - lo]
            else:
                got = m[at]
            out[name] = pa.array(got, mask=np.isnan(got) if not there.all() else None)
        return pa.table({c: group[c].filter(pa.array(own)) for c in CELL} | out)

    last = field.groupBy("segment").agg((F.max("t") + 1).cast("long").alias("n"))
    rows = field.select(*CELL, F.col(value).cast("double").alias("v")).join(F.broadcast(last), "segment")  # a number for each segment
    block = lambda c: F.floor(c / steps)
    lo, hi = block(F.greatest(F.col("t") - reach, F.lit(0))), block(F.least(F.col("t") + reach, F.col("n") - 1))
    rows = rows.withColumn("block", F.explode(F.sequence(lo, hi)))
    kinds = [f"{c} {field.schema[c].dataType.simpleString()}" for c in CELL]
    return rows.groupBy("segment", "block").applyInArrow(means, ", ".join([*kinds, *(f"`{name}` double" for name in sizes)]))


def box_mean(field: DataFrame, time: float = 1, space: float = 1, values: tuple[str, ...] = ("v",), wrap_lon: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean over a box of odd sizes, one axis after the other. One exchange serves both axes of a step.

    shape: rows and columns of the grid; with it, blocks of steps are worked on as arrays where they fit (box_means), windows wider than the grid are folded and cost no more than narrow ones, and a line of another length is an error. All lines of a segment have its last step.
    """
    wt, ws = odd_window(time), odd_window(space)
    if shape and len(values) == 1 and max(wt, ws) > 1 and (out := box_means(field, {values[0]: (time, space)}, shape, values[0], wrap_lon)) is not None:
        return out
    out, vs = field.select(*CELL, *values), list(values)
    ny, nx = shape or (None, None)
    if ws > 1:
        out = out.repartition("segment", "t")
        out = _box_axis(_box_axis(out, "ix", ws, vs, wrap_lon, nx), "iy", ws, vs, False, ny)
    if wt <= 1:
        return out
    last = field.groupBy("segment").agg((F.max("t") + 1).cast("long").alias("__n"))
    return _box_axis(out.join(F.broadcast(last), "segment"), "t", wt, vs, False).select(*CELL, *values)  # a number for each segment


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)] if sigma > 0 else [1.0]
    return [x / sum(w) for x in w]


def gaussian(field: DataFrame, sigma: float, value: str = "v") -> DataFrame:
    """Gaussian mean in y and x, edges mirrored; sigma 0 changes nothing."""
    w = gaussian_weights(sigma)
    out, r = field.select(*CELL, value), len(w) // 2
    if not r:
        return out
    out = out.repartition("segment", "t")
    for axis in ("iy", "ix"):
        order = Window.partitionBy(*LINE[axis]).orderBy("__pos")
        rows = padded(out, axis, r)
        terms = [F.lag(value, -k).over(order) * x for k, x in zip(range(-r, r + 1), w)]
        rows = rows.withColumn("__g", sum(terms[1:], terms[0])).where((F.col("__pos") >= 0) & (F.col("__pos") < F.col("__n")))
        out = rows.select(*(F.col("__pos").cast("int").alias(c) if c == axis else F.col(c) for c in CELL), F.col("__g").alias(value))
    return out


def gaussian_series(rows: DataFrame, keys: tuple[str, ...], value: str, out: str, sigma: float = 1.0) -> DataFrame:
    """Gaussian mean of each key's series by t, ends mirrored; a null spreads to all windows that hold it. rows: every step of the key's span."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    span = Window.partitionBy(*keys)
    order = span.orderBy("t")
    rows = rows.withColumn("__i", (F.row_number().over(order) - 1).cast("long")).withColumn("__n", F.count("*").over(span)).withColumn("__near", F.collect_list(F.struct(value)).over(order.rowsBetween(-r, r)))
    # A mirrored place is never farther off than the one that it stands for.
    from_ = F.greatest(F.col("__i") - r, F.lit(0))

    def at(k: int) -> Column:
        j = F.pmod(F.col("__i") + k, 2 * F.col("__n"))
        return F.get("__near", (F.when(j < F.col("__n"), j).otherwise(2 * F.col("__n") - 1 - j) - from_).cast("int"))[value]

    terms = [at(k) * x for k, x in zip(range(-r, r + 1), w)]
    return rows.withColumn(out, sum(terms[1:], terms[0])).drop("__i", "__n", "__near")


def local_maxima(field: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Cells that equal the largest value of their 3 x 3 neighbourhood and exceed threshold."""
    row = Window.partitionBy("segment", "t", "iy").orderBy("ix").rangeBetween(-1, 1)
    col = Window.partitionBy("segment", "t", "ix").orderBy("iy").rangeBetween(-1, 1)
    top = field.repartition("segment", "t").withColumn("__r", F.max(value).over(row)).withColumn("__m", F.max("__r").over(col))
    return top.where((F.col(value) == F.col("__m")) & (F.col(value) > threshold)).drop("__r", "__m")


def peaks(field: DataFrame, labels: DataFrame, min_dist: int, threshold: float, ny: int, nx: int, value: str = "v") -> DataFrame:
    """Local maxima of labelled cells, thinned per object and step: from the highest down, none within min_dist (Chebyshev) of a taken one or of the border. labels: segment, t, iy, ix, obj_id."""
    inside = (F.col("iy") >= min_dist) & (F.col("iy") < ny - min_dist) & (F.col("ix") >= min_dist) & (F.col("ix") < nx - min_dist)
    found = local_maxima(field, threshold, value).where(inside).join(labels, list(CELL)).select("segment", "t", F.col("iy").cast("int"), F.col("ix").cast("int"), "obj_id", F.col(value).cast("double").alias("v"))

    # In order of height; each is compared with the taken ones of its object and step.
    near = lambda a, b: F.greatest(F.abs(a["iy"] - b["iy"]), F.abs(a["ix"] - b["ix"])) <= min_dist
    order = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("low"), "iy", "ix")))
    none = F.array().cast("array<struct<low: double, iy: int, ix: int>>")
    taken = F.aggregate("tops", none, lambda acc, x: F.when(F.exists(acc, lambda y: near(x, y)), acc).otherwise(F.array_append(acc, x)))
    tops = found.groupBy("segment", "t", "obj_id").agg(order.alias("tops")).select("segment", "t", "obj_id", F.inline(taken))
    return tops.select("segment", "t", "iy", "ix", "obj_id", (-F.col("low")).alias("v"))
