"""Watershed basins of objects, and their tracks by overlap."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged
from .derive import mask_by_label
from .forest import link_basins, track
from .label import label
from .objects import areas, lifetime_filter
from .stencil import CELL, box_mean, peaks


def markers(found: DataFrame, ny: int, nx: int) -> DataFrame:
    """Peaks that touch (4 neighbours) are one marker: segment, t, iy, ix, marker."""
    return label(found, ny, nx, diagonal=False, through_time=False).select(*CELL, F.col("obj_id").alias("marker"))


#: Neighbours in the order in which they are reached: sides before corners.
AROUND = ((-1, 0), (0, -1), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))


def flood(objects: DataFrame, found: DataFrame, field: DataFrame, value: str = "v") -> DataFrame:
    """Basins: inside each object, water rises from the markers over the field turned upside down (8 neighbours); a cell belongs to the water that reaches it first, highest values first and, of equal ones, those met first. Objects without a marker have no basin.

    One task works on one object in one step, cell by cell in the order of a heap.
    """
    cells = objects.join(field.select(*CELL, F.col(value).cast("double").alias("__v")), list(CELL)).join(found.select(*CELL, "marker"), list(CELL), "left").select(*CELL, "obj_id", "marker", "__v")

    def basins(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["iy", "ix"])
        places = list(zip(rows["iy"].tolist(), rows["ix"].tolist()))
        depth = dict(zip(places, (-rows["__v"]).tolist()))
        taken = {c: int(m) for c, m in zip(places, rows["marker"]) if not pd.isna(m)}
        queue = [(depth[c], 0, c) for c in taken]
        heapq.heapify(queue)
        age = 0
        while queue:
            _, _, (y, x) = heapq.heappop(queue)
            for dy, dx in AROUND:
                c = (y + dy, x + dx)
                if c in depth and c not in taken:
                    age += 1
                    taken[c] = taken[y, x]
                    heapq.heappush(queue, (depth[c], age, c))
        at = list(taken)
        first = rows.iloc[0]
        return pd.DataFrame({"segment": int(first["segment"]), "t": int(first["t"]), "iy": [c[0] for c in at], "ix": [c[1] for c in at], "obj_id": list(taken.values())})

    return cells.groupBy("segment", "t", "obj_id").applyInPandas(basins, "segment int, t int, iy int, ix int, obj_id long")


def watershed_tracks(anom: DataFrame, objects: DataFrame, grid: DataFrame, ny: int, nx: int, min_dist: int, threshold: float, smooth_steps: float, smooth_cells: float, min_steps: int, sign: int = 1, claim: str = "largest") -> DataFrame:
    """Objects split at their peaks and followed by overlap: the masked anomaly (times sign) is smoothed, its peaks mark basins, basins link in time, short tracks go."""
    field = mask_by_label(anom.withColumn("v", F.col("anom") * sign).select(*CELL, "v"), objects)
    field = staged(box_mean(field, smooth_steps, smooth_cells), "smoothed")
    found = markers(peaks(field, objects, min_dist, threshold, ny, nx), ny, nx)
    basins = staged(flood(objects, found, field), "basins")
    sizes = areas(basins, grid).withColumnRenamed("area", "size")
    return lifetime_filter(track(basins, link_basins(basins, sizes, claim)), min_steps)


