"""Linking of basins from step to step on a stream, with the step before as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SPAN = 1 << 32
#: Rows that are given out at once.
_PART = 1 << 16
_OUT = "segment int, obj_id long, t long, iy int, ix int"
#: A step that is given out (with the objects its basins belong to), and one that can still grow.
_STATE = "t long, cells binary, basins binary, roots binary, open_t long, open_cells binary, open_basins binary"


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of columns, where each new value begins, and the number of each row's value."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def parents(t: np.ndarray, cells: np.ndarray, basins: np.ndarray, claim: str = "largest") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The basins of many steps at once, by the rules of `forest.link_basins`, sizes being cells: of each row (in the order of t and cells) the number of its basin, and by number the first row and the basin before that it goes on (-1: none)."""
    order = np.lexsort((basins, t))
    first, number = _numbered(t[order], basins[order])
    node = np.empty(len(t), np.int64)
    node[order] = number
    size = np.diff(np.append(first, len(t)))
    # Rows of a cell that was there in the step before, too: steps in order, cells in order in them.
    by_cell = np.lexsort((t, cells))
    met = np.flatnonzero((np.diff(cells[by_cell]) == 0) & (np.diff(t[by_cell]) == 1)) if len(t) else np.zeros(0, np.int64)
    before, now = node[by_cell[met]], node[by_cell[met + 1]]
    # Each basin before chooses the one with which it shares most cells, the least on ties.
    pair = np.lexsort((now, before))
    before, now = before[pair], now[pair]
    at, _ = _numbered(before, now)
    n = np.diff(np.append(at, len(before)))
    before, now = before[at], now[at]
    top = np.lexsort((now, -n, before))
    top = top[_numbered(before[top])[0]]
    before, now = before[top], now[top]
    # Of those that chose the same, the one of the largest size goes on, or the smallest.
    won = np.lexsort((before, -size[before], now) if claim == "largest" else (-before, size[before], now))
    won = won[_numbered(now[won])[0]]
    parent = np.full(len(first), -1, np.int64)
    parent[now[won]] = before[won]
    return node, order[first], parent


def _linked(t: np.ndarray, cells: np.ndarray, basins: np.ndarray, roots: np.ndarray, known: int, claim: str) -> np.ndarray:
    """The object of each row's basin, all steps at once: pointers to parents double. Of the first `known` rows it is given; rows in the order of t and cells."""
    node, first, up = parents(t, cells, basins, claim)
    given = first < known
    up = np.where(given | (up < 0), np.arange(len(up)), up)
    while (up != up[up]).any():
        up = up[up]
    return np.where(given, roots[first], basins[first])[up][node]


def link_stream(basins: DataFrame, claim: str = "largest") -> DataFrame:
    """segment, obj_id, t, iy, ix of a stream of basins (segment, t, iy, ix, obj_id = basin), as `forest.track` names them from `forest.link_basins` with cells as sizes.

    Steps of a segment come in order, a step's rows in any number of batches. A step is given out
    when a later one begins, so the last one never is unless a row with null iy (no cell) and a
    later t closes it. Cells of a step that is already given out are an error. State: two steps of
    a segment, the one before and the one that can still grow, in the checkpoint of the query.
    """

    def linked(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches], ignore_index=True)
        newest, least = int(rows["t"].max()), int(rows["t"].min())
        cells = rows[rows["iy"].notna()]
        t, ids = cells["t"].to_numpy(np.int64), cells["obj_id"].to_numpy(np.int64)
        cells = cells["iy"].to_numpy(np.int64) * _SPAN + cells["ix"].to_numpy(np.int64)
        known, roots = 0, np.zeros(0, np.int64)
        if state.exists:
            before_t, *before, open_t, open_cells, open_ids = state.get
            longs = lambda x: np.frombuffer(x, np.int64)
            open_cells, open_ids = longs(open_cells), longs(open_ids)
            if least < open_t:
                raise ValueError(f"segment {key[0]}: step {least} came after step {open_t}")
            newest = max(newest, open_t)
            t, cells, ids = np.append(np.full(len(open_cells), open_t), t), np.append(open_cells, cells), np.append(open_ids, ids)
            if before_t is not None:
                last_cells, last_ids, roots = map(longs, before)
                known = len(roots)
                t, cells, ids = np.append(np.full(known, before_t), t), np.append(last_cells, cells), np.append(last_ids, ids)
        order = np.lexsort((cells, t))  # stable: of equal cells of a step the first stays
        order = order[_numbered(t[order], cells[order])[0]]
        t, cells, ids = t[order], cells[order], ids[order]
        # The rows of the step before come first, and are the first in order.
        end = int(np.searchsorted(t, newest))
        roots = _linked(t[:end], cells[:end], ids[:end], np.append(roots, np.zeros(end - known, np.int64)), known, claim)
        if end:
            start = int(np.searchsorted(t, t[end - 1]))
            packed = [int(t[end - 1]), *(x[start:end].astype(np.int64).tobytes() for x in (cells, ids, roots))]
        else:
            packed = [None, b"", b"", b""]
        state.update((*packed, newest, cells[end:].tobytes(), ids[end:].tobytes()))
        for at in range(known, end, _PART):
            to = min(end, at + _PART)
            yield pd.DataFrame({"segment": key[0], "obj_id": roots[at:to], "t": t[at:to], "iy": (cells[at:to] // _SPAN).astype(np.int32), "ix": (cells[at:to] % _SPAN).astype(np.int32)})

    rows = basins.selectExpr("cast(segment as int) segment", "cast(t as long) t", "cast(iy as int) iy", "cast(ix as int) ix", "cast(obj_id as long) obj_id")
    return rows.groupBy("segment").applyInPandasWithState(linked, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
