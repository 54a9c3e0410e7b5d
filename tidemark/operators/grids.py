"""Walks over the cells of grids, many grids at once.

Spark deals whole grids to tasks; a task stacks some of them (equal cells side by side) and walks over all of them in
array steps, a row or a column of every grid at a time, until nothing changes. A stack holds ``CELLS`` cells or one grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS = 1 << 18
Walk = Callable[[np.ndarray, dict[str, np.ndarray]], tuple[np.ndarray, dict[str, np.ndarray]]]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole grids, as many as make about CELLS rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= CELLS:
            table = pa.Table.from_batches(held)
            code = np.asarray(table.column(0).combine_chunks().dictionary_encode().indices)
            cut = int(np.flatnonzero(np.diff(code))[-1]) + 1 if (np.diff(code) != 0).any() else 0
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def walked(grid: DataFrame, walk: Walk, found: str) -> DataFrame:
    """source_id, r, c and the ``found`` columns of the cells that ``walk`` keeps. ``grid`` starts with source_id, r, c;
    ``walk`` gets which cells a stack holds and its other columns, all as arrays (row, column, grid), and gives which
    cells to keep and the columns found."""
    kind = grid.schema["source_id"].dataType.simpleString()
    schema = f"source_id {kind}, r int, c int{', ' + found if found else ''}"
    names, values = [f.split()[0] for f in schema.split(", ")], grid.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            table = table.combine_chunks()
            code = np.asarray(table.column(0).combine_chunks().dictionary_encode().indices)
            g = np.concatenate(([0], np.cumsum(np.diff(code) != 0)))
            r, c = (np.asarray(table.column(k)).astype(np.int64) for k in (1, 2))
            r0, c0 = r.min(), c.min()
            shape = (int(r.max() - r0) + 1, int(c.max() - c0) + 1, int(g[-1]) + 1)
            at = (r - r0, c - c0, g)
            held = np.zeros(shape, bool)
            held[at] = True
            stacked = {}
            for k, name in enumerate(values, 3):
                value = np.asarray(table.column(k))
                stacked[name] = np.zeros(shape, value.dtype)
                stacked[name][at] = value
            kept, out = walk(held, stacked)
            mask = kept[at]
            columns = [table.column(k).filter(pa.array(mask)).combine_chunks() for k in range(3)]
            columns = [columns[0], columns[1].cast(pa.int32()), columns[2].cast(pa.int32()), *(pa.array(out[n][at][mask]) for n in names[3:])]
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], names=names)

    return grid.repartition("source_id").sortWithinPartitions("source_id", "r", "c").mapInArrow(run, schema)


def _sweeps(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Views of an array along which a sweep goes: lines before, line, place; down, up, right and left."""
    for view, axis in ((a, 0), (a[::-1], 1), (a.swapaxes(0, 1), 2), (a.swapaxes(0, 1)[::-1], 3)):
        for k in range(1, len(view)):
            yield view, axis, k


def _view(a: np.ndarray, axis: int) -> np.ndarray:
    return (a, a[::-1], a.swapaxes(0, 1), a.swapaxes(0, 1)[::-1])[axis]


def reached(free: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Free cells that free cells join (by side or corner) to free starts."""
    seen = free & start
    while True:
        before = int(seen.sum())
        for view, axis, k in _sweeps(seen):
            last = view[k - 1]
            near = last.copy()
            near[1:] |= last[:-1]
            near[:-1] |= last[1:]
            view[k] |= near & _view(free, axis)[k]
        if int(seen.sum()) == before:
            return seen


def spill(height: np.ndarray, seed: np.ndarray, straight: float) -> np.ndarray:
    """The least, over paths from the seed, of the highest cell and the friction on the way (``straight`` for a step to
    a side). A sweep carries it along whole lines of all grids; it ends when a round of sweeps changes nothing."""
    best, diagonal = np.where(seed, height, np.inf), straight * np.sqrt(2.0)
    while True:
        before = best.copy()
        for view, axis, k in _sweeps(best):
            last = view[k - 1]
            to = last + straight
            np.minimum(to[1:], last[:-1] + diagonal, out=to[1:])
            np.minimum(to[:-1], last[1:] + diagonal, out=to[:-1])
            np.minimum(view[k], np.maximum(to, _view(height, axis)[k]), out=view[k])
        if (best == before).all():
            return best


def grown(order: np.ndarray, allowed: np.ndarray, seed: np.ndarray, barred: np.ndarray, wanted: np.ndarray, free_cells: int) -> np.ndarray:
    """Cells of a connected patch around each grid's seed: again and again the open cell of least ``order`` is taken
    and opens its allowed neighbours, until ``wanted`` cells are; once ``free_cells`` are, barred ones are passed over."""
    rows, columns, grids = order.shape
    taken, opened, closed = np.zeros(order.shape, bool), seed.copy(), np.zeros(order.shape, bool)
    count, each = np.zeros(grids, np.int64), np.arange(grids)
    flat = lambda a: a.reshape(-1, grids)
    while True:
        waiting = np.where(opened & ~closed, order, np.inf)
        place = flat(waiting).argmin(0)
        going = np.isfinite(flat(waiting)[place, each]) & (count < wanted)
        if not going.any():
            return taken
        g, p = each[going], place[going]
        flat(closed)[p, g] = True
        fits = ~(flat(barred)[p, g] & (count[g] >= free_cells))
        g, p = g[fits], p[fits]
        flat(taken)[p, g] = True
        count[g] += 1
        r, c = p // columns, p % columns
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                y, x = r + dr, c + dc
                inside = (y >= 0) & (y < rows) & (x >= 0) & (x < columns)
                y, x, k = y[inside], x[inside], g[inside]
                opened[y, x, k] |= allowed[y, x, k]
