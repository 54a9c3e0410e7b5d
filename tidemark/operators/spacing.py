"""Rows that keep a distance in time from the last row taken, over runs of any length.

Which row is taken next after a taken one (the first at least ``apart`` later, or the first of another level) does not
depend on what came before, so a span of time is a function: from the time of the last row taken before it to the last
one taken in it. Spans (64 distances long) are worked out apart, each in arrays, by doubling of the pointers to the next
row; the only rows that can follow one before the span are those within one distance of its start, so a span's function
is a short list. The spans of a key are then chained in order, one row each, and every span, told what came before it,
marks its own rows. No task holds more than a span, and the rows of a key are never gathered.

Rows without a time are left out; keys and levels may be null (nulls are equal); rows of equal time go by ``tie``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = 64
NEVER = (1 << 63) - 1  # the threshold of a row that is taken whatever came before


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Where a new (grp, span) begins, but for the first row."""
    code = np.asarray(batch.column(0).dictionary_encode().indices)
    return np.flatnonzero((np.diff(code) != 0) | (np.diff(np.asarray(batch.column(1))) != 0)) + 1


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold whole groups."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = pa.Table.from_batches([rest[-1].slice(rest[-1].num_rows - 1), batch]).combine_chunks().to_batches()[0] if rest else batch
        cuts = _changes(joined)
        if not len(cuts):
            rest.append(batch)
            continue
        first, last = (int(cuts[k]) - (1 if rest else 0) for k in (0, -1))
        if rest:
            yield pa.Table.from_batches([*rest, batch.slice(0, first)]).combine_chunks().to_batches()[0]
        else:
            first = 0
        if last > first:
            yield batch.slice(first, last - first)
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


class Spans:
    """The rows of some whole spans (grp, span, t, level, ...) and, for each row, the next one taken after it."""

    def __init__(self, batch: pa.RecordBatch, apart: int, width: int):
        self.t, level = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        n = len(self.t)
        self.first = np.concatenate(([0], _changes(batch)))
        self.end = np.append(self.first[1:], n)
        self.group = np.repeat(np.arange(len(self.first)), self.end - self.first)
        begins = np.asarray(batch.column(1))[self.first] * width
        self.offset = self.t - begins[self.group]
        # spans side by side on one axis: what lies up to a distance beyond a span is still before the next
        self.axis, self.step = self.offset + self.group * (2 * width), 2 * width
        self.begins, self.apart = begins, apart
        change = np.zeros(n, bool)
        change[1:] = (level[1:] != level[:-1]) | (self.t[1:] - self.t[:-1] >= apart)
        change[self.first] = False
        self.change = change
        walls = np.union1d(np.flatnonzero(change), self.end)
        following = walls[np.searchsorted(walls, np.arange(n), side="right")]
        self.next = np.minimum(np.maximum(np.searchsorted(self.axis, self.axis + apart), np.arange(n) + 1), following)
        self.inside = self.next < self.end[self.group]
        starts = np.append(np.flatnonzero(change), n)
        self.first_change = np.minimum(starts[np.searchsorted(starts, self.first)], self.end)

    def last_from(self) -> np.ndarray:
        """The time of the last row taken in the span if a row is taken."""
        to = np.where(self.inside, self.next, np.arange(len(self.t)))
        while True:
            further = to[to]
            if (further == to).all():
                return self.t[to]
            to = further

    def functions(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every span the thresholds that the last time before plus the distance is held against, rising, and the
        last time taken if that row is the first to reach it."""
        out = self.last_from()
        reach = np.minimum(np.searchsorted(self.axis, np.arange(len(self.first)) * self.step + self.apart) + 1, self.first_change)
        reach = np.minimum(reach, self.end)
        limits, results = [], []
        for a, b, c, e in zip(self.first, reach, self.first_change, self.end):
            always = c < e and b == c  # a change of level within reach is taken in any case
            limits.append(np.append(self.t[a:b], NEVER) if always else self.t[a:b])
            results.append(np.append(out[a:b], out[c]) if always else out[a:b])
        return limits, results

    def taken(self, before: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Which rows are taken, given the last time taken before each span; in fresh spans the first row is."""
        at = np.searchsorted(self.axis, np.arange(len(self.first)) * self.step + np.maximum(before + self.apart - self.begins, 0))
        entry = np.where(fresh, self.first, np.minimum(np.maximum(at, self.first), self.first_change))
        marked = self.change.copy()
        going = entry[entry < self.end]
        going = np.union1d(going, np.flatnonzero(self.change))
        marked[going] = True
        while len(going):
            going = self.next[going][self.inside[going]]
            going = going[~marked[going]]
            marked[going] = True
        return marked


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def spaced(rows: DataFrame, keys: list[str], micros: str, tie: str, apart_us: int, level: str | None = None, spans: int = SPANS) -> DataFrame:
    """keys, micros, tie of the rows that are taken: the first of a key, those of another level than the row before,
    those after a silence of ``apart_us``, and each that is ``apart_us`` or more after the last one taken."""
    width = apart_us * spans
    kept = F.struct(*keys, micros, tie).alias("row")
    t = F.col(micros).cast("long")
    span = ((t - F.pmod(t, F.lit(width))) / width).cast("long")
    named = rows.where(F.col(micros).isNotNull()).select(
        F.to_json(F.struct(*keys)).alias("grp"), span.alias("span"), t.alias("t"),
        (F.xxhash64(level) if level is not None else F.lit(0).cast("long")).alias("level"), F.col(tie).alias("tie"), kept,
    )
    dealt = named.repartition("grp", "span")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            found = Spans(batch, apart_us, width)
            limits, results = found.functions()
            first, last = pa.array(found.first), pa.array(found.end - 1)
            columns = [batch.column(0).take(first), batch.column(1).take(first), *(batch.column(k).take(at) for at in (first, last) for k in (2, 3))]
            yield pa.RecordBatch.from_arrays([*columns, _lists(limits), _lists(results)], names=["grp", "span", "t0", "level0", "t1", "level1", "limits", "results"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = end = level_before = last = None
        for batch in batches:
            out = []
            for grp, _, t0, level0, t1, level1, limits, results in zip(*(c.to_pylist() for c in batch.columns)):
                fresh = grp != key or level0 != level_before or t0 - end >= apart_us
                out.append(None if fresh else last)
                at = 0 if fresh else bisect_left(limits, last + apart_us)
                last = results[at] if at < len(results) else last
                key, end, level_before = grp, t1, level1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["grp", "span", "before"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            found = Spans(batch, apart_us, width)
            before = batch.column(4).take(pa.array(found.first))
            fresh = np.asarray(before.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(5).filter(pa.array(found.taken(np.asarray(before.fill_null(0)), fresh)))], names=["row"])

    order = ["grp", "span", "t", "tie"]
    shape = "grp string, span long, t0 long, level0 long, t1 long, level1 long, limits array<long>, results array<long>"
    pieces = dealt.sortWithinPartitions(*order).select("grp", "span", "t", "level").mapInArrow(functions, shape)
    before = pieces.repartition("grp").sortWithinPartitions("grp", "span").mapInArrow(chained, "grp string, span long, before long")
    told = dealt.join(before, ["grp", "span"]).sortWithinPartitions(*order).select("grp", "span", "t", "level", "before", "row")
    return told.mapInArrow(marked, f"row {named.schema['row'].dataType.simpleString()}").select("row.*")
