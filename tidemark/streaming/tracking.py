"""Vehicle tracks and repeated sightings of boxes along a camera's frames.

What a rule remembers of the past is one table of boxes (``Boxes``); a step takes the table of a new frame and gives the
next. Rows of a key are first cut into runs where frames lie further apart than ``gap``: frames without a box in
between would have emptied the memory, so nothing is lost, batches and streams agree, and no run is ever cut."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.sinks import written

SIDES = ["x1", "y1", "x2", "y2"]
NONE = -np.inf
NEAR = 1 << 15  # runs that start within so many gaps share a group
TOGETHER = 2048  # runs of a group that are worked through side by side
FEW = 6  # of fewer runs each goes by itself
# fixed values: confidence from which a box needs so many sightings
TIERS = ((0.12, 1), (0.03, 2), (0.008, 3), (0.0025, 4))
LEAST_CONF = np.array([least for least, _ in TIERS])


class Boxes:
    """Some boxes as columns: ``box`` (n x 4) and one-dimensional arrays by name."""

    def __init__(self, box: np.ndarray, **columns: np.ndarray):
        self.box, self.columns = np.asarray(box, float).reshape(-1, 4), {k: np.asarray(v) for k, v in columns.items()}

    @staticmethod
    def of(rows: pd.DataFrame, names: list[str]) -> Boxes:
        """Rows of one frame, the strongest first."""
        rows = rows.sort_values(["conf", "box_no"], ascending=[False, True], kind="stable")
        return Boxes(rows[SIDES].to_numpy(), **{n: rows[n].to_numpy() for n in names if n in rows})

    def __len__(self) -> int:
        return len(self.box)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def take(self, at: np.ndarray) -> Boxes:
        return Boxes(self.box[at], **{k: v[at] for k, v in self.columns.items()})

    def given(self, **columns: np.ndarray) -> Boxes:
        return Boxes(self.box, **self.columns | columns)

    def plain(self) -> dict[str, list]:
        return {"box": self.box.tolist()} | {k: v.tolist() for k, v in self.columns.items()}


class Stack:
    """The boxes of one frame of each of many runs: ``box`` (runs x room x 4) and columns (runs x room), of which the first
    ``n`` of a run count."""

    def __init__(self, box: np.ndarray, n: np.ndarray, **columns: np.ndarray):
        self.box, self.n, self.columns = box, n, columns

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    @property
    def there(self) -> np.ndarray:
        return np.arange(self.box.shape[1]) < self.n[:, None]

    def given(self, **columns: np.ndarray) -> Stack:
        return Stack(self.box, self.n, **self.columns | columns)

    def runs(self, at: slice | np.ndarray) -> Stack:
        return Stack(self.box[at], self.n[at], **{k: v[at] for k, v in self.columns.items()})

    def ordered(self, order: np.ndarray, n: np.ndarray) -> Stack:
        """The first n places of ``order`` (runs x places)."""
        order = order[:, : n.max(initial=0)]
        return Stack(np.take_along_axis(self.box, order[:, :, None], 1), n, **{k: np.take_along_axis(v, order, 1) for k, v in self.columns.items()})

    def where(self, good: np.ndarray) -> Stack:
        """Those of the boxes that are good, in their order."""
        return self.ordered(np.argsort(~good, axis=1, kind="stable"), good.sum(1))

    def one(self, run: int) -> Boxes:
        n = self.n[run]
        return Boxes(self.box[run, :n], **{k: v[run, :n] for k, v in self.columns.items()})


def no_stack(runs: int, **kinds: type) -> Stack:
    return Stack(np.zeros((runs, 0, 4)), np.zeros(runs, np.int64), **{k: np.zeros((runs, 0), kind) for k, kind in kinds.items()})


def nothing(**kinds: type) -> Boxes:
    return Boxes(np.zeros((0, 4)), **{k: np.zeros(0, kind) for k, kind in kinds.items()})


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all boxes of a (rows) against all of b (columns), frame by frame where both are stacks: IoU, and the share of
    the smaller box that both cover."""
    ax1, ay1, ax2, ay2 = (a[..., k][..., :, None] for k in range(4))
    bx1, by1, bx2, by2 = (b[..., k][..., None, :] for k in range(4))
    shared = np.maximum(np.minimum(ax2, bx2) - np.maximum(ax1, bx1), 0) * np.maximum(np.minimum(ay2, by2) - np.maximum(ay1, by1), 0)
    area_a, area_b = np.maximum(ax2 - ax1, 0) * np.maximum(ay2 - ay1, 0), np.maximum(bx2 - bx1, 0) * np.maximum(by2 - by1, 0)
    union = area_a + area_b - shared
    return shared / np.where(union > 0, union, 1), shared / np.minimum(np.maximum(area_a, 1), np.maximum(area_b, 1))


def centres_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of the centres in diagonals of the larger box (of 8 at least), as ``overlaps``."""
    ax1, ay1, ax2, ay2 = (a[..., k][..., :, None] for k in range(4))
    bx1, by1, bx2, by2 = (b[..., k][..., None, :] for k in range(4))
    aw, ah, bw, bh = ax2 - ax1, ay2 - ay1, bx2 - bx1, by2 - by1
    diagonal = np.maximum(np.maximum(np.sqrt(aw * aw + ah * ah), np.sqrt(bw * bw + bh * bh)), 8.0)
    return np.hypot((ax1 + ax2 - bx1 - bx2) / 2, (ay1 + ay2 - by1 - by2) / 2) / diagonal


def nearness(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all boxes of a (rows) against all of b (columns): IoU, distance of the centres in diagonals of the larger box
    (of 8 at least), and the share of the smaller box that both cover."""
    iou, smaller = overlaps(a, b)
    return iou, centres_apart(a, b), smaller


def moves(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """How far each box's centre has moved."""
    return ((now - before)[..., :2] + (now - before)[..., 2:]) / 2


def first_come(score: np.ndarray) -> np.ndarray:
    """For each row in turn the free column of its best score, or -1 where all are NONE."""
    score, pick = score.copy(), np.full(len(score), -1)
    for k in range(len(score) if score.size else 0):
        best = int(score[k].argmax())
        if score[k, best] > NONE:
            pick[k], score[:, best] = best, NONE
    return pick


def best_first(score: np.ndarray) -> np.ndarray:
    """For each column its row when the best of all free pairs is taken again and again, or -1."""
    score, pick = score.copy(), np.full(score.shape[1], -1)
    while score.size and score.max() > NONE:
        row, column = np.unravel_index(int(score.argmax()), score.shape)
        pick[column] = row
        score[row], score[:, column] = NONE, NONE
    return pick


def sightings_needed(conf: np.ndarray, whole_frame: bool) -> np.ndarray:
    """By confidence; 0 for boxes too weak to count outside a whole-frame pass."""
    steps = np.array([5 if whole_frame else 0] + [n for _, n in TIERS[::-1]])
    return steps[(conf[:, None] >= LEAST_CONF).sum(1)]


def confirm(frame: Boxes, before: Boxes, whole_frame: bool = True, least_iou: float = 0.12, most_centre: float = 0.55, kept: int = 60) -> tuple[Boxes, Boxes]:
    """The frame's boxes with hits and confirmed, and what to remember. Weak boxes need repeated sightings; a confirmed
    box stays so while it is seen."""
    needed = sightings_needed(frame["conf"], whole_frame)
    frame, needed = frame.take(needed > 0), needed[needed > 0]
    iou, centre, _ = nearness(frame.box, before.box)
    seen = first_come(np.where((iou >= least_iou) | (centre <= most_centre), 3.5 * iou + np.clip(1 - centre, 0, None), NONE))
    hits = np.ones(len(frame), np.int64)
    old = seen >= 0
    hits[old] += before["hits"][seen[old]]
    sure = np.zeros(len(frame), bool)
    sure[old] = before["confirmed"][seen[old]]
    hits = np.where(sure, np.maximum(hits, needed), hits)
    out = frame.given(hits=hits, confirmed=hits >= needed)
    return out, out.take(np.lexsort((-out["conf"], ~out["confirmed"]))[:kept])


def associate(frame: Boxes, before: Boxes, next_id: int, least_iou: float = 0.08, most_centre: float = 0.9, most_missed: int = 1, blend: float = 1.0) -> tuple[Boxes, int]:
    """Tracks after a frame. A matched box is blended with its track's, moves the velocity and keeps the track's stage
    (as stale) if it has none of its own; other boxes start tracks; a track that is missed is carried with 0.9 of its
    confidence. Of tracks that cover each other the present, then the stronger one stays."""
    n = len(frame)
    iou, centre, _ = nearness(before.box, frame.box)
    track = best_first(np.where((iou >= least_iou) | (centre <= most_centre), 4 * iou + np.clip(1 - centre, 0, None), NONE))
    old = np.flatnonzero(track >= 0)
    box, velocity, ids = frame.box.copy(), np.zeros((n, 2)), np.zeros(n, np.int64)
    stage = frame.columns.get("stage", np.full(n, np.nan)).astype(float)
    stale = np.zeros(n, bool)
    if len(old):
        mate = track[old]
        box[old] = np.round(blend * frame.box[old] + (1 - blend) * before.box[mate], 1)
        velocity[old] = np.round(0.65 * moves(before.box[mate], frame.box[old]) + 0.35 * np.stack([before["vx"][mate], before["vy"][mate]], 1), 2)
        ids[old] = before["track_id"][mate]
        stale[old] = np.isnan(stage[old]) & ~np.isnan(before["stage"][mate])
        stage[old] = np.where(np.isnan(stage[old]), before["stage"][mate], stage[old])
    new = np.flatnonzero(track < 0)
    ids[new] = next_id + np.arange(len(new))
    lost = np.setdiff1d(np.arange(len(before)), track)
    lost = before.take(lost[before["missed"][lost] < most_missed])
    join = lambda mine, theirs: np.concatenate([mine, theirs])
    every = Boxes(np.concatenate([box, lost.box]), conf=join(frame["conf"], np.round(0.9 * lost["conf"], 3)), box_no=join(frame["box_no"], lost["box_no"]), track_id=join(ids, lost["track_id"]), missed=join(np.zeros(n, np.int64), lost["missed"] + 1),
                  vx=join(velocity[:, 0], lost["vx"]), vy=join(velocity[:, 1], lost["vy"]), stage=join(stage, lost["stage"]), stale=join(stale, lost["stale"]))
    every = every.take(np.lexsort((every["track_id"], -every["conf"], every["missed"])))
    iou, _, smaller = nearness(every.box, every.box)
    double, stays = (iou >= 0.45) | (smaller >= 0.72), np.zeros(len(every), bool)
    for k in range(len(every)):
        stays[k] = not (double[k] & stays).any()
    return every.take(stays), next_id + len(new)


def repeated(frame: Boxes, before: Boxes, least_iou: float = 0.3, required: int = 3, least_motion: float | None = None) -> tuple[Boxes, Boxes]:
    """The frame's privacy boxes with hits and confirmed: the same label near the same place in enough frames, and, if
    asked for, enough motion since the frame before."""
    iou, _, _ = nearness(frame.box, before.box)
    seen = first_come(np.where((iou >= least_iou) & (frame["label"][:, None] == before["label"][None]), iou, NONE))
    hits = np.ones(len(frame), np.int64)
    hits[seen >= 0] += before["hits"][seen[seen >= 0]]
    moved = frame["motion"] >= least_motion if least_motion is not None and len(before) else np.ones(len(frame), bool)
    out = frame.given(hits=np.minimum(hits, required + 1), confirmed=(hits >= required) & moved)
    return out, out


def first_come_all(score: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first_come`` of every run's score (runs x rows x columns), whose first ``n`` rows count."""
    score, pick = score.copy(), np.full(score.shape[:2], -1)
    for k in range(score.shape[1] if score.size else 0):
        at = np.flatnonzero(n > k)
        best = score[at, k].argmax(1)
        good = score[at, k, best] > NONE
        at, best = at[good], best[good]
        pick[at, k] = best
        score[at, :, best] = NONE
    return pick


def best_first_all(score: np.ndarray) -> np.ndarray:
    """``best_first`` of every run's score (runs x rows x columns)."""
    score, pick = score.copy(), np.full((len(score), score.shape[2]), -1)
    at, left = np.arange(len(score)), score
    while left.size:
        flat = left.reshape(len(left), -1)
        best = flat.argmax(1)
        good = flat[np.arange(len(left)), best] > NONE
        at, left, best = at[good], left[good], best[good]
        row, column = np.divmod(best, score.shape[2])
        pick[at, column] = row
        mine = np.arange(len(at))
        left[mine, row] = NONE
        left[mine, :, column] = NONE
    return pick


def confirm_all(frame: Stack, before: Stack, least_iou: float = 0.12, most_centre: float = 0.55, kept: int = 60) -> tuple[Stack, Stack]:
    """``confirm`` of whole frames of many runs."""
    there, needed = frame.there, sightings_needed(frame["conf"].ravel(), True).reshape(frame["conf"].shape)
    iou, _ = overlaps(frame.box, before.box)
    centre = centres_apart(frame.box, before.box)
    near = ((iou >= least_iou) | (centre <= most_centre)) & there[:, :, None] & before.there[:, None, :]
    seen = first_come_all(np.where(near, 3.5 * iou + np.clip(1 - centre, 0, None), NONE), frame.n)
    run, k = np.nonzero(seen >= 0)
    old = (run, seen[run, k])
    hits, sure = np.ones(seen.shape, np.int64), np.zeros(seen.shape, bool)
    hits[run, k] += before["hits"][old]
    sure[run, k] = before["confirmed"][old]
    hits = np.where(sure, np.maximum(hits, needed), hits)
    out = frame.given(hits=hits, confirmed=hits >= needed)
    return out, out.ordered(np.lexsort((-out["conf"], ~out["confirmed"], ~there)), np.minimum(frame.n, kept))


def stays_all(every: Stack, least_iou: float = 0.45, least_share: float = 0.72) -> np.ndarray:
    """Of boxes in order those that no box which stays covers (runs x room). Runs of like numbers go together."""
    stays = np.zeros(every.box.shape[:2], bool)
    room = 4
    while room // 2 < every.n.max(initial=0) or room == 4:
        at = np.flatnonzero((every.n <= room) & ((every.n > room // 2) | (room == 4)))
        m = min(room, stays.shape[1])
        room *= 2
        if not len(at) or not m:
            continue
        box = every.box[at, :m]
        iou, smaller = overlaps(box, box)
        double = (iou >= least_iou) | (smaller >= least_share)
        mine, there = np.zeros((len(at), m), bool), every.there[at, :m]
        for k in range(m):
            mine[:, k] = there[:, k] & ~(double[:, k, :k] & mine[:, :k]).any(1)
        stays[at, :m] = mine
    return stays


def associate_all(frame: Stack, before: Stack, next_id: np.ndarray, least_iou: float = 0.08, most_centre: float = 0.9, most_missed: int = 1, blend: float = 1.0) -> tuple[Stack, np.ndarray]:
    """``associate`` of many runs, without stages."""
    there, held = frame.there, before.there
    iou, _ = overlaps(before.box, frame.box)
    centre = centres_apart(before.box, frame.box)
    near = ((iou >= least_iou) | (centre <= most_centre)) & held[:, :, None] & there[:, None, :]
    track = best_first_all(np.where(near, 4 * iou + np.clip(1 - centre, 0, None), NONE))
    run, k = np.nonzero(track >= 0)
    mate = (run, track[run, k])
    box, velocity, ids = frame.box.copy(), np.zeros((*there.shape, 2)), np.zeros(there.shape, np.int64)
    box[run, k] = np.round(blend * frame.box[run, k] + (1 - blend) * before.box[mate], 1)
    velocity[run, k] = np.round(0.65 * moves(before.box[mate], frame.box[run, k]) + 0.35 * np.stack([before["vx"][mate], before["vy"][mate]], 1), 2)
    ids[run, k] = before["track_id"][mate]
    new = there & (track < 0)
    ids = np.where(new, next_id[:, None] + np.cumsum(new, 1) - 1, ids)
    lost = held & (before["missed"] < most_missed)
    lost[mate] = False
    join = lambda mine, theirs: np.concatenate([mine, theirs], 1)
    every = Stack(join(box, before.box), frame.n + lost.sum(1), conf=join(frame["conf"], np.round(0.9 * before["conf"], 3)), box_no=join(frame["box_no"], before["box_no"]), track_id=join(ids, before["track_id"]),
                  missed=join(np.zeros(there.shape, np.int64), before["missed"] + 1), vx=join(velocity[:, :, 0], before["vx"]), vy=join(velocity[:, :, 1], before["vy"]))
    order = np.lexsort((every["track_id"], -every["conf"], every["missed"], ~join(there, lost)))
    every = every.ordered(order, every.n)
    return every.where(stays_all(every)), next_id + new.sum(1)


UNSEEN = {"hits": np.int64, "confirmed": bool, "label": object, "conf": float}
NO_TRACKS = {"conf": float, "box_no": np.int64, "track_id": np.int64, "missed": np.int64, "vx": float, "vy": float, "stage": float, "stale": bool}


def runs(boxes: DataFrame, keys: list[str], frame: str, gap: int, span: int = 4096) -> DataFrame:
    """The boxes with ``run``, the first frame of their run. The distinct frames are cut into spans of ``span`` gaps that
    are looked through apart; a span starts from the last frame, and the last start of a run, of the spans before."""
    frames = boxes.select(*keys, frame).distinct().withColumn("_span", F.floor(F.col(frame) / (max(1, gap) * span)))
    order = Window.partitionBy(*keys, "_span").orderBy(frame)
    spans = Window.partitionBy(*keys).orderBy("_span")
    earlier = spans.rowsBetween(Window.unboundedPreceding, -1)
    ends = frames.groupBy(*keys, "_span").agg(F.max(frame).alias("_end")).withColumn("_before", F.lag("_end").over(spans)).drop("_end")
    rows = frames.join(ends, [*keys, "_span"])
    apart = F.col(frame) - F.coalesce(F.lag(frame).over(order), "_before")
    rows = rows.withColumn("_starts", F.when(apart.isNull() | (apart > gap), F.col(frame))).drop("_before")
    starts = rows.groupBy(*keys, "_span").agg(F.max("_starts").alias("_last")).withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    own = F.last("_starts", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", own).join(starts, [*keys, "_span"])
    return boxes.join(rows.select(*keys, frame, F.coalesce("_own", "_carried").alias("run")), [*keys, frame])


class Frames:
    """Boxes in order as frames and runs: frame ``number``, the rows of a frame lie between ``at``, the frames of a run
    between ``first``. A row that is not ``full`` stands for a frame without boxes."""

    def __init__(self, run: np.ndarray, number: np.ndarray, full: np.ndarray, box: np.ndarray, columns: dict[str, np.ndarray]):
        cuts = lambda *by: np.flatnonzero(np.concatenate([[True], np.any([v[1:] != v[:-1] for v in by], axis=0), [True]]))
        at = cuts(run, number)
        self.first = np.searchsorted(at, cuts(run))
        self.number = number[at[:-1]]
        self.at = np.concatenate([[0], np.cumsum(full)])[at]
        self.box, self.columns = (box, columns) if full.all() else (box[full], {k: v[full] for k, v in columns.items()})

    def boxes(self, k: int) -> Boxes:
        a, b = self.at[k : k + 2]
        return Boxes(self.box[a:b], **{n: v[a:b] for n, v in self.columns.items()})

    def stack(self, frames: np.ndarray) -> Stack:
        n = self.at[frames + 1] - self.at[frames]
        place = self.at[frames][:, None] + np.arange(n.max(initial=0))
        place = np.minimum(place, max(len(self.box) - 1, 0))
        return Stack(self.box[place], n, **{k: v[place] for k, v in self.columns.items()})

    def of_run(self, run: int, begin: int = 0) -> range:
        return range(self.first[run] + begin, self.first[run + 1])


def side_by_side(frames: Frames, runs: np.ndarray, start: Callable[[int], tuple], step_all: Callable, step: Callable, keep: Callable) -> None:
    """Works through the runs, a frame of each at a time: ``step_all(stack, memory) -> (found, memory)`` as long as there are
    ``FEW`` runs, ``step`` on the boxes of a frame for what is left of the longest. A memory is a tuple of stacks and
    arrays by run, ``start`` gives that of new runs; ``keep(frames, found)`` gets what was found."""
    length = np.diff(frames.first)[runs]
    order = np.argsort(-length, kind="stable")
    runs, length = runs[order], length[order]
    for begin in range(0, len(runs), TOGETHER):
        mine, left = runs[begin : begin + TOGETHER], length[begin : begin + TOGETHER]
        memory, k = start(len(mine)), 0
        while (going := int(np.searchsorted(-left, -k))) >= FEW:
            memory = tuple(m.runs(slice(going)) if isinstance(m, Stack) else m[:going] for m in memory)
            now = frames.first[mine[:going]] + k
            found, memory = step_all(frames.stack(now), memory)
            keep(now, found)
            k += 1
        for j in range(going):
            held = tuple(m.one(j) if isinstance(m, Stack) else m[j] for m in memory)
            for n in frames.of_run(mine[j], k):
                found, held = step(frames.boxes(n), held)
                keep(n, found)


def _each_run(boxes: DataFrame, keys: list[str], frame: str, gap: int, work: Callable[[Frames, Callable], None], out: str) -> DataFrame:
    """keys, frame and the columns ``out`` (name kind, ...) of what ``work(frames, keep)`` keeps. Runs that start near each
    other share a group, in which rows are sorted once."""
    names = [c.split()[0] for c in out.split(", ")]
    read = [c for c in ("conf", "box_no", "label", "motion") if c in boxes.columns]

    def some_runs(group: pd.DataFrame) -> pd.DataFrame:
        frames = frames_of(group, frame, gap, read)
        number, found = [], {n: [] for n in names}

        def keep(now, some: Boxes | Stack) -> None:
            if isinstance(some, Stack):
                number.append(np.repeat(frames.number[now], some.n))
                there = some.there
            else:
                number.append(np.full(len(some), frames.number[now]))
                there = slice(None)
            for n in names:
                found[n].append(some[n][there])

        work(frames, keep)
        data = {frame: np.concatenate(number)} | {n: np.concatenate(found[n]) for n in names}
        return pd.DataFrame({k: group[k].iloc[0] for k in keys} | data)

    kinds = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in [*keys, frame])
    rows = dealt(boxes.select(*keys, frame, *SIDES, *read), keys, frame, gap)
    return rows.groupBy(*keys, "_near").applyInPandas(some_runs, f"{kinds}, {out}")


def frames_of(group: pd.DataFrame, frame: str, gap: int, read: list[str]) -> Frames:
    """The frames and runs of some rows of one key."""
    group = group.sort_values([frame, "conf", "box_no"], ascending=[True, False, True], kind="stable")
    number = group[frame].to_numpy()
    run = np.cumsum(np.concatenate([[0], np.diff(number) > gap]))
    full = group["_full"].to_numpy() if "_full" in group else np.ones(len(group), bool)
    return Frames(run, number, full, group[SIDES].to_numpy(float), {n: group[n].to_numpy() for n in read})


def dealt(boxes: DataFrame, keys: list[str], frame: str, gap: int) -> DataFrame:
    """The boxes with ``_near``: the span of ``NEAR`` gaps in which their run starts. Only frames are sorted for it: a span
    has the boxes before its first start dealt to the span of the start before, and its size does not matter else."""
    span = F.floor(F.col(frame) / (max(1, gap) * NEAR)).alias("_span")
    frames = boxes.select(*keys, frame, span).distinct()
    apart = F.col(frame) - F.lag(frame).over(Window.partitionBy(*keys, "_span").orderBy(frame))
    starts = F.when(F.col("_apart") > gap, F.col(frame))
    spans = frames.withColumn("_apart", apart).groupBy(*keys, "_span").agg(F.min(frame).alias("_first"), F.max(frame).alias("_end"), F.min(starts).alias("_inner"))
    order = Window.partitionBy(*keys).orderBy("_span")
    fresh = F.col("_first") - F.lag("_end").over(order) > gap
    spans = spans.withColumn("_start", F.when(F.coalesce(fresh, F.lit(True)), F.col("_first")).otherwise(F.col("_inner"))).drop("_first", "_end", "_inner")
    before = F.last(F.when(F.col("_start").isNotNull(), F.col("_span")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = written(spans.withColumn("_carried", before), "spans")
    mine = F.when(F.col(frame) >= F.col("_start"), F.col("_span")).otherwise(F.col("_carried"))
    return boxes.withColumn("_span", span).join(spans, [*keys, "_span"]).withColumn("_near", mine).drop("_span", "_start", "_carried")


def confirmed_boxes(boxes: DataFrame, keys: list[str], frame: str, gap: int = 1) -> DataFrame:
    """keys, frame, box_no, hits, confirmed."""

    def step(confirmed: Callable, now, held: tuple) -> tuple:
        found, seen = confirmed(now, *held)
        return found, (seen,)

    def work(frames: Frames, keep: Callable) -> None:
        every = np.arange(len(frames.first) - 1)
        side_by_side(frames, every, lambda n: (no_stack(n, **UNSEEN),), partial(step, confirm_all), partial(step, confirm), keep)

    return _each_run(boxes, keys, frame, gap, work, "box_no long, hits int, confirmed boolean")


def no_tracks(runs: int) -> tuple[Stack, np.ndarray]:
    return no_stack(runs, **{k: v for k, v in NO_TRACKS.items() if k not in ("stage", "stale")}), np.ones(runs, np.int64)


def staged(tracks: Boxes) -> Boxes:
    """Tracks of a stack, which hold no stages."""
    return tracks if "stage" in tracks.columns else tracks.given(stage=np.full(len(tracks), np.nan), stale=np.zeros(len(tracks), bool))


def tracks(boxes: DataFrame, keys: list[str], frame: str, gap: int = 1) -> DataFrame:
    """keys, frame, box_no (of the last sighting), track_id (within a run), missed, conf, vx, vy."""

    def step_all(now: Stack, held: tuple) -> tuple:
        found = associate_all(now, *held)
        return found[0], found

    def step(now: Boxes, held: tuple) -> tuple:
        found = associate(now, staged(held[0]), held[1])
        return found[0], found

    def work(frames: Frames, keep: Callable) -> None:
        side_by_side(frames, np.arange(len(frames.first) - 1), no_tracks, step_all, step, keep)

    return _each_run(boxes, keys, frame, gap, work, "box_no long, track_id int, missed int, conf double, vx double, vy double")


def repeated_boxes(boxes: DataFrame, keys: list[str], frame: str, gap: int = 1, **limits) -> DataFrame:
    """keys, frame, box_no, hits, confirmed."""

    def work(frames: Frames, keep: Callable) -> None:
        for run in range(len(frames.first) - 1):
            memory = nothing(**UNSEEN)
            for k in frames.of_run(run):
                found, memory = repeated(frames.boxes(k), memory, **limits)
                keep(k, found)

    return _each_run(boxes, keys, frame, gap, work, "box_no long, hits int, confirmed boolean")


def track_frame(state: tuple, number: int, now: Boxes, gap: int) -> tuple:
    """The state (frame, boxes seen, tracks, next id) after a whole frame whose confirmed boxes are tracked."""
    last, seen, tracks, next_id = state
    if last is None or number - last > gap:
        seen, tracks, next_id = nothing(**UNSEEN), nothing(**NO_TRACKS), 1
    found, seen = confirm(now, seen)
    return (int(number), seen, *associate(found.take(found["confirmed"]), tracks, next_id))


def counts(tracks: Boxes) -> tuple[int, int]:
    """Number of tracks, newest id."""
    return len(tracks), int(tracks["track_id"].max()) if len(tracks) else 0


def confirmed_track_counts(frames: DataFrame, key: str, frame: str, gap: int, load: Callable[[tuple], tuple], save: Callable[[tuple], tuple]) -> DataFrame:
    """key, frame, tracks, newest of whole frames (a list in ``boxes``), worked through as in ``tracks``. Where the key's
    first frame has a state in ``held``, its run goes on from that; of each group's last frame ``held`` is the state."""

    def step_all(now: Stack, held: tuple) -> tuple:
        found, seen = confirm_all(now, held[0])
        found = found.where(found["confirmed"] & found.there)
        after = associate_all(Stack(found.box, found.n, conf=found["conf"], box_no=found["box_no"]), *held[1:])
        return after[0], (seen, *after)

    def step(now: Boxes, held: tuple) -> tuple:
        _, *after = track_frame((0, held[0], staged(held[1]), held[2]), 0, now, 0)
        return after[1], tuple(after)

    def some_runs(group: pd.DataFrame) -> pd.DataFrame:
        given = group["held"].dropna()
        group["_full"] = group[[*SIDES, "conf", "box_no"]].notna().any(axis=1)
        group["box_no"] = group["box_no"].fillna(-1).astype(np.int64)
        frames = frames_of(group, frame, gap, ["conf", "box_no"])
        last = len(frames.first) - 2
        n, newest = np.zeros(len(frames.number), np.int32), np.zeros(len(frames.number), np.int32)

        def keep(now, found: Boxes | Stack) -> None:
            if isinstance(found, Stack):
                n[now], newest[now] = found.n, np.where(found.there, found["track_id"], 0).max(1, initial=0)
            else:
                n[now], newest[now] = counts(found)

        apart = sorted({last} | ({0} if len(given) else set()))
        for run in apart:  # those whose state comes from, or goes to, another batch
            state = load((given.iloc[0] if run == 0 and len(given) else None,))
            for k in frames.of_run(run):
                state = track_frame(state, frames.number[k], frames.boxes(k), gap)
                keep(k, state[2])
        rest = np.setdiff1d(np.arange(last + 1), apart)
        side_by_side(frames, rest, lambda runs: (no_stack(runs, **UNSEEN), *no_tracks(runs)), step_all, step, keep)
        held = [None] * (len(n) - 1) + [save(state)[0]]
        return pd.DataFrame({key: group[key].iloc[0], frame: frames.number, "tracks": n, "newest": newest, "held": held})

    rows = dealt(frames, [key], frame, gap).select(key, "_near", frame, "held", F.inline_outer("boxes"))
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in (key, frame))
    return rows.groupBy(key, "_near").applyInPandas(some_runs, f"{kinds}, tracks int, newest int, held string")
