"""The trackers: runs side by side, spans and micro-batches against loops over frames."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.sources.sinks import shared_path
from tidemark.streaming import jobs as S
from tidemark.streaming import tracking as T
from tidemark.streaming.replay import replay_batches


def some_boxes(seed, frames, most=7):
    r = random.Random(seed)
    for frame in frames:
        for k in range(r.randrange(most)):
            x, y = r.randrange(20) * 5.0, r.randrange(20) * 5.0
            yield frame, k, x, y, x + 4 + r.randrange(50), y + 4 + r.randrange(50), r.choice([0.001, 0.004, 0.01, 0.05, 0.5, 0.9])


def test_runs_side_by_side_agree_with_loops_over_frames():
    r = random.Random(8)
    gone = {f for f in range(4000) if r.random() < 0.03}
    group = pd.DataFrame(some_boxes(7, [f for f in range(4000) if f not in gone]), columns=["frame", "box_no", *T.SIDES, "conf"]).sample(frac=1, random_state=1)
    frames = T.frames_of(group, "frame", 1, ["conf", "box_no"])
    runs, calls, got, want = len(frames.first) - 1, [], {}, {}

    def keep(now, found):
        calls.append(now)
        for j, frame in enumerate(np.atleast_1d(now)):
            b = found.one(j) if isinstance(found, T.Stack) else found
            got[frame] = (b.box.tolist(), [b[c].tolist() for c in ("box_no", "track_id", "missed", "conf", "vx", "vy")])

    def step_all(now, held):
        found, seen = T.confirm_all(now, held[0])
        sure = found.where(found["confirmed"] & found.there)
        after = T.associate_all(T.Stack(sure.box, sure.n, conf=sure["conf"], box_no=sure["box_no"]), *held[1:])
        return after[0], (seen, *after)

    def step(now, held):
        found, seen = T.confirm(now, held[0])
        after = T.associate(found.take(found["confirmed"]), T.staged(held[1]), held[2])
        return after[0], (seen, *after)

    T.side_by_side(frames, np.arange(runs), lambda n: (T.no_stack(n, **T.UNSEEN), *T.no_tracks(n)), step_all, step, keep)
    side = dict(got)
    for run in range(runs):
        held = T.nothing(**T.UNSEEN), T.nothing(**T.NO_TRACKS), 1
        for k in frames.of_run(run):
            found, held = step(frames.boxes(k), held)
            keep(k, found)
            want[k] = got[k]
    assert side == want and len(want) == len(frames.number) > 3000 and runs > 90
    assert len(calls) - len(want) < len(want) / 4  # many frames a step


def test_runs_that_cross_spans_stay_whole(spark, monkeypatch):
    rows = [(cam, *b) for cam in (1, 2) for b in some_boxes(cam, [f for f in range(90) if f % 31 not in (7, 8, 20)])]
    df = spark.createDataFrame(rows, f"cam int, frame long, box_no long, {', '.join(f'{c} double' for c in (*T.SIDES, 'conf'))}").repartition(3)
    whole = sorted(T.tracks(df, ["cam"], "frame", 1).collect())
    monkeypatch.setattr(T, "NEAR", 4)
    assert sorted(T.tracks(df, ["cam"], "frame", 1).collect()) == whole
    groups = T.dealt(df, ["cam"], "frame", 1).groupBy("cam", "_near").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).collect()
    assert len(groups) > 8 and {r.b - r.a for r in groups} > {10}


def test_micro_batches_of_frames_agree_with_a_loop(spark):
    columns = ("x1", "y1", "x2", "y2", "conf", "box_no")
    frames = {(cam, f): [] for cam in (1, 2, 3) for f in range(120) if f % 31 not in (7, 8, 20 + cam)}
    for cam in (1, 2, 3):
        for f, k, *b in some_boxes(cam, [f for c, f in frames if c == cam], 6):
            frames[cam, f].append(dict(zip(columns, (*b, k))))
    given = [(c, f, 0 if f < 40 else 1 if f < 43 else 2, b) for (c, f), b in frames.items() if c != 3 or not 40 <= f < 43]  # the second has no frame of one camera
    want, state = set(), {}
    step = S.track_step(1)
    for c, f, _, b in sorted(given, key=lambda r: r[:2]):
        state[c], made = step(state.get(c, S.track_load((None,))), SimpleNamespace(frame=f, boxes=b))
        want.add((c, *made))
    fields = "x1: double, y1: double, x2: double, y2: double, conf: double, box_no: bigint"
    rows = spark.createDataFrame(given, f"cam long, frame long, part int, boxes array<struct<{fields}>>").repartition(3)
    for batches in (1, 3):
        base = shared_path(spark, "tracks")
        write = S.track_batches(base, "cam", "frame", 1)

        def twice(batch, number):
            write(batch, number)
            write(batch, number)  # as after a failure

        replay_batches(rows.drop("part"), twice) if batches == 1 else replay_batches(rows, twice, F.col("part"), batches)
        found = S.track_counts(rows, base, "cam", "frame").collect()
        assert len(found) == len(given) and {tuple(r) for r in found} == want
    assert any(not b for _, _, _, b in given) and max(w[3] for w in want) > 5
