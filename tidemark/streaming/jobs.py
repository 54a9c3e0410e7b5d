"""Structured Streaming jobs. Rows later than the watermark are dropped (the batch twins see all rows). Windows and
sessions use Spark's own state; rules that depend on what they decided before are in ``ordered``, the tracker keeps a
small state for each camera from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.sinks import written
from tidemark.sources.store import exists


def bucket_votes(stream: DataFrame, key: str, time: str, width: str, level: str = "level", confidence: str = "confidence", watermark: str = "30 seconds") -> DataFrame:
    """key, start, votes and confidence sums by level of tumbling windows; the consensus is columns of these."""
    aggs = [F.count_if(F.col(level) == k).alias(f"votes_lev{k}") for k in range(5)] + [F.sum(F.when(F.col(level) == k, F.col(confidence)).otherwise(0.0)).alias(f"sum{k}") for k in range(5)]
    rows = stream.withWatermark(time, watermark).groupBy(key, F.window(time, width)).agg(*aggs)
    tries = [F.struct(F.col(f"votes_lev{k}").alias("n"), F.round(F.col(f"sum{k}") / F.greatest(F.col(f"votes_lev{k}"), F.lit(1)), 9).alias("confidence"), F.lit(k).alias("stage")) for k in range(5)]
    best = F.greatest(*tries)
    return rows.select(key, F.col("window.start").alias("start"), best["stage"].alias("stage"), best["confidence"].alias("stage_confidence"), sum((F.col(f"votes_lev{k}") for k in range(5)), F.lit(0)).alias("votes"))


def last_of_bucket(stream: DataFrame, key: str, time: str, width: str, value: str, watermark: str = "30 seconds") -> DataFrame:
    rows = stream.withWatermark(time, watermark).groupBy(key, F.window(time, width)).agg(F.max(F.struct(time, value)).alias("l"))
    return rows.select(key, F.col("window.start").alias("start"), F.col(f"l.{value}").alias(value))


def sliding_sum(stream: DataFrame, key: str, time: str, value: str, width: str = "60 minutes", slide: str = "1 minute", watermark: str = "1 minute") -> DataFrame:
    rows = stream.withWatermark(time, watermark).groupBy(key, F.window(time, width, slide)).agg(F.sum(value).alias("total"))
    return rows.select(key, F.col("window.end").alias("end"), "total")


def episodes(stream: DataFrame, key: str, time: str, level: str, gap: str = "10 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Runs of flooded rows (level 1 and more) without a gap: key, start, end, rows, most."""
    rows = stream.where(F.col(level) >= 1).withWatermark(time, watermark).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("rows"), F.max(level).alias("most"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "most")


def first_within(stream: DataFrame, keys: list[str], time: str, watermark: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def ordered_state(stream: DataFrame, key: str, order: list[str], start: tuple, step: Callable[[tuple, object], tuple[tuple, tuple | None]], output: str, state: str, time: str | None = None, silence: str = "10 seconds", load: Callable[[tuple], tuple] = tuple, save: Callable[[tuple], tuple] = tuple) -> DataFrame:
    """Runs ``step(state, row) -> (state, output row or None)`` over each key's rows, a batch's rows in order.

    output and state are schemas; output starts with the key's column. A step may hold its state in a form of its own,
    which ``load`` makes from the stored one at the start of a batch and ``save`` stores at its end. Files arrive in time order for an exact match
    with the batch twin. With an event time, a key's state ends once the watermark is ``silence`` past its newest row,
    by which time the rule has forgotten it, so state does not grow with every key ever seen."""
    names = [c.split()[0] for c in output.split(", ")]

    wait = int(pd.Timedelta(silence).total_seconds() * 1000)

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = tuple(None if v is None or v != v else v for v in held.get) if held.exists else start
        now = load(now)
        out = []
        rows = pd.concat(list(frames)).sort_values(order)
        for row in rows.itertuples():
            now, made = step(now, row)
            if made is not None:
                out.append((*k, *made))
        held.update(save(now))
        if time is not None:
            held.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=names)

    if time is None:
        return stream.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)
    return stream.withWatermark(time, "0 seconds").groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def track_step(gap: int = 1) -> Callable:
    """Tracks of the confirmed boxes of whole frames (a list in ``boxes``). State: frame, boxes seen, tracks, next id;
    ``track_load`` and ``track_save`` turn it from and into JSON."""
    import numpy as np

    from tidemark.streaming import tracking as T

    sides = [*T.SIDES, "conf", "box_no"]

    def step(state: tuple, r) -> tuple[tuple, tuple]:
        rows = np.array([[b[c] for c in sides] for b in r.boxes], float).reshape(-1, len(sides))
        rows = rows[np.lexsort((rows[:, 5], -rows[:, 4]))]
        state = T.track_frame(state, r.frame, T.Boxes(rows[:, :4], conf=rows[:, 4], box_no=rows[:, 5].astype(np.int64)), gap)
        return state, (state[0], *T.counts(state[2]))

    return step


def track_load(state: tuple) -> tuple:
    import json

    import numpy as np

    from tidemark.streaming import tracking as T

    if not state[0]:
        return None, None, None, 1
    held = json.loads(state[0])
    boxes = lambda name, kinds: T.Boxes(held[name]["box"], **{k: np.array(held[name][k], kind) for k, kind in kinds.items()})
    return held["frame"], boxes("seen", T.UNSEEN), boxes("tracks", T.NO_TRACKS), held["next"]


def track_save(state: tuple) -> tuple:
    import json

    import numpy as np

    frame, seen, tracks, next_id = state
    return (json.dumps({"frame": frame, "seen": seen.given(label=np.full(len(seen), "")).plain(), "tracks": tracks.plain(), "next": int(next_id)}),)


def track_batches(base: str, key: str, frame: str, gap: int = 1) -> Callable[[DataFrame, int], None]:
    """Writes, for each micro-batch of whole frames (a list in ``boxes``), what ``track_step`` gives of them under ``base``.
    The runs of a camera's frames are worked through apart; each camera's state after a batch is a row of a table, from
    which the next batch goes on. A batch that is run again replaces what it had written. Read by ``track_counts``."""
    from tidemark.streaming import tracking as T

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = f"{base}/held/batch={number - 1}"
        before = spark.read.parquet(earlier) if exists(spark, earlier) else None
        frames = batch.select(key, frame, "boxes")
        if before is None:
            frames = frames.withColumn("held", F.lit(None).cast("string"))
        else:
            first = frames.groupBy(key).agg(F.min(frame).alias(frame)).join(before, key).where(F.col(frame) - F.col("last") <= gap)
            frames = frames.join(written(first.select(key, frame, "held"), "held"), [key, frame], "left")
        path = f"{base}/steps/batch={number}"
        T.confirmed_track_counts(frames, key, frame, gap, track_load, track_save).write.mode("overwrite").parquet(path)
        steps = spark.read.parquet(path)
        now = steps.where("held is not null").groupBy(key).agg(F.max_by("held", frame).alias("held"), F.max(frame).alias("last"))
        if before is not None:
            now = now.unionByName(before.join(now, key, "left_anti"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{base}/held/batch={number}")

    return write


def track_counts(rows: DataFrame, base: str, key: str, frame: str) -> DataFrame:
    """key, frame, tracks, newest of the batches of ``rows`` that were written under ``base``."""
    like = rows.select(key, frame, F.lit(0).alias("tracks"), F.lit(0).alias("newest")).limit(0)
    spark, path = rows.sparkSession, f"{base}/steps"
    return spark.read.schema(like.schema).parquet(path).select(*like.columns) if exists(spark, path) else like
