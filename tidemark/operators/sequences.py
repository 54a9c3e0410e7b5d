"""Operators along time: changes, runs, gates, folds and carries. Orders are total (time, then id).

Where a rule depends on what it decided before, no task gathers a key's rows: cooldowns compose the function from a row
to the next one taken (``spacing``); smoothing looks back over as many rows as still count in a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.spacing import spaced


def changes_only(events: DataFrame, key: str = "camera_id", level: str = "level", least: int = 0, time: str = "detected_at", tie: str = "id") -> DataFrame:
    """Rows whose level differs from the older row's of the key (the oldest counts); the floor applies afterwards."""
    older = F.lag(level).over(Window.partitionBy(key).orderBy(time, tie))
    rows = events.where(F.coalesce(F.trim(key), F.lit("")) != "").withColumn("_older", older)
    return rows.where((F.col("_older").isNull() | (F.col("_older") != F.col(level))) & (F.col(level) >= least)).drop("_older")


def newest(events: DataFrame, n: int, time: str = "detected_at", tie: str = "id") -> DataFrame:
    return events.orderBy(F.desc(time), F.desc(tie)).limit(n)


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def every_nth(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") % n == 0).drop("_rank")


def rain_steps(rows: DataFrame, key: str = "station", accumulated: str = "rain_day_mm", time: str = "observed_at", tie: str = "id") -> DataFrame:
    """Rain since the previous valid reading of a daily accumulator: its growth, or the reading itself on a new day or
    after a decrease; the first is 0 and a missing reading gives null and is no predecessor."""
    rows = rows.withColumn("_value", F.when(F.col(accumulated) >= 0, F.col(accumulated)))
    back = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("_value").isNotNull(), F.struct(F.col("_value").alias("v"), F.to_date(time).alias("d"))), ignorenulls=True).over(back)
    rows = rows.withColumn("_before", before)
    fresh = (F.col("_before.d") != F.to_date(time)) | (F.col("_value") < F.col("_before.v"))
    step = F.when(F.col("_value").isNull(), None).when(F.col("_before").isNull(), 0.0).when(fresh, F.col("_value")).otherwise(F.col("_value") - F.col("_before.v"))
    return rows.withColumn("rain_step_mm", step).drop("_value", "_before")


def rain_last_hour(rows: DataFrame, key: str = "station", step: str = "rain_step_mm", micros: str = "us", given: str | None = None) -> DataFrame:
    """Sum of the steps strictly newer than 60 minutes before the row; a given value of at least 0 wins."""
    hour = Window.partitionBy(key).orderBy(micros).rangeBetween(-3_600_000_000 + 1, 0)
    total = F.coalesce(F.sum(step).over(hour), F.lit(0.0))
    return rows.withColumn("rain_60m_mm", total if given is None else F.when(F.col(given) >= 0, F.col(given)).otherwise(total))


def carried(rows: DataFrame, value: str, key: str, micros: str, tie: str, minutes: float = 90) -> DataFrame:
    """The value, else the last one of the key that is at most ``minutes`` old (inclusive)."""
    back = Window.partitionBy(key).orderBy(micros, tie).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(micros).alias("t"))), ignorenulls=True).over(back)
    rows = rows.withColumn("_last", last)
    return rows.withColumn(f"{value}_carried", F.when(F.col(micros) - F.col("_last.t") <= int(minutes * 60_000_000), F.col("_last.v"))).drop("_last")


def gate(frames: DataFrame, key: str = "camera_id", micros: str = "t_us", tie: str = "event_id", hits: int = 5, seconds: float = 3.0, vehicles: int = 2, ratio: float = 0.75, gap_seconds: float = 10.0, confidence: float = 0.70, trusted: Column | None = None) -> DataFrame:
    """Confirmation of flood stages: hits int, accepted and pending boolean, reason string.

    A positive stage is accepted once a run of qualifying frames of that stage, without a gap over ``gap_seconds`` or
    any other frame between, has enough hits over enough seconds. Every early verdict ends the run."""
    trusted = F.lit(False) if trusted is None else trusted
    agree = (F.col("positive_votes") >= vehicles) & (F.col("total_votes") > 0) & (F.col("positive_votes") / F.col("total_votes") >= ratio)
    early = F.when(F.col("stage").isNull(), "no_stage").when(F.coalesce("confidence", F.lit(0.0)) < confidence, "below_minimum_confidence").when(F.col("stage") == 0, "normal_immediate").when(trusted, "trusted_flood_test").when(~agree, "insufficient_positive_vehicle_agreement")
    order = Window.partitionBy(key).orderBy(micros, tie)
    rows = frames.withColumn("_early", early)
    before = F.lag(F.struct("_early", F.col("stage").alias("_s"), F.col(micros).alias("_t"))).over(order)
    rows = rows.withColumn("_before", before)
    starts = F.col("_early").isNotNull() | F.col("_before").isNull() | F.col("_before._early").isNotNull() | (F.col("_before._s") != F.col("stage")) | (F.col(micros) - F.col("_before._t") > int(gap_seconds * 1e6))
    rows = rows.withColumn("_run", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    run = Window.partitionBy(key, "_run")
    rows = rows.withColumn("_hits", F.row_number().over(run.orderBy(micros, tie))).withColumn("_lasts", F.col(micros) - F.min(micros).over(run))
    confirmed = (F.col("_hits") >= hits) & (F.col("_lasts") >= int(seconds * 1e6))
    immediate = F.col("_early").isin("normal_immediate", "trusted_flood_test")
    return rows.select(
        *frames.columns,
        F.when(F.col("_early").isNull(), F.col("_hits")).when(immediate, 1).otherwise(0).cast("int").alias("hits"),
        F.when(F.col("_early").isNull(), confirmed).otherwise(immediate).alias("accepted"),
        (F.col("_early").isNull() & ~confirmed).alias("pending"),
        F.coalesce("_early", F.when(confirmed, "confirmed").otherwise("awaiting_repeated_confirmation")).alias("reason"),
    )


def save_cooldown(rows: DataFrame, keys: list[str], micros: str = "us", tie: str = "id", level: str = "level", seconds: float = 10.0) -> DataFrame:
    """keys, ids of the rows saved: a row of the same level within ``seconds`` of the last *saved* row is dropped."""
    return spaced(rows, keys, micros, tie, int(seconds * 1e6), level).drop(micros)


def alerts(rows: DataFrame, keys: list[str], micros: str = "t_us", tie: str = "event_id", level: str = "stage", frames: int = 5, least: int = 2, seconds: float = 30.0) -> DataFrame:
    """keys, ids that raise an alert: the last ``frames`` levels all reach ``least`` and the last alert is over
    ``seconds`` old; the first is always allowed."""
    span = Window.partitionBy(*keys).orderBy(micros, tie).rowsBetween(1 - frames, 0)
    full = rows.withColumn("_low", F.min(level).over(span)).withColumn("_n", F.count(level).over(span)).where((F.col("_n") == frames) & (F.col("_low") >= least))
    return spaced(full, keys, micros, tie, int(seconds * 1e6)).drop(micros)


def stage_ema(votes: DataFrame, key: str, micros: str, tie: str, shares: str = "shares", alpha: float = 0.35, reset_seconds: float = 8.0, look_back: int = 96) -> DataFrame:
    """key, tie, ema_stage int, ema_confidence double: exponential smoothing of vote shares (array of 5), started
    afresh after a silence; the lowest level wins ties. What lies more than ``look_back`` rows back weighs less than
    1e-17 and is left out, so no row holds more than that."""
    order = Window.partitionBy(key).orderBy(micros, tie)
    fresh = F.coalesce(F.col(micros) - F.lag(micros).over(order) > int(reset_seconds * 1e6), F.lit(True))
    rows = votes.withColumn("_fresh", fresh).withColumn("_run", F.sum(F.when(F.col("_fresh"), 1).otherwise(0)).over(order))
    recent = F.collect_list(shares).over(Window.partitionBy(key, "_run").orderBy(micros, tie).rowsBetween(1 - look_back, 0))
    p = F.aggregate(F.slice("_recent", 2, look_back), F.col("_recent")[0], lambda s, x: F.zip_with(x, s, lambda a, b: a * alpha + b * (1 - alpha)))
    rows = rows.withColumn("_recent", recent).withColumn("_p", p).withColumn("_top", F.array_max("_p"))
    return rows.select(key, tie, (F.array_position("_p", F.col("_top")) - 1).cast("int").alias("ema_stage"), F.round("_top", 6).alias("ema_confidence"))


def sampled(rows: DataFrame, keys: list[str], micros: str = "us", tie: str = "id", level: str = "level", seconds: float = 8.0, keep: int = 720) -> DataFrame:
    """keys, ids of live samples: a row is taken at a level change or ``seconds`` after the last taken one; the newest
    ``keep`` stay."""
    taken = spaced(rows, keys, micros, tie, int(seconds * 1e6), level)
    return top_per_key(taken, keys, [F.desc(micros), F.desc(tie)], keep).drop(micros)


def merged_history(stored: DataFrame, live: DataFrame, keys: list[str], start_us: int, end_us: int, micros: str = "us", tie: str = "id", level: str = "level", within_seconds: float = 1.0) -> DataFrame:
    """keys, micros, tie, level, live: stored and live points of a range in order of time (stored before live at equal
    times); a point is left out if the one before it has its level and is at most ``within_seconds`` older."""
    columns = [*keys, micros, tie, level]
    both = stored.select(*columns, F.lit(False).alias("live")).unionByName(live.select(*columns, F.lit(True).alias("live")))
    rows = both.where(F.col(micros).between(start_us, end_us))
    before = F.lag(F.struct(F.col(micros).alias("t"), F.col(level).alias("l"))).over(Window.partitionBy(*keys).orderBy(micros, "live", tie))
    near = (F.col(micros) - F.col("_before.t") <= int(within_seconds * 1e6)) & F.col("_before.l").eqNullSafe(F.col(level))
    return rows.withColumn("_before", before).where(~F.coalesce(near, F.lit(False))).drop("_before")


def combined_history(points: DataFrame, live: DataFrame, keys: list[str], start_us: int, end_us: int, values: list[str], micros: str = "us", tie: str = "id", level: str = "level") -> DataFrame:
    """keys, micros, level, values, live: one point a time. Live points carry the values of the key's newest stored
    point; at equal times a later point's fields stand over an earlier one's where it has them, live over stored."""
    last = points.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(micros, tie)).alias("_last"))
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    carried = live.alias("l").join(last.alias("p"), match, "left").select(*(F.col(f"l.{c}").alias(c) for c in [*keys, micros, tie, level]), *(F.col(f"_last.{v}").alias(v) for v in values), F.lit(True).alias("live"))
    both = points.select(*keys, micros, tie, level, *values, F.lit(False).alias("live")).unionByName(carried)
    order = F.struct(F.col("live").cast("int"), F.col(tie))
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in [level, *values]]
    return both.where(F.col(micros).between(start_us, end_us)).groupBy(*keys, micros).agg(*newest, F.max("live").alias("live"))


def velocity(tracks: DataFrame, keys: list[str], micros: str, tie: str, x: str, y: str, gain: float = 0.65, look_back: int = 40) -> DataFrame:
    """keys, tie, vx, vy: 0.65 of the last move plus 0.35 of the velocity before; a track starts at rest. Moves more
    than ``look_back`` rows back weigh less than 1e-17 and are left out."""
    order = Window.partitionBy(*keys).orderBy(micros, tie)
    rows = tracks.withColumns({f"_d{a}": F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0)) for a, c in (("x", x), ("y", y))})
    moves = F.collect_list(F.struct("_dx", "_dy")).over(order.rowsBetween(1 - look_back, 0))
    fold = lambda a: F.round(F.aggregate("_moves", F.lit(0.0), lambda v, m: m[f"_d{a}"] * gain + v * (1 - gain)), 9)
    return rows.withColumn("_moves", moves).select(*keys, tie, fold("x").alias("vx"), fold("y").alias("vy"))


def failure_runs(attempts: DataFrame, key: str, time: str, tie: str, ok: str) -> DataFrame:
    """key, failures (consecutive, up to the newest attempt), last_success and last_attempt."""
    last = attempts.groupBy(key).agg(F.max(F.when(F.col(ok), F.struct(time, tie))).alias("_ok"), F.max(time).alias("last_attempt"))
    later = attempts.join(last, key).where(~F.col(ok) & (F.col("_ok").isNull() | (F.struct(time, tie) > F.col("_ok"))))
    counts = later.groupBy(key).agg(F.count("*").alias("failures"))
    return last.join(counts, key, "left").select(key, F.coalesce("failures", F.lit(0).cast("long")).alias("failures"), F.col(f"_ok.{time}").alias("last_success"), "last_attempt")


def running_median(rows: DataFrame, key: str, order: list[str], value: str, size: int = 7) -> DataFrame:
    """Rows with a value, and the median of the last ``size`` of them."""
    span = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    return rows.where(F.col(value).isNotNull()).withColumn("median", F.expr(f"percentile({value}, 0.5)").over(span))


def timeline(series: DataFrame, time: str, name: str, value: str, names: list[str], keys: list[str] = (), chunk: int | None = None) -> DataFrame:
    """One row at every time of any series with all series held forward from their last value before or at it.

    With ``chunk`` (a span of time), spans are filled apart and start from the last values of the spans before, one row
    a span; so a single long timeline is not one task."""
    wide = series.groupBy(*keys, time).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))
    back = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    held = lambda by, at: {n: F.last(n, ignorenulls=True).over(back(by, at)) for n in names}
    if chunk is None:
        return wide.select(*keys, time, *(c.alias(n) for n, c in held(keys, time).items()))
    wide = wide.withColumn("_span", F.floor(F.col(time) / chunk))
    last = wide.groupBy(*keys, "_span").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col(time))).alias(n) for n in names))
    before = last.withColumns({f"_{n}": F.last(n, ignorenulls=True).over(back(keys, "_span").rowsBetween(Window.unboundedPreceding, -1)) for n in names}).drop(*names)
    rows = wide.withColumns(held([*keys, "_span"], time)).join(before, [*keys, "_span"])
    return rows.select(*keys, time, *(F.coalesce(n, f"_{n}").alias(n) for n in names))


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], chunk: Column, number: str = "number") -> DataFrame:
    """Rows with their number from 1 in the order within keys. Rows of a chunk are numbered apart (a chunk is a value
    that never falls along the order) and begin after those of the chunks before, whose counts are one row a chunk."""
    rows = rows.withColumn("_chunk", chunk)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_chunk", F.coalesce(before, F.lit(0).cast("long")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return rows.withColumn("_own", own).join(offsets, [*keys, "_chunk"]).withColumn(number, F.col("_own") + F.col("_before")).drop("_chunk", "_own", "_before")


def edge_carry(points: DataFrame, prior: DataFrame, key: str, start_us: int, end_us: int, age_seconds: float = 1200) -> DataFrame:
    """key, us, level, carried: the points, a copy of the prior stage at the range's start and of the last stage at its
    end, where these are no older than ``age_seconds``."""
    own = points.select(key, "us", "level", F.lit(False).alias("carried"))
    oldest = int(age_seconds * 1e6)
    first = prior.where((F.col("us") < start_us) & (start_us - F.col("us") <= oldest)).groupBy(key).agg(F.max_by("level", F.struct("us", "id")).alias("level"))
    last = points.where(end_us - F.col("us") <= oldest).groupBy(key).agg(F.max_by("level", F.struct("us", "id")).alias("level"), F.max("us").alias("at")).where(F.col("at") < end_us)
    edges = first.select(key, F.lit(start_us).cast("long").alias("us"), "level", F.lit(True).alias("carried")).unionByName(last.select(key, F.lit(end_us).cast("long").alias("us"), "level", F.lit(True).alias("carried")))
    return own.unionByName(edges)
