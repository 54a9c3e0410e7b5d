"""Voting: stages of frames, buckets and places from counted votes. A level wins by its number of votes, then by its
average confidence, then by being higher; without votes the result is (0, 0.0). Ties never depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import floored, identity_key

LEVELS = range(5)


def consensus(votes: DataFrame, keys: list[str], level: str = "level", confidence: str = "confidence") -> DataFrame:
    """keys, stage int, stage_confidence double, votes long: two small aggregations, the first combined map-side."""
    each = votes.groupBy(*keys, F.col(level).alias("_level")).agg(F.count("*").alias("_n"), F.avg(F.coalesce(confidence, F.lit(0.0))).alias("_avg"))
    best = F.max(F.struct("_n", F.round("_avg", 9).alias("_avg"), "_level"))
    return each.groupBy(*keys).agg(best.alias("_best"), F.sum("_n").alias("votes")).select(*keys, F.col("_best._level").cast("int").alias("stage"), F.col("_best._avg").alias("stage_confidence"), "votes")


def consensus_of_counts(counts: list[Column], sums: list[Column]) -> Column:
    """The winning (stage, confidence) of counts and confidence sums by level, as a struct of columns. Averages that
    differ in the last digits of their sums only are equal."""
    tries = [F.struct(c.cast("long").alias("n"), F.when(c > 0, F.round(s / c, 9)).otherwise(0.0).alias("confidence"), F.lit(k).alias("stage")) for k, (c, s) in enumerate(zip(counts, sums))]
    best = F.greatest(*tries)
    none = best["n"] == 0
    return F.struct(F.when(none, 0).otherwise(best["stage"]).alias("stage"), F.when(none, 0.0).otherwise(best["confidence"]).alias("confidence"))


def frame_votes(boxes: DataFrame, keys: list[str], stage: str = "stage", confidence: str = "conf", valid: Column | None = None) -> DataFrame:
    """Votes, averages and the consensus of each frame's valid boxes; frames without a valid vote have a null stage."""
    use = F.col(stage).isNotNull() if valid is None else valid & F.col(stage).isNotNull()
    aggs = []
    for k in LEVELS:
        mine = use & (F.col(stage) == k)
        aggs += [F.count_if(mine).alias(f"votes_lev{k}"), F.sum(F.when(mine, F.col(confidence)).otherwise(0.0)).alias(f"_sum{k}")]
    grouped = boxes.groupBy(*keys).agg(*aggs)
    best = consensus_of_counts([F.col(f"votes_lev{k}") for k in LEVELS], [F.col(f"_sum{k}") for k in LEVELS])
    total = sum((F.col(f"votes_lev{k}") for k in LEVELS), F.lit(0))
    return grouped.withColumn("_best", best).select(
        *keys, *(f"votes_lev{k}" for k in LEVELS), total.alias("total_votes"),
        F.when(total > 0, F.col("_best.stage")).cast("int").alias("stage"), F.when(total > 0, F.round("_best.confidence", 6)).alias("confidence"),
    )


def frame_summary(boxes: DataFrame, keys: list[str], level: str, confidence: str) -> DataFrame:
    best = F.max(F.struct(F.col(level).alias("level"), F.col(confidence).alias("confidence"))).alias("best")
    return boxes.groupBy(*keys).agg(best, F.count("*").alias("boxes")).select(*keys, "best.level", "best.confidence", "boxes")


def vehicle_stage(tires: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """A vehicle's stage: the consensus of its tire boxes; its body class only if it has none; else unclassified."""
    voted = consensus(tires, keys, "stage", "conf").select(*keys, F.col("stage").alias("tire_stage"), F.col("stage_confidence").alias("tire_conf"))
    both = bodies.join(voted, keys, "full_outer")
    source = F.when(F.col("tire_stage").isNotNull(), "tire").when(F.col("body_stage").isNotNull(), "car_body").otherwise("unclassified")
    return both.select(*keys, F.coalesce("tire_stage", "body_stage").cast("int").alias("stage"), F.coalesce("tire_conf", "body_conf").alias("conf"), source.alias("stage_source"))


def history_buckets(events: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """One consensus a bucket, one vote a row: stage, confidence, votes by level, the record source ("mixed" if
    several; unknown sources are legacy) and the id and time of the latest row."""
    rows = events.withColumn("bucket", bucket).withColumn("_source", record_source(F.col("record_source")))
    by = [*keys, "bucket"]
    counted = rows.groupBy(*by).agg(
        *(F.count_if(F.col("level") == k).alias(f"votes_lev{k}") for k in LEVELS), *(F.sum(F.when(F.col("level") == k, F.col("confidence")).otherwise(0.0)).alias(f"_sum{k}") for k in LEVELS),
        F.min("_source").alias("_low"), F.max("_source").alias("_high"), F.max(F.struct("detected_at", "id")).alias("_last"), F.count("*").alias("records"),
    )
    best = consensus_of_counts([F.col(f"votes_lev{k}") for k in LEVELS], [F.col(f"_sum{k}") for k in LEVELS])
    return counted.withColumn("_best", best).select(
        *by, F.col("_best.stage").cast("int").alias("stage"), F.round("_best.confidence", 6).alias("confidence"), "records", *(f"votes_lev{k}" for k in LEVELS),
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("mixed").alias("record_source"), F.col("_last.id").alias("last_id"), F.col("_last.detected_at").alias("last_at"),
    )


def record_source(column: Column) -> Column:
    return F.when(column.isin("background", "foreground"), column).otherwise("legacy")


def source_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    source = record_source(F.col("record_source"))
    return events.groupBy(*keys).agg(*(F.count_if(source == s).alias(s) for s in ("background", "foreground", "legacy")))


def current_stages(events: DataFrame, key: str, as_of: Column, stale_seconds: float = 1200, window_seconds: float = 120, records: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """The present stage of each key from authoritative rows no older than ``stale_seconds``: the newest row's own
    vehicle votes if it has at least two, else one vote for each of the newest rows within ``window_seconds``; and the
    newest row's ``carry`` columns."""
    age = as_of.cast("timestamp").cast("double") - F.col("detected_at").cast("timestamp").cast("double")
    rows = events.where(F.col(key).isNotNull() & ((F.col("level") == 0) | F.col("positive_confirmed")) & (age <= stale_seconds) & (age >= 0)).withColumn("_age", age)
    newest_first = Window.partitionBy(key).orderBy(F.desc("detected_at"), F.desc("id"))
    recent = rows.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= records)
    recent = recent.withColumn("_newest", F.min("_age").over(Window.partitionBy(key))).where(F.col("_age") - F.col("_newest") <= window_seconds)
    frames = consensus(recent, [key])
    newest = recent.where("_rank = 1").select(key, F.col("id").alias("last_id"), F.col("level").alias("last_level"), F.col("confidence").alias("last_confidence"), "vehicles", *carry)
    enough = F.col("vehicles") >= 2
    return frames.join(newest, key).select(key, "last_id", F.when(enough, F.col("last_level")).otherwise(F.col("stage")).cast("int").alias("stage"),
        F.round(F.when(enough, F.col("last_confidence")).otherwise(F.col("stage_confidence")), 6).alias("confidence"), F.when(enough, F.lit(1)).otherwise(F.col("votes")).cast("long").alias("records"), *carry)


def stage_list(events: DataFrame, as_of: Column, stale_seconds: float = 1200, window_seconds: float = 120, limit: int = 5000, test_id: str | None = None, test_name: str = "", least_stage: int = 1, least_confidence: float = 0.7) -> DataFrame:
    """camera_id, camera_name, stage, confidence, origin (id, name or test) of every camera in the newest ``limit`` rows
    that are not stale: by id, then rows that have only a name which no camera by id has. The test camera (by id, or by
    its name without case and signs) is always there once, raised to its floor."""
    age = as_of.cast("timestamp").cast("double") - F.col("detected_at").cast("timestamp").cast("double")
    rows = events.where(age.between(0, stale_seconds)).orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)
    rows = rows.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("camera_id", "camera_name")})
    of = lambda key, other: current_stages(rows, key, as_of, stale_seconds, window_seconds, carry=(other,))
    columns = ["camera_id", "camera_name", "stage", "confidence"]
    by_id = of("camera_id", "camera_name").select(*columns, F.lit("id").alias("origin"))
    legacy = of("camera_name", "camera_id").where("camera_id is null").join(by_id.select("camera_name"), "camera_name", "left_anti")
    found = by_id.unionByName(legacy.select(*columns, F.lit("name").alias("origin")))
    if test_id is None:
        return found
    is_test = F.coalesce(F.col("camera_id") == test_id, F.lit(False)) | F.coalesce(identity_key(F.col("camera_name")) == identity_key(F.lit(test_name)), F.lit(False))
    newest = found.where(is_test).agg(F.min_by(F.struct("stage", "confidence"), F.struct("origin", "camera_id", "camera_name")).alias("t"))
    stage, confidence, _ = floored(F.coalesce("t.stage", F.lit(0)), F.coalesce("t.confidence", F.lit(0.0)), F.lit(True), least_stage, least_confidence)
    test = newest.select(F.lit(test_id).alias("camera_id"), F.lit(test_name).alias("camera_name"), stage.cast("int").alias("stage"), confidence.alias("confidence"), F.lit("test").alias("origin"))
    return found.where(~is_test).unionByName(test)


def stage_sources(boxes: DataFrame, keys: list[str], source: str = "stage_source") -> DataFrame:
    return boxes.groupBy(*keys).agg(F.count_if(F.col(source) == "tire").alias("tire"), F.count_if(F.col(source) == "car_body").alias("car_body"))
