"""Sensor observations: unified schema, duplicates, upserts, retention, buckets and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unified(rain: DataFrame, sewer: DataFrame, river: DataFrame) -> DataFrame:
    """One schema for the three kinds; rain is never below 0 and missing ids and names get defaults."""
    parts = []
    for name, unit, frame in (("rain", "mm", rain), ("sewer", "m", sewer), ("river", "m", river)):
        value = F.greatest(F.lit(0.0), F.col("value")) if name == "rain" else F.col("value")
        parts.append(frame.select(F.lit(name).alias("sensor_type"), F.coalesce("sensor_id", F.lit(f"{name}-default")).alias("sensor_id"), F.coalesce("sensor_name", "sensor_id", F.lit(name)).alias("sensor_name"), value.alias("value"), F.lit(unit).alias("unit"), "lat", "lon", "us", "id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


KEY = ["sensor_type", "sensor_id", "second"]


def first_of_duplicates(batch: DataFrame, order: str = "id") -> DataFrame:
    """The first row of each sensor and second."""
    rows = batch.withColumn("second", F.expr("us div 1000000"))
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(order))).where("_rank = 1").drop("_rank")


def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch that the store does not have yet; existing rows win."""
    return first_of_duplicates(batch).join(stored.withColumn("second", F.expr("us div 1000000")).select(*KEY), KEY, "left_anti")


def expired(stored: DataFrame, before_us: int, most: int = 5000) -> DataFrame:
    """Rows that a retention pass removes: the oldest ids first, at most ``most``."""
    return stored.where(F.col("us") < before_us).orderBy("id").limit(most)


def retained(stored: DataFrame, before_us: int, most: int = 5000) -> DataFrame:
    """What a retention pass leaves of the store; a caller writes it as the store's next version."""
    return stored.join(expired(stored, before_us, most).select("id"), "id", "left_anti")


def last_per_bucket(readings: DataFrame, minutes: int) -> DataFrame:
    """The last reading of each sensor and bucket (ties: later id)."""
    width = minutes * 60_000_000
    rows = readings.withColumn("bucket_us", F.expr(f"us div {width} * {width}"))
    return rows.groupBy("sensor_type", "sensor_id", "bucket_us").agg(F.max(F.struct("us", "id", "value")).alias("_l")).select("sensor_type", "sensor_id", "bucket_us", F.col("_l.value").alias("value"), F.col("_l.id").alias("id"))


def newest_per_station(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row per station by its time as text; ties go to the later row."""
    return rows.groupBy(key).agg(F.max(F.struct(time, tie, "value")).alias("_l")).select(key, F.col(f"_l.{time}").alias(time), F.col("_l.value").alias("value"))


def ingest_report(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """sensor_type, received, stored, duplicates."""
    fresh = new_rows(batch, stored).groupBy("sensor_type").agg(F.count("*").alias("stored"))
    counts = batch.groupBy("sensor_type").agg(F.count("*").alias("received")).join(fresh, "sensor_type", "left")
    stored_n = F.coalesce("stored", F.lit(0).cast("long"))
    return counts.select("sensor_type", "received", stored_n.alias("stored"), (F.col("received") - stored_n).alias("duplicates"))


def cycle_rollup(attempts: DataFrame, cycle: str, ok: str, saved: str, time: str, tie: str, last: int = 20) -> DataFrame:
    """Counts and the newest errors of each scan cycle."""
    newest = F.row_number().over(Window.partitionBy(cycle).orderBy(F.desc(time), F.desc(tie)))
    errors = attempts.where(~F.col(ok)).withColumn("_rank", newest).where(F.col("_rank") <= last).groupBy(cycle).agg(F.array_sort(F.collect_list(F.struct(time, tie))).alias("_e"))
    rows = attempts.groupBy(cycle).agg(F.count("*").alias("processed"), F.count_if(ok).alias("success"), F.count_if(~F.col(ok)).alias("failed"), F.count_if(F.col(ok) & F.col(saved)).alias("stored"), F.max(time).alias("last_time"))
    text = F.coalesce(F.array_join(F.transform("_e", lambda e: e[tie].cast("string")), ","), F.lit(""))
    return rows.join(errors, cycle, "left").select(cycle, "processed", "success", "failed", "stored", "last_time", text.alias("last_errors"))


def rain_grid_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    valid = F.col("rain_mm") >= 0
    return points.groupBy(*keys).agg(F.max(F.when(valid, F.col("rain_mm"))).alias("max_rain_mm"), F.max(F.when(valid, F.col("us"))).alias("latest_us"), F.count_if(valid).alias("valid_points"), F.count("*").alias("total_points"), F.coalesce(F.bool_or(~valid | F.col("rain_mm").isNull()), F.lit(False)).alias("partial"))


def overlay(history: DataFrame, fresh: DataFrame, keys: list[str], time: str, most: int = 180) -> DataFrame:
    """Rows by key and time where fresh ones replace history; the newest ``most`` of each key."""
    rows = history.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, time).orderBy(F.desc("_p"), F.desc("id")))).where("_rank = 1")
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))).where(F.col("_rank") <= most).drop("_rank", "_p")


def stale(readings: DataFrame, keys: list[str], as_of_us: int, seconds: float) -> DataFrame:
    """Each key's age in seconds at a time and whether it is stale."""
    age = (F.lit(as_of_us) - F.max("us")) / 1e6
    return readings.where(F.col("us") <= as_of_us).groupBy(*keys).agg(age.alias("age_s")).withColumn("stale", F.col("age_s") > seconds)


def latest_issue(candidates: DataFrame, available: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest candidate base time that is available."""
    return candidates.join(available, [*keys, time], "left_semi").groupBy(*keys).agg(F.max(time).alias(time))


def forecast_rows(rows: DataFrame, keys: list[str], time: str, category: str, value: str, since_us: int, most: int = 6) -> DataFrame:
    """Forecast times as rows with rain_mm (0 by default) and kind ("none" by default), not older than 15 minutes
    before a time, the first ``most``."""
    wide = rows.where(F.col(time) >= since_us - 900_000_000).groupBy(*keys, time).agg(F.max(F.when(F.col(category) == "RN1", F.col(value))).alias("rain_mm"), F.max(F.when(F.col(category) == "PTY", F.col(value).cast("int").cast("string"))).alias("kind"))
    wide = wide.select(*keys, time, F.coalesce("rain_mm", F.lit(0.0)).alias("rain_mm"), F.coalesce("kind", F.lit("none")).alias("kind"))
    return wide.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(time))).where(F.col("_rank") <= most).drop("_rank")


def nowcast_wide(rows: DataFrame, keys: list[str], category: str, value: str, categories: tuple[str, ...] = ("RN1", "T1H", "REH", "WSD", "PTY")) -> DataFrame:
    return rows.groupBy(*keys).pivot(category, list(categories)).agg(F.max(value))


def catalog_report(cameras: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of a catalog against the events' cameras."""
    seen = events.select(F.col("camera_id").alias("id")).distinct().withColumn("_e", F.lit(1))
    both = cameras.select("id", "lat").withColumn("_c", F.lit(1)).join(seen, "id", "full_outer")
    return both.agg(F.count("_c").alias("cameras"), F.count("lat").alias("located"), F.count("_e").alias("cameras_in_events"), F.count_if(F.col("_c").isNull()).alias("unknown_in_events"), F.count_if(F.col("_e").isNull()).alias("without_events"))
