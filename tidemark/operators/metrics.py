"""Scores of detectors, masks and training runs, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.quantiles import exact_quantiles


def latency(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """Median, 95th percentile (exact, linear) and frames per second."""
    speed = rows.groupBy(*keys).agg((1000.0 / F.avg(ms)).alias("fps"))
    return exact_quantiles(rows, keys, ms, {"median_ms": 0.5, "p95_ms": 0.95}).join(speed, keys)


def per_frame(frames: DataFrame, boxes: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """Detections a frame: mean, median and maximum, frames without any included."""
    counts = boxes.groupBy(*keys, frame).agg(F.count("*").alias("n"))
    rows = frames.join(counts, [*keys, frame], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    middle = exact_quantiles(rows, keys, "n", {"median": 0.5})
    return rows.groupBy(*keys).agg(F.avg("n").alias("mean"), F.max("n").cast("long").alias("most")).join(middle, keys).select(*keys, "mean", "median", "most")


def mask_scores(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Global IoU, precision and recall from summed pixels, and means over images."""
    union = F.col("gt") + F.col("pred") - F.col("inter")
    image_iou = F.when(union > 0, F.col("inter") / union).otherwise(1.0)
    dice = F.when(F.col("gt") + F.col("pred") > 0, 2 * F.col("inter") / (F.col("gt") + F.col("pred"))).otherwise(1.0)
    i, g, p = F.sum("inter"), F.sum("gt"), F.sum("pred")
    return masks.groupBy(*keys).agg((i / (g + p - i)).alias("iou"), F.avg(image_iou).alias("mean_iou"), F.avg(dice).alias("mean_dice"), (i / p).alias("precision"), (i / g).alias("recall"))


def best_threshold(scored: DataFrame, threshold: str = "conf") -> DataFrame:
    """The threshold of the best IoU on the validation split (lowest among equals), and its scores on the test one."""
    best = scored.where("split = 'valid'").agg(F.max(F.struct("iou", (-F.col(threshold)).alias("t"))).alias("b")).select((-F.col("b.t")).alias(threshold), F.col("b.iou").alias("valid_iou"))
    return best.join(scored.where("split = 'test'").select(threshold, F.col("iou").alias("test_iou"), "precision", "recall"), threshold, "left")


def level_consistency(rows: DataFrame, level: str, value: str) -> DataFrame:
    """level, n, mean, std, and whether the means never fall from level to level (at most a handful of levels)."""
    stats = rows.groupBy(level).agg(F.count("*").alias("n"), F.round(F.avg(value), 9).alias("mean"), F.round(F.stddev_pop(value), 9).alias("std"))
    steps = stats.withColumn("_up", F.coalesce(F.col("mean") >= F.lag("mean").over(Window.orderBy(level)), F.lit(True)))
    return stats.withColumn("non_decreasing", steps.agg(F.bool_and("_up")).scalar())


def ratio_summary(rows: DataFrame, keys: list[str], ratio: str, ms: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(ratio).alias("mean"), F.min(ratio).alias("least"), F.max(ratio).alias("most"), F.count_if(F.col(ratio) == 0).alias("zeros"), (1000.0 / F.avg(ms)).alias("fps"))


def class_weights(rows: DataFrame, cls: str) -> DataFrame:
    """total / (classes * count) of each class."""
    counts = rows.groupBy(cls).agg(F.count("*").alias("n"))
    total, k = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.select(cls, "n", (total / (k * F.col("n"))).alias("weight"))


def training_log(log: DataFrame, run: str, epoch: str, score: str, patience: int = 5, least_gain: float = 1e-4) -> DataFrame:
    """Each run's best epoch and score, and the epoch at which it would have stopped: the first that lies ``patience``
    epochs after the last gain of at least ``least_gain`` over the best before."""
    before = F.max(score).over(Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("_gain", before.isNull() | (F.col(score) > before + least_gain))
    last = F.last(F.when(F.col("_gain"), F.col(epoch)), ignorenulls=True).over(Window.partitionBy(run).orderBy(epoch))
    rows = rows.withColumn("_idle", F.col(epoch) - last)
    best = F.max(F.struct(score, (-F.col(epoch)).alias("e"))).alias("b")
    return rows.groupBy(run).agg(best, F.min(F.when(F.col("_idle") >= patience, F.col(epoch))).alias("stop_epoch")).select(run, (-F.col("b.e")).alias("best_epoch"), F.col(f"b.{score}").alias("best_score"), "stop_epoch")


def errors(rows: DataFrame, keys: list[str], measured: str, true: str) -> DataFrame:
    gap = F.abs(F.col(measured) - F.col(true))
    return rows.groupBy(*keys).agg(F.avg(gap).alias("mae"), F.max(gap).alias("most"))


def class_distribution(rows: DataFrame, split: str, cls: str) -> DataFrame:
    return rows.groupBy(split, cls).agg(F.count("*").alias("n"))


def summary(speed: DataFrame, quality: DataFrame, covered: DataFrame, on: str) -> DataFrame:
    return speed.join(quality, on, "left").join(covered, on, "left")
