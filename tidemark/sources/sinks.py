"""Rows and files that the engine writes: accepted events, steps, GeoJSON and CSV."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, spark.checkpoint.dir; a temporary one where none is set and all
    tasks run in the driver's process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str = "step") -> DataFrame:
    """The same rows, read from a table in the shared folder: what is used more than once is worked out once, and a lost
    executor costs no more than the step that runs."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def event_rows(frames: DataFrame, least_confidence: float = 0.70, carry: tuple[str, ...] = ()) -> DataFrame:
    """Frames that become events: with a stage, confident enough, and a positive stage only if it was confirmed; the
    rest of the row, but for the columns ``carry``, is composed into JSON details."""
    good = F.col("stage").isNotNull() & (F.col("confidence") >= least_confidence) & ((F.col("stage") == 0) | F.col("accepted"))
    details = F.to_json(F.struct(F.concat(F.lit("Lev"), F.col("stage").cast("string")).alias("level_label"), F.col("total_votes").alias("detections"), F.col("accepted").alias("positive_confirmed"), F.col("reason")))
    return frames.where(good).select("event_id", "camera_id", F.col("stage").alias("level"), "confidence", "at", details.alias("details"), *carry)


def feature(lon: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON point feature."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*(c.alias(n) for n, c in properties.items())).alias("properties"))


def feature_lines(rows: DataFrame, one: Column) -> DataFrame:
    """One feature a line, for layers of any size."""
    return rows.select(F.to_json(one).alias("feature"))


def feature_collection(rows: DataFrame, one: Column, keys: list[str]) -> DataFrame:
    """keys, geojson: a small layer for each key as one collection."""
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list(one)).alias("features"))).alias("geojson"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
