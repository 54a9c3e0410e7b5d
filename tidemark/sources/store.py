"""A store of rows by date: appended in batches, scanned by date, expired by whole dates.

A batch is the folder ``date=.../batch=...`` of its dates. Spark puts such folders in place when the write is whole, so
a batch that is run again replaces what it had written, and one that died has left nothing. Keys hold the row's time, so
a row's duplicates lie in the date folders of the batch: an append reads no others, however old the store is.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import written

LAYOUT = ("date", "batch")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store's rows with date and batch; none where there is no store yet."""
    schema = like.select(*(c for c in like.columns if c not in LAYOUT), F.lit(None).cast("date").alias("date"), F.lit(None).cast("long").alias("batch")).schema
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def append(rows: DataFrame, path: str, time: str, batch: int = 0) -> None:
    """Writes the rows as a batch of the store, in place of what the batch had written before. Rows without a time are
    kept under the date null."""
    _write(rows.withColumns({"date": F.to_date(time), "batch": F.lit(batch).cast("long")}), path)


def append_new(batch: DataFrame, path: str, keys: list[str], time: str, number: int = 0, tie: str | None = None) -> None:
    """Appends the rows whose keys no earlier batch has: of equal keys in the batch the one of least ``tie``. Null keys
    equal null keys. The keys have to hold the time (or its date)."""
    spark = batch.sparkSession
    rows = batch.withColumn("date", F.to_date(time))
    if tie is None:
        rows = rows.dropDuplicates(keys)
    else:
        values = [c for c in rows.columns if c not in keys]
        first = F.min(F.struct(F.col(tie).alias("_tie"), F.struct(*values).alias("_row"))).alias("_first")
        rows = rows.groupBy(*keys).agg(first).select(*keys, "_first._row.*").select(*rows.columns)
    ends = rows.agg(F.min("date"), F.max("date"), F.count("*")).first()
    if not ends[2]:
        return
    held = stored(spark, path, batch).where(F.col("date").between(F.lit(ends[0]), F.lit(ends[1])) | F.col("date").isNull())
    held = held.where(F.col("batch") != number).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    _write(rows.join(held, same, "left_anti").withColumn("batch", F.lit(number).cast("long")), path)


def appender(path: str, keys: list[str], time: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that appends rows whose keys the store lacks, once for each batch id."""
    return lambda batch, number: append_new(batch, path, keys, time, number)


def scan(store: DataFrame, time: str, start, end) -> DataFrame:
    """Rows of a range of times (the end not included); only its date folders are read."""
    inside = (F.col("date") >= F.to_date(F.lit(start))) & (F.col("date") <= F.to_date(F.lit(end)))
    return store.where(inside & (F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def expire(spark: SparkSession, path: str, before: date) -> list[str]:
    """Drops the date folders before a date, without reading them; returns their names."""
    where, files = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    old = sorted(n for n in names if n.startswith("date=") and n[5:15] < before.isoformat() and n[5:6].isdigit())
    for name in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(where, name), True)
    return old


def expire_rows(store: DataFrame, path: str, time: str, before) -> None:
    """Expires rows up to a time within a date: earlier dates as a whole, and of that date the rows before it. Their
    rest is written beside the store first, so that a failure loses nothing."""
    spark = store.sparkSession
    expire(spark, path, before.date())
    day = store.where(F.col("date") == F.lit(before.date()))
    rest = written(day.where(F.col(time) >= F.lit(before)), "rest")
    kept = rest.select("batch").distinct()
    for number in [r.batch for r in day.select("batch").distinct().join(kept, "batch", "left_anti").collect()]:  # batches of one date
        where, files = _files(spark, f"{path}/date={before.date().isoformat()}/batch={number}")
        files.delete(where, True)
    _write(rest, path)
