"""The dated store: what is read, what a batch run again leaves, what expires."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store

KEYS = ["kind", "sensor", "at"]


def readings(spark, days, shift=0):
    rows = [(k + shift, "rain", f"s{k % 3}", datetime(2024, 3, d, 12, k % 60)) for d in days for k in range(9)]
    return spark.createDataFrame([*rows, (99 + shift, "rain", None, None)], "id long, kind string, sensor string, at timestamp_ntz")


def test_a_scan_reads_its_dates_only(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = readings(spark, range(1, 11))
    store.append(rows, path, "at")
    found = store.scan(store.stored(spark, path, rows), "at", datetime(2024, 3, 4, 12, 3), datetime(2024, 3, 6, 12, 2))
    assert found.count() == 6 + 9 + 2
    files = {f.split("date=")[1][:10] for f in found.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files == {"2024-03-04", "2024-03-05", "2024-03-06"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    path = f"{tmp_path}/store"
    first, second = readings(spark, [1, 2]), readings(spark, [2, 3], 1000)
    for rows, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        store.append_new(rows.unionByName(rows), path, KEYS, "at", number, "id")
    found = store.stored(spark, path, first)
    assert found.count() == 28 and found.select(*KEYS).distinct().count() == 28  # 27 readings and the one without a time
    assert {(r.batch, r.date.day if r.date else None) for r in found.select("batch", "date").distinct().collect()} == {(0, 1), (0, 2), (1, 3), (0, None)}


def test_a_write_that_died_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = readings(spark, [1, 2])
    store.append_new(rows.where("id < 99"), path, KEYS, "at", 0)
    dies = rows.withColumn("id", F.when(F.dayofmonth("at") == 3, F.raise_error(F.lit("gone"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="gone"):
        store.append(dies.unionByName(readings(spark, [3]).withColumn("id", F.raise_error(F.lit("gone")).cast("long"))), path, "at", 1)
    assert store.stored(spark, path, rows).where("batch = 1").count() == 0
    store.append_new(readings(spark, [2, 3]), path, KEYS, "at", 1)
    assert store.stored(spark, path, rows).groupBy("batch").count().orderBy("batch").collect() == [(0, 18), (1, 10)]


def test_an_append_reads_only_the_dates_of_its_batch(spark, tmp_path, monkeypatch):
    """Folders of other dates may be unreadable: the cost of an append does not follow the store's age."""
    path = f"{tmp_path}/store"
    store.append_new(readings(spark, [1, 2, 3]), path, KEYS, "at", 0)
    for file in (tmp_path / "store" / "date=2024-03-01").rglob("*.parquet"):
        file.write_bytes(b"not parquet")
    store.append_new(readings(spark, [3, 4]), path, KEYS, "at", 1)
    assert store.stored(spark, path, readings(spark, [1])).where("date >= '2024-03-02'").count() == 27


def test_dates_expire_as_a_whole_and_the_last_one_in_part(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = readings(spark, range(1, 6))
    for number in (0, 1):
        store.append(rows.where(f"id % 2 = {number}"), path, "at", number)
    assert store.expire(spark, path, datetime(2024, 3, 2).date()) == ["date=2024-03-01"]
    store.expire_rows(store.stored(spark, path, rows), path, "at", datetime(2024, 3, 3, 12, 8))
    left = store.stored(spark, path, rows)
    assert left.where("date = '2024-03-03'").select("id").collect() == [(8,)] and left.where("date < '2024-03-03'").count() == 0
    assert left.where("date > '2024-03-03'").count() == 18 and left.where("date is null").count() == 1
    assert store.expire(spark, f"{tmp_path}/none", datetime(2024, 1, 1).date()) == []
