"""From boxes to events: what is worked out once, and boxes that do not count."""

from pyspark.sql import functions as F

from conftest import SF
from tidemark.operators import boxes as B
from tidemark.plans import api as A
from tidemark.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_suppression_is_worked_out_once(spark):
    boxes = spark.createDataFrame([(1, k, 10.0 * k, 0.0, 10.0 * k + 30, 30.0, 0.5, k % 3) for k in range(6)], "frame int, box_no int, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    assert plan(B.suppress(boxes, ["frame"])).count("aggregate(") == 1
    assert "collect_list" not in plan(registry.queries()["q_08"](spark, SF))
    kept = B.suppress(boxes, ["frame"], keep=["cls"], use=F.col("box_no") != 0, aggs=(F.min("box_no").alias("least"),)).collect()
    assert {(r.box_no, r.cls, r.conf, r.least) for r in kept} == {(k, k % 3, 0.5, 0) for k in (1, 3, 5)}
    assert B.suppress(boxes, ["frame"], use=F.col("box_no") < 0).collect() == []


def test_a_frames_time_is_that_of_all_its_boxes(spark):
    fields = "cam int, frame long, t_us long, box_no int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
    rows = [(1, f, f * 20_000_000 + k, k, 100.0, 100.0, 100.0 + (0 if k == 0 else 80), 180.0, 0.9, 0) for f in (1, 2) for k in (0, 1)]
    found = A.frames_to_events(spark.createDataFrame(rows, fields))
    assert {(r.event_id, r.camera_id, r.level) for r in found.collect()} == {(1, "CAM-1", 0), (2, "CAM-1", 0)}
    assert {r.us for r in found.select(F.unix_micros("at").alias("us")).collect()} == {20_000_000, 40_000_000}
