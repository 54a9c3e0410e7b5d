"""Tables that hold copies: repeated ids and places, and ties of averages."""

import hashlib
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark.functions import scalars as N
from tidemark.operators import catalog as J
from tidemark.operators import consensus as C
from tidemark.operators import terrain as G
from tidemark.plans import api as A
from tidemark.sources import feeds as R
from tidemark.streaming import jobs as S
from tidemark.streaming import tracking as T


def test_votes_of_equal_averages_do_not_depend_on_the_order_of_sums(spark):
    votes = [(1, 0.1), (1, 0.2), (1, 0.3), (0, 0.3), (0, 0.2), (0, 0.1)]  # 0.6000000000000001 and 0.6 by order
    sums = [0.3 + 0.2 + 0.1, 0.1 + 0.2 + 0.3]
    assert sums[0] != sums[1]
    for low, high in (sums, sums[::-1]):
        best = C.consensus_of_counts([F.lit(3), F.lit(3)], [F.lit(low), F.lit(high)])
        assert spark.range(1).select(best.alias("b")).first().b.stage == 1
    rows = spark.createDataFrame([(1, s, c) for s, c in votes], "frame int, cls int, conf double")
    assert C.frame_votes(rows, ["frame"], "cls").first().stage == 1


def test_events_meet_every_camera_of_their_id(spark):
    cameras = spark.createDataFrame([("A-1", "one", "x", 1.0, 1.0), ("A-1", "two", "y", 2.0, 2.0), ("B", "one", "z", 3.0, 3.0)], "id string, name string, address string, lat double, lon double")
    events = spark.createDataFrame([(1, "a1", "one"), (2, "none", "one"), (3, "none", "else")], "id long, camera_id string, camera_name string")
    got = sorted((r.id, r.display_name, r.address, r.matched_by) for r in J.enrich(events, cameras).collect())
    assert got == [(1, "one", "x", "id"), (1, "two", "y", "id"), (2, "one", "z", "name"), (3, "else", None, "none")]


def test_rain_and_elevation_of_repeated_ids(spark):
    cameras = spark.createDataFrame([("A", 35.9, 129.3), ("A", 35.9, 129.3), ("A", 36.0, 129.3), ("B", 35.9, 129.3)], "id string, lat double, lon double")
    points = spark.createDataFrame([(35.9, 129.3, 4.0)], "lat double, lon double, rain_mm double")
    assert sorted(tuple(r) for r in J.idw_rain(cameras, points).collect()) == [("A", 4.0), ("B", 4.0)]
    tiles = G.tile_of(cameras.withColumn("z", F.lit(12))).select("z", "x", "y").distinct().withColumn("elev", F.array(*map(F.lit, (7.0, 7.0, 7.0, 7.0))))
    assert sorted(tuple(r) for r in G.sample_tiles(cameras, tiles, [11, 12], 2).collect()) == [("A", 7.0, 12)] * 3 + [("B", 7.0, 12)]


def test_nearest_sensor_among_copies_of_places(spark):
    cameras = spark.createDataFrame([("A", 35.9, 129.3), ("A", 36.5, 129.3), ("B", 35.9, 129.3)], "id string, lat double, lon double")
    sensors = spark.createDataFrame([("rain", f"S{k}", 35.9 if k % 2 else 36.4, 129.3) for k in range(1, 60)], "sensor_type string, sensor_id string, slat double, slon double")
    got = sorted((r.id, r.sensor_id, r.metres) for r in J.nearest_located(cameras, sensors).collect())
    assert got == [("A", "S1", 0.0), ("B", "S1", 0.0)]


def test_influence_counts_the_strongest_flood_of_a_place(spark):
    cells = spark.createDataFrame([(k, 0, 0, 35.9, 129.3) for k in range(3)], "source_id long, r int, c int, lat double, lon double")
    points = spark.createDataFrame([(35.9, 129.3, 4, 0.2), (35.9, 129.3, 1, 0.9), (35.9, 129.3, 2, 0.1)], "plat double, plon double, stage int, recency double")
    got = {r.source_id: r.influence for r in G.history_influence(cells, points).collect()}
    assert got == {k: (0.35 + 0.65 / 4) * 0.9 for k in range(3)}


def test_runs_are_cut_alike_in_any_span(spark):
    frames = [0, 3, 4, 9, 12, 13, 40, 42, 44, 46, 48, 50, 90]
    boxes = spark.createDataFrame([(cam, f, no) for cam in (1, 2) for f in frames[cam - 1 :] for no in range(2)], "cam int, frame long, box_no long")
    want, start = {}, None
    for cam in (1, 2):
        before = None
        for f in frames[cam - 1 :]:
            start = f if before is None or f - before > 3 else start
            want[cam, f], before = start, f
    for span in (1, 2, 5, 4096):
        rows = T.runs(boxes, ["cam"], "frame", 3, span).collect()
        assert len(rows) == boxes.count() and {(r.cam, r.frame): r.run for r in rows} == want


def test_annotations_of_a_camera_in_several_files(spark):
    names = '"categories":[{"id":1,"name":"c1"}]'
    value = lambda k: f'{{{names},"images":[{{"id":{k},"file_name":"f{k}.jpg"}}],"annotations":[{{"image_id":{k},"category_id":[1],"bbox":[[{k},0,2,3]]}}]}}'
    files = spark.createDataFrame([(7, value(k)) for k in range(3)], "file int, value string")
    assert sorted((r.image, r.x) for r in R.camera_annotations(files).collect()) == [(f"f{k}.jpg", float(k)) for k in range(3)]


def test_lines_in_equal_grids(spark):
    sources = spark.createDataFrame([(k, 35.9, 129.3, 1, 0.0, "CCTV") for k in range(3)], "source_id long, lat double, lon double, stage int, rain_mm double, kind string")
    points = spark.createDataFrame([(i, 0, p, 129.3 + (p - 0.5) * 0.001, 35.9) for i in range(40) for p in (0, 1)], "id long, line int, point int, lon double, lat double")
    got = G.grid_lines(points, sources).collect()
    one = {(r.r, r.c) for r in got if r.source_id == 0}
    assert one and len(got) == 3 * len(one) and all({(r.r, r.c) for r in got if r.source_id == k} == one for k in (1, 2))


def test_sources_of_one_grid_share_its_first(spark):
    rows = [(5, 35.9, 129.3, 1, 0.0, "CCTV"), (3, 35.9, 129.3, 1, 0.0, "CCTV"), (4, 35.9, 129.3, 3, 0.0, "CCTV"), (2, 36.0, 129.3, 1, 0.0, "CCTV")]
    sources = spark.createDataFrame(rows, "source_id long, lat double, lon double, stage int, rain_mm double, kind string")
    assert {r["source_id"]: r["first"] for r in G.alike(sources).select("source_id", F.col("first")).collect()} == {5: 3, 3: 3, 4: 4, 2: 2}
    assert G.analysis_grid(sources).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_places_that_repeat_an_id_meet_the_readings_once(spark):
    cameras = spark.createDataFrame([("A", 35.9, 129.3)] * 40 + [("B", 35.9, 129.3), ("C", None, None)], "id string, lat double, lon double")
    fields = "id long, sensor_type string, sensor_id string, sensor_name string, value double, lat double, lon double, us long"
    readings = spark.createDataFrame([(k, "rain", "S1", "s", k * 1.0, 35.9, 129.3, k * 60_000_000) for k in range(10)], fields)
    found = A.environment_by_id(cameras, readings, 300_000_000, 600_000_000, 1)
    assert sorted({(r.id, r.copies, r.n) for r in found.groupBy("id", "copies").agg(F.count("*").alias("n")).collect()}) == [("A", 40, 6), ("B", 1, 6), ("C", 1, 6)]
    each = A.environment_history(cameras, readings, 300_000_000, 600_000_000, 1)
    assert each.columns == ["id", "sensor_type", "sensor_id", "metres", "us", "value", "previous"]
    assert {(r.id, r["count"]) for r in each.groupBy("id").count().collect()} == {("A", 240), ("B", 6), ("C", 6)}


def test_tracker_frames_do_not_write_their_state_each():
    step, state, out = S.track_step(15), S.track_load((None,)), []
    box = lambda k: {"x1": 10.0 + k, "y1": 10.0, "x2": 60.0 + k, "y2": 60.0, "conf": 0.5, "box_no": 1}
    for frame in (0, 15, 30, 90):
        state, made = step(state, SimpleNamespace(frame=frame, boxes=[box(frame // 15)]))
        assert len(state) == 4  # boxes, not text
        out.append(made)
        held = S.track_save(state)
        state = S.track_load(held)  # a batch may end at any frame
        assert S.track_save(S.track_load(S.track_save(state))) == S.track_save(state)
    assert out == [(0, 1, 1), (15, 1, 1), (30, 1, 1), (90, 1, 1)]


def test_repeated_ids_are_signed_in_the_order_of_their_keys(spark):
    rows = [("a", 1, 9.0), ("a", 2, 5.0), ("b", 3, 1.0)]
    signed = lambda r, shown: spark.createDataFrame(r, "id string, n int, lat double").agg(N.signature(F.collect_list(F.struct("id", "n", "lat")), shown).alias("s")).first().s
    text = '[{"id":"a","lat":9.0},{"id":"a","lat":5.0},{"id":"b","lat":1.0}]'
    assert signed(rows, ["id", "lat"]) == signed(rows[::-1], ["id", "lat"]) == hashlib.sha256(text.encode()).hexdigest()
    assert signed(rows, None) == signed(rows[::-1], None)


def test_of_readings_of_one_time_the_first_or_the_last_is_taken(spark):
    rows = [(k, "rain", "S", float(k), 7) for k in (3, 1, 2)] + [(0, "rain", "S", 9.0, 6)]
    readings = spark.createDataFrame(rows, "id long, sensor_type string, sensor_id string, value double, us long")
    assert [J.previous_reading(readings, 9, first).first().value for first in (False, True)] == [3.0, 1.0]


def test_probes_take_the_last_id_of_the_readings_of_one_time(spark):
    readings = spark.createDataFrame([(k, u, 5, float(k)) for u in range(40) for k in (2, 3, 1)], "id long, u int, us long, value double")
    probes = spark.createDataFrame([(9, u, 6) for u in range(40)] + [(8, u, 5) for u in range(40)], "id long, u int, us long")
    for order in (F.asc("id"), F.desc("id")):
        found = J.as_of(probes, readings.coalesce(1).sortWithinPartitions(order), "u").collect()
        assert {(r.id, r.previous) for r in found} == {(9, 3.0), (8, None)}
