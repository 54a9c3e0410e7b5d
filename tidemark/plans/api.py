"""The user-facing queries: each is a composition of operators, for all cameras at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import stage_depth
from tidemark.functions.space import plausible_box
from tidemark.operators import boxes as B
from tidemark.operators import catalog as J
from tidemark.operators import consensus as C
from tidemark.operators import datasets as D
from tidemark.operators import environment as E
from tidemark.operators import metrics as M
from tidemark.operators import sequences as Q
from tidemark.operators import terrain as G
from tidemark.sources.sinks import event_rows, written


def events(flood: DataFrame, cameras: DataFrame, limit: int = 100, min_level: int = 0, changes_only: bool = False) -> DataFrame:
    """The newest events from a level on, or only those at which a camera's level changed, with catalog fields."""
    rows = Q.changes_only(flood, least=min_level) if changes_only else flood.where(F.col("level") >= min_level)
    return J.enrich(Q.newest(rows, limit), cameras)


def environment_by_id(places: DataFrame, readings: DataFrame, start_us: int, end_us: int, minutes: int) -> DataFrame:
    """Each place id's nearest sensors with their bucketed readings of a range, and the last reading before it; copies is
    the number of its places."""
    near = J.nearest_by_id(places, J.sensor_candidates(readings, end_us), start_us)
    inside = E.last_per_bucket(readings.where(F.col("us").between(start_us, end_us)), minutes).select("sensor_type", "sensor_id", F.col("bucket_us").alias("us"), "value", F.lit(False).alias("previous"))
    before = J.previous_reading(readings, start_us).select("sensor_type", "sensor_id", "us", "value", F.lit(True).alias("previous"))
    return near.join(inside.unionByName(before), ["sensor_type", "sensor_id"]).select("id", "sensor_type", "sensor_id", "metres", "us", "value", "previous", "copies")


def environment_history(places: DataFrame, readings: DataFrame, start_us: int, end_us: int, minutes: int) -> DataFrame:
    """The rows of ``environment_by_id`` once a place: places that repeat an id are counted, not joined apart."""
    return J.each_place(environment_by_id(places, readings, start_us, end_us, minutes))


def history(flood: DataFrame, places: DataFrame, readings: DataFrame, start_us: int, end_us: int, minutes: int, carry_seconds: float = 1200) -> DataFrame:
    """A timeline for each camera: at every time of its stage buckets, carried edges and sensor readings, the stage and
    the three sensor values last known."""
    width = minutes * 60_000_000
    inside = flood.where(F.col("us").between(start_us, end_us))
    buckets = C.history_buckets(inside, ["camera_id"], F.expr(f"us div {width} * {width}")).select("camera_id", F.col("bucket").alias("us"), F.col("stage").alias("level"), F.col("last_id").alias("id"))
    stages = Q.edge_carry(buckets, flood.select("camera_id", "us", "level", "id"), "camera_id", start_us, end_us, carry_seconds)
    stages = stages.groupBy("camera_id", "us").agg(F.max("level").cast("double").alias("value")).withColumn("series", F.lit("stage"))
    sensed = environment_by_id(places, readings, start_us, end_us, minutes).select(F.col("id").alias("camera_id"), F.greatest("us", F.lit(start_us)).alias("us"), "value", F.col("sensor_type").alias("series"), F.col("previous"))
    sensed = sensed.groupBy("camera_id", "us", "series").agg(F.min_by("value", F.col("previous").cast("int")).alias("value"))  # a reading at the start wins
    both = stages.select("camera_id", "us", "series", "value").unionByName(sensed.select("camera_id", "us", "series", "value"))
    return Q.timeline(both, "us", "series", "value", ["stage", "rain", "sewer", "river"], ["camera_id"])


def current_stages(flood: DataFrame, as_of_us: int, stale_seconds: float, window_seconds: float, limit: int = 5000, test_id: str | None = None, test_name: str = "") -> DataFrame:
    """The present stage of every camera by id, of nameless-id rows by name, and of the test camera."""
    return C.stage_list(flood, F.timestamp_micros(F.lit(as_of_us)), stale_seconds, window_seconds, limit, test_id, test_name)


def map_overlay(cameras: DataFrame, flood: DataFrame, rain: DataFrame, as_of_us: int, stale_seconds: float = 1200, window_seconds: float = 120) -> DataFrame:
    """Markers with stage, rain and the influence of past floods at the camera."""
    stored = C.current_stages(flood, "camera_id", F.timestamp_micros(F.lit(as_of_us)), stale_seconds, window_seconds)
    marks = J.markers(cameras, stored, flood.where("record_source = 'foreground'").withColumnRenamed("level", "stage"), as_of_us, J.idw_rain(cameras, rain))
    past = G.history_points(flood, cameras, as_of_us).select(F.col("lat5").alias("plat"), F.col("lon5").alias("plon"), "stage", "recency")
    cells = cameras.where("lat is not null").select(F.col("id").alias("source_id"), F.lit(0).alias("r"), F.lit(0).alias("c"), "lat", "lon")
    influence = G.history_influence(cells, past).select(F.col("source_id").alias("id"), "influence")
    return marks.join(influence, "id", "left").withColumn("influence", F.coalesce("influence", F.lit(0.0)))


def flood_surface(markers: DataFrame, tiles: DataFrame, zooms: list[int], tile_size: int, roads: DataFrame, hydro: DataFrame, history: DataFrame, cell_m: float = 15.0, friction_m_per_km: float = 0.12) -> tuple[DataFrame, DataFrame]:
    """The water around the most urgent flood sources among markers(id, lat, lon, stage, rain_mm, depth_cm, kind) on the
    ground of elevation tiles(z, x, y, elev), with lines(id, line, point, lon, lat) of roads and water and past floods
    (plat, plon, stage, recency). Gives the layers (source_id, level, cells, area_m2, max_depth_cm, depth_cm, fallback;
    a source without any band has one layer, its least footprint) and the report (source_id, wet_cells, depths). A source
    is the marker that was chosen; both tell it from others of its id by its ``rank``, which keys its grid."""
    chosen = G.select_sources(markers.withColumn("snapshot", F.lit(0)), "snapshot", 60.0, carried=("lat", "lon", "stage", "rain_mm", "depth_cm", "kind"))
    chosen = written(chosen.drop("snapshot"), "chosen")
    sources = written(G.sized_sources(chosen.drop("id").withColumnRenamed("rank", "source_id"), cell_m), "sources")
    cells = G.analysis_grid(sources, cell_m)
    ground = written(cells.join(G.grid_heights(cells, tiles, zooms, tile_size), ["source_id", "r", "c"]), "ground")
    grid = G.water_masks(ground.select("source_id", "r", "c", "elev"), G.grid_lines(hydro, sources, cell_m), cell_m)
    road = G.grid_lines(roads, sources, cell_m).withColumn("road", F.lit(True))
    grid = grid.join(road, ["source_id", "r", "c"], "left").withColumn("road", F.coalesce("road", F.lit(False)))
    past = G.history_influence(ground, history)
    seeds = written(G.snapped_seeds(ground, sources, cell_m), "seeds")
    at_seed = seeds.select("source_id", F.col("seed_r").alias("r"), F.col("seed_c").alias("c"), F.lit(True).alias("_seed"))
    grid = written(grid.join(at_seed, ["source_id", "r", "c"], "left").withColumn("water", F.col("water") & F.col("_seed").isNull()).drop("_seed"), "grid")
    spill = written(G.spill_heights(grid, seeds, cell_m, friction_m_per_km), "spill")
    known = sources.select("source_id", "stage", "rain_mm", "depth_cm", "radius_m").join(seeds, "source_id")
    depths = written(G.depth(grid, known, spill, G.susceptibility(grid, past, cell_m), cell_m), "depth")

    seed_cell = (F.col("r") == F.col("seed_r")) & (F.col("c") == F.col("seed_c"))
    wet = depths.join(seeds.select("source_id", "seed_r", "seed_c"), "source_id").select("source_id", "r", "c", ((F.col("depth_m") >= G.BANDS_M[0]) | seed_cell).alias("wet"))
    joined = G.wet_component(wet, seeds, "wet").join(depths, ["source_id", "r", "c"])
    bands = G.bands(joined, cell_m, 2)
    layers = bands.select("source_id", "level", "cells", "area_m2", F.round(100 * F.col("max_depth_m"), 1).alias("max_depth_cm"), F.round(100 * F.col("shown_depth_m"), 1).alias("depth_cm"), F.lit(False).alias("fallback"))
    dry = known.join(bands.select("source_id").distinct(), "source_id", "left_anti")
    patch = G.least_footprint(grid.join(spill, ["source_id", "r", "c"]), dry, cell_m).groupBy("source_id").agg(F.count("*").alias("cells"))
    deepest = depths.groupBy("source_id").agg(F.max("depth_m").alias("_most"))
    given = F.coalesce("depth_cm", F.lit(0.0))
    observed = F.greatest(F.lit(1.0), F.when(given != 0, given).otherwise(stage_depth(F.coalesce("stage", F.lit(1)))))
    shown = F.round(F.greatest(100 * F.col("_most"), observed), 1)
    least = dry.join(patch, "source_id").join(deepest, "source_id").select("source_id", G.stage_of(F.col("stage")).cast("int").alias("level"), "cells", (F.col("cells") * cell_m**2).alias("area_m2"), shown.alias("max_depth_cm"), shown.alias("depth_cm"), F.lit(True).alias("fallback"))
    named = chosen.select(F.col("rank").alias("source_id"), "id")
    by_name = lambda rows: rows.join(named, "source_id").withColumnsRenamed({"source_id": "rank", "id": "source_id"})
    return by_name(layers.unionByName(least)), by_name(G.report(depths, ["source_id"]))


def ingest_environment(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch to append to the store, and the report by sensor type."""
    rows = E.unified(*(batch.where(F.col("sensor_type") == k) for k in ("rain", "sewer", "river")))
    return E.new_rows(rows, stored), E.ingest_report(rows, stored)


def frames_to_events(detections: DataFrame, frame_area: float = 1920.0 * 1080.0, cooldown_seconds: float = 10.0) -> DataFrame:
    """From boxes(cam, frame, t_us, ...) to event rows: shape filter, suppression, votes, confirmation, cooldown."""
    good = plausible_box(*(F.col(c) for c in B.SIDES), frame_area=frame_area)
    kept = B.suppress(detections, ["cam", "frame"], keep=["cls"], use=good, aggs=(F.min("t_us").alias("t_us"),))
    votes = C.frame_votes(kept, ["cam", "frame", "t_us"], "cls", "conf")
    positive = sum((F.col(f"votes_lev{k}") for k in range(1, 5)), F.lit(0))
    frames = votes.select(F.concat(F.lit("CAM-"), F.col("cam").cast("string")).alias("camera_id"), F.col("frame").alias("event_id"), "t_us", F.timestamp_micros("t_us").alias("at"), "stage", "confidence", positive.alias("positive_votes"), "total_votes")
    rows = written(event_rows(Q.gate(frames), 0.0, ("t_us",)), "events")  # read three times below
    saved = Q.save_cooldown(rows, ["camera_id"], "t_us", "event_id", "level", cooldown_seconds)
    return rows.drop("t_us").join(saved, ["camera_id", "event_id"])


def detector_benchmark(predictions: DataFrame, truth: DataFrame, frames: DataFrame) -> DataFrame:
    """model, precision, recall, f1, median_ms, coverage of each model's boxes against the truth."""
    predictions, truth, frames = written(predictions, "predictions"), written(truth, "truth"), written(frames, "frames")  # each is read several times
    models = predictions.select("model").distinct().agg(F.collect_list("model")).scalar()  # a handful of names
    labels = truth.withColumn("model", F.explode(models))
    matches = B.greedy_matches(predictions, labels, ["model", "frame"])
    scores = B.scores(matches, labels, ["model", "frame"], "model").select("model", "precision", "recall", "f1", "miss_rate")
    covered = B.coverage(labels, predictions, ["model", "frame"]).groupBy("model").agg(F.avg("covered").alias("coverage"))
    return M.summary(M.latency(frames, ["model"], "ms").select("model", "median_ms", "fps"), scores, covered, "model")


def prepare_dataset(boxes: DataFrame, width: float, height: float, seed: str) -> DataFrame:
    """frame, split, boxes, lines: camera-disjoint split and label text of each image with a usable box."""
    texts = D.label_text(D.normalised(boxes, width, height))
    return D.split_by_group(boxes.select("cam", "frame").distinct().join(texts, "frame"), "cam", seed).select("frame", "split", "boxes", "lines")
