"""Queries of sources, sinks and tracking (SC, SN, WN)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from tidemark.operators.sequences import gate
from tidemark.plans.q_core import END_US, GATE, START_US
from tidemark.plans.registry import query
from tidemark.sources import feeds as R
from tidemark.sources import sinks as W
from tidemark.sources import store
from tidemark.sources.sinks import shared_path
from tidemark.streaming import tracking as T


@query("sc_03", """with i as (select c_custkey as pos, 0 as sub, 'http://cam/' || cast(c_custkey // 2 as varchar) as url, c_custkey from customer union all select c_custkey, 1, 'https://sub/' || cast(c_custkey as varchar), c_custkey from customer where c_custkey % 3 = 0 union all select c_custkey, 2, '', c_custkey from customer where false),
f as (select *, row_number() over (partition by url order by pos, sub) as rank from i) select 'POH-' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as id, stream_url, name, lat from (select row_number() over (order by pos, sub) as n, url as stream_url, 'P' || cast(c_custkey as varchar) as name, case when sub = 0 and c_custkey % 5 > 0 then 36e0 end as lat from f where rank = 1)""")
def _(t):
    k = F.col("c_custkey")
    sub = F.when(k % 3 == 0, F.array(F.struct(F.concat(F.lit("//sub/"), k.cast("string")).alias("hmpg_cmra_url"), F.lit("x").alias("cmra_y_crdn")), F.struct(F.lit(" ").alias("hmpg_cmra_url"), F.lit("x").alias("cmra_y_crdn"))))
    item = F.to_json(F.struct(F.concat(F.lit("P"), k.cast("string")).alias("ixr_nm"), F.concat(F.lit("http://cam/"), F.floor(k / 2).cast("string")).alias("hmpg_cmra_url"), F.when(k % 5 > 0, "36.0").otherwise("99").alias("cmra_y_crdn"), F.lit("129.3").alias("cmra_x_crdn"), sub.alias("detail")))
    return R.camera_catalog(t.customer.select(k.alias("pos"), item.alias("item"))).select("id", "stream_url", "name", "lat")


@query("sc_04", """select user_id as file, event_id as stn, date_trunc('minute', ts) as at, cast(k as varchar) as rn from v_events""")
def _(t):
    row = F.when(F.col("k") % 2 == 0, F.concat_ws(",", F.date_format("ts", "yyyyMMddHHmm"), F.col("event_id").cast("string"), F.col("k").cast("string"), F.lit("="))).otherwise(F.concat_ws(" ", F.date_format("ts", "yyyyMMddHHmm"), F.col("event_id").cast("string"), F.col("k").cast("string")))
    head = F.when(F.col("user_id") % 2 == 0, "# YYMMDDHHMI STN RN-DAY").otherwise("#TM,STN,RN-DAY")
    files = t.v_events.groupBy("user_id").agg(F.concat_ws("\n", F.lit("# text"), F.first(head), F.array_join(F.collect_list(row), "\n"), F.lit("soon,1,2")).alias("value"))
    out = R.minute_table(files.withColumnRenamed("user_id", "file"))
    return out.select("file", F.col("fields")["STN"].cast("long").alias("stn"), "at", F.col("fields")["RN_DAY"].alias("rn"))


@query("sc_05", """select user_id as file, date_trunc('minute', max(ts)) as at, greatest(arg_max(k, ts) - 5, 0) * 1e0 as value from v_events group by user_id""")
def _(t):
    row = F.concat_ws(" ", F.date_format("ts", "yyyyMMddHHmm"), F.lit("36.0"), (F.col("k") - 5).cast("string"))
    files = t.v_events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", row.alias("r")))), lambda x: x["r"]), "\n").alias("v"))
    return R.grid_points(files.select(F.col("user_id").alias("file"), F.concat(F.lit("# grid\n"), "v", F.lit("\nno data")).alias("value")))


@query("sc_08", """select user_id as file, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as pos, 'W' || cast(event_id as varchar) as id, case when k % 2 = 0 then k / 100e0 else k * 1e0 end as level_m, k * 2e0 as flow_cms from v_events""")
def _(t):
    s = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"stationCode":"W'), F.col("event_id").cast("string"), F.lit('","level_cm":"'), F.col("k").cast("string"), F.lit(' cm","flux":'), (F.col("k") * 2).cast("string"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"id":"W'), F.col("event_id").cast("string"), F.lit('","wal":'), F.col("k").cast("string"), F.lit(',"flow":"'), (F.col("k") * 2).cast("string"), F.lit('"}')))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", s.alias("s")))), lambda x: x["s"]), ",")
    files = t.v_events.groupBy("user_id").agg(items.alias("i"))
    wrap = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit('{"code":"00","result":{"data":[]},"payload":{"stations":['), "i", F.lit("]}}"))).when(F.col("user_id") % 5 == 2, F.concat(F.lit('{"result":{"data":['), "i", F.lit("]}}")))
    wrap = wrap.when(F.col("user_id") % 3 == 0, F.concat(F.lit("["), "i", F.lit("]"))).when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"items":['), "i", F.lit("]}"))).otherwise(F.concat(F.lit('{"response":{"body":{"items":{"item":['), "i", F.lit("]}}}}")))
    return R.water_levels(files.select(F.col("user_id").alias("file"), wrap.alias("value"))).select("file", "pos", "id", "level_m", "flow_cms")


@query("sc_08_xml", """select event_id as file, 'X' || cast(event_id as varchar) as id, k * 1e0 as level_m from v_events""")
def _(t):
    xml = F.concat(F.lit("<response><body><items><item><wlobscd>X"), F.col("event_id").cast("string"), F.lit("</wlobscd><wl>"), F.col("k").cast("string"), F.lit("</wl></item></items></body></response>"))
    return R.water_levels(R.xml_items(t.v_events.select(F.col("event_id").alias("file"), xml.alias("value")))).select("file", "id", "level_m")


FILE_FRAMES = 15_000  # a camera's annotations are split into files, so no document grows with the camera's age


@query("sc_13", """select cam as file, 'f' || cast(frame as varchar) || '.jpg' as image, cls as category, x1 as x, y2 - y1 as h from v_boxes where cls <> 3""")
def _(t):
    """Files of a camera hold ``FILE_FRAMES`` frame numbers each."""
    boxes = t.v_boxes.groupBy("cam", "frame").agg(F.collect_list("cls").alias("c"), F.collect_list(F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("b"))
    files = boxes.groupBy("cam", F.floor(F.col("frame") / FILE_FRAMES)).agg(F.to_json(F.struct(
        F.array(*(F.struct(F.lit(k).alias("id"), F.lit(f"c{k}").alias("name")) for k in range(5))).alias("categories"),
        F.collect_list(F.struct(F.col("frame").alias("id"), F.concat(F.lit("a/f"), F.col("frame").cast("string"), F.lit(".jpg")).alias("file_name"))).alias("images"),
        F.collect_list(F.struct(F.col("frame").alias("image_id"), F.col("c").alias("category_id"), F.col("b").alias("bbox"))).alias("annotations"))).alias("value"))
    return R.camera_annotations(files.withColumnRenamed("cam", "file"), ("c3",)).select("file", "image", "category", "x", "h")


@query("sc_14", """select cam as file, 'f' || cast(frame as varchar) as image, cls - 1 as cls, x1 as first_x from v_boxes where cls > 0""")
def _(t):
    """Files of a camera hold ``FILE_FRAMES`` frame numbers each."""
    anns = F.collect_list(F.struct(F.col("frame").alias("image_id"), F.col("cls").alias("category_id"), F.array(F.array("x1", "y1", "x2", "y1", "x2", "y2")).alias("segmentation")))
    images = F.collect_set(F.struct(F.col("frame").alias("id"), F.concat(F.lit("f"), F.col("frame").cast("string")).alias("file_name")))
    cats = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(f"c{k}").alias("name"), F.lit("none" if k == 0 else "water").alias("supercategory")) for k in range(5)))
    files = t.v_boxes.groupBy("cam", F.floor(F.col("frame") / FILE_FRAMES)).agg(F.to_json(F.struct(cats.alias("categories"), images.alias("images"), anns.alias("annotations"))).alias("value"))
    return R.coco_polygons(files.withColumnRenamed("cam", "file")).select("file", "image", "cls", F.col("flat")[0].alias("first_x"))


@query("sn_01", GATE + " select event_id, g.camera_id, g.stage as level, confidence, '{\"level_label\":\"Lev' || cast(g.stage as varchar) || '\",\"detections\":' || cast(total_votes as varchar) || ',\"positive_confirmed\":' || cast(accepted as varchar) || ',\"reason\":\"' || reason || '\"}' as details from g join v_frames f using (event_id) where confidence >= 0.7 and (g.stage = 0 or accepted)")
def _(t):
    return W.event_rows(gate(t.v_frames)).select("event_id", "camera_id", "level", "confidence", "details")


@query("sn_01_store", """select id, camera_id, level, us // 86400000000 as day, cast(id % 3 as bigint) as batch from v_flood where level >= 1""")
def _(t):
    """Three batches are appended, one of them twice."""
    path = shared_path(t.spark, "events")
    rows = t.v_flood.where("level >= 1").select("id", "camera_id", "level", "detected_at")
    for number in (0, 1, 2, 1):
        store.append(rows.where(f"id % 3 = {number}"), path, "detected_at", number)
    found = store.stored(t.spark, path, rows)
    return found.select("id", "camera_id", "level", F.unix_date("date").cast("long").alias("day"), "batch")


@query("sc_01_store", f"""select id, camera_id, level from v_flood where us >= {START_US} and us < {END_US} and level >= 1""")
def _(t):
    path = shared_path(t.spark, "events")
    store.append(t.v_flood.select("id", "camera_id", "level", "detected_at"), path, "detected_at")
    times = [datetime.fromtimestamp(us / 1e6, UTC).replace(tzinfo=None) for us in (START_US, END_US)]
    found = store.scan(store.stored(t.spark, path, t.v_flood.select("id", "camera_id", "level", "detected_at")), "detected_at", *times)
    return found.where("level >= 1").select("id", "camera_id", "level")


@query("sn_02_store", """with f as (select *, us // 86400000000 as day from v_env), a as (select min(id) as id, sensor_id, day from f where id % 2 = 1 group by 2, 3),
b as (select min(id) as id, sensor_id, day from f where id % 2 = 0 and (sensor_id, day) not in (select sensor_id, day from a) group by 2, 3) select *, 1 as batch from a union all select *, 2 from b""")
def _(t):
    """Observations of a day, once each: a batch, a second one, and the second once more."""
    path = shared_path(t.spark, "observations")
    rows = t.v_env.select("id", "sensor_id", F.to_date("observed_at").alias("seen_on"))
    for number in (1, 2, 2):
        store.append_new(rows.where(f"id % 2 = {number % 2}"), path, ["sensor_id", "seen_on"], "seen_on", number, "id")
    found = store.stored(t.spark, path, rows)
    return found.select("id", "sensor_id", F.unix_date("seen_on").cast("long").alias("day"), F.col("batch").cast("int").alias("batch"))


@query("sn_03_store", f"""select id, us from v_env where us >= {START_US + 3_600_000_000}""")
def _(t):
    path = shared_path(t.spark, "observations")
    rows = t.v_env.select("id", "us", "observed_at")
    for number in (0, 1):
        store.append(rows.where(f"id % 2 = {number}"), path, "observed_at", number)
    before = datetime.fromtimestamp(START_US / 1e6 + 3600, UTC).replace(tzinfo=None)
    store.expire_rows(store.stored(t.spark, path, rows), path, "observed_at", before)
    return store.stored(t.spark, path, rows).select("id", "us")


@query("sn_04", """select id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || cast(c_custkey * 1e0 as varchar) || ',36.5]},"properties":{"id":"' || id || '"}}' as feature from v_cams""")
def _(t):
    one = W.feature(F.col("c_custkey") * 1.0, F.lit(36.5), id=F.col("id"))
    return t.v_cams.select("id", F.to_json(one).alias("feature"))


@query("sn_04_layers", """select name, '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","geometry":{"type":"Point","coordinates":[' || cast(lon as varchar) || ',' || cast(lat as varchar) || ']},"properties":{"id":"' || id || '"}}', ',' order by lon, lat, id) || ']}' as geojson from v_cams where lat is not null group by name""")
def _(t):
    return W.feature_collection(t.v_cams.where("lat is not null"), W.feature(F.col("lon"), F.col("lat"), id=F.col("id")), ["name"])


@query("sn_05", """select cls, cast(count(*) as varchar) as n from v_boxes group by cls""")
def _(t):
    rows = t.v_boxes.groupBy("cls").agg(F.count("*").alias("n"))
    from tidemark.streaming.replay import shared_path

    path = shared_path(t.spark, "csv")
    W.write_csv(rows, path)
    back = t.spark.read.option("header", True).csv(path)
    return back.select(F.col("cls").cast("int").alias("cls"), "n")


STEP = 15  # frames of a camera lie this far apart; one empty frame ends a run


SHARED = "greatest(least(x2, p.x2) - greatest(x1, p.x1), 0) * greatest(least(y2, p.y2) - greatest(y1, p.y1), 0)"
UNION = f"((x2 - x1) * (y2 - y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - {SHARED})"
OVERLAP = f"{SHARED} / case when {UNION} > 0 then {UNION} else 1 end"
SPREAD = "greatest(8e0, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), sqrt(pow(p.x2 - p.x1, 2) + pow(p.y2 - p.y1, 2)))"
APART = f"sqrt(pow((x1 + x2 - p.x1 - p.x2) / 2, 2) + pow((y1 + y2 - p.y1 - p.y2) / 2, 2)) / {SPREAD}"


def sightings_sql(rows: str, score: str, least: str, hits: str, sure: str, kept: str) -> str:
    """Boxes one by one, the strongest of a frame first: each takes the free box of the frame before that scores best.
    A row holds what was seen in the frame before (seen), what of it is taken (gone), and its own frame so far (now)."""
    empty = "[{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'label': label, 'hits': 0::bigint, 'sure': false}][1:0]"
    return f"""with recursive f as (select *, lag(frame) over (partition by cam order by frame, conf desc, box_no) as bf from {rows}),
r as (select *, sum(case when bf is null or frame - bf > {STEP} then 1 else 0 end) over (partition by cam order by frame, conf desc, box_no) as run from f),
b as (select *, row_number() over (partition by cam, run order by frame, conf desc, box_no) as rn from r),
s as (select cam, run, frame, box_no, 0::bigint as rn, 0::bigint as hits, false as sure, {empty} as seen, cast([] as bigint[]) as gone, {empty} as now from b where rn = 1
union all select cam, run, frame, box_no, rn, h, ok, seen, list_append(gone, pick), list_append(now, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'label': label, 'hits': h, 'sure': ok}})
from (select *, {sure} as ok from (select *, {hits} as h from (select *, case when list_max(scores) >= {least} then list_position(scores, list_max(scores)) else 0 end as pick
from (select *, list_transform(seen, lambda p, i: case when list_contains(gone, i) then -1e9 else {score} end) as scores
from (select b.cam, b.run, b.frame, b.box_no, b.rn, b.conf, b.label, b.x1, b.y1, b.x2, b.y2, case when b.frame = b.bf then s.seen else {kept} end as seen, case when b.frame = b.bf then s.gone else s.gone[1:0] end as gone, case when b.frame = b.bf then s.now else s.now[1:0] end as now
from s join b on b.cam = s.cam and b.run = s.run and b.rn = s.rn + 1)))))) select cam, frame, box_no, hits, sure as confirmed from s where rn > 0"""


NEEDED = "case when conf >= 0.12 then 1 when conf >= 0.03 then 2 when conf >= 0.008 then 3 when conf >= 0.0025 then 4 else 5 end"
WEAK = sightings_sql(
    "(select *, '' as label from v_boxes)", f"case when {OVERLAP} >= 0.12 or {APART} <= 0.55 then 3.5e0 * ({OVERLAP}) + greatest(1 - {APART}, 0) else -1e9 end", "-1",
    f"case when pick > 0 and seen[pick].sure then greatest(1 + seen[pick].hits, {NEEDED}) when pick > 0 then 1 + seen[pick].hits else 1 end", f"h >= {NEEDED}",
    "list_concat(list_filter(s.now, lambda p: p.sure), list_filter(s.now, lambda p: not p.sure))",
)
REPEATED = sightings_sql(
    "(select *, case when cls = 0 then 'face' else 'license_plate' end as label from v_boxes where cls < 2)", f"case when {OVERLAP} >= 0.05 and p.label = label then {OVERLAP} else -1e9 end", "0",
    "least(4, case when pick > 0 then 1 + seen[pick].hits else 1 end)", "h >= 3", "s.now",
)


@query("wn_12", WEAK)
def _(t):
    return T.confirmed_boxes(t.v_boxes, ["cam"], "frame", STEP)


@query("wn_13")
def _(t):
    return T.tracks(t.v_boxes, ["cam"], "frame", STEP)


@query("wn_18", REPEATED)
def _(t):
    boxes = t.v_boxes.where("cls < 2").withColumn("label", F.when(F.col("cls") == 0, "face").otherwise("license_plate"))
    return T.repeated_boxes(boxes.withColumn("motion", F.lit(0.0)), ["cam"], "frame", STEP, least_iou=0.05)
