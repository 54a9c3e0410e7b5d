"""Queries of label preparation (DS, SC, ST) and marker depths (DM, AG, WN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import datasets as D
from tidemark.operators import markers as K
from tidemark.plans.registry import query


@query("ds_01", """select event_id as file, case when k % 10 = 0 then 'error' when k % 7 in (0, 3) then 'keep' else 'remove' end as status from v_events""")
def _(t):
    k = F.col("k")
    text = F.when(k % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"a":[{"classId" : "P'), (k % 7).cast("string"), F.lit('"}],"b":{"classId":"'), F.when(k % 7 == 3, "P0").otherwise("Q"), F.lit('"}}')))
    return D.keep_by_class(t.v_events.select(F.col("event_id").alias("file"), text.alias("json")), "P0")


@query("ds_02", """with g as (select distinct user_id, row_number() over (order by md5('s1' || cast(user_id as varchar)), user_id) as rank from (select distinct user_id from v_events)) select event_id, case when rank <= greatest(1, floor(0.2 * (select count(*) from g))) then 'val' else 'train' end as split from v_events join g using (user_id)""")
def _(t):
    return D.split_by_group(t.v_events, "user_id", "s1").select("event_id", "split")


@query("ds_03", """select event_id, case when row_number() over (partition by event_type order by md5('s2' || cast(event_id as varchar)), event_id) <= floor(0.2 * count(*) over (partition by event_type)) then 'val' else 'train' end as split from v_events""")
def _(t):
    return D.split_by_class(t.v_events, "event_type", "event_id", "s2").select("event_id", "split")


def normal_sql(width: int, height: int) -> str:
    return f"(select cam, frame, box_no, cls, round((a + c) / 2 / {width}, 8) as cx, round((b + d) / 2 / {height}, 8) as cy, round((c - a) / {width}, 8) as w, round((d - b) / {height}, 8) as h, case when c - a < 2 or d - b < 2 then 'small' end as skipped from (select *, least(greatest(x1, 0), {width}) as a, least(greatest(y1, 0), {height}) as b, least(greatest(x2, 0), {width}) as c, least(greatest(y2, 0), {height}) as d from v_boxes))"


def text_sql(width: int, height: int) -> str:
    number = lambda c: f"cast(cast(round(cast({c} as decimal(12, 8)), 6) as decimal(12, 6)) as varchar)"
    line = " || ' ' || ".join(["cast(cls as varchar)", *map(number, ("cx", "cy", "w", "h"))])
    return f"(select cam, frame, string_agg({line}, chr(10) order by box_no) as lines, count(*) as boxes from {normal_sql(width, height)} where skipped is null group by cam, frame)"


@query("ds_04", f"select frame, box_no, cls, cx, cy, w, h, skipped from {normal_sql(640, 360)}")
def _(t):
    return D.normalised(t.v_boxes, 640.0, 360.0)


@query("ds_04_text", f"select frame, lines, boxes from {text_sql(640, 360)}")
def _(t):
    return D.label_text(D.normalised(t.v_boxes, 640.0, 360.0))


UNSIZED = "frame % 11 = 0"  # frames whose size is not known


def sized(t):
    known = lambda v: F.when(~F.expr(UNSIZED), F.lit(v))
    return t.v_boxes, known(640.0), known(360.0)


@query("ds_04_v2", f"""select frame, box_no, cls, round((x1 + x2) / 2 / w, 8) as cx, round((y1 + y2) / 2 / h, 8) as cy, round((x2 - x1) / w, 8) as w, round((y2 - y1) / h, 8) as h,
case when w is null then 'no_size' when not ((x1 + x2) / 2 / w > 0 and (x1 + x2) / 2 / w < 1 and (y1 + y2) / 2 / h > 0 and (y1 + y2) / 2 / h < 1 and (x2 - x1) / w > 0 and (x2 - x1) / w <= 1 and (y2 - y1) / h > 0 and (y2 - y1) / h <= 1) then 'outside' end as skipped
from (select *, case when not {UNSIZED} then 640e0 end as w, case when not {UNSIZED} then 360e0 end as h from v_boxes)""")
def _(t):
    return D.normalised(*sized(t), rule="v2")


@query("ds_04_v1", """select frame, box_no, cls, round((x1 + x2 / 2) / 640, 8) as cx, round((y1 + y2 / 2) / 360, 8) as cy, round(x2 / 640, 8) as w, round(y2 / 360, 8) as h, cast(null as varchar) as skipped from v_boxes""")
def _(t):
    return D.normalised(t.v_boxes, 640.0, 360.0, rule="v1")


@query("ds_04_counters", f"""with b as (select *, {UNSIZED} as unsized, least(greatest(x1, 0), 640) as a, least(greatest(y1, 0), 360) as b, least(greatest(x2, 0), 640) as c, least(greatest(y2, 0), 360) as d from v_boxes where cls <> 4),
f as (select frame, bool_or(unsized) as unsized, count(*) filter (where c - a >= 2 and d - b >= 2) as kept, count(*) filter (where c - a < 2 or d - b < 2) as small from b group by 1),
i as (select distinct frame, {UNSIZED} as unsized from v_boxes)
select count(*) as images, count(*) filter (where i.unsized) as no_size, count(*) filter (where not i.unsized and coalesce(kept, 0) = 0) as empty, count(*) filter (where not i.unsized and kept > 0) as written, cast(sum(kept) filter (where not i.unsized) as bigint) as boxes, cast(sum(small) filter (where not i.unsized) as bigint) as small, 0 as outside
from i left join f on f.frame = i.frame""")
def _(t):
    boxes, w, h = sized(t)
    images = boxes.select("frame", (~F.expr(UNSIZED)).alias("sized")).distinct()
    return D.label_counters(images, D.normalised(boxes.where("cls <> 4"), w, h))


LINES = "case k % 5 when 0 then '1 0.5 0.5 0.1' when 1 then '7 0.5 0.5 0.1 0.1' when 2 then '2 1.5 0.5 0.1 0.1' when 3 then '3 0.5  0.25 0.1 0.1' else 'x 0.5 0.5 0.1 0.1' end"


def label_lines(t):
    return t.v_events.where("event_id % 6 > 0").select(F.col("event_id").alias("file"), F.lit(1).cast("long").alias("line_no"), F.expr(LINES).alias("line"))


@query("sc_12", """select event_id as file, cast(1 as bigint) as line_no, cast(case when k % 5 = 0 then 4 else 5 end as int) as fields, cast(case k % 5 when 0 then 1 when 1 then 7 when 2 then 2 when 3 then 3 end as int) as cls, case when k % 5 = 2 then 1.5e0 else 0.5e0 end as cx from v_events where event_id % 6 > 0""")
def _(t):
    return D.parse_labels(label_lines(t)).select("file", "line_no", "fields", "cls", "cx")


@query("ds_05", """select event_id as file, cast(1 as bigint) as line_no, case k % 5 when 0 then 'field_count' when 1 then 'class' when 2 then 'coordinates' else 'class' end as error from v_events where event_id % 6 > 0 and k % 5 <> 3 union all select event_id, null, 'missing_label' from v_events where event_id % 6 = 0""")
def _(t):
    return D.validate_labels(t.v_events.select(F.col("event_id").alias("file")), D.parse_labels(label_lines(t)))


@query("ds_06", """select category, dense_rank() over (order by category) - 1 as cls from (select distinct k % 17 as category from v_events) where category not in (0, 5)""")
def _(t):
    return D.dense_classes(t.v_events.select((F.col("k") % 17).alias("category")), "category", [0, 5])


@query("ds_06_files", """with s as (select user_id as file, list_sort(list(distinct k % 3)) as marks from v_events group by user_id) select file, marks = (select marks from s order by file limit 1) as consistent from s""")
def _(t):
    return D.inconsistent_files(t.v_events.select(F.col("user_id").alias("file"), (F.col("k") % 3).alias("category"), F.lit("n").alias("name")))


@query("ds_07", """select event_id as file, user_id as camera, case k % 4 when 0 then 1920 when 1 then 1280 else 640 + user_id end as width, case k % 4 when 0 then 1080 when 1 then 720 else 360 + user_id end as height, k % 4 < 2 as known from v_events""")
def _(t):
    codes = t.spark.createDataFrame([(0, 1920, 1080), (1, 1280, 720)], "code int, width long, height long")
    images = t.v_events.select(F.col("event_id").alias("file"), F.col("user_id").alias("camera"), (F.col("k") % 4).alias("code"))
    return D.sizes_by_code(images, codes, t.v_events.select("user_id", (F.col("user_id") + 640).alias("w"), (F.col("user_id") + 360).alias("h")).distinct())


@query("ds_08", """with r as (select p.preset, event_id, ratio, row_number() over (partition by preset order by md5('s3' || preset || cast(event_id as varchar)), event_id) as rank from v_events cross join (select 'night' as preset, 0.25e0 as ratio union all select 'rain', 0.1e0) p) select preset, event_id, cast(event_id as varchar) || '_' || preset as output from r where rank <= floor((select count(*) from v_events) * ratio)""")
def _(t):
    presets = t.spark.createDataFrame([("night", 0.25), ("rain", 0.1)], "preset string, ratio double")
    return D.sample_per_preset(t.v_events.select("event_id"), presets, "event_id", "s3")


@query("ds_09", """select frame as file, box_no as no, round(least(greatest(x1 / 640, 0), 1), 8) as x, round(least(greatest(y2 / 360, 0), 1), 8) as y from v_boxes""")
def _(t):
    flat = F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    rows = D.polygons(t.v_boxes.select(F.col("frame").alias("file"), F.col("box_no").alias("no"), flat.alias("flat")), 640.0, 360.0)
    return rows.select("file", "no", F.col("points")[3]["x"].alias("x"), F.col("points")[3]["y"].alias("y"))


@query("ds_09_counters", """with p as (select frame, count(*) filter (where box_no % 4 > 0) as polygons, count(*) filter (where box_no % 4 = 0) as empty_poly from v_boxes where cls > 2 group by 1), i as (select distinct frame, frame % 13 > 0 as present from v_boxes)
select count(*) filter (where present) as images, count(*) filter (where not present) as missing_image, cast(sum(polygons) filter (where present) as bigint) as polygons, cast(sum(empty_poly) filter (where present) as bigint) as empty_poly, count(*) filter (where present and coalesce(polygons, 0) = 0) as background_only from i left join p on p.frame = i.frame""")
def _(t):
    """Every fourth annotation has two points only."""
    whole, line = F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2"), F.array("x1", "y1", "x2", "y2")
    flat = F.when(F.col("box_no") % 4 == 0, line).otherwise(whole)
    rows = D.polygons(t.v_boxes.where("cls > 2").select(F.col("frame").alias("file"), F.col("box_no").alias("no"), flat.alias("flat")), 640.0, 360.0)
    return D.polygon_counters(t.v_boxes.select(F.col("frame").alias("file"), (F.col("frame") % 13 > 0).alias("present")).distinct(), rows)


@query("st_06", """select distinct frame as file, 'image' as kind from v_boxes where cls < 3 and frame not in (select frame from v_boxes where cls > 1) union all select distinct frame, 'label' from v_boxes where cls > 1 and frame not in (select frame from v_boxes where cls < 3)""")
def _(t):
    i, l = (t.v_boxes.where(w).select(F.col("frame").alias("file")).distinct() for w in ("cls < 3", "cls > 1"))  # noqa: E741
    return i.join(l, "file", "left_anti").withColumn("kind", F.lit("image")).unionByName(l.join(i, "file", "left_anti").withColumn("kind", F.lit("label")))


@query("st_07", """with e as (select event_id from v_events where k % 10 = 0) select event_id as file, 'rejected' as reason from v_events where k < 50 and k % 10 <> 0 union all select event_id, 'label' from v_events where k < 50 and event_id % 2 = 0 and k % 10 <> 0 union all select event_id, 'orphan' from v_events where k > 90 and k % 10 <> 0""")
def _(t):
    f = lambda w: t.v_events.where(w).select(F.col("event_id").alias("file"))
    return D.removal_manifest(f("k < 50"), f("event_id % 2 = 0"), f("k > 90"), f("k % 10 = 0"))


@query("st_08", """select cast(event_id as varchar) as output, 'original' as origin from v_events union all select cast(event_id as varchar) || '_x', 'augmented' from v_events where k < 20 union all select cast(event_id as varchar), 'negative' from (select event_id from v_events where k > 80 order by md5('s4' || cast(event_id as varchar)), event_id limit 50)""")
def _(t):
    f = lambda w: t.v_events.where(w).select(F.col("event_id").alias("file"))
    samples = f("k < 20").select(F.concat(F.col("file").cast("string"), F.lit("_x")).alias("output"))
    return D.augmented_manifest(f("true"), samples, f("k > 80"), 50, "s4")


def readings(t):
    return t.v_boxes.select("frame", F.col("box_no").alias("reading"), F.col("y1").alias("y"), (F.col("l_quantity") / 10).alias("contrast"), (F.col("l_discount") * 10).alias("noise"))


READINGS = "(select frame, box_no as reading, y1 as y, l_quantity / 10 as contrast, l_discount * 10 as noise from v_boxes)"


@query("dm_01", f"""select frame, reading from (select *, quantile_cont(top, 0.5) over (partition by frame) as middle from (select *, case when row_number() over (partition by frame order by contrast desc, reading) <= 3 then contrast end as top from {READINGS})) where contrast >= 0.35 * middle and contrast >= noise""")
def _(t):
    return K.visible_stripes(readings(t), "frame").select("frame", "reading")


@query("dm_02", f"""with n as (select frame, reading, y, stripe, d from (select *, row_number() over (partition by frame, reading order by d, stripe) as rank from (select r.*, n as stripe, abs(y - n * 40) as d from {READINGS} r cross join series11)) where rank = 1 and d <= 15) select frame, reading, stripe, d as distance from (select *, row_number() over (partition by frame, stripe order by d, reading) as rank from n) where rank = 1""")
def _(t):
    expected = t.series11.select(F.col("n").alias("stripe"), (F.col("n") * 40.0).alias("centre"))
    return K.match_stripes(readings(t), expected, "frame", 15.0)


@query("dm_03", """with f as (select frame, max(conf) * 5 as best, min(case when cls > 0 then cls end) as lowest, min(case when flag = 'R' then 0.5e0 else 1e0 end) as part from v_boxes group by frame),
s as (select *, 25e0 + (lowest - 1) * 20 as bottom, case when best < 0.8 then 'LOW_CONTRAST' when lowest is null then 'NO_STRIPE' when part < 1 then 'PARTIAL_STRIPE' when lowest = 1 then 'BELOW_MARKER' else 'STRIPE_COUNT' end as status from f),
d as (select frame, status, case status when 'PARTIAL_STRIPE' then bottom + (1 - part) * 10 when 'STRIPE_COUNT' then bottom - 5 when 'BELOW_MARKER' then 0e0 end as depth_cm, case status when 'PARTIAL_STRIPE' then bottom + (1 - part) * 10 + 1 when 'STRIPE_COUNT' then bottom when 'BELOW_MARKER' then bottom end as high_cm from s)
select *, cast(case when depth_cm < 5 then 0 when depth_cm < 15 then 1 when depth_cm < 25 then 2 when depth_cm < 40 then 3 when depth_cm >= 40 then 4 end as int) as level from d""")
def _(t):
    frames = t.v_boxes.groupBy("frame").agg((F.max("conf") * 5).alias("best_contrast"), F.min(F.when(F.col("cls") > 0, F.col("cls"))).alias("lowest_stripe"), F.min(F.when(F.col("flag") == "R", 0.5).otherwise(1.0)).alias("visible_part"))
    return K.water_line(frames).select("frame", "status", "depth_cm", "high_cm", "level")


FIT = "(select cam, count(*) as n, avg(x1) as centre, avg(y1) as intercept, regr_slope(y1, x1) as slope from v_boxes group by cam)"


@query("ag_33", f"""select cam, n, round(centre, 6) as centre, round(intercept, 6) as intercept, round(slope, 6) as slope from {FIT}""")
def _(t):
    fit = K.calibrate(t.v_boxes, "cam", "x1", "y1")
    return fit.select("cam", "n", *(F.round(c, 6).alias(c) for c in ("centre", "intercept", "slope")))


@query("dm_04", f"""select b.frame, box_no, round(greatest(intercept + slope * (y2 - centre), 0), 6) as depth_cm, case when intercept + slope * (y2 - centre) < 0 then 'below' when y2 not between 50 and 400 then 'extrapolated' else 'ok' end as status from v_boxes b join {FIT} f using (cam)""")
def _(t):
    fit = K.calibrate(t.v_boxes, "cam", "x1", "y1")
    return K.measure(t.v_boxes.select("cam", "frame", "box_no", "y2"), fit, "cam", "y2", 50, 400).select("frame", "box_no", F.round("depth_cm", 6).alias("depth_cm"), "status")


@query("dm_05", """select frame, abs(max(x1) - max(y1)) as gap_cm, abs(max(x1) - max(y1)) > 5 as flagged from v_boxes group by frame""")
def _(t):
    a, b = (t.v_boxes.groupBy("frame").agg(F.max(c).alias("depth_cm")) for c in ("x1", "y1"))
    return K.cross_check(a, b, "frame")


@query("ag_34", """select frame, round(quantile_cont(y1, 0.05), 6) as line_y from v_boxes group by frame""")
def _(t):
    return K.pole_line(t.v_boxes, "frame", "y1").withColumn("line_y", F.round("line_y", 6))


WHEELS = """r as (select frame, floor(y1) + 3 as y, x1 + 10 as xa, x2 + 30 as xb from v_boxes where flag = 'A'),
w as (select b.frame, b.box_no, sum(case when y between y1 and y2 - 1 then least(xb, x2) - greatest(xa, x1) end) as wet, min(y) as top_y from v_boxes b join r on r.frame = b.frame and xa < x2 and xb > x1 where b.flag = 'R' group by 1, 2),
h as (select b.frame, b.box_no, coalesce(wet, 0) / ((x2 - x1) * (y2 - y1)) as wet_share, top_y, case when top_y is null then 0e0 else greatest((y2 - greatest(top_y, y1)) / (y2 - y1), 0) end as height_ratio from v_boxes b left join w on w.frame = b.frame and w.box_no = b.box_no where b.flag = 'R' and y2 > y1),
l as (select *, case when height_ratio < 0.05 then 0 when height_ratio < 0.25 then 1 when height_ratio < 0.5 then 2 when height_ratio < 0.75 then 3 else 4 end as level from h)"""


def wheels(t):
    runs = t.v_boxes.where("flag = 'A'").select("frame", (F.floor("y1") + 3).alias("y"), (F.col("x1") + 10).alias("xa"), (F.col("x2") + 30).alias("xb"))
    return K.wheel_submersion(t.v_boxes.where("flag = 'R'").select("frame", "box_no", "x1", "y1", "x2", "y2"), runs, "frame")


@query("ag_36", f"with {WHEELS} select * from l")
def _(t):
    return wheels(t)


@query("ag_36_frame", f"with {WHEELS} select f.frame, count(l.frame) as wheels, coalesce(max(level), 0) as level from (select distinct frame from v_boxes) f left join l on l.frame = f.frame group by 1")
def _(t):
    return K.frame_submersion(t.v_boxes, wheels(t), "frame")


def run_sql(rows: str) -> str:
    return f"""g as (select *, pos - lag(pos) over (partition by cam order by pos) as gap from {rows}), m as (select *, quantile_cont(gap, 0.5) over (partition by cam) as mid from g), r as (select *, sum(case when abs(gap - mid) <= 0.35 * mid then 0 else 1 end) over (partition by cam order by pos) as run from m),
a as (select cam, run, count(*) as n, min(pos) as first, max(pos) as last from r group by cam, run)"""


@query("wn_21", f"""with p as (select distinct cam, x1 + y1 as pos from v_boxes where conf > 0.5), {run_sql("p")} select cam, 0 as round, first, last, n from (select *, row_number() over (partition by cam order by n desc, first) as rank from a) where rank = 1 and n >= 3""")
def _(t):
    return K.periodic_run(t.v_boxes.where("conf > 0.5").withColumn("pos", F.col("x1") + F.col("y1")), "cam", "pos", rounds=1)
