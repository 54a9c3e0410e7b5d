"""Queries of the column functions (FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import space as G
from tidemark.plans.registry import query

B = ("x1", "y1", "x2", "y2")


def box(*names: str) -> list[F.Column]:
    return [F.col(n) for n in names or B]


TIMES = "case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' when 1 then strftime(ts, '%Y%m%d%H%M%S') when 2 then strftime(ts, '%Y-%m-%d %H:%M') else 'soon' end"


@query("fn_01", """select event_id, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) - interval 9 hour when 2 then date_trunc('minute', ts) - interval 9 hour end as at from v_events""")
def _(t):
    ts = F.col("ts")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyyMMddHHmmss")).when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm")).otherwise("soon")
    return t.v_events.select("event_id", S.parse_time(text).alias("at"))


@query("fn_02", """select event_id, case event_id % 3 when 0 then date_trunc('minute', ts) when 1 then date_trunc('hour', ts) else date_trunc('day', ts) end as at from v_events""")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy/MM/dd HH")).otherwise(F.date_format("ts", "yyyy.MM.dd"))
    return t.v_events.select("event_id", S.parse_digits_time(text).alias("at"))


@query("fn_03", """select event_id, case when event_id % 3 = 0 then null when event_id % 3 = 1 then value end as number from v_events""")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, F.lit("-99.0")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("v="), F.col("value").cast("string"), F.lit(" mm"))).otherwise(F.lit("n/a"))
    return t.v_events.select("event_id", S.number_in(text).alias("number"))


@query("fn_04", """select event_id, coalesce(case when k % 2 = 0 then value end, case when k % 3 = 0 then k * 1e0 end, user_id * 1e0) as v from v_events""")
def _(t):
    return t.v_events.select("event_id", S.first_valid(F.when(F.col("k") % 2 == 0, F.col("value")), F.when(F.col("k") % 3 == 0, F.col("k") * 1.0), F.col("user_id") * 1.0).alias("v"))


@query("fn_05", """select event_id, case k % 4 when 0 then 0e0 when 1 then k + 1000e0 when 2 then k / 2e0 else k * 1e0 end as mm from v_events""")
def _(t):
    k = F.col("k").cast("string")
    text = F.when(F.col("k") % 4 == 0, "강수없음").when(F.col("k") % 4 == 1, F.concat(F.lit("1,"), F.lpad(k, 3, "0"), F.lit("mm"))).when(F.col("k") % 4 == 2, F.concat(k, F.lit("mm 미만"))).otherwise(F.concat(k, F.lit(".0mm")))
    return t.v_events.select("event_id", S.rain_text(text).alias("mm"))


@query("fn_06", """select event_id, case k % 9 when 0 then '없음' when 1 then '비' when 2 then '비/눈' when 3 then '눈' when 5 then '빗방울' when 6 then '빗방울/눈날림' when 7 then '눈날림' else '코드 ' || cast(k % 9 as varchar) end as name from v_events""")
def _(t):
    return t.v_events.select("event_id", S.precipitation_name(F.col("k") % 9).alias("name"))


@query("fn_07", """select id, case when lon is not null then cast(floor(ra * sin(th) + 43 + 0.5) as int) end as nx, case when lon is not null then cast(floor(ro - ra * cos(th) + 136 + 0.5) as int) end as ny from (
  select *, sf0 / pow(tan(pi() * 0.25 + radians(lat) * 0.5), sn) as ra, sf0 / pow(tan(pi() * 0.25 + radians(38e0) * 0.5), sn) as ro, (radians(lon) - radians(126e0)) * sn as th from (
  select *, (6371.00877e0 / 5) * pow(tan(pi() * 0.25 + radians(30e0) * 0.5), sn) * cos(radians(30e0)) / sn as sf0 from (
  select *, ln(cos(radians(30e0)) / cos(radians(60e0))) / ln(tan(pi() * 0.25 + radians(60e0) * 0.5) / tan(pi() * 0.25 + radians(30e0) * 0.5)) as sn from v_cams)))""")
def _(t):
    nx, ny = G.grid_5km(F.col("lat"), F.col("lon"))
    return t.v_cams.select("id", nx.alias("nx"), ny.alias("ny"))


@query("fn_08", """select id, round(2 * 6371000e0 * atan2(sqrt(a), sqrt(1 - a)), 3) as metres from (select id, pow(sin(radians(lat - 36e0) / 2), 2) + cos(radians(36e0)) * cos(radians(lat)) * pow(sin(radians(lon - 129.36e0) / 2), 2) as a from v_cams)""")
def _(t):
    return t.v_cams.select("id", F.round(G.haversine(F.lit(36.0), F.lit(129.36), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query("fn_09", """select id, round(sqrt(pow((lon - 129.36e0) * 111320 * cos(radians((lat + 36e0) / 2)), 2) + pow((lat - 36e0) * 110540, 2)), 3) as metres from v_cams""")
def _(t):
    return t.v_cams.select("id", F.round(G.flat_metres(F.lit(36.0), F.lit(129.36), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query("fn_10", """select id, case when value < 1 then 0 when value < 5 then 1 when value < 15 then 2 when value < 30 then 3 else 4 end as level, case when value < 1 then 0e0 else least(90e0, greatest(6e0, value * 1.8e0)) end as depth_cm from v_env""")
def _(t):
    return t.v_env.select("id", S.level_of(F.col("value"), S.RAIN_BREAKS_MM).alias("level"), S.rain_depth(F.col("value")).alias("depth_cm"))


@query("fn_11", """select id, case level when 0 then 0 when 1 then 8 when 2 then 25 when 3 then 48 else 70 end as depth_cm, case when k < 1 then 0 when k < 12 then 1 when k < 35 then 2 when k < 60 then 3 else 4 end as level_of_k from v_flood""")
def _(t):
    return t.v_flood.select("id", S.stage_depth(F.col("level")).alias("depth_cm"), S.level_of(F.col("k")).alias("level_of_k"))


@query("fn_12", """select id, regexp_replace(lower(trim(' A-' || name || ' 형산 (강)!')), '[^a-z0-9가-힣]', '', 'g') as key from v_cams""")
def _(t):
    return t.v_cams.select("id", S.identity_key(F.concat(F.lit(" A-"), "name", F.lit(" 형산 (강)!"))).alias("key"))


@query("fn_13", """select id, name as plain, 'A12-345' as code_only from v_cams""")
def _(t):
    return t.v_cams.select("id", S.human_name(F.concat(F.lit(" A12-345 "), "name")).alias("plain"), S.human_name(F.lit("A12-345")).alias("code_only"))


@query("fn_14", """select id, case when user_id % 5 = 0 and level < 1 then 1 else level end as stage, case when user_id % 5 = 0 and level < 1 then greatest(confidence, 0.7e0) else confidence end as conf, user_id % 5 = 0 and level < 1 as raised from v_flood""")
def _(t):
    stage, conf, raised = S.floored(F.col("level"), F.col("confidence"), F.col("user_id") % 5 == 0)
    return t.v_flood.select("id", stage.cast("int").alias("stage"), conf.alias("conf"), raised.alias("raised"))


@query("fn_15", """select id, coalesce(case when k % 7 > 0 then confidence end, 0e0) >= 0.7e0 as confident, level = 0 or coalesce(case when k % 5 > 0 then positive_confirmed end, false) as authoritative from v_flood""")
def _(t):
    return t.v_flood.select("id", S.confident(F.when(F.col("k") % 7 > 0, F.col("confidence"))).alias("confident"), S.authoritative(F.col("level"), F.when(F.col("k") % 5 > 0, F.col("positive_confirmed"))).alias("authoritative"))


@query("fn_16", """select id, '{"site":"' || name || '","n":' || cast(c_custkey as varchar) || '}' as details from v_cams""")
def _(t):
    return t.v_cams.select("id", F.to_json(F.struct(F.col("name").alias("site"), F.col("c_custkey").alias("n"))).alias("details"))


@query("fn_17", """select id, coalesce(case when k % 4 = 0 then value end, case when k % 4 = 1 then value * 2 end, case when k % 4 = 2 then k * 1e0 end / 100, value / 100) as metres from (select e.*, event_id % 100 as k from (select *, id as event_id from v_env) e)""")
def _(t):
    e, k = t.v_env, F.col("id") % 100
    none = F.lit(None).cast("double")
    return e.select("id", S.sensor_level(F.when(k % 4 == 0, F.col("value")), F.when(k % 4 == 1, F.col("value") * 2), none, F.when(k % 4 == 2, k * 1.0), none, F.col("value")).alias("metres"))


@query("fn_18", """select event_id, case k % 3 when 0 then props when 1 then '{"label":"plain text"}' else '{"label":"[1,2]"}' end as details from v_props""".replace("v_props", "(select event_id, props, cast(json_extract_string(props, '$.k') as int) as k from events)"))
def _(t):
    e = t.events.join(t.v_events.select("event_id", "k"), "event_id")
    text = F.when(F.col("k") % 3 == 0, F.col("props")).when(F.col("k") % 3 == 1, "plain text").otherwise("[1,2]")
    return e.select("event_id", S.details(text).alias("details"))


@query("fn_19", """select event_id, date_trunc('hour', ts) + to_minutes(cast(minute(ts) // 5 * 5 as int)) as b5, date_trunc('hour', ts) + to_minutes(cast(minute(ts) // 30 * 30 as int)) as b30, date_trunc('hour', ts) as b60 from v_events""")
def _(t):
    return t.v_events.select("event_id", *(S.bucket(F.col("ts"), m).alias(f"b{m}") for m in (5, 30, 60)))


@query("fn_20", """select event_id, case when k * 10 <= 6 then 1 when k * 10 <= 48 then 5 when k * 10 <= 336 then 30 else 60 end as minutes from v_events""")
def _(t):
    return t.v_events.select("event_id", S.bucket_minutes(F.col("k") * 10).alias("minutes"))


@query("fn_21", """select event_id, cast(case when k % 7 <= 4 then k % 7 else least(k // 10, 4) end as int) as stage from v_events""")
def _(t):
    return t.v_events.select("event_id", S.stage_from(F.col("k") % 7, F.concat(F.lit("Lev"), F.floor(F.col("k") / 10).cast("string"))).alias("stage"))


PAIR = "select a.frame, a.box_no as a_no, b.box_no as b_no, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2 from v_boxes a join v_boxes b on a.frame = b.frame and b.box_no = a.box_no + 1"
INTER = "greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0)"
AREAS = "(ax2 - ax1) * (ay2 - ay1) as aa, (bx2 - bx1) * (by2 - by1) as ba"


def neighbours(t):
    a, b = (t.v_boxes.select("frame", F.col("box_no").alias(f"{s}_no"), *(F.col(c).alias(f"{s}{c}") for c in B)) for s in "ab")
    return a.withColumn("b_no", F.col("a_no") + 1).join(b, ["frame", "b_no"])


@query("fn_22", f"""select frame, a_no, b_no, round(case when aa + ba - i > 0 then i / (aa + ba - i) else 0 end, 9) as iou, round(case when least(aa, ba) > 0 then i / least(aa, ba) else 0 end, 9) as overlap,
  round(sqrt(pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + pow((ay1 + ay2 - by1 - by2) / 2, 2)) / greatest(8, sqrt(pow(ax2 - ax1, 2) + pow(ay2 - ay1, 2)), sqrt(pow(bx2 - bx1, 2) + pow(by2 - by1, 2))), 9) as centre
  from (select *, {INTER} as i, {AREAS} from ({PAIR}))""")
def _(t):
    a, b = box(*(f"a{c}" for c in B)), box(*(f"b{c}" for c in B))
    return neighbours(t).select("frame", "a_no", "b_no", F.round(G.iou(a, b), 9).alias("iou"), F.round(G.overlap_of_smaller(a, b), 9).alias("overlap"), F.round(G.centre_distance(a, b), 9).alias("centre"))


@query("fn_23", """select frame, box_no from v_boxes where x2 - x1 >= 6 and y2 - y1 >= 6 and (x2 - x1) / (y2 - y1) between 0.28 and 7 and (x2 - x1) * (y2 - y1) <= 0.45 * 640 * 360""")
def _(t):
    return t.v_boxes.where(G.plausible_box(*box(), frame_area=640.0 * 360.0)).select("frame", "box_no")


@query("fn_24", """select frame, box_no, round(least(greatest(x1 + 16.25, 0), 640), 1) as x1, round(least(greatest(y1 - 8.75, 0), 360), 1) as y1, round(least(greatest(x2 + 16.25, 0), 640), 1) as x2, round(least(greatest(y2 - 8.75, 0), 360), 1) as y2 from v_boxes""")
def _(t):
    return t.v_boxes.select("frame", "box_no", *(v.alias(n) for v, n in zip(G.moved_and_clipped(box(), F.lit(16.25), F.lit(-8.75), 640.0, 360.0), B)))


@query("fn_25", """select event_id, case k % 6 when 0 then 'face' when 1 then 'license_plate' when 2 then 'license_plate' when 3 then 'face' end as kind from v_events""")
def _(t):
    labels = ["Human-Face", "License Plate", "number_plate", " FACES ", "car", "person"]
    return t.v_events.select("event_id", S.privacy_kind(F.element_at(F.array(*map(F.lit, labels)), F.col("k") % 6 + 1)).alias("kind"))


@query("fn_26", """select frame, box_no, w >= 4 and h >= 4 and case when cls = 0 then w / h between 0.45 and 2 and w * h / (1920 * 1080) <= 0.01 and w / 1920 <= 0.18 and h / 1080 <= 0.25
  when cls = 1 then w / h between 1.5 and 7 and w * h / (1920 * 1080) <= 0.0045 and w / 1920 <= 0.22 and h / 1080 <= 0.09 else false end as valid,
  greatest(x1 + w / 2 - w * 0.75e0, 0) as gx1, least(y1 + h / 2 + h * 0.75e0, 1080) as gy2 from (select *, x2 - x1 as w, y2 - y1 as h from v_boxes)""")
def _(t):
    kind = F.when(F.col("cls") == 0, "face").when(F.col("cls") == 1, "license_plate")
    grown = G.grown(box(), 1.5, 1920.0, 1080.0)
    return t.v_boxes.select("frame", "box_no", G.privacy_box(kind, box(), 1920.0, 1080.0).alias("valid"), grown[0].alias("gx1"), grown[3].alias("gy2"))


@query("fn_27", """select frame, box_no from v_boxes where (x1 + x2) / 2 / 1920 >= 0.1 and (x1 + x2) / 2 / 1920 < 0.5 and (y1 + y2) / 2 / 1080 >= 0.05 and (y1 + y2) / 2 / 1080 < 0.4""")
def _(t):
    area = t.spark.range(1).select(G.region(F.lit("0.1,0.05;0.5,0.05;0.5,0.4;0.1,0.4")).alias("area"))
    return t.v_boxes.crossJoin(F.broadcast(area)).where(G.inside(F.col("area"), (F.col("x1") + F.col("x2")) / 2 / 1920, (F.col("y1") + F.col("y2")) / 2 / 1080)).select("frame", "box_no")


@query("fn_28", """select id, round((lon + 180) / 360 * 32768, 6) as fx, round((1 - asinh(tan(radians(lat))) / pi()) / 2 * 32768, 6) as fy, floor((lon + 180) / 360 * 32768) / 32768 * 360 - 180 as west from v_cams""")
def _(t):
    fx, fy = G.tile_fraction(F.col("lat"), F.col("lon"), 15)
    return t.v_cams.select("id", F.round(fx, 6).alias("fx"), F.round(fy, 6).alias("fy"), G.tile_bounds(F.floor(fx), F.floor(fy), 15)[0].alias("west"))


@query("fn_29", """select id, n as corner, round(lon + 60 * cos(n * (2 * pi() / 6)) / (111320 * cos(radians(lat))), 9) as lon, round(lat + 60 * sin(n * (2 * pi() / 6)) / 110540, 9) as lat from v_cams cross join series11 where n <= 6 and lat is not null""")
def _(t):
    rings = t.v_cams.where("lat is not null").select("id", F.posexplode(G.ring(F.col("lat"), F.col("lon"), F.lit(60.0), 6)).alias("corner", "p"))
    return rings.select("id", F.col("corner").cast("int").alias("corner"), F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query("fn_30", """select frame, box_no, round(least(greatest(x1 + least(greatest(30 * s, -0.4 * w), 0.4 * w), 0), 640), 6) as px1, round(least(greatest(y1 + least(greatest(10 * s, -0.32 * h), 0.32 * h), 0), 360), 6) as py1
  from (select *, greatest(x2 - x1, 2) as w, greatest(y2 - y1, 2) as h, 0.12e0 / 0.18e0 as s from v_boxes)""")
def _(t):
    moved = G.projected(box(), F.lit(30.0), F.lit(10.0), 0.12, 0.18, 640.0, 360.0)
    return t.v_boxes.select("frame", "box_no", F.round(moved[0], 6).alias("px1"), F.round(moved[1], 6).alias("py1"))


@query("fn_31", """select event_id, case when k < 5 then 0 when k < 15 then 1 when k < 25 then 2 when k < 40 then 3 else 4 end as marker, case when k < 10 then 0 when k < 20 then 1 when k < 30 then 2 when k < 45 then 3 else 4 end as pole,
  case when k < 5 then 0 when k < 25 then 1 when k < 50 then 2 when k < 75 then 3 else 4 end as wheel from v_events""")
def _(t):
    k = F.col("k")
    return t.v_events.select("event_id", S.level_of(k, (5, 15, 25, 40)).alias("marker"), S.level_of(k, (10, 20, 30, 45)).alias("pole"), S.level_of(k / 100, (0.05, 0.25, 0.5, 0.75)).alias("wheel"))


@query("fn_32", """select id, n as stripe, 25e0 + (n - 1) * 20 as low, 25e0 + (n - 1) * 20 + 10 as high, 25e0 + (n - 1) * 20 + 5 as centre from v_cams cross join series11 where n between 1 and 5""")
def _(t):
    low = F.lit(25.0) + (F.col("stripe") - 1) * 20
    return t.v_cams.select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("stripe")).select("id", "stripe", low.alias("low"), (low + 10).alias("high"), (low + 5).alias("centre"))


@query("fn_33", """select name, sha256('[' || string_agg('{"id":"' || id || '"' || coalesce(',"lat":' || cast(round(lat, 7) as varchar), '') || coalesce(',"lon":' || cast(round(lon, 7) as varchar), '') || '}', ',' order by id) || ']') as signature from v_cams group by name""")
def _(t):
    rows = F.collect_list(F.struct("id", "c_custkey", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon")))  # ids may repeat
    return t.v_cams.groupBy("name").agg(S.signature(rows, ["id", "lat", "lon"]).alias("signature"))
