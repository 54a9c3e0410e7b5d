"""Queries of catalogs, sensors and observations (JN, AG, ST, SN, SC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import catalog as J
from tidemark.operators import consensus as C
from tidemark.operators import environment as E
from tidemark.plans.q_core import END_US, START_US, consensus_sql
from tidemark.plans.registry import query

FLAT = "sqrt(pow(({lon2} - {lon1}) * 111320 * cos(radians(({lat1} + {lat2}) / 2)), 2) + pow(({lat2} - {lat1}) * 110540, 2))"
HAVERSINE = "2 * 6371000e0 * atan2(sqrt({a}), sqrt(1 - {a}))".format(a="(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))")


@query("jn_01", """with i as (select *, regexp_replace(lower(id), '[^a-z0-9]', '', 'g') as key from v_cams), n as (select * from (select *, row_number() over (partition by name order by id desc) as rank from v_cams) where rank = 1)
select e.id, coalesce(i.name, n.name, e.camera_name) as display_name, coalesce(i.address, n.address) as address, case when i.id is not null then i.lat else n.lat end as lat, case when i.id is not null then 'id' when n.id is not null then 'name' else 'none' end as matched_by
from (select *, case when id % 3 = 0 then 'X' || camera_id else camera_id end as cid from v_flood) e left join i on i.key = regexp_replace(lower(e.cid), '[^a-z0-9]', '', 'g') left join n on n.name = e.camera_name""")
def _(t):
    events = t.v_flood.withColumn("camera_id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("X"), "camera_id")).otherwise(F.col("camera_id")))
    return J.enrich(events, t.v_cams).select("id", "display_name", "address", "lat", "matched_by")


@query("jn_02", """with k as (select regexp_replace(lower(key), '[^a-z0-9]', '', 'g') as key, max(id) as id from (select id, id as key from v_cams union all select id, name from v_cams union all select id, address from v_cams) group by 1)
select key, id from k union all select 'cctv' || cast(c_custkey as varchar), 'CAM-' || lpad(cast(c_custkey as varchar), 4, '0') from v_cams where c_custkey % 10 = 0""")
def _(t):
    ten = t.v_cams.where("c_custkey % 10 = 0")
    aliases = ten.select(F.concat(F.lit("CCTV "), F.col("c_custkey").cast("string")).alias("alias"), "id").unionByName(ten.select(F.col("name").alias("alias"), "id"))
    return J.key_table(t.v_cams, aliases)


@query("jn_03", """select id from v_flood where camera_id in ('CAM-0003', 'CAM-0007') or camera_name in ('Cam 3', 'Cam 5')""")
def _(t):
    aliases = t.spark.createDataFrame([(x,) for x in ("CAM-0003", "CAM-0007", "Cam 3", "Cam 5")], "alias string")
    return J.of_aliases(t.v_flood, aliases).select("id")


CANDIDATES = f"select sensor_type, sensor_id, max(sensor_name) as sensor_name, max(lat) as lat, max(lon) as lon, max(us) as last_us from v_env where us <= {END_US} group by sensor_type, sensor_id"


@query("ag_05", CANDIDATES)
def _(t):
    return J.sensor_candidates(t.v_env, END_US)


NEAREST = f"""c as ({CANDIDATES}), u as (select * from (select *, bool_or(last_us >= {START_US}) over (partition by sensor_type) as any_ from c) where last_us >= {START_US} or not any_),
p as (select id, sensor_type, sensor_id, metres from (select *, row_number() over (partition by id, sensor_type order by metres, sensor_id) as rank from (select v.id, s.sensor_type, s.sensor_id, round({HAVERSINE}, 1) as metres from v_cams v cross join (select sensor_type, sensor_id, lat as slat, lon as slon from u where lat is not null) s where v.lat is not null)) where rank = 1),
w as (select sensor_type, sensor_id from (select *, row_number() over (partition by sensor_type order by last_us desc, sensor_id desc) as rank from u) where rank = 1),
near as (select v.id, w.sensor_type, coalesce(p.sensor_id, w.sensor_id) as sensor_id, p.metres from v_cams v cross join w left join p on p.id = v.id and p.sensor_type = w.sensor_type)"""


@query("jn_04", f"with {NEAREST} select * from near")
def _(t):
    return J.nearest_sensor(t.v_cams, J.sensor_candidates(t.v_env, END_US), START_US)


RAIN_POINTS = "(select lat as plat, lon as plon, avg(value) as rain_mm from v_env where lat is not null and sensor_type = 'rain' group by lat, lon)"
IDW = f"""(select v.id, coalesce(round(sum(rain_mm / pow(greatest(m, 400), 2)) / sum(1 / pow(greatest(m, 400), 2)), 6), 0) as rain_mm from v_cams v left join (select * from (select v.id, rain_mm, {FLAT.format(lat1='v.lat', lon1='v.lon', lat2='plat', lon2='plon')} as m from v_cams v cross join {RAIN_POINTS} where v.lat is not null) where m <= {{radius}}) p on p.id = v.id group by v.id)"""


def rain_points(t):
    """Means over exact sums, so their last digits do not depend on the order of the readings."""
    mean = F.sum(F.col("value").cast("decimal(28,9)")).cast("double") / F.count("value")
    return t.v_env.where("lat is not null and sensor_type = 'rain'").groupBy("lat", "lon").agg(mean.alias("rain_mm"))


@query("jn_05", f"select * from {IDW.format(radius=35000)}")
def _(t):
    return J.idw_rain(t.v_cams, rain_points(t)).withColumn("rain_mm", F.round("rain_mm", 6))


@query("jn_05_near", f"select * from {IDW.format(radius=3000)}")
def _(t):
    return J.idw_rain(t.v_cams, rain_points(t), radius_m=3000.0).withColumn("rain_mm", F.round("rain_mm", 6))


@query("jn_06", f"""select sensor_type, sensor_id, max(us) as us, arg_max(value, us) as value from v_env where us < {START_US} group by sensor_type, sensor_id""")
def _(t):
    return J.previous_reading(t.v_env, START_US, first=True)  # arg_max keeps the first row of a tie


@query("jn_06_many", """select user_id, id, us, previous from (select user_id, id, us, side, last_value(v ignore nulls) over (partition by user_id order by us, side rows between unbounded preceding and 1 preceding) as previous from (select user_id, us, 1 as side, value as v, null as id from v_env union all select user_id, us, 0, null, id from v_flood)) where side = 0""")
def _(t):
    return J.as_of(t.v_flood, t.v_env, "user_id")


MARKERS = """(select c.id, c.lat, c.lon, cast(coalesce(l.stage, s.stage, m.stage, 0) as int) as stage, case when l.stage is not null then 'live' when coalesce(s.stage, m.stage) is not null then 'stored' else 'none' end as stage_from, coalesce(r.rain_mm, 0) as rain_mm
from v_cams c left join {stored} s on s.camera_id = c.id left join {named} m on m.camera_name = c.name and {trusted} left join (select camera_id, arg_max(level, {{'u': us, 'l': level}}) as stage from v_flood where us between {since} and {end} and record_source = 'foreground' group by camera_id) l on l.camera_id = c.id left join {rain} r on r.id = c.id)"""


@query("jn_07", "select * from " + MARKERS.format(stored=f"(select camera_id, arg_max(level, us) as stage from v_flood where us <= {END_US} and camera_id < 'CAM-0040' group by camera_id)", named=f"(select camera_name, arg_max(level, {{{{'u': us, 'i': id}}}}) as stage from v_flood where us <= {END_US} group by camera_name)".replace("{{", "{").replace("}}", "}"), trusted="c.c_custkey % 7 = 0", since=END_US - 86400000000, end=END_US, rain=IDW.format(radius=35000)))
def _(t):
    past = t.v_flood.where(F.col("us") <= END_US)
    stored = past.where("camera_id < 'CAM-0040'").groupBy("camera_id").agg(F.max_by("level", "us").alias("stage"))
    named = past.groupBy("camera_name").agg(F.max_by("level", F.struct("us", "id")).alias("stage"))
    live = t.v_flood.where("record_source = 'foreground'").withColumnRenamed("level", "stage")
    rain = J.idw_rain(t.v_cams, rain_points(t)).withColumn("rain_mm", F.round("rain_mm", 6))
    return J.markers(t.v_cams, stored, live, END_US, rain, 86400, named, F.col("c_custkey") % 7 == 0)


SNAPSHOTS = "(select *, us // 21600000000 as snapshot, case when k % 4 = 0 then -1e0 else value end as rain_mm from (select *, id % 100 as k from v_env))"


@query("jn_08", f"""with x as (select * from {SNAPSHOTS} where sensor_type = 'rain'), g as (select * from x where user_id % 2 = 0 and rain_mm >= 0) select id, snapshot, rain_mm, 'grid' as origin from g union all select id, snapshot, rain_mm, 'station' from x where user_id % 2 = 1 and snapshot not in (select snapshot from g)""")
def _(t):
    rows = t.v_env.where("sensor_type = 'rain'").withColumn("snapshot", F.expr("us div 21600000000")).withColumn("rain_mm", F.when(F.col("id") % 100 % 4 == 0, -1.0).otherwise(F.col("value")))
    pick = rows.select("id", "snapshot", "rain_mm", "user_id")
    return J.grid_or_station(pick.where("user_id % 2 = 0").drop("user_id"), pick.where("user_id % 2 = 1").drop("user_id"))


@query("jn_09", """with i as (select distinct cam, frame from v_boxes where cls < 3), l as (select distinct cam, frame from v_boxes where cls > 1) select coalesce(i.cam, l.cam) as cam, coalesce(i.frame, l.frame) as frame, case when i.frame is null then 'label_only' when l.frame is null then 'image_only' else 'paired' end as status from i full outer join l on i.cam = l.cam and i.frame = l.frame""")
def _(t):
    return J.pair_files(t.v_boxes.where("cls < 3"), t.v_boxes.where("cls > 1"), ["cam", "frame"])


@query("jn_10", """with i as (select distinct cam as camera, frame as file from v_boxes where cls < 3), l as (select distinct cam as camera, frame as file from v_boxes where cls = 4 and cam % 4 > 0) select i.camera, i.file, case when l.file is not null then 'paired' when i.camera in (select camera from l) then 'no_label' else 'unknown_camera' end as status from i left join l on i.camera = l.camera and i.file = l.file""")
def _(t):
    files = lambda where: t.v_boxes.where(where).select(F.col("cam").alias("camera"), F.col("frame").alias("file")).distinct()
    return J.pair_by_camera(files("cls < 3"), files("cls = 4 and cam % 4 > 0"))


@query("jn_15", """with t as (select id, level as stage, confidence as stage_conf from v_flood), u as (select id, case when k % 2 = 0 then k % 5 end as stage, k / 100e0 as stage_conf from v_flood where k % 3 = 0)
select t.id as track_id, coalesce(u.stage, t.stage) as stage, case when u.stage is not null then u.stage_conf else t.stage_conf end as stage_conf, u.id is not null and u.stage is null as stale from t left join u on t.id = u.id""")
def _(t):
    tracks = t.v_flood.select(F.col("id").alias("track_id"), F.col("level").alias("stage"), F.col("confidence").alias("stage_conf"))
    updates = t.v_flood.where("k % 3 = 0").select(F.col("id").alias("track_id"), F.when(F.col("k") % 2 == 0, F.col("k") % 5).alias("stage"), (F.col("k") / 100).alias("stage_conf"))
    return J.merge_stage(tracks, updates)


@query("st_01", """select sensor_type, sensor_id, sensor_name, case when sensor_type = 'rain' then greatest(0, value - 5) else value - 5 end as value, case when sensor_type = 'rain' then 'mm' else 'm' end as unit, id from v_env""")
def _(t):
    e = t.v_env.withColumn("value", F.col("value") - 5)
    return E.unified(*(e.where(F.col("sensor_type") == n) for n in ("rain", "sewer", "river"))).select("sensor_type", "sensor_id", "sensor_name", "value", "unit", "id")




@query("st_02", """select min(id) as id, sensor_type, sensor_id, us // 3600000000 as hour from v_env group by sensor_type, sensor_id, us // 3600000000""")
def _(t):
    hours = t.v_env.withColumn("us", F.expr("us div 3600000000 * 1000000"))
    return E.first_of_duplicates(hours).select("id", "sensor_type", "sensor_id", F.col("second").alias("hour"))


@query("sn_02", """with b as (select min(id) as id, sensor_type, sensor_id, us // 86400000000 as day from v_env where id % 2 = 0 group by 2, 3, 4) select id from b where (sensor_type, sensor_id, day) not in (select sensor_type, sensor_id, us // 86400000000 from v_env where id % 2 = 1)""")
def _(t):
    days = t.v_env.withColumn("us", F.expr("us div 86400000000 * 1000000"))
    return E.new_rows(days.where("id % 2 = 0"), days.where("id % 2 = 1")).select("id")


@query("sn_03", f"""select id, us from v_env where us < {START_US} order by id limit 500""")
def _(t):
    return E.expired(t.v_env, START_US, 500).select("id", "us")


@query("sn_03_kept", f"""select id from v_env where id not in (select id from v_env where us < {START_US} order by id limit 500)""")
def _(t):
    return E.retained(t.v_env, START_US, 500).select("id")


@query("ag_08", """select sensor_type, sensor_id, us // 1800000000 * 1800000000 as bucket_us, arg_max(value, {'u': us, 'i': id}) as value, arg_max(id, {'u': us, 'i': id}) as id from v_env group by 1, 2, 3""")
def _(t):
    return E.last_per_bucket(t.v_env, 30)


@query("sc_09", """select sensor_id, max(time) as time, arg_max(value, time || lpad(cast(id as varchar), 9, '0')) as value from (select *, strftime(observed_at, '%Y%m%d%H') as time from v_env) group by sensor_id""")
def _(t):
    return E.newest_per_station(t.v_env.withColumn("time", F.date_format("observed_at", "yyyyMMddHH")), "sensor_id", "time", "id")


@query("ag_13", """with d as (select *, us // 86400000000 as day from v_env), f as (select sensor_type, count(*) as stored from (select distinct sensor_type, sensor_id, day from d where id % 2 = 0) x where (sensor_type, sensor_id, day) not in (select sensor_type, sensor_id, day from d where id % 2 = 1) group by sensor_type)
select b.sensor_type, received, coalesce(stored, 0) as stored, received - coalesce(stored, 0) as duplicates from (select sensor_type, count(*) as received from d where id % 2 = 0 group by sensor_type) b left join f on f.sensor_type = b.sensor_type""")
def _(t):
    days = t.v_env.withColumn("us", F.expr("us div 86400000000 * 1000000"))
    return E.ingest_report(days.where("id % 2 = 0"), days.where("id % 2 = 1"))


@query("ag_14", """select us // 86400000000 as cycle, count(*) as processed, count(*) filter (where event_type <> 'error') as success, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type <> 'error' and k > 20) as stored, max(us) as last_us,
array_to_string(list_slice(list(event_id order by us, event_id) filter (where event_type = 'error'), -20, -1), ',') as last_errors from v_events group by 1""")
def _(t):
    rows = t.v_events.withColumn("cycle", F.expr("us div 86400000000")).withColumn("ok", F.col("event_type") != "error").withColumn("saved", F.col("k") > 20)
    return E.cycle_rollup(rows, "cycle", "ok", "saved", "us", "event_id").withColumnRenamed("last_time", "last_us")


@query("ag_11", f"""select snapshot, max(rain_mm) filter (where rain_mm >= 0) as max_rain_mm, max(us) filter (where rain_mm >= 0) as latest_us, count(*) filter (where rain_mm >= 0) as valid_points, count(*) as total_points, bool_or(rain_mm < 0) as partial from {SNAPSHOTS} group by snapshot""")
def _(t):
    rows = t.v_env.withColumn("snapshot", F.expr("us div 21600000000")).withColumn("rain_mm", F.when(F.col("id") % 100 % 4 == 0, -1.0).otherwise(F.col("value")))
    return E.rain_grid_summary(rows, ["snapshot"])


@query("st_03", """with o as (select sensor_id, us // 3600000000 as hour, value, id, id % 2 as fresh from v_env), one as (select * from (select *, row_number() over (partition by sensor_id, hour order by fresh desc, id desc) as rank from o) where rank = 1) select sensor_id, hour, id from (select *, row_number() over (partition by sensor_id order by hour desc) as r2 from one) where r2 <= 20""")
def _(t):
    o = t.v_env.select("sensor_id", F.expr("us div 3600000000").alias("hour"), "value", "id")
    return E.overlay(o.where("id % 2 = 0"), o.where("id % 2 = 1"), ["sensor_id"], "hour", 20).select("sensor_id", "hour", "id")


@query("st_04", """select -1 as c_custkey, 'TEST' as id, 0 as ordinal union all select c_custkey, id, 1 from v_cams where c_custkey <> 7""")
def _(t):
    test = t.spark.sql("select cast(-1 as bigint) as c_custkey, 'TEST' as id, 0 as ordinal")
    return test.unionByName(t.v_cams.where("c_custkey <> 7").select("c_custkey", "id", F.lit(1).alias("ordinal")))


@query("ss_11", f"""select sensor_type, sensor_id, ({END_US} - max(us)) / 1e6 as age_s, ({END_US} - max(us)) / 1e6 > 86400 as stale from v_env where us <= {END_US} group by 1, 2""")
def _(t):
    return E.stale(t.v_env, ["sensor_type", "sensor_id"], END_US, 86400)


@query("tk_09", """select user_id, max(hour) as hour from (select user_id, us // 3600000000 - us // 3600000000 % 4 as hour from v_events) where (user_id, hour) in (select user_id, us // 3600000000 from v_env) group by user_id""")
def _(t):
    hour = F.expr("us div 3600000000")
    return E.latest_issue(t.v_events.select("user_id", (hour - hour % 4).alias("hour")), t.v_env.select("user_id", hour.alias("hour")), ["user_id"], "hour")


CATEGORIES = "case k % 5 when 0 then 'RN1' when 1 then 'T1H' when 2 then 'REH' when 3 then 'WSD' else 'PTY' end"


@query("sc_06", f"""select user_id, base, {", ".join(f'max(case when c = {chr(39)}{n}{chr(39)} then value end) as "{n}"' for n in ("RN1", "T1H", "REH", "WSD", "PTY"))} from (select *, us // 86400000000 as base, {CATEGORIES} as c from v_events) group by user_id, base""")
def _(t):
    rows = t.v_events.withColumn("base", F.expr("us div 86400000000")).withColumn("c", F.expr(CATEGORIES))
    return E.nowcast_wide(rows, ["user_id", "base"], "c", "value")


@query("sc_07", f"""select user_id, slot, rain_mm, kind from (select *, row_number() over (partition by user_id order by slot) as rank from (select user_id, us // 3600000000 * 3600000000 as slot, coalesce(max(case when c = 'RN1' then value end), 0) as rain_mm, coalesce(max(case when c = 'PTY' then cast(cast(trunc(value) as int) as varchar) end), 'none') as kind from (select *, {CATEGORIES} as c from v_events) where us // 3600000000 * 3600000000 >= {START_US} - 900000000 group by 1, 2)) where rank <= 6""")
def _(t):
    rows = t.v_events.withColumn("slot", F.expr("us div 3600000000 * 3600000000")).withColumn("c", F.expr(CATEGORIES))
    return E.forecast_rows(rows, ["user_id"], "slot", "c", "value", START_US)


@query("ag_37", """select count(c.id) as cameras, count(c.lat) as located, count(e.id) as cameras_in_events, count(*) filter (where c.id is null) as unknown_in_events, count(*) filter (where e.id is null) as without_events from v_cams c full outer join (select distinct camera_id as id from v_flood) e on e.id = c.id""")
def _(t):
    return E.catalog_report(t.v_cams, t.v_flood)


@query("ag_18", """select cls, count(*) - count(distinct frame) as duplicates from v_boxes group by cls""")
def _(t):
    return t.v_boxes.groupBy("cls").agg((F.count("frame") - F.count_distinct("frame")).alias("duplicates"))
