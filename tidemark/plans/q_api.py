"""The user-facing queries (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import terrain as T
from tidemark.plans import api as A
from tidemark.plans.q_core import CHANGES, END_US, GATE, LATEST, START_US, consensus_sql, named, stage_list_sql
from tidemark.plans.q_boxes import SAME, matches_sql, scores_sql
from tidemark.plans.q_labels import text_sql
from tidemark.plans.q_places import FLAT, IDW, MARKERS, NEAREST, rain_points
from tidemark.plans.q_terrain import HISTORY, HOLES, roads
from tidemark.plans.registry import query


@query("q_01", f"""with c as ({CHANGES.format(least=1)}), top as (select * from c order by us desc, id desc limit 200), n as (select * from (select *, row_number() over (partition by name order by id desc) as rank from v_cams) where rank = 1)
select t.id, t.camera_id, t.level, t.us, coalesce(i.name, n.name, f.camera_name) as display_name, coalesce(i.address, n.address) as address, case when i.id is not null then 'id' when n.id is not null then 'name' else 'none' end as matched_by
from top t join v_flood f on f.id = t.id left join v_cams i on i.id = t.camera_id left join n on n.name = f.camera_name""")
def _(t):
    return A.events(t.v_flood, t.v_cams, 200, 1, True).select("id", "camera_id", "level", "us", "display_name", "address", "matched_by")


PLAUSIBLE = "x2 - x1 >= 6 and y2 - y1 >= 6 and (x2 - x1) / (y2 - y1) between 0.28 and 7 and (x2 - x1) * (y2 - y1) <= 0.45 * 1920 * 1080"
DROP = "(fd.lv = ev.level and ev.t_us - fd.at < 10000000)"
BUCKETED = f"""b as (select sensor_type, sensor_id, us // 3600000000 * 3600000000 as bucket, arg_max(value, {{'u': us, 'i': id}}) as value, false as previous from v_env where us between {START_US} and {END_US} group by 1, 2, 3
union all select sensor_type, sensor_id, max(us), arg_max(value, {{'u': us, 'i': id}}), true from v_env where us < {START_US} group by 1, 2)"""


@query("q_02", f"""with {NEAREST}, {BUCKETED}, inside as (select *, us // 3600000000 * 3600000000 as bucket from v_flood where us between {START_US} and {END_US}), bs as ({consensus_sql("inside", "camera_id, bucket")}), bl as (select camera_id, bucket, arg_max(id, {{'u': us, 'i': id}}) as last_id from inside group by 1, 2),
bk as (select bs.camera_id, bs.bucket as us, stage as level, last_id as id from bs join bl on bl.camera_id = bs.camera_id and bl.bucket = bs.bucket),
edges as (select * from bk union all select camera_id, {START_US}, arg_max(level, {{'u': us, 'i': id}}), 0 from v_flood where us < {START_US} and {START_US} - us <= 86400000000 group by camera_id union all select camera_id, {END_US}, arg_max(level, {{'u': us, 'i': id}}), 0 from bk where {END_US} - us <= 86400000000 group by camera_id having max(us) < {END_US}),
sensed as (select near.id as camera_id, greatest(bucket, {START_US}) as us, near.sensor_type as series, arg_min(value, cast(previous as int)) as value from near join b on b.sensor_type = near.sensor_type and b.sensor_id = near.sensor_id group by 1, 2, 3),
seen as (select camera_id, us, 'stage' as series, max(level) * 1e0 as value from edges group by 1, 2 union all select camera_id, us, series, value from sensed), wide as (select camera_id, us, {", ".join(f"max(case when series = '{n}' then value end) as {n}" for n in ("stage", "rain", "sewer", "river"))} from seen group by 1, 2)
select camera_id, us, {", ".join(f"last_value({n} ignore nulls) over (partition by camera_id order by us rows between unbounded preceding and current row) as {n}" for n in ("stage", "rain", "sewer", "river"))} from wide""")
def _(t):
    return A.history(t.v_flood, t.v_cams, t.v_env, START_US, END_US, 60, 86400)


@query("q_03", stage_list_sql(150, "CAM-9000", "Test camera"))
def _(t):
    return A.current_stages(named(t), END_US, 86400, 36000, 150, "CAM-9000", "Test camera")


NOW = MARKERS.format(stored="stored", named="(select '' as camera_name, 0 as stage where false)", trusted="true", since=END_US - 15_000_000, end=END_US, rain=IDW.format(radius=35000))


@query("q_04", LATEST.format(key="camera_id") + f""", best as ({consensus_sql("top", "camera_id")}), stored as (select b.camera_id, cast(case when n.vehicles >= 2 then n.level else stage end as int) as stage from best b join top n on n.camera_id = b.camera_id and n.rank = 1),
near as (select id, round(max((0.35e0 + 0.65e0 * stage / 4) * recency * exp(-pow(d / 220, 2))), 6) as influence from (select c.id, p.stage, p.recency, {FLAT.format(lat1='c.lat', lon1='c.lon', lat2='lat5', lon2='lon5')} as d from v_cams c cross join {HISTORY} p where c.lat is not null) where d <= 700 group by 1)
select m.*, coalesce(influence, 0) as influence from {NOW} m left join near on near.id = m.id""")
def _(t):
    found = A.map_overlay(t.v_cams, t.v_flood.withColumn("vehicles", F.col("k") % 4), rain_points(t), END_US, 86400, 36000)
    return found.withColumns({c: F.round(c, 6) for c in ("rain_mm", "influence")})


@query("q_04_surface")
def _(t):
    """The ground is given by tiles of two zooms around the markers; roads and streams are lines near every fourth."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "KMA").otherwise("CCTV").alias("kind")
    marks = t.v_cams.where("lat is not null").select("id", "lat", "lon", (k % 5).alias("stage"), (k % 7 * 5.0).alias("rain_mm"), (k % 3 * 10.0).alias("depth_cm"), kind)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    tiles = T.tile_of(marks.withColumn("z", F.explode(F.array(F.lit(12), F.lit(14))))).select("z", "x", "y").withColumn("i", around).withColumn("j", around)
    tiles = tiles.select("z", (F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y")).distinct().where(f"z = 12 or {HOLES}")
    height = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda p: (p % 16 + F.floor(p / 16) + F.col("x") % 2 * 16 + F.col("y") % 2 * 16) * 0.1)
    past = T.history_points(t.v_flood, t.v_cams, END_US).select(F.col("lat5").alias("plat"), F.col("lon5").alias("plon"), "stage", "recency")
    layers, report = A.flood_surface(marks, tiles.withColumn("elev", height), [12, 14], 16, roads(t), roads(t, 2e-3), past)
    return layers.join(report, ["source_id", "rank"]).drop("rank")


@query("q_05", f"with {NEAREST}, {BUCKETED} select near.id, near.sensor_type, near.sensor_id, metres, bucket as us, value, previous from near join b on b.sensor_type = near.sensor_type and b.sensor_id = near.sensor_id")
def _(t):
    return A.environment_history(t.v_cams, t.v_env, START_US, END_US, 60)


@query("q_07", """with u as (select id, sensor_type, sensor_id, us // 86400000000 as day from v_env) select min(id) as id, sensor_type, sensor_id, day from u where id % 2 = 0 and (sensor_type, sensor_id, day) not in (select sensor_type, sensor_id, day from u where id % 2 = 1) group by 2, 3, 4""")
def _(t):
    days = t.v_env.withColumn("us", F.expr("us div 86400000000 * 1000000"))
    fresh, _ = A.ingest_environment(days.where("id % 2 = 0"), days.where("id % 2 = 1"))
    return fresh.select("id", "sensor_type", "sensor_id", F.col("second").alias("day"))


@query("q_08", f"""with recursive good as (select * from v_boxes where {PLAUSIBLE}), nf as (select *, row_number() over (partition by frame order by conf desc, box_no) as rn from good),
nr as (select f.frame, f.rn, coalesce(list(k.rn) filter (where k.rn is not null), []) as near from nf f left join nf k on f.frame = k.frame and f.rn > k.rn and {SAME} group by 1, 2),
sup as (select frame, rn, [rn] as kept, true as stays from nf where rn = 1 union all select nr.frame, nr.rn, case when len(list_intersect(sup.kept, near)) > 0 then sup.kept else list_append(sup.kept, nr.rn) end, len(list_intersect(sup.kept, near)) = 0 from sup join nr on nr.frame = sup.frame and nr.rn = sup.rn + 1),
kept as (select nf.* from nf join sup on sup.frame = nf.frame and sup.rn = nf.rn where stays), ct as (select cam, frame, count(*) filter (where cls > 0) as positive, count(*) as total from kept group by 1, 2), bs as ({consensus_sql("kept", "cam, frame", "cls", "conf")}),
fr as (select 'CAM-' || cast(ct.cam as varchar) as camera_id, ct.frame as event_id, ct.frame * 400000 as t_us, stage, round(stage_confidence, 6) as confidence, positive as positive_votes, total as total_votes from ct join bs on bs.cam = ct.cam and bs.frame = ct.frame), {GATE.replace("v_frames", "fr")[len("with "):]},
ev as (select event_id, g.camera_id, g.stage as level, confidence, g.t_us, '{{"level_label":"Lev' || cast(g.stage as varchar) || '","detections":' || cast(total_votes as varchar) || ',"positive_confirmed":' || cast(accepted as varchar) || ',"reason":"' || reason || '"}}' as details, row_number() over (partition by g.camera_id order by g.t_us, event_id) as rn from g join fr using (event_id) where g.stage = 0 or accepted),
fd as (select camera_id, rn, event_id, t_us as at, level as lv, true as taken from ev where rn = 1 union all select ev.camera_id, ev.rn, ev.event_id, case when {DROP} then fd.at else ev.t_us end, case when {DROP} then fd.lv else ev.level end, not ({DROP}) from ev join fd on ev.camera_id = fd.camera_id and ev.rn = fd.rn + 1)
select ev.event_id, ev.camera_id, ev.level, confidence, make_timestamp(t_us) as at, details from fd join ev on ev.event_id = fd.event_id where taken""")
def _(t):
    return A.frames_to_events(t.v_boxes.withColumn("t_us", F.col("frame") * 400_000))


M = "(select *, 'm' || cast(box_no % 2 as varchar) as model from v_boxes)"
G = "(select g.*, x as model from v_truth g, (select 'm0' as x union all select 'm1'))"


@query("q_09", f"""with recursive {matches_sql(M, G, "model, frame")}, s as ({scores_sql(G, "model")}), lat as (select model, quantile_cont(l_quantity, 0.5) as median_ms, 1000 / avg(l_quantity) as fps from {M} group by model),
h as (select g.model, g.frame, g.box_no, greatest(g.x1, p.x1) as a, least(g.x2, p.x2) as b, greatest(g.y1, p.y1) as c, least(g.y2, p.y2) as d from {G} g join {M} p on p.model = g.model and p.frame = g.frame and p.x1 < g.x2 and p.x2 > g.x1 and p.y1 < g.y2 and p.y2 > g.y1),
l as (select model, frame, box_no, a, b, unnest(generate_series(cast(ceil(c) as bigint), cast(ceil(d) as bigint) - 1)) as y from h), w as (select *, max(b) over (partition by model, frame, box_no, y order by a, b rows between unbounded preceding and 1 preceding) as reach from l), k as (select model, frame, box_no, sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) as covered from w group by 1, 2, 3),
v as (select g.model, round(avg(case when (x2 - x1) * (y2 - y1) > 0 then coalesce(covered, 0) / ((x2 - x1) * (y2 - y1)) else 0 end), 9) as coverage from {G} g left join k on k.model = g.model and k.frame = g.frame and k.box_no = g.box_no group by 1)
select lat.*, precision, recall, f1, miss_rate, coverage from lat left join s on s.model = lat.model left join v on v.model = lat.model""")
def _(t):
    p = t.v_boxes.withColumn("model", F.concat(F.lit("m"), (F.col("box_no") % 2).cast("string")))
    frames = p.select("model", "frame", F.col("l_quantity").alias("ms"))
    found = A.detector_benchmark(p.select("model", "frame", "box_no", "x1", "y1", "x2", "y2", "conf"), t.v_truth.select("frame", "box_no", "x1", "y1", "x2", "y2"), frames)
    return found.withColumn("coverage", F.round("coverage", 9))


@query("q_10", f"""with g as (select cam, row_number() over (order by md5('s5' || cast(cam as varchar)), cam) as rank from (select distinct cam from v_boxes)) select frame, case when rank <= greatest(1, floor(0.2 * (select count(*) from g))) then 'val' else 'train' end as split, boxes, lines from {text_sql(900, 600)} x join g on g.cam = x.cam""")
def _(t):
    return A.prepare_dataset(t.v_boxes, 900.0, 600.0, "s5")
