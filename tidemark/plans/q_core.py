"""Queries of voting (AG) and of operators along time (WN, TK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import consensus as C
from tidemark.operators import sequences as Q
from tidemark.plans.registry import query

END_US = 1706572800000000  # 2024-01-30 00:00
START_US = END_US - 4 * 86_400_000_000
START, END = "2024-01-26 00:00:00", "2024-01-30 00:00:00"


def consensus_sql(rows: str, keys: str, level: str = "level", conf: str = "confidence") -> str:
    return f"""select {keys}, cast(level as int) as stage, a as stage_confidence, votes from (select *, row_number() over (partition by {keys} order by n desc, a desc, level desc) as rank, cast(sum(n) over (partition by {keys}) as bigint) as votes
      from (select {keys}, {level} as level, count(*) as n, round(avg({conf}), 9) as a from {rows} group by {keys}, {level})) where rank = 1"""


@query("ag_01", consensus_sql("(select *, us // 3600000000 as hour from v_flood)", "camera_id, hour"))
def _(t):
    return C.consensus(t.v_flood.withColumn("hour", F.expr("us div 3600000000")), ["camera_id", "hour"])


VOTES = ", ".join(f"count(*) filter (where v and cls = {k}) as votes_lev{k}" for k in range(5))


@query("ag_02", f"""with b as (select *, conf >= 0.2 as v from v_boxes), best as ({consensus_sql("(select * from b where v)", "frame", "cls", "conf")})
select c.frame, {", ".join(f"c.votes_lev{k}" for k in range(5))}, c.total_votes, stage, round(stage_confidence, 6) as confidence from (select frame, {VOTES}, count(*) filter (where v) as total_votes from b group by frame) c left join best on best.frame = c.frame""")
def _(t):
    return C.frame_votes(t.v_boxes, ["frame"], "cls", "conf", F.col("conf") >= 0.2)


@query("ag_03", """select frame, cls as level, conf as confidence, n as boxes from (select *, count(*) over (partition by frame) as n, row_number() over (partition by frame order by cls desc, conf desc) as rank from v_boxes) where rank = 1""")
def _(t):
    return C.frame_summary(t.v_boxes, ["frame"], "cls", "conf")


@query("ag_04", f"""with best as ({consensus_sql("(select * from v_boxes where flag = 'R')", "frame, cam", "cls", "conf")}), bodies as (select frame, cam, max(cls) as body_stage, max(conf) as body_conf from v_boxes where flag <> 'R' and l_linenumber_ok group by frame, cam)
select coalesce(a.frame, b.frame) as frame, coalesce(a.cam, b.cam) as cam, cast(coalesce(stage, body_stage) as int) as stage, coalesce(stage_confidence, body_conf) as conf, case when stage is not null then 'tire' when body_stage is not null then 'car_body' else 'unclassified' end as stage_source
from best a full outer join bodies b on a.frame = b.frame and a.cam = b.cam""".replace("l_linenumber_ok", "conf >= 0.3"))
def _(t):
    bodies = t.v_boxes.where("flag <> 'R' and conf >= 0.3").groupBy("frame", "cam").agg(F.max("cls").alias("body_stage"), F.max("conf").alias("body_conf"))
    return C.vehicle_stage(t.v_boxes.where("flag = 'R'").withColumnRenamed("cls", "stage"), bodies, ["frame", "cam"])


SOURCE = "case when record_source in ('background', 'foreground') then record_source else 'legacy' end"


@query("ag_06", f"""with r as (select *, us // 3600000000 as bucket, {SOURCE} as src from v_flood), best as ({consensus_sql("r", "camera_id, bucket")})
select g.*, stage, round(stage_confidence, 6) as confidence from (select camera_id, bucket, count(*) as records, {", ".join(f"count(*) filter (where level = {k}) as votes_lev{k}" for k in range(5))},
case when min(src) = max(src) then min(src) else 'mixed' end as record_source, arg_max(id, us) as last_id, max(detected_at) as last_at from r group by camera_id, bucket) g join best on best.camera_id = g.camera_id and best.bucket = g.bucket""")
def _(t):
    return C.history_buckets(t.v_flood, ["camera_id"], F.expr("us div 3600000000"))


@query("ag_07", f"""select camera_id, count(*) filter (where s = 'background') as background, count(*) filter (where s = 'foreground') as foreground, count(*) filter (where s = 'legacy') as legacy from (select *, {SOURCE} as s from v_flood) group by camera_id""")
def _(t):
    return C.source_counts(t.v_flood, ["camera_id"])


LATEST = """with r as (select *, 1706572800000000 - us as age, k % 4 as vehicles from v_flood where us <= 1706572800000000 and (level = 0 or positive_confirmed)), top as (select * from (select *, row_number() over (partition by {key} order by us desc, id desc) as rank, min(age) over (partition by {key}) as newest from r where age <= 86400000000) where rank <= 5 and age - newest <= 36000000000)"""


NAMED = "(select *, case when user_id % 5 = 0 then '' else camera_id end as cid, case when user_id % 7 = 0 then '' when user_id % 5 = 0 then 'Old ' || camera_name else camera_name end as cname from v_flood)"


def stage_list_sql(limit: int, test_id: str, test_name: str) -> str:
    """Stages by id, by name where there is no id, and the test camera raised to its floor."""
    top = lambda key: f"(select * from (select *, row_number() over (partition by {key} order by us desc, id desc) as rank, max(us) over (partition by {key}) as newest from r where {key} <> '') where rank <= 5 and newest - us <= 36000000000)"
    best = lambda key, table: f"(select n.cid, n.cname, cast(case when n.vehicles >= 2 then n.level else stage end as int) as stage, round(case when n.vehicles >= 2 then n.confidence else stage_confidence end, 6) as confidence from ({consensus_sql(table, key)}) b join {table} n on n.{key} = b.{key} and n.rank = 1)"
    is_test = f"(cid = '{test_id}' or regexp_replace(lower(cname), '[^a-z0-9]', '', 'g') = regexp_replace(lower('{test_name}'), '[^a-z0-9]', '', 'g'))"
    return f"""with f as (select *, k % 4 as vehicles from {NAMED} where us <= {END_US} and {END_US} - us <= 86400000000 order by us desc, id desc limit {limit}),
r as (select * from f where level = 0 or positive_confirmed), i as {top("cid")}, n as {top("cname")}, bi as {best("cid", "i")}, bn as {best("cname", "n")},
u as (select cid, nullif(cname, '') as cname, stage, confidence, 'id' as origin from bi union all select null, cname, stage, confidence, 'name' from bn where cid = '' and cname not in (select cname from bi)),
t as (select arg_min({{'s': stage, 'c': confidence}}, {{'o': origin, 'i': coalesce(cid, ''), 'n': coalesce(cname, '')}}) as t from u where {is_test})
select cid as camera_id, cname as camera_name, stage, confidence, origin from u where not coalesce({is_test}, false)
union all select '{test_id}', '{test_name}', greatest(coalesce(t.s, 0), 1), case when coalesce(t.s, 0) < 1 then greatest(coalesce(t.c, 0), 0.7e0) else t.c end, 'test' from t"""


def named(t):
    no_id = F.col("user_id") % 5 == 0
    name = F.when(F.col("user_id") % 7 == 0, "").when(no_id, F.concat(F.lit("Old "), "camera_name")).otherwise(F.col("camera_name"))
    return t.v_flood.withColumns({"camera_id": F.when(no_id, "").otherwise(F.col("camera_id")), "camera_name": name, "vehicles": F.col("k") % 4})


@query("st_05", stage_list_sql(100000, "CAM-0033", "Cam 33"))
def _(t):
    return C.stage_list(named(t), F.timestamp_micros(F.lit(END_US)), 86400, 36000, 100000, "CAM-0033", "Cam 33")


@query("ag_09", LATEST.format(key="camera_id") + f""", best as ({consensus_sql("top", "camera_id")}) select b.camera_id, n.id as last_id, cast(case when n.vehicles >= 2 then n.level else stage end as int) as stage, round(case when n.vehicles >= 2 then n.confidence else stage_confidence end, 6) as confidence, cast(case when n.vehicles >= 2 then 1 else votes end as bigint) as records from best b join top n on n.camera_id = b.camera_id and n.rank = 1""")
def _(t):
    rows = t.v_flood.withColumn("vehicles", F.col("k") % 4)
    return C.current_stages(rows, "camera_id", F.timestamp_micros(F.lit(END_US)), stale_seconds=86400, window_seconds=36000)


@query("ag_09_names", LATEST.format(key="camera_name") + f""", best as ({consensus_sql("top", "camera_name")}) select b.camera_name, n.id as last_id, cast(case when n.vehicles >= 2 then n.level else stage end as int) as stage, round(case when n.vehicles >= 2 then n.confidence else stage_confidence end, 6) as confidence, cast(case when n.vehicles >= 2 then 1 else votes end as bigint) as records from best b join top n on n.camera_name = b.camera_name and n.rank = 1""")
def _(t):
    rows = t.v_flood.withColumn("vehicles", F.col("k") % 4)
    return C.current_stages(rows, "camera_name", F.timestamp_micros(F.lit(END_US)), stale_seconds=86400, window_seconds=36000)


@query("ag_16", """select frame, count(*) filter (where cls < 2) as tire, count(*) filter (where cls = 2) as car_body from v_boxes group by frame""")
def _(t):
    return C.stage_sources(t.v_boxes.withColumn("stage_source", F.when(F.col("cls") < 2, "tire").when(F.col("cls") == 2, "car_body")), ["frame"])


CHANGES = "select id, camera_id, level, us from (select *, lag(level) over (partition by camera_id order by us, id) as older from v_flood) where (older is null or older <> level) and level >= {least}"


@query("wn_01", CHANGES.format(least=1))
def _(t):
    return Q.changes_only(t.v_flood, least=1).select("id", "camera_id", "level", "us")


STEPS = """select id, station, us, case when v is null then null when bv is null then 0e0 when bd <> us // 86400000000 or v < bv then v else v - bv end as rain_step_mm from (
select *, last_value(v ignore nulls) over w as bv, last_value(case when v is not null then us // 86400000000 end ignore nulls) over w as bd from (select *, case when rain_day_mm >= 0 then rain_day_mm end as v from v_minute)
window w as (partition by station order by us, id rows between unbounded preceding and 1 preceding))"""


@query("wn_02", STEPS)
def _(t):
    return Q.rain_steps(t.v_minute).select("id", "station", "us", "rain_step_mm")


@query("ag_12", f"""select id, coalesce(sum(rain_step_mm) over (partition by station order by us range between 3599999999 preceding and current row), 0) as rain_60m_mm from ({STEPS})""")
def _(t):
    return Q.rain_last_hour(Q.rain_steps(t.v_minute)).select("id", "rain_60m_mm")


@query("wn_03", """select id, case when us - lt <= 5400000000 then lv end as temperature_c_carried from (select *, last_value(temperature_c ignore nulls) over w as lv, last_value(case when temperature_c is not null then us end ignore nulls) over w as lt from v_minute window w as (partition by station order by us, id rows between unbounded preceding and current row))""")
def _(t):
    return Q.carried(t.v_minute, "temperature_c", "station", "us", "id").select("id", "temperature_c_carried")


SERIES = "(select us // 1000000 as s, sensor_type, value, sensor_id from v_env)"


@query("wn_04", f"""select s, {", ".join(f"last_value({n} ignore nulls) over (order by s rows between unbounded preceding and current row) as {n}" for n in ("rain", "river", "sewer"))} from (select s, {", ".join(f"max(case when sensor_type = '{n}' then value end) as {n}" for n in ("rain", "river", "sewer"))} from {SERIES} group by s)""")
def _(t):
    series = t.v_env.select(F.expr("us div 1000000").alias("s"), "sensor_type", "value")
    return Q.timeline(series, "s", "sensor_type", "value", ["rain", "river", "sewer"], chunk=21600)


@query("wn_05", f"""with p as (select * from v_flood where us between {START_US} and {END_US}), f as (select camera_id, arg_max(level, us) as level from v_flood where us < {START_US} and {START_US} - us <= 86400000000 group by camera_id),
l as (select camera_id, arg_max(level, us) as level, max(us) as at_us from p where {END_US} - us <= 86400000000 group by camera_id)
select camera_id, us, level, false as carried from p union all select camera_id, {START_US}, level, true from f union all select camera_id, {END_US}, level, true from l where at_us < {END_US}""")
def _(t):
    points = t.v_flood.where(F.col("us").between(START_US, END_US))
    return Q.edge_carry(points, t.v_flood, "camera_id", START_US, END_US, 86400)


EMA_VIEW = "(select event_id, camera_id, t_us, " + ", ".join(f"case when stage = {k} then 0.5e0 else 0.125e0 end as p{k}" for k in range(5)) + " from v_frames)"


@query("wn_06", f"""with recursive f as (select *, row_number() over (partition by camera_id order by t_us, event_id) as rn, lag(t_us) over (partition by camera_id order by t_us, event_id) as bt from {EMA_VIEW}),
e as (select camera_id, rn, event_id, {", ".join(f"p{k} as s{k}" for k in range(5))} from f where rn = 1 union all select f.camera_id, f.rn, f.event_id, {", ".join(f"case when f.t_us - f.bt > 8000000 then f.p{k} else f.p{k} * 0.35e0 + e.s{k} * 0.65e0 end" for k in range(5))} from f join e on f.camera_id = e.camera_id and f.rn = e.rn + 1)
select camera_id, event_id, cast(case greatest(s0, s1, s2, s3, s4) when s0 then 0 when s1 then 1 when s2 then 2 when s3 then 3 else 4 end as int) as ema_stage, round(greatest(s0, s1, s2, s3, s4), 6) as ema_confidence from e""")
def _(t):
    shares = F.array(*(F.when(F.col("stage") == k, 0.5).otherwise(0.125) for k in range(5)))
    return Q.stage_ema(t.v_frames.withColumn("shares", shares), "camera_id", "t_us", "event_id")


GATE = """with e as (select *, case when confidence < 0.7 then 'below_minimum_confidence' when stage = 0 then 'normal_immediate' when positive_votes < 2 or positive_votes / total_votes < 0.75 then 'insufficient_positive_vehicle_agreement' end as early from v_frames),
s as (select *, case when early is not null or lag(event_id) over w is null or lag(early) over w is not null or lag(stage) over w <> stage or t_us - lag(t_us) over w > 10000000 then 1 else 0 end as starts from e window w as (partition by camera_id order by t_us, event_id)),
r as (select *, sum(starts) over (partition by camera_id order by t_us, event_id) as run from s),
h as (select *, row_number() over (partition by camera_id, run order by t_us, event_id) as hit, t_us - min(t_us) over (partition by camera_id, run) as lasts from r),
g as (select event_id, camera_id, stage, t_us, cast(case when early is null then hit when early = 'normal_immediate' then 1 else 0 end as int) as hits, case when early is null then hit >= 5 and lasts >= 3000000 else early = 'normal_immediate' end as accepted, early is null and not (hit >= 5 and lasts >= 3000000) as pending,
coalesce(early, case when hit >= 5 and lasts >= 3000000 then 'confirmed' else 'awaiting_repeated_confirmation' end) as reason from h)"""


@query("wn_07", GATE + " select event_id, hits, accepted, pending, reason from g")
def _(t):
    return Q.gate(t.v_frames).select("event_id", "hits", "accepted", "pending", "reason")


FOLD = """with recursive f as (select *, row_number() over (partition by camera_id order by {us}, {id}) as rn from {rows}),
e as (select camera_id, rn, {id}, {us} as at, {level} as lv, true as taken from f where rn = 1 union all
select f.camera_id, f.rn, f.{id}, case when {drop} then e.at else f.{us} end, case when {drop} then e.lv else f.{level} end, not coalesce({drop}, false) from f join e on f.camera_id = e.camera_id and f.rn = e.rn + 1)
select camera_id, {id} from e where taken"""


ALERTS = FOLD.format(us="t_us", id="event_id", level="stage", drop="(f.t_us - e.at < 30000000)", rows="(select * from (select *, min(stage) over w as low, count(*) over w as n from v_frames window w as (partition by camera_id order by t_us, event_id rows between 2 preceding and current row)) where n = 3 and low >= 2)")


@query("wn_08", ALERTS)
def _(t):
    return Q.alerts(t.v_frames, ["camera_id"], frames=3)


@query("wn_09", FOLD.format(us="t_us", id="event_id", level="stage", drop="(e.lv = f.stage and f.t_us - e.at < 10000000)", rows="v_frames"))
def _(t):
    return Q.save_cooldown(t.v_frames, ["camera_id"], "t_us", "event_id", "stage")


@query("wn_10", """select id, station, quantile_cont(temperature_c, 0.5) over (partition by station order by us, id rows between 6 preceding and current row) as median from v_minute where temperature_c is not null""")
def _(t):
    return Q.running_median(t.v_minute, "station", ["us", "id"], "temperature_c").select("id", "station", "median")


@query("wn_11", """select id, camera_id from (select *, row_number() over (partition by camera_id order by us desc, id desc) as rank from v_flood) where rank <= 5""")
def _(t):
    return Q.top_per_key(t.v_flood, ["camera_id"], [F.desc("us"), F.desc("id")], 5).select("id", "camera_id")


@query("wn_14", """with recursive f as (select camera_id, event_id, k * 1e0 as x, (k * 7 % 50) * 1e0 as y, row_number() over (partition by camera_id order by t_us, event_id) as rn from v_frames),
e as (select camera_id, rn, event_id, x, y, 0e0 as vx, 0e0 as vy from f where rn = 1 union all select f.camera_id, f.rn, f.event_id, f.x, f.y, (f.x - e.x) * 0.65e0 + e.vx * 0.35e0, (f.y - e.y) * 0.65e0 + e.vy * 0.35e0 from f join e on f.camera_id = e.camera_id and f.rn = e.rn + 1)
select camera_id, event_id, round(vx, 9) as vx, round(vy, 9) as vy from e""")
def _(t):
    tracks = t.v_frames.withColumn("x", F.col("k") * 1.0).withColumn("y", F.col("k") * 7 % 50 * 1.0)
    return Q.velocity(tracks, ["camera_id"], "t_us", "event_id", "x", "y")


@query("wn_15", FOLD.format(us="t_us", id="event_id", level="stage", drop="(e.lv = f.stage and f.t_us - e.at < 8000000)", rows="v_frames"))
def _(t):
    return Q.sampled(t.v_frames, ["camera_id"], "t_us", "event_id", "stage")


LIVE = "event_id % 3 = 0"  # these frames stand for the live ones


@query("wn_15_merged", f"""with b as (select camera_id, t_us, event_id, stage, {LIVE} as live from v_frames where t_us between 20000000 and 150000000),
p as (select *, lag(t_us) over w as bt, lag(stage) over w as bs from b window w as (partition by camera_id order by t_us, live, event_id))
select camera_id, t_us, event_id, stage, live from p where bt is null or t_us - bt > 1000000 or bs <> stage""")
def _(t):
    live, stored = t.v_frames.where(LIVE), t.v_frames.where(f"not ({LIVE})")
    return Q.merged_history(stored, live, ["camera_id"], 20_000_000, 150_000_000, "t_us", "event_id", "stage")


@query("wn_15_combined", f"""with f as (select *, (t_us // 2000000) * 2000000 as slot, case when k % 4 = 0 then null else k end as rain, case when k % 5 = 0 then null else k * 2 end as sewer from v_frames),
s as (select camera_id, slot, event_id, stage, rain, sewer, false as live from f where not ({LIVE})),
e as (select camera_id, arg_max({{'r': rain, 's': sewer}}, slot * 1000000 + event_id) as e from s group by 1),
b as (select * from s union all select f.camera_id, slot, event_id, stage, e.e.r, e.e.s, true from f left join e on e.camera_id = f.camera_id where {LIVE}),
c as (select *, case when live then 1000000000 else 0 end + event_id as place from b where slot between 20000000 and 150000000)
select camera_id, slot, arg_max(stage, place) as stage, arg_max(rain, place) as rain, arg_max(sewer, place) as sewer, bool_or(live) as live from c group by 1, 2""")
def _(t):
    rain, sewer = F.when(F.col("k") % 4 != 0, F.col("k")), F.when(F.col("k") % 5 != 0, F.col("k") * 2)
    rows = t.v_frames.select("camera_id", "event_id", "stage", F.expr("t_us div 2000000 * 2000000").alias("slot"), rain.alias("rain"), sewer.alias("sewer"))
    return Q.combined_history(rows.where(f"not ({LIVE})"), rows.where(LIVE), ["camera_id"], 20_000_000, 150_000_000, ["rain", "sewer"], "slot", "event_id", "stage")


@query("wn_16", """select a.user_id, count(*) filter (where not ok and (last_ok is null or us > last_ok)) as failures, make_timestamp(last_ok) as last_success, max(ts) as last_attempt from (select *, event_type <> 'error' as ok, max(case when event_type <> 'error' then us end) over (partition by user_id) as last_ok from v_events) a group by a.user_id, last_ok""")
def _(t):
    return Q.failure_runs(t.v_events.withColumn("ok", F.col("event_type") != "error"), "user_id", "ts", "event_id", "ok")


@query("wn_17", """select event_id from (select *, row_number() over (partition by camera_id order by t_us, event_id) as rn from v_frames) where rn % 3 = 0""")
def _(t):
    return Q.every_nth(t.v_frames, ["camera_id"], ["t_us", "event_id"], 3).select("event_id")


@query("tk_01", """select id, level, us from v_flood where level >= 2 order by us desc, id desc limit 100""")
def _(t):
    return Q.newest(t.v_flood.where("level >= 2"), 100).select("id", "level", "us")


@query("tk_02", """select id, level, us from v_flood order by us desc, id desc limit 1""")
def _(t):
    return Q.newest(t.v_flood, 1).select("id", "level", "us")


@query("sc_01", f"""select id, camera_id, level from v_flood where us >= {START_US} and us < {END_US} and level >= 1""")
def _(t):
    span = f"detected_at >= timestamp_ntz'{START}' and detected_at < timestamp_ntz'{END}'"
    return t.v_flood.where(span).where("level >= 1").select("id", "camera_id", "level")


@query("sc_02", f"""select id, sensor_id, value from v_env where sensor_type = 'rain' and us between {START_US} and {END_US}""")
def _(t):
    span = f"read_at >= timestamp_ntz'{START}' and read_at < timestamp_ntz'{END}' + interval 1 second"  # readings count by whole seconds
    return t.v_env.where(span).where("sensor_type = 'rain'").select("id", "sensor_id", "value")
