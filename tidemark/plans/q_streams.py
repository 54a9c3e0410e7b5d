"""Queries of the streaming jobs (SS): each replays a view as a stream and gives what its batch twin gives.

A far-future row per view pushes the watermark past all real windows; its own window stays open and is never put out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.q_core import ALERTS, CHANGES, EMA_VIEW, FOLD, GATE, consensus_sql
from tidemark.plans.registry import query
from tidemark.sources import store
from tidemark.sources.sinks import shared_path
from tidemark.streaming import jobs as J
from tidemark.streaming import ordered as O
from tidemark.streaming.replay import replay, replay_batches


def flushed(rows, time: str):
    """The rows and one far in the future."""
    last = rows.limit(1).withColumn(time, F.timestamp_micros(F.lit(4_000_000_000_000_000)))
    return rows.unionByName(last)


def frames(t):
    """The frames, and one far in the future whose id is -1."""
    rows = t.v_frames.withColumn("at", F.timestamp_micros(1704067200000000 + F.col("t_us")))
    return rows.unionByName(rows.limit(1).withColumns({"at": F.timestamp_micros(F.lit(4_000_000_000_000_000)), "event_id": F.lit(-1).cast("long")}))


def real(rows):
    return rows.where("event_id >= 0")


FAR = 3_000_000_000_000_000


@query("ss_01", consensus_sql("(select *, (1704067200000000 + t_us) // 1000000 as s from v_frames)", "camera_id, s", "stage"))
def _(t):
    out = replay(frames(t), lambda s: J.bucket_votes(s, "camera_id", "at", "1 second", "stage"))
    return out.select("camera_id", F.unix_seconds("start").alias("s"), "stage", "stage_confidence", "votes")


def gate(stream, delay="0 seconds"):
    return O.in_order(stream, "camera_id", "at", ["event_id"], O.gate_rule(), output="camera_id string, event_id long, hits int, accepted boolean, reason string", delay=delay, **O.GATE)


@query("ss_02", GATE + " select camera_id, event_id, hits, accepted, reason from g")
def _(t):
    return real(replay(frames(t), gate))


@query("ss_02_out_of_order", GATE + " select camera_id, event_id, hits, accepted, reason from g")
def _(t):
    """Rows come up to 20 seconds late, over four micro-batches; the delay of the watermark holds them all."""
    arrival = F.greatest(F.col("t_us") + F.col("event_id") * 7919 % 20 * 1_000_000, F.lit(0))
    batch = F.when(F.col("event_id") < 0, 4).otherwise(F.least((arrival / 45_000_000).cast("int"), F.lit(3)))
    return real(replay(frames(t), lambda s: gate(s, "21 seconds"), batch=batch, batches=5))


@query("ss_03", FOLD.format(us="t_us", id="event_id", level="stage", drop="(e.lv = f.stage and f.t_us - e.at < 10000000)", rows="v_frames"))
def _(t):
    job = lambda s: O.in_order(s, "camera_id", "at", ["event_id"], O.cooldown_rule(), ["t_us", "stage"], "level int, at long", "camera_id string, event_id long")
    return real(replay(frames(t), job))


@query("ss_03_alerts", ALERTS)
def _(t):
    job = lambda s: O.in_order(s, "camera_id", "at", ["event_id"], O.alert_rule(3), ["t_us", "stage"], "row int, at long", "camera_id string, event_id long", silence="1 hour")
    return real(replay(frames(t), job))


@query("ss_04", """select sensor_id, us // 86400000000 as day from v_env group by 1, 2""")
def _(t):
    rows = t.v_env.select("sensor_id", F.expr("us div 86400000000").alias("day"), F.timestamp_micros("us").alias("at"))
    return replay(rows, lambda s: J.first_within(s, ["sensor_id", "day"], "at", "2 days").select("sensor_id", "day"))


@query("ss_04_batches", """select sensor_id, us // 86400000000 as day from v_env group by 1, 2""")
def _(t):
    base = shared_path(t.spark, "observations")
    rows = t.v_env.select("sensor_id", F.to_date("observed_at").alias("seen_on"))
    rows.write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    writer = stream.writeStream.foreachBatch(store.appender(f"{base}/store", ["sensor_id", "seen_on"], "seen_on"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return store.stored(t.spark, f"{base}/store", rows).select("sensor_id", F.unix_date("seen_on").cast("long").alias("day"))


@query("ss_05", consensus_sql("(select *, us // 3600000000 * 3600 as s from v_flood)", "camera_id, s"))
def _(t):
    rows = flushed(t.v_flood.withColumn("at", F.timestamp_micros("us")), "at")
    out = replay(rows, lambda s: J.bucket_votes(s, "camera_id", "at", "60 minutes"))
    return out.select("camera_id", F.unix_seconds("start").alias("s"), "stage", "stage_confidence", "votes")


@query("ss_05_last", """select sensor_id, us // 1800000000 * 1800 as s, arg_max(value, {'u': us, 'v': value}) as value from v_env group by 1, 2""")
def _(t):
    rows = flushed(t.v_env.withColumn("at", F.timestamp_micros("us")), "at")
    out = replay(rows, lambda s: J.last_of_bucket(s, "sensor_id", "at", "30 minutes", "value"))
    return out.select("sensor_id", F.unix_seconds("start").alias("s"), "value")


@query("ss_06", """select sensor_id, us // 1800000000 * 1800 + n * 1800 + 1800 as s, round(sum(value), 6) as total from v_env, (select n from series11 where n < 2) group by 1, 2""")
def _(t):
    rows = flushed(t.v_env.withColumn("at", F.timestamp_micros("us")), "at")
    out = replay(rows, lambda s: J.sliding_sum(s, "sensor_id", "at", "value", "60 minutes", "30 minutes")).where(F.unix_micros("end") < FAR)
    return out.select("sensor_id", F.unix_seconds("end").alias("s"), F.round("total", 6).alias("total"))


@query("ss_07", """with f as (select camera_id, t_us, stage, event_id, case when t_us - lag(t_us) over w >= 10000000 or lag(t_us) over w is null then 1 else 0 end as starts from v_frames where stage >= 1 window w as (partition by camera_id order by t_us, event_id)),
r as (select *, sum(starts) over (partition by camera_id order by t_us, event_id) as run from f) select camera_id, min(t_us) as first_us, max(t_us) as last_us, count(*) as rows, max(stage) as most from r group by camera_id, run""")
def _(t):
    flood = flushed(t.v_frames.where("stage >= 1").withColumn("at", F.timestamp_micros(1704067200000000 + F.col("t_us"))), "at")
    out = replay(flood, lambda s: J.episodes(s, "camera_id", "at", "stage")).where(F.unix_micros("start") < FAR)
    return out.select("camera_id", (F.unix_micros("start") - 1704067200000000).alias("first_us"), (F.unix_micros("end") - 10000000 - 1704067200000000).alias("last_us"), "rows", "most")


@query("ss_08", f"""with recursive f as (select *, row_number() over (partition by camera_id order by t_us, event_id) as rn, lag(t_us) over (partition by camera_id order by t_us, event_id) as bt from {EMA_VIEW}),
e as (select camera_id, rn, event_id, {", ".join(f"p{k} as s{k}" for k in range(5))} from f where rn = 1 union all select f.camera_id, f.rn, f.event_id, {", ".join(f"case when f.t_us - f.bt > 8000000 then f.p{k} else f.p{k} * 0.35e0 + e.s{k} * 0.65e0 end" for k in range(5))} from f join e on f.camera_id = e.camera_id and f.rn = e.rn + 1)
select camera_id, event_id, cast(case greatest(s0, s1, s2, s3, s4) when s0 then 0 when s1 then 1 when s2 then 2 when s3 then 3 else 4 end as int) as ema_stage, round(greatest(s0, s1, s2, s3, s4), 6) as ema_confidence from e""")
def _(t):
    rows = frames(t).select("camera_id", "event_id", "t_us", "at", *(F.when(F.col("stage") == k, 0.5).otherwise(0.125).alias(f"p{k}") for k in range(5)))
    shares = [f"p{k}" for k in range(5)]
    memory = "at long, " + ", ".join(f"s{k} double" for k in range(5))
    job = lambda s: O.in_order(s, "camera_id", "at", ["event_id"], O.ema_rule(), ["t_us", *shares], memory, "camera_id string, event_id long, ema_stage int, ema_confidence double", silence="8 seconds")
    return real(replay(rows, job)).withColumn("ema_confidence", F.round("ema_confidence", 6))


@query("ss_09")
def _(t):
    boxes = F.collect_list(F.struct("x1", "y1", "x2", "y2", "conf", "box_no"))
    rows = t.v_boxes.groupBy("cam", "frame").agg(boxes.alias("boxes"))
    base = shared_path(t.spark, "tracks")
    replay_batches(rows, J.track_batches(base, "cam", "frame", 15))
    return J.track_counts(rows, base, "cam", "frame")


@query("ss_10", CHANGES.format(least=0).replace("us, id", "t_us, event_id").replace("select id, camera_id, level, us", "select camera_id, event_id, level").replace("v_flood", "(select *, stage as level from v_frames)"))
def _(t):
    job = lambda s: O.in_order(s, "camera_id", "at", ["event_id"], O.change_rule(), ["stage"], "level int", "camera_id string, event_id long, level int", silence="30 days")
    return real(replay(frames(t), job))
