"""Queries of detections and detector metrics (JN, TK, AG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boxes as B
from tidemark.operators import metrics as M
from tidemark.plans.registry import query

I = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"  # noqa: E741


def inter(a: str, b: str) -> str:
    return I.format(a=a, b=b)


def iou(a: str, b: str) -> str:
    area = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
    return f"({inter(a, b)}) / ({area.format(a)} + {area.format(b)} - {inter(a, b)})"


@query("jn_11", f"""select p.frame, p.box_no as a_no, g.box_no as b_no, round({iou("p", "g")}, 9) as iou from v_boxes p join v_truth g on p.frame = g.frame""")
def _(t):
    p, g = t.v_boxes.select("frame", "box_no", *B.SIDES), t.v_truth.select("frame", "box_no", *B.SIDES)
    return B.overlaps(p, g, ["frame"]).select("frame", "a_no", "b_no", F.round("iou", 9).alias("iou"))


@query("jn_12", """select p.frame, p.box_no, 'license_plate' as kind from v_boxes p where p.cls = 1 and exists (select 1 from v_boxes v where v.frame = p.frame and v.cls <> 1 and (p.x1 + p.x2) / 2 between greatest((v.x1 + v.x2) / 2 - (v.x2 - v.x1) * 1.18e0 / 2, 0) and (v.x1 + v.x2) / 2 + (v.x2 - v.x1) * 1.18e0 / 2
  and (p.y1 + p.y2) / 2 between greatest((v.y1 + v.y2) / 2 - (v.y2 - v.y1) * 1.18e0 / 2, 0) and (v.y1 + v.y2) / 2 + (v.y2 - v.y1) * 1.18e0 / 2 and (p.x2 - p.x1) * (p.y2 - p.y1) <= 0.5 * (v.x2 - v.x1) * (v.y2 - v.y1))
  union all select frame, box_no, 'face' from v_boxes where cls = 0 and (x2 - x1) * (y2 - y1) <= 10000""")
def _(t):
    b = t.v_boxes
    return B.plates_in_vehicles(b.where("cls = 1"), b.where("cls = 0"), b.where("cls <> 1"), ["frame"], most_share=0.5)


@query("tk_04", """select frame, box_no from (select *, row_number() over (partition by frame order by conf desc, box_no) as rank from v_boxes) where rank <= 2""")
def _(t):
    return B.strongest(t.v_boxes, ["frame"], 2).select("frame", "box_no")


OVER = f"({inter('f', 'k')}) / least((f.x2 - f.x1) * (f.y2 - f.y1), (k.x2 - k.x1) * (k.y2 - k.y1))"
CENTRE = "sqrt(pow((f.x1 + f.x2 - k.x1 - k.x2) / 2, 2) + pow((f.y1 + f.y2 - k.y1 - k.y2) / 2, 2)) / greatest(8, sqrt(pow(f.x2 - f.x1, 2) + pow(f.y2 - f.y1, 2)), sqrt(pow(k.x2 - k.x1, 2) + pow(k.y2 - k.y1, 2)))"
SAME = f"({iou('f', 'k')} >= 0.38 or {OVER} >= 0.72 or ({CENTRE} <= 0.12 and {iou('f', 'k')} >= 0.18))"


@query("tk_05", f"""with recursive f as (select cam, box_no, frame, x1, y1, x2, y2, row_number() over (partition by frame order by conf desc, box_no) as rn from v_boxes where frame % 5 < 5),
s as (select k.frame, k.rn as k_rn, f.rn as f_rn from f k join f on f.frame = k.frame and f.rn > k.rn where {SAME}),
e as (select frame, rn, box_no, [rn] as kept, true as stays from f where rn = 1 union all select f.frame, f.rn, f.box_no, case when len(list_intersect(e.kept, c.near)) > 0 then e.kept else list_append(e.kept, f.rn) end, len(list_intersect(e.kept, c.near)) = 0
from e join f on f.frame = e.frame and f.rn = e.rn + 1 join (select f.frame, f.rn, coalesce(list(s.k_rn) filter (where s.k_rn is not null), []) as near from f left join s on s.frame = f.frame and s.f_rn = f.rn group by f.frame, f.rn) c on c.frame = f.frame and c.rn = f.rn)
select frame, box_no from e where stays""")
def _(t):
    return B.suppress(t.v_boxes, ["frame"]).select("frame", "box_no")


@query("tk_06", f"""with recursive b as (select *, row_number() over (partition by cam, frame order by box_no) as rn, struct_pack(no := box_no, x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf) as f from v_boxes where x2 - x1 >= 8 and y2 - y1 >= 8),
e as (select cam, frame, rn, [f] as kept from b where rn = 1 union all select b.cam, b.frame, b.rn, case when z.p = 0 then list_append(e.kept, b.f) when b.f.conf > e.kept[z.p].conf then list_concat(list_append(e.kept[:z.p - 1], b.f), e.kept[z.p + 1:]) else e.kept end
from e join b on b.cam = e.cam and b.frame = e.frame and b.rn = e.rn + 1, lateral (select coalesce(list_position(list_transform(e.kept, lambda k: {iou("b.f", "k")} >= 0.55), true), 0) as p) z)
select cam, frame, cast(i - 1 as int) as slot, kept[i].no as box_no, kept[i].conf as conf from (select *, unnest(generate_series(1, len(kept))) as i from (select * from e qualify row_number() over (partition by cam, frame order by rn desc) = 1))""")
def _(t):
    return B.merge_candidates(t.v_boxes, ["cam", "frame"]).select("cam", "frame", "slot", "box_no", "conf")


@query("tk_07", """select image, inter / (gt + pred - inter) as iou from v_masks where conf = 3 order by iou, image limit 25""")
def _(t):
    return t.v_masks.where("conf = 3").select("image", (F.col("inter") / (F.col("gt") + F.col("pred") - F.col("inter"))).alias("iou")).orderBy("iou", "image").limit(25)


@query("tk_08", """select frame, cls, conf, box_no from (select *, row_number() over (partition by frame order by cls desc, conf desc, box_no) as rank from v_boxes where conf >= 0.1) where rank = 1""")
def _(t):
    return B.representative(t.v_boxes, ["frame"], "cls", F.col("conf") >= 0.1)


MODELS = "(select *, 'm' || cast(box_no % 3 as varchar) as model from v_boxes)"


@query("ag_20", f"""with m as (select frame, box_no, model, x1, y1, x2, y2 from {MODELS}), c as (select model, count(*) as n from m group by model),
h as (select model, other, count(*) as hits from (select p.frame, p.model, p.box_no, g.model as other, max({iou("p", "g")}) as best from m p join m g on g.frame = p.frame and g.model <> p.model group by 1, 2, 3, 4) where best >= 0.2 group by 1, 2)
select a.model, b.model as other, coalesce(hits, 0) / a.n as share from c a join c b on a.model <> b.model left join h on h.model = a.model and h.other = b.model""")
def _(t):
    m = t.v_boxes.withColumn("model", F.concat(F.lit("m"), (F.col("box_no") % 3).cast("string"))).select("frame", "box_no", "model", *B.SIDES)
    return B.agreement(m, ["frame"], 0.2)


def matches_sql(predictions: str, truth: str, keys: str) -> str:
    """Recursive parts whose last, m, has each prediction with its hit; predictions and truth have the frame's keys."""
    cols, on = keys.split(", "), lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in cols)
    return f"""p as (select {keys}, box_no, conf, x1, y1, x2, y2, row_number() over (partition by {keys} order by conf desc, box_no) as rn from {predictions}),
o as (select {of("p")}, p.rn, list(struct_pack(i := {iou("p", "g")}, n := -g.box_no) order by {iou("p", "g")} desc, g.box_no) as near from p join {truth} g on {on("g", "p")} group by all),
q as (select {of("p")}, p.rn, p.box_no, p.conf, coalesce(o.near, []) as near from p left join o on {on("o", "p")} and o.rn = p.rn),
e as (select {keys}, rn, box_no, conf, case when near[1].i >= 0.5 then [near[1].n] else [] end as used, coalesce(near[1].i >= 0.5, false) as hit from q where rn = 1 union all
select {of("q")}, q.rn, q.box_no, q.conf, case when b.i >= 0.5 then list_append(e.used, b.n) else e.used end, coalesce(b.i >= 0.5, false) from e join q on {on("q", "e")} and q.rn = e.rn + 1, lateral (select list_filter(q.near, lambda x: not list_contains(e.used, x.n))[1] as b) z),
m as (select {keys}, box_no, conf, hit from e)"""


def scores_sql(truth: str, cls: str) -> str:
    return f"""select {cls}, predictions, hits, labels, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end as f1, miss_rate from (select l.{cls}, coalesce(n, 0) as predictions, coalesce(h, 0) as hits, labels, case when n > 0 then h / n else 0e0 end as precision, coalesce(h, 0) / labels as recall, 1 - coalesce(caught, 0) / (select count(distinct frame) from {truth}) as miss_rate
from (select {cls}, count(*) as labels from {truth} group by 1) l left join (select {cls}, count(*) as n, count(*) filter (where hit) as h, count(distinct frame) filter (where hit) as caught from m group by 1) f on f.{cls} = l.{cls})"""


@query("ag_21", f"with recursive {matches_sql('(select * from v_boxes where conf >= 0.1)', 'v_truth', 'frame, cls')} {scores_sql('v_truth', 'cls')}")
def _(t):
    matches = B.greedy_matches(t.v_boxes.where("conf >= 0.1"), t.v_truth, ["frame", "cls"])
    return B.scores(matches, t.v_truth, ["frame", "cls"], "cls")


@query("ag_21_matches", f"with recursive {matches_sql('(select * from v_boxes where conf >= 0.1)', 'v_truth', 'frame, cls')} select * from m")
def _(t):
    return B.greedy_matches(t.v_boxes.where("conf >= 0.1"), t.v_truth, ["frame", "cls"])


@query("ag_22", f"""with recursive {matches_sql('v_boxes', 'v_truth', 'frame, cls')},
c as (select n / 20e0 as threshold, case when count(conf) > 0 then count(*) filter (where hit) / count(conf) else 1e0 end as precision, count(*) filter (where hit) / (select count(*) from v_truth) as recall from series21 left join m on conf >= n / 20e0 where n < 20 group by 1)
select round(coalesce(sum((recall - r) * (precision + p) / 2), 0e0), 9) as ap from (select *, lag(recall) over w as r, lag(precision) over w as p from c window w as (order by recall, threshold desc))""")
def _(t):
    matches = B.greedy_matches(t.v_boxes, t.v_truth, ["frame", "cls"])
    curve = B.pr_curve(matches, t.v_truth.agg(F.count("*")).scalar(), [k / 20 for k in range(20)])
    return B.average_precision(curve).withColumn("ap", F.round("ap", 9))


@query("ag_23", f"""with b as (select g.frame, g.box_no, max({iou("g", "p")}) as best from v_truth g join v_boxes p on p.frame = g.frame where p.conf >= 0.5 group by 1, 2)
select size, count(*) as labels, avg(case when coalesce(best, 0) >= 0.5 then 1e0 else 0e0 end) as recall from (select g.*, best, case when (x2 - x1) * (y2 - y1) < 1024 then 'small' when (x2 - x1) * (y2 - y1) < 9216 then 'medium' else 'large' end as size from v_truth g left join b on b.frame = g.frame and b.box_no = g.box_no) group by size""")
def _(t):
    p = t.v_boxes.where("conf >= 0.5").select("frame", "box_no", *B.SIDES)
    return B.recall_by_size(p, t.v_truth.select("frame", "box_no", *B.SIDES), ["frame"])


@query("ag_24", """with h as (select g.frame, g.box_no, greatest(g.x1, p.x1) as a, least(g.x2, p.x2) as b, greatest(g.y1, p.y1) as c, least(g.y2, p.y2) as d from v_truth g join v_boxes p on p.frame = g.frame and p.x1 < g.x2 and p.x2 > g.x1 and p.y1 < g.y2 and p.y2 > g.y1 where p.conf >= 0.5),
l as (select frame, box_no, a, b, unnest(generate_series(cast(ceil(c) as bigint), cast(ceil(d) as bigint) - 1)) as y from h),
m as (select *, max(b) over (partition by frame, box_no, y order by a, b rows between unbounded preceding and 1 preceding) as reach from l), s as (select frame, box_no, sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) as covered from m group by 1, 2)
select g.frame, g.box_no, case when (x2 - x1) * (y2 - y1) > 0 then coalesce(covered, 0) / ((x2 - x1) * (y2 - y1)) else 0 end as covered from v_truth g left join s on s.frame = g.frame and s.box_no = g.box_no""")
def _(t):
    return B.coverage(t.v_truth, t.v_boxes.where("conf >= 0.5"), ["frame"])


@query("ag_25", """select cam, quantile_cont(l_quantity, 0.5) as median_ms, quantile_cont(l_quantity, 0.95) as p95_ms, 1000 / avg(l_quantity) as fps from v_boxes group by cam""")
def _(t):
    return M.latency(t.v_boxes, ["cam"], "l_quantity")


@query("ag_26", """select cam, avg(n) as mean, quantile_cont(n, 0.5) as median, max(n) as most from (select f.cam, f.frame, coalesce(n, 0) as n from (select distinct cam, frame from v_boxes) f left join (select frame, count(*) as n from v_boxes where conf >= 0.5 group by frame) c on c.frame = f.frame) group by cam""")
def _(t):
    return M.per_frame(t.v_boxes.select("cam", "frame").distinct(), t.v_boxes.where("conf >= 0.5"), ["cam"], "frame")


MASK = "sum(inter) / (sum(gt) + sum(pred) - sum(inter)) as iou, avg(inter / (gt + pred - inter)) as mean_iou, avg(2 * inter / (gt + pred)) as mean_dice, sum(inter) / sum(pred) as precision, sum(inter) / sum(gt) as recall"


@query("ag_27", f"select split, conf, round(mean_iou, 9) as mean_iou, round(mean_dice, 9) as mean_dice, iou, precision, recall from (select split, conf, {MASK} from v_masks group by split, conf)")
def _(t):
    return M.mask_scores(t.v_masks, ["split", "conf"]).withColumns({c: F.round(c, 9) for c in ("mean_iou", "mean_dice")})


@query("ag_28", f"""with s as (select split, conf, {MASK} from v_masks group by split, conf), b as (select conf, iou from s where split = 'valid' order by iou desc, conf limit 1) select b.conf, b.iou as valid_iou, s.iou as test_iou, precision, recall from b left join s on s.conf = b.conf and s.split = 'test'""")
def _(t):
    return M.best_threshold(M.mask_scores(t.v_masks, ["split", "conf"]))


@query("ag_29", """with s as (select level, count(*) as n, round(avg(confidence), 9) as mean, round(stddev_pop(confidence), 9) as std from v_flood group by level) select *, (select bool_and(up) from (select coalesce(mean >= lag(mean) over (order by level), true) as up from s)) as non_decreasing from s""")
def _(t):
    return M.level_consistency(t.v_flood, "level", "confidence")


@query("ag_30", """select cam, avg(l_discount) as mean, min(l_discount) as least, max(l_discount) as most, count(*) filter (where l_discount = 0) as zeros, 1000 / avg(l_quantity) as fps from v_boxes group by cam""")
def _(t):
    return M.ratio_summary(t.v_boxes, ["cam"], "l_discount", "l_quantity")


@query("ag_31", """select cls, n, sum(n) over () / (count(*) over () * n) as weight from (select cls, count(*) as n from v_boxes group by cls)""")
def _(t):
    return M.class_weights(t.v_boxes, "cls")


@query("ag_32", """with g as (select *, before is null or score > before + 1e-4 as gain from (select *, max(score) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before from (select user_id as run, id as epoch, k / 100e0 as score from v_flood))),
i as (select *, epoch - last_value(case when gain then epoch end ignore nulls) over (partition by run order by epoch) as idle from g) select run, arg_max(epoch, struct_pack(s := score, e := -epoch)) as best_epoch, max(score) as best_score, min(case when idle >= 50 then epoch end) as stop_epoch from i group by run""")
def _(t):
    return M.training_log(t.v_flood.select(F.col("user_id").alias("run"), F.col("id").alias("epoch"), (F.col("k") / 100).alias("score")), "run", "epoch", "score", patience=50)


@query("ag_35", """select cam, round(avg(abs(x1 - y1)), 9) as mae, max(abs(x1 - y1)) as most from v_boxes group by cam""")
def _(t):
    return M.errors(t.v_boxes, ["cam"], "x1", "y1").withColumn("mae", F.round("mae", 9))


@query("ag_17", """select flag as split, cls, count(*) as n from v_boxes group by flag, cls""")
def _(t):
    return M.class_distribution(t.v_boxes.withColumnRenamed("flag", "split"), "split", "cls")


@query("jn_16", """select a.cam, fps, mean, mae from (select cam, 1000 / avg(l_quantity) as fps from v_boxes group by cam) a left join (select cam, round(avg(l_discount), 9) as mean from v_boxes where cam % 2 = 0 group by cam) b on a.cam = b.cam left join (select cam, round(avg(abs(x1 - y1)), 9) as mae from v_boxes where cam % 3 = 0 group by cam) c on a.cam = c.cam""")
def _(t):
    speed = M.latency(t.v_boxes, ["cam"], "l_quantity").select("cam", "fps")
    quality = M.ratio_summary(t.v_boxes.where("cam % 2 = 0"), ["cam"], "l_discount", "l_quantity").select("cam", F.round("mean", 9).alias("mean"))
    return M.summary(speed, quality, M.errors(t.v_boxes.where("cam % 3 = 0"), ["cam"], "x1", "y1").select("cam", F.round("mae", 9).alias("mae")), "cam")


@query("wn_19", """select frame, box_no from (select *, greatest(0.003, least(0.035, 0.12 * max(conf) over (partition by frame))) as least_, row_number() over (partition by frame order by conf desc, box_no) as rank from v_boxes) where rank <= 3 and (conf >= least_ or rank = 1)""")
def _(t):
    return B.visible(t.v_boxes, ["frame"], most=3).select("frame", "box_no")
