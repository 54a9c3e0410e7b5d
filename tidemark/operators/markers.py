"""Depth from marker poles: tables of stripe readings in, depths out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.quantiles import exact_quantiles

from tidemark.functions.scalars import level_of


def visible_stripes(readings: DataFrame, frame: str, share: float = 0.35) -> DataFrame:
    """Readings whose contrast reaches ``share`` of the median of the frame's three strongest, and the noise floor."""
    rank = F.row_number().over(Window.partitionBy(frame).orderBy(F.desc("contrast"), "reading"))
    rows = readings.withColumn("_rank", rank)
    middle = F.expr("percentile(case when _rank <= 3 then contrast end, 0.5)").over(Window.partitionBy(frame))
    return rows.withColumn("_middle", middle).where((F.col("contrast") >= share * F.col("_middle")) & (F.col("contrast") >= F.col("noise"))).drop("_rank", "_middle")


def match_stripes(readings: DataFrame, expected: DataFrame, frame: str, tolerance: float) -> DataFrame:
    """Each reading goes to the nearest expected centre(stripe, centre) within the tolerance; a stripe takes its
    nearest reading."""
    centres = expected.agg(F.collect_list(F.struct("stripe", "centre"))).scalar()  # the stripes of one marker
    best = F.array_min(F.transform("_centres", lambda e: F.struct(F.abs(F.col("y") - e["centre"]).alias("_d"), e["stripe"].alias("stripe"))))
    nearest = readings.select(frame, "reading", "y", centres.alias("_centres")).withColumn("_b", best).drop("_centres").where(F.col("_b._d") <= tolerance)
    rows = nearest.withColumn("_rank", F.row_number().over(Window.partitionBy(frame, "_b.stripe").orderBy("_b._d", "reading")))
    return rows.where("_rank = 1").select(frame, "reading", F.col("_b.stripe").alias("stripe"), F.col("_b._d").alias("distance"))


def water_line(frames: DataFrame, base_cm: float = 25.0, period_cm: float = 20.0, stripe_cm: float = 10.0, stripes: int = 5, least_contrast: float = 0.8) -> DataFrame:
    """Depth and its bounds from each frame's visible stripes: frame, depth_cm, low_cm, high_cm, level, status.

    frames(frame, best_contrast, lowest_stripe, visible_part) where visible_part is the uncovered share of the lowest
    visible stripe. Too little contrast and no stripe give no depth; a stripe cut by the water gives its height; the
    lowest stripe in full view means that the water is below the marker."""
    bottom = base_cm + (F.col("lowest_stripe") - 1) * period_cm
    partial = F.col("visible_part") < 1.0
    status = (F.when(F.col("best_contrast") < least_contrast, "LOW_CONTRAST").when(F.col("lowest_stripe").isNull(), "NO_STRIPE").when(partial, "PARTIAL_STRIPE").when(F.col("lowest_stripe") == 1, "BELOW_MARKER").otherwise("STRIPE_COUNT"))
    rows = frames.withColumn("status", status)
    cut = bottom + (1 - F.col("visible_part")) * stripe_cm
    low = F.when(F.col("status") == "PARTIAL_STRIPE", cut - 1).when(F.col("status") == "STRIPE_COUNT", bottom - period_cm + stripe_cm).when(F.col("status") == "BELOW_MARKER", 0.0)
    high = F.when(F.col("status") == "PARTIAL_STRIPE", cut + 1).when(F.col("status").isin("STRIPE_COUNT", "BELOW_MARKER"), bottom)
    depth = F.when(F.col("status") == "PARTIAL_STRIPE", cut).when(F.col("status") == "STRIPE_COUNT", (bottom * 2 - period_cm + stripe_cm) / 2).when(F.col("status") == "BELOW_MARKER", 0.0)
    return rows.select("frame", "status", depth.alias("depth_cm"), low.alias("low_cm"), high.alias("high_cm"), F.when(depth.isNotNull(), level_of(depth, (5, 15, 25, 40))).alias("level"))


def calibrate(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares line and parabola y(x) of each key by moment sums, and the parabola's coefficients only if the
    fit has a unique solution: key, n, intercept, slope, a0, a1, a2, rmse (of the line)."""
    centre = F.avg(x).over(Window.partitionBy(key))
    rows = points.withColumn("_c", centre).withColumn("_x", F.col(x) - F.col("_c"))
    powers = {f"_s{k}": F.sum(F.pow("_x", F.lit(float(k)))) for k in range(5)} | {f"_t{k}": F.sum(F.pow("_x", F.lit(float(k))) * F.col(y)) for k in range(3)}
    g = rows.groupBy(key).agg(*(v.alias(n) for n, v in powers.items()), F.first("_c").alias("_c"), F.sum(F.col(y) * F.col(y)).alias("_yy"), F.count("*").alias("n"))
    s, t = [F.col(f"_s{k}") for k in range(5)], [F.col(f"_t{k}") for k in range(3)]
    slope = F.when(s[2] > 0, t[1] / s[2]).otherwise(0.0)  # centred: the sum of x is 0
    mean = t[0] / s[0]
    det3 = lambda a, b, c, d, e, f, g_, h, i: a * (e * i - f * h) - b * (d * i - f * g_) + c * (d * h - e * g_)
    det = det3(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4])
    a = [det3(t[0], s[1], s[2], t[1], s[2], s[3], t[2], s[3], s[4]), det3(s[0], t[0], s[2], s[1], t[1], s[3], s[2], t[2], s[4]), det3(s[0], s[1], t[0], s[1], s[2], t[1], s[2], s[3], t[2])]
    solvable = (F.col("n") >= 3) & (F.abs(det) > 1e-9)
    rest = F.greatest(F.col("_yy") - mean * t[0] - slope * t[1], F.lit(0.0))
    return g.select(key, "n", F.col("_c").alias("centre"), mean.alias("intercept"), slope.alias("slope"), *(F.when(solvable, v / det).alias(f"a{k}") for k, v in enumerate(a)), F.sqrt(rest / F.col("n")).alias("rmse"))


def measure(rows: DataFrame, fits: DataFrame, key: str, y: str, low: float, high: float) -> DataFrame:
    """Depth of a water line at pixel row y by a key's line: status ok, extrapolated, below or no_water."""
    cm = F.col("intercept") + F.col("slope") * (F.col(y) - F.col("centre"))
    status = F.when(F.col(y).isNull(), "no_water").when(cm < 0, "below").when(~F.col(y).between(low, high), "extrapolated").otherwise("ok")
    return rows.join(fits.select(key, "centre", "intercept", "slope"), key).select(*rows.columns, F.greatest(cm, F.lit(0.0)).alias("depth_cm"), status.alias("status"))


def cross_check(a: DataFrame, b: DataFrame, key: str, limit: float = 5.0) -> DataFrame:
    gap = F.abs(F.col("a_cm") - F.col("b_cm"))
    return a.select(key, F.col("depth_cm").alias("a_cm")).join(b.select(key, F.col("depth_cm").alias("b_cm")), key).select(key, gap.alias("gap_cm"), (gap > limit).alias("flagged"))


def pole_line(wet: DataFrame, key: str, y: str) -> DataFrame:
    """5th percentile of a frame's wet rows in the pole's columns."""
    return exact_quantiles(wet, [key], y, {"line_y": 0.05})


def wheel_submersion(wheels: DataFrame, runs: DataFrame, frame: str) -> DataFrame:
    """frame, box_no, wet_share, top_y, height_ratio, level of wheel boxes against wet runs (y, xa, xb) of a frame: the
    share of the box's pixels that are wet, and how high the topmost wet row over all of the box's columns stands."""
    over = wheels.join(runs, frame).where((F.col("xa") < F.col("x2")) & (F.col("xb") > F.col("x1")))
    inside = F.col("y").between(F.col("y1"), F.col("y2") - 1)
    wet = over.groupBy(frame, "box_no").agg(F.sum(F.when(inside, F.least("xb", "x2") - F.greatest("xa", "x1"))).alias("_wet"), F.min("y").alias("top_y"))
    rows = wheels.join(wet, [frame, "box_no"], "left").where((F.col("y2") > F.col("y1")) & (F.col("x2") > F.col("x1")))
    height = (F.col("y2") - F.greatest("top_y", "y1")) / (F.col("y2") - F.col("y1"))
    ratio = F.when(F.col("top_y").isNull(), 0.0).otherwise(F.greatest(height, F.lit(0.0)))
    share = F.coalesce("_wet", F.lit(0.0)) / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return rows.select(frame, "box_no", share.alias("wet_share"), "top_y", ratio.alias("height_ratio"), level_of(ratio, (0.05, 0.25, 0.5, 0.75)).alias("level"))


def frame_submersion(frames: DataFrame, wheels: DataFrame, frame: str) -> DataFrame:
    """frame, wheels, level: the deepest of a frame's wheels (of ``wheel_submersion``), level 0 without any."""
    of = wheels.groupBy(frame).agg(F.count("*").alias("wheels"), F.max("level").alias("level"))
    return frames.select(frame).distinct().join(of, frame, "left").select(frame, F.coalesce("wheels", F.lit(0)).cast("long").alias("wheels"), F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def periodic_run(stripes: DataFrame, frame: str, position: str, tolerance: float = 0.35, rounds: int = 4) -> DataFrame:
    """The longest run of positions whose spacing is within a share of the frame's median spacing; repeated on what is
    left up to ``rounds`` times: frame, round, first, last, n."""
    left, out = stripes.select(frame, position).distinct(), None
    for k in range(rounds):
        order = Window.partitionBy(frame).orderBy(position)
        gaps = left.withColumn("_gap", F.col(position) - F.lag(position).over(order))
        rows = gaps.withColumn("_mid", F.expr("percentile(_gap, 0.5)").over(Window.partitionBy(frame)))
        breaks = F.when(F.abs(F.col("_gap") - F.col("_mid")) <= tolerance * F.col("_mid"), 0).otherwise(1)
        runs = rows.withColumn("_run", F.sum(breaks).over(order)).groupBy(frame, "_run").agg(F.count("*").alias("n"), F.min(position).alias("first"), F.max(position).alias("last"))
        best = runs.groupBy(frame).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "last")).alias("b")).select(frame, F.lit(k).alias("round"), (-F.col("b.f")).alias("first"), F.col("b.last").alias("last"), F.col("b.n").alias("n")).where("n >= 3")
        out = best if out is None else out.unionByName(best)
        gone = best.select(frame, "first", "last")
        left = left.join(gone, frame).where(~F.col(position).between(F.col("first"), F.col("last"))).select(frame, position)
    return out
