"""Detections: suppression, matching, coverage and detector metrics. Greedy per-frame rules are folds over a frame's
sorted boxes inside the JVM; a frame holds at most a few hundred boxes. The order is total: confidence, then number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.space import area, centre_distance, grown, iou, overlap_of_smaller

SIDES = ("x1", "y1", "x2", "y2")


def corners(row: Column) -> list[Column]:
    return [row[c] for c in SIDES]


def overlaps(a: DataFrame, b: DataFrame, frame: list[str]) -> DataFrame:
    """All pairs of boxes of a frame (a_no, b_no, iou, and each side's other columns with the prefixes a_ and b_)."""
    sides = [x.select(*frame, *(F.col(c).alias(f"{p}_{'no' if c == 'box_no' else c}") for c in x.columns if c not in frame)) for p, x in (("a", a), ("b", b))]
    pairs = sides[0].join(sides[1], frame)
    return pairs.withColumn("iou", iou([F.col(f"a_{c}") for c in SIDES], [F.col(f"b_{c}") for c in SIDES]))


def _sorted(boxes: DataFrame, frame: list[str], keep: list[str], use: Column | None = None, aggs: tuple[Column, ...] = ()) -> DataFrame:
    item = F.struct((-F.col("conf")).alias("order"), "box_no", *SIDES, *keep)
    items = F.collect_list(item if use is None else F.when(use, item))
    return boxes.groupBy(*frame).agg(F.array_sort(items).alias("items"), *aggs)


def _empty(items: str) -> Column:
    return F.slice(F.col(items), F.lit(1), F.lit(0))


def suppress(boxes: DataFrame, frame: list[str], least_iou: float = 0.38, least_overlap: float = 0.72, centre: float = 0.12, centre_iou: float = 0.18, most: int = 40, keep: list[str] = (), use: Column | None = None, aggs: tuple[Column, ...] = ()) -> DataFrame:
    """Class-agnostic greedy suppression: strongest first, a box goes if a kept one overlaps it; at most ``most``. Gives
    the boxes with their columns ``keep``, of those that are of ``use``, and ``aggs`` over all boxes of their frame."""

    def step(kept: Column, box: Column) -> Column:
        def same(k: Column) -> Column:
            a, b = corners(box), corners(k)
            i = iou(a, b)
            return (i >= least_iou) | (overlap_of_smaller(a, b) >= least_overlap) | ((centre_distance(a, b) <= centre) & (i >= centre_iou))

        return F.when((F.size(kept) >= most) | F.exists(kept, same), kept).otherwise(F.concat(kept, F.array(box)))

    items = _sorted(boxes, frame, list(keep), use, aggs)
    more = [c for c in items.columns if c not in (*frame, "items")]
    kept = items.select(*frame, *more, F.aggregate("items", _empty("items"), step).alias("kept"))
    # explode would have the optimizer work the fold out twice, for a filter on its size as well
    each = kept.select(*frame, *more, F.explode_outer("kept").alias("b")).where("b is not null")
    return each.select(*frame, "b.box_no", *(f"b.{c}" for c in SIDES), (-F.col("b.order")).alias("conf"), *(f"b.{c}" for c in keep), *more)


def merge_candidates(boxes: DataFrame, frame: list[str], least_iou: float = 0.55, least_side: float = 8.0) -> DataFrame:
    """First come, first kept, in box number order: a later box that overlaps a kept one replaces its geometry in
    place if it is stronger. frame, slot (order of arrival), box_no (whose geometry stands), sides, conf."""
    items = F.array_sort(F.collect_list(F.struct("box_no", *SIDES, "conf")))
    usable = boxes.where((F.col("x2") - F.col("x1") >= least_side) & (F.col("y2") - F.col("y1") >= least_side))
    rows = usable.groupBy(*frame).agg(items.alias("items"))

    def step(kept: Column, box: Column) -> Column:
        hits = F.transform(kept, lambda k: (iou(corners(box), corners(k)) >= least_iou).cast("int"))
        first = F.array_position(hits, 1)
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == first) & (box["conf"] > k["conf"]), box).otherwise(k))
        return F.when(first == 0, F.concat(kept, F.array(box))).otherwise(swapped)

    kept = rows.select(*frame, F.aggregate("items", _empty("items"), step).alias("kept"))
    return kept.select(*frame, F.posexplode("kept").alias("slot", "b")).select(*frame, "slot", "b.box_no", *(f"b.{c}" for c in SIDES), "b.conf")


def plates_in_vehicles(plates: DataFrame, faces: DataFrame, vehicles: DataFrame, frame: list[str], grow: float = 1.18, most_share: float = 0.12, most_face: float = 10_000.0) -> DataFrame:
    """Plates whose centre lies in a grown vehicle and that are small against it; faces only by size."""
    v = vehicles.select(*frame, *(c.alias(f"v{n}") for c, n in zip(grown([F.col(c) for c in SIDES], grow, 1e9, 1e9), SIDES)), area(*(F.col(c) for c in SIDES)).alias("varea"))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    p = plates.withColumn("_cx", cx).withColumn("_cy", cy).withColumn("_area", area(*(F.col(c) for c in SIDES))).alias("p")
    on = (F.col("_cx").between(F.col("vx1"), F.col("vx2"))) & (F.col("_cy").between(F.col("vy1"), F.col("vy2"))) & (F.col("_area") <= most_share * F.col("varea"))
    for c in frame:
        on = on & (F.col(f"p.{c}") == F.col(f"v.{c}"))
    inside = p.join(v.alias("v"), on, "left_semi").select(*frame, "box_no", F.lit("license_plate").alias("kind"))
    small = faces.where(area(*(F.col(c) for c in SIDES)) <= most_face).select(*frame, "box_no", F.lit("face").alias("kind"))
    return inside.unionByName(small)


def agreement(detections: DataFrame, frame: list[str], least: float = 0.5) -> DataFrame:
    """model, other, share: the share of a model's boxes that overlap any box of the other by IoU."""
    near = overlaps(detections, detections, frame).where((F.col("a_model") != F.col("b_model")) & (F.col("iou") >= least))
    hits = near.select(*frame, "a_model", "a_no", "b_model").distinct().groupBy("a_model", "b_model").agg(F.count("*").alias("hits"))
    counts = detections.groupBy("model").agg(F.count("*").alias("boxes"))
    models = counts.agg(F.collect_list("model")).scalar()  # a handful of names
    pairs = counts.select(F.col("model").alias("a_model"), "boxes", F.explode(models).alias("b_model"))
    joined = pairs.where("a_model <> b_model").join(hits, ["a_model", "b_model"], "left")
    return joined.select(F.col("a_model").alias("model"), F.col("b_model").alias("other"), (F.coalesce("hits", F.lit(0)) / F.col("boxes")).alias("share"))


def greedy_matches(predictions: DataFrame, truth: DataFrame, frame: list[str], least: float = 0.5) -> DataFrame:
    """frame, box_no, conf, hit: predictions in order of confidence each claim their best free truth box. Only pairs that
    overlap enough are put in order: by prediction, then the best truth first; a pair counts if both its boxes are free."""
    p = predictions.select(*frame, "box_no", "conf", *SIDES)
    t = truth.select(*frame, F.col("box_no").alias("t_no"), *(F.col(c).alias(f"t_{c}") for c in SIDES))
    near = iou([F.col(c) for c in SIDES], [F.col(f"t_{c}") for c in SIDES])
    pair = F.struct((-F.col("conf")).alias("order"), F.col("box_no").cast("long").alias("p"), (-near).alias("far"), F.col("t_no").cast("long").alias("t"))
    pairs = p.join(t, frame).where(near >= least).groupBy(*frame).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))

    def step(taken: Column, x: Column) -> Column:
        return F.when(F.exists(taken, lambda k: (k["p"] == x["p"]) | (k["t"] == x["t"])), taken).otherwise(F.concat(taken, F.array(x)))

    hits = pairs.select(*frame, F.when(F.size("pairs") == 1, F.col("pairs")).otherwise(F.aggregate("pairs", _empty("pairs"), step))["p"].alias("hits"))
    rows = p.select(*frame, F.col("box_no").cast("long").alias("box_no"), "conf").join(hits, frame, "left")
    return rows.select(*frame, "box_no", "conf", F.coalesce(F.array_contains("hits", F.col("box_no")), F.lit(False)).alias("hit"))


def scores(matches: DataFrame, truth: DataFrame, frame: list[str], cls: str) -> DataFrame:
    """cls, predictions, hits, labels, precision, recall, f1, miss_rate (frames with any label that have no hit)."""
    labels = truth.groupBy(cls).agg(F.count("*").alias("labels"))
    frames = [c for c in frame if c != cls]
    labelled = truth.select(*frames).distinct()
    each = matches.groupBy(cls, *frames).agg(F.count("*").alias("n"), F.count_if("hit").alias("h"))  # one pass over the matches
    found = each.groupBy(cls).agg(F.sum("n").alias("predictions"), F.sum("h").alias("hits"), F.count_if(F.col("h") > 0).alias("caught"))
    total = labelled.agg(F.count("*")).scalar()
    rows = labels.join(found, cls, "left").withColumn("frames", total)
    hits, n = F.coalesce("hits", F.lit(0)), F.coalesce("predictions", F.lit(0))
    precision, recall = F.when(n > 0, hits / n).otherwise(0.0), hits / F.col("labels")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select(cls, n.cast("long").alias("predictions"), hits.cast("long").alias("hits"), "labels", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), (1 - F.coalesce("caught", F.lit(0)) / F.col("frames")).alias("miss_rate"))


def pr_curve(matches: DataFrame, labels: int | Column, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall of matches at or above each threshold; labels is the number of truth boxes."""
    steps = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.col("conf") >= t).alias("in")) for t in thresholds))
    each = matches.select("hit", F.explode(steps).alias("s")).groupBy(F.col("s.threshold").alias("threshold")).agg(F.count_if(F.col("hit") & F.col("s.in")).alias("hits"), F.count_if("s.in").alias("n"))
    grid = matches.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rows = grid.join(each, "threshold", "left").select("threshold", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n", F.lit(0)).alias("n"))
    n_labels = labels if isinstance(labels, Column) else F.lit(labels)
    return rows.select("threshold", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(1.0).alias("precision"), (F.col("hits") / n_labels).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Trapezoid area under precision over recall; a curve has as many rows as thresholds."""
    order = Window.orderBy("recall", F.desc("threshold"))
    steps = curve.withColumn("_r", F.lag("recall").over(order)).withColumn("_p", F.lag("precision").over(order))
    return steps.agg(F.coalesce(F.sum((F.col("recall") - F.col("_r")) * (F.col("precision") + F.col("_p")) / 2), F.lit(0.0)).alias("ap"))


def recall_by_size(predictions: DataFrame, truth: DataFrame, frame: list[str], least: float = 0.5, breaks: tuple[float, float] = (1024.0, 9216.0)) -> DataFrame:
    """size, labels, recall: a label counts if any prediction overlaps it."""
    best = overlaps(truth, predictions, frame).groupBy(*frame, "a_no").agg(F.max("iou").alias("best")).withColumnRenamed("a_no", "box_no")
    a = area(*(F.col(c) for c in SIDES))
    rows = truth.join(best, [*frame, "box_no"], "left").withColumn("size", F.when(a < breaks[0], "small").when(a < breaks[1], "medium").otherwise("large"))
    return rows.groupBy("size").agg(F.count("*").alias("labels"), F.avg(F.when(F.coalesce("best", F.lit(0.0)) >= least, 1.0).otherwise(0.0)).alias("recall"))


def coverage(truth: DataFrame, predictions: DataFrame, frame: list[str], grow: float = 1.0, pixel_rows: bool = True) -> DataFrame:
    """frame, box_no, covered: share of each label's area under the union of the (grown) boxes. A label is cut into
    strips at the edges of the boxes that meet it, and in a strip overlapping intervals are merged by a running maximum,
    so the work follows the number of boxes, not their height. With ``pixel_rows`` edges go up to the next pixel row, as
    a mask has them; without, fractions count."""
    p = predictions.select(*frame, *(c.alias(f"p{n}") for c, n in zip(grown([F.col(c) for c in SIDES], grow, 1e9, 1e9), SIDES)))
    hit = truth.join(p, frame).where((F.col("px1") < F.col("x2")) & (F.col("px2") > F.col("x1")) & (F.col("py1") < F.col("y2")) & (F.col("py2") > F.col("y1")))
    edge = (lambda v: F.ceil(v).cast("double")) if pixel_rows else (lambda v: v.cast("double"))
    hit = hit.select(*frame, "box_no", F.greatest("x1", "px1").alias("a"), F.least("x2", "px2").alias("b"), edge(F.greatest("y1", "py1")).alias("top"), edge(F.least("y2", "py2")).alias("foot"))
    hit = hit.where("top < foot")
    label = [*frame, "box_no"]
    edges = hit.select(*label, F.explode(F.array("top", "foot")).alias("y")).distinct()
    below = F.lead("y").over(Window.partitionBy(*label).orderBy("y"))
    strips = edges.withColumn("y1", below).where("y1 is not null")
    pieces = strips.join(hit, label).where((F.col("top") <= F.col("y")) & (F.col("foot") >= F.col("y1")))
    order = Window.partitionBy(*label, "y").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(reach, F.col("a"))), F.lit(0.0)) * (F.col("y1") - F.col("y"))
    sums = pieces.withColumn("_added", added).groupBy(*label).agg(F.sum("_added").alias("_covered"))
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return truth.join(sums, label, "left").select(*label, F.when(size > 0, F.coalesce("_covered", F.lit(0.0)) / size).otherwise(0.0).alias("covered"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    c = F.col("covered")
    return covered.agg(F.avg(c).alias("mean"), F.avg((c >= 0.95).cast("double")).alias("full"), F.avg((c < 0.5).cast("double")).alias("under_half"), F.avg((c == 0).cast("double")).alias("none"))


def visible(boxes: DataFrame, frame: list[str], floor: tuple[float, float, float] = (0.003, 0.035, 0.12), most: int = 12) -> DataFrame:
    """The strongest ``most`` boxes at or above a floor that follows the frame's strongest (which always stays)."""
    by = Window.partitionBy(*frame)
    least = F.greatest(F.lit(floor[0]), F.least(F.lit(floor[1]), floor[2] * F.max("conf").over(by)))
    rows = boxes.withColumn("_least", least).withColumn("_rank", F.row_number().over(by.orderBy(F.desc("conf"), "box_no")))
    return rows.where((F.col("_rank") <= most) & ((F.col("conf") >= F.col("_least")) | (F.col("_rank") == 1))).drop("_rank").withColumnRenamed("_least", "floor")


def strongest(boxes: DataFrame, frame: list[str], k: int) -> DataFrame:
    return boxes.withColumn("_rank", F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc("conf"), "box_no"))).where(F.col("_rank") <= k).drop("_rank")


def representative(boxes: DataFrame, frame: list[str], stage: str, valid: Column) -> DataFrame:
    return boxes.where(valid).groupBy(*frame).agg(F.max(F.struct(stage, "conf", (-F.col("box_no")).alias("n"))).alias("b")).select(*frame, F.col(f"b.{stage}").alias(stage), F.col("b.conf").alias("conf"), (-F.col("b.n")).alias("box_no"))


