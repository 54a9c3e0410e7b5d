"""Preparation of label data: filters by class, splits, normalised boxes, validation and manifests.

Seeded shuffles are re-aimed to ranks by a hash of seed and name: the same sizes, the same result on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.sequences import numbered


def keep_by_class(files: DataFrame, class_id: str, text: str = "json") -> DataFrame:
    """file, status: keep if the class id occurs anywhere in the nested JSON, remove if not, error if it is no JSON."""
    ids = F.regexp_extract_all(F.col(text), F.lit(r'"classId"\s*:\s*"([^"]*)"'), F.lit(1))
    status = F.when(F.try_parse_json(text).isNull(), "error").when(F.array_contains(ids, class_id), "keep").otherwise("remove")
    return files.select("file", status.alias("status"))


def shuffled(name: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), name.cast("string")))


def ranked(rows: DataFrame, keys: list[str], name: str, mark: Column) -> DataFrame:
    """Rows with ``_rank`` by their mark (hex text of a hash), then name: its first three digits are the chunks in which
    they are ranked apart, so no key is one task."""
    return numbered(rows.withColumn("_mark", mark), keys, ["_mark", name], F.substring("_mark", 1, 3), "_rank").drop("_mark")


def split_by_group(rows: DataFrame, group: str, seed: str, share: float = 0.2) -> DataFrame:
    """Rows with split train or val so that no group is in both; max(1, int(share * groups)) groups are val."""
    groups = rows.select(group).distinct()
    n = groups.agg(F.greatest(F.lit(1), F.floor(F.lit(share) * F.count("*")))).scalar()
    side = ranked(groups, [], group, shuffled(F.col(group), seed)).select(group, F.when(F.col("_rank") <= n, "val").otherwise("train").alias("split"))
    return rows.join(side, group)


def split_by_class(rows: DataFrame, cls: str, name: str, seed: str, share: float = 0.2) -> DataFrame:
    """int(share * n) rows of each class are val."""
    sizes = rows.groupBy(cls).agg(F.floor(share * F.count("*")).alias("_val"))
    out = ranked(rows, [cls], name, shuffled(F.col(name), seed)).join(sizes, cls)
    return out.withColumn("split", F.when(F.col("_rank") <= F.col("_val"), "val").otherwise("train")).drop("_rank", "_val")


def sample_per_preset(rows: DataFrame, presets: DataFrame, name: str, seed: str) -> DataFrame:
    """int(n * ratio) rows without replacement for each preset(preset, ratio), and the output's name. Presets are a short
    list; each row is met with all of them."""
    kinds = presets.agg(F.collect_list(F.struct("preset", "ratio"))).scalar()
    every = rows.select(name, F.explode(kinds).alias("p")).select(name, "p.preset", "p.ratio")
    most = every.groupBy("preset").agg(F.floor(F.count("*") * F.first("ratio")).alias("_most"))
    key = F.md5(F.concat(F.lit(seed), "preset", F.col(name).cast("string")))
    chosen = ranked(every, ["preset"], name, key).join(most, "preset").where(F.col("_rank") <= F.col("_most"))
    return chosen.select("preset", name, F.concat_ws("_", F.col(name).cast("string"), "preset").alias("output"))


def normalised(boxes: DataFrame, width: float | Column, height: float | Column, least: float = 2.0, rule: str = "v3") -> DataFrame:
    """Boxes as centre and size in shares of the frame, with a reason where one is skipped: ``no_size`` without a frame
    size, and by rule: v3 clips to the frame and skips what is under ``least`` pixels (``small``); v2 clips nothing and
    skips centres outside of the frame and sizes that are none or more than the frame (``outside``); v1 takes x2 and y2
    as width and height and skips nothing."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    if rule == "v3":
        x1, x2 = (F.least(F.greatest(v, F.lit(0.0)), w) for v in (x1, x2))
        y1, y2 = (F.least(F.greatest(v, F.lit(0.0)), h) for v in (y1, y2))
    elif rule == "v1":
        x2, y2 = x1 + x2, y1 + y2
    shares = {"cx": (x1 + x2) / 2 / w, "cy": (y1 + y2) / 2 / h, "w": (x2 - x1) / w, "h": (y2 - y1) / h}
    skip = F.when(w.isNull() | h.isNull(), "no_size")
    if rule == "v3":
        skip = skip.when((x2 - x1 < least) | (y2 - y1 < least), "small")
    elif rule == "v2":
        inside = [(shares[c] > 0) & (shares[c] < 1) for c in ("cx", "cy")] + [(shares[c] > 0) & (shares[c] <= 1) for c in ("w", "h")]
        skip = skip.when(~(inside[0] & inside[1] & inside[2] & inside[3]), "outside")
    return boxes.select("frame", "box_no", "cls", *(F.round(v, 8).alias(n) for n, v in shares.items()), skip.alias("skipped"))


def label_counters(images: DataFrame, rows: DataFrame) -> DataFrame:
    """images, no_size, empty, written, boxes, small, outside: what became of images(frame, sized boolean) and of their
    boxes; an image without a usable box is empty and is not written."""
    usable = F.col("skipped").isNull()
    of = rows.groupBy("frame").agg(F.count_if(usable).alias("kept"), *(F.count_if(F.col("skipped") == k).alias(k) for k in ("small", "outside")))
    joined = images.join(of, "frame", "left").na.fill(0, ["kept", "small", "outside"])
    sized = F.col("sized")
    return joined.agg(
        F.count("*").alias("images"), F.count_if(~sized).alias("no_size"), F.count_if(sized & (F.col("kept") == 0)).alias("empty"), F.count_if(sized & (F.col("kept") > 0)).alias("written"),
        *(F.coalesce(F.sum(F.when(sized, F.col(c))), F.lit(0).cast("long")).alias(n) for c, n in (("kept", "boxes"), ("small", "small"), ("outside", "outside"))),
    )


def label_text(rows: DataFrame) -> DataFrame:
    """frame, lines, boxes: one text for each image, lines in box order."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")
    items = F.array_sort(F.collect_list(F.struct("box_no", line.alias("line"))))
    return rows.where("skipped is null").groupBy("frame").agg(items.alias("i")).select("frame", F.array_join(F.transform("i", lambda x: x["line"]), "\n").alias("lines"), F.size("i").cast("long").alias("boxes"))


def parse_labels(lines: DataFrame) -> DataFrame:
    """file, line_no, fields int, cls int, cx, cy, w, h double of label lines; values that are no numbers are null."""
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda p: p != "")
    number = lambda k: F.try_element_at(F.col("_p"), F.lit(k)).try_cast("double")
    return lines.withColumn("_p", parts).select("file", "line_no", F.size("_p").alias("fields"), number(1).cast("int").alias("cls"), *(number(k).alias(n) for k, n in enumerate(("cx", "cy", "w", "h"), 2)))


def validate_labels(images: DataFrame, labels: DataFrame, classes: int = 5) -> DataFrame:
    """file, line_no, error: one row for each fault of a parsed label line, and for an image without a label."""
    bad = F.lit(False)
    for c in ("cx", "cy", "w", "h"):
        bad = bad | ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    whole = F.col("fields") == 5
    codes = F.array_compact(F.array(F.when(~whole, "field_count"), F.when(whole & ~F.coalesce(F.col("cls").between(0, classes - 1), F.lit(False)), "class"), F.when(whole & bad, "coordinates")))
    faults = labels.select("file", "line_no", F.explode(codes).alias("error"))
    missing = images.join(labels.select("file").distinct(), "file", "left_anti").select("file", F.lit(None).cast("long").alias("line_no"), F.lit("missing_label").alias("error"))
    return faults.unionByName(missing)


def dense_classes(rows: DataFrame, category: str, excluded: list[int]) -> DataFrame:
    """category -> dense class id from 0, without excluded ones (as many rows as categories)."""
    kept = rows.select(category).distinct().where(~F.col(category).isin(excluded))
    return kept.select(category, (F.dense_rank().over(Window.orderBy(category)) - 1).alias("cls"))


def inconsistent_files(categories: DataFrame) -> DataFrame:
    """file, consistent: whether a file's set of (id, name) equals the first file's."""
    marks = categories.groupBy("file").agg(F.md5(F.to_json(F.array_sort(F.collect_set(F.struct("category", "name")))).cast("binary")).alias("mark"))
    return marks.select("file", (F.col("mark") == marks.agg(F.min_by("mark", "file")).scalar()).alias("consistent"))


def sizes_by_code(images: DataFrame, codes: DataFrame, fallback: DataFrame) -> DataFrame:
    """file, width, height, known: by resolution code, else the camera's fallback."""
    rows = images.join(codes, "code", "left").join(fallback.toDF("camera", "fw", "fh"), "camera", "left")
    return rows.select("file", "camera", F.coalesce("width", "fw").alias("width"), F.coalesce("height", "fh").alias("height"), F.col("width").isNotNull().alias("known"))


def polygons(rows: DataFrame, width: float, height: float) -> DataFrame:
    """file, no, points: flat pixel coordinates as clipped shares; fewer than three points are empty."""
    n = F.floor(F.size("flat") / 2)
    clip = lambda v: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), 8)
    points = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(clip(F.element_at("flat", (2 * k - 1).cast("int")) / width).alias("x"), clip(F.element_at("flat", (2 * k).cast("int")) / height).alias("y")))
    return rows.select("file", "no", F.when(n >= 3, points).alias("points"))


def polygon_counters(images: DataFrame, rows: DataFrame) -> DataFrame:
    """images, missing_image, polygons, empty_poly, background_only: what became of images(file, present boolean) and of
    their polygons(file, no, points; null points are an annotation without a polygon). An image that is there and has
    no polygon is background only; what belongs to a missing image counts nowhere."""
    of = rows.groupBy("file").agg(F.count("points").alias("polygons"), F.count_if(F.col("points").isNull()).alias("empty_poly"))
    joined = images.join(of, "file", "left").na.fill(0, ["polygons", "empty_poly"])
    here = F.col("present")
    total = lambda c: F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0).cast("long")).alias(c)
    return joined.agg(F.count_if(here).alias("images"), F.count_if(~here).alias("missing_image"), total("polygons"), total("empty_poly"), F.count_if(here & (F.col("polygons") == 0)).alias("background_only"))


def removal_manifest(rejected: DataFrame, labels: DataFrame, orphans: DataFrame, errors: DataFrame) -> DataFrame:
    """file, reason of everything to remove but files that could not be read."""
    every = rejected.select("file", F.lit("rejected").alias("reason")).unionByName(labels.join(rejected, "file", "left_semi").select("file", F.lit("label").alias("reason"))).unionByName(orphans.select("file", F.lit("orphan").alias("reason")))
    return every.join(errors.select("file"), "file", "left_anti").distinct()


def augmented_manifest(originals: DataFrame, samples: DataFrame, negatives: DataFrame, most_negatives: int, seed: str) -> DataFrame:
    """output, origin: originals, preset samples, and at most ``most_negatives`` negatives by hash order."""
    some = negatives.orderBy(shuffled(F.col("file"), seed), "file").limit(most_negatives)
    parts = [(originals, F.col("file").cast("string"), "original"), (samples, F.col("output"), "augmented"), (some, F.col("file").cast("string"), "negative")]
    frames = [f.select(c.alias("output"), F.lit(o).alias("origin")) for f, c, o in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
