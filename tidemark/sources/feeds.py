"""Readers of payloads: text feeds, JSON catalogs, water levels and label files. Each takes a DataFrame with the payload
in a column (spark.read.text or .json make one), so files, tables and streams are read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import number_in, parse_digits_time
from tidemark.operators.sequences import numbered


def lines_of(files: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """key, pos, line: the non-blank lines of whole-text files."""
    return files.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "^﻿", ""))).where("line <> ''")


def minute_table(files: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """key, pos, at, fields map<string,string> of a weather station's minute feed.

    The last header line counts (three dialects; its first column is TM); rows are comma or blank separated, a trailing
    "=" goes, short rows are padded and long ones cut, rows without a time go."""
    lines = lines_of(files, key, text)
    head = F.trim(F.regexp_replace("line", "^#+", ""))
    is_header = F.col("line").startswith("#") & (head.startswith("YYMMDDHHMI") | F.upper(head).startswith("TM,") | F.upper(head).rlike(r"^TM\s+STN(\s|$)"))
    split = lambda c: F.transform(F.when(c.contains(","), F.split(c, ",")).otherwise(F.split(c, r"\s+")), lambda x: F.trim(x))
    names = F.transform(split(head), lambda x, i: F.when(i == 0, F.lit("TM")).otherwise(F.regexp_replace(F.upper(x), "-", "_")))
    headers = lines.where(is_header).groupBy(key).agg(F.max_by(names, "pos").alias("_names"))
    rows = lines.where(~F.col("line").startswith("#")).join(headers, key)
    values = split(F.trim(F.regexp_replace(F.regexp_replace("line", r"[,\s]*=$", ""), r",\s*$", "")))
    n = F.size("_names")
    padded = F.slice(F.concat(values, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    out = rows.select(key, "pos", F.map_from_arrays("_names", padded).alias("fields"))
    return out.withColumn("at", parse_digits_time(F.col("fields")["TM"])).where("at is not null").select(key, "pos", "at", "fields")


def grid_points(files: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """key, at, value: the last line of a file that has a time and a number; values are never below 0."""
    lines = lines_of(files, key, text).where(~F.col("line").startswith("#"))
    tokens = F.filter(F.split("line", r"[\s,]+"), lambda x: x != "")
    rows = lines.withColumn("_times", F.filter(F.transform(tokens, lambda x: parse_digits_time(x)), lambda x: x.isNotNull())).withColumn("_numbers", F.filter(F.transform(tokens, lambda x: number_in(x)), lambda x: x.isNotNull()))
    rows = rows.where((F.size("_times") > 0) & (F.size("_numbers") > 0))
    last = F.max(F.struct("pos", F.col("_times")[0].alias("at"), F.greatest(F.element_at("_numbers", -1), F.lit(0.0)).alias("value"))).alias("_l")
    return rows.groupBy(key).agg(last).select(key, "_l.at", "_l.value")


def camera_catalog(items: DataFrame, order: str = "pos", payload: str = "item") -> DataFrame:
    """Cameras from catalog items as JSON text, each with its ``detail`` list: rows without a URL go, the first of each
    URL stays, places outside 33-39 N, 124-132 E become null, ids count in order. A catalog is one city's."""
    row = "hmpg_cmra_url string, cmra_y_crdn string, cmra_x_crdn string, istl_lctn string, drct_lctn string"
    parsed = items.select(order, F.from_json(payload, f"ixr_nm string, {row}, detail array<struct<{row.replace(' string', ': string')}>>").alias("i"))
    fields = [f.split()[0] for f in row.split(", ")]
    own = F.struct(*(F.col(f"i.{f}").alias(f) for f in fields))
    rows = parsed.select(order, F.col("i.ixr_nm").alias("parent"), F.posexplode(F.concat(F.array(own), F.coalesce("i.detail", F.slice(F.array(own), 1, 0)))).alias("sub", "r"))
    url = F.trim("r.hmpg_cmra_url")
    rows = rows.withColumn("stream_url", F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)).where("stream_url <> ''")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("stream_url").orderBy(order, "sub"))).where("_rank = 1")
    lat, lon = F.col("r.cmra_y_crdn").try_cast("double"), F.col("r.cmra_x_crdn").try_cast("double")
    inside = F.coalesce(lat.between(33, 39) & lon.between(124, 132), F.lit(False))
    some = lambda c: F.nullif(c, F.lit(""))
    name = F.coalesce(some(F.col("parent")), some(F.col("r.istl_lctn")), some(F.col("r.drct_lctn")), F.lit("이름없음"))
    rows = numbered(rows, [], [order, "sub"], F.floor(F.col(order) / 4096))
    return rows.select(F.format_string("POH-%03d", "number").alias("id"), name.alias("name"), F.coalesce(some(F.col("r.istl_lctn")), some(F.col("r.drct_lctn")), F.lit("")).alias("address"), F.when(inside, lat).alias("lat"), F.when(inside, lon).alias("lon"), "stream_url")


# fixed values: names that water-level services give their fields
WATER_NAMES = {
    "id": ("id", "station_id", "stationId", "station_code", "stationCode", "wlobscd", "wlobsCd", "obscd", "code"),
    "name": ("name", "station_name", "stationName", "wlobsnm", "obsnm", "site_name", "siteName"),
    "level_m": ("level_m", "water_level_m", "waterLevel", "water_level", "level", "wl", "wal", "wlvalue", "wl_value"),
    "level_cm": ("level_cm", "water_level_cm"),
    "flow_cms": ("flow_cms", "flow", "flux", "discharge", "qty"),
    "warning_m": ("warning_m", "warningLevel", "warning_level", "attention_level"),
    "danger_m": ("danger_m", "dangerLevel", "danger_level", "alarm_level"),
    "lat": ("lat", "latitude", "y"),
    "lon": ("lon", "lng", "longitude", "x"),
    "observed_at": ("observed_at", "observedAt", "obs_time", "obsTime", "tm", "datetime", "dateTime", "obsrdate", "measure_time"),
}
# fixed values: fields by which an object is a sensor, and where lists of them are looked for first
SENSOR_KEYS = ("level_m", "water_level_m", "level", "wal", "wl", "wlobscd", "wlobsCd", "wlobsnm", "station_id", "stationId", "station_name", "stationName", "flux")
ENVELOPES = ("sensors", "items", "item", "records", "data", "list", "result", "results", "response", "body", "header")


def sensor_list(payloads: DataFrame, text: str, out: str, levels: int = 6) -> DataFrame:
    """Payloads with the JSON text of their list of sensors, or of a single one: level by level the first known envelope,
    else the first field, that holds either."""
    holds = r"\[\s*\{|\"(" + "|".join(SENSOR_KEYS) + r")\"\s*:"
    rows = payloads.withColumn(out, F.trim(text))
    for _ in range(levels):
        rows = rows.withColumn("_m", F.from_json(out, "map<string,string>"))
        good = lambda c: F.when(c.rlike(r"^\s*[\[{]") & c.rlike(holds), c)
        known = F.arrays_overlap(F.map_keys("_m"), F.array(*map(F.lit, SENSOR_KEYS)))
        inner = F.coalesce(*(good(F.try_element_at("_m", F.lit(n))) for n in ENVELOPES), F.try_element_at(F.filter(F.map_values("_m"), lambda c: good(c).isNotNull()), F.lit(1)))
        rows = rows.withColumn(out, F.when(F.col(out).startswith("[") | F.col("_m").isNull() | known, F.col(out)).otherwise(F.coalesce(inner, out))).drop("_m")
    return rows


def water_levels(payloads: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """key, pos and the fields of WATER_NAMES (numbers as double, centimetres become metres) of JSON payloads, whatever
    envelopes their sensors are in. XML payloads go through ``xml_items`` first."""
    payloads = sensor_list(payloads.select(key, text), text, "_list")
    lists = F.when(F.col("_list").startswith("["), F.from_json("_list", "array<map<string,string>>")).otherwise(F.array(F.from_json("_list", "map<string,string>")))
    rows = payloads.select(key, F.posexplode(lists).alias("pos", "s")).where("s is not null")

    def first(name: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.try_element_at("s", F.lit(n))), F.lit("")) for n in WATER_NAMES[name]))

    number = lambda name: F.nullif(F.regexp_extract(F.regexp_replace(first(name), ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")
    level = F.coalesce(number("level_m"), number("level_cm") / 100)
    return rows.select(key, "pos", F.coalesce(first("id"), F.concat(F.lit("sensor-"), F.col("pos").cast("string"))).alias("id"), F.coalesce(first("name"), F.lit("이름 없는 수위계")).alias("name"), level.alias("level_m"), *(number(n).alias(n) for n in ("flow_cms", "warning_m", "danger_m", "lat", "lon")), first("observed_at").alias("observed_at"))


def xml_items(payloads: DataFrame, key: str = "file", text: str = "value", path: str = "body/items/item") -> DataFrame:
    """key, value: the items of XML payloads as JSON lists that ``water_levels`` reads."""
    names = [n for every in WATER_NAMES.values() for n in every]
    schema = f"array<struct<{', '.join(f'{n}: string' for n in dict.fromkeys(names) if n.lower() not in [m.lower() for m in names[: names.index(n)]])}>>"
    steps = path.split("/")
    for step in reversed(steps[1:]):
        schema = f"struct<{step}: {schema}>"
    items = F.from_xml(F.col(text), f"{steps[0]} {schema}")
    for step in steps:
        items = items[step]
    return payloads.select(key, F.to_json(items).alias("value"))


def camera_annotations(files: DataFrame, excluded: tuple[str, ...] = (), key: str = "file", text: str = "value") -> DataFrame:
    """key, image, category, x, y, w, h of a camera's JSON with images and annotations whose category and box lists run
    in parallel; excluded category names go. A camera's annotations may be split into several files of its key."""
    schema = "categories array<struct<id: int, name: string>>, images array<struct<id: int, file_name: string>>, annotations array<struct<image_id: int, category_id: array<int>, bbox: array<array<double>>>>"
    d = files.select(key, F.from_json(text, schema).alias("d"))
    images = d.select(key, F.explode("d.images").alias("i")).select(key, F.col("i.id").alias("image_id"), F.element_at(F.split("i.file_name", "/"), -1).alias("image"))
    boxes = d.select(key, F.explode("d.annotations").alias("a")).select(key, F.col("a.image_id").alias("image_id"), F.explode(F.arrays_zip(F.col("a.category_id").alias("category"), F.col("a.bbox").alias("box"))).alias("z"))
    names = d.select(key, F.explode("d.categories").alias("c")).select(key, F.col("c.id").alias("category"), "c.name").distinct()
    rows = boxes.select(key, "image_id", "z.category", *(F.col("z.box")[k].alias(n) for k, n in enumerate("xywh"))).join(images, [key, "image_id"]).join(names, [key, "category"], "left")
    return rows.where(~F.coalesce(F.col("name").isin(list(excluded)), F.lit(False))).select(key, "image", "category", "x", "y", "w", "h")


def coco_polygons(files: DataFrame, key: str = "file", text: str = "value") -> DataFrame:
    """key, image, cls (dense, dummy categories left out unless there are only those), flat array<double> of COCO files."""
    schema = "categories array<struct<id: int, name: string, supercategory: string>>, images array<struct<id: int, file_name: string>>, annotations array<struct<image_id: int, category_id: int, segmentation: array<array<double>>>>"
    d = files.select(key, F.from_json(text, schema).alias("d"))
    real = F.filter("d.categories", lambda c: F.coalesce(c["supercategory"], F.lit("")) != "none")
    used = F.array_sort(F.transform(F.when(F.size(real) > 0, real).otherwise(F.col("d.categories")), lambda c: c["id"]))
    d = d.withColumn("used", used)
    images = d.select(key, F.explode("d.images").alias("i")).select(key, F.col("i.id").alias("image_id"), F.col("i.file_name").alias("image"))
    rows = d.select(key, "used", F.explode("d.annotations").alias("a")).select(key, F.col("a.image_id").alias("image_id"), (F.array_position("used", F.col("a.category_id")) - 1).cast("int").alias("cls"), F.explode("a.segmentation").alias("flat"))
    return rows.where("cls >= 0").join(images, [key, "image_id"]).select(key, "image", "cls", "flat")
