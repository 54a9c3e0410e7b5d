"""Column functions: parsing, cleaning, levels and names. All are expressions that Catalyst compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: flood stages and their depths, and the breaks between levels
STAGE_DEPTH_CM = (0, 8, 25, 48, 70)
DEPTH_BREAKS_CM = (1, 12, 35, 60)
RAIN_BREAKS_MM = (1, 5, 15, 30)
MIN_CONFIDENCE = 0.70
NUMBER = r"[-+]?[0-9]*\.?[0-9]+"


def level_of(value: Column, breaks: tuple = DEPTH_BREAKS_CM) -> Column:
    """0..n by ascending breaks; null is level 0."""
    out = F.lit(0)
    for k, b in enumerate(breaks, 1):
        out = F.when(value >= b, k).otherwise(out)
    return out.cast("int")


def stage_depth(level: Column) -> Column:
    """Depth in cm of a stage, clamped to the known stages."""
    return F.element_at(F.array(*(F.lit(d) for d in STAGE_DEPTH_CM)), (F.least(F.greatest(level, F.lit(0)), F.lit(4)) + 1).cast("int"))


def rain_depth(rain: Column) -> Column:
    """Display depth in cm of an hour's rain: none below 1 mm, else 1.8 cm a mm within 6 to 90."""
    return F.when(rain < 1, F.lit(0.0)).otherwise(F.least(F.lit(90.0), F.greatest(F.lit(6.0), rain * 1.8)))


def number_in(text: Column, missing_at: float = -9.0) -> Column:
    """The first number in a text; at or below the sentinel it is missing."""
    value = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).cast("double")
    return F.when(value > missing_at, value)


def first_valid(*columns: Column) -> Column:
    return F.coalesce(*columns)


# fixed values: words of the rain reports
NO_RAIN, LESS_THAN = "없음", "미만"


def rain_text(text: Column, default: float = 0.0) -> Column:
    """Rain amounts written as text: none or empty is 0, commas are dropped, "less than x" is half of x; a text
    without a number, or null, gives the default."""
    value = F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")
    return F.when((F.trim(text) == "") | text.contains(NO_RAIN), 0.0).when(value.isNull(), default).when(text.contains(LESS_THAN), value / 2).otherwise(value)


# fixed values: precipitation codes
PRECIPITATION = {0: "없음", 1: "비", 2: "비/눈", 3: "눈", 5: "빗방울", 6: "빗방울/눈날림", 7: "눈날림"}


def precipitation_name(code: Column) -> Column:
    out = F.concat(F.lit("코드 "), code.cast("string"))
    for k, name in PRECIPITATION.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def parse_time(text: Column, kst_hours: int = 9) -> Column:
    """Naive UTC time of an ISO text (with or without a zone) or a compact one; without a zone it is local (UTC+9).
    Null where no format fits."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "([0-9])T([0-9])", "$1 $2"), "Z$", "+00:00")
    zoned = F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ssXXX")).cast("timestamp_ntz")
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMdd")
    local = F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in formats)).cast("timestamp_ntz")
    return F.coalesce(zoned, local - F.make_dt_interval(hours=F.lit(kst_hours)))


def parse_digits_time(text: Column) -> Column:
    """A time from the digits of a text, by its first 12, 10 or 8 that make one."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    tries = []
    for size, pattern in ((12, "yyyyMMddHHmm"), (10, "yyyyMMddHH"), (8, "yyyyMMdd")):
        tries.append(F.when(F.length(digits) >= size, F.try_to_timestamp(F.substring(digits, 1, size), F.lit(pattern))))
    return F.coalesce(*tries).cast("timestamp_ntz")


def identity_key(text: Column) -> Column:
    """Lower case, letters (Latin, Hangul) and digits only."""
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9가-힣]", "")


def human_name(text: Column) -> Column:
    """A camera's name without the device code before it; the code alone stays."""
    plain = F.trim(F.regexp_replace(F.trim(text), r"^[A-Za-z][0-9]{2}[-_][0-9]{3}\s*", ""))
    return F.when(plain == "", text).otherwise(plain)


def confident(confidence: Column, least: float = MIN_CONFIDENCE) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) >= min(max(least, 0.0), 1.0)


def authoritative(stage: Column, positive_confirmed: Column) -> Column:
    return (stage == 0) | F.coalesce(positive_confirmed, F.lit(False))


def floored(stage: Column, confidence: Column, trusted: Column, least_stage: int = 1, least_confidence: float = 0.7) -> tuple[Column, Column, Column]:
    """Clamped stage and confidence, raised to the floor for a trusted camera below it, and whether they were."""
    stage = F.least(F.greatest(F.coalesce(stage, F.lit(0)), F.lit(0)), F.lit(4))
    confidence = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    raised = F.coalesce(trusted, F.lit(False)) & (stage < least_stage)
    return F.when(raised, least_stage).otherwise(stage), F.when(raised, F.greatest(confidence, F.lit(least_confidence))).otherwise(confidence), raised


def sensor_level(level_m: Column, water_level_m: Column, wal: Column, level_cm: Column, water_level_cm: Column, value: Column) -> Column:
    """Metres from whichever field is given; the later ones are centimetres."""
    return F.coalesce(level_m, water_level_m, wal, F.coalesce(level_cm, water_level_cm, value) / 100)


def details(text: Column) -> Column:
    """A details payload as JSON text: an object stays, anything else is its label."""
    parsed = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, text).otherwise(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("label"))))


def bucket(time: Column, minutes: int) -> Column:
    """Start of the time bucket inside the hour; minutes divide 60."""
    return (F.date_trunc("hour", time) + F.make_dt_interval(mins=(F.floor(F.minute(time) / minutes) * minutes).cast("int"))).cast("timestamp_ntz")


def bucket_minutes(hours: Column) -> Column:
    """Bucket width for a range: up to 6 h 1, 48 h 5, 14 d 30, else 60."""
    return F.when(hours <= 6, 1).when(hours <= 48, 5).when(hours <= 14 * 24, 30).otherwise(60)


def stage_from(class_id: Column, label: Column) -> Column:
    """A stage from a class id 0..4, else from the first digit in a label, clamped."""
    digit = F.coalesce(F.nullif(F.regexp_extract(label, "[0-9]", 0), F.lit("")).cast("int"), F.lit(0))
    return F.when(class_id.between(0, 4), class_id).otherwise(F.least(F.greatest(digit, F.lit(0)), F.lit(4))).cast("int")


# fixed values: class names of faces and plates, without separators
FACES = ("face", "faces", "humanface")
PLATES = ("plate", "licenseplate", "licenceplate", "numberplate", "vehicleplate", "registrationplate")


def privacy_kind(label: Column) -> Column:
    """face, license_plate or null."""
    plain = F.regexp_replace(F.lower(F.trim(label)), "[_ -]", "")
    return F.when(plain.isin(*FACES), "face").when(plain.isin(*PLATES), "license_plate")


def signature(rows: Column, shown: list[str] | None = None) -> Column:
    """SHA-256 of the canonical JSON of an array of structs, whatever its order: they are sorted by all fields, in their
    order, and written with those ``shown``."""
    rows = F.array_sort(rows)
    if shown:
        rows = F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in shown)))
    return F.sha2(F.to_json(rows).cast("binary"), 256)
