"""Exact quantiles of groups of any size, by distributed selection.

A quantile of a group lies between two values of its order (it is interpolated). A mergeable sketch brackets the places
that are sought, one more pass counts what lies below and inside of each bracket, exactly; brackets that still hold more
than ``LIMIT`` rows are narrowed again. Only the rows of the brackets are then counted by value and put in order, so no
task ever holds a large group. A bracket that turns out not to hold its place is left as it was and tried wider. Where
all groups are small, each is put in order by itself, in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.sinks import written

LIMIT = 1 << 20
SMALL = 4096  # rows of a group that an aggregation may hold
STEPS, ACCURACY = 200, 20_000


def _in_brackets(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    return values.join(brackets, keys).where(F.col("value").between(F.col("low"), F.col("high")))


def _narrowed(values: DataFrame, brackets: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The brackets, with those that hold more than ``limit`` rows narrowed around the place that they are for."""
    wide = brackets.where((F.col("inside") > limit) & (F.col("low") < F.col("high")))
    grid = [k / STEPS for k in range(STEPS + 1)]
    sketch = _in_brackets(values, wide, keys).groupBy(*keys, "p").agg(F.percentile_approx("value", grid, ACCURACY).alias("grid"))
    at = F.floor((F.floor("place") - F.col("below")) * STEPS / F.col("inside"))
    around = lambda k: F.element_at("grid", F.least(F.greatest(at + k + 1, F.lit(1)), F.lit(STEPS + 1)).cast("int"))
    tried = wide.join(sketch, [*keys, "p"]).withColumns({"a": F.greatest("low", around(-F.col("spare"))), "b": F.least("high", around(F.col("spare") + 1))}).drop("grid")
    less, within = F.count_if(F.col("value") < F.col("a")), F.count_if(F.col("value").between(F.col("a"), F.col("b")))
    counted = _in_brackets(values, tried, keys).groupBy(*keys, "p").agg(less.alias("less"), within.alias("within"))
    found = tried.join(counted, [*keys, "p"])
    start = F.col("below") + F.col("less")
    good = (start <= F.floor("place")) & (F.ceil("place") < start + F.col("within"))
    take = lambda new, old: F.when(good, new).otherwise(F.col(old)).alias(old)
    spare = F.when(good & (F.col("within") < F.col("inside")), F.lit(1)).otherwise(F.col("spare") * 4).alias("spare")
    new = found.select(*keys, "p", "n", "place", take(F.col("a"), "low"), take(F.col("b"), "high"), take(start, "below"), take(F.col("within"), "inside"), spare)
    rest = brackets.join(wide.select(*keys, "p"), [*keys, "p"], "left_anti")
    return rest.unionByName(new)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str | Column, points: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """keys and a column for each of ``points`` (name to share): quantiles with linear interpolation of the values that
    are not null. Groups without any are left out; null keys are a group."""
    if keys and limit >= SMALL:
        known = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_value")).where("_value is not null")
        most = known.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= SMALL:
            return known.groupBy(*keys).agg(*(F.percentile("_value", F.lit(float(p))).alias(n) for n, p in points.items()))
    names = [f"k{i}" for i in range(len(keys))]
    safe = [F.struct(F.col(k).alias("k")).alias(n) for k, n in zip(keys, names)]  # structs of nulls are equal
    values = rows.select(*safe, (F.col(value) if isinstance(value, str) else value).cast("double").alias("value")).where("value is not null")
    if not keys:
        names, values = ["k0"], values.withColumn("k0", F.lit(0))
    ends = values.groupBy(*names).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    shares = F.explode(F.array(*(F.lit(float(p)) for p in sorted(set(points.values()))))).alias("p")
    brackets = ends.select(*names, shares, "n", "low", "high")
    brackets = brackets.select(*names, "p", "n", ((F.col("n") - 1) * F.col("p")).alias("place"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(1).alias("spare"))
    brackets = written(brackets, "brackets")
    wide = (F.col("inside") > limit) & (F.col("low") < F.col("high")) & (F.col("spare") < STEPS)
    if brackets.where(wide).limit(1).count():
        values = written(values, "values")  # each round reads them again
    while brackets.where(wide).limit(1).count():
        brackets = written(_narrowed(values, brackets, names, limit), "brackets")
    counts = _in_brackets(values, brackets, names).groupBy(*names, "p", "place", "below", "value").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*names, "p").orderBy("value"))
    sides = [F.min(F.when(F.col("upto") > edge, F.col("value"))).alias(side) for side, edge in (("a", F.floor("place")), ("b", F.ceil("place")))]
    found = counts.withColumn("upto", upto).groupBy(*names, "p", "place").agg(*sides)
    share = F.col("place") - F.floor("place")
    result = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("place") - F.col("place")) * F.col("a") + share * F.col("b"))
    wide = found.withColumn("result", result).groupBy(*names).agg(*(F.max(F.when(F.col("p") == float(p), F.col("result"))).alias(n) for n, p in points.items()))
    return wide.select(*(F.col(f"{n}.k").alias(k) for k, n in zip(keys, names)), *points)
