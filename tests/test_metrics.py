"""Exact quantiles in narrowed brackets, and the area under a union of boxes."""

import random

import numpy as np
import pytest

from tidemark.operators import boxes as B
from tidemark.operators.quantiles import exact_quantiles

POINTS = {"least": 0.0, "low": 0.05, "half": 0.5, "high": 0.95, "most": 1.0}


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_quantiles_of_one_large_group_and_small_ones(spark, limit):
    r = random.Random(limit)
    groups = {
        "all": [r.gauss(0, 1) for _ in range(6000)],
        "ties": [r.choice([1.0, 1.0, 1.0, 2.0, 5.0]) for _ in range(3000)],
        "one value": [7.0] * 500,
        "far": [10.0 ** r.uniform(-9, 9) for _ in range(2500)],
        "single": [3.5],
        None: [1.0, 2.0],
        "two": [1.0, 2.0, None],
        "none": [None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    found = exact_quantiles(spark.createDataFrame(r.sample(rows, len(rows)), "g string, v double").repartition(6), ["g"], "v", POINTS, limit)
    got = {x.g: tuple(x[n] for n in POINTS) for x in found.collect()}
    want = {g: tuple(np.quantile([v for v in values if v is not None], list(POINTS.values()))) for g, values in groups.items() if g != "none"}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12, abs=1e-12)
    whole = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"half": 0.5}, limit).collect()
    assert [x.half for x in whole] == [pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))]
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", POINTS, limit).count() == 0


@pytest.mark.parametrize("pixel_rows", [True, False])
def test_coverage_equals_cells_between_all_edges(spark, pixel_rows):
    r = random.Random(9)
    box = lambda most: (x := r.uniform(0, 60), y := r.uniform(0, 60), x + r.uniform(0.5, most), y + r.uniform(0.5, most))
    truth = [(f, k, *box(40)) for f in range(4) for k in range(3)] + [(9, 0, 1.0, 1.0, 5.0, 5.0), (3, 7, 2.0, 2.0, 2.0, 9.0)]
    found = [(f, *box(30)) for f in range(4) for _ in range(9)] + [(0, 0.0, 0.0, 50_000.0, 50_000.0)]
    sides = "x1 double, y1 double, x2 double, y2 double"
    got = B.coverage(spark.createDataFrame(truth, f"frame int, box_no int, {sides}"), spark.createDataFrame(found, f"frame int, {sides}"), ["frame"], pixel_rows=pixel_rows)
    got = {(x.frame, x.box_no): x.covered for x in got.collect()}
    up = np.ceil if pixel_rows else float
    for f, k, x1, y1, x2, y2 in truth:
        hits = [(max(a, x1), up(max(b, y1)), min(c, x2), up(min(d, y2))) for g, a, b, c, d in found if g == f and a < x2 and c > x1 and b < y2 and d > y1]
        xs, ys = sorted({v for h in hits for v in (h[0], h[2])}), sorted({v for h in hits for v in (h[1], h[3])})
        area = sum((b - a) * (d - c) for a, b in zip(xs, xs[1:]) for c, d in zip(ys, ys[1:]) if any(h[0] <= a and h[2] >= b and h[1] <= c and h[3] >= d for h in hits))
        size = (x2 - x1) * (y2 - y1)
        assert got[f, k] == pytest.approx(area / size if size > 0 else 0.0, abs=1e-9)
