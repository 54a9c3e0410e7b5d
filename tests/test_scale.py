"""What keeps queries in proportion to their tables, and loops that give the same rows."""

import math
import random

from pyspark.sql import functions as F

from conftest import SF
from tidemark.functions import space as G
from tidemark.operators import boxes as B
from tidemark.operators import quantiles as Q
from tidemark.operators import terrain as T
from tidemark.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_regions_are_read_once_and_polygons_agree_with_a_loop(spark):
    assert not [x for x in plan(registry.queries()["fn_27"](spark, SF)).splitlines() if "Filter" in x and "split(" in x]
    rng = random.Random(3)
    rows = [(k, ";".join(f"{rng.randrange(9)},{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))), rng.random() * 9, rng.random() * 9) for k in range(300)]
    got = {r.k: r.i for r in spark.createDataFrame(rows, "k int, t string, x double, y double").select("k", G.inside(G.region(F.col("t")), F.col("x"), F.col("y")).alias("i")).collect()}
    for k, text, x, y in rows:
        p = [tuple(map(float, q.split(","))) for q in text.split(";")]
        cuts = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1]))
        assert got[k] == (cuts % 2 == 1 if len(p) >= 3 else None)


def test_matches_agree_with_a_loop_and_scores_read_them_once(spark):
    rng = random.Random(5)
    box = lambda: (float(x := rng.randrange(6)), float(y := rng.randrange(6)), x + 2.0 + rng.randrange(9), y + 2.0 + rng.randrange(9))
    found = [(f, c, k, rng.randrange(4) / 4, *box()) for f in range(60) for c in range(2) for k in range(rng.randrange(9))]
    truth = [(f, c, k, *box()) for f in range(65) for c in range(2) for k in range(rng.randrange(6))]
    p = spark.createDataFrame(found, "frame int, cls int, box_no int, conf double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(truth, "frame int, cls int, box_no int, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)

    used, want = set(), {}
    for f, c, k, conf, *a in sorted(found, key=lambda r: (-r[3], r[2])):
        best = max(((iou(a, g[3:]), -g[2]) for g in truth if g[:2] == (f, c) and g[:3] not in used), default=(0, 0))
        want[f, c, k] = best[0] >= 0.5
        if want[f, c, k]:
            used.add((f, c, -best[1]))
    matches = B.greedy_matches(p, t, ["frame", "cls"])
    assert {(r.frame, r.cls, r.box_no): r.hit for r in matches.collect()} == want and sum(want.values()) > 20
    scores = B.scores(matches, t, ["frame", "cls"], "cls")
    assert plan(scores).count("collect_list") == 1
    for r in scores.collect():
        mine = {k: v for k, v in want.items() if k[1] == r.cls}
        assert (r.predictions, r.hits) == (len(mine), sum(mine.values()))
        assert abs(r.miss_rate - (1 - len({k[0] for k, v in mine.items() if v}) / len({g[0] for g in truth}))) < 1e-12


def test_agreement_keeps_near_pairs_only(spark):
    rows = [(f, k, f"m{k % 3}", float(k), 0.0, k + 6.0, 6.0) for f in range(4) for k in range(9)]
    boxes = spark.createDataFrame(rows, "frame int, box_no int, model string, x1 double, y1 double, x2 double, y2 double")
    near = {(f, k, m) for f, k, a, x, *_ in rows for g, _, m, y, *_ in rows if g == f and m != a and max(0, 6 - abs(x - y)) / (6 + abs(x - y)) >= 0.5}
    got = B.agreement(boxes, ["frame"], 0.5)
    assert "max(iou" not in plan(got)
    assert {(r.model, r.other): round(r.share * 12) for r in got.collect()} == {(f"m{a}", f"m{b}"): sum(k % 3 == a and m == f"m{b}" for _, k, m in near) for a in range(3) for b in range(3) if a != b}


def test_small_groups_need_no_brackets(spark):
    rows = [(None if k % 4 == 0 else k % 4, None if k % 7 == 0 else float(k * 37 % 101)) for k in range(90)] + [(9, None)]
    data = spark.createDataFrame(rows, "k int, v double")
    got = Q.exact_quantiles(data, ["k"], "v", {"a": 0.05, "b": 0.5})
    assert "Join" not in plan(got)
    wide = Q.exact_quantiles(data, ["k"], "v", {"a": 0.05, "b": 0.5}, limit=10)
    assert sorted(map(str, got.collect())) == sorted(map(str, wide.collect())) and got.count() == 4


def test_lines_are_shuffled_before_they_become_cells(spark):
    rng = random.Random(9)
    lines = [(k % 5, *(rng.randrange(-9, 9) for _ in range(4))) for k in range(60)]
    got = T.line_cells(spark.createDataFrame(lines, "k int, r0 int, c0 int, r1 int, c1 int"), ["k"])
    want = set()
    for k, r0, c0, r1, c1 in lines:
        n = max(abs(r1 - r0), abs(c1 - c0))
        want |= {(k, math.floor(r0 + (r1 - r0) * i / max(n, 1) + 0.5), math.floor(c0 + (c1 - c0) * i / max(n, 1) + 0.5)) for i in range(n + 1)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    text = plan(got)
    assert text.count("Aggregate") == 1 and text.index("Generate") < text.index("Aggregate")


def test_cells_are_dealt_before_those_around_them(spark):
    got = T.buffered(spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 5, 5)], "k int, r int, c int"), ["k"], 2, 3)
    assert plan(got).index("Generate") < plan(got).index("RepartitionByExpression") and got.count() == 28 + 23
