"""Walks over grids and the flood surface against loops over cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grids
from tidemark.operators import terrain as G
from tidemark.plans import api as A

CELL = 30.0
NEAR = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def around(cell, cells):
    return [(cell[0] + r, cell[1] + c) for r, c in NEAR if (cell[0] + r, cell[1] + c) in cells]


def spill_by_hand(height, seed, friction):
    best, open_ = {seed: height[seed]}, {seed}
    while open_:
        at = min(open_, key=lambda k: best[k])
        open_.remove(at)
        for to in around(at, height):
            cost = max(best[at] + friction * (math.sqrt(2.0) if at[0] != to[0] and at[1] != to[1] else 1), height[to])
            if cost < best.get(to, math.inf):
                best[to] = cost
                open_.add(to)
    return best


def reached_by_hand(free, starts):
    seen, todo = set(), [s for s in starts if s in free]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += around(at, free)
    return seen


def patch_by_hand(height, spill, water, seed, stage, depth_cm, cell):
    reach = max(1.5 * cell, min(155.25, 55 + 28 * stage))
    limit = height[seed] + max(0.01, (depth_cm or (0, 8, 25, 48, 70)[stage]) / 100) + 0.3
    far = {k: math.hypot(k[0] - seed[0], k[1] - seed[1]) * cell for k in height}
    rank = {k: (spill[k] if k == seed else spill[k] + far[k] * 0.0025 + max(height[k] - height[seed], 0) * 0.15, far[k], k) for k in height}
    taken, passed, opened = [], set(), {seed}
    while len(taken) < (0, 5, 10, 18, 30)[stage] and opened - passed:
        at = min(opened - passed, key=rank.get)
        passed.add(at)
        if rank[at][0] <= limit or len(taken) < 4:
            taken.append(at)
            opened |= {k for k in around(at, height) if k not in water and far[k] <= reach + 1e-6}
    return set(taken)


def random_ground(r, rows, columns):
    ground = {(y, x): 2 + abs(x - columns // 2) / 9 + r.random() * 0.4 for y in range(rows) for x in range(columns)}
    for y in range(rows):  # a ridge with gaps
        ground[y, columns // 3] += r.choice([0, 3, 3, 3])
    return ground


def test_walks_equal_loops_on_grids_of_several_sizes(spark):
    r = random.Random(6)
    grounds = {f"s{k}": random_ground(r, *shape) for k, shape in enumerate([(11, 11), (19, 19), (1, 7), (15, 15)])}
    water = {s: {k for k in g if r.random() < 0.12} for s, g in grounds.items()}
    seeds = {s: (max(k[0] for k in g) // 2, max(k[1] for k in g) // 2) for s, g in grounds.items()}
    rows = [(s, y, x, e, (y, x) in water[s]) for s, g in grounds.items() for (y, x), e in g.items()]
    grid = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "source_id string, r int, c int, elev double, water boolean").repartition(3)
    known = [(s, *seeds[s], grounds[s][seeds[s]], k % 4 + 1, (0.0, 40.0, None, 5.0)[k]) for k, s in enumerate(grounds)]
    at = spark.createDataFrame(known, "source_id string, seed_r int, seed_c int, seed_elev double, stage int, depth_cm double")
    spill = {(x.source_id, x.r, x.c): x.spill for x in G.spill_heights(grid, at, CELL).collect()}
    by_hand = {s: spill_by_hand(g, seeds[s], 0.4 / 1000 * CELL) for s, g in grounds.items()}
    assert spill == {(s, *k): v for s, g in by_hand.items() for k, v in g.items()}

    sea = {(x.source_id, x.r, x.c) for x in G.open_sea(grid, 2.6).collect()}
    want = set()
    for s, g in grounds.items():
        ends = [max(k[i] for k in g) for i in (0, 1)]
        low = {k for k, e in g.items() if e <= 2.6}
        want |= {(s, *k) for k in reached_by_hand(low, [k for k in low if 0 in k or k[0] == ends[0] or k[1] == ends[1]])}
    assert sea == want
    wet = grid.withColumn("wet", (F.col("elev") < 3.2) | F.col("water"))
    found = {(x.source_id, x.r, x.c) for x in G.wet_component(wet, at, "wet").collect()}
    want = {s: reached_by_hand({k for k, e in g.items() if e < 3.2 or k in water[s]}, [seeds[s]]) for s, g in grounds.items()}
    assert found == {(s, *k) for s, cells in want.items() for k in cells}

    heights = spark.createDataFrame([(s, *k, v) for s, g in by_hand.items() for k, v in g.items()], "source_id string, r int, c int, spill double")
    patch = {}
    for x in G.least_footprint(grid.join(heights, ["source_id", "r", "c"]), at, CELL).collect():
        patch.setdefault(x.source_id, set()).add((x.r, x.c))
    for s, *seed, _, stage, depth in known:
        assert patch[s] == patch_by_hand(grounds[s], by_hand[s], water[s], tuple(seed), stage, depth, CELL)
        assert patch[s] == reached_by_hand(patch[s], [tuple(seed)])  # connected, and around the seed


def test_a_long_maze_is_walked_to_its_end():
    """Sweeps need many rounds where the way winds: a wall in every other row, open at alternating ends."""
    n = 21
    height = np.zeros((n, n, 1))
    for k in range(1, n, 2):
        height[k, :, 0] = 9.0
        height[k, 0 if k % 4 == 1 else n - 1, 0] = 0.0
    seed = np.zeros(height.shape, bool)
    seed[0, n - 1] = True
    by_hand = spill_by_hand({(y, x): float(height[y, x, 0]) for y in range(n) for x in range(n)}, (0, n - 1), 0.01)
    found = grids.spill(height, seed, 0.01)
    assert all(found[y, x, 0] == v for (y, x), v in by_hand.items())
    assert grids.reached(height < 1, seed).sum() == (height < 1).sum()


def tile_place(lon, lat, z):
    n = 2.0**z
    return (lon + 180) / 360 * n, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n


def sampled(tiles, lon, lat, z, size):
    fx, fy = tile_place(lon, lat, z)
    tile = tiles[z, math.floor(fx), math.floor(fy)]
    px, py = (min(max((f - math.floor(f)) * size - 0.5, 0), size - 1.0) for f in (fx, fy))
    x, y = min(math.floor(px), size - 2), min(math.floor(py), size - 2)
    at = lambda dy, dx: tile[(y + dy) * size + x + dx]
    wx, wy = px - x, py - y
    return (at(0, 0) * (1 - wx) + at(0, 1) * wx) * (1 - wy) + (at(1, 0) * (1 - wx) + at(1, 1) * wx) * wy


def drawn(points, lat0, lon0, dlat, dlon, cells):
    out = set()
    at = [(round((lat - lat0) / dlat), round((lon - lon0) / dlon)) for lon, lat in points]
    for a, b in zip(at, at[1:]):
        n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
        out |= {tuple(math.floor(p + (q - p) * k / n + 0.5) if n else p for p, q in zip(a, b)) for k in range(n + 1)}
    return out & cells


def surface_by_hand(source, tiles, zooms, size, roads, hydro, past):
    """The layers of one source: (level, cells, deepest, shown, whether it is the least footprint)."""
    _, lat, lon, stage, rain, depth_cm, kind = source
    s = min(max(stage, 1), 4)
    radius = max(3 * CELL, 160 + 90 * s + min(120, 4 * rain) if kind == "CCTV" else 150 + 115 * s + min(180, 4 * rain))
    half = min(max(math.ceil(2 * min(1000, radius) / CELL) + 1, 11), 101) // 2
    dlat, dlon = CELL / 110_540, CELL / (111_320 * math.cos(math.radians(lat)))
    place = {(r, c): (lat + (r - half) * dlat, lon + (c - half) * dlon) for r in range(2 * half + 1) for c in range(2 * half + 1)}
    zoom = max(z for z in zooms if all((z, *map(math.floor, tile_place(x, y, z))) in tiles for y, x in place.values()))
    height = {k: sampled(tiles, x, y, zoom, size) for k, (y, x) in place.items()}
    n = 2 * half + 1
    ground = np.array([[height[r, c] for c in range(n)] for r in range(n)])
    lines = lambda group: set().union(*(drawn(line, lat - half * dlat, lon - half * dlon, dlat, dlon, set(place)) for line in group))
    road, core = lines(roads), lines(hydro)
    low = {k for k, e in height.items() if e <= 0.35}
    sea = reached_by_hand(low, [k for k in low if 0 in k or n - 1 in k])
    water = sea | {(r + a, c + b) for r, c in core for a, b in [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]}
    gy, gx = np.gradient(ground, CELL)
    slope = np.hypot(gx, gy)
    middle = (half, half)
    if kind != "CCTV":
        free = [k for k in height if math.hypot(k[0] - half, k[1] - half) * CELL <= 90 + 1e-6]
        middle = min(free, key=lambda k: (height[k] + slope[k] * 25 + math.hypot(k[0] - half, k[1] - half) * CELL * 0.045, k))
    water = water - {middle}
    spill = spill_by_hand(height, middle, 0.12 / 1000 * CELL)
    wide = [math.exp(-(d**2) / (2 * 1.5**2)) for d in range(-6, 7)]
    clip = lambda v: min(max(v, 0), n - 1)
    tall = np.array([[sum(w * ground[clip(r + d), c] for d, w in zip(range(-6, 7), wide)) / sum(wide) for c in range(n)] for r in range(n)])
    soft = np.array([[sum(w * tall[r, clip(c + d)] for d, w in zip(range(-6, 7), wide)) / sum(wide) for c in range(n)] for r in range(n)])
    p10, p90 = np.percentile(ground, [10, 90])
    unit = lambda v: min(max(v, 0.0), 1.0)
    seen, cap = depth_cm / 100, (0.119, 0.349, 0.599, 1.2)[s - 1]
    surface = height[middle] + min(cap, max(seen, 0.05 + rain * 0.012))
    raw = {}
    for k, e in height.items():
        wet = min((math.hypot(k[0] - w[0], k[1] - w[1]) * CELL for w in core | sea), default=None)
        old = 0.0
        for plat, plon, level, recency in past:
            d = math.hypot((place[k][1] - plon) * 111_320 * math.cos(math.radians((place[k][0] + plat) / 2)), (place[k][0] - plat) * 110_540)
            old = max(old, (0.35 + 0.65 * level / 4) * recency * math.exp(-((d / 220) ** 2)) if d <= 700 else 0.0)
        flat = math.exp(-((slope[k] / 0.075) ** 2))
        beside = any((k[0] + a, k[1] + b) in road for a in (-1, 0, 1) for b in (-1, 0, 1))
        score = 0.24 * flat + 0.22 * unit((soft[k] - e + 0.15) / 1.5) + 0.22 * unit((p90 - e) / max(p90 - p10, 0.25)) + 0.11 * beside
        score = round(unit(score + (0.11 * math.exp(-((wet / 180) ** 2)) if wet is not None else 0) + 0.14 * unit(old)), 6)
        away = math.hypot(k[0] - middle[0], k[1] - middle[1]) * CELL
        land = k not in water
        reach = half * CELL
        first = spill[k] <= surface + 1e-5 and away <= reach and (score >= 0.26 or away <= 75) and land
        thin = max(surface - e, 0) * flat * max(1 - 0.08 * (away / reach) ** 2, 0.92) if first else 0
        held = seen * math.exp(-((away / max(45, min(115, 0.45 * reach))) ** 2)) if seen > 0 and spill[k] <= height[middle] + seen + 0.3 and land else 0
        raw[k] = max(thin, held)
    budget = max(250, rain / 1000 * math.pi * min(half * CELL, 300 + 130 * stage) ** 2 * 0.68 + seen * math.pi * 115**2 * 0.62)
    scale = min(1, budget / (sum(raw.values()) * CELL**2)) if sum(raw.values()) else 1
    shown = lambda k, v: round(x, 6) if (x := max(min(v, cap), min(seen, 1.2) if k == middle else 0)) >= 0.01 else 0.0
    depth, terrain = {k: shown(k, v * scale) for k, v in raw.items()}, {k: shown(k, v) for k, v in raw.items()}
    joined = reached_by_hand({k for k, v in depth.items() if v >= 0.01} | {middle}, [middle])
    out = []
    for level, least, most in ((1, 0.01, 11.9), (2, 0.12, 34.9), (3, 0.35, 59.9), (4, 0.6, math.inf)):
        cells = [k for k in joined if depth[k] >= 0.01 and terrain[k] >= least]
        if len(cells) >= 2:
            top = 100 * max(terrain[k] for k in cells)
            out.append((level, len(cells), round(top, 1), round(min(top, most), 1), False))
    if not out:
        top = round(max(100 * max(depth.values()), 1, depth_cm or (0, 8, 25, 48, 70)[s]), 1)
        out = [(s, len(patch_by_hand(height, spill, water, middle, s, depth_cm, CELL)), top, top, True)]
    wet = [v for v in depth.values() if v >= 0.01]
    return out, (len(wet), max(depth.values()), sum(wet) / len(wet) if wet else None), zoom


@pytest.mark.parametrize("seed", [1, 2])
def test_flood_surface_equals_a_loop(spark, seed):
    r = random.Random(seed)
    sources = [("a", 36.02, 129.36, 4, 12.0, 70.0, "CCTV"), ("b", 36.05, 129.40, 1, 0.0, 0.0, "CCTV"), ("c", 35.99, 129.38, 2, 30.0, 0.0, "KMA"), ("d", 60.2, 24.9, 1, 3.0, 20.0, "KMA")]
    size, zooms, tiles = 16, [12, 15], {}
    for _, lat, lon, *_ in sources:
        for z in zooms:
            x, y = map(math.floor, tile_place(lon, lat, z))
            for i in range(x - 2, x + 3):
                for j in range(y - 2, y + 3):
                    if z == 12 or lat > 60 or (i + j) % 4:  # zoom 15 has holes but in the north
                        base = r.uniform(0.5, 2.5)
                        tiles[z, i, j] = [max(0.0, base + math.sin(k % size / 3) + math.cos(k // size / 4) + r.random() * 0.1) for k in range(size * size)]
    line = lambda lon, lat: [(lon + r.uniform(-0.02, 0.02), lat + r.uniform(-0.01, 0.01)) for _ in range(4)]
    roads, hydro = ([line(s[2], s[1]) for s in sources for _ in range(2)] for _ in range(2))
    roads.append([(129.0, 36.02), (129.8, 36.021)])  # straight through from far away
    past = [(s[1] + r.uniform(-0.005, 0.005), s[2] + r.uniform(-0.005, 0.005), r.randint(1, 4), r.random()) for s in sources for _ in range(3)]
    table = lambda lines: spark.createDataFrame([(k, 0, i, x, y) for k, points in enumerate(lines) for i, (x, y) in enumerate(points)], "id int, line int, point int, lon double, lat double")
    markers = spark.createDataFrame(sources, "id string, lat double, lon double, stage int, rain_mm double, depth_cm double, kind string")
    ground = spark.createDataFrame([(*k, v) for k, v in tiles.items()], "z int, x int, y int, elev array<double>")
    history = spark.createDataFrame(past, "plat double, plon double, stage int, recency double")
    layers, report = A.flood_surface(markers, ground, zooms, size, table(roads), table(hydro), history, CELL)
    found = {(x.source_id, x.level): (x.cells, x.max_depth_cm, x.depth_cm, x.fallback) for x in layers.collect()}
    reports = {x.source_id: x for x in report.collect()}
    want, zooms_used = {}, set()
    for source in sources:
        rows, (wet, deepest, mean), zoom = surface_by_hand(source, tiles, zooms, size, roads, hydro, past)
        want |= {(source[0], level): tuple(rest) for level, *rest in rows}
        zooms_used.add(zoom)
        got = reports[source[0]]
        assert (got.wet_cells, got.max_depth_m) == (wet, pytest.approx(deepest)) and (mean is None or got.mean_depth_m == pytest.approx(mean))
    assert zooms_used == {12, 15}
    assert set(found) == set(want)
    for key, row in want.items():
        assert found[key][0] == row[0] and found[key][3] == row[3] and found[key][1:3] == pytest.approx(row[1:3], abs=0.11)


def test_classes_keep_the_ground_where_the_volume_is_short(spark):
    """A round hollow with much seen at its middle but little water: the depth is scaled down, the classes are not."""
    cells = [(7, r, c, 5.0 + 0.004 * ((r - 16) ** 2 + (c - 16) ** 2), (r - c) % 13 == 6) for r in range(33) for c in range(33)]
    grid = spark.createDataFrame(cells, "source_id int, r int, c int, elev double, hydro boolean")
    known = spark.createDataFrame([(7, 4, 1.0, 95.0, 16, 16, 5.0)], "source_id int, stage int, rain_mm double, depth_cm double, seed_r int, seed_c int, seed_elev double")
    depths = G.depth(grid, known, G.spill_heights(grid, known, CELL), G.susceptibility(grid), CELL)
    total = depths.agg(F.sum("depth_m"), F.sum("terrain_m")).first()
    assert total[0] < 0.9 * total[1]
    assert depths.join(grid.where("hydro"), ["source_id", "r", "c"]).where("depth_m > 0 or terrain_m > 0").count() == 0
    bands = {x.level: x for x in G.bands(depths, CELL).collect()}
    assert set(bands) == {1, 2, 3, 4} and bands[1].shown_depth_m == 0.119 and bands[4].shown_depth_m == bands[4].max_depth_m
    assert bands[1].cells >= bands[2].cells > bands[3].cells > bands[4].cells


def test_past_floods_count_at_every_latitude(spark):
    places = [(k, lat, lon) for k, (lat, lon) in enumerate([(0.0, 10.0), (36.0, 129.0), (60.0, 24.0), (71.3, -27.5), (-78.0, 166.0)])]
    cells = spark.createDataFrame(places, "source_id int, lat double, lon double").selectExpr("source_id", "0 as r", "0 as c", "lat", "lon")
    away = lambda lat, d: d / (111_320 * math.cos(math.radians(lat)))
    past = [(lat + 1e-9, lon + sign * away(lat, 600), 4, 1.0) for _, lat, lon in places for sign in (1, -1)]
    found = G.history_influence(cells, spark.createDataFrame(past, "plat double, plon double, stage int, recency double"), reach_m=600)
    assert {x.source_id: x.influence for x in found.collect()} == {k: pytest.approx(math.exp(-1), rel=1e-3) for k, _, _ in places}


def test_sources_that_repeat_an_id_have_grids_of_their_own(spark):
    places = [(36.02, 129.36, 4), (36.05, 129.40, 2), (36.02, 129.36, 1)]  # the third is the first one's place
    ground = spark.createDataFrame([(12, x + i, y + j, [0.1 * (k % 7) for k in range(16)]) for x, y in {tuple(map(math.floor, tile_place(lon, lat, 12))) for lat, lon, _ in places} for i in (-1, 0, 1) for j in (-1, 0, 1)], "z int, x int, y int, elev array<double>").dropDuplicates(["z", "x", "y"])
    lines = spark.createDataFrame([], "id long, line int, point int, lon double, lat double")
    past = spark.createDataFrame([], "plat double, plon double, stage int, recency double")
    got = []
    for names in ("abc", "aaa"):
        markers = spark.createDataFrame([(n, lat, lon, stage, 12.0, 30.0, "CCTV") for n, (lat, lon, stage) in zip(names, places)], "id string, lat double, lon double, stage int, rain_mm double, depth_cm double, kind string")
        layers, report = A.flood_surface(markers, ground, [12], 4, lines, lines, past)
        both = layers.join(report, ["source_id", "rank"]).collect()
        assert {x.source_id for x in both} == set(names[:2])
        got.append(sorted((x.level, x.cells, x.max_depth_cm, x.wet_cells) for x in both))
    assert got[0] == got[1] and len(got[0]) >= 2
