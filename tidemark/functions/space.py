"""Column functions on coordinates, tiles and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres over the sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by degrees, for short distances."""
    x = (lon2 - lon1) * 111_320.0 * F.cos(F.radians((lat1 + lat2) / 2))
    y = (lat2 - lat1) * 110_540.0
    return F.sqrt(x * x + y * y)


def grid_5km(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Cell numbers of the weather service's 5 km Lambert conformal grid; its constants are folded here."""
    # fixed values: the grid's sphere (km), spacing (km), standard parallels, origin and origin cell
    radius, spacing, parallel1, parallel2, lon0, lat0, x0, y0 = 6371.00877, 5.0, 30.0, 60.0, 126.0, 38.0, 43.0, 136.0
    half = lambda deg: math.tan(math.pi * 0.25 + math.radians(deg) * 0.5)
    n = math.log(math.cos(math.radians(parallel1)) / math.cos(math.radians(parallel2))) / math.log(half(parallel2) / half(parallel1))
    f = half(parallel1) ** n * math.cos(math.radians(parallel1)) / n
    scale = radius / spacing
    origin = scale * f / half(lat0) ** n
    r = F.lit(scale * f) / F.pow(F.tan(F.lit(math.pi * 0.25) + F.radians(lat) * 0.5), F.lit(n))
    turn = F.radians(lon) - math.radians(lon0)
    turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn) * n
    return F.floor(r * F.sin(turn) + x0 + 0.5).cast("int"), F.floor(origin - r * F.cos(turn) + y0 + 0.5).cast("int")


def tile_fraction(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile coordinates with their fractions."""
    n = float(2**zoom)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n


def tile_bounds(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north degrees of a tile."""
    n = float(2**zoom)
    north = lambda row: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * row / n))))
    return x / n * 360 - 180, north(y + 1), (x + 1) / n * 360 - 180, north(y)


def ring(lat: Column, lon: Column, radius_m: Column, corners: int) -> Column:
    """A circle as corners + 1 points (lon, lat), closed."""
    def point(k: Column) -> Column:
        angle = k * (2 * math.pi / corners)
        return F.struct((lon + radius_m * F.cos(angle) / (111_320.0 * F.cos(F.radians(lat)))).alias("lon"), (lat + radius_m * F.sin(angle) / 110_540.0).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), point)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def shared_area(a: list[Column], b: list[Column]) -> Column:
    """Area of the intersection of boxes (x1, y1, x2, y2)."""
    return area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def iou(a: list[Column], b: list[Column]) -> Column:
    shared = shared_area(a, b)
    union = area(*a) + area(*b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def overlap_of_smaller(a: list[Column], b: list[Column]) -> Column:
    least = F.least(area(*a), area(*b))
    return F.when(least > 0, shared_area(a, b) / least).otherwise(0.0)


def centre_distance(a: list[Column], b: list[Column], least_diagonal: float = 8.0) -> Column:
    """Distance of centres against the larger diagonal."""
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    diagonal = lambda q: F.sqrt((q[2] - q[0]) * (q[2] - q[0]) + (q[3] - q[1]) * (q[3] - q[1]))
    return F.sqrt(dx * dx + dy * dy) / F.greatest(diagonal(a), diagonal(b), F.lit(least_diagonal))


def plausible_box(x1: Column, y1: Column, x2: Column, y2: Column, frame_area: float, least_side: float = 6, aspect: tuple[float, float] = (0.28, 7.0), most_share: float = 0.45) -> Column:
    w, h = x2 - x1, y2 - y1
    return (w >= least_side) & (h >= least_side) & (w / h >= aspect[0]) & (w / h <= aspect[1]) & (w * h <= most_share * frame_area)


def moved_and_clipped(box: list[Column], dx: Column, dy: Column, width: float, height: float) -> list[Column]:
    """A tile's box in its frame, inside it, to one decimal."""
    clip = lambda v, most: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(most)), 1)
    return [clip(box[0] + dx, width), clip(box[1] + dy, height), clip(box[2] + dx, width), clip(box[3] + dy, height)]


def grown(box: list[Column], scale: float, width: float, height: float) -> list[Column]:
    """A box scaled around its centre, inside the frame."""
    cx, cy, w, h = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, (box[2] - box[0]) * scale / 2, (box[3] - box[1]) * scale / 2
    return [F.greatest(cx - w, F.lit(0.0)), F.greatest(cy - h, F.lit(0.0)), F.least(cx + w, F.lit(width)), F.least(cy + h, F.lit(height))]


def region(text: Column) -> Column:
    """Corners of a region written as x,y;x,y;... with shares 0..1; null below three."""
    points = F.transform(F.split(text, ";"), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
    return F.when(F.size(points) >= 3, points)


def inside(points: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon (even-odd rule). ``points`` are taken once a row; a region that is
    the same for all rows is best read once and joined to them."""

    def crossed(total: Column, edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        cuts = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return total + F.when(F.coalesce(cuts, F.lit(False)), 1).otherwise(0)

    edges = lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.element_at(F.transform(F.array(points), lambda p: F.aggregate(edges(p), F.lit(0), crossed)), 1) % 2 == 1


def projected(box: list[Column], vx: Column, vy: Column, seconds: float, interval: float, width: float, height: float, most: tuple[float, float] = (0.40, 0.32)) -> list[Column]:
    """A box for display, moved by its velocity (pixels a detector interval) for at most one interval and by at most
    a share of its own size, inside the frame."""
    step = min(1.0, max(0.0, seconds) / max(0.08, interval))
    bound = lambda v, side, share: F.least(F.greatest(v * step, -share * side), share * side)
    dx = bound(vx, F.greatest(box[2] - box[0], F.lit(2.0)), most[0])
    dy = bound(vy, F.greatest(box[3] - box[1], F.lit(2.0)), most[1])
    clip = lambda v, edge: F.least(F.greatest(v, F.lit(0.0)), F.lit(edge))
    return [clip(box[0] + dx, width), clip(box[1] + dy, height), clip(box[2] + dx, width), clip(box[3] + dy, height)]


def privacy_box(kind: Column, box: list[Column], width: float, height: float) -> Column:
    """Whether a box has a shape and size that a face or a plate can have."""
    w, h = F.greatest(box[2] - box[0], F.lit(0.0)), F.greatest(box[3] - box[1], F.lit(0.0))
    aspect, share = w / F.greatest(h, F.lit(1.0)), w * h / (width * height)
    limits = {"face": (0.45, 2.0, 0.010, 0.18, 0.25), "license_plate": (1.5, 7.0, 0.0045, 0.22, 0.09)}
    fits = F.lit(False)
    for name, (low, high, most, wide, tall) in limits.items():
        fits = F.when(kind == name, aspect.between(low, high) & (share <= most) & (w / width <= wide) & (h / height <= tall)).otherwise(fits)
    return (w >= 4) & (h >= 4) & F.coalesce(fits, F.lit(False))
