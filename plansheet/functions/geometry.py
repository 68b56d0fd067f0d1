"""Plane geometry as Column expressions.  A polygon is an array of structs (x, y) whose last point joins the first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _next(poly: Column) -> Column:
    return F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))


def area(poly: Column) -> Column:
    """Shoelace area."""
    cross = F.zip_with(poly, _next(poly), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def contains(poly: Column, px: Column, py: Column) -> Column:
    """Even-odd test."""
    def crossed(a, b):
        at = F.try_divide((b["x"] - a["x"]) * (py - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > py) != (b["y"] > py)) & F.coalesce(px < at, F.lit(False))

    return F.aggregate(F.zip_with(poly, _next(poly), crossed), F.lit(False), lambda s, x: s != x)


def boundary_distance(poly: Column, px: Column, py: Column) -> Column:
    return F.array_min(F.zip_with(poly, _next(poly), lambda a, b: segment_distance(px, py, a["x"], a["y"], b["x"], b["y"])))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees of a line, from 0 to below 180."""
    return F.pmod(F.degrees(F.atan2(by - ay, bx - ax)), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(F.pmod(a, F.lit(180.0)) - F.pmod(b, F.lit(180.0)))
    return F.least(d, 180.0 - d)


def bbox_gap(a: Column, b: Column) -> Column:
    """Distance of two boxes [x0, y0, x1, y1]; 0 if they meet."""
    dx = F.greatest(b[0] - a[2], a[0] - b[2], F.lit(0.0))
    dy = F.greatest(b[1] - a[3], a[1] - b[3], F.lit(0.0))
    return F.hypot(dx, dy)


def upper_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def average_hash(cells: Column) -> Column:
    """Bits of 64 numbers as a long: cell above the mean."""
    mean = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)
    return F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > mean, 1).otherwise(0).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def crosses(poly: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Does the segment cross an edge of the polygon?"""
    def turn(px, py, qx, qy, rx, ry):
        return (qy - py) * (rx - qx) - (qx - px) * (ry - qy) > 0

    def cut(c, d):
        other = turn(ax, ay, bx, by, c["x"], c["y"]) != turn(ax, ay, bx, by, d["x"], d["y"])
        return other & (turn(c["x"], c["y"], d["x"], d["y"], ax, ay) != turn(c["x"], c["y"], d["x"], d["y"], bx, by))

    return F.exists(F.zip_with(poly, _next(poly), cut), lambda x: x)


def thickness(poly: Column) -> Column:
    """Extent across the longest edge (the first of equals), to 0.1."""
    edges = F.zip_with(poly, _next(poly), lambda a, b: F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("size")))
    none = F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("size"))
    long = F.aggregate(edges, none, lambda top, e: F.when(e["size"] > top["size"], e).otherwise(top))
    off = F.transform(poly, lambda p: F.try_divide(p["y"] * long["dx"] - p["x"] * long["dy"], long["size"]))
    return F.coalesce(F.round(F.array_max(off) - F.array_min(off), 1), F.lit(0.0))


def along_ray(ox: Column, oy: Column, ux: Column, uy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far along the unit direction from o a segment is met; null if it isn't; where it lies on the ray, where it begins."""
    ex, ey, wx, wy = bx - ax, by - ay, ax - ox, ay - oy
    det = ux * ey - uy * ex
    t, k = F.try_divide(wx * ey - wy * ex, det), F.try_divide(wx * uy - wy * ux, det)
    t0, t1 = wx * ux + wy * uy, (bx - ox) * ux + (by - oy) * uy
    on_ray = F.when((F.abs(wx * uy - wy * ux) <= 1e-6) & (F.greatest(t0, t1) >= 0), F.greatest(F.lit(0.0), F.least(t0, t1)))
    return F.when(F.abs(det) < 1e-9, on_ray).when((t >= 0) & k.between(0, 1), t)


def strike(edges: Column, ox: Column, oy: Column, ux: Column, uy: Column, limit: float, least: float = 0.15) -> Column:
    """Distance of the first edge (structs ax, ay, bx, by) met within limit; 0 where the origin lies on an edge; null if none is."""
    met = F.filter(F.transform(edges, lambda e: along_ray(ox, oy, ux, uy, e["ax"], e["ay"], e["bx"], e["by"])), lambda t: t.isNotNull())
    return F.when(F.exists(met, lambda t: t < 0.05), F.lit(0.0)).otherwise(F.array_min(F.filter(met, lambda t: (t > least) & (t <= limit))))


def segments(points: Column, closed: Column) -> Column:
    """Structs ax, ay, bx, by of a polyline's (array of [x, y]) edges."""
    pair = lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
    n = F.size(points)
    open_ = F.slice(F.zip_with(points, F.slice(points, 2, F.greatest(n, F.lit(1))), pair), 1, F.greatest(n - 1, F.lit(0)))
    return F.when(closed & (n > 2), F.concat(open_, F.array(pair(F.get(points, n - 1), F.get(points, F.lit(0)))))).otherwise(open_)


def polyline_length(points: Column, closed: Column) -> Column:
    return F.round(F.aggregate(segments(points, closed), F.lit(0.0), lambda s, e: s + F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])), 1)


def box_of(points: Column) -> Column:
    """[min x, min y, max x, max y] of an array of [x, y]."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def box_union(boxes: Column) -> Column:
    return F.array(*[(F.array_min if i < 2 else F.array_max)(F.transform(boxes, lambda b, i=i: F.round(b[i], 1))) for i in range(4)])


def box_overlap_share(a: Column, b: Column) -> Column:
    """Common area over the smaller box's."""
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    size = lambda x: F.greatest(x[2] - x[0], F.lit(0.0)) * F.greatest(x[3] - x[1], F.lit(0.0))
    return F.when((w > 0) & (h > 0), F.coalesce(F.try_divide(w * h, F.least(size(a), size(b))), F.lit(0.0))).otherwise(0.0)


def circle(vertices: Column, length: Column, bbox: Column) -> Column:
    """Struct x, y, r of a circle: its first vertex, else its box's middle; its length over two pi, else half its box."""
    at = F.get(vertices, F.lit(0))
    r = F.coalesce(F.nullif(length, F.lit(0.0)) / (2 * math.pi), F.greatest(bbox[2] - bbox[0], bbox[3] - bbox[1]) / 2)
    return F.struct(F.coalesce(at[0], (bbox[0] + bbox[2]) / 2).alias("x"), F.coalesce(at[1], (bbox[1] + bbox[3]) / 2).alias("y"), r.alias("r"))


def r1(c: Column) -> Column:
    """To 0.1; what is no number is 0."""
    return F.coalesce(F.round(c.try_cast("double"), 1), F.lit(0.0))


def hash_grid(cells: Column) -> Column:
    """256 bits of a 16 x 16 grid (array of 256 numbers) as four longs: a bit for each cell above the mean."""
    mean = F.aggregate(cells, F.lit(0.0), lambda s, x: s + x) / F.size(cells)
    word = lambda k: F.aggregate(F.slice(cells, 64 * k + 1, 64), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > mean, 1).otherwise(0).cast("long")))
    return F.array(*[word(k) for k in range(4)])


def hash_distance(a: Column, b: Column) -> Column:
    """Bits in which two hashes (arrays of longs) differ; 64 where either is missing or their sizes differ."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(bits, F.lit(64))).otherwise(64)
