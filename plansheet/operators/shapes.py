"""Plane geometry of one sheet in plain Python, for grouped kernels; functions/geometry.py has the same as expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

Point = tuple[float, float]
Segment = tuple[Point, Point]


def ring(poly: list[Point]) -> Iterable[Segment]:
    return zip(poly, [*poly[1:], poly[0]], strict=True)


def area(poly: list[Point]) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in ring(poly))) / 2


def foot(p: Point, s: Segment) -> Point:
    """The segment's point nearest to p."""
    (ax, ay), (bx, by) = s
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / size)) if size else 0.0
    return ax + t * dx, ay + t * dy


def distance(p: Point, s: Segment) -> float:
    return math.dist(p, foot(p, s))


def inside(p: Point, poly: list[Point]) -> bool:
    x, y = p
    hit = False
    for (ax, ay), (bx, by) in ring(poly):
        if (ay > y) != (by > y):
            hit ^= x < ax + (bx - ax) * (y - ay) / (by - ay)
    return hit


def touches(p: Point, poly: list[Point], limit: float) -> bool:
    """In the polygon, or at its boundary."""
    return inside(p, poly) or any(distance(p, s) <= limit for s in ring(poly))


def _turn(a: Point, b: Point, c: Point) -> bool:
    return (b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1]) > 0


def crosses(s: Segment, poly: list[Point]) -> bool:
    a, b = s
    return any(_turn(a, b, c) != _turn(a, b, d) and _turn(c, d, a) != _turn(c, d, b) for c, d in ring(poly))


def thickness(poly: list[Point]) -> float:
    """Extent across the longest edge (the first of equals), to 0.1."""
    a, b = max(ring(poly), key=lambda s: math.dist(*s))
    size = math.dist(a, b)
    if not size:
        return 0.0
    off = [(y * (b[0] - a[0]) - x * (b[1] - a[1])) / size for x, y in poly]
    return round(max(off) - min(off), 1)


def angle(s: Segment) -> float:
    (ax, ay), (bx, by) = s
    return math.degrees(math.atan2(by - ay, bx - ax)) % 180


def angle_between(a: float, b: float) -> float:
    d = abs(a - b) % 180
    return min(d, 180 - d)


def along_ray(o: Point, u: Point, s: Segment) -> float | None:
    """How far along the unit direction u from o the segment is met; a segment on the ray is met where it begins."""
    (ax, ay), (bx, by) = s
    ex, ey, wx, wy = bx - ax, by - ay, ax - o[0], ay - o[1]
    det = u[0] * ey - u[1] * ex
    if abs(det) < 1e-9:
        if abs(wx * u[1] - wy * u[0]) > 1e-6:
            return None
        ends = [wx * u[0] + wy * u[1], (bx - o[0]) * u[0] + (by - o[1]) * u[1]]
        return max(0.0, min(ends)) if max(ends) >= 0 else None
    t, k = (wx * ey - wy * ex) / det, (wx * u[1] - wy * u[0]) / det
    return t if t >= 0 and 0 <= k <= 1 else None


def strike(o: Point, toward: Point, edges: list[Segment], limit: float, least: float = 0.15) -> Point | None:
    """The first edge point that a ray meets within limit; the origin itself where it lies on an edge."""
    size = math.hypot(*toward) or 1.0
    u = toward[0] / size, toward[1] / size
    met = [t for e in edges if (t := along_ray(o, u, e)) is not None]
    if any(t < 0.05 for t in met):
        return round(o[0], 1), round(o[1], 1)
    t = min((t for t in met if least < t <= limit), default=None)
    return None if t is None else (round(o[0] + u[0] * t, 1), round(o[1] + u[1] * t, 1))


def bbox(points: list[Point]) -> list[float]:
    xs, ys = zip(*points, strict=True)
    return [min(xs), min(ys), max(xs), max(ys)]


def bbox_gap(a: list[float], b: list[float]) -> float:
    return math.hypot(max(b[0] - a[2], a[0] - b[2], 0.0), max(b[1] - a[3], a[1] - b[3], 0.0))


def overlap_share(a: list[float], b: list[float]) -> float:
    """Common area over the smaller one's."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    least = min(max(x[2] - x[0], 0.0) * max(x[3] - x[1], 0.0) for x in (a, b))
    return w * h / least if w > 0 and h > 0 and least > 0 else 0.0


def loops(segments: list[Segment], gap: float) -> list[list[Point]]:
    """Closed chains of segments: from the first unused one on, always the unused end nearest to the tail (the last of equals); open chains are used up."""
    left, out = list(segments), []
    while left:
        poly = list(left.pop(0))
        while left:
            tail = poly[-1]
            at, near, far, least = -1, tail, tail, gap
            for i, s in enumerate(left):
                for a, b in (s, s[::-1]):
                    d = math.dist(a, tail)
                    if d <= least:
                        at, near, far, least = i, a, b, d
            if at < 0:
                break
            left.pop(at)
            if math.dist(far, poly[0]) <= gap:
                out.append(poly)
                break
            poly += [near, far]
    return [p for p in out if len(p) >= 3]
