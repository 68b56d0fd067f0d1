"""Binding of dimensions, leaders and regions to facts by position on the sheet.

Everything near is found through a grid of cells as wide as the search radius:
an equi-join on (drawing, cell), so neither side is paired off whole, and a
crowded drawing is spread over its cells.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..config import CHAIN_RANKS, ShapeRules, Words
from ..functions import geometry as G
from ..functions import reading as R
from . import shapes as S
from .kernels import nearest, per_group

#: Reach of a snap and of a region's boundary in mm; types of annotations.
SNAP, BOUNDARY = 0.5, 0.5
#: Points or segments, and regions, of a cell that one task compares at a time.
LEFTS_PER_PART, RIGHTS_PER_PART = 8192, 1024
ANNOTATIONS = ("TEXT", "MTEXT", "MULTILEADER", "PDFTEXT", "ANNOTATION")


def _cell(v: Column, width: float) -> Column:
    return F.floor(v / F.lit(float(width))).cast("long")


def near(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """All pairs within radius in one drawing: points' columns, targets' columns and dist.

    points (drawing, x, y, ...), targets (drawing, tx, ty, ...); other column names must differ.
    """
    here = points.withColumn("cx", _cell(F.col("x"), radius)).withColumn("cy", _cell(F.col("y"), radius))
    around = F.array(*[F.struct((_cell(F.col("tx"), radius) + i).alias("cx"), (_cell(F.col("ty"), radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = targets.withColumn("cell", F.explode(around)).select(*targets.columns, "cell.cx", "cell.cy")
    pairs = here.join(spread, ["drawing", "cx", "cy"]).drop("cx", "cy")
    return pairs.withColumn("dist", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"))).filter(F.col("dist") <= radius)


def snap(points: DataFrame, vertices: DataFrame, radius: float = SNAP, keys: tuple[str, ...] = ("drawing", "point_id")) -> DataFrame:
    """(keys, vertex_id, tx, ty, dist): each point's nearest vertex; of equally near ones (to 1e-6), the largest vertex_id."""
    best = F.min_by(F.struct("vertex_id", "tx", "ty", "dist"), F.struct(F.round("dist", 6).alias("near"), (-F.col("vertex_id")).alias("late")))
    return near(points, vertices, radius).groupBy(*keys).agg(best.alias("v")).select(*keys, "v.*")


def _boxed(df: DataFrame, boundary: float) -> DataFrame:
    """regions (drawing, region_id, poly) with their box, widened by the boundary, and its size class: the next power of two."""
    along = lambda c: F.transform("poly", lambda p: p[c])
    lows, highs = (F.array_min(along(c)) - boundary for c in "xy"), (F.array_max(along(c)) + boundary for c in "xy")
    boxed = df.select("drawing", "region_id", "poly", *[v.alias(n) for v, n in zip((*lows, *highs), ("x0", "y0", "x1", "y1"), strict=True)])
    return boxed.withColumn("size", _class())


def _class() -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0)))))


def _tiled(boxed: DataFrame) -> DataFrame:
    """A row for each cell of the given width that the box meets."""
    cell = lambda v: F.floor(F.col(v) / F.col("width")).cast("long")
    across = F.explode(F.sequence(cell("x0"), F.greatest(cell("x0"), cell("x1"))))
    return boxed.withColumn("cx", across).withColumn("cy", F.explode(F.sequence(cell("y0"), F.greatest(cell("y0"), cell("y1")))))


def _per_tile(left: DataFrame, right: DataFrame, kernel, schema: T.StructType) -> DataFrame:
    """kernel(key, left rows, right rows) for each tile that both have; crowded tiles in parts, each of one side with each of the other."""
    tile, right = ["drawing", "width", "cx", "cy"], right.toDF(*right.columns)  # the two may come from one table
    counts = [df.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(n)) for df, most, n in ((left, LEFTS_PER_PART, "lefts"), (right, RIGHTS_PER_PART, "rights"))]
    parts = counts[0].join(counts[1], tile)
    deal = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(parts, tile).withColumn("_l", deal(left, "lefts")).withColumn("_r", each("rights")).drop("lefts", "rights")
    b = right.join(parts, tile).withColumn("_l", each("lefts")).withColumn("_r", deal(right, "rights")).drop("lefts", "rights")
    keys = [*tile, "_l", "_r"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(kernel, schema)


def _polygons(table: pa.Table) -> list[np.ndarray]:
    """(points, 2) of each row's poly."""
    col = table.column("poly").combine_chunks()
    at, body = col.offsets.to_numpy(), col.values
    xy = np.stack([body.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1).astype(float)
    return [xy[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def _holds(poly: np.ndarray, box: np.ndarray, x: np.ndarray, y: np.ndarray, boundary: float) -> np.ndarray:
    """Which points lie in the polygon or at most the boundary away: within its widened box, and by distance to a billionth."""
    out = np.zeros(len(x), bool)
    at = np.flatnonzero((x >= box[0]) & (y >= box[1]) & (x <= box[2]) & (y <= box[3]))
    if not len(at):
        return out
    px, py = x[at], y[at]
    (ax, ay), (bx, by) = poly.T[:, :, None], np.roll(poly, -1, 0).T[:, :, None]
    dx, dy = bx - ax, by - ay
    with np.errstate(divide="ignore", invalid="ignore"):
        held = np.logical_xor.reduce(((ay > py) != (by > py)) & (px < dx * (py - ay) / dy + ax), 0)
        t = np.clip(np.nan_to_num(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)), 0, 1)
    out[at] = held | (np.hypot(px - (ax + t * dx), py - (ay + t * dy)).min(0) <= boundary + 1e-9)
    return out


def _goes_through(poly: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which segments cross an edge: their ends lie beyond it on either side, so an end that only touches it doesn't count."""
    turn = lambda px, py, qx, qy, rx, ry: (qy - py) * (rx - qx) - (qx - px) * (ry - qy)
    (cx, cy), (dx, dy) = poly.T[:, :, None], np.roll(poly, -1, 0).T[:, :, None]
    apart = (turn(ax, ay, bx, by, cx, cy) > 0) != (turn(ax, ay, bx, by, dx, dy) > 0)
    a, b = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    return (apart & ((a > 0) & (b < 0) | (a < 0) & (b > 0))).any(0)


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(float) for n in names]


def regions_at(points: DataFrame, regions: DataFrame, boundary: float = BOUNDARY) -> DataFrame:
    """points with region_id: the first region (smallest region_id) that holds the point or whose boundary is near; null if none does.

    points (drawing, point_id, x, y, ...), regions (drawing, region_id, poly).
    A region is looked up in cells as wide as its box (the next power of two),
    so it lies in four cells at most; a point looks once for each width that
    its drawing's regions have.  In a cell, regions come in order and take the
    points that none before has, so a point is tested up to its first region.
    """
    sized = _boxed(regions, boundary).withColumnRenamed("size", "width")
    cell = lambda v: F.floor(F.col(v) / F.col("width")).cast("long")
    placed = points.select("drawing", "point_id", "x", "y").filter("x IS NOT NULL AND y IS NOT NULL")
    here = placed.join(sized.select("drawing", "width").distinct(), "drawing").withColumn("cx", cell("x")).withColumn("cy", cell("y"))

    def first(here: pa.Table, there: pa.Table) -> pa.Table:
        there = there.take(pc.sort_indices(there, [("region_id", "ascending")]))
        (x, y), boxes, found = _numbers(here, "x", "y"), np.stack(_numbers(there, "x0", "y0", "x1", "y1"), 1), np.full(here.num_rows, -1)
        left = np.argsort(x, kind="stable")
        for k, poly in enumerate(_polygons(there)):
            if not len(left):
                break
            lo, hi = np.searchsorted(x[left], boxes[k, 0]), np.searchsorted(x[left], boxes[k, 2], "right")
            some = left[lo:hi]
            hit = _holds(poly, boxes[k], x[some], y[some], boundary)
            if hit.any():
                found[some[hit]] = k
                left = np.concatenate([left[:lo], some[~hit], left[hi:]])
        met = np.flatnonzero(found >= 0)
        return here.select(["drawing", "point_id"]).take(met).append_column("region_id", there.column("region_id").take(found[met]))

    schema = T.StructType([points.schema["drawing"], points.schema["point_id"], regions.schema["region_id"]])
    met = _per_tile(here, _tiled(sized).filter("region_id IS NOT NULL"), first, schema)
    first_of = met.groupBy("drawing", "point_id").agg(F.min("region_id").alias("region_id"))
    return points.join(first_of, ["drawing", "point_id"], "left")


def regions_of_segments(segments: DataFrame, regions: DataFrame, boundary: float = BOUNDARY) -> DataFrame:
    """(segments' columns, region_id) of all regions that a segment (drawing, segment_id, x, y, x2, y2) lies in or crosses.

    It lies in a region that holds both ends or has them near its boundary, and
    crosses one if its ends lie beyond an edge on either side.  Segments and
    regions meet in cells as wide as the larger one's box (the next power of
    two), a pair in the one cell where the common part of their boxes begins.
    """
    own = F.struct(*segments.columns)
    ends = {"x0": F.least("x", "x2") - boundary, "y0": F.least("y", "y2") - boundary, "x1": F.greatest("x", "x2") + boundary, "y1": F.greatest("y", "y2") + boundary}
    here = segments.filter("x IS NOT NULL AND y IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL").select("drawing", own.alias("own"), "x", "y", "x2", "y2", *[v.alias(n) for n, v in ends.items()]).withColumn("size", _class())
    there = _boxed(regions, boundary)
    levels = lambda df: df.select("drawing", F.col("size").alias("width")).distinct()
    at_levels = lambda df, other: _tiled(df.join(levels(df).unionByName(levels(other)).distinct(), "drawing").filter("width >= size"))

    def meet(key, here: pa.Table, there: pa.Table) -> pa.Table:
        _, width, cx, cy, _, _ = (k.as_py() for k in key)
        x, y, x2, y2, x0, y0, x1, y1, size = _numbers(here, "x", "y", "x2", "y2", "x0", "y0", "x1", "y1", "size")
        boxes, sizes = np.stack(_numbers(there, "x0", "y0", "x1", "y1"), 1), _numbers(there, "size")[0]
        which, regions = [], []
        for k, poly in enumerate(_polygons(there)):
            box = boxes[k]
            near = (x1 >= box[0]) & (x0 <= box[2]) & (y1 >= box[1]) & (y0 <= box[3]) & (np.maximum(size, sizes[k]) == width)
            i = np.flatnonzero(near & (np.floor(np.maximum(x0, box[0]) / width) == cx) & (np.floor(np.maximum(y0, box[1]) / width) == cy))
            both = _holds(poly, box, x[i], y[i], boundary)
            both[both] = _holds(poly, box, x2[i][both], y2[i][both], boundary)
            rest = i[~both]
            both[~both] = _goes_through(poly, x[rest], y[rest], x2[rest], y2[rest])
            which.append(i[both])
            regions.append(np.full(len(which[-1]), k))
        at, k = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (which, regions))
        own = here.column("own").combine_chunks()
        columns = [pc.struct_field(own, n).take(pa.array(at)) for n in segment_columns]
        return pa.table([*columns, there.column("region_id").take(pa.array(k))], names=[*segment_columns, "region_id"])

    segment_columns, schema = segments.columns, T.StructType([*segments.schema.fields, regions.schema["region_id"]])
    return _per_tile(at_levels(here, there), at_levels(there, here), meet, schema)


# --- one sheet


def _lines(r: dict) -> list[S.Point]:
    return [(float(p[0]), float(p[1])) for p in r["vertices"] or []] if r["type"] in ("LINE", "LWPOLYLINE") else []


def _segments(records: list[dict], gap: float | None = None, paths: bool = False) -> list[S.Segment]:
    """Drawn segments; a polyline is closed as it says, or, where it doesn't say, if its ends meet within gap."""
    out: list[S.Segment] = []
    for r in records:
        pts = _lines(r)
        out += zip(pts, pts[1:], strict=False)
        closed = r.get("closed")
        if closed is None:
            closed = gap is not None and len(pts) > 2 and math.dist(pts[0], pts[-1]) <= gap
        if r["type"] == "LWPOLYLINE" and len(pts) > 2 and closed:
            out.append((pts[-1], pts[0]))
    for r in records if paths else ():
        if r["type"] == "PDFPATH":
            pts = [(float(p[0]), float(p[1])) for p in r["vertices"] or []]
            out += zip(pts, pts[1:], strict=False)
    return out


def sheet_regions(records: list[dict], reader: R.Reader, rules: ShapeRules) -> list[dict]:
    """Closed areas of a sheet: hatches, then loops of lines on one layer whose middle no area holds yet; numbered by place."""
    found: list[dict] = []

    def add(poly: list[S.Point], layer: str, hatch: str | None, material: str | None) -> None:
        cx, cy = (sum(v) / len(poly) for v in zip(*poly, strict=True))
        found.append({
            "polygon": [{"x": round(x, 1), "y": round(y, 1)} for x, y in poly], "bbox": [round(v, 1) for v in S.bbox(poly)], "cx": round(cx, 1), "cy": round(cy, 1), "layer": layer,
            "hatch_pattern": hatch, "material": material, "thickness": S.thickness(poly), "poly": [(round(x, 1), round(y, 1)) for x, y in poly],
        })

    for r in records:
        poly = [(float(p[0]), float(p[1])) for p in r["vertices"] or []] if r["type"] == "HATCH" else []
        if len(poly) >= 3 and S.area(poly) >= rules.least_area:
            add(poly, r["layer"] or "0", r["hatch_pattern"], reader.hatch_material(r["hatch_pattern"]) or reader.layer_material(r["layer"]))
    by_layer: dict[str, list[S.Segment]] = {}
    for r in records:
        if len(pts := _lines(r)) >= 2:
            own = by_layer.setdefault(r["layer"] or "0", [])
            own += zip(pts, pts[1:], strict=False)
            if r["type"] == "LWPOLYLINE" and len(pts) > 2 and r.get("closed") is not False:
                own.append((pts[-1], pts[0]))
    for layer, segments in by_layer.items():
        for poly in S.loops(segments, rules.close_gap):
            middle = tuple(sum(v) / len(poly) for v in zip(*poly, strict=True))
            if S.area(poly) >= rules.least_area and not any(S.inside(middle, g["poly"]) for g in found):
                add(poly, layer, None, reader.layer_material(layer))
    found.sort(key=lambda g: (g["cx"], g["cy"]))
    for i, g in enumerate(found):
        g["region_id"] = f"r_{i:02d}"
        same = (r for r in records if g["hatch_pattern"] and r["hatch_pattern"] == g["hatch_pattern"] and r["layer"] == g["layer"])
        lines = (r for r in records if r["type"] == "LWPOLYLINE" and r["layer"] == g["layer"])
        g["source_element_id"] = next((r["element_id"] for r in itertools.chain(same, lines)), None)
    return found


def _region(p: S.Point | None, regions: list[dict], rules: ShapeRules) -> dict | None:
    return next((g for g in regions if S.touches(p, g["poly"], rules.snap)), None) if p else None


def _snapped(p: S.Point, vertices: list[S.Point], segments: list[S.Segment], rules: ShapeRules) -> S.Point | None:
    """The nearest drawn vertex, else the first near edge's point."""
    best = nearest(vertices, lambda v: math.dist(v, p), rules.snap, last=True)
    if best is None:
        near_edge = next((s for s in segments if S.distance(p, s) <= rules.snap), None)
        best = tuple(round(v, 1) for v in S.foot(p, near_edge)) if near_edge else None
    return best


def stated_value(r: dict, scale: float = 1.0) -> float | None:
    """What a dimension says: its text's number, else its measurement, in drawing scale."""
    said = R.first_number(r["dim_override"])
    said = r["dim_measurement"] if said is None else said
    return None if said is None else round(said * scale, 2)


def _measured_points(r: dict) -> list[S.Point]:
    pts = [(float(p[0]), float(p[1])) for p in r["dim_defpoints"] or [] if p]
    return [*pts[1:3], *pts] if len(pts) >= 3 else pts


def scale_of_sheet(records: list[dict]) -> tuple[float, bool]:
    """Stated over measured lengths, if all agree within a hundredth; and whether they don't."""
    ratios = []
    for r in records:
        if r["type"] == "DIMENSION":
            pts = r["dim_defpoints"] or []
            size = math.dist(pts[1], pts[2]) if len(pts) >= 3 else r["dim_measurement"]
            said = R.first_number(r["dim_override"])
            said = r["dim_measurement"] if said is None else said
            if said and size:
                ratios.append(said / size)
    if not ratios:
        return 1.0, False
    middle = sorted(ratios)[len(ratios) // 2]
    if any(abs(x - middle) > max(0.01 * abs(middle), 1e-9) for x in ratios):
        return 1.0, True
    return (1.0 if abs(middle - 1) <= 1e-9 else round(middle, 4)), False


def _fact(r: dict | None, **fields) -> dict:
    empty = dict.fromkeys(("region_id", "material", "part", "qualifier", "dim_uid"))
    return {**empty, "element_id": r["element_id"] if r else None, "unit": "mm", "measure": "thickness", "conflict": False, "leader_own_value": False, "review_needed": False, **fields}


def dimension_chain(records: list[dict], regions: list[dict], rules: ShapeRules, scale: float) -> tuple[list[dict], list[dict], list[dict]]:
    """Dimensions between two drawn points: bound to the one region they lie in or cross, assemblies over several, and the rest with a reason."""
    bound, assemblies, loose = [], [], []
    vertices, segments = [p for r in records for p in _lines(r)], _segments(records, rules.close_gap)
    for r in records:
        value = stated_value(r, scale) if r["type"] == "DIMENSION" else None
        if value is None:
            continue
        ends: list[S.Point] = []
        for p in _measured_points(r):
            at = _snapped(p, vertices, segments, rules)
            if at is not None and at not in ends and len(ends) < 2:
                ends.append(at)
        held = [g for g in regions if S.touches(ends[0], g["poly"], rules.snap) and S.touches(ends[1], g["poly"], rules.snap) or S.crosses((ends[0], ends[1]), g["poly"])] if len(ends) == 2 else []
        if len(held) > 1:
            assemblies.append({"element_id": r["element_id"], "value": value, "unit": "mm", "regions": [g["region_id"] for g in held], "kind": "assembly"})
        elif held and held[0]["material"]:
            bound.append(_fact(r, region_id=held[0]["region_id"], material=held[0]["material"], value=value, confidence="medium", chain="dimension"))
        else:
            why = "defpoints snap to no drawn geometry" if len(ends) < 2 else "region has no material" if held else "defpoints resolve to no region"
            loose.append({"element_id": r["element_id"], "dxf_handle": r["dxf_handle"], "value": value, "unit": "mm", "reason": why})
    return bound, assemblies, loose


def leader_end(r: dict, records: list[dict], rules: ShapeRules) -> S.Point | None:
    """Where an annotation's leader points: as stored, else the far end of the line that starts nearest to a text."""
    if r.get("leader_endpoint"):
        return tuple(round(float(v), 1) for v in r["leader_endpoint"][:2])
    if r["type"] not in ("TEXT", "MTEXT") or r["insert_x"] is None:
        return None
    at = (r["insert_x"], r["insert_y"] or 0.0)
    ends = [(a, z) for x in records if x["type"] == "LINE" and len(p := _lines(x)) >= 2 for a, z in ((p[0], p[-1]), (p[-1], p[0]))]
    best = nearest((e for e in ends if math.dist(e[0], at) <= rules.pair), lambda e: math.dist(e[0], at), rules.pair)
    return best[1] if best else None


def leader_chain(records: list[dict], regions: list[dict], rules: ShapeRules) -> list[dict]:
    """Annotations that name a material or a measured value, bound to the region their leader points into."""
    out = []
    for r in records:
        said = r["parsed"] or {}
        value = said.get("value")
        if r["type"] not in ANNOTATIONS or not said.get("material") and not (said.get("measure") and value is not None):
            continue
        g = _region(leader_end(r, records, rules), regions, rules)
        sure, chain, conflict = "medium", "leader", False
        if value is not None:
            agree = g is None or abs(g["thickness"] - value) <= rules.conflict
            sure, chain, conflict = "high" if agree else "low", "leader+geometry" if g else "leader", not agree
        elif g and g["thickness"]:
            chain = "leader+geometry"
        stated = value is not None
        out.append(_fact(r, region_id=g and g["region_id"], material=said.get("material"), part=said.get("part"), qualifier=said.get("qualifier"), measure=said.get("measure") or "thickness", value=value if stated else g["thickness"] if chain != "leader" else None, confidence=sure, chain=chain, conflict=conflict, leader_own_value=stated))
    return out


def region_chain(regions: list[dict]) -> list[dict]:
    """Regions of known material and thickness."""
    return [_fact(None, element_id=g["source_element_id"], region_id=g["region_id"], material=g["material"], value=g["thickness"], confidence="medium", chain="geometry") for g in regions if g["material"] and g["thickness"]]


def _across(s: S.Segment, axis: float, rules: ShapeRules) -> bool:
    return abs(S.angle_between(S.angle(s), axis) - 90) <= rules.parallel


def _from(p: S.Point, s: S.Segment) -> tuple[S.Point, S.Point]:
    """The segment's ends, the one nearer to p first."""
    return s if math.dist(s[0], p) <= math.dist(s[1], p) else s[::-1]


def trace(value: float, p: S.Point, q: S.Point, segments: list[S.Segment], regions: list[dict], rules: ShapeRules, wide: bool = True) -> tuple[dict | None, list[dict]]:
    """The region between the edges that a dimension's extension lines point at, if their distance is the stated one; and regions that could be meant."""
    axis = S.angle((p, q))
    u = math.cos(math.radians(axis)), math.sin(math.radians(axis))
    middle = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2
    reach = max(rules.probe, 1.0)

    def extension(at: S.Point) -> tuple[S.Point, S.Point] | None:
        near_by = [_from(at, s) for s in segments if min(math.dist(s[0], at), math.dist(s[1], at)) <= reach and _across(s, axis, rules)]
        return min(near_by, key=lambda e: math.dist(e[0], at), default=None)

    pair = [extension(p), extension(q)]
    if None in pair and wide:
        mid = lambda s: ((s[0][0] + s[1][0]) / 2, (s[0][1] + s[1][1]) / 2)
        far = sorted((math.dist(mid(s), middle), i) for i, s in enumerate(segments) if _across(s, axis, rules))
        both = [segments[i] for d, i in far[:2] if d <= max(8 * reach, 12.0)]
        if len(both) == 2 and abs(sum((a - b) * k for a, b, k in zip(mid(both[0]), mid(both[1]), u, strict=True))) > 0.5:
            pair = [_from(middle, s) for s in both]
    hit = None
    if None not in pair:
        edges = segments + [e for g in regions for e in S.ring(g["poly"])]
        struck = [S.strike(tip, (tip[0] - tail[0], tip[1] - tail[1]), edges, rules.probe) if math.dist(tip, tail) >= 1e-9 else None for tip, tail in pair]
        if None not in struck:
            (ax, ay), (bx, by) = struck
            if abs(abs((ax - bx) * u[0] + (ay - by) * u[1]) - value) <= rules.value_conflict:
                g = _region(((ax + bx) / 2, (ay + by) / 2), regions, rules)
                hit = g if g and g["material"] else None
    could = [g for g in regions if math.dist((g["cx"], g["cy"]), middle) <= rules.candidates and abs((g["thickness"] or 0) - value) <= rules.value_conflict]
    return hit, sorted(could, key=lambda g: g["region_id"])


def exploded_dimensions(records: list[dict], segments: list[S.Segment], rules: ShapeRules) -> list[tuple[dict, float, S.Point, S.Point]]:
    """(label, value, far ends of the two extension lines) of dimensions drawn as plain lines around a bare number."""
    out, used = [], set()
    lines = [(i, s) for i, s in enumerate(segments) if 2 <= math.dist(*s) <= 500]
    for r in records:
        number = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*", r["text_raw"] or "") if r["type"] in ANNOTATIONS else None
        if not number:
            continue
        at = r["geom"]["x"], r["geom"]["y"]
        best = nearest((x for x in lines if x[0] not in used), lambda x: math.dist(((x[1][0][0] + x[1][1][0]) / 2, (x[1][0][1] + x[1][1][1]) / 2), at), rules.cluster)
        if best is None:
            continue
        i, (a, b) = best
        axis = math.radians(S.angle((a, b)))
        off = lambda p: (p[1] - a[1]) * math.cos(axis) - (p[0] - a[0]) * math.sin(axis)  # noqa: E731, B023
        ends: dict[bool, tuple[float, S.Point]] = {}
        for s in segments:
            if _across(s, math.degrees(axis) % 180, rules) and min(S.distance(a, s), S.distance(b, s)) <= 2:
                at_a = math.dist(s[0], a) + math.dist(s[1], a) <= math.dist(s[0], b) + math.dist(s[1], b)
                far = s[0] if abs(off(s[0])) > abs(off(s[1])) else s[1]
                ends.setdefault(at_a, ((off(s[0]) + off(s[1])) / 2, far))
        if len(ends) == 2 and ends[True][0] * ends[False][0] >= 0:
            used.add(i)
            out.append((r, float(number[1]), ends[True][1], ends[False][1]))
    return out


def trace_chain(records: list[dict], regions: list[dict], rules: ShapeRules, scale: float, done: set[str]) -> tuple[list[dict], list[dict]]:
    """Dimensions that no region was found for, and exploded ones, by their extension lines; and candidates for those left."""
    bound, open_, seen = [], [], set()
    segments = _segments(records, paths=True)
    asked = [(r, v, *_measured_points(r)[:2], r["dim_override"]) for r in records if r["type"] == "DIMENSION" and r["element_id"] not in done and (v := stated_value(r, scale)) is not None and len(_measured_points(r)) >= 2]
    for r, value, p, q in exploded_dimensions(records, segments, rules):
        if r["element_id"] not in seen:
            seen.add(r["element_id"])
            asked.append((r, round(value * scale, 2), p, q, r["text_raw"].strip()))
    for r, value, p, q, label in asked:
        g, could = trace(value, p, q, segments, regions, rules, len(records) < rules.wide_records)
        if g:
            bound.append(_fact(r, region_id=g["region_id"], material=g["material"], value=value, confidence="high" if g["hatch_pattern"] else "medium", chain="extension_trace"))
        else:
            open_.append({"element_id": r["element_id"], "value": value, "unit": "mm", "label": label, "anchor": [round((a + b) / 2, 1) for a, b in zip(p, q, strict=True)], "regions": could})
    return bound, open_


def review_chain(drawing: str, candidates: list[dict], choose: Callable[[dict], list[str]] | None = None) -> tuple[list[dict], list[dict]]:
    """Dimensions for a person to look at; choose (off by default) may rank a candidate's regions, and what it picks binds at low confidence."""
    facts, rows = [], []
    for c in candidates:
        uid = R.short_hash("vd_", f"{drawing}|{c['element_id'] or ''}|{c['value']}", 6)
        row = {"uid": uid, "drawing": drawing, "element_id": c["element_id"], "value": c["value"], "unit": c["unit"], "label": c["label"], "anchor": c["anchor"], "status": "pending", "chain": "vision", "confidence": "low", "material": None, "region_id": None}
        row["regions"] = [{"region_id": g["region_id"], "measured_width": g["thickness"], "material": g["material"], "layer": g["layer"]} for g in c["regions"]]
        ranked = choose(c) if choose and c["regions"] else []
        top = next((g for g in c["regions"] if ranked and g["region_id"] == ranked[0]), None)
        if top and top["material"]:
            row |= {"material": top["material"], "region_id": top["region_id"]}
            facts.append(_fact(c, region_id=top["region_id"], material=top["material"], value=c["value"], confidence="low", chain="vision", review_needed=True, dim_uid=uid))
        rows.append(row)
    return facts, rows


def analyse_sheet(records: list[dict], reader: R.Reader, rules: ShapeRules, choose=None) -> dict:
    """All evidence of one sheet: regions, evidence (before reconciling), assemblies, unattributed, dim_review, scale, references, wet area."""
    drawing = records[0]["drawing"] if records else ""
    regions = sheet_regions(records, reader, rules)
    scale, scale_conflict = scale_of_sheet(records)
    bound, assemblies, loose = dimension_chain(records, regions, rules, scale)
    traced, candidates = trace_chain(records, regions, rules, scale, {b["element_id"] for b in bound if b["element_id"]})
    seen, reviews = review_chain(drawing, candidates, choose)
    evidence = leader_chain(records, regions, rules) + bound + region_chain(regions) + traced + seen
    texts = [r["text_raw"] for r in records if r["text_raw"]] + [r["dim_override"] for r in records if r["dim_override"]]
    found = {t["element_id"] for t in traced if t["element_id"]}
    return {
        "drawing": drawing, "regions": regions, "evidence": [e | {"drawing": drawing, "ord": i} for i, e in enumerate(evidence)], "assemblies": assemblies, "unattributed": [x for x in loose if x["element_id"] not in found],
        "dim_review": reviews, "scale_factor": scale, "scale_conflict": scale_conflict, "depends_on": R.references(" ".join(texts)), "wet_area": any("wet area" in t.lower() for t in texts),
    }


_SMALL = "element_id STRING, value DOUBLE, unit STRING"
ANALYSIS = (
    f"drawing STRING, regions ARRAY<STRUCT<{schemas.as_fields(schemas.REGION)}>>, evidence ARRAY<STRUCT<{schemas.as_fields(schemas.FACT)}>>, assemblies ARRAY<STRUCT<{schemas.as_fields(_SMALL)}, regions: ARRAY<STRING>, kind: STRING>>, "
    f"unattributed ARRAY<STRUCT<{schemas.as_fields(_SMALL)}, dxf_handle: STRING, reason: STRING>>, dim_review ARRAY<STRUCT<{schemas.as_fields(schemas.REVIEW)}>>, scale_factor DOUBLE, scale_conflict BOOLEAN, depends_on ARRAY<STRING>, wet_area BOOLEAN"
)


def analyse(state: DataFrame, rules: ShapeRules | None = None, words: Words | None = None, choose=None) -> DataFrame:
    """A row per drawing with all evidence of its elements (schemas.STATE)."""
    rules, reader = rules or ShapeRules(), R.Reader(words)
    return per_group(state, ["drawing"], lambda rows: [analyse_sheet(sorted(rows, key=_order), reader, rules, choose)], ANALYSIS)


def _order(r: dict) -> tuple:
    return r["layer"] or "", r["type"] or "", r["geom"]["x"], r["geom"]["y"], r["text_raw"] or "", r["element_id"] or ""


def facts(analysed: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Bound facts of analysed drawings, rival evidence reconciled."""
    return reconcile(analysed.select(F.explode("evidence").alias("e")).select("e.*"), tolerance)


def reconcile(evidence: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """One fact from rival evidence (schemas.FACT) for a region, material and measure; without a region, for an element's.

    The best chain's item is the base.  A leader's own value wins and the chain
    names all chains; else a dimension and a measured region within 0.15 give
    the dimension's value; else a leader takes the measured value.  An item's
    own conflict, or strong values (leaders' own, dimensions, traces) further
    apart than the tolerance, make it a low conflict; an own value, or a
    dimension and a region together, make it high.
    """
    col = F.col
    rank = F.coalesce(*[F.when(col("chain") == k, n) for k, n in CHAIN_RANKS.items()], F.lit(9))
    rows = evidence.withColumn("measure", F.coalesce("measure", F.lit("thickness"))).withColumn("rank", rank)
    item = F.struct(*[c for c in evidence.columns if c != "measure"])
    own, dim, geo = F.coalesce("leader_own_value", F.lit(False)), col("chain").isin("dimension", "extension_trace"), col("chain") == "geometry"
    strong = F.when(col("value").isNotNull() & (own | dim), col("value"))
    first = lambda on: F.min_by(F.when(on, item), F.when(on, col("ord")))
    named = F.struct("rank", "chain")
    names = lambda on: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(on, named))), lambda x: x["chain"]), "+")
    key = ["drawing", "region_id", "material", "measure"]
    by = rows.groupBy(*key, F.when(col("region_id").isNull(), col("element_id")).alias("alone")).agg(
        F.min_by(item, F.struct("rank", "ord")).alias("base"), first(own).alias("own"), first(dim).alias("dim"), first(geo).alias("geo"), names(F.lit(True)).alias("chains"), names(dim | geo).alias("measured"),
        F.max(col("chain").startswith("leader")).alias("leader"), F.max(F.coalesce("conflict", F.lit(False))).alias("conflict"), F.count(strong).alias("n"), (F.max(strong) - F.min(strong)).alias("spread"),
    )
    agree = F.coalesce(F.abs(col("dim.value") - col("geo.value")) <= 0.15, F.lit(False))
    which = F.when(col("own").isNotNull(), "own").when(agree, "dim").when(col("leader") & col("geo").isNotNull(), "geo").otherwise("base")
    conflict = col("conflict") | F.coalesce((col("n") > 1) & (col("spread") > tolerance), F.lit(False))
    sure = F.when(conflict, "low").when(col("own").isNotNull() | (col("dim").isNotNull() & col("geo").isNotNull()), "high").otherwise(col("base.confidence"))
    pick = lambda **of: F.coalesce(*[F.when(col("which") == k, v) for k, v in of.items()], F.lit(None))
    value = F.when(col("which") == "own", col("own.value")).when(col("which") == "dim", col("dim.value")).when(col("which") == "geo", col("geo.value")).otherwise(col("base.value"))
    chain = F.when(col("which") == "own", col("chains")).when(col("which") == "dim", F.concat(F.when(col("leader"), "leader+").otherwise(""), col("measured"))).when(col("which") == "geo", "leader+geometry").otherwise(col("base.chain"))
    element = F.coalesce(pick(own=col("own.element_id"), dim=col("dim.element_id")), col("base.element_id"))
    qualifier = F.when(col("which") == "own", col("own.qualifier")).otherwise(col("base.qualifier"))
    by = by.withColumn("which", which)
    return by.select(
        "drawing", element.alias("element_id"), "region_id", "material", F.coalesce(pick(own=col("own.part")), col("base.part")).alias("part"), value.alias("value"), col("base.unit").alias("unit"), qualifier.alias("qualifier"),
        "measure", sure.alias("confidence"), chain.alias("chain"), conflict.alias("conflict"), F.coalesce("base.review_needed", F.lit(False)).alias("review_needed"), col("base.dim_uid").alias("dim_uid"),
    )
