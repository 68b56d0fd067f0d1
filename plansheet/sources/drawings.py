"""ASCII group-code drawings as element rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import reading as R

# Entity types that a scan keeps, and versions from the oldest to the newest.
KEPT = ("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "HATCH", "TEXT", "MTEXT", "DIMENSION", "MULTILEADER")
VERSIONS = ["AC1009", "AC1015", "AC1018", "AC1021", "AC1024", "AC1027", "AC1032"]
_FULL_TURN = 2 * math.pi


def r1(v) -> float:
    """To 0.1; what is no number is 0."""
    try:
        return round(float(v), 1)
    except (TypeError, ValueError):
        return 0.0


def supported(version: str) -> bool:
    return version in VERSIONS and VERSIONS.index(version) >= VERSIONS.index("AC1032")


def _pairs(content: str) -> list[tuple[str, str]]:
    lines = content.splitlines()
    return [(code.strip(), value.strip("\r")) for code, value in zip(lines[::2], lines[1::2], strict=False)]


def version_of(content: str) -> str:
    pairs = _pairs(content)
    return next((after[1].strip() for at, after in zip(pairs, pairs[1:], strict=False) if (at[0], at[1].strip()) == ("9", "$ACADVER")), "")


class _Entity:
    """Group codes of one entity, in order."""

    def __init__(self, type_: str) -> None:
        self.type, self.codes = type_, []

    def text(self, code: str) -> str | None:
        return next((v for c, v in self.codes if c == code), None)

    def number(self, code: str) -> float | None:
        try:
            return float(self.text(code))
        except (TypeError, ValueError):
            return None

    def points(self, x: str, y: str) -> list[list[float]]:
        """Each x with the y that follows it."""
        out: list[list[float]] = []
        for c, v in self.codes:
            if c == x:
                out.append([float(v)])
            elif c == y and out and len(out[-1]) == 1:
                out[-1].append(float(v))
        return [p for p in out if len(p) == 2]

    def point(self, x: str, y: str) -> list[float] | None:
        return next(iter(self.points(x, y)), None)


def _entities(content: str) -> Iterator[_Entity]:
    section, now = "", None
    for code, value in [*_pairs(content), ("0", "EOF")]:
        if code == "0":
            kind = value.strip()
            if kind == "VERTEX" and now is not None and now.type == "POLYLINE":
                now.codes.append(("vertex", ""))
                continue
            if now is not None and now.type in KEPT and section == "ENTITIES":
                yield now
            now = _Entity(kind)
        elif code == "2" and now is not None and now.type == "SECTION":
            section = value.strip()
        elif now is not None:
            now.codes.append((code, value))


def _vertices(e: _Entity) -> list[list[float]]:
    if e.type == "LINE":
        return [p for p in (e.point("10", "20"), e.point("11", "21")) if p]
    if e.type in ("CIRCLE", "ARC"):
        return e.points("10", "20")[:1]
    if e.type == "HATCH":  # the first point is the elevation
        return e.points("10", "20")[1 : 1 + int(e.number("93") or 0)]
    if e.type == "POLYLINE":
        at = next((i for i, (c, _) in enumerate(e.codes) if c == "vertex"), len(e.codes))
        rest = _Entity(e.type)
        rest.codes = e.codes[at:]
        return rest.points("10", "20")
    return e.points("10", "20") if e.type == "LWPOLYLINE" else []


def _box(e: _Entity, pts: list[list[float]], text: str | None) -> list[float]:
    """Extent; of a text as if its letters were as wide as high; of a dimension none."""
    if e.type in ("CIRCLE", "ARC") and pts:
        (x, y), r = pts[0], e.number("40") or 0.0
        return [x - r, y - r, x + r, y + r]
    if e.type in ("TEXT", "MTEXT", "MULTILEADER"):
        at = e.point("10", "20")
        if at is None:
            return [0.0] * 4
        h, turn = e.number("40") or 0.0, math.radians(e.number("50") or 0.0)
        lines = R.plain_mtext(text) if e.type != "TEXT" else text or ""
        w = h * len(lines)
        down = -1 if e.type == "MTEXT" else 1
        corners = [(x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)) for x in (0.0, w) for y in (0.0, down * h)]
        pts = [[at[0] + x, at[1] + y] for x, y in corners]
    if not pts:
        return [0.0] * 4
    xs, ys = zip(*pts, strict=True)
    return [min(xs), min(ys), max(xs), max(ys)]


def _length(e: _Entity, pts: list[list[float]], closed: bool) -> float | None:
    if e.type in ("LINE", "LWPOLYLINE", "POLYLINE"):
        ring = [*pts, pts[0]] if closed and len(pts) > 2 else pts
        return r1(sum(math.dist(a, b) for a, b in zip(ring, ring[1:], strict=False)))
    if e.type == "CIRCLE":
        return r1(_FULL_TURN * (e.number("40") or 0.0))
    if e.type == "ARC":
        return r1((e.number("40") or 0.0) * (math.radians((e.number("51") or 0.0) - (e.number("50") or 0.0)) % _FULL_TURN))
    return None


def _row(e: _Entity, reader: R.Reader) -> dict:
    kind = "LWPOLYLINE" if e.type == "POLYLINE" else e.type
    text = None
    if e.type == "TEXT":
        text = e.text("1")
    elif e.type == "MTEXT":
        text = "".join(v for c, v in e.codes if c in ("1", "3"))
    elif e.type == "MULTILEADER":
        text = e.text("304")
    pts = _vertices(e)
    closed = bool(int(e.number("70") or 0) & 1) if kind == "LWPOLYLINE" else None
    box = [r1(v) for v in _box(e, pts, text)]
    geom = {"x": r1((box[0] + box[2]) / 2), "y": r1((box[1] + box[3]) / 2), "bbox": box}
    dim = e.type == "DIMENSION"
    measured = r1(e.number("42")) if dim and e.number("42") is not None else None
    override = (e.text("1") or None) if dim else None
    override = None if override in ("<>", "") else override
    hatch = e.text("2") if e.type == "HATCH" else None
    at = e.point("10", "20") if text is not None else None
    arrow = e.points("10", "20")[-1:] if e.type == "MULTILEADER" else []
    layer = e.text("8") or "0"
    return {
        "dxf_handle": e.text("5") or "", "type": kind, "layer": layer, "geom": geom, "text_raw": text, "parsed": reader.read_element(text, hatch), "hatch_pattern": hatch, "hatch_scale": e.number("41") if hatch else None,
        "dim_measurement": measured, "dim_override": override, "dim_defpoints": [[r1(v) for v in p] for x, y in (("10", "20"), ("13", "23"), ("14", "24")) if (p := e.point(x, y))] if dim else None, "dim_style": e.text("3") if dim else None,
        "fingerprint": R.fingerprint(kind, layer, geom["x"], geom["y"], box, text, hatch, measured, override), "height": e.number("40") if text is not None else None, "rotation": (e.number("50") or 0.0) if text is not None else None,
        "vertices": [[r1(v) for v in p] for p in pts] or None, "length": _length(e, pts, bool(closed)), "linetype": e.text("6"), "closed": closed, "insert_x": at and r1(at[0]), "insert_y": at and r1(at[1]),
        "leader_endpoint": [r1(v) for v in arrow[0]] if arrow else None,
    }


def scan(content: str, reader: R.Reader | None = None) -> list[dict]:
    """Element rows of one drawing, in state order."""
    reader = reader or R.Reader()
    rows = [_row(e, reader) for e in _entities(content)]
    return sorted(rows, key=lambda r: (r["layer"], r["type"], r["geom"]["x"], r["geom"]["y"], r["text_raw"] or "", r["dxf_handle"]))


def read_drawings(spark: SparkSession, path: str, words=None) -> DataFrame:
    """(path, drawing, version, supported, schemas.ELEMENT) of all *.dxf below path; entities of other types than KEPT are left out, versions below AC1032 read and marked."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dxf").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    named = files.withColumn("drawing", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.dxf$", ""))
    schema = schemas.struct(f"path STRING, drawing STRING, version STRING, supported BOOLEAN, {schemas.ELEMENT}")
    arrow, reader = to_arrow_schema(schema), R.Reader(words)

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                version = version_of(r["value"])
                found = [x | {"path": r["path"], "drawing": r["drawing"], "version": version, "supported": supported(version)} for x in scan(r["value"], reader)]
                if found:
                    yield from pa.Table.from_pylist(found, schema=arrow).to_batches()

    return named.select("path", "drawing", "value").mapInArrow(rows, schema)
