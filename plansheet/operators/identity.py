"""Entity resolution across revisions, changes between matched elements, and islands of elements.

All tiers of matching ask for the same type and layer, so a group of one
drawing, type and layer is matched by itself, in the order of its rows, with
the same result as the whole drawing at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import reading as R
from .kernels import per_pair
from .search import modal_offset

#: Largest distance of a fuzzy match, and least ratio of its texts; what counts as moved.
TOLERANCE, LEAST_RATIO, MOVED = 25.0, 0.6, 0.15
TEXTS = ("TEXT", "MTEXT", "MULTILEADER", "ANNOTATION")
COMPARED = ("material", "value", "unit", "qualifier", "profile", "dims", "r_value")
#: What matching and comparing read of an element.
FIELDS = ["dxf_handle", "handles", "type", "layer", "geom", "text_raw", "parsed", "hatch_pattern", "dim_measurement", "dim_override", "fingerprint"]


def parsed_equal(a: Column, b: Column) -> Column:
    """Do two readings say the same? A part that only one of them names doesn't count."""
    same = F.lit(True)
    for name in COMPARED:
        same = same & a[name].eqNullSafe(b[name])
    part = a["part"].isNull() | b["part"].isNull() | (a["part"] == b["part"])
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same & part)


def change_status(now: Column, before: Column, reach: float = MOVED) -> Column:
    """new, unchanged, moved, value_changed or moved+value_changed, of two element structs (before: null if there is none); a move goes farther than reach."""
    far = F.hypot(now["geom"]["x"] - before["geom"]["x"], now["geom"]["y"] - before["geom"]["y"]) > reach
    edges = F.exists(F.zip_with(now["geom"]["bbox"], before["geom"]["bbox"], lambda a, b: F.abs(a - b) > reach), lambda x: F.coalesce(x, F.lit(False)))
    moved = F.coalesce(far, F.lit(False)) | F.coalesce(edges, F.lit(False))
    changed = ~parsed_equal(now["parsed"], before["parsed"])
    for name in ("text_raw", "hatch_pattern", "dim_measurement", "dim_override"):
        changed = changed | ~now[name].eqNullSafe(before[name])
    status = F.when(moved & changed, "moved+value_changed").when(moved, "moved").when(changed, "value_changed").otherwise("unchanged")
    return F.when(before.isNull(), "new").otherwise(status)


def translations(now: DataFrame, before: DataFrame, share: float = 0.8) -> DataFrame:
    """(drawing, dx, dy, n, total) of drawings that moved as a whole, as most elements with a common handle, type and layer say."""
    key = ["drawing", "dxf_handle", "type", "layer"]
    a = now.select(*key, F.col("geom.x").alias("x"), F.col("geom.y").alias("y"))
    b = before.select(*key, F.col("geom.x").alias("px"), F.col("geom.y").alias("py"))
    pairs = a.join(b, key).select("drawing", F.round(F.col("x") - F.col("px"), 1).alias("dx"), F.round(F.col("y") - F.col("py"), 1).alias("dy"))
    return modal_offset(pairs, share)


def _shift(r: dict) -> dict:
    """The element without the drawing's own move, for matching and comparing."""
    dx, dy = r.get("dx") or 0.0, r.get("dy") or 0.0
    if not dx and not dy:
        return r
    g = r["geom"]
    box = [round(v - (dy if i % 2 else dx), 1) for i, v in enumerate(g["bbox"])]
    geom = {"x": round(g["x"] - dx, 1), "y": round(g["y"] - dy, 1), "bbox": box}
    moved = R.fingerprint(r["type"], r["layer"], geom["x"], geom["y"], box, r["text_raw"], r["hatch_pattern"], r["dim_measurement"], r["dim_override"])
    return r | {"geom": geom, "moved_print": moved}


def _same_reading(a: dict | None, b: dict | None) -> bool:
    if a is None or b is None:
        return a is b
    return all(a.get(k) == b.get(k) for k in COMPARED) and (a.get("part") is None or b.get("part") is None or a["part"] == b["part"])


def _status(now: dict, before: dict) -> str:
    g, p = now["geom"], before["geom"]
    moved = math.hypot(g["x"] - p["x"], g["y"] - p["y"]) > MOVED or any(abs(x - y) > MOVED for x, y in zip(g["bbox"], p["bbox"], strict=False))
    changed = not _same_reading(now["parsed"], before["parsed"]) or any(now[k] != before[k] for k in ("text_raw", "hatch_pattern", "dim_measurement", "dim_override"))
    return "+".join(x for x, on in (("moved", moved), ("value_changed", changed)) if on) or "unchanged"


def _handles(r: dict) -> set[str]:
    return {h for h in [*(r["dxf_handle"] or "").split("|"), *(r["handles"] or [])] if h}


class _Earlier:
    """Elements of an earlier revision, looked up by handle, fingerprint and place; each is given out once."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = sorted(rows, key=lambda r: (r["deleted"], r["ord"]))
        self.used: set[str] = set()
        self.by_handle = {r["dxf_handle"]: i for i, r in enumerate(self.rows) if not r["deleted"]}
        self.by_piece: dict[str, list[int]] = {}
        self.by_print: dict[str, list[int]] = {}
        self.by_cell: dict[tuple[int, int], list[int]] = {}
        for i, r in enumerate(self.rows):
            if not r["deleted"]:
                for h in _handles(r):
                    self.by_piece.setdefault(h, []).append(i)
            if r["fingerprint"]:
                self.by_print.setdefault(r["fingerprint"], []).append(i)
            self.by_cell.setdefault(self._cell(r), []).append(i)

    @staticmethod
    def _cell(r: dict) -> tuple[int, int]:
        return math.floor(r["geom"]["x"] / TOLERANCE), math.floor(r["geom"]["y"] / TOLERANCE)

    def _free(self, found) -> dict | None:
        return next((self.rows[i] for i in found if self.rows[i]["element_id"] not in self.used), None)

    def match(self, r: dict) -> tuple[dict | None, str, float]:
        if r["dxf_handle"] in self.by_handle:
            hit = self._free([self.by_handle[r["dxf_handle"]]])
        else:
            hit = self._free(sorted({i for h in _handles(r) for i in self.by_piece.get(h, ())}))
        if hit:
            return hit, "handle", 1.0
        hit = self._free([*self.by_print.get(r["fingerprint"] or "", ()), *self.by_print.get(r.get("moved_print") or "", ())])
        if hit:
            return hit, "fingerprint", 1.0
        best, sure = None, (-1.0, 1.0)
        x, y = self._cell(r)
        for i in sorted(i for a in (-1, 0, 1) for b in (-1, 0, 1) for i in self.by_cell.get((x + a, y + b), ())):
            p = self.rows[i]
            far = math.hypot(r["geom"]["x"] - p["geom"]["x"], r["geom"]["y"] - p["geom"]["y"]) / TOLERANCE
            if far > 1 or p["element_id"] in self.used:
                continue
            like = R.text_likeness(r["text_raw"], p["text_raw"]) if r["type"] in TEXTS else 1 - far
            if r["type"] in TEXTS and like < LEAST_RATIO:
                continue
            score = like - 0.2 * far if r["type"] in TEXTS else like
            if score > sure[0]:
                best, sure = p, (score, round(like, 3))
        return best, "fuzzy" if best else "new", sure[1]


def _match(now: list[dict], earlier: list[dict]):
    pool, minted = _Earlier(earlier), {r["element_id"] for r in earlier}
    for r in sorted(now, key=lambda r: r["ord"]):
        moved = _shift(r)
        hit, tier, sure = pool.match(moved)
        if hit:
            pool.used.add(hit["element_id"])
            live = next((p for p in pool.rows if p["element_id"] == hit["element_id"] and not p["deleted"]), hit)
            found = (hit["element_id"], _status(moved, live), live["text_raw"])
        else:
            named = f"{r['drawing']}|{r['type']}|{r['layer']}|{r['fingerprint']}|{r['dxf_handle']}"
            k = 0
            while (eid := R.short_hash("e_", f"{named}|{k}", 12)) in minted:
                k += 1
            minted.add(eid)
            found = (eid, "new", None)
        yield {"drawing": r["drawing"], "type": r["type"], "layer": r["layer"], "ord": r["ord"], "element_id": found[0], "status": found[1], "match_tier": tier, "match_confidence": sure, "previous_text": found[2]}


def _ordered(df: DataFrame) -> DataFrame:
    """Rows with their place (ord) within their drawing, type and layer: given, or by position, text and handle."""
    df = df.withColumns({"layer": F.coalesce("layer", F.lit("0")), "type": F.coalesce("type", F.lit(""))})
    if "ord" in df.columns:
        return df.withColumn("ord", F.col("ord").cast("long"))
    w = Window.partitionBy("drawing", "type", "layer").orderBy("geom.x", "geom.y", F.coalesce("text_raw", F.lit("")), F.coalesce("dxf_handle", F.lit("")), F.coalesce("fingerprint", F.lit("")))
    return df.withColumn("ord", F.row_number().over(w).cast("long"))


def resolve(now: DataFrame, before: DataFrame, tombstones: DataFrame | None = None, share: float = 0.8) -> DataFrame:
    """now with element_id, status, match_tier, match_confidence and previous_text: who is who among a drawing's elements.

    now, before: element rows (drawing and FIELDS, before with element_id);
    tombstones: rows of deleted elements in before's form.  A drawing that
    moved as a whole is compared without that move.  Rows are taken in the
    order of column ord (else by place), and each earlier id is used once: by
    handle, by a common handle of joined annotations, by fingerprint (deleted
    ones come back so), by likeness within TOLERANCE.  What matches nothing
    gets an id made of its content.
    """
    old = _ordered(before).select("drawing", "element_id", "ord", *FIELDS, F.lit(False).alias("deleted"))
    if tombstones is not None:
        old = old.unionByName(_ordered(tombstones).select("drawing", "element_id", "ord", *FIELDS, F.lit(True).alias("deleted")))
    rows = _ordered(now)
    moves = translations(now, before, share).select("drawing", "dx", "dy")
    given = rows.select("drawing", "ord", *FIELDS).join(moves, "drawing", "left")
    key = ["drawing", "type", "layer"]
    names = [("ord", T.LongType()), ("element_id", T.StringType()), ("status", T.StringType()), ("match_tier", T.StringType()), ("match_confidence", T.DoubleType()), ("previous_text", T.StringType())]
    found = per_pair(given, old, key, _match, T.StructType([given.schema[c] for c in key] + [T.StructField(*x) for x in names]))
    kept = rows.drop("element_id", "status", "match_tier", "match_confidence", "previous_text")
    return kept.join(found, [*key, "ord"]).drop("ord")


def fuzzy_reviews(resolved: DataFrame) -> DataFrame:
    """Matches by likeness, for a person to look at."""
    return resolved.filter("match_tier = 'fuzzy'").select("drawing", "element_id", "dxf_handle", F.col("match_confidence").alias("confidence"), "previous_text", F.col("text_raw").alias("current_text"))


def identity_map(resolved: DataFrame, before: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The map of all ids that ever were (drawing, element_id, deleted, FIELDS): it only grows.

    Resolved elements are live, earlier ones that matched nothing are deleted
    and keep their last fields, other known ids stay as they are.
    """
    key = ["drawing", "element_id"]
    live = resolved.select(*key, F.lit(False).alias("deleted"), *FIELDS)
    gone = before.join(resolved.select(*key), key, "left_anti").select(*key, F.lit(True).alias("deleted"), *FIELDS)
    out = live.unionByName(gone)
    return out if known is None else out.unionByName(known.join(out.select(*key), key, "left_anti").select(*key, "deleted", *FIELDS))


def tombstones(known: DataFrame) -> DataFrame:
    """Deleted elements of an identity map, as rows to match."""
    return known.filter("deleted").drop("deleted")



def content_islands(boxes: DataFrame, gap: float) -> DataFrame:
    """(drawing, element_id, island): elements whose boxes lie within gap of each other, directly or by others; an island is named by its smallest element."""
    id_type, drawing_type = boxes.schema["element_id"].dataType.simpleString(), boxes.schema["drawing"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("element_id").reset_index(drop=True)
        b, parent = np.array(pdf["bbox"].tolist(), float), np.arange(len(pdf))

        def top(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        order = np.argsort(b[:, 0], kind="stable")
        open_: list[int] = []
        for i in order.tolist():  # a sweep over x: only boxes still within reach are compared
            open_ = [j for j in open_ if b[i, 0] - b[j, 2] <= gap]
            for j in open_:
                dx, dy = max(b[i, 0] - b[j, 2], b[j, 0] - b[i, 2], 0), max(b[i, 1] - b[j, 3], b[j, 1] - b[i, 3], 0)
                if math.hypot(dx, dy) <= gap:
                    x, y = sorted((top(i), top(j)))
                    parent[y] = x
            open_.append(i)
        return pd.DataFrame({"drawing": pdf["drawing"], "element_id": pdf["element_id"], "island": [pdf["element_id"][top(i)] for i in range(len(pdf))]})

    return boxes.select("drawing", "element_id", "bbox").groupBy("drawing").applyInPandas(one, f"drawing {drawing_type}, element_id {id_type}, island {id_type}")
