"""Annotations put together from the single lines a drawing holds, one sheet at a time.

Signals in order: texts that are whole already (MTEXT, MULTILEADER), lines that
a leader points from and lines that go on below them, lines that stand under
each other, and the completeness of what joined and single lines say.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import TextRules, Words
from ..functions import reading as R
from .kernels import per_group

LINES = ("TEXT", "MTEXT", "MULTILEADER", "PDFTEXT")
PT = 25.4 / 72


# --- frames, heights, edges, gaps


def frame(r: dict) -> list[float]:
    """The line's box, turned back if the line stands upright."""
    x0, y0, x1, y1 = r["bbox"]
    if not 45 < (r["rotation"] or 0.0) % 180 < 135:
        return [x0, y0, x1, y1]
    cx, cy, w, h = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2
    return [cx - h, cy - w, cx + h, cy + w]


def height(r: dict) -> float | None:
    if r.get("height"):
        return float(r["height"])
    f = frame(r)
    return abs(f[3] - f[1]) or None


def edges(r: dict) -> tuple[float, float, float]:
    """Left, right and centre."""
    f = frame(r)
    return f[0], f[2], (f[0] + f[2]) / 2


def alignment(lines: list[dict]) -> int:
    """Which of the edges varies least, in text heights (the first of equals)."""
    if len(lines) < 2:
        return 0
    size = sum(height(r) or 1.0 for r in lines) / len(lines)
    return int(np.argmin(np.var(np.array([edges(r) for r in lines]) / size, axis=0)))


def box_distance(p, box) -> float:
    return math.hypot(max(box[0] - p[0], p[0] - box[2], 0.0), max(box[1] - p[1], p[1] - box[3], 0.0))


def vertical_gap(a: dict, b: dict) -> float:
    a, b = frame(a), frame(b)
    return max(a[1] - b[3], b[1] - a[3], 0.0)


def mergeable(group: list[dict], r: dict, rules: TextRules) -> bool:
    """Does the line go on below the group: same layer, rotation, height and edge, and a line's distance from the last one?"""
    last = group[-1]
    if rules.same_layer and r["layer"] != group[0]["layer"]:
        return False
    turn = [abs((r["rotation"] or 0.0) % 180 - (g["rotation"] or 0.0) % 180) for g in group]
    if any(min(t, abs(t - 180)) > rules.rotation for t in turn):
        return False
    own = height(r)
    if any(own and (h := height(g)) and abs(own - h) / max(own, h) > rules.height for g in group):
        return False
    off = [abs(a - b) for a, b in zip(edges(r), edges(last), strict=True)]
    if (min(off) if len(group) == 1 else off[alignment(group)]) > rules.edge:
        return False
    size = height(last) or own or 1.0
    return rules.gap[0] * size <= vertical_gap(last, r) <= rules.gap[1] * size


def mergeable_pair(a: Column, b: Column, rules: TextRules | None = None) -> Column:
    """mergeable() of two single lines as an expression; a, b: structs of layer, rotation, height and bbox of upright text."""
    rules = rules or TextRules()
    h = lambda r: F.coalesce(F.nullif(r["height"], F.lit(0.0)), F.nullif(F.abs(r["bbox"][3] - r["bbox"][1]), F.lit(0.0)))
    turn = F.abs(F.pmod(F.coalesce(a["rotation"], F.lit(0.0)), F.lit(180.0)) - F.pmod(F.coalesce(b["rotation"], F.lit(0.0)), F.lit(180.0)))
    off = F.least(F.abs(a["bbox"][0] - b["bbox"][0]), F.abs(a["bbox"][2] - b["bbox"][2]), F.abs(a["bbox"][0] + a["bbox"][2] - b["bbox"][0] - b["bbox"][2]) / 2)
    gap = F.greatest(a["bbox"][1] - b["bbox"][3], b["bbox"][1] - a["bbox"][3], F.lit(0.0))
    size = F.coalesce(h(a), h(b), F.lit(1.0))
    same_height = F.coalesce(F.abs(h(a) - h(b)) / F.greatest(h(a), h(b)) <= rules.height, F.lit(True))
    out = (F.least(turn, F.abs(turn - 180)) <= rules.rotation) & same_height & (off <= rules.edge) & gap.between(rules.gap[0] * size, rules.gap[1] * size)
    return out & (a["layer"] == b["layer"]) if rules.same_layer else out


# --- leaders


def leaders_of(records: list[dict], rules: TextRules) -> list[dict]:
    """Lines on note layers that touch text with exactly one end, and leaders of MULTILEADER texts with a known endpoint."""
    boxes = [r["geom"]["bbox"] for r in records if r["type"] in LINES[:3] and (r["text_raw"] or "").strip() and any(r["geom"]["bbox"])]
    out = []
    for r in records:
        if r["type"] == "MULTILEADER" and r.get("leader_endpoint"):
            at = (r["insert_x"], r["insert_y"]) if r["insert_x"] is not None else tuple(r["leader_endpoint"])
            out.append({"handle": r["dxf_handle"], "near": at, "far": tuple(r["leader_endpoint"])})
        if r["type"] not in ("LINE", "LWPOLYLINE") or not any(s in (r["layer"] or "").upper() for s in rules.note_layers) or len(r["vertices"] or []) < 2:
            continue
        ends = [tuple(r["vertices"][0]), tuple(r["vertices"][-1])]
        touch = [any(box_distance(p, b) <= rules.capture for b in boxes) for p in ends]
        if touch[0] != touch[1]:
            near, far = ends if touch[0] else ends[::-1]
            out.append({"handle": r["dxf_handle"], "near": tuple(round(v, 1) for v in near), "far": tuple(round(v, 1) for v in far)})
    out.sort(key=lambda x: x["far"])
    return [x | {"id": f"l_{i:02d}"} for i, x in enumerate(out)]


def _by_place(lines: list[dict]) -> list[dict]:
    """Top down, then left to right."""
    return sorted(lines, key=lambda r: (-frame(r)[3], frame(r)[0]))


def leader_groups(lines: list[dict], leaders: list[dict], rules: TextRules) -> tuple[dict[str, list[dict]], int]:
    """Lines of each leader: those it is nearest to, and lines that go on from them unless another leader is nearer; and how many lines several leaders reach."""
    reach = {r["n"]: sorted((d, x["id"]) for x in leaders if (d := box_distance(x["near"], r["bbox"])) <= rules.capture) for r in lines}
    groups: dict[str, list[dict]] = {x["id"]: [] for x in leaders}
    for r in lines:
        if reach[r["n"]]:
            groups[reach[r["n"]][0][1]].append(r)
    taken = {r["n"] for g in groups.values() for r in g}
    grew = True
    while grew:
        grew = False
        for x in leaders:
            group = groups[x["id"]]
            if not group:
                continue
            held = _by_place(group)
            for r in lines:
                if r["n"] in taken or not mergeable(held, r, rules):
                    continue
                own = box_distance(x["near"], r["bbox"])
                if all(box_distance(o["near"], r["bbox"]) >= own for o in leaders if o is not x):
                    group.append(r)
                    taken.add(r["n"])
                    grew = True
    return groups, sum(len(x) > 1 for x in reach.values())


# --- annotations


def _annotation(lines: list[dict], how: dict, far, drawing, reader: R.Reader) -> dict:
    first, *_ = lines = _by_place(lines)
    text = R.squeeze(" ".join(r["text"] for r in lines))
    box = [round(f([r["bbox"][i] for r in lines]), 1) for f, i in ((min, 0), (min, 1), (max, 2), (max, 3))]
    geom = {"x": round((box[0] + box[2]) / 2, 1), "y": round((box[1] + box[3]) / 2, 1), "bbox": box}
    layer = how.pop("layer")
    handles = sorted({r["handle"] for r in lines if r["handle"]})
    return {
        "drawing": drawing, "type": "ANNOTATION", "dxf_handle": "|".join(handles), "handles": handles, "layer": layer, "geom": geom, "text_raw": text, "parsed": reader.read_element(text, None),
        "fingerprint": R.fingerprint("ANNOTATION", layer, geom["x"], geom["y"], box, text, None, None, None), "height": first["height"], "rotation": first["rotation"],
        "insert_x": first["insert"][0], "insert_y": first["insert"][1], "leader_endpoint": list(far) if far else None, "leader_id": how["leader_id"], "source": first["source"],
        "source_lines": [{"text": r["text"], "bbox": r["bbox"], "entity_handle": r["handle"], "insert": list(r["insert"]) if r["insert"][0] is not None else None} for r in lines], "reassembly": how,
    }


def reassemble_sheet(records: list[dict], rules: TextRules, reader: R.Reader, adjudicate: Callable[[list[str]], list[list[int]]] | None = None) -> list[dict]:
    """A sheet's records with its text lines replaced by annotations.

    adjudicate: given the texts of lines that stand together but read better
    apart, may group them (a strict partition of their places; anything else is
    dropped).
    """
    leaders, lines = leaders_of(records, rules), []
    for at, r in enumerate(records):
        text = R.plain_mtext(r["text_raw"]) if r["type"] == "MTEXT" else R.squeeze(r["text_raw"])
        if r["type"] in LINES and text:
            line = {"n": len(lines), "at": at, "text": text, "bbox": [float(v) for v in r["geom"]["bbox"]], "insert": (r["insert_x"], r["insert_y"]), "layer": r["layer"] or "0", "handle": r["dxf_handle"] or ""}
            lines.append(line | {k: r.get(k) for k in ("height", "rotation", "type", "source")})
    by_id = {x["id"]: x for x in leaders}
    groups: list[tuple[list[dict], dict]] = []

    def add(members: list[dict], signal: str, sure: str, leader: str | None = None, alternatives: int = 0, ai: bool = False) -> None:
        groups.append((members, {"signal": signal, "confidence": sure, "leader_id": leader, "alternatives_considered": alternatives, "ai_used": ai, "layer": members[0]["layer"]}))

    own_leader = {x["handle"]: x for x in leaders if x["handle"]}
    free = []
    for r in lines:
        if r["type"] not in ("MTEXT", "MULTILEADER"):
            free.append(r)
        elif r["type"] == "MULTILEADER" and r["handle"] in own_leader:
            add([r], "multileader", "high", own_leader[r["handle"]]["id"])
        else:
            near = sorted((d, x["id"]) for x in leaders if (d := box_distance(x["near"], r["bbox"])) <= rules.capture)
            add([r], r["type"].lower(), "high", near[0][1] if near else None, max(0, len(near) - 1))
    if free and leaders:
        held, contested = leader_groups(free, leaders, rules)
        for leader, members in held.items():
            if members:
                add(_by_place(members), "leader", "high", leader, contested)
        taken = {r["n"] for members in held.values() for r in members}
        free = [r for r in free if r["n"] not in taken]
    stacks: list[list[dict]] = []
    for r in _by_place(free):
        home = next((g for g in stacks if mergeable(g, r, rules)), None)
        if home is None:
            stacks.append([r])
        else:
            home.append(r)
    unsure: list[dict] = []
    for members in stacks:
        members = _by_place(members)
        texts = [r["text"] for r in members]
        if len(members) == 1:
            add(members, "singleton", "high")
        elif reader.should_merge(texts) or len(members) == 2 and not all(reader.read(t) for t in texts):
            add(members, "contiguity+parse", "high", alternatives=1)
        else:
            unsure += members
    parts = None
    if unsure and adjudicate is not None:
        parts = adjudicate([r["text"] for r in unsure])
        if sorted(i for p in parts for i in p) != list(range(len(unsure))):
            parts = None
    if parts is None:
        for r in unsure:
            add([r], "split-parses-better", "medium", alternatives=1)
    else:
        for p in parts:
            add(_by_place([unsure[i] for i in p]), "ai", "medium", alternatives=len(unsure), ai=True)
    used = {r["at"] for members, _ in groups for r in members}
    drawing = records[0]["drawing"]
    out = [r for at, r in enumerate(records) if at not in used]
    out += [_annotation(members, how, by_id[how["leader_id"]]["far"] if how["leader_id"] else None, drawing, reader) for members, how in groups]
    return sorted(out, key=state_order)


def state_order(r: dict) -> tuple:
    return r["layer"], r["type"], r["geom"]["x"], r["geom"]["y"], r["text_raw"] or ""


def reassemble(elements: DataFrame, rules: TextRules | None = None, words: Words | None = None, adjudicate=None) -> DataFrame:
    """Element rows (drawing and schemas.ELEMENT) with lines replaced by annotations; a drawing is one group."""
    rules, reader = rules or TextRules(), R.Reader(words)
    rows = elements.select([F.col(f.name) if f.name in elements.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.struct(f"drawing STRING, {schemas.ELEMENT}")])
    return per_group(rows, ["drawing"], lambda group: reassemble_sheet(sorted(group, key=lambda r: (*state_order(r), r["dxf_handle"] or "")), rules, reader, adjudicate), rows.schema)


# --- text spans of a page


def span_lines(spans: list[dict]) -> list[dict]:
    """Spans (text, x0, y0, x1, y1, size, rotation) of a page as lines: same rotation, size and baseline, and no wide gap; top down."""
    lines: list[dict] = []
    for s in spans:
        if not s["text"]:
            continue
        size, turn = s["size"] or 1.0, s["rotation"] or 0
        flat = turn % 180 == 0
        lo, hi, base = (s["x0"], s["x1"], s["y0"]) if flat else (s["y0"], s["y1"], s["x0"])
        for x in lines:
            top = max(size, x["size"])
            if x["rotation"] == turn and abs(size - x["size"]) / top <= 0.15 and abs(base - x["base"]) <= 0.3 * top and lo <= x["hi"] + 0.6 * size and x["lo"] <= hi + 0.6 * size:
                x["spans"].append((lo, hi, size, s))
                x["lo"], x["hi"], x["base"] = min(x["lo"], lo), max(x["hi"], hi), min(x["base"], base)
                break
        else:
            lines.append({"rotation": turn, "size": size, "lo": lo, "hi": hi, "base": base, "spans": [(lo, hi, size, s)]})
    out = []
    for x in lines:
        text, end = "", None
        for lo, hi, size, s in sorted(x["spans"], key=lambda p: p[0]):
            if not s["text"].strip():
                text, end = text + " ", None
                continue
            if end is not None and not text.endswith(" ") and lo - end > 0.5 * size:
                text += " "
            text, end = text + s["text"], hi
        text = re.sub(" {2,}", " ", text).strip()
        if text:
            parts = [s for *_, s in x["spans"]]
            sizes = sorted(s["size"] or 0 for s in parts)
            out.append({"text": text, "x0": min(s["x0"] for s in parts), "y0": min(s["y0"] for s in parts), "x1": max(s["x1"] for s in parts), "y1": max(s["y1"] for s in parts), "size": sizes[len(sizes) // 2], "rotation": x["rotation"]})
    return sorted(out, key=lambda r: (-r["y1"], r["x0"]))


def lines_of_pages(spans: DataFrame) -> DataFrame:
    """(drawing, page, line, text, x0, y0, x1, y1, size, rotation) from spans in reading order (column seq)."""
    def page(rows: list[dict]):
        ordered = sorted(rows, key=lambda r: r["seq"])
        return [r | {"drawing": rows[0]["drawing"], "page": rows[0]["page"], "line": i + 1} for i, r in enumerate(span_lines(ordered))]

    return per_group(spans, ["drawing", "page"], page, "drawing STRING, page INT, line INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE, rotation INT")


def page_elements(lines: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Lines of text and stroked paths (drawing, page, seq, x0, y0, x1, y1; points) of pages as element rows in mm."""
    def mm(name: str) -> Column:
        return F.round(F.col(name) * PT, 1)

    def shaped(df: DataFrame, handle: Column, kind: str, extra: dict[str, Column]) -> DataFrame:
        x0, y0, x1, y1 = (mm(c) for c in ("x0", "y0", "x1", "y1"))
        box = F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
        geom = F.struct(F.round((x0 + x1) / 2, 1).alias("x"), F.round((y0 + y1) / 2, 1).alias("y"), box.alias("bbox"))
        known = {"dxf_handle": handle, "type": F.lit(kind), "layer": F.format_string("PDF-P%d", "page"), "geom": geom, "source": F.lit("pdf"), **extra}
        return df.select("drawing", *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(schemas.ELEMENT)])

    texts = shaped(lines, F.format_string("pdf:%02d-%04d", "page", "line"), "PDFTEXT", {"text_raw": F.col("text"), "height": F.nullif(mm("size"), F.lit(0.0)), "rotation": F.coalesce("rotation", F.lit(0)), "insert_x": mm("x0"), "insert_y": mm("y1")})
    if paths is None:
        return texts
    ends = F.array(F.array(mm("x0"), mm("y0")), F.array(mm("x1"), mm("y1")))
    strokes = shaped(paths, F.format_string("pdfpath:%02d-%04d", "page", "seq"), "PDFPATH", {"vertices": ends, "length": F.round(F.hypot(mm("x1") - mm("x0"), mm("y1") - mm("y0")), 1)})
    from ..functions.text import fingerprint

    strokes = strokes.withColumn("fingerprint", fingerprint(F.struct(*strokes.columns)))
    return texts.unionByName(strokes)


def page_state(spans: DataFrame, paths: DataFrame | None = None, rules: TextRules | None = None, words: Words | None = None) -> DataFrame:
    """Pages' spans and paths as annotations and paths of their drawings; a drawing without text has no rows."""
    from pyspark.sql import functions as F

    texts = reassemble(page_elements(lines_of_pages(spans)), rules, words)
    if paths is None:
        return texts
    strokes = page_elements(lines_of_pages(spans), paths).filter("type = 'PDFPATH'").join(spans.select("drawing").distinct(), "drawing", "left_semi")
    return texts.unionByName(strokes.select(texts.columns)).withColumn("source", F.lit("pdf"))
