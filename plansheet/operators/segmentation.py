"""Sheets split into details at their title bubbles, and details with what is known of them, one sheet at a time."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import SheetRules, Words
from ..functions import reading as R
from ..vocabulary import Vocabulary, facets_of
from . import shapes as S
from .attribution import ANNOTATIONS
from .kernels import nearest, per_group, per_pair

_TITLED = ("TEXT", "MTEXT", "ANNOTATION")


def anchor(r: dict) -> S.Point | None:
    """Insertion point, else the middle of a dimension's points, else of the element."""
    if r["insert_x"] is not None and r["insert_y"] is not None:
        return r["insert_x"], r["insert_y"]
    box = _measured_box(r)
    if box:
        return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return (r["geom"]["x"], r["geom"]["y"]) if r["geom"] else None


def _measured_box(r: dict) -> list[float] | None:
    pts = [p for p in r["dim_defpoints"] or [] if p] if r["type"] == "DIMENSION" else []
    return S.bbox([(p[0], p[1]) for p in pts]) if len(pts) >= 2 else None


def box(r: dict) -> list[float] | None:
    b = list(r["geom"]["bbox"]) if r["geom"] else None
    return _measured_box(r) or b if b == [0.0] * 4 else b


def markers(records: list[dict], rules: SheetRules) -> list[dict]:
    """Bubbles with a tag inside, with the nearest scale and title beside them, left to right."""
    texts = [(r, at) for r in records if r["type"] in _TITLED and (r["text_raw"] or "").strip() and (at := anchor(r))]
    out = []
    for r in records:
        if r["type"] != "CIRCLE":
            continue
        at = tuple(r["vertices"][0][:2]) if r["vertices"] else anchor(r)
        b = r["geom"]["bbox"] if r["geom"] else [0.0] * 4
        radius = (r["length"] or 0) / (2 * math.pi) or max(b[2] - b[0], b[3] - b[1]) / 2
        if at is None or not rules.bubble[0] <= radius <= rules.bubble[1]:
            continue
        away = lambda t: math.dist(t[1], at)  # noqa: E731, B023
        tag = nearest((t for t in texts if away(t) <= 1.2 * radius + 1), away, 1.5 * radius + 2)
        if tag is None:
            continue
        around = [t for t in texts if t is not tag and away(t) <= rules.search]
        scale = nearest((t for t in around if R.tells_scale(t[0]["text_raw"])), away, rules.search)
        others = [t for t in around if t is not scale]
        title = nearest((t for t in others if len(t[0]["text_raw"].strip()) >= 10), away, rules.search) or nearest(others, away, rules.search)
        of = lambda t, name: t[0][name] if t else None
        out.append({
            "center": tuple(round(v, 1) for v in at), "radius": round(radius, 1), "tag": R.squeeze(tag[0]["text_raw"]).upper(), "tag_element": tag[0]["element_id"], "circle_element": r["element_id"],
            "title": title[0]["text_raw"].strip() if title else None, "title_element": of(title, "element_id"), "title_anchor": title and title[1], "scale": R.scale_of(of(scale, "text_raw")), "scale_element": of(scale, "element_id"),
        })
    return sorted(out, key=lambda m: m["center"])


def islands(boxes: dict[int, list[float] | None], gap: float) -> list[list[int]]:
    """Groups of boxes within gap of each other, directly or by others; a missing box stands alone."""
    parent = {i: i for i in boxes}

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    open_: list[int] = []
    for i in sorted((i for i in boxes if boxes[i]), key=lambda i: boxes[i][0]):
        open_ = [j for j in open_ if boxes[i][0] - boxes[j][2] <= gap]
        for j in open_:
            if S.bbox_gap(boxes[i], boxes[j]) <= gap:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        open_.append(i)
    out: dict[int, list[int]] = {}
    for i in boxes:
        out.setdefault(top(i), []).append(i)
    return list(out.values())


def borders(records: list[dict], rules: SheetRules) -> list[list[S.Point]]:
    """Closed polylines on frame layers that are large enough to part details."""
    out = []
    for r in records:
        pts = [(p[0], p[1]) for p in r["vertices"] or []]
        if r["type"] == "LWPOLYLINE" and r["closed"] and len(pts) >= 3 and any(k in (r["layer"] or "").upper() for k in rules.border_layers) and S.area(pts) >= rules.border_area:
            out.append(pts)
    return out


def assign(records: list[dict], found: list[dict], rules: SheetRules) -> list[list[int]]:
    """Places of each marker's records: its own texts, what its border holds, and islands of content whose middle is nearest to its title."""
    owner = {m[k]: i for i, m in enumerate(found) for k in ("circle_element", "tag_element", "title_element", "scale_element") if m[k]}
    pinned = {n: owner[r["element_id"]] for n, r in enumerate(records) if r["element_id"] in owner}
    out: list[list[int]] = [[] for _ in found]
    for n, i in pinned.items():
        out[i].append(n)
    at = [m["title_anchor"] or m["center"] for m in found]
    closest = lambda p: min(range(len(at)), key=lambda i: math.dist(p, at[i]))
    framed = [(b, closest(((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)), poly) for poly in borders(records, rules) for b in [S.bbox(poly)]]
    for island in islands({n: box(r) for n, r in enumerate(records) if n not in pinned}, rules.island_gap):
        rest = []
        for n in island:
            p = anchor(records[n])
            home = next((i for b, i, poly in framed if p and b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3] and S.inside(p, poly)), None)
            (rest if home is None else out[home]).append(n)
        if rest:
            places = [anchor(records[n]) or (0.0, 0.0) for n in rest]
            out[closest(tuple(sum(v) / len(places) for v in zip(*places, strict=True)))] += rest
    return [sorted(x) for x in out]


def segment_sheet(records: list[dict], rules: SheetRules) -> dict:
    """Regions of a sheet (tag, title, scale, bbox, members), certain; or one region SHEET with the reason why it wasn't split."""
    found = markers(records, rules)

    def around(members: list[int]) -> list[float]:
        boxes = [b for n in members if (b := box(records[n]))]
        return [round(f(b[i] for b in boxes), 1) for f, i in ((min, 0), (min, 1), (max, 2), (max, 3))] if boxes else [0.0] * 4

    def region(members: list[int], tag: str, title: str | None = None, scale: str | None = None) -> dict:
        return {"tag": tag, "title": title, "scale": scale, "bbox": around(members), "members": members, "element_ids": sorted(records[n]["element_id"] for n in members if records[n]["element_id"])}

    def whole(why: str) -> dict:
        return {"segmentation": "uncertain", "uncertain_reason": why, "markers": found, "regions": [region(list(range(len(records))), "SHEET")]}

    if not found:
        return whole("no title markers found")
    if len(found) == 1 and found[0]["title"] is None and found[0]["scale"] is None:
        return whole("single bare bubble without title/scale")
    members = assign(records, found, rules)
    for m, own in zip(found, members, strict=True):
        if len(own) < rules.least_share * len(records):
            return whole(f"marker {m['tag']} holds only {len(own)}/{len(records)} entities")
    regions = [region(own, m["tag"], m["title"], m["scale"]) for m, own in zip(found, members, strict=True)]
    if any(S.overlap_share(a["bbox"], b["bbox"]) > rules.overlap for i, a in enumerate(regions) for b in regions[i + 1 :]):
        return whole("detail regions overlap")
    return {"segmentation": "certain", "uncertain_reason": None, "markers": found, "regions": sorted(regions, key=lambda r: r["tag"])}


_PATHED = "path ARRAY<STRING>, confidence STRING, attribution_chain STRING, element_id STRING, exact_value DOUBLE, qualifier STRING, review_needed BOOLEAN"
DETAIL = (
    "drawing STRING, detail_id STRING, title STRING, detail_tag STRING, scale STRING, projection STRING, junction_type STRING, assembly STRING, context STRING, classified_by STRING, facet_nodes ARRAY<STRING>, "
    f"classifications ARRAY<STRUCT<{schemas.as_fields(_PATHED)}>>, build_up ARRAY<STRUCT<material: STRING, thickness: DOUBLE, qualifier: STRING, confidence: STRING, element_id: STRING>>, wet_area BOOLEAN, depends_on ARRAY<STRING>, "
    "delegated_to STRING, delegated_text STRING, provenance_status STRING, reusable BOOLEAN, thumbnail STRING, text_blob STRING, bbox ARRAY<DOUBLE>, segmentation STRING, uncertain_reason STRING, entity_count INT, element_ids ARRAY<STRING>"
)
CANDIDATE = (
    "drawing STRING, detail_id STRING, raw_string STRING, normalised STRING, level_guess STRING, attribute STRING, material STRING, part STRING, value DOUBLE, qualifier STRING, measure STRING, element_id STRING, reason STRING, "
    "layer STRING, hatch_pattern STRING, region_layer STRING, measured_thickness DOUBLE, attribution_chain STRING, sibling_context ARRAY<STRING>"
)


def sheet_details(records: list[dict], facts: list[dict], regions: list[dict], vocabulary: Vocabulary, reader: R.Reader, rules: SheetRules) -> tuple[list[dict], list[dict]]:
    """Details of a sheet, and what in them the vocabulary doesn't know."""
    drawing, sheet = records[0]["drawing"], segment_sheet(records, rules)
    by_element: dict[str, list[dict]] = {}
    for f in facts:
        if f["element_id"]:
            by_element.setdefault(f["element_id"], []).append(f)
    by_id = {r["element_id"]: r for r in records if r["element_id"]}
    furniture = {m[k] for m in sheet["markers"] for k in ("circle_element", "tag_element", "title_element", "scale_element") if m[k]}
    polys = [(g, [(p["x"], p["y"]) for p in g["polygon"]]) for g in regions]
    details, candidates = [], []
    for region in sheet["regions"]:
        held = [records[n] for n in region["members"]]
        detail = R.short_hash("d_", f"{drawing}::{region['tag']}", 4)
        texts = [t for r in held for t in (r["text_raw"], r["dim_override"]) if t]
        title = region["title"] or ("Typical details" if region["tag"] == "SHEET" else region["tag"])
        facets = facets_of(title, texts)
        components, nodes = vocabulary.facet_components(facets), vocabulary.facet_nodes(facets)
        paths: list[dict] = []
        unknown: list[dict] = []

        def classify(fact: dict, r: dict, text: str) -> None:
            found, open_ = vocabulary.classify(fact, components)
            paths.extend(found)
            if open_:
                keep(fact, r, text, open_)

        def keep(fact: dict, r: dict, text: str, open_: dict) -> None:
            at = anchor(r)
            g = next((g for g, poly in polys if at and len(poly) >= 3 and S.inside(at, poly)), None)
            unknown.append({
                "drawing": drawing, "detail_id": detail, "raw_string": text, "normalised": R.folded(text), **open_, **{k: fact.get(k) for k in ("material", "part", "value", "qualifier")}, "measure": fact.get("measure") or "thickness",
                "element_id": r["element_id"], "layer": r["layer"], "hatch_pattern": r["hatch_pattern"], "region_layer": g and g["layer"], "measured_thickness": g and g["thickness"], "attribution_chain": fact.get("chain"),
            })

        own = [f for i in region["element_ids"] for f in by_element.get(i, [])]
        for f in own:
            if f["material"] or f["part"] is not None or f["value"] is not None:
                r = by_id[f["element_id"]]
                f = f if f["part"] is not None else f | {"part": reader.unknown_noun(r["text_raw"])}
                classify(f, r, r["text_raw"] or r["dim_override"] or "")
        for r in held:
            text, said = (r["text_raw"] or "").strip(), r["parsed"]
            if r["type"] not in ANNOTATIONS or not text or r["element_id"] in furniture:
                continue
            fact = {"confidence": "medium", "chain": "leader", "element_id": r["element_id"], "material": None, "part": None, "value": None, "qualifier": None}
            if said is not None:
                if not said.get("material") and r["element_id"] not in by_element and said.get("part"):
                    fact |= {"part": said["part"], "qualifier": said.get("qualifier"), "measure": said.get("measure")}
                    found, open_ = vocabulary.classify(fact, components)
                    paths.extend(found)
                    if open_ and not vocabulary.ignores(text):
                        keep(fact, r, text, open_)
                continue
            if re.fullmatch(r"[\d\s.,x×:+\-°'\"]+", text) or vocabulary.ignores(text):
                continue
            node, token = vocabulary.known(text), reader.unknown_noun(text)
            level = vocabulary.nodes[node]["level"] if node in vocabulary.nodes else None
            if level == "part":
                classify(fact | {"part": node.split(".", 1)[1].replace("_", " "), "chain": "synonym"}, r, text)
            elif level == "value":
                classify(fact | {"material": node.split(".", 1)[1], "chain": "synonym"}, r, text)
            elif token:
                classify(fact | {"part": token}, r, text)
            else:
                keep({}, r, text, {"level_guess": "part", "attribute": None, "reason": "unparsed"})
        around = sorted({*nodes, *(e for c in paths for e in c["path"] if e.startswith(("component.", "part.")))})
        candidates += [u | {"sibling_context": around} for u in unknown]
        told = next((r for r in held if (r["parsed"] or {}).get("delegated_to")), None)
        stack = sorted((f for f in own if f["material"]), key=lambda f: by_id[f["element_id"]]["geom"]["x"])
        details.append({
            "drawing": drawing, "detail_id": detail, "title": title, "detail_tag": region["tag"], "scale": region["scale"], **facets, "facet_nodes": nodes, "classifications": sorted(paths, key=lambda c: (c["path"], c["element_id"] or "")),
            "build_up": [{"material": f["material"], "thickness": f["value"], "qualifier": f["qualifier"], "confidence": f["confidence"], "element_id": f["element_id"]} for f in stack], "wet_area": any("wet area" in t.lower() for t in texts),
            "depends_on": R.references(" ".join(texts)), "delegated_to": told and told["parsed"]["delegated_to"], "delegated_text": told and told["text_raw"], "provenance_status": "unknown", "reusable": True, "thumbnail": None,
            "text_blob": "\n".join(texts), "bbox": region["bbox"], "segmentation": sheet["segmentation"], "uncertain_reason": sheet["uncertain_reason"], "entity_count": len(held), "element_ids": region["element_ids"],
        })
    return sorted(details, key=lambda d: d["detail_tag"]), sorted(candidates, key=lambda c: (c["detail_id"], c["normalised"], c["element_id"] or ""))


def _order(r: dict) -> tuple:
    return r["layer"] or "", r["type"] or "", r["geom"]["x"], r["geom"]["y"], r["text_raw"] or "", r["element_id"] or ""


def segment(state: DataFrame, rules: SheetRules | None = None) -> DataFrame:
    """(drawing, segmentation, uncertain_reason, tag, title, scale, bbox, element_ids) of every detail region."""
    rules = rules or SheetRules()

    def sheet(rows: list[dict]):
        found = segment_sheet(sorted(rows, key=_order), rules)
        return [r | {k: found[k] for k in ("segmentation", "uncertain_reason")} | {"drawing": rows[0]["drawing"]} for r in found["regions"]]

    return per_group(state, ["drawing"], sheet, "drawing STRING, segmentation STRING, uncertain_reason STRING, tag STRING, title STRING, scale STRING, bbox ARRAY<DOUBLE>, element_ids ARRAY<STRING>")


def details(state: DataFrame, facts: DataFrame, analysed: DataFrame, vocabulary: Vocabulary, rules: SheetRules | None = None, words: Words | None = None) -> DataFrame:
    """(drawing, details, candidates): a row per drawing; facts and analysed as operators/attribution.py gives them."""
    rules, reader = rules or SheetRules(), R.Reader(words)
    known = facts.groupBy("drawing").agg(F.array_sort(F.collect_list(F.struct("element_id", "material", "part", "value", "qualifier", "measure", "confidence", "chain"))).alias("facts"))
    right = analysed.select("drawing", "regions").join(known, "drawing", "left")

    def sheet(left: list[dict], right: list[dict]):
        if not left:
            return []
        of = right[0] if right else {"facts": [], "regions": []}
        made, open_ = sheet_details(sorted(left, key=_order), of["facts"] or [], of["regions"] or [], vocabulary, reader, rules)
        return [{"drawing": left[0]["drawing"], "details": made, "candidates": open_}]

    return per_pair(state, right, ["drawing"], sheet, f"drawing STRING, details ARRAY<STRUCT<{schemas.as_fields(DETAIL)}>>, candidates ARRAY<STRUCT<{schemas.as_fields(CANDIDATE)}>>")


def flatten(sheets: DataFrame, name: str = "details") -> DataFrame:
    """A row for each detail (or candidate) of details()."""
    return sheets.select(F.explode(name).alias("d")).select("d.*")


def committed_first(committed: DataFrame, live: DataFrame) -> DataFrame:
    """Committed details where a drawing has them at a commit, else what was found live; both keyed (drawing, commit_seq)."""
    key = ["drawing", "commit_seq"]
    return committed.unionByName(live.join(committed.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)
