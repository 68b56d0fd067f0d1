"""Kernels of one sheet: annotations, identity, binding, segmentation, classification."""

import pytest
from pyspark.sql import functions as F

from plansheet import schemas
from plansheet.config import ShapeRules, SheetRules, TextRules
from plansheet.functions import reading as R
from plansheet.operators import attribution as A
from plansheet.operators import identity as I
from plansheet.operators import reassembly as T
from plansheet.operators import segmentation as G
from plansheet.operators import shapes as S
from plansheet.vocabulary import Vocabulary, VocabularyError

EMPTY = dict.fromkeys("drawing element_id dxf_handle handles type layer geom text_raw parsed hatch_pattern hatch_scale hatch_area dim_measurement dim_override dim_defpoints dim_style fingerprint height rotation vertices length linetype closed insert_x insert_y source leader_endpoint leader_id source_lines reassembly".split())
READER = R.Reader()


def row(n, type_, layer="A-ANNO", box=(0, 0, 0, 0), **more):
    box = [float(v) for v in box]
    geom = {"x": (box[0] + box[2]) / 2, "y": (box[1] + box[3]) / 2, "bbox": box}
    out = EMPTY | {"drawing": "S1", "element_id": f"e{n:02d}", "dxf_handle": f"H{n:02X}", "type": type_, "layer": layer, "geom": geom} | more
    return out | {"fingerprint": R.fingerprint(type_, layer, geom["x"], geom["y"], box, out["text_raw"], out["hatch_pattern"], out["dim_measurement"], out["dim_override"])}


def text(n, said, x, y, h=2.5, w=None, **more):
    return row(n, "TEXT", box=(x, y - 1.2, x + (w or max(8.0, 1.4 * len(said))), y + 1.2), text_raw=said, height=h, rotation=more.pop("rotation", 0.0), insert_x=float(x), insert_y=float(y), **more)


def line(n, a, b, layer="A-ANNO", **more):
    return row(n, "LINE", layer, (min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])), vertices=[list(map(float, a)), list(map(float, b))], **more)


def loop(n, x0, y0, x1, y1, layer, type_="LWPOLYLINE", **more):
    return row(n, type_, layer, (x0, y0, x1, y1), vertices=[[float(x), float(y)] for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))], closed=True if type_ == "LWPOLYLINE" else None, **more)


def stack(*said, **more):
    return [text(i, t, 40, 60 - 5 * i, **more) for i, t in enumerate(said)]


def notes(rows):
    return [r for r in T.reassemble_sheet(rows, TextRules(), READER) if r["type"] == "ANNOTATION"]


# --- annotations


def test_a_leader_joins_lines():
    (a,) = notes([*stack("NOM. 50MM SLAB", "SETDOWN"), line(9, (38, 58), (100, 55))])
    assert (a["text_raw"], a["reassembly"]["signal"], a["leader_endpoint"]) == ("NOM. 50MM SLAB SETDOWN", "leader", [100.0, 55.0])
    assert a["parsed"]["measure"] == "setdown" and a["handles"] == ["H00", "H01"] and [x["text"] for x in a["source_lines"]] == ["NOM. 50MM SLAB", "SETDOWN"]


def test_two_leaders_share_five_lines():
    found = notes([*stack("TYPICAL WET AREA WALL", "TILE ON SUBSTRATE", "NOM. 10MM FLUSH JOINTED", "PLASTERBOARD TO INTERNAL", "TIMBER FRAMED WALLS"), line(8, (38, 59), (90, 40)), line(9, (38, 49), (110, 30))])
    assert len(found) == 2 and "WET AREA" in found[0]["text_raw"] + found[1]["text_raw"] and sum(len(a["handles"]) for a in found) == 5


def test_orphans_join_without_a_leader():
    (a,) = notes(stack("CONCRETE SLAB REFER ENG.", "DWGS FOR DETAILS"))
    assert a["text_raw"] == "CONCRETE SLAB REFER ENG. DWGS FOR DETAILS" and a["reassembly"]["signal"] == "contiguity+parse"


def test_height_rotation_and_layer_keep_lines_apart():
    a, b = stack("NOTE TEXT", "HEADING TEXT")
    assert len(notes([a, b | {"height": 6.0}])) == len(notes([a, b | {"rotation": 90.0}])) == len(notes([a, b | {"layer": "B-ANNO"}])) == 2


def test_centred_titles_join():
    a, b = text(0, "TYPICAL ARCHITRAVE", 40, 60, w=34), text(1, "DETAILS AR 1", 48, 55, w=18)
    assert [x["text_raw"] for x in notes([a, b])] == ["TYPICAL ARCHITRAVE DETAILS AR 1"]
    assert T.alignment([r | {"bbox": r["geom"]["bbox"]} for r in (a, b)]) == 2


def test_whole_readings_stay_apart_unless_adjudicated():
    rows = stack("10MM PLYWOOD", "6MM GLASS", "20MM CONCRETE")
    assert [a["reassembly"]["confidence"] for a in notes(rows)] == ["medium"] * 3
    asked = lambda parts: [a["text_raw"] for a in T.reassemble_sheet(rows, TextRules(), READER, lambda texts: parts) if a["type"] == "ANNOTATION"]
    assert sorted(asked([[0, 1], [2]])) == ["10MM PLYWOOD 6MM GLASS", "20MM CONCRETE"]
    assert len(asked([[0, 1]])) == 3  # no partition


def test_multi_line_texts_are_whole():
    (a,) = notes([row(1, "MTEXT", box=(0, 0, 20, 5), text_raw="12MM\\PPLYWOOD", height=2.5, rotation=0.0), line(2, (21, 2), (60, 2))])
    assert (a["text_raw"], a["parsed"]["value"], a["leader_endpoint"], a["reassembly"]["signal"]) == ("12MM PLYWOOD", 12.0, [60.0, 2.0], "mtext")


def test_pair_gate_as_an_expression(spark):
    rows = [(a["layer"], a["rotation"], a["height"], a["geom"]["bbox"]) for a in stack("NOTE", "OTHER")] + [("A-ANNO", 0.0, 6.0, [40.0, 53.8, 60.0, 56.2]), ("A-ANNO", 0.0, 2.5, [40.0, 30.0, 60.0, 32.0])]
    one = "struct<layer:string,rotation:double,height:double,bbox:array<double>>"
    pairs = [(rows[0], b) for b in rows[1:]]
    got = [r[0] for r in spark.createDataFrame(pairs, f"a {one}, b {one}").select(T.mergeable_pair(F.col("a"), F.col("b"))).collect()]
    keyed = lambda r: dict(zip(("layer", "rotation", "height", "bbox"), r, strict=True))
    assert got == [T.mergeable([keyed(rows[0])], keyed(b), TextRules()) for b in rows[1:]] == [True, False, False]


def test_spans_become_lines(spark):
    span = lambda t, x0, x1, y0=10.0, size=10.0: {"text": t, "x0": x0, "y0": y0, "x1": x1, "y1": y0 + size, "size": size, "rotation": 0}
    got = T.span_lines([span("12", 0.0, 10.0), span("MM", 10.5, 20.0), span("PLY", 25.6, 40.0), span("far", 90.0, 99.0), span("big", 41.0, 60.0, size=20.0), span("up", 0.0, 9.0, 40.0), span("  ", 99.0, 101.0), span("end", 101.0, 110.0)])
    assert [x["text"] for x in got] == ["up", "big", "12MM PLY", "far end"]
    rows = [("d", 1, i, *[s[k] for k in ("text", "x0", "y0", "x1", "y1", "size", "rotation")]) for i, s in enumerate([span("12MM", 0.0, 40.0), span("PLYWOOD", 45.1, 90.0)])]
    spans = spark.createDataFrame(rows, "drawing string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, size double, rotation int")
    paths = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 72.0, 0.0)], "drawing string, page int, seq int, x0 double, y0 double, x1 double, y1 double")
    state = {r.type: r for r in T.page_state(spans, paths).collect()}
    assert state["ANNOTATION"].text_raw == "12MM PLYWOOD" and state["ANNOTATION"].parsed.material == "plywood" and state["PDFPATH"].length == 25.4


# --- identity


def frame(spark, rows, extra=""):
    keep = [f.name for f in schemas.struct(schemas.STATE)]
    return spark.createDataFrame([tuple(r[k] for k in keep) for r in rows], schemas.struct(schemas.STATE))


def matched(spark, now, before, tombstones=None):
    found = I.resolve(frame(spark, now).drop("element_id"), frame(spark, before), tombstones and frame(spark, tombstones))
    return {r.dxf_handle: (r.element_id if r.match_tier != "new" else None, r.match_tier, r.status) for r in found.collect()}


def test_tiers(spark):
    before = [text(1, "10 PLY", 0, 0), line(2, (50, 0), (52, 0)), text(3, "gone", 90, 90), row(4, "ANNOTATION", box=(0, 200, 9, 202), text_raw="A B", dxf_handle="X1|X2", handles=["X1", "X2"])]
    now = [
        text(21, "10 PLY", 0, 0), line(22, (53, 0), (55, 0)), text(23, "all new here", 500, 0), row(24, "ANNOTATION", box=(0, 200, 9, 202), text_raw="A C", dxf_handle="X2|X3", handles=["X2", "X3"]),
    ]
    got = matched(spark, now, before, [text(5, "back", 700, 700)])
    assert got["H15"] == ("e01", "fingerprint", "unchanged") and got["H16"] == ("e02", "fuzzy", "moved")
    assert got["H17"] == (None, "new", "new") and got["X2|X3"] == ("e04", "handle", "value_changed")
    back = matched(spark, [text(30, "back", 700, 700)], [], [text(5, "back", 700, 700)])
    assert back["H1E"] == ("e05", "fingerprint", "unchanged")


def test_a_whole_sheet_that_moved_is_unchanged(spark):
    before = [text(i, f"note {i}", 100 * i, 0) for i in range(1, 6)]
    now = [text(i, f"note {i}", 100 * i + 1000, 7) for i in range(1, 6)] + [text(9, "note 9", 1050, 80)]
    got = matched(spark, now, before)
    assert {got[f"H{i:02X}"] for i in range(1, 6)} == {(f"e{i:02d}", "handle", "unchanged") for i in range(1, 6)} and got["H09"][1] == "new"


def test_a_used_handle_always_matches_and_each_id_once(spark):
    before = [text(1, "old", 0, 0)]
    got = matched(spark, [text(1, "entirely different", -900, 900), text(2, "old", 0, 0)], before)  # taken in order of place
    assert got["H01"] == ("e01", "handle", "moved+value_changed") and got["H02"][1] == "new"


def test_identity_map_only_grows(spark):
    before, now = frame(spark, [text(1, "a", 0, 0), text(2, "b", 50, 50)]), [text(1, "a", 0, 0)]
    found = I.resolve(frame(spark, now).drop("element_id"), before)
    known = I.identity_map(found, before)
    assert {(r.element_id, r.deleted) for r in known.collect()} == {("e01", False), ("e02", True)}
    assert [r.element_id for r in I.tombstones(known).collect()] == ["e02"]


# --- binding


def wall(width=10.0, hatch=None, **more):
    out = [loop(1, 100, 0, 100 + width, 100, "A-DETL-PLASTER"), line(2, (100, 0), (100, -10)), line(3, (100 + width, 0), (100 + width, -10))]
    return out + ([loop(4, 100, 0, 100 + width, 100, "A-DETL-PLASTER", "HATCH", hatch_pattern=hatch)] if hatch else [])


def dimension(n, said, a, b, base=(0, -8)):
    return row(n, "DIMENSION", dim_override=said, dim_measurement=float(abs(b[0] - a[0])), dim_defpoints=[list(map(float, p)) for p in (base, a, b)])


def evidence(rows):
    return A.analyse_sheet(rows, READER, ShapeRules())


def test_a_dimension_binds_to_the_region_it_measures():
    found = evidence([*wall(), dimension(5, "10", (100, 0), (110, 0))])
    (bound,) = [e for e in found["evidence"] if e["chain"] == "dimension"]
    assert (bound["material"], bound["value"], bound["confidence"], bound["region_id"]) == ("plasterboard", 10.0, "medium", "r_00")
    assert found["scale_factor"] == 1.0 and not found["scale_conflict"] and not found["unattributed"]


def test_drifted_points_are_traced_by_extension_lines():
    drifted = dimension(5, "10", (105, 5), (115, 5))
    found = evidence([*wall(hatch="PLASTER"), drifted])
    (bound,) = [e for e in found["evidence"] if e["chain"] == "extension_trace"]
    assert (bound["confidence"], bound["material"], bound["value"]) == ("high", "plasterboard", 10.0) and not found["dim_review"]
    wrong = evidence([*wall(14.0), dimension(5, "10", (105, 5), (115, 5))])
    assert not [e for e in wrong["evidence"] if e["chain"] == "extension_trace"] and wrong["dim_review"][0]["status"] == "pending"


def test_exploded_dimensions_are_found():
    found = evidence([*wall(), line(6, (100, -8), (110, -8)), text(7, "10", 103, -6, w=3)])
    assert [e["value"] for e in found["evidence"] if e["chain"] == "extension_trace"] == [10.0]


def test_a_floating_dimension_stays_open_and_a_chosen_region_is_low():
    floating = dimension(5, "20", (300, 300), (320, 300))
    found = evidence([floating])
    assert [u["reason"] for u in found["unattributed"]] == ["defpoints snap to no drawn geometry"] and not found["evidence"]
    rows = [*wall(10.0), dimension(5, "10", (115, 20), (125, 20))]
    chosen = A.analyse_sheet(rows, READER, ShapeRules(), lambda c: [g["region_id"] for g in c["regions"]])
    (seen,) = [e for e in chosen["evidence"] if e["chain"] == "vision"]
    assert (seen["confidence"], seen["review_needed"], seen["dim_uid"]) == ("low", True, chosen["dim_review"][0]["uid"])


def test_leaders_bind_values_and_conflicts():
    at = lambda n, said, end: row(n, "ANNOTATION", box=(0, 0, 9, 2), text_raw=said, parsed=READER.read(said), leader_endpoint=end)
    found = {e["element_id"]: e for e in evidence([*wall(), at(11, "10MM PLASTERBOARD", [105.0, 50.0]), at(12, "30MM PLASTERBOARD", [105.0, 50.0]), at(13, "PLASTERBOARD", [105.0, 50.0]), at(14, "10MM TILE", None), at(15, "50MM SETDOWN", None)])["evidence"] if e["chain"].startswith("leader")}
    pick = lambda k: tuple(found[k][c] for c in ("value", "confidence", "chain", "conflict"))
    assert pick("e11") == (10.0, "high", "leader+geometry", False) and pick("e12") == (30.0, "low", "leader+geometry", True)
    assert pick("e13") == (10.0, "medium", "leader+geometry", False) and pick("e14") == (10.0, "high", "leader", False) and found["e15"]["measure"] == "setdown"


def test_chains_reconcile(spark):
    rows = [*wall(hatch="PLASTER"), dimension(5, "10", (100, 0), (110, 0)), row(6, "ANNOTATION", box=(0, 0, 9, 2), text_raw="NOM. 10MM PLASTERBOARD", parsed=READER.read("NOM. 10MM PLASTERBOARD"), leader_endpoint=[105.0, 50.0])]
    (fact,) = A.facts(A.analyse(frame(spark, rows))).collect()
    assert (fact.material, fact.value, fact.confidence, fact.chain, fact.qualifier, fact.conflict, fact.element_id) == ("plasterboard", 10.0, "high", "leader+geometry+dimension+geometry", "nominal", False, "e06")


def test_assemblies_and_scale():
    rows = [loop(1, 0, 0, 10, 50, "A-PLASTER"), loop(2, 10, 0, 30, 50, "A-PLY"), dimension(3, "60", (0, 25), (30, 25))]
    found = evidence(rows)
    assert found["scale_factor"] == 2.0 and found["assemblies"][0]["regions"] == ["r_00", "r_01"] and found["assemblies"][0]["value"] == 120.0
    assert S.loops([((0.0, 0.0), (9.0, 0.0)), ((0.0, 9.0), (0.0, 0.2)), ((9.0, 0.0), (0.0, 9.0))], 1.0) and not S.loops([((0.0, 0.0), (9.0, 0.0)), ((9.0, 5.0), (0.0, 9.0))], 1.0)


# --- details

NODES = [
    {"id": "component.door", "level": "component", "label": "Door", "definition": "d"}, {"id": "component.wall", "level": "component", "label": "External Wall", "definition": "d"},
    {"id": "part.jamb", "level": "part", "label": "Jamb", "definition": "d", "parents": ["component.door"]}, {"id": "part.lining", "level": "part", "label": "Lining", "definition": "d", "parents": ["component.wall"]},
    {"id": "part.sill", "level": "part", "label": "Sill", "synonyms": ["cill"], "definition": "the bottom member", "parents": ["component.wall", "component.door"]},
    {"id": "attr.material", "level": "attribute", "label": "Material", "definition": "d"}, {"id": "attr.thickness", "level": "attribute", "label": "Thickness", "definition": "d"},
    {"id": "value.quirk", "level": "value", "label": "Quirk", "parents": ["attr.material"]}, {"id": "value.plasterboard", "level": "value", "label": "Plasterboard", "parents": ["attr.material"]},
]


def vocabulary():
    return Vocabulary(NODES, {"part.cill": "part.sill"}, ["refer"])


def sheet():
    """Two details side by side, each with a bubble, a title and a scale."""
    out = []
    for k, (x, tag) in enumerate(((155, "AR 1"), (455, "AR 2"))):
        n = 20 * k
        out += [row(n + 1, "CIRCLE", box=(x - 8, 122, x + 8, 138), vertices=[[float(x), 130.0]], length=50.3), text(n + 2, tag, x, 130), text(n + 3, f"TYPICAL DOOR JAMB — {tag}", x - 30, 145), text(n + 4, "Scale: 1:5", x - 30, 118), loop(n + 5, x - 50, 0, x - 40, 100, "A-PLASTER")]
        said = "10MM QUIRK JAMB" if k == 0 else "FLANGE BRACKETS"
        out += [row(n + 6, "ANNOTATION", box=(x - 90, 79, x - 60, 81), text_raw=said, parsed=READER.read(said), insert_x=x - 90.0, insert_y=80.0, leader_endpoint=[x - 45.0, 80.0]), line(n + 7, (x - 60, 80), (x - 45, 80)), line(n + 8, (x - 40, 100), (x, 122))]
    return [r | {"text_raw": "REFER A.109 WET AREA"} if r["element_id"] == "e08" else r for r in out]


def test_a_sheet_splits_at_its_bubbles():
    found = G.segment_sheet(sheet(), SheetRules())
    assert found["segmentation"] == "certain" and [(r["tag"], r["scale"]) for r in found["regions"]] == [("AR 1", "1:5"), ("AR 2", "1:5")]
    assert [len(r["members"]) for r in found["regions"]] == [8, 8] and found["regions"][0]["bbox"][2] <= found["regions"][1]["bbox"][0]
    assert found["regions"][0]["title"] == "TYPICAL DOOR JAMB — AR 1"


def test_uncertain_sheets_stay_whole():
    bare = [row(1, "CIRCLE", box=(-8, -8, 8, 8), vertices=[[0.0, 0.0]], length=50.3), text(2, "G1", 0, 0), line(3, (-500, -500), (500, 500))]
    assert (found := G.segment_sheet(bare, SheetRules()))["segmentation"] == "uncertain" and found["regions"][0]["tag"] == "SHEET"
    assert G.segment_sheet([line(1, (0, 0), (1, 1))], SheetRules())["uncertain_reason"] == "no title markers found"
    few = [*sheet(), *(line(100 + i, (-1000, i), (-900, i)) for i in range(400))]
    assert "entities" in G.segment_sheet(few, SheetRules())["uncertain_reason"]


def test_details_are_classified(spark):
    state = frame(spark, sheet())
    analysed = A.analyse(state)
    made = G.details(state, A.facts(analysed), analysed, vocabulary())
    one, two = sorted(G.flatten(made).collect(), key=lambda d: d.detail_tag)
    assert (one.junction_type, one.assembly, one.scale, one.classified_by, one.facet_nodes) == ("door_jamb", "door", "1:5", "auto", ["component.door", "part.jamb"])
    assert ["component.door", "part.jamb", "attr.material", "value.quirk"] in [c.path for c in one.classifications]
    assert one.wet_area and one.depends_on == ["A.109"] and not two.wet_area and one.detail_id == R.short_hash("d_", "S1::AR 1", 4)
    open_ = {c.raw_string: c for c in G.flatten(made, "candidates").collect()}
    assert open_["FLANGE BRACKETS"].reason == "unknown-part:brackets" and open_["FLANGE BRACKETS"].detail_id == two.detail_id and "REFER A.109 WET AREA" not in open_
    again = G.details(state, A.facts(analysed), analysed, vocabulary()).collect()
    assert again == made.collect()


def test_classification_paths():
    v = vocabulary()
    fact = lambda **k: {"material": None, "part": None, "value": None, "element_id": "e"} | k
    paths = lambda f, comps: [c["path"] for c in v.classify(f, comps)[0]]
    assert paths(fact(material="quirk", part="jamb", value=10.0), ["component.door"]) == [["component.door", "part.jamb", "attr.material", "value.quirk"], ["component.door", "part.jamb", "attr.thickness", "value.10mm"]]
    assert paths(fact(material="plasterboard", part="lining"), ["component.door"]) == [["part.lining", "attr.material", "value.plasterboard"]]  # no ancestor of a lining
    assert paths(fact(material="plasterboard"), ["component.door"])[0][0] == "component.door"
    assert paths(fact(part="lining", value=3.0), []) == [["part.lining"]] and paths(fact(value=6.38, measure="setdown"), []) == [["attr.setdown", "value.6.38mm"]]
    assert v.classify(fact(part="flange"), [])[1]["reason"] == "unknown-part:flange" and v.classify(fact(material="mud"), [])[1]["attribute"] == "attr.material"
    assert v.classify(fact(part="wall"), [])[1]["reason"] == "unresolvable" and v.is_component_word("wall") and not v.is_component_word("external wall")
    assert v.part("cill") == "part.sill" and v.known("CILL ") == "part.sill" and v.ignores("Refer to sheet 2")


def test_vocabulary_search_and_upkeep():
    v = vocabulary()
    assert [n["id"] for n, _ in v.search("cill")][:1] == ["part.sill"] and v.search("bottom member")[0] == (v.nodes["part.sill"], 0.5) and v.node_for("cill") == "part.sill"
    assert v.paths("part.sill") == [["component.wall", "part.sill"], ["component.door", "part.sill"]] and v.problems() == []
    assert v.duplicates("Sills")[0][0]["id"] == "part.sill" and v.duplicates("Completely other") == []
    assert v.suggest("jambs", ["component.door"])[0] == ("part.jamb", 1.0)
    with pytest.raises(VocabularyError, match="definition"):
        v.with_node({"id": "part.new", "level": "part", "label": "New", "parents": ["component.door"]})
    bad = Vocabulary([{"id": "part.a", "level": "part", "label": "A", "definition": "d", "parents": ["part.b"]}, {"id": "part.b", "level": "part", "label": "B", "definition": "d", "parents": ["part.a"]}])
    assert bad.cycles() == [["part.a", "part.b", "part.a"]]
    m = v.merged("part.lining", "part.sill")
    assert m.resolve("part.lining") == "part.sill" and "Lining" in m.nodes["part.sill"]["synonyms"] and [x for x, _ in v.tree("component.door")] == [["component.door"], ["component.door", "part.jamb"], ["component.door", "part.sill"]]


def test_confirmed_facets_replace_the_components():
    v = vocabulary()
    record = {"classifications": [{"path": ["component.door", "part.sill", "attr.material", "value.quirk"], "element_id": "e"}]}
    out = v.refacet(record, {"assembly": "external_wall", "context": "exterior"})
    assert out["classifications"][0]["path"] == ["part.sill", "attr.material", "value.quirk"] and out["classified_by"] == "human"  # component.external_wall isn't in this vocabulary
    with pytest.raises(ValueError, match="context"):
        v.refacet(record, {"context": "sideways"})
