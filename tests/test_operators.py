import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plansheet.functions import geometry as G
from plansheet.functions import reading as R
from plansheet.functions import text as X
from plansheet.operators import history as H
from plansheet.operators import review as Q
from plansheet.operators import search as S
from plansheet.operators import vocabulary as V
from plansheet.plans.catalog import QUERIES, SQL
from plansheet.sources import drawings, files

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    want = duck.execute(SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(map(plain, r)) for r in want.fetchall()) == sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def state(spark, rows):
    return spark.createDataFrame(rows, "drawing string, element_id string, commit_seq int, value double")


def changed(now, before):
    return ~now["value"].eqNullSafe(before["value"])


def test_revision_of_a_value(spark):
    s = state(spark, [("a", "e1", 1, 3.0), ("a", "e2", 1, 5.0), ("a", "e1", 2, 2.0), ("b", "x", 2, 1.0), ("a", "e2", 3, 5.0)])
    got = {(r.drawing, r.element_id, r.commit_seq): r.status for r in H.with_status(s, changed).collect()}
    assert got == {("a", "e1", 1): "new", ("a", "e2", 1): "new", ("a", "e1", 2): "value_changed", ("a", "e2", 2): "deleted", ("a", "e1", 3): "deleted", ("a", "e2", 3): "new", ("b", "x", 2): "new", ("b", "x", 3): "deleted"}
    assert {(r.drawing, r.element_id) for r in H.current(s).collect()} == {("a", "e2"), ("b", "x")}
    diff = {(r.element_id, r.change, r.before, r.after) for r in H.changed_between(s, 1, 2).collect()}
    assert diff == {("e1", "changed", 3.0, 2.0), ("e2", "deleted", 5.0, None), ("x", "added", None, 1.0)}
    assert state(spark, []).transform(lambda d: H.with_status(d, changed)).collect() == []


def test_stacked_search_needs_every_chip(spark):
    f = spark.createDataFrame([("mixed", 1, "glass", 6.0, "high"), ("mixed", 2, "plywood", 12.0, "medium"), ("glass", 1, "glass", 6.0, "high"), ("low", 1, "glass", 6.0, "low"), ("low", 2, "plywood", 12.0, "low")], "drawing string, element_id int, material string, value double, confidence string")
    assert [r.drawing for r in S.stacked(f, [("material", "Glass"), ("material", "plywood")]).collect()] == ["mixed"]
    assert S.stacked(f, [("value", "no number")]).collect() == [] and S.parse_chip("material:glass") == ("material", "glass") and S.parse_chip("a:b") == ("text", "a:b")


def test_setdown_values_are_found_only_when_asked_for(spark):
    f = spark.createDataFrame([("d", 1, "concrete", 50.0, "high", "setdown")], "drawing string, element_id int, material string, value double, confidence string, measure string")
    assert f.filter(S.fact_condition(value=50.0)).count() == 0 and f.filter(S.fact_condition(value=50.0, measure="setdown")).count() == 1


READINGS = [
    ("2mm GLASS", {"material": "glass", "value": 2}),
    ("GLASS 2mm", {"material": "glass", "value": 2}),
    ("12 THK PLYWOOD", {"material": "plywood", "value": 12}),
    ("6.38 LAMINATED", {"material": "glass", "value": 6.38, "qualifier": "laminated"}),
    ("75x50 SHS", {"material": "steel", "profile": "SHS", "dims": [75, 50]}),
    ("R2.5 BATT INSUL", {"material": "insulation", "r_value": 2.5}),
    ("2mm TOUGHENED GLASS", {"material": "glass", "value": 2, "qualifier": "toughened"}),
    ("INTERNAL TIMBER LINING", {"material": "timber", "part": "lining"}),
    ("SELECTED TIMBER DECKING", {"material": "timber", "part": "decking"}),
    ("TYPICAL TIMBER ENTRY DOOR", {"material": "timber", "part": "entry", "qualifier": "typical"}),
    ("ENTRY MAT", {"part": "entry"}),
    ("WALLS: T1", {"part": "wall"}),
    ("XYZ FOOBAR ???", None),
    ("SUBSTRATE", None),
    ("  ", None),
    ("", None),
    (None, None),
    ("R2.5 INSULATION 90MM", {"material": "insulation", "r_value": 2.5, "part": "insulation"}),
    ("2M LONG 12MM PLYWOOD", {"material": "plywood", "value": 12}),
    ("1.2 CM GLASS", {"material": "glass", "value": 12}),
    ("1,200MM GLASS", {"material": "glass", "value": 200}),
    ("NOM. 50MM SLAB SETDOWN", {"measure": "setdown", "value": 50, "qualifier": "nominal", "part": "slab"}),
    ("FALL 1:100", {"measure": "fall"}),
    ("CONCRETE FALL 1:80 20MM", {"material": "concrete", "measure": "fall"}),
    ("CONCRETE SLAB REFER ENG. DWGS FOR DETAILS", {"material": "concrete", "part": "slab", "delegated_to": "engineering"}),
    ("REFER STRUCTURAL DRAWINGS", {"bare_to": "structural"}),
    ("WALLTYPE VARIES", {"qualifier": "varies"}),
    ("MAX. SOMETHING", None),
    ("90X45 shs low-e TYP.", {"material": "steel", "profile": "SHS", "dims": [90, 45], "qualifier": "typical"}),
    ("GYPROCK 13", {"material": "plasterboard", "value": 13}),
]


def clean(d):
    return None if d is None else {("bare_to" if k == "to" else k): v for k, v in d.items() if v is not None and k != "unit"}


def test_readings_as_expressions_and_in_python(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(READINGS)], "i int, t string").select("i", X.parse(F.col("t")).alias("p"), X.completeness(X.parse(F.col("t"))).alias("s")).collect()
    reader = R.Reader()
    for r in rows:
        text, want = READINGS[r.i]
        assert clean(r.p and r.p.asDict()) == want == clean(reader.read(text)), text
        assert r.s == reader.score(text or "")[0], text


@given(st.lists(st.sampled_from("GLASS ply 12 2.5MM 3 cm THK 45x90 shs SETDOWN FALL 1:100 NOM. TBC varies REFER ENG. HYDRAULIC WALLS slab insul R2.5 R3 , x é".split()), max_size=7))
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_expressions_read_like_python(spark, words):
    text = " ".join(words)
    got = spark.range(1).select(X.parse(F.lit(text)).alias("p")).first().p
    assert clean(got and got.asDict()) == clean(R.Reader().read(text))


def test_text_functions(spark):
    row = spark.createDataFrame([("A\\PB\\pC %%d {\\fArial;x} \\S1^2;", "Item  No-4.b")], "m string, n string").select(X.unescape_mtext(F.col("m")).alias("m"), X.normalise(F.col("n")).alias("n"), X.slug(F.col("n")).alias("s")).first()
    assert (row.m, row.n, row.s) == ("A B C ° x 1/2", "item no 4 b", "item_no_4_b") and R.plain_mtext("A\\PB\\pC %%d {\\fArial;x} \\S1^2;") == row.m
    assert R.references("REFER. A.109 + A.110 AND a.109") == ["A.109", "A.110"]
    assert (R.scale_of("Scale 1 : 5"), R.scale_of("nts"), R.scale_of("x"), R.tells_scale("SCALE")) == ("1:5", "NTS", None, True)
    assert R.ignored(" Refer  to X", ["refer"]) and R.ignored("", []) and not R.ignored("preferred", ["refer"]) and R.ignored("A-12", [], [r"^a-\d+$"])
    assert R.Reader().unknown_noun("FLANGE 5MM ALUMINIUM BRACKETS") == "brackets" and R.similarity("", "") == 0.0 and R.similarity("Coping ", "coping") == 1.0


def test_geometry(spark):
    df = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D), named_struct('x', 0D, 'y', 3D)) p, 1D x, 1D y")
    r = df.select(G.area(F.col("p")).alias("a"), G.contains(F.col("p"), F.col("x"), F.col("y")).alias("i"), G.contains(F.col("p"), F.lit(9.0), F.col("y")).alias("o"), G.boundary_distance(F.col("p"), F.col("x"), F.col("y")).alias("d"), G.angle_difference(F.lit(179.0), F.lit(2.0)).alias("g"), G.bbox_gap(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.array(*map(F.lit, (4.0, 5.0, 6.0, 6.0)))).alias("b"), G.hamming(F.lit(5), F.lit(6)).alias("h")).first()
    assert (r.a, r.i, r.o, r.d, r.g, r.b, r.h) == (12.0, True, False, 1.0, 3.0, 5.0, 2)


def test_vocabulary(spark):
    e = spark.createDataFrame([("root", "wall"), ("root", "roof"), ("wall", "panel"), ("roof", "panel"), ("panel", "glass")], "parent string, child string")
    assert {(r.ancestor) for r in V.closure(e).filter("node = 'glass'").collect()} == {"root", "wall", "roof", "panel", "glass"}
    assert sorted("/".join(r.path) for r in V.paths(e).filter("node = 'glass'").collect()) == ["root/roof/panel/glass", "root/wall/panel/glass"]
    assert V.cycles(e).collect() == [] and {r.node for r in V.cycles(e.unionByName(e.limit(0)).union(spark.createDataFrame([("glass", "wall")], e.schema))).collect()} == {"wall", "panel", "glass"}
    a = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)], "alias string, target string")
    assert {r.target for r in V.resolve_aliases(a).collect()} == {"n7"}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "parent string, child string")
    assert V.closure(chain).count() == 28 and max(len(r.path) for r in V.paths(chain).collect()) == 7  # a chain of seven
    assert {r.node for r in V.descendants(chain, spark.createDataFrame([("n4",)], "s string")).collect()} == {"n4", "n5", "n6"}
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "d")], "alias string, target string")
    assert {r.alias: r.target for r in V.resolve_aliases(loop).collect()} == {"a": "a", "b": "b", "c": "a", "d": "d"}


def test_review_log_replays(spark):
    log = spark.createDataFrame([(1, 1, "a", "assign", None), (2, 2, "a", "ignore", None), (3, 3, None, "undo", 2), (4, 4, "b", "ignore", None), (5, 5, None, "undo", 4)], "rid int, event_seq int, uid string, action string, reverts int")
    assert {(r.uid, r.status) for r in Q.effective_status(log).collect()} == {("a", "assign")}
    log = spark.createDataFrame([("1", 1, ["a"], "assign", None), ("2", 2, ["a"], "undo", "1"), ("3", 3, ["a"], "undo", "2")], "rid string, event_seq long, uids array<string>, action string, reverts string")
    assert [(r.uid, r.status) for r in Q.statuses(log).collect()] == [("a", "resolved")]  # an undone undo


def test_drawing_files(spark, tmp_path):
    dxf = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1032\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nLINE\n5\nA1\n8\nWALL\n10\n1.04\n20\n2\n11\n3\n21\n4\n0\nTEXT\n5\nB2\n8\nNOTE\n10\n5\n20\n6\n40\n2\n1\n12MM PLY\n0\nIMAGE\n5\nC3\n0\nCIRCLE\n5\nD4\n8\nNOTE\n10\n9\n20\n9\n40\n2\n0\nLWPOLYLINE\n5\nE5\n8\nWALL\n70\n1\n10\n0\n20\n0\n10\n4\n20\n0\n10\n4\n20\n3\n0\nPOLYLINE\n5\nF6\n8\nZ\n10\n0\n20\n0\n0\nVERTEX\n10\n1\n20\n1\n0\nVERTEX\n10\n2\n20\n2\n0\nSEQEND\n0\nDIMENSION\n5\nG7\n8\nD\n10\n0\n20\n9\n13\n1\n23\n2\n14\n3\n24\n2\n42\n2.04\n1\n20\n0\nHATCH\n5\nH8\n8\nH\n2\nANSI31\n10\n0\n20\n0\n91\n1\n92\n2\n93\n3\n10\n0\n20\n0\n10\n5\n20\n0\n10\n5\n20\n5\n97\n0\n0\nENDSEC\n0\nEOF\n"
    (tmp_path / "a.dxf").write_text(dxf)
    rows = drawings.read_drawings(spark, str(tmp_path)).collect()
    got = {r.dxf_handle: r for r in rows}
    assert sorted(got) == ["A1", "B2", "D4", "E5", "F6", "G7", "H8"] and {r.supported for r in rows} == {True} and {r.drawing for r in rows} == {"a"}
    assert (got["A1"].vertices, got["A1"].length, got["A1"].geom.bbox) == ([[1.0, 2.0], [3.0, 4.0]], 2.8, [1.0, 2.0, 3.0, 4.0])
    assert got["B2"].parsed.material == "plywood" and (got["B2"].insert_x, got["B2"].height) == (5.0, 2.0)
    assert (got["D4"].length, got["D4"].geom.bbox) == (12.6, [7.0, 7.0, 11.0, 11.0]) and (got["E5"].closed, got["E5"].length) == (True, 12.0)
    assert (got["F6"].type, got["F6"].vertices) == ("LWPOLYLINE", [[1.0, 1.0], [2.0, 2.0]]) and (got["G7"].dim_measurement, got["G7"].dim_override, got["G7"].dim_defpoints[1]) == (2.0, "20", [1.0, 2.0])
    assert (got["H8"].hatch_pattern, got["H8"].vertices, got["H8"].parsed.material) == ("ANSI31", [[0.0, 0.0], [5.0, 0.0], [5.0, 5.0]], "steel")
    again = drawings.scan(dxf)
    assert [files.state_line(r) for r in again] == [files.state_line(r) for r in drawings.scan(dxf)]
    d = tmp_path / "state" / "proj"
    d.mkdir(parents=True)
    (d / "D-1.jsonl").write_text('{"element_id": "e1", "layer": "A", "geom": {"x": 1.5, "y": 2}, "parsed": {"material": "glass", "spec_delegated": {"to": "hydraulic"}}}\n{broken\n')
    rows = files.read_states(spark, str(tmp_path / "state")).collect()
    assert [(r.element_id, r.drawing, r.project, r.geom.x, r.parsed.delegated_to) for r in rows] == [("e1", "proj/D-1", "proj", 1.5, "hydraulic")]


def test_pruned_tree_counts_unmatched_children(spark):
    from plansheet.operators import tree

    paths = spark.createDataFrame([(["a", "b"], True), (["a", "c"], False), (["a", "d"], None), (["z"], False), ([], True), (None, True)], "path array<string>, m boolean")
    got = {tuple(r.prefix): (r.paths, r.hits, r.collapsed) for r in tree.prune(tree.forest(paths, F.col("m"))).collect()}
    assert got == {("a",): (3, 1, 2), ("a", "b"): (1, 1, 0)}
