"""Whole jobs: drawings to details, decisions in the review queue, commits as a stream."""

import subprocess

from pyspark.sql import functions as F

from plansheet import schemas
from plansheet.operators import identity as I
from plansheet.operators import review as Q
from plansheet.operators import search as S
from plansheet.operators import vocabulary as V
from plansheet.plans import workflows as W
from plansheet.sources import files
from plansheet.streaming import commits as C
from plansheet.vocabulary import Vocabulary
from tests.test_sheets import NODES, frame, sheet, text, vocabulary


def group(*codes):
    return "\n".join(map(str, codes))


def drawing(*entities):
    return group(0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, "AC1032", 0, "ENDSEC", 0, "SECTION", 2, "ENTITIES", *(c for e in entities for c in e), 0, "ENDSEC", 0, "EOF") + "\n"


def dxf_wall(width=10, note="10MM PLASTERBOARD"):
    x1 = 100 + width
    ring = [c for x, y in ((100, 0), (x1, 0), (x1, 100), (100, 100)) for c in (10, x, 20, y)]
    return drawing(
        (0, "LWPOLYLINE", 5, "A1", 8, "A-DETL-PLASTER", 70, 1, *ring), (0, "TEXT", 5, "B2", 8, "A-ANNO", 10, 40, 20, 50, 40, 2.5, 1, note), (0, "LINE", 5, "C3", 8, "A-ANNO", 10, 39, 20, 50, 11, 105, 21, 50),
        (0, "DIMENSION", 5, "D4", 8, "A-ANNO", 10, 100, 20, -8, 13, 100, 23, 0, 14, x1, 24, 0, 42, width, 1, str(width)),
    )


def test_ingest_from_drawings(spark, tmp_path):
    (tmp_path / "D-1.dxf").write_text(dxf_wall())
    none = spark.createDataFrame([], schemas.struct(schemas.STATE))
    first = W.ingest_drawings(spark, str(tmp_path), none, vocabulary())
    assert {r.status for r in first.state.collect()} == {"new"} and first.summary.first().note == "first revision"
    (fact,) = first.facts.collect()
    assert (fact.material, fact.value, fact.confidence, fact.chain) == ("plasterboard", 10.0, "high", "leader+geometry+dimension+geometry")
    (detail,) = first.details.collect()
    assert (detail.detail_tag, detail.segmentation) == ("SHEET", "uncertain") and ["attr.material", "value.plasterboard"] in [c.path for c in detail.classifications]
    again = W.ingest_drawings(spark, str(tmp_path), first.state, vocabulary())
    assert {r.status for r in again.state.collect()} == {"unchanged"} and {r.element_id for r in again.state.collect()} == {r.element_id for r in first.state.collect()}
    assert W.check(again, first.state, first.details)
    assert again.state.transform(files.state_lines).collect() == first.state.transform(files.state_lines).collect()
    (tmp_path / "D-1.dxf").write_text(dxf_wall(note="13MM PLASTERBOARD"))
    other = W.ingest_drawings(spark, str(tmp_path), first.state, vocabulary(), known=first.identity_map)
    assert {r.type: r.status for r in other.state.collect()}["ANNOTATION"] == "value_changed" and not W.check(other, first.state, first.details)
    assert [r.conflict for r in other.facts.collect()] == [True]
    files.write_states(first.state, str(tmp_path / "out"))
    lines = sorted(p.read_text() for p in (tmp_path / "out" / "drawing=D-1").glob("*.txt"))
    assert len(lines) == 1 and lines[0].count("\n") == 4


def test_questions(spark):
    one = [text(1, "3MM GLASS", 0, 0), text(2, "12MM PLY", 0, 50)]
    two = [text(1, "2MM GLASS", 0, 0)]
    rows = frame(spark, one).withColumn("commit_seq", F.lit(1)).unionByName(frame(spark, two).withColumn("commit_seq", F.lit(2)))
    rows = rows.withColumns({"commit_date": F.format_string("2024-01-%02d", "commit_seq"), "project": F.lit("")})
    status = W.index_states(rows)
    assert {(r.element_id, r.commit_seq): r.status for r in status.collect()} == {("e01", 1): "new", ("e02", 1): "new", ("e01", 2): "value_changed", ("e02", 2): "deleted"}
    fact = "drawing string, element_id string, commit_seq int, material string, part string, value double, measure string, confidence string, chain string, qualifier string"
    facts = spark.createDataFrame([("S1", "e01", 1, "glass", None, 3.0, None, "high", "leader", None), ("S1", "e02", 1, "plywood", None, 12.0, None, "low", "leader", None), ("S1", "e01", 2, "glass", None, 2.0, None, "high", "leader", None), ("S1", "e01", 2, None, None, 7.0, None, None, "unattributed", None)], fact)
    found = lambda **k: [(r.element_id, r.commit_seq) for r in W.find(status, facts, **k).collect()]
    assert found(material="glass", value=3.0) == [] and found(material="glass", value=3.0, ever=True) == [("e01", 1)]  # ever 3 mm
    assert found(value=12.0, ever=True) == [] and found(value=12.0, ever=True, include_low=True) == [("e02", 1)] and found(material="plywood", ever=True) == [("e02", 1)]
    assert found(value=7.0) == [] and found(value=7.0, include_loose=True) == [("e01", 2)] and found(text="glass") == [("e01", 2)]
    commits = spark.createDataFrame([(1, "abc1"), (2, "abd2")], "commit_seq int, commit_sha string")
    assert [r.element_id for r in W.snapshot(status, commits, "abc").orderBy("element_id").collect()] == ["e01", "e02"]
    assert [(r.element_id, r.change) for r in W.changed(status, commits, "abc", "abd").collect()] == [("e01", "changed"), ("e02", "deleted")]
    assert [r.status for r in W.element(status, "e01").collect()] == ["new", "value_changed"]
    pages = W.page(status.drop("parsed"), facts, ["material:Glass", "value:3"], ever=True)
    (d,) = pages["drawings"].collect()
    assert (d.elements, d.matched, d.via_history, d.deleted_only) == (1, 1, False, False) and [r.element_id for r in pages["deleted"].collect()] == ["e02"]
    text_, payload = W.full_report(status.drop("parsed", "geom", "source_lines", "reassembly"), facts.withColumnRenamed("commit_seq", "at"), ["drawing", "element_id", "text_raw"])
    assert text_.splitlines()[-1] == "| S1 | e01 | 2MM GLASS |" and payload.count() == 4


def test_chip_rules(spark):
    rows = spark.createDataFrame([("a", 10.0, None, "high", None), ("a", 10.0, "ply", "low", None), ("a", 10.0, "ply", "high", "setdown"), ("a", 10.4, "ply", "high", None)], "drawing string, value double, material string, confidence string, measure string")
    hits = lambda *c, **k: [r[0] for r in rows.select(S.fact_chip(*c, **k)).collect()]
    assert hits("value", "10") == [False] * 4 and hits("value", "10", include_loose=True) == [True, False, False, False] and hits("value", "10", include_low=True) == [False, True, False, False]
    assert hits("value", "10", tolerance=0.5) == [False, False, False, True] and hits("value", "10", measure="setdown") == [False, False, True, False] and hits("material", "PLY") == [False, False, True, True]


def occurrences(spark):
    made = [("u1", "EZY CAV JAMB LINER", "part", "t1"), ("u2", "EZY CAV jamb liners", "part", "t1"), ("u3", "fixed EZY CAV sill", "part", "t2"), ("u4", "MUD", "value", "t2"), ("u5", "jamb", "part", "t2")]
    rows = [(u, t, " ".join(t.lower().split()), lv, "attr.material" if lv == "value" else None, t.lower() if lv == "value" else None, t.lower() if u == "u5" else None, None, None, "thickness", f"e{u}", d, "S1", 3, "2024-01-03", ["component.door"]) for u, t, lv, d in made]
    return spark.createDataFrame(rows, "uid string, raw_string string, normalised string, level_guess string, attribute string, material string, part string, value double, qualifier string, measure string, element_id string, detail_id string, drawing string, commit_seq int, commit_date string, sibling_context array<string>")


def test_review_queue(spark):
    v, occ = vocabulary(), occurrences(spark)
    nodes, log = files.vocabulary_nodes(spark, v), spark.createDataFrame([], schemas.struct(Q.LOG))
    titles = spark.createDataFrame([("t1", "One"), ("t2", "Two")], "detail_id string, title string")
    first = W.queue(occ, log, nodes, v, titles).collect()
    # u5 is known; u1, u2 and u3 share a word pair
    assert [(c.occurrence_count, c.label, c.level_guess, c.titles) for c in first] == [(3, "EZY CAV jamb liners", "part", ["One", "Two"]), (1, "MUD", "value", ["Two"])]
    key = first[0].cluster_key
    rows = Q.scoped(W.queue(occ, log, nodes, v), occ, first[0].cluster_id)
    log2, v2 = Q.assign(log, rows, v, key, "part.lining", "me")
    assert {(r.uid, r.status) for r in Q.statuses(log2).collect()} == {("u1", "resolved"), ("u2", "resolved"), ("u3", "resolved")} and "EZY CAV JAMB LINER" in v2.nodes["part.lining"]["synonyms"]
    assert [c.label for c in W.queue(occ, log2, files.vocabulary_nodes(spark, v2), v2).collect()] == ["MUD"]
    components = spark.createDataFrame([("t1", ["component.wall"])], "detail_id string, components array<string>")
    got = {(r.detail_id, r.element_id): r.path for r in Q.reclassified(log2, occ, v2, components).collect()}
    assert got == {("t1", "eu1"): ["component.wall", "part.lining"], ("t1", "eu2"): ["component.wall", "part.lining"], ("t2", "eu3"): ["part.lining"]}
    log3, v3 = Q.undo(log2, log2.first()["rid"], v2)
    assert v3.nodes["part.lining"]["synonyms"] == [] and len(W.queue(occ, log3, nodes, v3).collect()) == 2
    log4, v4 = Q.ignore(log3, Q.scoped(W.queue(occ, log3, nodes, v3), occ, first[1].cluster_key), v3, first[1].cluster_key)
    assert v4.ignores("mud") and [c.occurrence_count for c in W.queue(occ, log4, nodes, v4).collect()] == [3]
    hidden = Q.dismiss(spark.createDataFrame([], "cluster_key string, actor string"), key, "me")
    assert [c.label for c in W.queue(occ, log, nodes, v, dismissed=hidden, actor="me").collect()] == ["MUD"] and len(W.queue(occ, log, nodes, v, dismissed=hidden, actor="you").collect()) == 2
    proposal = Q.proposal_from(W.queue(occ, log, nodes, v), nodes, key).first()
    assert (proposal.label, proposal.parents, proposal.status) == ("EZY CAV jamb liners", ["component.door"], "pending")
    assert Q.insert_new(occ, occ.limit(2)).count() == 5 and [r.action for r in Q.recent(log4, 2).collect()] == ["ignore", "undo"]


def test_proposals(spark):
    v = vocabulary()
    nodes = files.vocabulary_nodes(spark, v)
    near = V.propose(nodes, "part", "Sills", ["component.wall"], "d")
    assert near.first().status == "blocked" and near.first().blocked_by[0] == "part.sill"
    new = V.propose(nodes, "part", "Gutter bracket", ["component.wall"], "holds it", ["bracket"])
    assert V.approve(nodes, new, "gutter_bracket").filter("node_id = 'part.gutter_bracket'").count() == 1 and V.approve(nodes, near, "sills").count() == nodes.count()
    assert "bracket" in V.merge_proposal(nodes, new, "gutter_bracket", "part.sill").filter("node_id = 'part.sill'").first().synonyms
    assert [r.node_id for r in V.duplicates(nodes, "Linings").collect()] == ["part.lining"] and V.query_node(nodes, "cill").first().node_id == "part.sill"


def test_confirmed_dimensions(spark):
    reviews = spark.createDataFrame([("vd_1", "S1", "e1", 10.0, "ply", "pending"), ("vd_2", "S1", "e2", 5.0, None, "pending")], "uid string, drawing string, element_id string, value double, material string, status string")
    log = Q.confirm_dimension(spark.createDataFrame([], schemas.struct(Q.LOG)), reviews, "vd_1")
    facts = spark.createDataFrame([("S1", "e1", 10.0, "low", "vision"), ("S1", "e1", 11.0, "low", "vision")], "drawing string, element_id string, value double, confidence string, chain string")
    assert {(r.value, r.confidence, r.chain) for r in Q.confirmed_facts(facts, reviews, log).collect()} == {(10.0, "medium", "vision+human"), (11.0, "low", "vision")}
    assert [r.uid for r in Q.dimensions_open(reviews, log).collect()] == ["vd_2"]
    kept = Q.upsert_reviews(reviews.withColumn("status", F.lit("confirmed")), reviews.filter("uid = 'vd_1'")).collect()
    assert {r.status for r in kept} == {"confirmed"}


def test_files_round_trip(spark, tmp_path):
    v = vocabulary()
    files.write_vocabulary(v, str(tmp_path / "v"))
    back = files.load_vocabulary(str(tmp_path / "v"))
    assert {i: {k: x for k, x in n.items() if x} for i, n in back.nodes.items()} == {i: {k: x for k, x in n.items() if x} for i, n in v.nodes.items()} and (back.aliases, back.ignore) == (v.aliases, v.ignore)
    assert files.cached_vocabulary(str(tmp_path / "v")) is files.cached_vocabulary(str(tmp_path / "v"))
    (tmp_path / "m.yaml").write_text("materials:\n  mud: {keywords: [MUD], qualifiers: [wet]}\nparts: [pit]\n")
    assert files.load_words(str(tmp_path / "m.yaml")).materials == {"mud": ["mud"]}
    repo = tmp_path / "r"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(2):
        (repo / "a.txt").write_text(f"v{k}")
        git("add", ".")
        git("commit", "-qm", f"commit {k}")
    commits = files.read_commits(spark, str(repo)).orderBy("commit_seq").collect()
    assert [c.commit_message for c in commits] == ["commit 0", "commit 1"] and files.read_commits(spark, str(tmp_path)).count() == 0
    blobs = files.read_blobs(spark, str(repo), [(c.commit_sha, f) for c in commits for f in ("a.txt", "none")])
    assert sorted(bytes(b.content) for b in blobs.collect()) == [b"v0", b"v1"]
    listed = files.ingest_kind(files.list_files(spark, str(repo), "*.txt"))
    assert [r.kind for r in listed.collect()] == ["other"] and files.unindexed(listed, spark.createDataFrame([("x/A",)], "drawing string")).count() == 0
    twin = spark.createDataFrame([("/x/a.pdf", "a"), ("/x/a.dxf", "a"), ("/x/b.pdf", "b"), ("/x/c.PNG", "c")], "file string, stem string")
    assert {r.file: r.kind for r in files.ingest_kind(twin).collect()} == {"/x/a.pdf": "pdf-twin", "/x/a.dxf": "dxf", "/x/b.pdf": "pdf", "/x/c.PNG": "image"}


def test_commits_as_a_stream(spark, tmp_path):
    rows = {1: [("a", "e1", 1.0), ("a", "e2", 2.0)], 2: [("a", "e1", 1.5)], 3: [("a", "e1", 1.5), ("b", "e9", 9.0)]}
    schema = "drawing string, element_id string, value double, commit_seq int"
    moved = lambda now, before: F.when(now["value"] != before["value"], "value_changed").otherwise("unchanged")
    for seq, held in rows.items():
        spark.createDataFrame([(*r, seq) for r in held], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = C.state_stream(spark, str(tmp_path / "in"), schema)
        C.index_stream(stream, str(tmp_path / "index"), str(tmp_path / "check"), moved).awaitTermination(60)
    got = {(r.drawing, r.element_id, r.commit_seq): r.status for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    assert got == {("a", "e1", 1): "new", ("a", "e2", 1): "new", ("a", "e1", 2): "value_changed", ("a", "e2", 2): "deleted", ("a", "e1", 3): "unchanged", ("b", "e9", 3): "new"}


def test_element_status_expression_agrees_with_matching(spark):
    a, b = text(1, "x", 0, 0), text(1, "x", 0.1, 0)
    for before, now, want in ((a, b, "unchanged"), (a, text(1, "x", 1, 0), "moved"), (a, text(1, "y", 0, 0, w=8.0), "value_changed"), (a, text(1, "y", 5, 0, w=8.0), "moved+value_changed")):
        pair = frame(spark, [now]).select(F.struct("*").alias("n")).join(frame(spark, [before]).select(F.struct("*").alias("b")))
        assert pair.select(I.change_status(F.col("n"), F.col("b"))).first()[0] == want == I._status(now, before)
    assert Vocabulary(NODES).problems() == [] and len(sheet()) == 16
