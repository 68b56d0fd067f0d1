"""Further registered queries: texts, geometry, vocabulary, classification, search, review ledgers, trees and history, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FILLERS, Words
from ..functions import geometry as G
from ..functions import text as X
from ..operators import classify as C
from ..operators import history as H
from ..operators import review as Q
from ..operators import search as S
from ..operators import vocabulary as V
from ..sources import adapters as A
from .catalog import _F, _H, _STATUS, _status, query

# --- texts

_RAW = r"""r AS (SELECT p_partkey AS element_id, '{\fArial|b0;' || p_name || '\P' || upper(p_brand) || '}  \S1^2; %%d%%C' || CASE p_partkey % 3 WHEN 0 THEN '\L' ELSE '\H2.5x;' END || p_type AS raw FROM part)"""


@query(rf"""WITH {_RAW} SELECT element_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(raw, '\P', ' '), '%%d', '°'), '%%C', 'Ø'), '\\S([^;^]*)\^([^;]*);', '\1/\2', 'g'), '\\([LOKloPXpm\d;?. ]|f[^;]*;|H[\d.]+x?;|[CTQWA]\d+;)', ' ', 'g'), '[{{}}]', '', 'g'), '\s+', ' ', 'g')) AS text FROM r""")
def plain_mtext(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 3 == 0, "\\L").otherwise("\\H2.5x;")
    raw = F.concat(F.lit("{\\fArial|b0;"), "p_name", F.lit("\\P"), F.upper("p_brand"), F.lit("}  \\S1^2; %%d%%C"), code, "p_type")
    return p.select(F.col("p_partkey").alias("element_id"), X.unescape_mtext(raw).alias("text"))


_KEYS = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query(f"""SELECT p_partkey AS id, {_KEYS.format("regexp_replace(lower(p_brand || ' / ' || p_name), '[._\\-/]+', ' ', 'g')")} AS normalised, {_KEYS.format("p_brand || '  ' || p_type")} AS folded, trim(regexp_replace(upper(p_brand || '  ' || p_type), '\\s+', ' ', 'g')) AS tag,
  regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, 'value.' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 0.5 AS VARCHAR) END || 'mm' AS amount,
  'd_' || substr(sha1(p_brand || '::' || p_type), 1, 4) AS detail_id, 'u_' || substr(sha1(lower(p_name) || '|part|' || p_partkey || '|'), 1, 6) AS uid, 'vd_' || substr(sha1(p_brand || '|' || p_partkey || '|' || p_size || '.0'), 1, 6) AS dim_uid FROM part""")
def text_keys(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    both = lambda *c: F.concat_ws("  ", *c)
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    return p.select(
        F.col("p_partkey").alias("id"), X.normalise(F.concat_ws(" / ", "p_brand", "p_name")).alias("normalised"), X.folded(both("p_brand", "p_type")).alias("folded"), X.tag(both("p_brand", "p_type")).alias("tag"), X.slug(F.col("p_brand")).alias("slug"),
        X.amount_node(F.when(size % 2 == 0, size.cast("double")).otherwise(size + 0.5)).alias("amount"), X.detail_id(F.col("p_brand"), F.col("p_type")).alias("detail_id"),
        X.occurrence_uid(F.lower("p_name"), F.lit("part"), key, F.lit(None)).alias("uid"), X.dimension_uid(F.col("p_brand"), key, size.cast("double")).alias("dim_uid"),
    )


_WORDS = Words(materials={"steel": ["steel"], "copper": ["copper"], "tin": ["tin", "brass"]}, hatches={"Economy": "steel", "PROMO": "copper"}, parts=["anodized", "plate"], qualifiers=["small"])


@query(r"""SELECT p_partkey AS id, CASE WHEN regexp_matches(lower(replace(p_type, '-', ' ')), '\bcopper\b') THEN 'copper' WHEN regexp_matches(lower(p_type), '\bsteel\b') THEN 'steel' WHEN regexp_matches(lower(p_type), '\b(brass|tin)\b') THEN 'tin' END AS layer_material,
  CASE upper(split_part(p_type, ' ', 1)) WHEN 'ECONOMY' THEN 'steel' WHEN 'PROMO' THEN 'copper' END AS hatch_material, CASE p_partkey % 3 WHEN 0 THEN '1:' || p_size WHEN 1 THEN 'NTS' END AS scale, p_partkey % 3 < 2 AS tells_scale,
  p_partkey % 2 = 0 AS ignored, CASE WHEN len(list_filter(regexp_extract_all(upper(p_name), '\b[A-Z]{4,}\b'), lambda w: w <> 'SMALL')) = 0 THEN NULL
    ELSE lower(list_reduce(list_filter(regexp_extract_all(upper(p_name), '\b[A-Z]{4,}\b'), lambda w: w <> 'SMALL'), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)) END AS noun,
  CAST(nullif(regexp_extract(replace(p_brand || ' 1,250.5', ',', ''), '\d+(\.\d+)?'), '') AS DOUBLE) AS number FROM part""")
def annotation_words(spark, sf_dir):
    p, n = A.table(spark, sf_dir, "part"), F.col("p_partkey")
    scale = F.when(n % 3 == 0, F.concat(F.lit("SCALE 1 : "), F.col("p_size").cast("string"))).when(n % 3 == 1, "Not  to scale").otherwise("SCALING")
    said = F.when(n % 2 == 0, F.concat(F.lit("See NOTES  to all"), "p_name")).otherwise(F.col("p_type"))
    return p.select(
        n.alias("id"), X.layer_material(F.replace("p_type", F.lit(" "), F.lit("-")), _WORDS).alias("layer_material"), X.hatch_material(F.split_part("p_type", F.lit(" "), F.lit(1)), _WORDS).alias("hatch_material"),
        X.scale_of(scale).alias("scale"), X.tells_scale(scale).alias("tells_scale"), X.ignored(said, ["see notes"]).alias("ignored"), X.unknown_noun(F.upper("p_name"), _WORDS).alias("noun"), X.first_number(F.concat("p_brand", F.lit(" 1,250.5"))).alias("number"),
    )


@query(f"""WITH w AS (SELECT p_partkey AS id, list_filter(regexp_extract_all(lower(p_name || ' for ' || p_type), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('steel', {", ".join(f"'{f}'" for f in FILLERS)})) AS ws FROM part)
SELECT id, array_to_string(ws, ' ') AS words, array_to_string(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), '|') AS pairs FROM w""")
def content_bigrams(spark, sf_dir):
    w = X.content_words(F.concat_ws(" for ", "p_name", "p_type"), ["steel"], FILLERS)
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), w.alias("w")).select("id", F.array_join("w", " ").alias("words"), F.array_join(X.bigrams(F.col("w")), "|").alias("pairs"))


@query("SELECT source, bool_or(contains(lower(text), 'wet area')) AS wet, count(*) AS n FROM documents GROUP BY source")
def wet_areas(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("source", X.wet_area(F.array("text")).alias("w"))
    return d.groupBy("source").agg(F.max("w").alias("wet"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS id, 'sha1:' || sha1('TEXT|' || c_mktsegment || '|' || c_nationkey || '.0,0.0,' || c_nationkey || '.0,0.0,' || (c_nationkey + 2) || '.0,1.0|' || c_name || '||' || CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey || '.0' ELSE '' END || '|') AS fingerprint FROM customer""")
def fingerprints(spark, sf_dir):
    n = F.col("c_nationkey").cast("double")
    box = F.array(n, F.lit(0.0), n + 2, F.lit(1.0))
    none = F.lit(None).cast("string")
    r = F.struct(F.lit("TEXT").alias("type"), F.col("c_mktsegment").alias("layer"), F.struct(n.alias("x"), F.lit(0.0).alias("y"), box.alias("bbox")).alias("geom"), F.col("c_name").alias("text_raw"), none.alias("hatch_pattern"), F.when(F.col("c_nationkey") % 2 == 0, n).alias("dim_measurement"), none.alias("dim_override"))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.fingerprint(r).alias("fingerprint"))


# --- geometry


@query("""WITH r AS (SELECT s_suppkey AS id, CAST(s_nationkey + 1 AS DOUBLE) AS w, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS h FROM supplier)
SELECT id, w * h AS area, least(w, h) AS thickness, round(2 * (w + h), 1) AS ring, round(2 * w + h, 1) AS open_length, w AS x1, h AS y1, CASE WHEN w > 5 AND h > 0 THEN least(w, 8) - 5 ELSE 0 END > 0 AS meets,
  CASE WHEN w <= 5 THEN 0 ELSE round((least(w, 8) - 5) * least(h, 2) / least(w * h, 6), 9) END AS overlap, round(w / (2 * pi()), 9) AS radius, 0.5 < h AS crossed, CASE WHEN 0.5 <= h AND w <= 20 THEN w END AS struck FROM r""")
def region_measures(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 1.0).alias("w"), (F.col("s_suppkey") % 7 + 1.0).alias("h"))
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    xy = [(zero, zero), (w, zero), (w, h), (zero, h)]
    poly, line = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in xy]), F.array(*[F.array(x, y) for x, y in xy])
    box, other = G.box_of(line), F.array(*[F.lit(float(v)) for v in (5, 0, 8, 2)])
    edges = G.segments(line, F.lit(True))
    at = F.lit(0.5)
    return s.select(
        "id", G.area(poly).alias("area"), F.when(w >= h, G.thickness(poly)).otherwise(G.thickness(poly)).alias("thickness"), G.polyline_length(line, F.lit(True)).alias("ring"), G.polyline_length(line, F.lit(False)).alias("open_length"),
        box[2].alias("x1"), box[3].alias("y1"), (G.box_overlap_share(box, other) > 0).alias("meets"), F.round(G.box_overlap_share(box, other), 9).alias("overlap"), F.round(G.circle(F.lit(None).cast("array<array<double>>"), w, box)["r"], 9).alias("radius"),
        G.crosses(poly, F.lit(-1.0), at, w / 2, at).alias("crossed"), F.when(G.strike(edges, F.lit(0.25), at, F.lit(1.0), zero, 19.75).isNotNull(), G.strike(edges, F.lit(0.25), at, F.lit(1.0), zero, 19.75) + 0.25).alias("struck"),
    )


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, e FROM v UNION ALL SELECT vec_id + 1000000, label, list_concat(list_transform(e[1:vec_id % 8], lambda x: -x), e[vec_id % 8 + 1:]) FROM v),
b AS (SELECT vec_id, label, list_transform(e, lambda x: x > list_sum(e) / 64) AS bits FROM u), p AS (SELECT a.label, a.vec_id AS a, z.vec_id AS z, len(list_filter(range(1, 65), lambda i: a.bits[i] <> z.bits[i])) AS distance FROM b a JOIN b z ON a.label = z.label AND a.vec_id < z.vec_id) SELECT label, a, z, distance FROM p WHERE distance <= 6""")
def near_duplicates(spark, sf_dir):
    """Hashes of vectors and of copies with up to seven numbers turned, within each label."""
    from ..operators.report import near_hashes

    e = A.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    k = (F.col("vec_id") % 8).cast("int")
    turned = e.select("label", (F.col("vec_id") + 1_000_000).alias("vec_id"), F.concat(F.transform(F.slice("e", F.lit(1), k), lambda x: -x), F.slice("e", k + 1, F.lit(64))).alias("e"))
    rows = e.unionByName(turned).select(F.col("label").alias("drawing"), F.col("vec_id").alias("id"), F.array(G.average_hash(F.col("e"))).alias("hash"))
    return near_hashes(rows, 6).select(F.col("drawing").alias("label"), "a", "z", F.col("distance").cast("long").alias("distance"))


_SEG = """s AS (SELECT c_nationkey AS drawing, c_custkey AS segment_id, c_acctbal / 10 AS x, c_acctbal / 10 + c_custkey % 60 AS x2 FROM customer), r AS (SELECT s_nationkey AS drawing, s_suppkey AS region_id, s_acctbal / 10 AS lo, s_acctbal / 10 + 40 AS hi FROM supplier)"""


@query(f"WITH {_SEG} SELECT s.drawing, segment_id, count(*) AS regions, min(region_id) AS first_region FROM s JOIN r ON s.drawing = r.drawing WHERE (x >= lo - 0.5 AND x <= hi + 0.5 AND x2 >= lo - 0.5 AND x2 <= hi + 0.5) OR (least(x, x2) < lo AND greatest(x, x2) > lo) OR (least(x, x2) < hi AND greatest(x, x2) > hi) GROUP BY ALL")
def regions_crossed(spark, sf_dir):
    from ..operators.attribution import regions_of_segments

    c, s = A.table(spark, sf_dir, "customer"), A.table(spark, sf_dir, "supplier")
    at = F.col("c_acctbal") / 10
    segments = c.select(F.col("c_nationkey").alias("drawing"), F.col("c_custkey").alias("segment_id"), at.alias("x"), F.lit(0.5).alias("y"), (at + F.col("c_custkey") % 60).alias("x2"), F.lit(0.5).alias("y2"))
    corner = lambda dx, y: F.struct((F.col("s_acctbal") / 10 + dx).alias("x"), F.lit(float(y)).alias("y"))
    regions = s.select(F.col("s_nationkey").alias("drawing"), F.col("s_suppkey").alias("region_id"), F.array(corner(0.0, -9), corner(40.0, -9), corner(40.0, 9), corner(0.0, 9)).alias("poly"))
    found = regions_of_segments(segments, regions)
    return found.groupBy("drawing", "segment_id").agg(F.count(F.lit(1)).alias("regions"), F.min("region_id").alias("first_region"))


# --- vocabulary

_NODES = """nodes AS (SELECT 'component.r' || r_regionkey AS node_id, 'component' AS level, r_name AS label, NULL AS parent, r_regionkey AS ord FROM region
UNION ALL SELECT 'part.n' || n_nationkey, 'part', n_name, 'component.r' || n_regionkey, 100 + n_nationkey FROM nation)"""


def _nodes(spark, sf_dir):
    r, n = A.table(spark, sf_dir, "region"), A.table(spark, sf_dir, "nation")
    text = "array<string>"
    top = r.select(F.concat(F.lit("component.r"), "r_regionkey").alias("node_id"), F.col("r_regionkey").alias("ord"), F.lit("component").alias("level"), F.col("r_name").alias("label"), F.lit("d").alias("definition"), F.array().cast(text).alias("parents"))
    low = n.select(F.concat(F.lit("part.n"), "n_nationkey"), F.col("n_nationkey") + 100, F.lit("part"), F.col("n_name"), F.lit("d"), F.array(F.concat(F.lit("component.r"), "n_regionkey")))
    none = F.lit(None).cast("string")
    return top.union(low).select("*", F.array().cast(text).alias("synonyms"), none.alias("deprecated_by"), none.alias("value_type"), F.array().cast(text).alias("enum_members"), none.alias("slug"))


@query(f"WITH {_NODES} SELECT n.node_id AS node, CASE WHEN n.parent IS NULL THEN n.label ELSE p.label || '>' || n.label END AS labels, CASE WHEN n.parent IS NULL THEN 0 ELSE 1 END AS depth FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent")
def vocab_tree(spark, sf_dir):
    return V.tree(_nodes(spark, sf_dir)).select("node", F.array_join("labels", ">").alias("labels"), "depth")


@query(f"WITH {_NODES} SELECT node_id, 'unknown parent' AS rule FROM nodes WHERE parent = 'component.r3' UNION ALL SELECT node_id, 'definition is required' FROM nodes WHERE level = 'part' AND ord % 5 = 0 UNION ALL SELECT node_id, 'needs a parent' FROM nodes WHERE node_id = 'part.n7'")
def vocab_violations(spark, sf_dir):
    n = _nodes(spark, sf_dir).filter("node_id <> 'component.r3'").withColumn("definition", F.when((F.col("level") == "part") & (F.col("ord") % 5 == 0), "").otherwise("d"))
    lost = F.when(F.col("node_id") == "part.n7", F.array().cast("array<string>")).otherwise(F.col("parents"))
    regioned = n.withColumn("parents", lost)
    return V.violations(regioned).filter("NOT (node_id = 'part.n7' AND rule = 'unknown parent')").select("node_id", "rule")


@query(f"WITH {_NODES} SELECT node_id, CASE WHEN parent = 'component.r1' THEN 'component.r2' ELSE coalesce(parent, '') END AS parent, CASE WHEN node_id = 'component.r1' THEN 'component.r2' END AS deprecated_by, CASE WHEN node_id = 'component.r2' THEN (SELECT label FROM nodes WHERE node_id = 'component.r1') ELSE '' END AS synonyms FROM nodes")
def node_merge(spark, sf_dir):
    merged = V.merge_nodes(_nodes(spark, sf_dir), "component.r1", "component.r2")
    return merged.select("node_id", F.array_join("parents", ",").alias("parent"), "deprecated_by", F.array_join("synonyms", ",").alias("synonyms"))


_FACTS = """f AS (SELECT p_partkey AS id, 'd' || p_partkey % 9 AS drawing, CASE p_partkey % 3 WHEN 0 THEN 'anodized' WHEN 1 THEN 'plated' ELSE 'burnished' END AS part, CASE p_size % 4 WHEN 0 THEN 'copper' WHEN 1 THEN 'steel' WHEN 2 THEN 'tin' ELSE 'copper' END AS material, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_partkey % 5 = 0 THEN 'setdown' ELSE 'thickness' END AS measure FROM part)"""


def _words(n):
    """A part and a material that each of the driver's parts is said to have."""
    part = F.when(n % 3 == 0, "anodized").when(n % 3 == 1, "plated").otherwise("burnished")
    material = F.when(F.col("p_size") % 4 == 1, "steel").when(F.col("p_size") % 4 == 2, "tin").otherwise("copper")
    return part.alias("part"), material.alias("material")


def _catalogue(spark):
    """Components, parts and values: 'anodized' and 'plated' are parts, 'copper' and 'steel' values."""
    rows = [
        ("component.shell", 0, "component", "Outer Shell", [], []), ("part.anodized", 1, "part", "Anodized", ["component.shell"], []), ("part.plated", 2, "part", "Plated sheet", ["component.core"], ["plated"]), ("component.core", 3, "component", "Core", [], []),
        ("attr.material", 4, "attribute", "Material", [], []), ("value.copper", 5, "value", "Copper", ["attr.material"], []), ("value.st", 6, "value", "Stahl", ["attr.material"], ["steel"]),
    ]
    return spark.createDataFrame(rows, "node_id string, ord int, level string, label string, parents array<string>, synonyms array<string>").withColumn("deprecated_by", F.lit(None).cast("string"))


@query(f"""WITH {_FACTS}, r AS (SELECT *, CASE part WHEN 'anodized' THEN 'part.anodized' WHEN 'plated' THEN 'part.plated' END AS pn, CASE material WHEN 'copper' THEN 'value.copper' WHEN 'steel' THEN 'value.st' END AS mn FROM f),
q AS (SELECT *, CASE WHEN pn IS NULL THEN 'unknown-part:' || part WHEN mn IS NULL THEN 'unknown-material:' || material END AS reason, CASE WHEN pn = 'part.anodized' THEN 'component.shell>' ELSE '' END || pn AS head FROM r)
SELECT id, reason, CASE WHEN reason IS NOT NULL THEN '' ELSE head || '>attr.material>' || mn || coalesce('|' || head || '>attr.' || measure || '>value.' || CAST(CAST(value AS INTEGER) AS VARCHAR) || 'mm', '') END AS paths FROM q""")
def classified_facts(spark, sf_dir):
    p, n = A.table(spark, sf_dir, "part"), F.col("p_partkey")
    facts = p.select(n.alias("id"), F.concat(F.lit("d"), n % 9).alias("drawing"), *_words(n), F.when(n % 4 != 0, F.col("p_size").cast("double")).alias("value"), F.when(n % 5 == 0, "setdown").otherwise("thickness").alias("measure"))
    components = facts.select("drawing", F.array(F.lit("component.shell")).alias("components")).distinct()
    found = C.classify(facts, _catalogue(spark), components)
    return found.select("id", "reason", F.array_join(F.transform("paths", lambda x: F.array_join(x, ">")), "|").alias("paths"))


@query("""SELECT p_partkey AS id, CASE WHEN contains(p_name, 'door') THEN 'door_jamb' WHEN p_partkey % 3 = 0 THEN 'sill' END AS junction_type, CASE WHEN p_partkey % 4 = 0 THEN 'roof' END AS assembly, CASE WHEN p_partkey % 2 = 0 THEN 'interior' END AS context,
  'section' AS projection, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'component.roof,part.sill' ELSE 'component.roof' END WHEN p_partkey % 3 = 0 THEN 'part.sill' ELSE '' END AS nodes FROM part""")
def detail_facets(spark, sf_dir):
    p, n = A.table(spark, sf_dir, "part"), F.col("p_partkey")
    texts = F.array(F.when(n % 3 == 0, "CILL  to sill").otherwise("none"), F.when(n % 4 == 0, "Roof").otherwise("none"), F.when(n % 2 == 0, "Ensuite").otherwise("none"))
    texts = F.when(n % 3 == 0, F.concat(texts, F.array(F.lit("cill")))).otherwise(texts)
    found = p.select(n.alias("id"), C.facets(F.lit("Detail A"), texts).alias("f"))
    return found.select("id", "f.junction_type", "f.assembly", "f.context", "f.projection", F.array_join(C.facet_nodes(F.col("f")), ",").alias("nodes"))


# --- search

_ROWS = f"""{_STATUS}, fc AS (SELECT drawing, element_id, commit_seq, CASE WHEN element_id % 3 = 0 THEN 'steel' ELSE 'tile' END AS material, value, CASE WHEN element_id % 4 = 0 THEN 'low' ELSE 'high' END AS confidence FROM h WHERE element_id % 2 = 0),
top AS (SELECT drawing, max(commit_seq) AS commit_seq FROM st GROUP BY drawing), ftop AS (SELECT drawing, max(commit_seq) AS commit_seq FROM fc GROUP BY drawing)"""


def _bound(spark, sf_dir):
    n, none = F.col("element_id"), F.lit(None).cast("string")
    h = A.snapshots(spark, sf_dir).filter(n % 2 == 0)
    return h.select("drawing", "element_id", "commit_seq", F.when(n % 3 == 0, "steel").otherwise("tile").alias("material"), "value", none.alias("measure"), F.when(n % 4 == 0, "low").otherwise("high").alias("confidence"), F.lit("leader").alias("chain"), none.alias("qualifier"))


@query(f"""WITH {_ROWS}, q AS (SELECT DISTINCT fc.drawing FROM fc JOIN ftop USING (drawing, commit_seq) WHERE material = 'steel' AND confidence = 'high'),
r AS (SELECT st.drawing, st.element_id, st.status, coalesce(fc.material = 'steel' AND fc.confidence = 'high', false) AS m FROM st JOIN top USING (drawing, commit_seq) LEFT JOIN fc ON fc.drawing = st.drawing AND fc.element_id = st.element_id AND fc.commit_seq = st.commit_seq)
SELECT drawing, count(*) FILTER (status <> 'deleted') AS elements, count(*) FILTER (status <> 'deleted' AND m) AS matched, (SELECT count(*) FROM st s2 JOIN top t2 USING (drawing, commit_seq) WHERE s2.drawing = r.drawing AND s2.status = 'deleted') AS removed FROM r WHERE drawing IN (SELECT drawing FROM q) GROUP BY drawing""")
def stacked_drawings(spark, sf_dir):
    state = _status(spark, sf_dir).withColumn("material", F.lit(None).cast("string"))
    drawings, _, deleted = S.search_stacked(state, _bound(spark, sf_dir), [("material", "Steel")])
    gone = deleted.groupBy("drawing").agg(F.count(F.lit(1)).alias("removed"))
    return drawings.filter("NOT deleted_only").join(gone, "drawing", "left").select("drawing", "elements", "matched", F.coalesce("removed", F.lit(0)).alias("removed"))


@query(f"WITH {_ROWS} SELECT st.drawing, st.element_id, st.commit_seq, fc.confidence, fc.value AS exact_value FROM st JOIN top USING (drawing, commit_seq) JOIN fc ON fc.drawing = st.drawing AND fc.element_id = st.element_id AND fc.commit_seq = st.commit_seq WHERE st.status <> 'deleted' AND fc.material = 'steel' AND fc.confidence = 'high'")
def stacked_rows(spark, sf_dir):
    state = _status(spark, sf_dir).withColumn("material", F.lit(None).cast("string"))
    _, rows, _ = S.search_stacked(state, _bound(spark, sf_dir), [("material", "steel")])
    return rows.filter("matched AND exact_value IS NOT NULL").select("drawing", "element_id", "commit_seq", "confidence", "exact_value")


@query("SELECT (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT p_type AS x FROM part ORDER BY 1 LIMIT 40)) AS material, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT p_brand AS x FROM part ORDER BY 1 LIMIT 40)) AS part")
def suggestion_lists(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("material"), F.col("p_brand").alias("part"))
    return S.suggestion_lists(p, 40).select(F.array_join("material", "|").alias("material"), F.array_join("part", "|").alias("part"))


# --- ledgers

_LOG = "l AS (SELECT event_id AS rid, event_id AS seq, user_id AS uid, CASE event_type WHEN 'error' THEN 'undo' WHEN 'click' THEN 'assign' WHEN 'view' THEN 'ignore' ELSE 'unsure' END AS action, CASE WHEN event_type = 'error' THEN event_id - 1 END AS reverts FROM events)"


@query(f"""WITH RECURSIVE {_LOG}, chain AS (SELECT rid AS root, rid, 0 AS n FROM l WHERE action <> 'undo' UNION ALL SELECT c.root, u.rid, c.n + 1 FROM chain c JOIN l u ON u.action = 'undo' AND u.reverts = c.rid),
ok AS (SELECT root FROM chain GROUP BY root HAVING max(n) % 2 = 0) SELECT uid, arg_max(CASE WHEN action = 'ignore' THEN 'ignored' ELSE 'resolved' END, seq) AS status FROM l JOIN ok ON ok.root = l.rid GROUP BY uid""")
def decided_status(spark, sf_dir):
    e, kind = A.table(spark, sf_dir, "events"), F.col("event_type")
    action = F.when(kind == "error", "undo").when(kind == "click", "assign").when(kind == "view", "ignore").otherwise("unsure")
    log = e.select(F.col("event_id").cast("string").alias("rid"), F.col("event_id").alias("event_seq"), F.array("user_id").alias("uids"), action.alias("action"), F.when(kind == "error", (F.col("event_id") - 1).cast("string")).alias("reverts"))
    return Q.statuses(log).select("uid", "status")


@query("""WITH o AS (SELECT p_partkey AS uid, CASE WHEN p_partkey % 2 = 0 THEN 'part' ELSE 'value' END AS level, CASE p_partkey % 3 WHEN 0 THEN 'anodized' WHEN 1 THEN 'plated' ELSE 'burnished' END AS part, CASE p_size % 4 WHEN 0 THEN 'copper' WHEN 1 THEN 'steel' WHEN 2 THEN 'tin' ELSE 'copper' END AS material FROM part)
SELECT uid FROM o WHERE CASE WHEN level = 'value' THEN material NOT IN ('copper', 'steel') ELSE part NOT IN ('anodized', 'plated') END""")
def still_open(spark, sf_dir):
    p, n = A.table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(n.alias("uid"), F.when(n % 2 == 0, "part").otherwise("value").alias("level_guess"), *_words(n))
    return Q.still_open(rows, _catalogue(spark)).select("uid")


@query("WITH a AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS p FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) END AS n, NULL AS p FROM customer WHERE c_custkey % 4 <> 0) SELECT coalesce(a.k, b.k) AS k, coalesce(b.n, a.n) AS n, coalesce(b.p, a.p) AS p FROM a FULL JOIN b ON a.k = b.k")
def upsert_coalesce(spark, sf_dir):
    c, k = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    known = c.filter(k % 3 != 0).select(k.alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("p"))
    found = c.filter(k % 4 != 0).select(k.alias("k"), F.when(k % 2 == 0, F.upper("c_mktsegment")).alias("n"), F.lit(None).cast("string").alias("p"))
    return H.upsert_coalesce(known, found, ["k"])


@query("SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def insert_if_absent(spark, sf_dir):
    c, k = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    return H.insert_if_absent(c.filter(k % 3 == 0).select(k.alias("k"), F.col("c_name").alias("n")), c.filter(k % 2 == 0).select(k.alias("k"), F.lit("new").alias("n")), ["k"])


@query("SELECT o_custkey AS detail_id, arg_max(o_orderkey, row(CAST(o_orderdate AS DATE), o_orderkey)) AS commit_seq FROM orders GROUP BY ALL")
def latest_details(spark, sf_dir):
    from ..operators.tree import current_details

    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("detail_id"), F.col("o_orderkey").alias("commit_seq"), F.to_date("o_orderdate").alias("commit_date"))
    return current_details(o).select("detail_id", "commit_seq")


# --- tree search

_DETAILS = """c AS (SELECT l_orderkey AS detail_id, 'component.r' || n_regionkey AS a, 'part.n' || n_nationkey AS b, 'value.q' || CAST(l_linenumber AS VARCHAR) AS v, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rnk FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def _details(spark, sf_dir):
    li, s, n = A.table(spark, sf_dir, "lineitem"), A.table(spark, sf_dir, "supplier"), A.table(spark, sf_dir, "nation")
    place = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.concat(F.lit("component.r"), "n_regionkey").alias("a"), F.concat(F.lit("part.n"), "n_nationkey").alias("b"))
    rows = li.join(place, li.l_suppkey == place.s_suppkey)
    sure = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    path = F.array("a", "b", F.concat(F.lit("value.q"), F.col("l_linenumber").cast("string")))
    by = rows.groupBy(F.col("l_orderkey").alias("detail_id")).agg(F.array_sort(F.collect_list(F.struct(path.alias("path"), sure.alias("confidence")))).alias("classifications"))
    return by.withColumns({"title": F.lit("t"), "drawing": F.col("detail_id") % 10, "thumbnail": F.lit(None).cast("string"), "commit_date": F.lit("2024-01-01"), "provenance_status": F.lit("unknown"), "reusable": F.lit(True)})


def _down(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("component.r"), "n_regionkey").alias("parent"), F.concat(F.lit("part.n"), "n_nationkey").alias("child"))


@query(f"""WITH {_DETAILS}, m AS (SELECT detail_id, min(rnk) AS r FROM c WHERE a = 'component.r1' GROUP BY ALL) SELECT detail_id, CASE r WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, (SELECT count(*) FROM c x WHERE x.detail_id = m.detail_id) AS total,
  (SELECT count(*) FROM c x WHERE x.detail_id = m.detail_id AND rnk = 0) AS highs, (SELECT count(DISTINCT e) FROM (SELECT unnest([a, b, v]) AS e FROM c x WHERE x.detail_id = m.detail_id AND a = 'component.r1')) AS matched FROM m""")
def tree_search(spark, sf_dir):
    from ..operators.tree import search

    found = search(_details(spark, sf_dir), _down(spark, sf_dir), "component.r1")
    return found.select("detail_id", "confidence", F.col("total_classifications").cast("long").alias("total"), F.col("highs").cast("long").alias("highs"), F.size("matched_nodes").cast("long").alias("matched"))


@query(f"""WITH {_DETAILS}, d AS (SELECT DISTINCT detail_id, a, b, v FROM c), k AS (SELECT DISTINCT detail_id, a FROM d WHERE b = 'part.n3'),
off AS (SELECT k.detail_id, count(DISTINCT d.b) AS parts, count(DISTINCT d.b || d.v) AS leaves FROM k JOIN d ON d.detail_id = k.detail_id AND d.a = k.a AND d.b <> 'part.n3' GROUP BY ALL)
SELECT k.detail_id, 2 + (SELECT count(DISTINCT v) FROM d WHERE d.detail_id = k.detail_id AND b = 'part.n3') AS kept, coalesce(parts, 0) AS parts, coalesce(leaves, 0) AS nodes FROM k LEFT JOIN off ON off.detail_id = k.detail_id""")
def pruned_details(spark, sf_dir):
    from ..operators.tree import pruned_forests

    rows = _details(spark, sf_dir).select("detail_id", F.explode("classifications").alias("c")).select("detail_id", "c.path")
    below = spark.createDataFrame([("part.n3",)], "node string")
    kept = pruned_forests(rows, below)
    return kept.groupBy("detail_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("collapsed_parts").alias("parts"), F.sum("collapsed_nodes").alias("nodes"))


@query(f"WITH {_DETAILS}, f AS (SELECT DISTINCT detail_id FROM c WHERE b = 'part.n3') SELECT a AS component, count(DISTINCT detail_id % 10) AS drawings FROM c WHERE detail_id IN (SELECT detail_id FROM f) GROUP BY a")
def search_facets(spark, sf_dir):
    from ..operators import tree

    details, edges = _details(spark, sf_dir), _down(spark, sf_dir)
    return tree.facets(tree.search(details, edges, "part.n3"), details, edges)


@query("SELECT drawing, detail_id, count(DISTINCT said) AS matches FROM (SELECT 'd' || (o_custkey % 50) AS drawing, 't' || (o_custkey % 200) AS detail_id, md5(CAST(o_custkey % 97 AS VARCHAR)) AS said FROM orders) WHERE contains(said, 'ab') GROUP BY ALL")
def unclassified(spark, sf_dir):
    from ..operators.tree import unclassified

    return unclassified(A.occurrences(spark, sf_dir), " AB ").select("drawing", "detail_id", F.size("matches").cast("long").alias("matches"))


# --- history


@query(f"""WITH {_H}, c AS (SELECT a.drawing, a.element_id, a.commit_seq, b.element_id IS NOT NULL AS seen, abs(a.value - b.value) > 20 AS moved, floor(a.value) <> floor(b.value) AS changed FROM h a LEFT JOIN h b ON a.drawing = b.drawing AND a.element_id = b.element_id AND b.commit_seq = a.commit_seq - 1)
SELECT drawing, CASE WHEN NOT seen THEN 'new' WHEN moved AND changed THEN 'moved+value_changed' WHEN moved THEN 'moved' WHEN changed THEN 'value_changed' ELSE 'unchanged' END AS status, count(*) AS n FROM c GROUP BY ALL""")
def element_status(spark, sf_dir):
    from ..operators.identity import change_status

    h = A.snapshots(spark, sf_dir)
    geom = F.struct(F.col("value").alias("x"), F.lit(0.0).alias("y"), F.array(F.col("value"), F.lit(0.0), F.col("value"), F.lit(0.0)).alias("bbox"))
    none = F.lit(None).cast("string")
    parsed = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("material", "string"), ("value", "double"), ("unit", "string"), ("qualifier", "string"), ("profile", "string"), ("dims", "array<double>"), ("r_value", "double"), ("part", "string"))])
    rows = h.select("drawing", "element_id", "commit_seq", geom.alias("geom"), F.floor("value").cast("string").alias("text_raw"), parsed.alias("parsed"), none.alias("hatch_pattern"), F.lit(None).cast("double").alias("dim_measurement"), none.alias("dim_override"))
    found = H.with_status(rows, status=lambda now, before: change_status(now, before, 20.0)).filter("status <> 'deleted'")
    return found.groupBy("drawing", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_H}, k AS (SELECT DISTINCT drawing, commit_seq FROM h WHERE NOT (drawing = 'click' AND commit_seq BETWEEN 5 AND 7)) SELECT drawing, commit_seq + 1 AS commit_seq FROM k WHERE commit_seq < (SELECT max(commit_seq) FROM h) AND NOT EXISTS (SELECT 1 FROM k z WHERE z.drawing = k.drawing AND z.commit_seq = k.commit_seq + 1)")
def vanished_drawings(spark, sf_dir):
    h = A.snapshots(spark, sf_dir)
    kept = h.filter(~((F.col("drawing") == "click") & F.col("commit_seq").between(5, 7)))
    return H.vanished_drawings(kept, h.select("commit_seq").distinct())


@query(f"WITH {_STATUS} SELECT drawing, element_id, commit_seq, status FROM st WHERE commit_seq >= 4")
def indexed_increment(spark, sf_dir):
    """Commits from the fourth on, indexed as new ones behind an index of the first three (those are then left out)."""
    h = A.snapshots(spark, sf_dir)
    moved = lambda now, before: F.when(F.abs(now["value"] - before["value"]) > 0.15, "value_changed").otherwise("unchanged")
    commits = h.select("commit_seq").distinct()
    first = H.with_status(h.filter("commit_seq <= 3"), status=moved)
    return H.index_new(first, h, commits, moved).filter("commit_seq >= 4").select("drawing", "element_id", "commit_seq", "status")


@query(f"WITH {_H}, a AS (SELECT * FROM h WHERE commit_seq = 3), b AS (SELECT * FROM h WHERE commit_seq = 9) SELECT coalesce(a.drawing, b.drawing) AS drawing, CASE WHEN a.element_id IS NULL THEN 'added' WHEN b.element_id IS NULL THEN 'deleted' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.drawing = b.drawing AND a.element_id = b.element_id WHERE a.value IS DISTINCT FROM b.value OR (a.value > 50) IS DISTINCT FROM (b.value > 50) GROUP BY ALL")
def changed_fields(spark, sf_dir):
    h = A.snapshots(spark, sf_dir, (3, 9)).withColumn("large", F.col("value") > 50)
    return H.changed_fields(h, 3, 9, ["value", "large"]).groupBy("drawing", "change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STATUS} SELECT drawing, count(*) FILTER (status <> 'deleted') AS total, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'deleted') AS n_deleted, 7 AS revision FROM st WHERE commit_seq = 7 GROUP BY drawing")
def ingest_summary(spark, sf_dir):
    st = _status(spark, sf_dir)
    before = st.filter("commit_seq < 7").groupBy("drawing").agg(F.max("commit_seq").alias("revision"))
    return H.ingest_summary(st.filter("commit_seq = 7"), before).select("drawing", "total", "n_new", "n_deleted", F.col("revision").cast("int").alias("revision"))


@query(f"WITH {_F} SELECT drawing, max(element_id) AS commit_seq FROM f GROUP BY drawing")
def latest_fact_commits(spark, sf_dir):
    return S.latest_fact_commits(A.facts(spark, sf_dir).withColumnRenamed("element_id", "commit_seq"))
