"""Registered queries of the engine's operators over the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Words
from ..functions import geometry as G
from ..functions import text as X
from ..operators import history as H
from ..operators import search as S
from ..operators import vocabulary as V
from ..sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_H = """days AS (SELECT day, row_number() OVER (ORDER BY day) AS commit_seq FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
h AS (SELECT event_type AS drawing, CAST(commit_seq AS INTEGER) AS commit_seq, user_id AS element_id, arg_max(value, row(ts, event_id)) AS value
      FROM events JOIN days ON CAST(ts AS DATE) = day GROUP BY ALL)"""
_STATUS = (
    _H
    + """, st AS (SELECT c.drawing, c.element_id, c.commit_seq, c.value, CASE WHEN p.element_id IS NULL THEN 'new' WHEN abs(c.value - p.value) > 0.15 THEN 'value_changed' ELSE 'unchanged' END AS status
      FROM h c LEFT JOIN h p ON p.drawing = c.drawing AND p.element_id = c.element_id AND p.commit_seq = c.commit_seq - 1
    UNION ALL SELECT p.drawing, p.element_id, p.commit_seq + 1, p.value, 'deleted' FROM h p LEFT JOIN h c ON p.drawing = c.drawing AND p.element_id = c.element_id AND p.commit_seq = c.commit_seq - 1
      WHERE c.element_id IS NULL AND p.commit_seq < (SELECT max(commit_seq) FROM h))"""
)
_F = """li AS (SELECT l_orderkey, l_linenumber, min(row(l_partkey, l_quantity, l_returnflag, l_linestatus)) AS x FROM lineitem GROUP BY ALL),
li2 AS (SELECT l_orderkey, l_linenumber, x[1] AS pk, x[2] AS q, x[3] AS rf, x[4] AS ls FROM li),
f AS (SELECT l_orderkey AS drawing, l_linenumber AS element_id, p_type AS material, p_brand AS part, q AS value,
      CASE rf WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence, CASE ls WHEN 'F' THEN 'thickness' ELSE 'setdown' END AS measure
      FROM li2 JOIN part ON p_partkey = pk)"""
_E = """e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation
  UNION SELECT 'N' || s_nationkey, 'P' || l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
cl AS (SELECT parent AS ancestor, child AS node FROM e UNION SELECT a.parent, b.child FROM e a JOIN e b ON a.child = b.parent
  UNION SELECT parent, parent FROM e UNION SELECT child, child FROM e)"""

# Words of the driver's part names in the roles of materials, and other keyword tables.
MATERIALS = {"almond": "plywood", "antique": "plasterboard", "azure": "glass", "beige": "steel", "blue": "insulation", "burnt": "concrete", "red": "tile", "green": "membrane", "small": "fixing", "large": "panel", "part": "board"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _moved(now, before):
    return F.abs(now["value"] - before["value"]) > 0.15


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_status(A.snapshots(spark, sf_dir), _moved)


@query(f"WITH {_F} SELECT DISTINCT drawing FROM f WHERE lower(material) = 'economy' AND value BETWEEN 3 AND 10 AND confidence IN ('high', 'medium') AND measure = 'thickness'")
def find_bound_value(spark, sf_dir):
    facts = A.facts(spark, sf_dir)
    return S.find(facts, facts, ["drawing", "element_id"], material="economy", value=6.5, tolerance=3.5).select("drawing").distinct()


@query(f"WITH {_F}, b AS (SELECT drawing, count(*) AS elements, count(*) FILTER (WHERE confidence <> 'low' AND (lower(material) = 'promo' OR value = 10 AND measure = 'thickness')) AS matched, bool_or(confidence <> 'low' AND lower(material) = 'promo') AS a, bool_or(confidence <> 'low' AND value = 10 AND measure = 'thickness') AS z FROM f GROUP BY drawing) SELECT drawing, elements, matched FROM b WHERE a AND z")
def stacked_all_chips(spark, sf_dir):
    return S.stacked(A.facts(spark, sf_dir), [("material", "promo"), ("value", "10")])


@query(f"WITH {_H} SELECT drawing, commit_seq, element_id, value FROM h JOIN (SELECT drawing, max(commit_seq) AS commit_seq FROM h GROUP BY drawing) USING (drawing, commit_seq)")
def current_snapshot(spark, sf_dir):
    return H.current(A.snapshots(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT drawing, commit_seq, status, count(*) AS n, round(sum(value), 4) AS total FROM st GROUP BY ALL")
def snapshot_status(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("drawing", "commit_seq", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {_H} SELECT coalesce(a.drawing, b.drawing) AS drawing, coalesce(a.element_id, b.element_id) AS element_id, CASE WHEN a.element_id IS NULL THEN 'added' WHEN b.element_id IS NULL THEN 'deleted' ELSE 'changed' END AS change, a.value AS before, b.value AS after FROM (SELECT * FROM h WHERE commit_seq = 3) a FULL JOIN (SELECT * FROM h WHERE commit_seq = 9) b ON a.drawing = b.drawing AND a.element_id = b.element_id WHERE a.value IS DISTINCT FROM b.value")
def changed_between(spark, sf_dir):
    return H.changed_between(A.snapshots(spark, sf_dir, (3, 9)), 3, 9)


@query(f"WITH {_STATUS}, n AS (SELECT *, row_number() OVER (PARTITION BY drawing, element_id ORDER BY commit_seq) AS nth FROM st) SELECT drawing, element_id, commit_seq, value, status FROM n WHERE nth = 1 OR status <> 'unchanged'")
def element_history(spark, sf_dir):
    return H.element_history(_status(spark, sf_dir))


@query(f"WITH {_H} SELECT * FROM h WHERE commit_seq = 7")
def snapshot_at(spark, sf_dir):
    return H.at(A.snapshots(spark, sf_dir, (7,)), 7)


@query(f"WITH {_STATUS}, b AS (SELECT drawing, commit_seq, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status = 'value_changed') AS n_value_changed, count(*) FILTER (status = 'deleted') AS n_deleted, count(*) FILTER (status <> 'unchanged') AS changed FROM st GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY drawing ORDER BY commit_seq) AS revision FROM b")
def drawing_revisions(spark, sf_dir):
    return H.revisions(_status(spark, sf_dir))


@query(f"WITH {_STATUS} SELECT drawing, element_id, commit_seq, value, status FROM st JOIN (SELECT drawing, max(commit_seq) AS commit_seq FROM st GROUP BY drawing) USING (drawing, commit_seq) WHERE status = 'deleted'")
def deleted_latest(spark, sf_dir):
    return H.deleted_latest(_status(spark, sf_dir))


@query("SELECT DISTINCT p_type AS material FROM part WHERE p_type IS NOT NULL ORDER BY 1 LIMIT 500")
def distinct_suggestions(spark, sf_dir):
    return S.suggestions(A.table(spark, sf_dir, "part").select(F.col("p_type").alias("material")), "material")


@query(f"WITH {_F}, b AS (SELECT drawing, arg_min(row(element_id, material, value, confidence), row(CASE WHEN value > 20 THEN 0 ELSE 1 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, element_id)) AS b FROM f GROUP BY drawing) SELECT drawing, b[1] AS element_id, b[2] AS material, b[3] AS value, b[4] AS confidence FROM b")
def best_fact(spark, sf_dir):
    return S.best_fact(A.facts(spark, sf_dir), F.col("value") > 20)


_RECONCILE = f"""WITH {_F},
e AS (SELECT drawing, CASE WHEN element_id % 5 = 0 THEN NULL ELSE 'r' || CAST(element_id % 2 AS VARCHAR) END AS region_id, CAST(element_id AS VARCHAR) AS element_id, part, value, confidence, measure, CAST(element_id AS INTEGER) AS ord,
  CASE element_id % 4 WHEN 0 THEN 'leader' WHEN 1 THEN 'dimension' WHEN 2 THEN 'geometry' ELSE 'extension_trace' END AS chain, element_id % 4 = 0 AND value > 30 AS own, confidence = 'low' AND value > 45 AS conflict FROM f),
e2 AS (SELECT *, CASE chain WHEN 'leader' THEN 2 WHEN 'dimension' THEN 3 WHEN 'extension_trace' THEN 4 ELSE 5 END AS rnk, chain IN ('dimension', 'extension_trace') AS dim, chain = 'geometry' AS geo FROM e),
g AS (SELECT drawing, region_id, measure, CASE WHEN region_id IS NULL THEN element_id END AS alone,
  arg_min(row(element_id, part, value, confidence, chain), row(rnk, ord)) AS b,
  arg_min(row(element_id, part, value), ord) FILTER (own) AS o, arg_min(row(element_id, part, value), ord) FILTER (dim) AS d, arg_min(row(element_id, part, value), ord) FILTER (geo) AS x,
  array_to_string(list_transform(list_sort(list(DISTINCT row(rnk, chain))), lambda c: c[2]), '+') AS chains,
  array_to_string(list_transform(list_sort(list(DISTINCT row(rnk, chain)) FILTER (dim OR geo)), lambda c: c[2]), '+') AS measured,
  bool_or(chain = 'leader') AS leader, bool_or(conflict) AS item_conflict, count(*) FILTER (own OR dim) AS n, max(value) FILTER (own OR dim) - min(value) FILTER (own OR dim) AS spread
  FROM e2 GROUP BY ALL),
w AS (SELECT *, CASE WHEN o IS NOT NULL THEN 'own' WHEN abs(d[3] - x[3]) <= 0.15 THEN 'dim' WHEN leader AND x IS NOT NULL THEN 'geo' ELSE 'base' END AS which, item_conflict OR coalesce(n > 1 AND spread > 5, false) AS clash FROM g)
SELECT drawing, region_id, measure, CASE which WHEN 'own' THEN o[1] WHEN 'dim' THEN d[1] ELSE b[1] END AS element_id, CASE WHEN which = 'own' THEN coalesce(o[2], b[2]) ELSE b[2] END AS part,
  CASE which WHEN 'own' THEN o[3] WHEN 'dim' THEN d[3] WHEN 'geo' THEN x[3] ELSE b[3] END AS value,
  CASE which WHEN 'own' THEN chains WHEN 'dim' THEN CASE WHEN leader THEN 'leader+' ELSE '' END || measured WHEN 'geo' THEN 'leader+geometry' ELSE b[5] END AS chain,
  CASE WHEN clash THEN 'low' WHEN o IS NOT NULL OR (d IS NOT NULL AND x IS NOT NULL) THEN 'high' ELSE b[4] END AS confidence, CAST(clash AS INTEGER) AS conflict FROM w"""


@query(_RECONCILE)
def reconcile_evidence(spark, sf_dir):
    from ..operators.attribution import reconcile

    f, n = A.facts(spark, sf_dir), F.col("element_id")
    kind = F.when(n % 4 == 0, "leader").when(n % 4 == 1, "dimension").when(n % 4 == 2, "geometry").otherwise("extension_trace")
    none = F.lit(None).cast("string")
    e = f.select(
        "drawing", n.cast("string").alias("element_id"), F.when(n % 5 != 0, F.concat(F.lit("r"), (n % 2).cast("string"))).alias("region_id"), F.lit("ply").alias("material"), "part", "value", F.lit("mm").alias("unit"), none.alias("qualifier"), "measure", "confidence",
        kind.alias("chain"), ((F.col("confidence") == "low") & (F.col("value") > 45)).alias("conflict"), ((n % 4 == 0) & (F.col("value") > 30)).alias("leader_own_value"), F.lit(False).alias("review_needed"), none.alias("dim_uid"), n.cast("int").alias("ord"),
    )
    return reconcile(e, 5.0).select("drawing", "region_id", "measure", "element_id", "part", "value", "chain", "confidence", F.col("conflict").cast("int").alias("conflict"))


@query("WITH p AS (SELECT c.c_nationkey AS drawing, CAST(o_custkey % 2 AS INTEGER) AS dx, CAST(o_orderkey % 2 AS INTEGER) AS dy FROM orders JOIN customer c ON c_custkey = o_custkey), b AS (SELECT drawing, dx, dy, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT drawing, arg_max(row(dx, dy, n), row(n, -dx, -dy)) AS m, CAST(sum(n) AS BIGINT) AS total FROM b GROUP BY drawing) SELECT drawing, m[1] AS dx, m[2] AS dy, m[3] AS n, total FROM t WHERE total >= 3 AND m[3] >= 0.26 * total AND NOT (m[1] = 0 AND m[2] = 0)")
def modal_offset(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = o.select(F.col("c_nationkey").alias("drawing"), (F.col("o_custkey") % 2).cast("int").alias("dx"), (F.col("o_orderkey") % 2).cast("int").alias("dy"))
    return S.modal_offset(pairs, share=0.26)


@query(f"WITH {_E} SELECT ancestor, node FROM cl")
def vocab_closure(spark, sf_dir):
    return A.closed(spark, sf_dir)


@query(f"WITH {_E}, r AS (SELECT DISTINCT parent AS p FROM e WHERE parent NOT IN (SELECT child FROM e)) SELECT p AS node, p AS path FROM r UNION ALL SELECT child, parent || '>' || child FROM e JOIN r ON p = parent UNION ALL SELECT b.child, a.parent || '>' || a.child || '>' || b.child FROM e a JOIN r ON p = a.parent JOIN e b ON a.child = b.parent")
def vocab_paths(spark, sf_dir):
    return V.paths(A.edges(spark, sf_dir)).select("node", F.array_join("path", ">").alias("path"))


@query("WITH RECURSIVE a AS (SELECT n_nationkey AS alias, CAST(n_nationkey / 2 AS INTEGER) AS t FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey > 0), w AS (SELECT alias, t FROM a UNION ALL SELECT w.alias, a.t FROM w JOIN a ON a.alias = w.t) SELECT alias, min(t) AS target FROM w GROUP BY alias")
def alias_resolve(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0 AND n_nationkey > 0")
    return V.resolve_aliases(n.select(F.col("n_nationkey").alias("alias"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("target")))


@query(f"WITH {_E} SELECT l_orderkey AS drawing, count(*) AS n FROM lineitem WHERE 'P' || l_partkey IN (SELECT node FROM cl WHERE ancestor = 'N3') GROUP BY ALL")
def tree_match(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("drawing"), F.concat(F.lit("P"), "l_partkey").alias("node"))
    below = V.descendants(A.edges(spark, sf_dir), spark.createDataFrame([("N3",)], "seed string"))  # only what lies below the node asked for
    return V.matches(li, "node", below).groupBy("drawing").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_E} SELECT ancestor, count(DISTINCT l_suppkey) AS drawings FROM lineitem JOIN cl ON node = 'P' || l_partkey GROUP BY ancestor")
def facet_counts(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("drawing"), F.concat(F.lit("P"), "l_partkey").alias("node")).distinct()
    return V.facet_counts(li, "node", A.closed(spark, sf_dir))


#: Words of the driver's notes: materials by part names, parts by brands' digits are none, qualifiers and measures as added to the notes.
NOTES = Words(materials={m: [k] for k, m in MATERIALS.items()}, parts=["almond", "ply", "chocolate"], qualifiers=["nominal", "clear"], measures={"setdowns": "setdown", "setdown": "setdown", "fall": "fall", "thick": "thickness"})
_LOOK = lambda words, plural="": "CASE " + " ".join(f"WHEN regexp_matches(t, '\\b{k}{plural}\\b') THEN '{v}'" for k, v in sorted(words.items(), key=lambda x: -len(x[0]))) + " END"
_NOTE = """n AS (SELECT p_partkey AS element_id, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN 'MM ' WHEN 1 THEN ' ' WHEN 2 THEN 'CM ' ELSE ' THK ' END || upper(p_name) || CASE p_partkey % 7 WHEN 0 THEN ' SETDOWN' WHEN 1 THEN ' NOM.' WHEN 2 THEN ' FALL 1:100'
  WHEN 3 THEN ' REFER ENG. DWGS' WHEN 4 THEN ' 45X90 SHS' ELSE '' END AS text FROM part), t AS (SELECT *, lower(text) AS t FROM n)"""


@query(f"""WITH {_NOTE}, w AS (SELECT *, {_LOOK(MATERIALS)} AS mat, {_LOOK({k: k for k in NOTES.parts}, 's?')} AS part, regexp_extract(t, '\\b(shs|rhs|ub|uc|pfc|ea|ua)\\b', 1) AS shs,
  CASE WHEN regexp_matches(t, '\\bsetdowns\\b') OR regexp_matches(t, '\\bsetdown\\b') THEN 'setdown' WHEN regexp_matches(t, '\\bfall\\b') THEN 'fall' END AS measure,
  CASE WHEN regexp_matches(t, '\\bnom\\.') THEN 'nominal' END AS qualifier, CASE WHEN regexp_matches(t, '\\brefer\\b') AND regexp_matches(t, '\\beng\\b') THEN 'engineering' END AS to_,
  regexp_extract_all(t, '(\\d+(?:\\.\\d+)?)\\s*(?:mm|thk|cm|m)?\\b') AS nums FROM t),
v AS (SELECT *, coalesce(list_filter(nums, lambda x: regexp_matches(x, '(mm|thk)$'))[1], nums[1]) AS pick FROM w)
SELECT element_id, CASE WHEN shs <> '' THEN coalesce(mat, 'steel') ELSE mat END AS material, part, qualifier, measure, to_ AS delegated_to, nullif(upper(shs), '') AS profile,
  CASE WHEN shs = '' AND (mat IS NOT NULL OR measure IS NOT NULL) AND NOT coalesce(measure = 'fall', false) THEN CAST(regexp_extract(pick, '^\\d+(\\.\\d+)?') AS DOUBLE) * CASE WHEN pick LIKE '%cm' THEN 10 ELSE 1 END END AS value
FROM v WHERE mat IS NOT NULL OR part IS NOT NULL OR measure IS NOT NULL OR shs <> '' """)
def parse_annotation(spark, sf_dir):
    said = X.parse(F.col("text"), NOTES)
    rows = A.notes(spark, sf_dir).withColumn("p", said).filter("p IS NOT NULL AND p.bare_to IS NULL")
    rows = rows.select("element_id", "p.material", "p.part", "p.qualifier", "p.measure", "p.delegated_to", "p.profile", "p.value")
    return rows.filter("coalesce(material, part, measure, profile) IS NOT NULL")


@query("SELECT doc_id, array_to_string(list_sort(r), '|') AS refs FROM (SELECT doc_id, list_distinct(regexp_extract_all(upper(text), '\\b(TRASH|IDIOT|MORON|LOSER|CLOWN)\\b', 1)) AS r FROM documents) WHERE len(r) > 0")
def extract_refs(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", X.references(F.col("text"), r"\b(TRASH|IDIOT|MORON|LOSER|CLOWN)\b").alias("r"))
    return d.filter(F.size("r") > 0).select("doc_id", F.array_join(F.array_sort("r"), "|").alias("refs"))


@query("SELECT l_orderkey AS drawing, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS factor, CASE WHEN max(l_quantity) - min(l_quantity) > 0.01 * min(l_quantity) THEN 1 ELSE 0 END AS conflict FROM lineitem GROUP BY ALL")
def scale_consensus(spark, sf_dir):
    by = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("drawing")).agg(G.upper_median(F.collect_list("l_quantity")).alias("factor"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return by.select("drawing", "factor", F.when(F.col("hi") - F.col("lo") > 0.01 * F.col("lo"), 1).otherwise(0).alias("conflict"))


@query("SELECT c_custkey AS element_id, CASE WHEN c_acctbal > 1000 AND c_acctbal < 5000 AND c_nationkey + 0.5 > 3 AND c_nationkey + 0.5 < 20 THEN 1 ELSE 0 END AS inside FROM customer")
def point_in_region(spark, sf_dir):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    box = F.array(corner(1000, 3), corner(5000, 3), corner(5000, 20), corner(1000, 20))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("element_id"), G.contains(box, F.col("c_acctbal"), F.col("c_nationkey") + 0.5).cast("int").alias("inside"))



@query("WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, CAST(len(list_filter(v, lambda x: x > list_sum(v) / 64)) AS INTEGER) AS ones FROM b")
def average_hash_bits(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", G.average_hash(F.col("embedding").cast("array<double>")).alias("h"))
    return e.select("vec_id", F.bit_count("h").alias("ones"))


@query("SELECT o_orderkey AS detail_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, o_custkey % 3 AS highs, CAST(o_orderdate AS DATE) AS commit_date FROM orders ORDER BY rank, CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END, highs DESC, commit_date DESC, o_orderkey LIMIT 25")
def tree_rank(spark, sf_dir):
    from ..operators.tree import ranked

    o = A.table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = o.select(F.col("o_orderkey").alias("detail_id"), rank.alias("rank"), (F.col("o_custkey") % 4).alias("status_rank"), (F.col("o_custkey") % 2 == 0).alias("reusable"), (F.col("o_custkey") % 3).alias("highs"), F.to_date("o_orderdate").alias("commit_date"))
    return ranked(rows, 25).select("detail_id", "rank", "highs", "commit_date")


_CLUSTERS = """o AS (SELECT 'u_' || o_orderkey AS uid, CASE WHEN o_orderkey % 3 = 0 THEN 'value' ELSE 'part' END AS level, md5(CAST(o_custkey % 97 AS VARCHAR)) AS said, 'd' || (o_custkey % 50) AS drawing, 't' || (o_custkey % 200) AS detail_id,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS seen FROM orders), c AS (SELECT level || '|' || said AS cluster_key, said AS label, level, count(*) AS n, min(seen) AS oldest, max(seen) AS newest, count(DISTINCT drawing) AS drawings, count(DISTINCT detail_id) AS details FROM o GROUP BY ALL)"""


def _queue(spark, sf_dir):
    from ..operators.review import clusters
    from ..sources.files import vocabulary_nodes
    from ..vocabulary import Vocabulary

    nodes = vocabulary_nodes(spark, Vocabulary([{"id": "attr.note", "level": "attribute", "label": "Note", "definition": "d", "value_type": "free_text"}]))
    return clusters(A.occurrences(spark, sf_dir), nodes), nodes


@query(f"WITH {_CLUSTERS} SELECT cluster_key, label, level AS level_guess, n AS occurrence_count, details, oldest FROM c")
def review_clusters(spark, sf_dir):
    return _queue(spark, sf_dir)[0].select("cluster_key", "label", "level_guess", "occurrence_count", F.size(F.array_distinct(F.transform("places", lambda p: p["detail_id"]))).cast("long").alias("details"), "oldest")


@query(f"WITH {_CLUSTERS} SELECT count(*) FILTER (newest >= '1998-06-01') AS new_clusters, count(*) AS pending_total, CAST(sum(n) AS BIGINT) AS pending_occurrences, min(oldest) AS oldest_pending, count(*) FILTER (n >= 20) AS high_impact FROM c")
def digest(spark, sf_dir):
    from ..operators.review import digest

    return digest(_queue(spark, sf_dir)[0], "1998-06-01", 20)


@query(f"WITH {_CLUSTERS} SELECT 'value.' || said AS node_id, n AS occurrence_count FROM (SELECT label AS said, n FROM c WHERE level = 'value' AND n >= 10 AND drawings >= 3)")
def auto_promotion(spark, sf_dir):
    from ..operators.review import to_promote

    queue, nodes = _queue(spark, sf_dir)
    return to_promote(queue, nodes, enabled=True).select("node_id", "occurrence_count")


@query(f"WITH {_CLUSTERS}, t AS (SELECT n FROM c ORDER BY n DESC, label LIMIT 5) SELECT (SELECT count(*) FROM t) AS clusters, greatest(0, count(*) - 5) AS more, count(*) AS pending_total, count(*) > 50 AS banner FROM c")
def notification(spark, sf_dir):
    from ..operators.review import notification

    queue, _ = _queue(spark, sf_dir)
    return notification(queue, queue).select(F.size("clusters").cast("long").alias("clusters"), F.col("more").cast("long").alias("more"), "pending_total", "banner")


@query("WITH s AS (SELECT event_id AS rid, user_id AS uid, event_type, CASE WHEN event_type = 'error' THEN event_id - 1 END AS reverts FROM events) SELECT uid, arg_max(event_type, rid) AS status FROM s WHERE event_type <> 'error' AND rid NOT IN (SELECT reverts FROM s WHERE reverts IS NOT NULL) GROUP BY uid")
def review_status(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    undo = F.col("event_type") == "error"
    log = e.select(F.col("event_id").alias("rid"), F.col("event_id").alias("event_seq"), F.col("user_id").alias("uid"), F.when(undo, "undo").otherwise(F.col("event_type")).alias("action"), F.when(undo, F.col("event_id") - 1).alias("reverts"))
    from ..operators.review import effective_status

    return effective_status(log)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_write_wins(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return H.last_write_wins(e, ["user_id"], "event_id")


@query("SELECT p_partkey AS node_id, p_name AS label, CAST(0.85 AS DOUBLE) AS score FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey LIMIT 25")
def vocab_search(spark, sf_dir):
    nodes = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("label"), F.lit("part").alias("level"), F.array().cast("array<string>").alias("synonyms"), F.col("p_partkey").alias("ord"))
    # names of several words are too unlike the query to count by likeness
    return V.vocabulary_search(nodes, "ring").select("node_id", "label", "score")


@query("WITH o AS (SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 3 = 0 THEN 'value' ELSE 'part' END AS level, md5(CAST(o_custkey % 97 AS VARCHAR)) AS said FROM orders) SELECT uid, level || '|' || said AS cluster_key FROM o")
def cluster_occurrences(spark, sf_dir):
    from ..operators.review import cluster

    return cluster(A.occurrences(spark, sf_dir)).select(F.col("uid").cast("long").alias("uid"), "cluster_key")


@query(f"WITH {_H}, a AS (SELECT * FROM h WHERE commit_seq = 9), b AS (SELECT * FROM h WHERE commit_seq = 8) SELECT a.drawing, CAST(a.element_id AS VARCHAR) AS handle, CASE WHEN b.element_id IS NULL THEN 'new' ELSE 'handle' END AS tier, CASE WHEN b.element_id IS NULL THEN 'new' WHEN abs(round(a.value, 1) - round(b.value, 1)) > 0 THEN 'value_changed' ELSE 'unchanged' END AS status, CASE WHEN b.element_id IS NOT NULL THEN 'e_' || a.element_id END AS known_id FROM a LEFT JOIN b ON a.drawing = b.drawing AND a.element_id = b.element_id")
def entity_resolution(spark, sf_dir):
    from ..operators.identity import resolve

    h = A.snapshots(spark, sf_dir, (8, 9))
    now, before = A.elements(H.at(h, 9)), A.elements(H.at(h, 8)).withColumn("element_id", F.concat(F.lit("e_"), "dxf_handle"))
    found = resolve(now, before)
    known = F.when(F.col("match_tier") == "handle", F.col("element_id"))
    return found.select("drawing", F.col("dxf_handle").alias("handle"), F.col("match_tier").alias("tier"), "status", known.alias("known_id"))


@query("WITH b AS (SELECT s_nationkey AS drawing, s_suppkey AS element_id, s_acctbal AS lo, s_acctbal + 5 AS hi FROM supplier), g AS (SELECT *, CASE WHEN lo - max(hi) OVER (PARTITION BY drawing ORDER BY lo, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 25 THEN 0 ELSE 1 END AS starts FROM b), i AS (SELECT *, sum(starts) OVER (PARTITION BY drawing ORDER BY lo, element_id) AS k FROM g) SELECT drawing, element_id, min(element_id) OVER (PARTITION BY drawing, k) AS island FROM i")
def islands(spark, sf_dir):
    from ..operators.identity import content_islands

    boxes = A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("drawing"), F.col("s_suppkey").alias("element_id"), F.array(F.col("s_acctbal"), F.lit(0.0), F.col("s_acctbal") + 5, F.lit(5.0)).alias("bbox"))
    return content_islands(boxes, 25.0)


@query(f"WITH {_STATUS}, l AS (SELECT drawing, max(commit_seq) AS top FROM st GROUP BY drawing), fa AS (SELECT drawing, element_id, count(*) AS n, min(rank_value) AS low FROM (SELECT event_type AS drawing, user_id AS element_id, event_id AS rank_value FROM events) GROUP BY ALL) SELECT drawing, element_id, commit_seq, status, CAST(commit_seq = top AND status <> 'deleted' AS INTEGER) AS is_current, CAST(commit_seq = top AND status = 'deleted' AS INTEGER) AS is_deleted_latest, CAST(coalesce(n, 0) AS INTEGER) AS facts, low AS first_fact FROM st JOIN l USING (drawing) LEFT JOIN fa USING (drawing, element_id)")
def report_rows(spark, sf_dir):
    from ..operators.report import report_rows

    facts = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("drawing"), F.col("user_id").alias("element_id"), F.col("event_id").alias("fact_id"))
    rows = report_rows(_status(spark, sf_dir), facts)
    return rows.select("drawing", "element_id", "commit_seq", "status", F.col("is_current").cast("int").alias("is_current"), F.col("is_deleted_latest").cast("int").alias("is_deleted_latest"), F.size("facts").alias("facts"), F.get("facts", F.lit(0))["fact_id"].alias("first_fact"))


_TREE = """p AS (SELECT l_linestatus AS a, l_returnflag AS b, CAST(l_linenumber AS VARCHAR) AS c, l_quantity > 49 AND l_linenumber = 3 AS hit FROM lineitem),
nodes AS (SELECT a AS prefix, 1 AS depth, CAST(NULL AS VARCHAR) AS parent, a AS node, count(*) AS paths, count(*) FILTER (hit) AS hits FROM p GROUP BY ALL
UNION ALL SELECT a || '>' || b, 2, a, b, count(*), count(*) FILTER (hit) FROM p GROUP BY a, b
UNION ALL SELECT a || '>' || b || '>' || c, 3, a || '>' || b, c, count(*), count(*) FILTER (hit) FROM p GROUP BY a, b, c)"""


def _forest(spark, sf_dir):
    from ..operators import tree

    li = A.table(spark, sf_dir, "lineitem").select(F.array("l_linestatus", "l_returnflag", F.col("l_linenumber").cast("string")).alias("path"), "l_quantity", "l_linenumber")
    return tree.forest(li, (F.col("l_quantity") > 49) & (F.col("l_linenumber") == 3))


@query(f"WITH {_TREE} SELECT prefix, depth, node, paths, hits FROM nodes")
def forest(spark, sf_dir):
    return _forest(spark, sf_dir).withColumn("prefix", F.array_join("prefix", ">"))


@query(f"WITH {_TREE} SELECT n.prefix, n.depth, n.node, n.paths, n.hits, (SELECT count(*) FROM nodes c WHERE c.parent = n.prefix AND c.hits = 0) AS collapsed FROM nodes n WHERE hits > 0")
def pruned_tree(spark, sf_dir):
    from ..operators import tree

    return tree.prune(_forest(spark, sf_dir)).withColumn("prefix", F.array_join("prefix", ">"))


def _customers(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("drawing"), F.col("c_custkey").alias("point_id"), (F.col("c_acctbal") / 10).alias("x"), F.lit(0.5).alias("y"))


@query("WITH d AS (SELECT c_nationkey AS drawing, c_custkey AS point_id, s_suppkey AS vertex_id, sqrt((s_acctbal / 10 - c_acctbal / 10) * (s_acctbal / 10 - c_acctbal / 10)) AS dist FROM customer JOIN supplier ON c_nationkey = s_nationkey) SELECT drawing, point_id, arg_min(vertex_id, row(round(dist, 6), -vertex_id)) AS vertex_id, round(min(dist), 6) AS dist FROM d WHERE dist <= 20 GROUP BY ALL")
def snap_points(spark, sf_dir):
    from ..operators.attribution import snap

    v = A.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("drawing"), F.col("s_suppkey").alias("vertex_id"), (F.col("s_acctbal") / 10).alias("tx"), F.lit(0.5).alias("ty"))
    return snap(_customers(spark, sf_dir), v, 20.0).select("drawing", "point_id", "vertex_id", F.round("dist", 6).alias("dist"))


@query("WITH c AS (SELECT c_nationkey AS drawing, c_custkey AS point_id, c_acctbal / 10 AS x FROM customer), r AS (SELECT s_nationkey AS drawing, s_suppkey AS region_id, s_acctbal / 10 AS lo, s_acctbal / 10 + 40 AS hi FROM supplier) SELECT c.drawing, point_id, min(region_id) AS region_id FROM c LEFT JOIN r ON c.drawing = r.drawing AND x >= lo - 0.5 AND x <= hi + 0.5 GROUP BY ALL")
def region_of_point(spark, sf_dir):
    from ..operators.attribution import regions_at

    s = A.table(spark, sf_dir, "supplier")
    corner = lambda dx, y: F.struct((F.col("s_acctbal") / 10 + dx).alias("x"), F.lit(float(y)).alias("y"))
    poly = F.array(corner(0.0, 0), corner(40.0, 0), corner(40.0, 1), corner(0.0, 1))
    r = s.select(F.col("s_nationkey").alias("drawing"), F.col("s_suppkey").alias("region_id"), poly.alias("poly"))
    return regions_at(_customers(spark, sf_dir), r).select("drawing", "point_id", "region_id")


from . import more  # noqa: E402, F401  registers further queries
