"""Classification paths as forests, pruned to what matches, and the search over details by a vocabulary node.

A forest is a table of path prefixes: every prefix of every path once, with the
paths below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import vocabulary as V
from .tables import small

#: Ranks of a detail's provenance.
STATUS_RANK = {"as_built": 0, "approved": 1, "concept": 2}


def forest(paths: DataFrame, hit: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, prefix, depth, node, paths, hits) of all prefixes of the paths (array column path, empty and null ones left out); hit says which paths count."""
    rows = paths.filter("size(path) > 0").select(*keys, "path", hit.alias("hit")).withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("path"))))
    prefix = rows.withColumn("prefix", F.slice("path", 1, F.col("depth")))
    by = prefix.groupBy(*keys, "prefix", "depth").agg(F.count(F.lit(1)).alias("paths"), F.count_if("hit").alias("hits"))
    return by.select(*keys, "prefix", "depth", F.element_at("prefix", -1).alias("node"), "paths", "hits")


def prune(tree: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Prefixes with hits, each with the number of its children that have none (collapsed)."""
    parent = F.slice("prefix", 1, F.greatest(F.col("depth") - 1, F.lit(1)))
    empty = tree.filter("hits = 0 AND depth > 1").groupBy(*keys, parent.alias("prefix")).agg(F.count(F.lit(1)).alias("collapsed"))
    return tree.filter("hits > 0").join(empty, [*keys, "prefix"], "left").withColumn("collapsed", F.coalesce("collapsed", F.lit(0)).cast("long"))


def pruned_forests(classified: DataFrame, below: DataFrame) -> DataFrame:
    """(detail_id, prefix, depth, node, matched, collapsed_parts, collapsed_nodes, collapsed_classifications) of details that match.

    classified: detail_id, path, ...; below (node): nodes that match (the query
    node and all under it).  A node that matches keeps its whole subtree;
    others stay only above a match.  Off-chain siblings are counted at their
    parent: parts of a part's subtree as parts, all else as nodes.
    """
    wanted = small(below.select("node", F.lit(True).alias("m")))
    rows = classified.filter("size(path) > 0").select("detail_id", "path", F.posexplode("path").alias("pos", "node")).join(wanted, "node", "left")
    flags = rows.groupBy("detail_id", "path").agg(F.min(F.when(F.col("m"), F.col("pos"))).alias("first"), F.count(F.lit(1)).alias("dup"))
    ups = F.explode(F.sequence(F.lit(1), F.size("path")))
    prefix = flags.select("detail_id", "path", "first", (F.col("dup") / F.size("path")).cast("long").alias("times"), ups.alias("depth")).withColumn("prefix", F.slice("path", 1, F.col("depth")))
    by = prefix.groupBy("detail_id", "prefix", "depth").agg(F.min("first").alias("first"), F.sum(F.when(F.size("path") == F.col("depth"), F.col("times")).otherwise(0)).alias("own"))
    by = by.withColumn("node", F.element_at("prefix", -1)).join(wanted, "node", "left").withColumn("matched", F.coalesce("m", F.lit(False))).drop("m")
    # kept: a match below, or a match at or above
    keep = F.coalesce(F.col("first") >= 0, F.lit(False))
    kept = by.filter(keep)
    gone = by.filter(~keep)
    parent = F.slice("prefix", 1, F.greatest(F.col("depth") - 1, F.lit(1)))
    # the highest dropped prefix hangs at a kept one
    tops = gone.filter("depth > 1").withColumn("at", parent).join(kept.select("detail_id", F.col("prefix").alias("at")), ["detail_id", "at"], "left_semi").select("detail_id", "at", F.col("prefix").alias("top"), F.col("depth").alias("top_depth"), F.col("node").startswith("part.").alias("is_part"))
    under = gone.select("detail_id", F.col("prefix").alias("p"), "node", "own", F.explode(F.sequence(F.lit(2), F.greatest(F.col("depth"), F.lit(2)))).alias("top_depth")).filter(F.size("p") >= F.col("top_depth")).withColumn("top", F.slice("p", 1, F.col("top_depth")))
    counted = tops.join(under, ["detail_id", "top", "top_depth"])
    part = F.col("is_part") & F.col("node").startswith("part.")
    sums = counted.groupBy("detail_id", F.col("at").alias("prefix")).agg(F.count_if(part).alias("collapsed_parts"), F.count_if(~part).alias("collapsed_nodes"), F.sum("own").alias("collapsed_classifications"))
    out = kept.join(sums, ["detail_id", "prefix"], "left")
    return out.select("detail_id", "prefix", "depth", "node", "matched", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("collapsed_parts", "collapsed_nodes", "collapsed_classifications")])


def current_details(details: DataFrame) -> DataFrame:
    """Each detail's latest record, by date and then by commit."""
    w = Window.partitionBy("detail_id").orderBy(F.desc("commit_date"), F.desc("commit_seq"))
    return details.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def search(details: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Details with a path at or below the node, best first: confidence, provenance, reusable, sure paths, newest.

    details: detail_id, title, drawing, commit_date, provenance_status,
    reusable, thumbnail, classifications (array of structs with path and
    confidence).  Returns them with confidence, matched_nodes, highs and
    total_classifications.
    """
    below = small(V.descendants(edges, details.sparkSession.createDataFrame([(node,)], "seed string")).select("node"))
    rows = details.select("detail_id", F.posexplode("classifications").alias("k", "c")).select("detail_id", "k", "c.path", "c.confidence")
    hit = rows.select("detail_id", "k", F.explode("path").alias("node")).join(below, "node", "left_semi").select("detail_id", "k").distinct()
    by = rows.join(hit, ["detail_id", "k"]).groupBy("detail_id").agg(F.min(confidence_rank(F.col("confidence"))).alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("path")))).alias("matched_nodes"))
    name = F.when(F.col("rank") == 0, "high").when(F.col("rank") == 1, "medium").otherwise("low")
    status = F.coalesce(*[F.when(F.col("provenance_status") == k, n) for k, n in STATUS_RANK.items()], F.lit(3))
    found = details.join(by, "detail_id").withColumn("confidence", name).withColumn("highs", F.size(F.filter("classifications", lambda c: c["confidence"] == "high"))).withColumn("total_classifications", F.size("classifications"))
    shown = found.withColumn("status_rank", status).withColumn("rank", confidence_rank(F.col("confidence")))
    return ranked(shown).select("detail_id", "title", F.col("drawing").alias("source_sheet"), "thumbnail", "confidence", "commit_date", "matched_nodes", "total_classifications", "highs")


def ranked(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows by rank, status_rank, reusable first, most highs, newest, and detail_id."""
    out = found.orderBy("rank", "status_rank", F.when(F.coalesce("reusable", F.lit(False)), 0).otherwise(1), F.desc("highs"), F.desc("commit_date"), "detail_id")
    return out if limit is None else out.limit(limit)


def facets(found: DataFrame, details: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, drawings): distinct drawings of the found details with a path at or below each component."""
    rows = details.join(found.select("detail_id"), "detail_id", "left_semi").select("drawing", F.explode("classifications").alias("c")).select("drawing", F.explode("c.path").alias("node"))
    counts = V.facet_counts(rows, "node", V.closure(edges))
    return counts.filter(F.col("ancestor").startswith("component.")).select(F.col("ancestor").alias("component"), "drawings").orderBy("component")


def unclassified(open_occurrences: DataFrame, query: str, clusters: DataFrame | None = None) -> DataFrame:
    """(drawing, detail_id, matches, cluster_ids): open occurrences whose text holds the query."""
    q = " ".join(query.lower().split()) if query.strip() else None
    holds = F.lit(False) if q is None else F.contains(F.lower("raw_string"), F.lit(query.lower().strip())) | F.contains(F.col("normalised"), F.lit(query.lower().strip()))
    rows = open_occurrences.filter(F.coalesce(holds, F.lit(False)))
    by = rows.groupBy("drawing", "detail_id").agg(F.array_sort(F.collect_set("raw_string")).alias("matches"))
    if clusters is not None:
        uids = clusters.select("cluster_id", F.explode("uids").alias("uid"))
        ids = rows.join(uids, "uid").groupBy("drawing", "detail_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"))
        by = by.join(ids, ["drawing", "detail_id"], "left")
    return by.orderBy("drawing", "detail_id")


def expand(details: DataFrame, detail_id: str) -> DataFrame:
    """The full forest of one detail: (prefix, depth, node, label-like name, paths)."""
    one = details.filter(F.col("detail_id") == detail_id).select(F.explode("classifications").alias("c")).select("c.path")
    return forest(one, F.lit(True)).withColumn("label", X.squeeze(F.regexp_replace(F.regexp_replace("node", r"^[^.]*\.", ""), "_", " "))).drop("hits").orderBy("prefix")
