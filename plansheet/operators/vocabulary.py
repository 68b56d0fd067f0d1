"""The vocabulary graph as DataFrames: closure, paths, aliases, names, search, duplicates, validation and upkeep.

Edges are rows (parent, child); a node may have several parents.  Closure and
paths run until nothing new turns up, however deep the graph is.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import reading as R
from ..functions import text as X
from ..vocabulary import PREFIX
from .tables import cut, small


def edges_of(nodes: DataFrame) -> DataFrame:
    """(parent, child) of nodes (node_id, parents, ...)."""
    return nodes.select(F.explode("parents").alias("parent"), F.col("node_id").alias("child"))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node) of every node and all above it, itself included.

    Each round joins what is known with itself and so doubles the reach; rounds
    grow as the logarithm of the depth, and a circle ends like any graph.
    """
    own = edges.select(F.explode(F.array("parent", "child")).alias("ancestor")).select("ancestor", F.col("ancestor").alias("node"))
    known = cut(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node")).unionByName(own).distinct())
    size = known.count()
    while True:
        ahead = known.select(F.col("ancestor").alias("node"), F.col("node").alias("next"))
        more = cut(known.join(ahead, "node").select("ancestor", F.col("next").alias("node")).distinct())
        if (now := more.count()) == size:
            return more
        known, size = more, now


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) of all nodes at or below the seeds (one column): only their part of the graph is walked."""
    (name,) = seeds.columns
    known = front = seeds.select(F.col(name).alias("seed"), F.col(name).alias("node")).distinct()
    while True:
        step = front.join(edges.withColumnRenamed("parent", "node"), "node").select("seed", F.col("child").alias("node")).distinct()
        front = cut(step.join(known, ["seed", "node"], "left_anti"))
        if not front.limit(1).count():
            return known
        known = known.unionByName(front)


def paths(edges: DataFrame) -> DataFrame:
    """(node, path) of every way from a node without parents down to each node; a way doesn't go round a circle."""
    roots = edges.select("parent").join(edges.select(F.col("child").alias("parent")), "parent", "left_anti").distinct()
    front = roots.select(F.col("parent").alias("node"), F.array("parent").alias("path"))
    found = front
    while True:
        step = front.join(edges.withColumnRenamed("parent", "node"), "node").filter(~F.array_contains("path", F.col("child")))
        front = cut(step.select(F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path")))
        if not front.limit(1).count():
            return found
        found = found.unionByName(front)


def cycles(edges: DataFrame) -> DataFrame:
    """(node) on a circle: what is below itself by one step or more."""
    below = closure(edges)
    return edges.join(below, (edges.child == below.ancestor) & (edges.parent == below.node)).select(F.col("parent").alias("node")).distinct()


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, target) at the end of each chain; in a circle, the first name that is met again."""
    step = aliases.select(F.col("alias").alias("at"), F.col("target").alias("next"))
    walk = aliases.select("alias", F.col("target").alias("at"), F.array("alias").alias("seen"))
    done = []
    while True:
        ahead = walk.join(step, "at", "left")
        ends = F.col("next").isNull() | (F.col("next") == F.col("at")) | F.array_contains("seen", F.col("at"))
        ahead = cut(ahead.withColumn("ends", ends))
        done.append(ahead.filter("ends").select("alias", F.col("at").alias("target")))
        walk = ahead.filter("NOT ends").select("alias", F.col("next").alias("at"), F.concat("seen", F.array("at")).alias("seen"))
        if not walk.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def matches(rows: DataFrame, column: str, below: DataFrame, ancestor: str | None = None) -> DataFrame:
    """Rows whose node is at or below the ancestor, by the closure (or by descendants() of one seed)."""
    wanted = below.filter(F.col("ancestor") == ancestor) if ancestor is not None else below
    return rows.join(wanted.select(F.col("node").alias(column)), column, "left_semi")


def facet_counts(rows: DataFrame, column: str, closed: DataFrame) -> DataFrame:
    """(ancestor, drawings): distinct drawings at or below each node; rows (drawing, node) are made distinct first."""
    held = rows.select("drawing", F.col(column).alias("node")).distinct()
    return held.join(small(closed), "node").groupBy("ancestor").agg(F.count_distinct("drawing").alias("drawings"))


# --- names


def names(nodes: DataFrame) -> DataFrame:
    """(node_id, level, ord, name, normalised, folded) of all labels and synonyms of nodes that aren't deprecated."""
    live = nodes.filter("deprecated_by IS NULL") if "deprecated_by" in nodes.columns else nodes
    said = F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))
    rows = live.select("node_id", "level", "ord", F.explode(said).alias("name"))
    return rows.withColumn("normalised", X.normalise(F.col("name"))).withColumn("folded", X.folded(F.col("name"))).filter("folded <> ''")


def resolve_tokens(tokens: DataFrame, nodes: DataFrame, level: str, aliases: DataFrame | None = None) -> DataFrame:
    """(token, node_id) of the level's node for each token (one column): by id, else by exact name, the first in order; then along aliases; null if none."""
    (column,) = tokens.columns
    asked = tokens.select(F.col(column).alias("token")).distinct().withColumn("node_id", F.concat(F.lit(f"{PREFIX[level]}."), X.slug(F.col("token")))).withColumn("folded", X.folded(F.col("token")))
    by_id = asked.join(nodes.select("node_id"), "node_id", "left_semi").select("token", F.col("node_id").alias("by_id"))
    first = names(nodes).filter(F.col("level") == level).groupBy("folded").agg(F.min_by("node_id", "ord").alias("by_name"))
    out = asked.select("token", "folded").join(by_id, "token", "left").join(small(first), "folded", "left").select("token", F.coalesce("by_id", "by_name").alias("node_id"))
    if aliases is None:
        return out
    ends = resolve_aliases(aliases).withColumnRenamed("alias", "node_id")
    return out.join(ends, "node_id", "left").select("token", F.coalesce("target", "node_id").alias("node_id"))


def known_strings(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text, node_id) of texts (one column) that are a node's name; the smallest id if several."""
    (column,) = texts.columns
    first = names(nodes).groupBy("folded").agg(F.min("node_id").alias("node_id"))
    return texts.select(F.col(column).alias("text")).distinct().withColumn("folded", X.folded(F.col("text"))).join(small(first), "folded").select("text", "node_id")


def component_words(nodes: DataFrame) -> DataFrame:
    """(word): last words of components' names."""
    return names(nodes).filter("level = 'component'").select(F.element_at(F.split("folded", " "), -1).alias("word")).distinct()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of the normalised texts; 0 where either is empty."""
    return pd.Series([R.similarity(x, y) for x, y in zip(a, b, strict=True)])


def name_score(name: Column, query: Column) -> Column:
    """1 equal, 0.85 one in the other, else shared words over the query's or likeness; both normalised."""
    words = F.array_distinct(F.split(query, " "))
    shared = F.size(F.array_intersect(words, F.split(name, " "))) / F.size(words)
    return F.when(name == query, 1.0).when(F.contains(name, query) | F.contains(query, name), 0.85).otherwise(F.greatest(0.9 * shared, 0.7 * similarity(name, query)))


def vocabulary_search(nodes: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """(node_id, label, level, score) of nodes that a query may mean, best first: by their best name, else 0.5 where the definition holds the query."""
    q = R.normalised(query)
    if not q:
        return nodes.select("node_id", "label", "level", F.lit(0.0).alias("score")).limit(0)
    best = names(nodes).filter("normalised <> ''").groupBy("node_id").agg(F.max(name_score(F.col("normalised"), F.lit(q))).alias("best"))
    defined = F.contains(X.normalise(F.col("definition")), F.lit(q)) if "definition" in nodes.columns else F.lit(False)
    score = F.when(F.col("best") >= 0.5, F.col("best")).when(defined, 0.5)
    rated = nodes.join(best, "node_id").select("node_id", "label", "level", F.round(score, 3).alias("score")).filter("score IS NOT NULL")
    return rated.orderBy(F.desc("score"), "label", "node_id").limit(limit)


def query_node(nodes: DataFrame, query: str) -> DataFrame:
    """(node_id) the query means: of the five best the one named exactly so, a part before components, values and attributes; else the best."""
    hits = vocabulary_search(nodes, query, 5)
    exact = names(nodes).filter(F.col("normalised") == R.normalised(query)).select("node_id", F.lit(0).alias("exact")).distinct()
    rank = F.when(F.col("exact").isNull(), 9).when(F.col("level") == "part", 0).when(F.col("level") == "component", 1).when(F.col("level") == "value", 2).otherwise(3)
    return hits.join(exact, "node_id", "left").orderBy(rank, F.when(F.col("exact").isNull(), -F.col("score")), "label", "node_id").limit(1).select("node_id")


def duplicates(nodes: DataFrame, label: str, synonyms: list[str] = (), threshold: float = 0.75) -> DataFrame:
    """(node_id, score, name) of nodes with a name more like a proposed one than the threshold, best first."""
    proposed = F.explode(F.array(*[F.lit(x) for x in [label, *synonyms]]))
    rated = names(nodes).select("node_id", "name", proposed.alias("p")).withColumn("score", similarity("p", "name"))
    best = rated.groupBy("node_id").agg(F.max(F.struct("score", "name")).alias("b"))
    return best.filter(F.col("b.score") > threshold).select("node_id", F.round("b.score", 3).alias("score"), F.col("b.name").alias("name")).orderBy(F.desc("score"), "node_id")


# --- upkeep


def violations(nodes: DataFrame) -> DataFrame:
    """(node_id, rule, about) of everything that is wrong with nodes (node_id, level, label, definition, parents, value_type, enum_members, slug)."""
    prefix = F.coalesce(*[F.when(F.col("level") == k, F.lit(p)) for k, p in PREFIX.items()], F.lit(None))
    no_parents = F.coalesce(F.size("parents"), F.lit(0)) == 0
    rules = {
        "bad level": prefix.isNull(),
        "label is required": F.coalesce("label", F.lit("")) == "",
        "id prefix": F.split_part("node_id", F.lit("."), F.lit(1)) != prefix,
        "definition is required": (F.coalesce("definition", F.lit("")) == "") & (F.col("level") != "value"),
        "takes no parents": F.col("level").isin("component", "attribute") & ~no_parents,
        "needs a parent": F.col("level").isin("part", "value") & no_parents,
    }
    own = [nodes.filter(test).select("node_id", F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("about")) for rule, test in rules.items()]
    above = nodes.select(F.col("node_id").alias("p"), F.col("level").alias("p_level"), "value_type", "enum_members")
    pairs = nodes.select("node_id", "level", F.coalesce("slug", F.substring_index("node_id", ".", -1)).alias("slug"), F.explode("parents").alias("p")).join(above, "p", "left")
    admitted = F.exists("enum_members", lambda m: X.normalise(m) == X.normalise(F.col("slug")))
    over = {
        "unknown parent": F.col("p_level").isNull(),
        "parent's level": F.col("p_level").isNotNull() & ((F.col("level") == "part") & ~F.col("p_level").isin("component", "part") | (F.col("level") == "value") & (F.col("p_level") != "attribute")),
        "not admitted under enum": (F.col("level") == "value") & (F.col("value_type") == "enum") & ~F.coalesce(admitted, F.lit(False)),
    }
    own += [pairs.filter(test).select("node_id", F.lit(rule).alias("rule"), F.col("p").alias("about")) for rule, test in over.items()]
    circles = cycles(edges_of(nodes)).select(F.col("node").alias("node_id"), F.lit("cycle").alias("rule"), F.lit(None).cast("string").alias("about"))
    return reduce(DataFrame.unionByName, [*own, circles])


def tree(nodes: DataFrame) -> DataFrame:
    """(node, path, labels, depth) of the tree below components without parents, deprecated nodes left out, in the order of labels."""
    live = nodes.filter("deprecated_by IS NULL")
    kept = edges_of(live).join(live.select(F.col("node_id").alias("parent")), "parent", "left_semi")
    roots = live.filter("level = 'component'").join(kept.select(F.col("child").alias("node_id")), "node_id", "left_anti")
    down = paths(kept).filter(F.col("path")[0].startswith("component."))
    down = down.unionByName(roots.select(F.col("node_id").alias("node"), F.array("node_id").alias("path"))).distinct()
    label = small(live.select("node_id", "label"))
    steps = down.select("node", "path", F.posexplode("path").alias("pos", "node_id")).join(label, "node_id")
    named = steps.groupBy("node", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))
    return named.withColumn("depth", F.size("path") - 1).orderBy("labels", "path")


def merge_nodes(nodes: DataFrame, loser: str, winner: str) -> DataFrame:
    """nodes after one was merged into another: it is deprecated, its children and names move."""
    moved = F.array_distinct(F.transform("parents", lambda p: F.when(p == loser, F.lit(winner)).otherwise(p)))
    gone = nodes.filter(F.col("node_id") == loser).select(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>"))).alias("more"))
    more = F.broadcast(gone.withColumn("node_id", F.lit(winner)))  # one row
    merged = nodes.join(more, "node_id", "left")
    more_names = F.array_sort(F.array_distinct(F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))))
    return merged.select(*[
        {"parents": F.when(F.col("node_id") == winner, F.array_remove(moved, winner)).otherwise(moved), "deprecated_by": F.when(F.col("node_id") == loser, winner).otherwise(F.col("deprecated_by")), "synonyms": F.when(F.col("node_id") == winner, more_names).otherwise(F.col("synonyms"))}.get(c, F.col(c)).alias(c)
        for c in nodes.columns
    ])


def rewrite_paths(paths_: Column, loser: str, winner: str) -> Column:
    """Classification paths (array of arrays) after a merge."""
    return F.array_distinct(F.transform(paths_, lambda p: F.transform(p, lambda x: F.when(x == loser, F.lit(winner)).otherwise(x))))


def propose(nodes: DataFrame, level: str, label: str, parents: list[str], definition: str, synonyms: list[str] = (), submitted_by: str = "", taken: DataFrame | None = None) -> DataFrame:
    """(slug, node_id, ..., status, blocked_by) of a proposal: pending, or blocked by nodes of like names; its slug differs from all ids and from those taken."""
    spark, base = nodes.sparkSession, R.slug(label, "node")
    near = [r["node_id"] for r in duplicates(nodes, label, list(synonyms)).limit(25).collect()]
    used = nodes.select(F.substring_index("node_id", ".", -1).alias("slug"))
    used = used if taken is None else used.unionByName(taken.select("slug"))
    held = {r["slug"] for r in used.filter(F.col("slug").rlike(rf"^{base}(_\d+)?$")).distinct().collect()}
    slug = next(s for s in (base, *(f"{base}_{k}" for k in range(2, len(held) + 3))) if s not in held)
    row = (slug, f"{PREFIX[level]}.{slug}", level, label, list(parents), list(synonyms), definition, submitted_by, "blocked" if near else "pending", near)
    return spark.createDataFrame([row], "slug string, node_id string, level string, label string, parents array<string>, synonyms array<string>, definition string, submitted_by string, status string, blocked_by array<string>")


def approve(nodes: DataFrame, proposals: DataFrame, slug: str) -> DataFrame:
    """nodes with a pending proposal's node added; without a definition (values but) it isn't."""
    ready = proposals.filter((F.col("slug") == slug) & (F.col("status") == "pending") & ((F.coalesce("definition", F.lit("")) != "") | (F.col("level") == "value")))
    added = ready.withColumn("ord", F.lit((nodes.agg(F.max("ord")).first()[0] or 0) + 1))
    return nodes.unionByName(added.select(*[F.col(c) if c in added.columns else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns]))


def merge_proposal(nodes: DataFrame, proposals: DataFrame, slug: str, target: str) -> DataFrame:
    """nodes with a pending proposal's names as synonyms of an existing node."""
    said = proposals.filter((F.col("slug") == slug) & (F.col("status") == "pending")).select(F.lit(target).alias("node_id"), F.concat(F.array("label"), "synonyms").alias("more"))
    merged = nodes.join(F.broadcast(said), "node_id", "left")  # one row
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("more"))))
    return merged.select(*[F.when(F.col("more").isNotNull(), both).otherwise(F.col(c)).alias(c) if c == "synonyms" else F.col(c) for c in nodes.columns])
