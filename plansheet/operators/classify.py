"""Bound facts as paths of the vocabulary, with what it doesn't know, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ASSEMBLIES, ASSEMBLY_NODES, CONTEXTS, JUNCTION_NODES, JUNCTIONS, MEASURE_NODES, PROJECTIONS
from ..functions import text as X
from . import vocabulary as V
from .tables import small


def _rule(said: Column, rules: dict[str, list[str]], every: bool) -> Column:
    """The first rule whose words occur (all of them, or any)."""
    def hit(words: list[str]) -> Column:
        found = [said.rlike(rf"\b{re.escape(w)}\b") for w in words]
        out = found[0]
        for f in found[1:]:
            out = out & f if every else out | f
        return out

    return F.coalesce(*[F.when(hit(words), F.lit(name)) for name, words in rules.items()], F.lit(None).cast("string"))


def facets(title: Column, texts: Column) -> Column:
    """Struct of junction_type, assembly, context, projection and classified_by that a title and texts (array) tell of."""
    said = X.folded(F.concat_ws(" ", title, F.array_join(texts, " ")))
    found = {"junction_type": _rule(said, JUNCTIONS, True), "assembly": _rule(said, ASSEMBLIES, True), "context": _rule(said, CONTEXTS, False), "projection": _rule(said, PROJECTIONS, False)}
    told = F.when(F.coalesce(*found.values()).isNotNull(), "auto").otherwise("none")
    return F.struct(*[c.alias(n) for n, c in found.items()], told.alias("classified_by"))


def facet_nodes(found: Column) -> Column:
    """Ids that a facet struct's junction and assembly stand for (not looked up)."""
    known = ASSEMBLY_NODES | JUNCTION_NODES
    node = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in known.items()], F.lit(None).cast("string"))
    return F.array_sort(F.array_compact(F.array_distinct(F.array(node(found["junction_type"]), node(found["assembly"])))))


def compose(components: Column, part: Column, material: Column, value: Column, measure: Column) -> Column:
    """Paths (array of arrays) of one fact: components must be those that apply; part and material are node ids or null."""
    leaf = F.coalesce(*[F.when(measure == m, F.lit(n)) for m, n in MEASURE_NODES.items()], F.lit("attr.thickness"))
    none = F.array().cast("array<array<string>>")
    named = F.when(material.isNotNull(), F.array(F.array(F.lit("attr.material"), material))).otherwise(none)
    counted = F.when(value.isNotNull() & (material.isNotNull() | part.isNull()), F.array(F.array(leaf, X.amount_node(value)))).otherwise(none)
    said = F.concat(named, counted)
    of_part = F.when(F.size(said) > 0, F.transform(said, lambda t: F.concat(F.array(part), t))).otherwise(F.array(F.array(part)))
    tails = F.when(part.isNotNull(), of_part).otherwise(said)
    under = F.flatten(F.transform(tails, lambda t: F.transform(components, lambda c: F.concat(F.array(c), t))))
    return F.when(F.coalesce(F.size(components), F.lit(0)) > 0, under).otherwise(tails)


def classify(facts: DataFrame, nodes: DataFrame, components: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """facts with paths (array of arrays), level_guess, attribute and reason.

    facts: drawing, material, part, value, measure, ...; components (drawing,
    components): facet components of each drawing or detail.  An unknown part
    (neither a part, a material nor a component's last word) or material gives
    no path but a reason.
    """
    rows = facts.withColumn("_n", F.monotonically_increasing_id())
    parts = V.resolve_tokens(facts.filter("part IS NOT NULL").select("part"), nodes, "part", aliases).select(F.col("token").alias("part"), F.col("node_id").alias("part_node"))
    as_material = V.resolve_tokens(facts.filter("part IS NOT NULL").select("part"), nodes, "value", aliases).select(F.col("token").alias("part"), F.col("node_id").alias("part_material"))
    materials = V.resolve_tokens(facts.filter("material IS NOT NULL").select("material"), nodes, "value", aliases).select(F.col("token").alias("material"), F.col("node_id").alias("material_node"))
    words = V.component_words(nodes).select(F.col("word").alias("part_word"), F.lit(True).alias("is_component"))
    rows = rows.join(small(parts), "part", "left").join(small(as_material), "part", "left").join(small(materials), "material", "left")
    rows = rows.withColumn("part_word", X.folded(F.col("part"))).join(small(words), "part_word", "left")
    if components is not None:
        rows = rows.join(components.select("drawing", "components"), "drawing", "left")
        closed = V.closure(V.edges_of(nodes))
        above = closed.groupBy(F.col("node").alias("part_node")).agg(F.collect_set("ancestor").alias("above"))
        rows = rows.join(small(above), "part_node", "left")
        apply = F.when(F.col("part_node").isNull(), F.col("components")).otherwise(F.array_intersect("components", F.coalesce("above", F.array("part_node"))))
        rows = rows.withColumn("components", F.array_sort(F.array_distinct(F.coalesce(apply, F.array().cast("array<string>")))))
    else:
        rows = rows.withColumn("components", F.array().cast("array<string>"))
    odd_part = F.col("part").isNotNull() & (F.col("part") != "") & F.coalesce("part_node", "part_material").isNull() & F.col("is_component").isNull()
    odd_material = F.col("material").isNotNull() & (F.col("material") != "") & F.col("material_node").isNull()
    found = compose(F.col("components"), F.col("part_node"), F.col("material_node"), F.col("value"), F.coalesce("measure", F.lit("thickness")))
    reason = F.when(odd_part, F.concat(F.lit("unknown-part:"), "part")).when(odd_material, F.concat(F.lit("unknown-material:"), "material")).when(F.size(found) == 0, "unresolvable")
    level = F.when(reason.isNull(), None).when(~odd_part & odd_material, "value").otherwise("part")
    out = rows.withColumns({"reason": reason, "paths": F.when(reason.isNull(), found).otherwise(F.array().cast("array<array<string>>")), "level_guess": level, "attribute": F.when(level == "value", "attr.material")})
    return out.select(*facts.columns, "paths", "level_guess", "attribute", "reason")
