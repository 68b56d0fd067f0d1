"""Search over bound facts: (drawing, element_id, material, part, value, confidence, measure)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def fact_condition(material: str | None = None, value: float | None = None, tolerance: float = 0.0, measure: str | None = None, include_low: bool = False, include_loose: bool = False, part: str | None = None) -> Column:
    """Conditions that one fact row must meet together.  A value asks for a trusted fact, of measure thickness unless said otherwise; a material or part alone asks for no confidence.

    include_loose: in a search by value alone, numbers bound to no material count too.
    """
    c = F.lit(True)
    if material is not None:
        c = c & (F.lower("material") == material.lower())
    if part is not None:
        c = c & (F.lower("part") == part.lower())
    if value is not None:
        sure = F.col("confidence").isin("high", "medium", *(["low"] if include_low else []))
        if include_loose and material is None:
            sure = sure | (F.col("material").isNull() & (F.col("chain") == "unattributed"))
        c = c & F.col("value").between(value - tolerance, value + tolerance) & F.coalesce(sure, F.lit(False))
        wanted = [m.strip() for m in (measure or "thickness").split(",")]
        c = c & F.coalesce("measure", F.lit("thickness")).isin(*wanted)
    elif measure is not None:
        c = c & (F.col("measure") == measure)
    return c


def find(elements: DataFrame, facts: DataFrame, keys: list[str], **conditions) -> DataFrame:
    """Elements with one fact that meets all conditions."""
    return elements.join(facts.filter(fact_condition(**conditions)), keys, "left_semi")


CHIPS = ("material", "part", "project", "drawing", "value", "text")


def parse_chip(text: str) -> tuple[str, str]:
    """'material:concrete' as its kind and value; other text is a text chip."""
    kind, sep, value = text.partition(":")
    if sep and kind.strip().lower() in CHIPS and value.strip():
        return kind.strip().lower(), value.strip()
    if not text.strip():
        raise ValueError(f"empty chip: {text!r}")
    return "text", text.strip()


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def fact_chip(kind: str, value, tolerance: float = 0.0, include_low: bool = False, include_loose: bool = False, measure: str | None = "thickness", of: Column | None = None) -> Column:
    """Does a bound fact meet a material or value chip? of: the fact as a struct, else the row's columns."""
    c = (lambda name: F.col(name)) if of is None else (lambda name: of[name])
    sure = c("confidence").isin("high", "medium", *(["low"] if include_low else []))
    if kind == "material":
        return F.coalesce((F.lower(c("material")) == str(value).lower()) & sure, F.lit(False))
    number = _number(value)
    if number is None:
        return F.lit(False)
    held = F.abs(c("value") - number) <= tolerance
    if measure is not None:
        held = held & (F.coalesce(c("measure"), F.lit("thickness")) == measure)
    loose = c("material").isNull() & F.lit(include_loose)
    return F.coalesce(held & F.when(c("material").isNull(), loose).otherwise(sure), F.lit(False))


def row_chip(kind: str, value) -> Column:
    """Does a row itself meet a chip? A value is compared as text."""
    if kind == "text":
        return F.contains(F.lower(F.coalesce("text_raw", F.lit(""))), F.lit(str(value).lower()))
    if kind == "value":
        return F.coalesce(F.col("value").cast("string"), F.lit("")) == str(value)
    return F.coalesce(F.lower(F.col(kind)), F.lit("")) == str(value).lower()


def chip_hit(facts: Column, kind: str, value, **options) -> Column:
    """Is a chip met by one of the row's facts (array of structs), or by the row itself where it has none or the chip asks for neither material nor value?"""
    if kind not in ("material", "value"):
        return row_chip(kind, value)
    return F.when(F.coalesce(F.size(facts), F.lit(0)) > 0, F.exists(facts, lambda f: fact_chip(kind, value, of=f, **options))).otherwise(row_chip(kind, value))


def latest_fact_commits(facts: DataFrame) -> DataFrame:
    """(drawing, commit_seq) of each drawing's last commit that has facts."""
    return facts.groupBy("drawing").agg(F.max("commit_seq").alias("commit_seq"))


def stacked(facts: DataFrame, chips: list[tuple[str, object]]) -> DataFrame:
    """(drawing, elements, matched) of drawings where every chip is met by some fact: one pass, no join per chip."""
    tests = [fact_chip(k, v) if k in ("material", "value") else F.coalesce(F.lower(F.col(k)) == str(v).lower(), F.lit(False)) for k, v in chips]
    hit = F.lit(False)
    for t in tests:
        hit = hit | t
    by = facts.groupBy("drawing").agg(F.count(F.lit(1)).alias("elements"), F.count_if(hit).alias("matched"), *[F.max(t).alias(f"_{i}") for i, t in enumerate(tests)])
    for i in range(len(tests)):
        by = by.filter(F.col(f"_{i}"))
    return by.select("drawing", "elements", "matched")


def qualifying(state: DataFrame, facts: DataFrame, chips: list[tuple[str, object]], ever: bool = False, **options) -> DataFrame:
    """(drawing) of drawings that meet every chip now, or, with ever, at any commit: material and value chips by bound facts, others by rows.

    state: drawing, commit_seq, status, ...; facts: drawing, commit_seq, ....
    Chips are independent of each other: two needn't hit one fact.
    """
    rows, held = state, facts
    if not ever:
        top = state.groupBy("drawing").agg(F.max("commit_seq").alias("commit_seq"))
        rows = state.join(top, ["drawing", "commit_seq"], "left_semi").filter("status <> 'deleted'")
        held = facts.join(latest_fact_commits(facts), ["drawing", "commit_seq"], "left_semi")
    drawings = state.select("drawing").distinct()
    for source, kinds, test in ((held, ("material", "value"), lambda k, v: fact_chip(k, v, **options)), (rows, ("part", "project", "drawing", "text"), row_chip)):
        tests = [test(k, v) for k, v in chips if k in kinds]
        if tests:
            by = source.groupBy("drawing").agg(*[F.max(t).alias(f"_{i}") for i, t in enumerate(tests)])
            for i in range(len(tests)):
                by = by.filter(F.col(f"_{i}"))
            drawings = drawings.join(by.select("drawing"), "drawing", "left_semi")
    return drawings


def search_stacked(state: DataFrame, facts: DataFrame, chips: list[tuple[str, object]], ever: bool = False, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drawings, rows, deleted) of the drawings that meet every chip.

    rows: all current rows of qualifying drawings, with matched and the best
    fact's confidence, attribution_chain, exact_value and qualifier.  deleted:
    what their last commits removed, and removals of other drawings where one
    matches.  drawings: drawing, project, elements, matched, via_history,
    deleted_only.  No chips: everything.
    """
    found = qualifying(state, facts, chips, ever, **options)
    top = state.groupBy("drawing").agg(F.max("commit_seq").alias("commit_seq"))
    fact = F.struct("element_id", "material", "value", "measure", "confidence", "chain", "qualifier")
    bound = facts.groupBy("drawing", "element_id", "commit_seq").agg(F.collect_list(fact).alias("facts"))
    last = state.join(top, ["drawing", "commit_seq"], "left_semi").join(bound, ["drawing", "element_id", "commit_seq"], "left")
    hit = F.lit(not chips)
    for k, v in chips:
        hit = hit | chip_hit(F.col("facts"), k, v, **options)
    last = last.withColumn("matched", F.coalesce(hit, F.lit(False)))
    meets = F.lit(False)
    asked = [(k, v) for k, v in chips if k in ("material", "value")]
    best_of = lambda f: [confidence_rank(f["confidence"]).alias("rank"), F.coalesce(f["element_id"].cast("string"), F.lit("")).alias("e"), f.alias("fact")]

    def preferred(f):
        out = meets
        for k, v in asked:
            out = out | fact_chip(k, v, of=f, **options)
        return F.struct((~out).cast("int").alias("miss"), *best_of(f))

    best = F.array_min(F.transform("facts", preferred))["fact"]
    last = last.withColumns({"confidence": best["confidence"], "attribution_chain": best["chain"], "exact_value": best["value"], "qualifier": F.coalesce(best["qualifier"], F.col("qualifier") if "qualifier" in state.columns else F.lit(None))})
    rows = last.filter("status <> 'deleted'").join(found, "drawing", "left_semi").drop("facts")
    gone = last.filter("status = 'deleted'")
    listed = found.select("drawing").unionByName(gone.filter("matched").select("drawing")).distinct()
    deleted = gone.join(listed, "drawing", "left_semi").drop("facts")
    live = rows.groupBy("drawing").agg(F.count(F.lit(1)).alias("elements"), F.count_if("matched").alias("n"))
    info = listed.join(live, "drawing", "left").join(found.select("drawing", F.lit(True).alias("found")), "drawing", "left")
    project = F.when(F.contains(F.col("drawing").cast("string"), F.lit("/")), F.split_part(F.col("drawing").cast("string"), F.lit("/"), F.lit(1))).otherwise("")
    history = F.coalesce("found", F.lit(False)) & (F.coalesce("n", F.lit(0)) == 0) & F.lit(bool(ever and chips))
    drawings = info.select("drawing", project.alias("project"), F.coalesce("elements", F.lit(0)).alias("elements"), F.coalesce("n", F.lit(0)).alias("matched"), history.alias("via_history"), F.col("found").isNull().alias("deleted_only"))
    order = ["drawing", "element_id"]
    return drawings.orderBy("drawing"), rows.orderBy(*order), deleted.orderBy(*order)


def commit_of(commits: DataFrame, prefix: str) -> DataFrame:
    """The first commit (commit_seq, commit_sha) whose name begins so."""
    return commits.filter(F.col("commit_sha").startswith(prefix)).orderBy("commit_seq").limit(1)


def best_fact(facts: DataFrame, satisfied: Column) -> DataFrame:
    """Per drawing the fact to show: one that satisfies, then the most trusted, then the lowest element."""
    order = F.struct((~satisfied).cast("int"), confidence_rank(F.col("confidence")), "element_id")
    return facts.groupBy("drawing").agg(F.min_by(F.struct("element_id", "material", "value", "confidence"), order).alias("f")).select("drawing", "f.*")


#: Columns that may be suggested from; text is left as it comes.
SUGGESTED = ("material", "part", "value", "drawing", "project", "text_raw")


def suggestions(df: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """Distinct values of one of the columns that may be suggested from, in order (texts as they come)."""
    if column not in SUGGESTED:
        raise ValueError(f"{column} is none of {SUGGESTED}")
    if column == "text_raw":
        return df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit)
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit)


def modal_offset(pairs: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """Per drawing the (dx, dy) that at least `share` of at least `least` pairs agree on, unless it is zero."""
    by = pairs.groupBy("drawing", "dx", "dy").agg(F.count(F.lit(1)).alias("n"))
    best = by.groupBy("drawing").agg(F.max_by(F.struct("dx", "dy", "n"), F.struct("n", -F.col("dx"), -F.col("dy"))).alias("m"), F.sum("n").alias("total"))
    return best.select("drawing", "m.dx", "m.dy", "m.n", "total").filter((F.col("total") >= least) & (F.col("n") >= share * F.col("total")) & ~((F.col("dx") == 0) & (F.col("dy") == 0)))


def suggestion_lists(df: DataFrame, limit: int = 500) -> DataFrame:
    """One row of arrays: suggestions() of every column that df has, in one pass over it."""
    held = [c for c in SUGGESTED if c in df.columns]
    return df.agg(*[F.slice(F.array_sort(F.collect_set(c)), 1, limit).alias(c) for c in held])
