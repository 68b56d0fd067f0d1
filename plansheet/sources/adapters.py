"""The driver's tables in the roles of the engine's inputs: snapshots, facts, vocabulary edges, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str, only: tuple[int, ...] | None = None) -> DataFrame:
    """(drawing, commit_seq, element_id, value): the last value of a day for each element, by (ts, event_id).

    A day with events is a commit.  only: these commits; their days are looked
    up first, so that the scan reads their times alone.
    """
    e = table(spark, sf_dir, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct()  # one row per commit
    seq = days.withColumn("commit_seq", F.row_number().over(Window.orderBy("day")))
    if only is not None:
        wanted = {r["commit_seq"]: r["day"] for r in seq.filter(F.col("commit_seq").isin(*only)).collect()}
        within = F.lit(False)
        for day in wanted.values():
            within = within | (F.col("ts") >= F.lit(day).cast("timestamp")) & (F.col("ts") < F.date_add(F.lit(day), 1).cast("timestamp"))
        e, seq = e.filter(within), spark.createDataFrame([(d, k) for k, d in wanted.items()], "day date, commit_seq int")
    last = e.withColumn("day", F.to_date("ts")).groupBy(F.col("event_type").alias("drawing"), "day", F.col("user_id").alias("element_id")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.join(F.broadcast(seq), "day").select("drawing", "commit_seq", "element_id", "value")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drawing, element_id, material, part, value, confidence, measure): bound facts, one per (drawing, element)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("x"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    li = li.select("l_orderkey", "l_linenumber", "x.*")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("drawing"), F.col("l_linenumber").alias("element_id"), F.col("p_type").alias("material"), F.col("p_brand").alias("part"),
        F.col("l_quantity").alias("value"), F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "thickness").otherwise("setdown").alias("measure"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child) of the vocabulary graph: region - nation - part, parts having several parents."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    top = n.select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
    low = li.join(s, li.l_suppkey == s.s_suppkey).select(F.concat(F.lit("N"), "s_nationkey").alias("parent"), F.concat(F.lit("P"), "l_partkey").alias("child")).distinct()
    return top.unionByName(low)


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of edges()."""
    from ..operators.vocabulary import closure

    return closure(edges(spark, sf_dir))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(element_id, text): notes such as '12MM ALMOND PLY NOM.'"""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    unit = F.when(n % 4 == 0, "MM ").when(n % 4 == 1, " ").when(n % 4 == 2, "CM ").otherwise(" THK ")
    more = F.when(n % 7 == 0, " SETDOWN").when(n % 7 == 1, " NOM.").when(n % 7 == 2, " FALL 1:100").when(n % 7 == 3, " REFER ENG. DWGS").when(n % 7 == 4, " 45X90 SHS").otherwise("")
    return p.select(n.alias("element_id"), F.concat(F.col("p_size").cast("string"), unit, F.upper("p_name"), more).alias("text"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts that nobody classified yet."""
    o = table(spark, sf_dir, "orders")
    said = F.md5((F.col("o_custkey") % 97).cast("string"))
    none = F.lit(None).cast("string")
    level = F.when(F.col("o_orderkey") % 3 == 0, "value").otherwise("part")
    return o.select(
        F.col("o_orderkey").cast("string").alias("uid"), said.alias("raw_string"), said.alias("normalised"), level.alias("level_guess"), F.when(level == "value", "attr.note").alias("attribute"), none.alias("material"), none.alias("part"),
        F.concat(F.lit("d"), F.col("o_custkey") % 50).alias("drawing"), F.concat(F.lit("t"), F.col("o_custkey") % 200).alias("detail_id"), none.alias("element_id"), F.year("o_orderdate").alias("commit_seq"),
        F.to_date("o_orderdate").cast("string").alias("commit_date"), F.array().cast("array<string>").alias("sibling_context"),
    )


def elements(state: DataFrame) -> DataFrame:
    """A snapshot as element rows: a line far from all others for each element, its value as text."""
    from .. import schemas

    x = F.col("element_id") * 100.0
    known = {"dxf_handle": F.col("element_id").cast("string"), "type": F.lit("LINE"), "layer": F.lit("0"), "geom": F.struct(x.alias("x"), F.lit(0.0).alias("y"), F.array(x, F.lit(0.0), x, F.lit(0.0)).alias("bbox")), "text_raw": F.round("value", 1).cast("string")}
    return state.select("drawing", *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(schemas.ELEMENT)])
