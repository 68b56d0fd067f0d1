"""Queries whose order or limits meet ties, against their SQL on tables made of ties; and how many rows a lookup of regions makes."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plansheet.operators import attribution as A
from plansheet.plans.catalog import QUERIES, SQL

FORMS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}


def agrees(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        spark.createDataFrame(rows, FORMS[t]).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    cols = [c[0] for c in want.description]
    got = [tuple(r[c] for c in cols) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key) and got


def sheets(step):
    """Balances in steps, so that points, vertices and edges meet or lie equally far from each other."""
    draw = random.Random(3)
    balance = lambda: round(draw.randrange(-300, 300) * step, 2)
    customers = [(i, "c", i % 2, balance(), "m") for i in range(300)]
    return {"customer": customers, "supplier": [(i, "s", i % 2, balance()) for i in range(40)]}


@pytest.mark.parametrize("name", ["snap_points", "regions_crossed", "region_of_point"])
@pytest.mark.parametrize("step", [0.7, 5.0])
def test_touching_and_equally_near(spark, tmp_path, name, step):
    agrees(spark, tmp_path, name, **sheets(step))


def test_moves_as_long_as_the_limit(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, 12)
    rows = []
    for k in range(400):
        value = round(30 + k * 0.17, 2)
        rows += [(2 * k, day, k, "click", value, ""), (2 * k + 1, day + datetime.timedelta(1), k, "click", round(value - 20, 2), "")]
    agrees(spark, tmp_path, "element_status", events=rows)


def most_rows(df):
    """Rows of the operator that makes the most, once df ran."""
    def walk(plan):
        name = plan.nodeName()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
        children = plan.children()
        made = plan.metrics().get("numOutputRows")
        return max([made.get().value() if made.isDefined() else 0, *map(walk, inner), *(walk(children.apply(i)) for i in range(children.size()))])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_points_among_many_regions_are_not_paired_with_all(spark):
    points = spark.range(2000).select(F.lit("a").alias("drawing"), F.col("id").alias("point_id"), (F.col("id") % 97 / 10 + 0.013).alias("x"), (F.col("id") % 89 / 10 + 0.017).alias("y"))
    corner = lambda dx, dy: F.struct((F.col("id") % 10 + dx).cast("double").alias("x"), (F.col("id") % 7 + dy).cast("double").alias("y"))
    regions = spark.range(300).select(F.lit("a").alias("drawing"), F.col("id").alias("region_id"), F.array(corner(0, 0), corner(3, 0), corner(0, 3)).alias("poly"))
    found = A.regions_at(points, regions)
    assert most_rows(found) < 20_000
    pairs = points.join(regions, "drawing").filter(A.G.contains(F.col("poly"), F.col("x"), F.col("y")) | (A.G.boundary_distance(F.col("poly"), F.col("x"), F.col("y")) <= 0.5))
    want = {r[0]: r[1] for r in pairs.groupBy("point_id").agg(F.min("region_id")).collect()}
    assert {r["point_id"]: r["region_id"] for r in found.collect()} == {i: want.get(i) for i in range(2000)}


def test_segments_and_regions_of_any_size_meet_once(spark):
    draw, rows = random.Random(5), []
    for i in range(200):
        x, y, size = draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice([0.1, 3, 40, 300])
        rows.append(("a", i, x, y, x + draw.uniform(-size, size), y + draw.uniform(-size, size)))
    segments = spark.createDataFrame(rows, "drawing string, segment_id long, x double, y double, x2 double, y2 double")
    polys = []
    for i in range(60):
        x, y, size = draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice([1, 8, 70])
        polys.append(("a", i, [{"x": x, "y": y}, {"x": x + size, "y": y}, {"x": x + size / 2, "y": y + size}]))
    regions = spark.createDataFrame(polys, "drawing string, region_id long, poly array<struct<x: double, y: double>>")
    c = F.col
    at = lambda x, y: A.G.contains(c("poly"), x, y) | (A.G.boundary_distance(c("poly"), x, y) <= 0.5)
    pairs = segments.join(regions, "drawing").filter(at(c("x"), c("y")) & at(c("x2"), c("y2")) | A.G.crosses(c("poly"), c("x"), c("y"), c("x2"), c("y2")))
    got = [(r["segment_id"], r["region_id"]) for r in A.regions_of_segments(segments, regions).collect()]
    assert sorted(got) == sorted((r["segment_id"], r["region_id"]) for r in pairs.collect()) and len(got) > 300
