import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plansheet.llm import exchange as X
from plansheet.llm import exact_dedup as E
from plansheet.llm.exact_dedup import exact_groups

SCHEMA = "text string, doc_id long, b string, sha string, keep_id long"


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.binary(max_size=5))
@settings(max_examples=200, deadline=None)
def test_golomb_round_trip(values, tail):
    v = np.array(sorted(values), np.uint64)
    back, used = X.ungolomb(X.golomb(v) + tail)
    assert (back == v).all() and used == len(X.golomb(v))


def test_golomb_is_smaller():
    v = np.unique(np.random.default_rng(1).integers(0, 2**64, 50_000, dtype=np.uint64))
    assert len(X.golomb(v)) < 0.85 * v.nbytes


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(E, "LIST_ROWS", 7)
    texts = ["Abc é", "aBC é", "abc É", None, "", " ", "x" * 5000, "X" * 5000] + ["hot Copy"] * 50 + [f"t{i % 20}" for i in range(60)]
    rows = [(t, i, "", "", 0) for i, t in enumerate(texts)]
    rows += [("x" * 5000, 7, "", "", 0), ("alone", None, "", "", 0), ("alone", None, "", "", 0), ("hot Copy", None, "", "", 0)]
    got = exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    groups = {}
    for t, i, *_ in rows:
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == max((i for i in g if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_full_bit_table_lets_more_through_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "BITS_LEAST", 8)
    monkeypatch.setattr(E, "BITS_MOST", 8)
    monkeypatch.setattr(E, "BIT_BLOCK", 8)
    rows = [(f"t{i % 30}", i, "", "", 0) for i in range(45)] + [(f"u{i}", 100 + i, "", "", 0) for i in range(100)]
    got = {r.doc_id: r for r in exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].group_size == (2 if i < 15 or 30 <= i < 45 else 1) for i in got)
    assert all(got[i].keep_id == (i + 30 if i < 15 else i) for i in got)


def test_rows_keep_their_place_when_cores_change(spark, tmp_path, monkeypatch):
    """Buckets and keys hang on partitions, so a table's splits mustn't follow the number of cores."""
    from pyspark import SparkContext
    from pyspark.sql import functions as F

    from plansheet.llm import shared

    spark.range(3000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 3000) AS text").repartition(3).write.parquet(path := str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    try:
        shared.pin_splits(spark)
        read = lambda: spark.read.parquet(path).select("doc_id", F.monotonically_increasing_id().alias("k"))
        first = {r.doc_id: r.k for r in read().collect()}
        assert int(spark.conf.get("spark.sql.files.minPartitionNum")) >= spark.sparkContext.defaultParallelism
        monkeypatch.setattr(SparkContext, "defaultParallelism", property(lambda self: 99))
        shared.pin_splits(spark)  # the first value stays
        assert spark.conf.get("spark.sql.files.minPartitionNum") != "99" and {r.doc_id: r.k for r in read().collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        if before is not None:
            spark.conf.set("spark.sql.files.minPartitionNum", before)
