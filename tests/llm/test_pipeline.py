import re

import corpus_pipeline as P


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    frames = [docs]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, frames[-1], d).write.parquet(path := str(tmp_path / str(k)))
        frames.append(spark.read.parquet(path))
        if k < 4:
            assert frames[-1].columns == docs.columns, name
    text = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:-1]]
    # exact dedup: the largest id of each text
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    assert set(text[2]) == {max(i for i, x in text[1].items() if low(x) == low(t)) for t in text[1].values()}
    # near duplicates: the smallest id of each component
    sets, parent = {i: shingles(t) for i, t in text[2].items()}, {i: i for i in text[2]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    assert set(text[3]) == {top(i) for i in sets}
    packed = frames[-1].collect()
    assert {r.doc_id for r in packed} == set(text[4]) and max(r.offset + r.length for r in packed) <= 2048
    assert P.run(spark, d).count() == len(packed)


ODD = [
    ("same text here for all of them now", 1), ("same text here for all of them now", 5), ("same text here for all of them now", None), ("SAME text here for all of them now", 5),
    (None, 7), ("", 8), (None, None), ("  ", 9), ("a rare short text", 20), ("x " * 30_000, 21), ("tie tie tie tie tie tie", 22), ("tie tie tie tie tie tie tie", 22),
]


def odd(spark):
    rows = [(t, i, "en", "s", 0, "k", 1, "r", "q") for t, i in ODD]
    return spark.createDataFrame(rows, "text string, doc_id long, lang string, source string, n_chars int, key string, row int, id string, component_id string")


def kept(df):
    return sorted(((r.text or "")[:40], r.doc_id if r.doc_id is not None else -1) for r in df.collect())


def test_stages_with_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    odd(spark).write.parquet(path := str(tmp_path / "odd"))
    docs = spark.read.parquet(path)
    copies = P.drop_copies(spark, docs, d)
    assert copies.columns == docs.columns
    # one row of each text, of the largest id; null and '' are one text
    assert [x for x in kept(copies) if x[0].lower().startswith("same")] == [x for x in kept(copies) if x[1] == 5] and len([x for x in kept(copies) if x[0] == ""]) == 1
    assert copies.count() == len({"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t, _ in ODD})
    near = P.drop_near_copies(spark, docs, d)
    # the smallest id of each group; texts without words all stay
    assert near.columns == docs.columns and [x for x in kept(near) if "same" in x[0].lower()] == [("same text here for all of them now", 1)]
    assert len([x for x in kept(near) if not x[0].strip()]) == 4 and len([x for x in kept(near) if x[0].startswith("tie")]) == 1
    clean = P.drop_contaminated(spark, docs, d)
    assert kept(clean) == kept(docs) and clean.columns == docs.columns
    assert P.drop_toxic(spark, docs, d).columns == docs.columns
    packed = P.pack(spark, docs, d)
    assert packed.filter("piece = 0").count() == len(ODD)


def test_stages_of_an_empty_table(spark, tmp_path):
    odd(spark).limit(0).write.parquet(path := str(tmp_path / "none"))
    docs = spark.read.parquet(path)
    for name, stage in P.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0, name


def test_decontamination_sums_cover_all_rows_of_a_stage(spark, monkeypatch, tmp_path):
    """The fit of the fourth stage reads every row it is given, not a draw of them, in one scan for several passes."""
    from pyspark.sql import functions as F

    from plansheet.llm import decontamination as D

    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta w"), F.col("id") % 50, F.lit(" gamma w"), F.col("id") % 7).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha w3 delta"), (2, "beta w5 epsilon")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 1)
    read, sums = [], D._sum_over
    monkeypatch.setattr(D, "_sum_over", lambda df, *rest: read.append((df.count(), [len(x) for x in rest])) or sums(df, *rest))
    P.drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    assert [k for k, _ in read] == [n] and read[0][1] == [2]
