import hashlib
import random
import re
from collections import Counter

import pytest

from plansheet.llm import exchange as X
from plansheet.llm.substring_dedup import levels, remove_repeats

SCHEMA = "text string, doc_id long, b string, owner string"


def brute(texts, window):
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts, window):
    df = spark.createDataFrame([(t, i, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in remove_repeats(df, window=window).collect()}
    assert len(got) == len(texts)
    for i, (n, gone, kept) in enumerate(brute(texts, window)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, kept), i
        assert sum(s.end - s.start for s in r.spans) == gone


@pytest.mark.parametrize("packed", [X.PACKED, 0])
def test_against_brute_force(spark, monkeypatch, packed):
    monkeypatch.setattr(X, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(X, "PACKED", packed)  # 0: hashes travel as rows
    rng = random.Random(3)
    passage = [" ".join(rng.choice("abcdefghé") for _ in range(k)) for k in (5, 9, 35, 60)]
    texts = [None, "", " \t\n", "a", "a " * 200, "one two three"]
    for _ in range(60):
        t = [" ".join("".join(rng.choice("xyzw") for _ in range(3)) for _ in range(rng.randrange(40))) for _ in range(3)]
        t.insert(1, rng.choice(passage))
        texts.append(rng.choice([" ", "\n", "\x0b\t"]).join(t))
    texts += texts[-3:]
    for window in (2, 8, 35) if packed else (35,):
        check(spark, texts, window)


def test_nonbreaking_space_is_no_separator(spark):
    check(spark, ["a b c d " * 30, "é" * 50 + " x"], 4)


def test_lengths_double():
    assert levels(35) == [9, 18, 35] and levels(72) == [9, 18, 36, 72] and levels(5) == [5]
    assert all(b <= 2 * a for w in range(2, 300) for a, b in zip(levels(w), levels(w)[1:], strict=False))


def test_repeated_rows_are_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_BYTES", 100)
    df = spark.createDataFrame([("a b c", None, "", "")] * 400, SCHEMA).repartition(4)
    rows, n = X.bucketed(df, "doc_id", "text")
    assert n > 4 and rows.select("b").distinct().count() > 1
    assert all((r.n_words, r.n_removed) == (3, 3) for r in remove_repeats(df, window=2).collect())


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_digest(spark):
    from plansheet.llm import queries

    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.QUERIES["op1_substring_dedup"](spark, d).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = sorted(docs)
    for i, (n, gone, kept) in zip(ids, brute([docs[i] for i in ids], 35), strict=True):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
