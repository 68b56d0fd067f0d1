import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plansheet.llm import decontamination as D
from plansheet.llm import queries

SCHEMA = "text string, doc_id long, item_id long, contaminated string"


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(-1, 6), max_size=40))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert D.lcs(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_copies_and_paraphrases_are_found_and_clean_text_is_left(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n))
    items = [(i, f"{say(rng.randrange(15, 45))}? {say(4)}.") for i in range(60)] + [(99, ""), (98, None), (None, "x"), (97, "?!")]
    rows, truth = [(None, 0), ("", 1), ("?", 2), ("dup dup", 3), ("dup dup", 3), (say(30_000), 4)], {}
    for k in range(150):
        text = [say(rng.randrange(5, 300)) for _ in range(2)]
        if k % 3 == 0:
            i, t = items[rng.randrange(60)]
            t = t.split()
            if k % 2:  # every eighth word replaced, case and marks changed
                t = [rng.choice(vocab) if j % 8 == 5 and j < len(t) - 4 else x.upper() + "," for j, x in enumerate(t)]
            text.insert(1, " ".join(t))
            truth[100 + k] = i
        rows.append(("\n".join(text), 100 + k))
    docs = spark.createDataFrame([(t, i, 0, "") for t, i in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.contaminated == (r.doc_id in truth) == (r.n_items > 0), r
        assert r.item_ids == ([truth[r.doc_id]] if r.doc_id in truth else []), r
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in D.contamination(docs, none).collect())
    assert D.contamination(spark.createDataFrame([], SCHEMA), bench).collect() == []


def test_recall_against_brute_force(spark):
    """All passages against all items without any test before, on documents of the tables (their choice only bounds the test's time)."""
    d = "/root/testdata/sf0.01"
    docs = queries._docs(spark, d)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    index = D.fit(D.survey(docs.select("text"), items), items)
    texts = [r.text for r in docs.filter("n_chars < 3000").orderBy("doc_id").limit(250).collect()]
    w = D._tokens(pa.array(texts))
    all_pairs = {(k, i) for k, x in enumerate(D.search(index, w, everything=True)) for i, _ in x}
    found = {(k, i) for k, x in enumerate(D.search(index, w)) for i, _ in x}
    print("pairs", len(all_pairs), "found", len(found))
    assert found <= all_pairs and len(found) >= 0.9 * len(all_pairs) > 0


def test_a_pass_never_drops_words(spark):
    """1,000 items of 40 words of their own, each copied into a document: more words than one pass holds."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(1000)]
    assert [len(x) for x in D.passes(items, 1000, 16384)] == [409, 409, 182]
    assert [len(x) for x in D.passes([(1, "a b c d"), (2, "a b"), (3, "e")], 10, 3)] == [1, 2]
    docs = spark.createDataFrame([(f"before {t} after it", i) for i, t in items] + [("nothing of the kind", 5000)], "text string, doc_id long")
    got = {r.doc_id: r.item_ids for r in D.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum(got[i] == [i] for i, _ in items) >= 900 and got[5000] == []


def test_many_passes_and_scans_agree_with_one(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, bench = queries._docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")
    one = {r.doc_id: (r.contaminated, r.item_ids) for r in D.contamination(docs, bench).collect()}
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 9)
    monkeypatch.setattr(D, "PASSES_PER_SCAN", 2)
    many = {r.doc_id: (r.contaminated, r.item_ids) for r in D.contamination(docs, bench).collect()}
    assert one.keys() == many.keys() and sum(one[k][0] != many[k][0] for k in one) <= 0.1 * sum(x for x, _ in one.values()) + 1


def test_the_latent_space_is_that_of_all_passages(spark, monkeypatch):
    """Twice as many documents as were once drawn: the fit's sums are those of every passage, whether by Gram matrix or passage by passage."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 90))) for _ in range(8000)]
    items = [(i, " ".join(rng.sample(vocab, 12))) for i in range(20)]
    corpus = D.survey(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), items)
    monkeypatch.setattr(D, "COMMON", 2.0)
    asked, sums = [], D._sum_over
    monkeypatch.setattr(D, "_sum_over", lambda df, spaces: asked.append(([s for s in spaces], sums(df, spaces))) or asked[-1][1])
    for most in (D.GRAM, 0):
        monkeypatch.setattr(D, "GRAM", most)
        D.fit(corpus, items)
        [(words, idf, x)], [got] = asked.pop()
        w = D._tokens(pa.array(texts))
        _, first, last = D._passages(w)
        p, k, times = D._entries(D._places(words, w.hash), first, last, len(words))
        want = D._gram_times(p, k, D._weights(p, k, times, idf, len(first)), x, len(first))
        assert len(first) == corpus.passages and np.abs(want).max() > 1 and np.allclose(got, want, rtol=1e-3, atol=1e-3 * np.abs(want).max())
