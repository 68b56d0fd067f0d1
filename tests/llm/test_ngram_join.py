import pathlib
import random
import re

import numpy as np
import pytest

from plansheet.llm import exchange as X
from plansheet.llm import ngram_join as J
from plansheet.llm import shared

SCHEMA = "text string, doc_id long, c string, b string, n long"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, n, num, den):
    sets = []
    for t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[top(i)] = top(j)
    low = {}
    for i, (_, d) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted((str(d), len(s), str(low.get(top(i)))) for i, ((_, d), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2)])
def test_linked_sets_always_share_a_signature(num, den):
    rng = np.random.default_rng(num)
    for size in [*range(1, 60), 75, 100, 141, 200, 500, 1200]:
        for _ in range(6):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            for drop in {0, 1, size // 20, size // 10, size // 5, size // 3}:
                for add in {0, 1, size // 25, size // 12, size // 4}:
                    b = np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)])
                    both, either = size - drop, size + add
                    if 0 < len(b) and den * both >= num * either and (drop or add):
                        x, y = J.signatures(a, num, den), J.signatures(b, num, den)
                        # in some band, both share at least as many as each needs
                        assert any(len(np.intersect1d(p, q)) >= max(m, n) for p, m in x for q, n in y)


def test_one_deletion_neighbourhoods(monkeypatch):
    monkeypatch.setattr(J, "allocate", lambda k, size: (0, (k + 2) // 2, 1) if k % 2 == 0 else (1, (k + 1) // 2, 1))
    J.bands.cache_clear()
    try:
        test_linked_sets_always_share_a_signature(90, 100)
        test_linked_sets_always_share_a_signature(80, 100)
    finally:
        J.bands.cache_clear()


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_components(spark, monkeypatch, n, num):
    monkeypatch.setattr(X, "BUCKET_BYTES", 16000)
    monkeypatch.setattr(J, "BLOCK", 3 if n == 5 else 256)
    rng = random.Random(n)
    vocab = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(300)]
    texts = [None, "", "  ", "one", "One", "two words", "a b c", "A b\tc"]
    for size in (12, 40, 150):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts += [" ".join(t)] * rng.choice([1, 1, 2])
        base = list(base)  # a chain in which each differs a little from the one before
        for i in range(20):
            base[(i * 7) % size] = rng.choice(vocab)
            texts.append("\n".join(base))
    rows = [(t, i) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(rows[0][0], rows[0][1]), (rows[20][0], None), ("only null id", None)]
    df = spark.createDataFrame([(t, i, "", "", 0) for t, i in rows], SCHEMA)
    got = J.jaccard_components(df, n=n, num=num, den=100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, n, num, 100)


@pytest.mark.parametrize("small", [0, 1000])
def test_long_paths_and_empty_table(spark, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL_LINKS", small)
    pairs = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(40)] + [(b"x", b"y")]
    got = J.components(spark.createDataFrame(pairs, "a binary, z binary")).collect()
    assert {bytes(r.root) for r in got if bytes(r.c) < b"x"} == {b"000"} and len(got) == 43
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tables_of_a_few_bytes_a_document_have_few_files(spark, monkeypatch):
    """One file for each 16 buckets, not one for each bucket, and no table of what is read once."""
    monkeypatch.setattr(X, "BUCKET_BYTES", 1 << 13)
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base + [t + f" end{i}" for i, t in enumerate(base)] + base[:20])], "doc_id long, text string")
    buckets, found, write = -(-X.text_bytes(docs, "text") // X.BUCKET_BYTES), [], shared.write
    assert buckets > 12

    def written(df, path):
        write(df, path)
        found.append((df.columns, len(list(pathlib.Path(path.removeprefix("file:")).glob("part-*")))))

    monkeypatch.setattr(shared, "write", written)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == {i: i % 150 for i in range(320)}
    small = [n for columns, n in found if columns in (["b", "id", "n_shingles", "c"], ["a", "z"], ["c", "component_id", "component_rows"])]
    assert len(small) >= 3 and max(small) <= -(-buckets // 16)
    assert ["c", "n", "weight", "s", "band", "need"] not in [columns for columns, _ in found]
