import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from plansheet.llm import language_id as L
from plansheet.llm import queries, toxicity

SCHEMA = "text string, doc_id long, lang string, id string, score double"
ODD = [(None, 0), ("", 1), ("12 34 ?!", 2), ("x" * 200_000, 3), ("tie tie", 4), ("tie tie", 4), ("東京", 5), ("n", None)]


def brute_bits(model, text, j):
    """Code length by walking the tree byte by byte."""
    a, bits = model.child.shape[1], 0.0
    before = [0] * L.ORDER
    for byte in text.encode():
        s, node = int(model.symbol[byte]), 0
        for k in range(1, L.ORDER + 1):
            deeper = model.child[node, before[-k]]
            if deeper < 0:
                break
            node = deeper
        bits += float(model.bits[node * a + s, j]) + (model.extra if s == 1 else 0)
        before.append(s)
    return bits


def test_code_lengths_and_distributions():
    samples = {"en": ["the thing and the other thing that was here", "then there"], "de": ["der die das und nicht ein über", "schön die"], "xx": ["zzz"]}
    m = L.train(samples)
    texts = ["the other", "", "über die Ö", "zzzz", "\x00\x7f", "a"]
    got = L.code_lengths(m, pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(got[i], [brute_bits(m, t, j) for j in range(3)], rtol=1e-4)
    a = m.child.shape[1]
    assert np.allclose(np.exp2(-m.bits.reshape(-1, a, 3)).sum(1), 1, atol=1e-3)
    assert [m.languages[i] for i in got.argmin(1)[[0, 2, 3]]] == ["en", "de", "xx"]


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(t, i, "en", "z", 0.5) for t, i in ODD], SCHEMA)
    got = L.predict(df, L.fit(df)).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"en"} and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert L.fit(empty) is None and L.predict(empty, None).collect() == []
    assert {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}


def test_language_query_against_code_lengths_byte_by_byte(spark):
    """The registered query's language has the shortest code, and its score is that code's share, for whole texts."""
    d = "/root/testdata/sf0.001"
    docs = queries._docs(spark, d)
    model = L.fit(docs.filter(queries._fold(4) != 2))
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text or "") > 1500:  # long texts take the plain walk too long; they are scored by the same code
            continue
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        bits = np.array([brute_bits(model, r.text, j) for j in range(len(model.languages))])
        assert got[r.doc_id].lang_pred == model.languages[int(bits.argmin())]
        assert abs(got[r.doc_id].score - 1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum()) < 1e-3


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, d).collect()}
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars").collect()
    assert len(got) == len(truth) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in truth)
    right = [got[r.doc_id].lang_pred == r.lang for r in truth if got[r.doc_id].held_out]
    assert np.mean(right) > 0.97


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(t, i, "en", "z", 0.5) for t, i in ODD], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    m = toxicity.fit(df, none)
    got = toxicity.score(df, m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    labels = spark.createDataFrame([(3, 1, ""), (3, 0, ""), (1, 0, ""), (None, 1, ""), (4, None, "")], "doc_id long, toxic int, text string")
    toxicity.score(df, toxicity.fit(df, labels)).collect()
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []


def test_positive_unlabelled_learning_finds_hidden_positives():
    rng = np.random.default_rng(1)
    plain = lambda: rng.integers(1000, 3000, 30, dtype=np.uint64)
    toxic = lambda: np.append(plain(), rng.integers(0, 8, 2, dtype=np.uint64))
    sets = lambda make, n: [np.unique(make()) for _ in range(n)]
    m = toxicity.train(sets(toxic, 300), sets(toxic, 200) + sets(plain, 1800), 0.1)

    def rate(docs):
        return np.mean([m.bias + m.weights[np.isin(m.features, d)].sum() > np.log(0.7 / 0.3) for d in docs])

    assert rate(sets(toxic, 500)) > 0.95 and rate(sets(plain, 500)) < 0.02


def test_toxicity_learns_from_every_document(spark):
    """Features are counted in all positives, and each document, however many there are, has its part in the weights."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    plain = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 3)) for _ in range(12))
    toxic = [plain() + (" vermin" if i % 2 else " scum") + (" rogue" if i % 7 == 0 else "") for i in range(200)]
    other = [plain() + (" scum" if i % 40 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")

    def fit(texts):
        return toxicity.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels, max_positive=20, max_unlabelled=40)

    m = fit(toxic + other)
    assert all(toxicity._features(pa.array([w]))[0][0, 0] in m.features for w in ("vermin", "scum", "rogue"))
    last = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    at = spark.range(201, 600).filter("id % 40 <> 0").orderBy(last.desc()).first()[0]  # no draw by this hash of the id took it
    changed = toxic + other
    changed[at] += " vermin"
    again, other_doc = fit(toxic + other), fit(changed)
    assert np.array_equal(m.weights, again.weights) and np.array_equal(m.features, other_doc.features)
    assert not np.array_equal(m.weights, other_doc.weights)


def test_toxicity_score_equals_a_plain_reading(spark):
    """The registered query's score is the logistic of the weights of the words and word beginnings that a text holds."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, labels = queries._docs(spark, d), spark.read.parquet(f"{d}/labels.parquet")
    m = toxicity.fit(docs.filter(queries._fold(3) != 1), labels.filter(queries._fold(3) != 1))
    weight = dict(zip(m.features.tolist(), m.weights.tolist(), strict=True))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in queries.QUERIES["op4_toxicity"](spark, d).collect()}
    for r in docs.filter(F.col("doc_id") % 5 == 0).collect():
        held = set()
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (r.text or "").encode()):
            held |= {int(x) for x in toxicity._features(pa.array([word.decode()]))[0].reshape(-1)}
        want = 1 / (1 + math.exp(-max(-40, min(40, m.bias + sum(weight.get(h, 0.0) for h in held)))))
        assert math.isclose(got[r.doc_id][0], want, rel_tol=1e-9) and got[r.doc_id][1] == (want >= 0.7)
        assert got[r.doc_id][2] == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert len(got) == docs.count()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op4_toxicity"](spark, d).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{d}/labels.parquet'").df()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    hit = both[both.toxic == 1].predicted.mean()
    wrong = both[both.toxic == 0].predicted.mean()
    print("toxic found", hit, "clean rejected", wrong)
    assert hit > 0.8 and wrong < 0.03
