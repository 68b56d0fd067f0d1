"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text of the learning
rows is unlabelled, toxic documents among it included.  A logistic classifier
over the presence of words and word beginnings minimises the class-prior-
corrected risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

by Adam on large mini-batches; where the bracket is negative on one, only the
first term has a gradient.  Features are those that confirmed toxic documents
hold much more often than all documents do, as counted over the whole table.
All learning rows are dealt over groups of bounded size, each learns on
executors, and the model is the groups' average; the driver gets counts and
weights, no texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from . import textcore as C

#: Labelled positives and other documents of a group, in expectation; features kept.
MAX_POSITIVE, MAX_UNLABELLED, FEATURES = 3000, 9000, 1024
#: Ids of positives that are broadcast at most (32 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Share of the positives that must hold a feature (5 documents at least).
MIN_SHARE = 0.005
#: Mini-batches of about 3000 unlabelled documents.
STEPS = 800
#: Word beginnings that count as features, in bytes.
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings of all texts (a matrix), and the bounds of documents' rows."""
    w = C.words(texts, lower=True, kind=C.LETTERS, prefixes=PREFIXES)
    return w.hash, w.off


def _present(features: np.ndarray, texts) -> np.ndarray:
    """Which features each text holds (documents by features)."""
    h, off = _features(texts)
    out = np.zeros((len(off) - 1, len(features)), bool)
    if len(features) and len(h):
        table = np.zeros(1 << 16, bool)  # first a cheap test, as most words are no features
        table[(features >> np.uint64(48)).astype(np.int64)] = True
        word, _ = at = np.nonzero(table[(h >> np.uint64(48)).astype(np.int64)])
        values = h[at]
        place = np.minimum(np.searchsorted(features, values), len(features) - 1)
        hit = features[place] == values
        out[np.searchsorted(off, word[hit], "right") - 1, place[hit]] = True
    return out


def telling(features: np.ndarray, in_positive: np.ndarray, positives: int, in_all: np.ndarray, documents: int, most: int = FEATURES) -> np.ndarray:
    """Sorted features that positives hold much more often than documents at large."""
    chance = max(1, positives) * in_all / max(1, documents)  # positives expected to hold the feature if it meant nothing
    z = (in_positive - chance) / np.sqrt(chance + 1)
    chosen = np.argsort(-z, kind="stable")[:most]
    return np.sort(features[chosen[z[chosen] > 5]])


def _least(positives: int) -> float:
    """Positives that must hold a feature."""
    return max(5, MIN_SHARE * positives)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = FEATURES, seed: int = 5) -> Model:
    """Learn from documents given as sorted distinct feature hashes."""
    def count(docs):
        return np.unique(np.concatenate(docs), return_counts=True) if docs else (np.zeros(0, np.uint64), np.zeros(0, int))

    (fp, cp), (fu, cu) = count(positive), count(unlabelled)
    keep = cp >= _least(len(positive))
    fp, cp = fp[keep], cp[keep]
    at = np.minimum(np.searchsorted(fu, fp), max(0, len(fu) - 1))
    in_u = np.where(fu[at] == fp, cu[at], 0) if len(fu) and len(fp) else np.zeros(len(fp))
    chosen = telling(fp, cp, len(positive), in_u, len(unlabelled), features)
    matrix = lambda docs: np.array([np.isin(chosen, d) for d in docs], np.float32).reshape(len(docs), len(chosen))
    return learn(chosen, matrix(positive), matrix(unlabelled), prior, seed)


def learn(chosen: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Weights of the chosen features from 0/1 rows of positive and unlabelled documents."""
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step, rng = np.zeros_like(w), np.zeros_like(w), 0, np.random.default_rng(seed)
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    if not len(xp) or not len(xu):
        return Model(chosen, w[:-1], float(w[-1]))
    parts = max(1, len(xu) // 3000)
    for _ in range(-(-STEPS // parts)):
        up = rng.permutation(len(xu))
        for part_u, part_p in zip(np.array_split(up, parts), np.array_split(rng.permutation(np.resize(np.arange(len(xp)), max(len(xp), parts))), parts), strict=True):
            p, u = xp[part_p], xu[part_u]
            gp, gu = sig(p @ w[:-1] + w[-1]), sig(u @ w[:-1] + w[-1])
            ones = lambda x: np.append(x[0] @ x[1], x[0].sum()) / len(x[0])
            d_pos = ones((gp - 1, p)) * prior  # of prior * l(g) on positives
            d_neg = ones((gu, u)) - prior * ones((gp, p))
            risk_neg = np.mean(-np.log1p(-np.minimum(gu, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(gp, 1 - 1e-12)))
            grad = (d_pos + d_neg if risk_neg >= 0 else d_pos) + np.append(2e-6 * w[:-1], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from docs (the learning rows only) and labels.

    Every row with a text is learnt from.  Rows are dealt by a hash over groups
    of about max_unlabelled documents without label 1; the documents with label
    1 are dealt over blocks of about max_positive, and each group learns from
    one block, each block with as many groups as the others (one more or less).
    The model is the groups' average, weighted by their documents without label
    1.  Rows without an id have no label.  prior: the share
    of toxic documents among all but the known positives; if None, rows without
    a label are taken to be toxic as often as labelled ones.  It is kept within
    0.02 and 0.5.  Several labels for one id:
    the largest counts.  No positives: a constant score equal to the prior.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("length(text) > 0")
    ids = rows.select("id", F.lit(True).alias("seen")).join(known, "id", "left")  # no text in this shuffle
    n = ids.agg(F.count(F.lit(1)).alias("all"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("positive")).first()
    if prior is None:
        share = n["positive"] / n["labelled"] if n["labelled"] else 0.05
        prior = share * (n["all"] - n["labelled"]) / max(1, n["all"] - n["positive"])
    prior = min(0.5, max(0.02, prior))
    toxic = known.filter("toxic = 1").select("id", F.lit(True).alias("positive"))
    few = toxic.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    spark = docs.sparkSession
    shared.pin_splits(spark)
    draw = F.xxhash64("id", "text", F.spark_partition_id())  # as buckets are dealt: no id and no repeated row is hot
    told = rows.withColumn("draw", draw).join(F.broadcast(toxic) if few else toxic, "id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    with shared.scratch(spark) as cut:
        # copies aren't independent evidence, so equal feature sets count once
        once = cut(told.filter("positive").select("text").mapInArrow(_named, "name binary, text string").groupBy("name").agg(F.min("text").alias("text")).select("text"))
        sets = once.count()
        counts = once.mapInArrow(_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        found = counts.filter(F.col("n") >= _least(sets)).collect()  # some 1 / MIN_SHARE times the features of a document
        features, in_positive = np.array([r["feature"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
        order = np.argsort(features)
        features, in_positive = features[order], in_positive[order]
        held = shared.broadcast(spark, features)

        def count(batches):
            features, total = held.value, np.zeros(len(held.value), np.int64)
            for part in _slices(batches):
                total += _present(features, part.column(0)).sum(0)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["k", "n"])

        in_all = np.zeros(len(features), np.int64)
        if len(features):
            for r in rows.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each feature
                in_all[r["k"]] = r["n"]
        chosen = telling(features, in_positive, sets, in_all, n["all"])
        constant = Model(chosen, np.zeros(len(chosen)), float(np.log(prior / (1 - prior))))
        if not n["positive"] or n["positive"] == n["all"]:
            return constant

        def bits(batches):
            for part in _slices(batches):
                x = _present(chosen, part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["positive", "draw", "bits"])

        dealt = told.select("positive", "draw", "text").mapInArrow(bits, "positive boolean, draw long, bits binary")
        blocks = -(-n["positive"] // max_positive)
        groups = max(blocks, -(-(n["all"] - n["positive"]) // max_unlabelled))
        block = F.pmod("draw", F.lit(blocks)).cast("int")
        of = F.when(F.col("positive"), F.sequence(block, F.lit(groups - 1), F.lit(blocks))).otherwise(F.array(F.pmod("draw", F.lit(groups)).cast("int")))

        def learned(key, table):
            sides = []
            for positive in (True, False):
                own = [b for b, p in zip(table.column("bits").to_pylist(), table.column("positive").to_pylist(), strict=True) if p == positive]
                packed = np.frombuffer(b"".join(sorted(own)), np.uint8).reshape(len(own), -(-len(chosen) // 8))
                sides.append(np.unpackbits(packed, axis=1, count=len(chosen)).astype(np.float32) if len(chosen) else np.zeros((len(own), 0), np.float32))
            m = learn(chosen, *sides, prior)
            size = len(sides[1]) if len(sides[0]) else 0
            return pa.table({"group": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([size], pa.int64()), "body": pa.array([np.append(m.weights, m.bias).tobytes()], pa.binary())})

        # few bytes but seconds of work for a group, so Spark mustn't put many in one task
        each = dealt.select(F.explode(of).alias("group"), "positive", "bits").repartition(min(2 * groups, 1 << 16), "group")
        models = cut(each.groupBy("group").applyInArrow(learned, "group int, n long, body binary"))
        total, weight = np.zeros(len(chosen) + 1), 0
        for r in models.orderBy("group").toLocalIterator():  # 8 KB for each group
            total, weight = total + r["n"] * np.frombuffer(r["body"], np.float64), weight + r["n"]
    return Model(chosen, total[:-1] / weight, float(total[-1] / weight)) if weight else constant


def _named(batches):
    """Texts with the smallest hashes of their features."""
    for part in _slices(batches):
        h, off = _features(part.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([np.unique(h[a:z])[:3].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary()), part.column(0)], ["name", "text"])


def _counts(batches):
    """Features and how many texts hold them, added up while they are not too many."""
    f, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(c)], ["feature", "n"])

    for part in _slices(batches):
        h, off = _features(part.column(0))
        own = np.concatenate([np.zeros(0, np.uint64), *(np.unique(h[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))])
        new, place = np.unique(np.concatenate([f, own]), return_inverse=True)
        c = np.bincount(place, np.append(c, np.ones(len(own), np.int64)), len(new)).astype(np.int64)
        f = new
        if len(f) > 1 << 20:
            yield out()
            f, c = f[:0], c[:0]
    yield out()


def _slices(batches, rows: int = 500):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """A row per input row: id, score (0 to 1, higher: likelier toxic), predicted (1 if score >= threshold).

    Null and empty texts have the score of a text without any feature.  Rows
    that repeat are scored each.  Only id and text are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = shared.broadcast(docs.sparkSession, model)  # FEATURES hashes and weights at most

    def run(batches):
        m = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                g = _present(m.features, part.column(1)) @ m.weights + m.bias
                s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    held = shared.broadcast(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                g = _present(m.features, part.column(at)) @ m.weights + m.bias
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(g, -40, 40))) < threshold))

    return docs.mapInArrow(run, docs.schema)
