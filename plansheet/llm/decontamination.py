"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages.  Passages and benchmark items are
TF-IDF vectors over the items' words (other words can't tell items apart), with
document frequencies counted over all passages of all documents.  A distributed
randomised SVD (Gram matrix times random directions, Nystrom) of all passages
of all documents stacked on all items gives the latent space; every passage is
then projected, and items with a high cosine are its candidates.  A candidate counts
if the longest common subsequence of words covers most of the item, or, for a
paraphrase, a good part of it and the words of its answer as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textcore as C

#: Words in a passage and between starts of passages.
PASSAGE, STRIDE = 64, 32
#: Latent dimensions, extra random directions.
RANK, EXTRA = 96, 16
#: Numbers of a scan's Gram matrices that a task holds; passes of more words are projected passage by passage, with the same sum.
GRAM = 1 << 24
#: A pass holds items until it has so many, or so many distinct words; so many passes search the documents in one scan.
ITEMS_PER_PASS, WORDS_PER_PASS, PASSES_PER_SCAN = 1000, 1 << 14, 4
#: Words of a larger share of passages tell nothing.
COMMON = 0.05
#: Least cosine of a candidate; share of an item that its common subsequence must cover alone, and together with the answer.
COSINE, COPIED, PARAPHRASED = 0.42, 0.6, 0.5


@dataclass
class Index:
    words: np.ndarray  # sorted hashes of the items' words
    idf: np.ndarray
    basis: np.ndarray | None  # words x latent dimensions
    latent: np.ndarray | None  # items x latent dimensions, of length 1
    ids: list[int]
    items: list[np.ndarray]  # places of each item's words among words
    answers: list[np.ndarray]


def _tokens(texts) -> C.Words:
    return C.words(texts, lower=True, kind=_WORDS)


_WORDS = C.LETTERS.copy()
_WORDS[48:58] = True  # digits: answers are often numbers


def _places(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash among words, -1 if it is none of them."""
    out = np.full(len(h), -1, np.int64)
    table = np.zeros(1 << 16, bool)
    table[(words >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, h[maybe]), len(words) - 1)
    hit = words[at] == h[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _passages(w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last word of every passage."""
    count = np.where(w.lens > 0, np.maximum(1, -(-(w.lens - PASSAGE) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = w.off[doc] + nth * STRIDE
    return doc, first, np.minimum(first + PASSAGE, w.off[doc + 1])


def _entries(place: np.ndarray, first: np.ndarray, last: np.ndarray, features: int):
    """(passage, word, times) of all words of all passages that are features."""
    known = np.flatnonzero(place >= 0)
    a, z = np.searchsorted(known, first), np.searchsorted(known, last)
    n = z - a
    which = np.repeat(np.arange(len(first)), n)
    at = known[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
    key, times = np.unique(which * features + place[at], return_counts=True)
    return key // features, key % features, times


def _weights(passage: np.ndarray, word: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    value = (1 + np.log(times)) * idf[word]
    length = np.sqrt(np.bincount(passage, value * value, n))
    return (value / np.maximum(length[passage], 1e-12)).astype(np.float32)


def _project(passage, word, value, basis: np.ndarray, n: int) -> np.ndarray:
    """Rows of A @ basis; passage is sorted."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    if len(passage):
        cut = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        out[passage[cut]] = np.add.reduceat(basis[word] * value[:, None], cut, axis=0)
    return out


def _gram_times(passage, word, value, x: np.ndarray, n: int) -> np.ndarray:
    """A.T @ (A @ x)."""
    y = _project(passage, word, value, x, n)
    order = np.argsort(word, kind="stable")
    out = np.zeros_like(x)
    if len(order):
        word, passage, value = word[order], passage[order], value[order]
        cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[cut]] = np.add.reduceat(y[passage] * value[:, None], cut, axis=0)
    return out


def lcs(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of places, bit-parallel; -1 matches nothing."""
    at: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(item)) - 1, (1 << len(item)) - 1
    for x in region.tolist():
        m = at.get(x, 0) if x >= 0 else 0
        if m:
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(item) - row.bit_count()


def _tight(item: np.ndarray, region: np.ndarray) -> int:
    """The longest common subsequence within any stretch of the region about as long as the item."""
    span = max(8, len(item) * 3 // 2)
    if len(region) <= span:
        return lcs(item, region)
    return max(lcs(item, region[a : a + span]) for a in range(0, len(region) - span // 2, max(1, span // 4)))


def _answer(text: str, places: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The item's answer: the three rarest words of its last sentence."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
    n = max(3, len(_tokens(pa.array(sentences[-1:])).start) if sentences else 0)
    tail = np.unique(places[-n:])
    return tail[np.argsort(-idf[tail], kind="stable")][:3]


def _each(df: DataFrame, kernel, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                yield from kernel(batch.slice(lo, 500))

    return df.mapInArrow(run, schema)


def _add_gram(gram: np.ndarray, passage: np.ndarray, word: np.ndarray, value: np.ndarray) -> None:
    """Adds A.T @ A to gram (flat); passage is sorted."""
    cut = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
    n = np.diff(np.append(cut, len(passage)))
    each = np.repeat(n, n)  # entries of each entry's passage
    one = np.repeat(np.arange(len(passage)), each)
    other = np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(cut, n), each)
    np.add.at(gram, word[one] * round(len(gram) ** 0.5) + word[other], value[one] * value[other])


def _sum_over(df: DataFrame, spaces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A.T @ (A @ x) over all passages of df (text) for each (words, idf, x), in one scan: a task's sums meet on executors in row blocks."""
    held, step, most = shared.broadcast(df.sparkSession, spaces), 512, GRAM  # for each pass, its words times RANK + EXTRA floats

    def part(batches):
        spaces, left, grams, totals = held.value, most, [], []
        for words, _, x in spaces:
            fits = len(words) ** 2 <= left
            left -= len(words) ** 2 if fits else 0
            grams.append(np.zeros(len(words) ** 2, np.float32) if fits else None)
            totals.append(np.zeros_like(x))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                w = _tokens(batch.column(0).slice(lo, 200))
                _, first, last = _passages(w)
                for (words, idf, x), gram, total in zip(spaces, grams, totals, strict=True):
                    p, k, times = _entries(_places(words, w.hash), first, last, len(words))
                    use = idf[k] > 0
                    p, k, times = p[use], k[use], times[use]
                    value = _weights(p, k, times, idf, len(first))
                    if gram is not None:
                        _add_gram(gram, p, k, value)
                    else:
                        total += _gram_times(p, k, value, x, len(first))
        for nth, ((_, _, x), gram, total) in enumerate(zip(spaces, grams, totals, strict=True)):
            if gram is not None:
                total = gram.reshape(len(x), len(x)) @ x
            at = list(range(0, len(x), step))
            yield pa.RecordBatch.from_arrays([pa.array([nth] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([total[a : a + step].tobytes() for a in at], pa.binary())], ["nth", "at", "body"])

    def add(key, table):
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in table.column("body").to_pylist())
        return pa.table({"nth": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out, form = [np.zeros_like(x) for _, _, x in spaces], "nth int, at int, body binary"
    for r in df.mapInArrow(part, form).groupBy("nth", "at").applyInArrow(add, form).collect():
        body = np.frombuffer(r["body"], np.float32).reshape(-1, out[r["nth"]].shape[1])
        out[r["nth"]][r["at"] : r["at"] + len(body)] = body
    return out


@dataclass
class Corpus:
    """What all passes share: sorted hashes of all items' words, the passages that hold each, all passages, and the texts."""

    words: np.ndarray
    held_by: np.ndarray
    passages: int
    texts: DataFrame

    def idf(self, words: np.ndarray) -> np.ndarray:
        n = self.held_by[np.searchsorted(self.words, words)]
        out = np.log((self.passages + 1) / (n + 1))
        return np.maximum(np.where(n > COMMON * self.passages + 5, 0, out), 0)  # words of most passages tell nothing


def survey(texts: DataFrame, items: list[tuple[int, str]]) -> Corpus:
    """One scan of all texts (one column) counts the passages of every word of any item."""
    words = np.unique(_tokens(pa.array([t for _, t in items], pa.large_string())).hash) if items else np.zeros(0, np.uint64)
    spark = texts.sparkSession
    held = shared.broadcast(spark, words)  # 8 bytes for each word of the benchmark

    def count(batches):
        words = held.value
        total = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                t = _tokens(batch.column(0).slice(lo, 500))
                _, first, last = _passages(t)
                if len(words):
                    _, k, _ = _entries(_places(words, t.hash), first, last, len(words))
                    total[:-1] += np.bincount(k, minlength=len(words))
                total[-1] += len(first)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["k", "n"])

    n = np.zeros(len(words) + 1, np.int64)
    for r in texts.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each word
        n[r["k"]] = r["n"]
    return Corpus(words, n[:-1], int(n[-1]), texts)


def passes(items: list[tuple[int, str]], most_items: int, most_words: int) -> list[list[tuple[int, str]]]:
    """Items in runs of at most so many items or distinct words; an item never splits, however many words it has."""
    out, run, known = [], [], set()
    for i, t in items:
        own = set(_tokens(pa.array([t], pa.large_string())).hash.tolist())
        if run and (len(run) >= most_items or len(known | own) > most_words):
            out.append(run)
            run, known = [], set()
        run.append((i, t))
        known |= own
    return out + [run] if run else out


def fit(corpus: Corpus, items: list[tuple[int, str]], rank: int = RANK) -> Index:
    """The latent space of all passages of the corpus and the items of one pass."""
    return fit_passes(corpus, [items], rank)[0]


def fit_passes(corpus: Corpus, runs: list[list[tuple[int, str]]], rank: int = RANK) -> list[Index]:
    """fit() of several passes in one scan of all texts."""
    out, wanted = [], []
    for items in runs:
        w = _tokens(pa.array([t for _, t in items], pa.large_string()))
        words = np.unique(w.hash)
        place = _places(words, w.hash) if len(words) else np.zeros(0, np.int64)
        parts = [place[a:z] for a, z in zip(w.off[:-1], w.off[1:], strict=True)]
        out.append(Index(words, np.zeros(0), None, None, [i for i, _ in items], parts, parts))
        if len(words):
            out[-1].idf = corpus.idf(words)
            x = np.random.default_rng(9).normal(size=(len(words), min(rank + EXTRA, len(words))))
            wanted.append((items, out[-1], np.linalg.qr(x)[0].astype(np.float32)))
    sums = _sum_over(corpus.texts, [(index.words, index.idf, x) for _, index, x in wanted]) if wanted else []
    for (items, index, x), found in zip(wanted, sums, strict=True):
        lens = np.array([len(p) for p in index.items])
        off = np.concatenate([[0], np.cumsum(lens)])
        p, k, times = _entries(np.concatenate(index.items), off[:-1], off[1:], len(index.words))
        value = _weights(p, k, times, index.idf, len(lens))
        weight = max(1.0, corpus.passages / len(lens))  # items weigh as much as all passages
        index.basis = _leading(found + weight * _gram_times(p, k, value, x, len(lens)), x, rank)
        latent = _project(p, k, value, index.basis, len(lens))
        index.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        index.answers = [_answer(t, own, index.idf) if len(own) else own for (_, t), own in zip(items, index.items, strict=True)]
    return out


def _leading(y: np.ndarray, x: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix of which y is the product with the orthonormal x (Nystrom)."""
    y, x = y.astype(np.float64), x.astype(np.float64)
    small = x.T @ y
    value, u = np.linalg.eigh((small + small.T) / 2)
    sure = value > 1e-6 * max(value[-1], 1e-30)
    vectors, _, _ = np.linalg.svd(y @ (u[:, sure] / np.sqrt(value[sure])), full_matrices=False)
    return vectors[:, :rank].astype(np.float32)


def search(index: Index, w: C.Words, everything: bool = False) -> list[list[tuple[int, float]]]:
    """For each text its items with their covered share.  everything: check all items in all passages, with no test before (for tests)."""
    found: list[dict[int, float]] = [{} for _ in range(len(w.off) - 1)]
    if not len(index.words) or not len(w.start):
        return [[] for _ in found]
    doc, first, last = _passages(w)
    place = _places(index.words, w.hash)
    if everything:
        pairs = [(p, i) for p in range(len(first)) for i in range(len(index.items))]
    else:
        p, k, times = _entries(place, first, last, len(index.words))
        use = index.idf[k] > 0
        p, k, times = p[use], k[use], times[use]
        value = _weights(p, k, times, index.idf, len(first))
        pairs = []
        for lo in range(0, len(first), 4096):
            hi = min(lo + 4096, len(first))
            a, z = np.searchsorted(p, [lo, hi])
            y = _project(p[a:z] - lo, k[a:z], value[a:z], index.basis, hi - lo)
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
            row, item = np.nonzero(y @ index.latent.T >= COSINE)
            pairs += zip((row + lo).tolist(), item.tolist(), strict=True)
    own = [np.unique(x) for x in index.items]
    told = [index.idf[x] for x in own]
    least = [PARAPHRASED * x.sum() for x in told]
    held = np.zeros(len(index.words) + 1, bool)  # the last place stands for all other words
    for p, i in pairs:
        d, item = doc[p], index.items[i]
        n = len(item)
        if not n:
            continue
        a, z = max(w.off[d], first[p] - n), min(w.off[d + 1], last[p] + n)
        region = place[a:z]
        held[region] = True
        telling = everything or told[i][held[own[i]]].sum() >= least[i]
        held[region] = False
        if not telling:
            continue
        share = _tight(item, region) / n
        if share >= COPIED or share >= PARAPHRASED and np.isin(index.answers[i], region).all():
            found[d][i] = max(share, found[d].get(i, 0.0))
    return [sorted((index.ids[i], s) for i, s in x.items()) for x in found]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per input row: id, contaminated, n_items, item_ids (sorted), best_share (0 if none).

    Words are runs of letters and digits, lower-cased A-Z only.  Null and empty
    texts and items match nothing, and neither do items without a word or with
    a null id.  Items of equal text all count; items of equal id are one.  Items
    are taken in passes of bounded size, a few passes a scan (and one to fit them), and a scan's
    models go when it ends, so memory keeps its size however long the benchmark
    is.  Rows that repeat get the same answer.  Of docs, only id and text are
    read; no rows or no items give n_items 0 everywhere.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = [F.xxhash64("id", "text").alias("k"), F.xxhash64("text", F.lit(5), "id").alias("l")]  # rows of equal content share their hits
    wanted = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("i IS NOT NULL AND length(t) > 0")
    items = [(r["i"], r["t"]) for r in wanted.orderBy("i", "t").toLocalIterator()]  # the benchmark
    hits = spark.createDataFrame([], "k long, l long, item long, share double")
    if items:
        corpus = survey(rows.select("text"), items)
        runs = passes(items, ITEMS_PER_PASS, WORDS_PER_PASS)
        for at in range(0, len(runs), PASSES_PER_SCAN):
            held = shared.broadcast(spark, fit_passes(corpus, runs[at : at + PASSES_PER_SCAN]))
            hits = hits.unionByName(shared.table(rows.select(*key, "text").mapInArrow(_judge(held), hits.schema)))
    by = hits.groupBy("k", "l").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("share").alias("best_share"))
    found = rows.select("id", *key).join(by, ["k", "l"], "left")
    return found.select(
        F.col("id").alias(id_col), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"),
    )


def _judge(held):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                w = _tokens(part.column(2))
                out = [(row, i, s) for index in held.value for row, x in enumerate(search(index, w)) for i, s in x]
                at, item, share = zip(*out, strict=True) if out else ((), (), ())
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(item, pa.int64()), pa.array(share, pa.float64())], ["k", "l", "item", "share"])

    return run
