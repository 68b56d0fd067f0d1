"""Language identification by prediction by partial matching (PPM).

For every language the training texts give a tree of byte contexts of up to
ORDER bytes.  The statistics are then frozen: a context's distribution gives a
seen byte c/(n+d), where d bytes have been seen n times in all, and escapes
with probability d/(n+d) to the context that is shorter by a byte, without the
bytes just ruled out.  Distributions sum to one exactly, so the sum of
-log2 p over a text is its exact code length; the shortest code wins.  All
languages share one tree of contexts, walked by table look-ups for all bytes
of a batch at once.
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

#: Longest context in bytes; documents per language learnt from at most in expectation; floats in the table of code lengths at most.
ORDER, DOCS_PER_LANGUAGE, TABLE_FLOATS = 4, 400, 6 << 20
#: Symbols: 0 stands before the text's start, 1 for all rare bytes, then the most frequent bytes.
MAX_SYMBOLS = 120
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    extra: float  # bits that name a byte within symbol 1
    child: np.ndarray  # (node, symbol before the context) -> node, -1 if none
    bits: np.ndarray  # (node * symbols + symbol, language) -> code length


def _symbols(symbol: np.ndarray, data: np.ndarray, off: np.ndarray, order: int):
    """Symbols of all texts with `order` start symbols before each, and where the texts' own are."""
    lens = np.diff(off)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(off)) * order, lens)
    out = np.zeros(len(data) + order * (len(off) - 1), np.int64)
    out[at] = symbol[data]
    return out, at


def train(samples: dict[str, list[str]], order: int = ORDER, table_floats: int = TABLE_FLOATS) -> Model:
    """Context trees of all languages; sample texts must not be empty overall."""
    languages = sorted(samples)
    raws = {x: C.raw(pa.array(samples[x], pa.large_string())) for x in languages}
    freq = sum(np.bincount(raws[x][0], minlength=256) for x in languages)
    common = np.argsort(-freq, kind="stable")[: MAX_SYMBOLS - 2]
    common = common[freq[common] > 0]
    symbol = np.ones(256, np.int64)
    symbol[common] = np.arange(2, 2 + len(common))
    a = 2 + len(common)
    extra = float(np.log2(max(1, 256 - len(common))))
    room = max(64, table_floats // (a * len(languages)))

    grams = []  # grams[d][language]: codes of d context symbols (nearest first) and the symbol, with counts
    for d in range(order + 1):
        grams.append([])
        for x in languages:
            s, at = _symbols(symbol, *raws[x], order)
            code = np.zeros(len(at), np.int64)
            for k in range(1, d + 1):
                code = code * a + s[at - k]
            grams[d].append(np.unique(code * a + s[at], return_counts=True))

    # the tree: contexts kept by depth, the most frequent first where room is short
    depth_codes = [np.zeros(1, np.int64)]
    nodes = 1
    child = [np.full((1, a), -1, np.int64)]
    first = [0]
    for d in range(1, order + 1):
        code = np.concatenate([g // a for g, _ in grams[d]])
        n = np.concatenate([c for _, c in grams[d]])
        code, place = np.unique(code, return_inverse=True)
        n = np.bincount(place, n)
        parent = np.searchsorted(depth_codes[-1], code // a)
        parent = np.minimum(parent, len(depth_codes[-1]) - 1)
        keep = (depth_codes[-1][parent] == code // a) & (n >= (1 if d < 3 else 4))
        if keep.sum() > max(0, room - nodes):
            keep &= n >= np.sort(n[keep])[::-1][max(0, room - nodes - 1)] if room > nodes else False
            if keep.sum() > room - nodes:
                keep[np.flatnonzero(keep)[max(0, room - nodes) :]] = False
        code, parent = code[keep], parent[keep]
        first.append(nodes)
        child[-1][parent, code % a] = nodes + np.arange(len(code))
        child.append(np.full((len(code), a), -1, np.int64))
        depth_codes.append(code)
        nodes += len(code)
        if not len(code):
            depth_codes, child, first = depth_codes[:-1], child[:-1], first[:-1]
            break

    bits = np.empty((nodes * a, len(languages)), np.float32)
    for j, _ in enumerate(languages):
        above = None
        for d, code in enumerate(depth_codes):
            g, c = grams[d][j]
            row = np.searchsorted(code, g // a)
            row = np.minimum(row, len(code) - 1)
            hit = code[row] == g // a
            seen = np.zeros((len(code), a))
            seen[row[hit], (g % a)[hit]] = c[hit]
            if d == 0:  # the start symbol is never coded; every other one has a share
                p = seen + 0.5
                p[:, 0] = 0
                p /= p.sum(1, keepdims=True)
            else:
                up = above[np.searchsorted(depth_codes[d - 1], code // a)]
                n, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
                rest = np.where(seen > 0, 0, up)
                left = rest.sum(1, keepdims=True)
                escape = np.where(left > 0, kinds / np.maximum(n + kinds, 1), 0)
                p = np.where(n > 0, seen / np.maximum(n, 1) * (1 - escape) + rest / np.where(left > 0, left, 1) * escape, up)
            above = p
            with np.errstate(divide="ignore"):
                bits[first[d] * a : (first[d] + len(code)) * a, j] = -np.log2(np.maximum(p, 1e-30)).reshape(-1)
    return Model(languages, symbol, extra, np.concatenate(child), bits)


def code_lengths(model: Model, texts: pa.Array, order: int = ORDER) -> np.ndarray:
    """Bits of every text (row) in every language (column)."""
    data, off = C.raw(texts)
    a = model.child.shape[1]
    flat, total = model.child.reshape(-1), np.zeros((len(off) - 1, len(model.languages)))
    for lo, hi in C.blocks(off, 1 << 18):
        part, cut = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if not len(part):
            continue
        s, at = _symbols(model.symbol, part, cut, order)
        node, on = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(1, order + 1):
            deeper = flat[node[on] * a + s[at[on] - k]]
            found = deeper >= 0
            on = on[found]
            node[on] = deeper[found]
        own = s[at]
        cost = model.bits[node * a + own]
        cost[own == 1] += model.extra
        full = np.flatnonzero(np.diff(cut) > 0)
        total[lo + full] = np.add.reduceat(cost.astype(np.float64), cut[full], axis=0)
    return total


def _has_letter(texts: pa.Array) -> np.ndarray:
    data, off = C.raw(texts)
    sums = np.concatenate([[0], np.cumsum(C.LETTERS[data] & (data < 128))])
    found = np.diff(sums[off]) > 0
    wide = np.diff(np.concatenate([[0], np.cumsum(data >= 128)])[off]) > 0
    for i in np.flatnonzero(wide & ~found):
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Learn from rows with a language; None if there are none with any text.

    About docs_per_language whole texts of each language are drawn by a hash of
    id and text (all, if there are fewer); counts decide the share drawn.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL AND length(text) > 0")
    share = {r["lang"]: docs_per_language / r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    draw = F.pmod(F.xxhash64("id", "text", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter(draw < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang")))
    samples: dict[str, list[str]] = {x: [] for x in share}
    for r in chosen.select("lang", "text").toLocalIterator():
        samples[r["lang"]].append(r["text"])
    samples = {x: sorted(t) for x, t in samples.items() if t}
    return train(samples) if samples else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, lang_pred, score.

    lang_pred is the language with the shortest code (ties: first by name), or
    'und' with score 0 for null text, text without a letter, or no model.
    score: its probability if all languages are equally likely beforehand.
    Only id and text are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = shared.broadcast(docs.sparkSession, model)  # of bounded size: TABLE_FLOATS

    def run(batches):
        m = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(1).fill_null("")
                if m is None:
                    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    bits = code_lengths(m, texts)
                    best = bits.argmin(1)
                    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    known = _has_letter(texts)
                    names = [m.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score = np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
