"""Removal of repeated word passages by level-wise doubling.

The lengths looked at double from a few words up to L (9, 18 and 35 words for
L = 35; a length is rounded up where L isn't a power of two times the first).
At each length, only windows that repeat are extended to the next: an L-run is
represented by the smallest-hashed window of that length inside it, so two
equal L-runs have equal representatives at every length, and an L-run whose
representative occurs at one place alone can't repeat and is given up.  Neighbouring
L-runs mostly share their representative, so a level moves about a fourteenth
of all window hashes and later ones only those of surviving candidates; where
none survive, a level sends nothing.  Doubling stops at L: a longer repeat
consists of repeats of L words.  Shorter levels use 64-bit hashes (a collision
only makes a needless candidate), the last one 128-bit ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import exchange as X
from . import textcore as C

#: Words in a passage, and least words of the first level.
WINDOW, FIRST = 35, 9


def levels(window: int) -> list[int]:
    """The doubling lengths, ascending; the last is the window."""
    out = [window]
    while out[0] > FIRST:
        out.insert(0, -(-out[0] // 2))
    return out


def _representatives(w: C.Words, starts: np.ndarray, length: int, window: int):
    """Hashes of the starts' representatives (one for each place), and for each start the number of its own."""
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    h = C.window_hashes(w.hash, length)
    low = np.uint64((1 << max(20, int(len(h)).bit_length())) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (C.sliding_min(key, window - length + 1)[starts] & low).astype(np.int64)
    first = np.append(True, at[1:] != at[:-1])
    return h[at[first]], np.cumsum(first) - 1


def _wide(w: C.Words, starts: np.ndarray, window: int):
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return C.window_hashes(w.hash, window)[starts], C.window_hashes(w.hash, window, 1)[starts]


def _candidates(w: C.Words, answers: pa.Table | None, window: int, n: int, upto: int) -> np.ndarray:
    """Starts of L-runs that survive so many levels."""
    starts = np.flatnonzero(w.left() >= window)
    for level, length in enumerate(levels(window)[:upto]):
        reps, run = _representatives(w, starts, length, window)
        hi, _, _, place = X.distinct(reps)
        starts = starts[X.read_answer(answers, level, hi, None, n)[place][run]] if len(starts) else starts
    return starts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word covered by a run of `window` words that starts anywhere else too.

    Returns a row per input row: id, n_words, n_removed, kept_text (kept words
    joined by one space), spans (array of removed [from, to) word ranges).
    Null or empty text: no words, kept_text ''.  Rows that repeat, ids
    included, are documents of their own (and so copies of each other).  Null
    ids stay null.  Other columns are not read.  window must be at least 2.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    rows, n = X.bucketed(docs, id_col, text_col)
    n = X.owners(n)
    id_type = rows.schema["id"].dataType

    lengths = levels(window)
    last = len(lengths) - 1

    def level_kernel(level: int):
        def send(key, table, answers=None):
            w = C.words(table.column("text"))
            starts = _candidates(w, answers, window, n, level)
            if level == last:
                hi, lo, multi, _ = X.distinct(*_wide(w, starts, window))
            else:
                hi, lo, multi, _ = X.distinct(_representatives(w, starts, lengths[level], window)[0])
            return X.messages(key[0].as_py(), hi, lo, multi, n)

        # the number of parameters tells whether answers come along
        return send if level else lambda key, table: send(key, table)

    def remove(table, answers):
        w = C.words(table.column("text"))
        starts = _candidates(w, answers, window, n, last)
        hi, lo, _, place = X.distinct(*_wide(w, starts, window))
        starts = starts[X.read_answer(answers, last, hi, lo, n)[place]]
        edge = np.zeros(len(w.start) + 1, np.int64)
        edge[starts] += 1
        edge[starts + window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        # bounds of removed ranges, cut at document bounds
        cut = np.append(gone, False) != np.append(False, gone)
        inner = w.off[1:-1][(w.off[1:-1] > 0) & (w.off[1:-1] < len(gone))]
        inner = np.unique(inner[gone[inner] & gone[inner - 1]])
        lo_at = np.sort(np.concatenate([np.flatnonzero(cut[:-1] & gone), inner]))
        hi_at = np.sort(np.concatenate([np.flatnonzero(cut[1:] & gone) + 1, inner]))
        d = np.searchsorted(w.off, lo_at, "right") - 1
        pair = pa.StructArray.from_arrays([pa.array(lo_at - w.off[d], pa.int64()), pa.array(hi_at - w.off[d], pa.int64())], ["start", "end"])
        per_doc = np.searchsorted(d, np.arange(len(w.off)))
        total = np.concatenate([[0], np.cumsum(gone)])
        return pa.table({
            "id": table.column("id"), "n_words": pa.array(w.lens, pa.int64()), "n_removed": pa.array(np.diff(total[w.off]), pa.int64()),
            "kept_text": pa.array(C.joined(w, ~gone), pa.binary()).cast(pa.string()), "spans": pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), pair),
        })

    answers = None
    for level in range(last + 1):
        by = rows.groupBy("b")
        sent = (by.cogroup(answers.groupBy("b")) if level else by).applyInArrow(level_kernel(level), X.MESSAGE)
        got = X.answered(sent, level == last, n, level)
        answers = answers.unionByName(got) if level else got
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(span))])
    return rows.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(remove, schema).withColumnRenamed("id", id_col)
