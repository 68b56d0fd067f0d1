"""Best-fit packing by exact-complement hashing.

Lengths are at most the sequence size, so a histogram of them is small however
many documents there are.  The driver plans on the histogram alone: for every
length, longest first, it looks up lengths, pairs and triples of lengths whose
sum fills the gap exactly and consumes them as often as counts allow; what is
left goes best-fit by decreasing length.  A plan is a short list of (length,
range of ranks) -> (sequence numbers, offset), every step of which uses up a
length or a group of gaps.  Pieces are ranked within their length by a local
count plus a prefix sum over input partitions, so that no task ever sees all
pieces of one length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .tokens import encoder, vocabulary

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 0


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, how many, first sequence, offset), and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] += n
    rank: dict[int, int] = defaultdict(int)
    slots, sequences = [], 0

    def take(lengths: list[int], times: int, first: int, at: int = 0) -> None:
        for x in lengths:
            slots.append((x, rank[x], times, first, at))
            rank[x] += times
            left[x] -= times
            at += x

    def fill(lengths: list[int]) -> None:
        """Consume a combination that fills a sequence as often as its lengths allow."""
        nonlocal sequences
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = int(min(left[x] // k for x, k in need.items()))
        if times:
            take(lengths, times, sequences)
            sequences += times

    def pairs(total: int, longest: int) -> np.ndarray:
        """First parts a >= b of available pairs a + b = total with a <= longest."""
        a = np.arange((total + 1) // 2, min(total - 1, longest) + 1)
        return a[(left[a] > 0) & (left[total - a] > 0)][::-1]

    for x in range(capacity, 0, -1):
        if not left[x]:
            continue
        gap = capacity - x
        if not gap:
            fill([x])
            continue
        if gap <= x:
            fill([x, gap])
        if left[x]:
            for a in pairs(gap, x):
                if not left[x]:
                    break
                fill([x, int(a), gap - int(a)])
        if left[x]:
            for a in range(min(gap - 2, x), (gap + 2) // 3 - 1, -1):
                if not left[x]:
                    break
                if left[a]:
                    for b in pairs(gap - a, a):
                        fill([x, a, int(b), gap - a - int(b)])
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    for x in range(capacity, 0, -1):
        while left[x]:
            room = min((g for g in gaps if g >= x), default=None)
            if room is None:
                per = min(capacity // x, int(left[x]))
                times = int(left[x]) // per
                take([x] * per, times, sequences)
                gaps[capacity - per * x].append((sequences, times))
                sequences += times
                continue
            first, n = gaps[room].pop()
            times = min(n, int(left[x]))
            if times < n:
                gaps[room].append((first + times, n - times))
            if not gaps[room]:
                del gaps[room]
            take([x], times, first, capacity - room)
            gaps[room - x].append((first, times))
    return slots, sequences


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Pieces of every document with their place within the input partition's pieces of that length."""
    content = vocabulary(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def pieces(batches):
        encode, part, seen = encoder(content), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                out = [[] for _ in range(7)]
                got = encode([t or "" for t in texts.slice(lo, 512).to_pylist()])
                for row, tokens in enumerate(got):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    count = -(-len(tokens) // capacity)
                    z = len(tokens) - capacity * (count - 1)
                    for k, (a, z) in enumerate(zip([0, *range(z, len(tokens), capacity)], [*range(z, len(tokens) + 1, capacity)], strict=True)):
                        body = tokens[a:z].tobytes()
                        for column, x in zip(out, (row, k, a, z - a, zlib.crc32(body), int(seen[z - a]), body if keep_ids else None), strict=True):
                            column.append(x)
                        seen[z - a] += 1
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, 512).take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5]),
                    pa.array(np.full(len(out[0]), part), pa.int32()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.binary()),
                ], ["id", "piece", "start", "length", "ids_crc32", "part", "local_rank", "ids"])

    fields = [("id", rows.schema["id"].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("local_rank", T.LongType()), ("ids", T.BinaryType())]
    return rows.mapInArrow(pieces, T.StructType([T.StructField(*f) for f in fields]))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the method finds.

    Returns a row per piece: id, piece, start, length, ids_crc32, sequence_id,
    offset, and ids (little-endian uint32; null unless keep_ids).  A document
    longer than capacity is cut into pieces of capacity tokens, the first one
    shorter if need be; null or empty text is one piece holding the end id.
    Rows with equal or null ids are packed as separate documents.  An empty
    table gives no rows.  Other columns are not read.  Equal lengths are
    interchangeable: which of them goes where follows the input's partitions.
    """
    pieces = shared.cut(cut_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    slots, _ = plan(histogram, capacity)
    table = np.array(sorted(slots) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    wide = np.int64(1) << 42  # ranks are below this: (length, rank) in one number, ordered
    keys = table[:, 0] * wide + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            into = rank - table[at, 1]
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 3] + into), pa.array(table[at, 4]), batch.column("ids")], [*("id", "piece", "start", "length", "ids_crc32"), "sequence_id", "offset", "ids"])

    ranked = pieces.join(bases, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"), "ids")
    schema = T.StructType([ranked.schema[c] for c in ("id", "piece", "start", "length", "ids_crc32")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
