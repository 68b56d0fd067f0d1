"""Bucketed rows, and an exchange of hashes between buckets and hash owners.

Rows are dealt over buckets by a hash of their content and their input
partition, so no key and no repeated row is hot.  A bucket sends every owner
one message: its distinct hashes in the owner's range, sorted, with a bit for
those it holds more than once.  The owner answers each message with a bitmap of
the hashes that occur at least twice overall.  A hash reaches its owner once
per bucket at most, however often it occurs, and answers are a bit per hash.

There are as many owners as buckets but OWNERS at most, so messages grow in
proportion to the input.
Beyond PACKED buckets (some 64 GB of text) an owner would have to hold too many
hashes at once; there, hashes travel as plain rows that Spark groups and joins,
which spills, and a bucket is answered with the list of its repeated hashes.
Results are the same.  The plan is plain DataFrames: a lost executor's part is
computed again from the shuffle or the scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Text bytes per bucket; a bucket is handled in one Python call.
BUCKET_BYTES = 8 << 20
#: Owners at most, buckets of packed messages at most, shuffle partitions at most (several buckets share one).
OWNERS, PACKED, PARTITIONS = 512, 8192, 1 << 16

MESSAGE = "owner int, b int, payload binary"
ANSWER = "b int, owner int, level int, bits binary"


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def dealt(rows: DataFrame, size: int, *content: str, bucket_bytes: int | None = None) -> tuple[DataFrame, int]:
    """rows with a bucket b, hash-partitioned on it, and the number of buckets for so many bytes.

    rows must give the same rows in the same partitions whenever they are read,
    as a table does (its splits are pinned here).
    """
    shared.pin_splits(rows.sparkSession)
    n = max(1, math.ceil(size / (bucket_bytes or BUCKET_BYTES)))
    salted: Column = F.xxhash64(*content, F.spark_partition_id())
    rows = rows.withColumn("b", F.pmod(salted, F.lit(n)).cast("int"))
    wanted = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > 1 else 1
    return rows.repartition(min(wanted, PARTITIONS), "b"), n


def bucketed(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(id, text, b) in buckets, and the number of buckets."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return dealt(rows, text_bytes(docs, text_col), "id", "text", bucket_bytes=bucket_bytes)


def owners(n: int) -> int:
    """Owners for n buckets; 0: hashes travel as rows."""
    return min(OWNERS, n) if n <= PACKED else 0


def owner_cuts(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n owners' ranges in sorted 64-bit hashes: owner = top 32 bits * n >> 32."""
    first = ((np.arange(n, dtype=np.uint64) << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n) << np.uint64(32)
    return np.append(np.searchsorted(hashes, first), len(hashes))


def distinct(hi: np.ndarray, lo: np.ndarray | None = None):
    """Sorted distinct hashes (64 or 128 bits), which of them occur twice, and each input's place."""
    if lo is None:
        order = np.argsort(hi, kind="stable")
        s = hi[order]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
        t = None
    else:
        order = np.lexsort((lo, hi))
        s, t = hi[order], lo[order]
        new = np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[at], None if t is None else t[at], np.diff(np.append(at, len(s))) > 1, place


def golomb(values: np.ndarray) -> bytes:
    """Golomb code of sorted distinct 64-bit values: gaps' quotients in unary, remainders in binary.

    Header: count (4 bytes), divisor (8), first value (8).  Quotients and
    remainders lie in two streams, which numpy reads without a loop.
    """
    gaps = np.diff(values)
    m = max(1, round(0.69 * (int(values[-1]) - int(values[0])) / max(1, len(gaps)))) if len(gaps) else 1
    width = (m - 1).bit_length()
    q = (gaps // np.uint64(m)).astype(np.int64)
    r = gaps - q.astype(np.uint64) * np.uint64(m)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = np.unpackbits(r.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :] if len(r) else np.zeros(0, np.uint8)
    head = len(values).to_bytes(4, "little") + m.to_bytes(8, "little") + values[:1].tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def ungolomb(code: bytes) -> tuple[np.ndarray, int]:
    """The values, and the bytes used.  Inverse of golomb()."""
    n, m = int.from_bytes(code[:4], "little"), int.from_bytes(code[4:12], "little")
    first, width = np.frombuffer(code, np.uint64, 1, 12), (m - 1).bit_length()
    if n == 1:
        return first.copy(), 20
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, -1, 20)))[: n - 1]
    q, used = np.diff(np.append(-1, ones)) - 1, 20 + -(-(int(ones[-1]) + 1) // 8)
    size = -(-(n - 1) * width // 8)
    bits = np.zeros((n - 1, 64), np.uint8)
    if width:
        bits[:, 64 - width :] = np.unpackbits(np.frombuffer(code, np.uint8, size, used), count=(n - 1) * width).reshape(n - 1, width)
    r = np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return np.append(first, first + np.cumsum(q.astype(np.uint64) * np.uint64(m) + r)), used + size


def messages(b: int, hi: np.ndarray, lo: np.ndarray | None, multi: np.ndarray, n: int, coded: bool = False) -> pa.Table:
    """One row for each of n owners that gets anything from this bucket; coded: 64-bit hashes, Golomb-coded.  No owners: a row for each hash."""
    if not n:
        width = 8 if lo is None else 16
        body = np.zeros((len(hi), width + 1), np.uint8)
        body[:, :8] = hi.view(np.uint8).reshape(-1, 8)
        if lo is not None:
            body[:, 8:16] = lo.view(np.uint8).reshape(-1, 8)
        body[:, width] = multi
        payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width + 1), len(hi), [None, pa.py_buffer(body)]).cast(pa.binary())
        return pa.table({"owner": pa.array(np.full(len(hi), -1), pa.int32()), "b": pa.array(np.full(len(hi), b), pa.int32()), "payload": payload})
    cuts = owner_cuts(hi, n)
    found = np.flatnonzero(np.diff(cuts))
    body = []
    for o in found:
        a, z = cuts[o], cuts[o + 1]
        if coded:
            body.append(golomb(hi[a:z]) + np.packbits(multi[a:z]).tobytes())
            continue
        body.append(hi[a:z].tobytes() + (b"" if lo is None else lo[a:z].tobytes()) + np.packbits(multi[a:z]).tobytes())
    return pa.table({"owner": pa.array(found, pa.int32()), "b": pa.array(np.full(len(found), b), pa.int32()), "payload": pa.array(body, pa.binary())})


def _answered_rows(sent: DataFrame, wide: bool, level: int) -> DataFrame:
    """Answers to messages of one hash each: a row for each bucket that holds repeated hashes, with those hashes and their counts."""
    width = 16 if wide else 8
    rows = sent.select("b", F.substring("payload", 1, width).alias("h"), (F.hex(F.substring("payload", width + 1, 1)) == "01").alias("multi"))
    many = rows.groupBy("h").agg(F.sum(F.when(F.col("multi"), 2).otherwise(1)).alias("n")).filter("n > 1")

    def pack(key, table):
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64).reshape(-1, width // 8)
        order = np.lexsort(h.T[::-1])
        body = h[order].tobytes() + table.column("n").to_numpy()[order].astype("<u4").tobytes()
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "owner": pa.array([-1 - (width == 16)], pa.int32()), "level": pa.array([level], pa.int32()), "bits": pa.array([body], pa.binary())})

    return rows.join(many, "h").select("b", "h", "n").groupBy("b").applyInArrow(pack, ANSWER)


def answered(sent: DataFrame, wide: bool, n: int, level: int = 0, coded: bool = False, counts_back: bool = False) -> DataFrame:
    """The n owners' bitmaps, one for each message; wide: hashes have 128 bits; coded: as in messages().

    counts_back: instead of a bit, the number of buckets' entries of each hash
    (32 bits, an entry held more than once counting twice).
    """
    if not n:
        return _answered_rows(sent, wide, level)
    width = 16 if wide else 8

    def owner(table):
        his, los, multis, counts = [], [], [], []
        for p in table.column("payload").to_pylist():
            if coded:
                h, used = ungolomb(p)
                his.append(h)
                counts.append(len(h))
                multis.append(np.unpackbits(np.frombuffer(p, np.uint8, -1, used), count=len(h)))
                continue
            k = len(p) * 8 // (8 * width + 1)
            his.append(np.frombuffer(p, np.uint64, k))
            if wide:
                los.append(np.frombuffer(p, np.uint64, k, 8 * k))
            multis.append(np.unpackbits(np.frombuffer(p, np.uint8, -1, width * k), count=k))
            counts.append(k)
        hi, lo, multi = np.concatenate(his), np.concatenate(los) if wide else None, np.concatenate(multis)
        _, _, twice, place = distinct(hi, lo)
        entries = np.bincount(place, multi + 1.0, len(twice))
        bits = np.split((entries if counts_back else entries > 1)[place], np.cumsum(counts)[:-1])
        return pa.table({
            "b": table.column("b"), "owner": table.column("owner"),
            "level": pa.array(np.full(len(counts), level), pa.int32()),
            "bits": pa.array([x.astype("<u4").tobytes() if counts_back else np.packbits(x).tobytes() for x in bits], pa.binary()),
        })

    return sent.groupBy("owner").applyInArrow(owner, ANSWER)


def read_answer(answers: pa.Table, level: int, hi: np.ndarray, lo: np.ndarray | None, n: int, counts: bool = False) -> np.ndarray:
    """For each of a bucket's sorted distinct hashes: does it occur at least twice overall? (counts: how often; 0 or 1 if once)"""
    cuts, out = owner_cuts(hi, n) if n else None, np.zeros(len(hi), np.int64 if counts else bool)
    for o, lv, bits in zip(*(answers.column(c).to_pylist() for c in ("owner", "level", "bits")), strict=True):
        if lv != level:
            continue
        if o >= 0:
            a, z = cuts[o], cuts[o + 1]
            out[a:z] = np.frombuffer(bits, "<u4") if counts else np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a)
            continue
        k = len(bits) // (20 if o == -2 else 12)
        h = np.frombuffer(bits, np.uint64, k * (2 if o == -2 else 1))
        times = np.frombuffer(bits, "<u4", k, h.nbytes)
        mine = hi if lo is None else np.stack([hi, lo], 1)
        whole = np.dtype((np.void, 16)) if lo is not None else np.uint64
        at = {x: i for i, x in enumerate((mine.view(whole) if lo is not None else mine).reshape(-1).tolist())}
        place = [at[x] for x in (np.ascontiguousarray(h).view(whole)).reshape(-1).tolist()]
        out[place] = times if counts else True
    return out
