"""Exact dedup by a Golomb-coded fingerprint exchange.

Texts are equal if their bytes are after lower-casing A-Z only.  A first scan
takes fingerprints where the texts lie: a partition writes the digests of its
rows, a list for some ten thousand rows, and sends owners the sorted distinct
64-bit fingerprints of each list as Golomb codes.  Owners answer with bitmaps
of what occurs twice.  Rows with a clear bit are unique at once.  A second scan
moves the texts of suspects only, picked by a bit table of their fingerprints
and compared byte by byte where Spark groups them; equal texts are combined
within a batch and within a task first, so a group of copies leaves a row per
task however large it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import shared
from . import textcore as C

#: Rows in a list of digests; fingerprints that an owner gets on average.
LIST_ROWS, OWNER_HASHES = 1 << 16, 1 << 21
#: Bits of the table of suspects for each of them, and in all at least and at most (64 MB).  A fuller table lets more texts through to the comparison, never fewer.
BITS_EACH, BITS_LEAST, BITS_MOST = 16, 1 << 20, 1 << 29
#: Bits of the table that one task sets.
BIT_BLOCK = 1 << 20


def _normalised(texts) -> list[bytes]:
    data, off = C.raw(texts, lower=True)
    whole, off = memoryview(data), off.tolist()
    return [bytes(whole[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def _digests(texts: list[bytes]) -> np.ndarray:
    """SHA-256 of each text, a row of four numbers; the first is its fingerprint."""
    return np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in texts), np.uint64).reshape(-1, 4)


def _slices(batches, rows: int = 500):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept, text_sha256.

    keep_id is the largest id among rows of equal text; null text counts as
    empty, and all empty texts are equal.  Of rows that also share that id, one
    is kept.  Null ids sort below all others; a group of null ids only has
    keep_id null and keeps one row.  Other columns are not read.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    count = rows.count()  # of footers, where docs is a table
    owners = max(1, -(-count // OWNER_HASHES), min(count // 1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def send(batches):
        """A list's digests and ids in a row with owner -1, and its messages."""
        ids, held = [], []

        def rows_of():
            digests = np.concatenate(held)
            at = int.from_bytes(np.random.default_rng().bytes(7), "little")  # names the list; the rows are written before they are used
            hi, _, multi, _ = X.distinct(digests[:, 0])
            cuts = X.owner_cuts(hi, owners)
            found = np.flatnonzero(np.diff(cuts)).tolist()
            body = [X.golomb(hi[cuts[o] : cuts[o + 1]]) + np.packbits(multi[cuts[o] : cuts[o + 1]]).tobytes() for o in found]
            all_ids = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(all_ids)] + [len(all_ids)] * len(found), pa.int32()), all_ids)
            columns = [pa.array([at] * (len(found) + 1), pa.int64()), pa.array([-1, *found], pa.int32()), pa.array([digests.tobytes(), *body], pa.binary()), lists]
            return pa.RecordBatch.from_arrays(columns, ["list", "owner", "payload", "ids"])

        n = 0
        for part in _slices(batches):
            ids.append(part.column(0))
            held.append(_digests(_normalised(part.column(1))))
            n += part.num_rows
            if n >= LIST_ROWS:
                yield rows_of()
                ids, held, n = [], [], 0
        if n:
            yield rows_of()

    sent = shared.table(rows.mapInArrow(send, T.StructType([T.StructField("list", T.LongType()), T.StructField("owner", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])))

    def answer(table):
        codes = [X.ungolomb(p) for p in table.column("payload").to_pylist()]
        multi = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, -1, used), count=len(h)) for p, (h, used) in zip(table.column("payload").to_pylist(), codes, strict=True)])
        _, _, twice, place = X.distinct(np.concatenate([h for h, _ in codes]))
        bits = (np.bincount(place, multi + 1.0, len(twice)) > 1)[place]
        return pa.table({"list": table.column("list"), "owner": table.column("owner"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(bits, np.cumsum([len(h) for h, _ in codes])[:-1])], pa.binary())})

    answers = sent.filter("owner >= 0").select("list", "owner", "payload").groupBy("owner").applyInArrow(answer, "list long, owner int, bits binary")

    def sort_out(table, right):
        out = []
        for at, payload, ids in zip(table.column("list").to_pylist(), table.column("payload").to_pylist(), table.column("ids").combine_chunks(), strict=True):
            digests = np.frombuffer(payload, np.uint64).reshape(-1, 4)
            hi, _, _, place = X.distinct(digests[:, 0])
            cuts, twice = X.owner_cuts(hi, owners), np.zeros(len(hi), bool)
            for o, bits in zip(right.column("owner").to_pylist(), right.column("bits").to_pylist(), strict=True):
                twice[cuts[o] : cuts[o + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[o + 1] - cuts[o])
            n = len(digests)
            sha = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(payload)]).cast(pa.binary())
            out.append(pa.table({"id": ids.values, "list": pa.array(np.full(n, at)), "nth": pa.array(np.arange(n, dtype=np.int32)), "sha": sha, "suspect": pa.array(twice[place])}))
        return pa.concat_tables(out)

    listed = sent.schema["ids"].dataType.elementType  # nested fields of what a file holds may all be null
    schema = T.StructType([T.StructField("id", listed), T.StructField("list", T.LongType()), T.StructField("nth", T.IntegerType()), T.StructField("sha", T.BinaryType()), T.StructField("suspect", T.BooleanType())])
    lists = sent.filter("owner = -1").groupBy("list").cogroup(answers.groupBy("list"))
    sorted_out = shared.table(lists.applyInArrow(sort_out, schema))

    table = _bit_table(sorted_out)
    held = shared.broadcast(spark, table)  # BITS_MOST / 8 bytes at most
    bits = 8 * len(table)

    def move(batches):
        """(sha, body, n) of texts whose bit is set, equal ones of a slice combined."""
        for part in _slices(batches):
            texts = _normalised(part.column(0))
            prints = _digests(texts)
            at = prints[:, 0] % np.uint64(bits)
            on = held.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            met: dict[bytes, int] = {}
            for i in np.flatnonzero(on).tolist():
                met[texts[i]] = met.get(texts[i], 0) + 1
            sha = [hashlib.sha256(t).digest() for t in met]
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(list(met), pa.binary()), pa.array(list(met.values()), pa.int64())], ["sha", "body", "n"])

    moved = rows.select("text").mapInArrow(move, "sha binary, body binary, n long")
    # one text for each digest: the bytes are compared in grouping
    bodies = moved.groupBy("sha", "body").agg(F.sum("n").alias("n")).groupBy("sha").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    groups = sorted_out.filter("suspect").groupBy("sha").agg(F.max(F.struct("id", "list", "nth")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    sound = (F.col("texts") == 1) & (F.col("n") == F.col("group_size"))
    groups = groups.join(bodies, "sha").select("sha", "keep", F.when(sound, F.col("group_size")).otherwise(F.raise_error(F.lit("texts with one SHA-256 differ")).cast("long")).alias("group_size"))
    copies = sorted_out.filter("suspect").join(groups, "sha")
    own = F.struct("id", "list", "nth")
    copies = copies.select("id", F.col("keep.id").alias("keep_id"), "group_size", own.eqNullSafe(F.col("keep")).alias("kept"), "sha")
    alone = sorted_out.filter("NOT suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return copies.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _bit_table(sorted_out: DataFrame) -> np.ndarray:
    """A bit for the fingerprint (modulo the table's size) of every suspect; its blocks are made on executors."""
    n = sorted_out.filter("suspect").agg(F.approx_count_distinct("sha")).first()[0]
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_EACH * n).bit_length()))

    def places(batches):
        for batch in batches:
            at = np.unique(np.frombuffer(b"".join(x[:8] for x in batch.column(0).to_pylist()), np.uint64) % np.uint64(bits))
            yield pa.RecordBatch.from_arrays([pa.array((at // BIT_BLOCK).astype(np.int32)), pa.array((at % BIT_BLOCK).astype(np.int32))], ["block", "bit"])

    def block(key, table):
        on = np.zeros(BIT_BLOCK, bool)
        on[table.column("bit").to_numpy()] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "body": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    marked = sorted_out.filter("suspect").select("sha").mapInArrow(places, "block int, bit int").distinct()
    for r in marked.groupBy("block").applyInArrow(block, "block int, body binary").toLocalIterator():  # bits / BIT_BLOCK rows
        out[r["block"] * (BIT_BLOCK // 8) : (r["block"] + 1) * (BIT_BLOCK // 8)] = np.frombuffer(r["body"], np.uint8)
    return out
