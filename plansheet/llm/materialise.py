"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents' ids, each followed by an end id, are concatenated within an input
partition and cut into sequences of `seq_len`; only a partition's last sequence
is padded.  Sequences are written once to the shared folder, numbered by a
prefix sum over partitions, and sent to slots by a keyed Feistel permutation
of [0, N) (values beyond N walk on along their cycle).  A shard holds a range
of slots; slot s lies at byte (s mod per_shard) * stride of its shard, so that
a reader starts anywhere without an index, and a writer that is run again
replaces a shard by the same bytes.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textcore import mix
from .tokens import encoder, vocabulary

#: Tokens in a sequence, bytes in a shard, rounds of the permutation.
SEQ_LEN, SHARD_BYTES, ROUNDS = 2048, 32 << 20, 6
#: Input partitions whose first sequence numbers are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_PARTS = 1 << 18


def _round_keys(key: int) -> np.ndarray:
    return mix(np.uint64(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _feistel(x: np.ndarray, half: int, keys) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for k in keys:
        left, right = right, left ^ (mix(right + k) & low)
    return (left << np.uint64(half)) | right


def _walk(index, n: int, step) -> np.ndarray:
    x = step(np.asarray(index, np.uint64))
    while (far := x >= np.uint64(n)).any():
        x[far] = step(x[far])
    return x.astype(np.int64)


def _half(n: int) -> int:
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of every sequence number below n: a permutation of [0, n) set by key."""
    return _walk(index, n, lambda x: _feistel(x, _half(n), _round_keys(key)))


def sequence_at(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """Inverse of slots()."""
    half = _half(n)
    low = np.uint64((1 << half) - 1)

    def back(x):
        left, right = x >> np.uint64(half), x & low
        for k in _round_keys(key)[::-1]:
            left, right = right ^ (mix(left + k) & low), left
        return (left << np.uint64(half)) | right

    return _walk(slot, n, back)


def _sequences(docs: DataFrame, content: bytes, id_col: str, text_col: str, seq_len: int, end_id: int, dtype: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType

    def cut(batches):
        encode, part, nth = encoder(content), TaskContext.get().partitionId(), 0
        held, room, owners, starts = [], seq_len, [], []

        def row():
            nonlocal held, room, owners, starts, nth
            body = np.concatenate(held).astype(dtype)
            out = (part, nth, len(body), zlib.crc32(body.tobytes()), body.tobytes(), owners, starts)
            held, room, owners, starts, nth = [], seq_len, [], [], nth + 1
            return out

        def batch_of(found):
            c = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(c[i], pa.int64()) for i in (1, 2, 3)), pa.array(c[4], pa.binary()), pa.array(c[5], pa.list_(id_arrow)), pa.array(c[6], pa.list_(pa.int32()))], names)

        names = ["part", "nth", "n_tokens", "crc32", "ids", "doc_ids", "doc_starts"]
        id_arrow = pa.int64()
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 512):
                done = []
                for i, tokens in zip(batch.column(0).slice(lo, 512).to_pylist(), encode([t or "" for t in batch.column(1).slice(lo, 512).to_pylist()]), strict=True):
                    tokens, a = np.append(tokens, np.uint32(end_id)), 0
                    while a < len(tokens):
                        owners.append(i)
                        starts.append(seq_len - room)
                        held.append(tokens[a : a + room])
                        a, room = a + len(held[-1]), room - len(held[-1])
                        if not room:
                            done.append(row())
                if done:
                    yield batch_of(done)
        if held:
            yield batch_of([row()])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("crc32", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_starts", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(cut, schema)


def _put(uri: str, body: bytes) -> None:
    """Write under a name of this attempt's own, then move: readers see whole files only."""
    store, path = pafs.FileSystem.from_uri(uri)
    task = TaskContext.get()
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part := f"{path}.{task.taskAttemptId() if task else 0}.part") as out:
        out.write(body)
    store.move(part, path)


def _uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{path}"


def materialise(docs: DataFrame, tokenizer: str, out_dir: str, key: int = 0, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = 0, pad_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shards and index.json to out_dir (a URI all executors reach); a row per sequence.

    Columns: slot, shard, byte_offset, n_tokens (the rest is padding), crc32 (of
    the unpadded little-endian ids), doc_ids and doc_starts (where each
    document's part begins), shard_path.  Ids are uint16 if the vocabulary
    allows it, else uint32.  Null or empty text contributes its end id.  Rows
    with equal or null ids are documents of their own.  An empty table writes
    an index.json with no shards.  Other columns are not read.
    """
    spark, content = docs.sparkSession, vocabulary(tokenizer)
    spec = json.loads(content)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), end_id, pad_id])
    dtype = "<u2" if top < 1 << 16 else "<u4"
    stride, base = seq_len * int(dtype[-1]), _uri(out_dir.rstrip("/"))
    per_shard = max(1, shard_bytes // stride)

    held = shared.new_path(spark, "sequences")
    _sequences(docs, content, id_col, text_col, seq_len, end_id, dtype).write.option("compression", "zstd").parquet(held)
    rows = spark.read.parquet(held)
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per input partition
    n, n_parts = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = rows.join(F.broadcast(firsts) if n_parts <= BROADCAST_PARTS else firsts, "part")
    columns = [*(c for c in rows.columns if c not in ("part", "nth")), "slot"]

    def to_slots(batches):
        zstd = pa.Codec("zstd", 1)
        for batch in batches:
            at = slots(batch.column("first").to_numpy() + batch.column("nth").to_numpy(), n, key) if batch.num_rows else np.zeros(0, np.int64)
            packed = [zstd.compress(x.as_buffer(), asbytes=True) for x in batch.column("ids")]  # shuffled so
            yield pa.RecordBatch.from_arrays([*(batch.column(c) if c != "ids" else pa.array(packed, pa.binary()) for c in columns[:-1]), pa.array(at)], columns)

    dealt = numbered.mapInArrow(to_slots, T.StructType([rows.schema[c] for c in columns[:-1]] + [T.StructField("slot", T.LongType())]))
    dealt = dealt.withColumn("shard", F.floor(F.col("slot") / F.lit(per_shard)).cast("int"))

    def write(shard, table):
        shard = shard[0].as_py()
        size = min(per_shard, n - shard * per_shard)
        block, at = np.full((size, seq_len), pad_id, dtype), table.column("slot").to_numpy() - shard * per_shard
        zstd = pa.Codec("zstd")
        for i, k, body in zip(at.tolist(), table.column("n_tokens").to_pylist(), table.column("ids"), strict=True):
            block[i, :k] = np.frombuffer(zstd.decompress(body.as_buffer(), k * block.itemsize), dtype)
        path = f"{base}/shard-{shard:08d}.bin"
        _put(path, block.tobytes())
        k = table.num_rows
        return pa.table({"slot": table.column("slot"), "shard": pa.array(np.full(k, shard), pa.int32()), "byte_offset": pa.array(at * stride), **{c: table.column(c) for c in ("n_tokens", "crc32", "doc_ids", "doc_starts")}, "shard_path": pa.array([path] * k, pa.string())})

    schema = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("byte_offset", T.LongType()), *(rows.schema[c] for c in ("n_tokens", "crc32", "doc_ids", "doc_starts")), T.StructField("shard_path", T.StringType())])
    found = shared.cut(dealt.groupBy("shard").applyInArrow(write, schema))
    _put(f"{base}/index.json", json.dumps({"sequences": n, "seq_len": seq_len, "dtype": dtype, "stride": stride, "per_shard": per_shard, "shards": math.ceil(n / per_shard), "key": key, "pad_id": pad_id, "end_id": end_id}).encode())
    shared.remove(spark, held)
    return found


def read_from(out_dir: str, slot: int = 0):
    """Sequences of the shards in training order from a slot on, read in sequence."""
    base = _uri(out_dir.rstrip("/"))
    store, path = pafs.FileSystem.from_uri(base)
    with store.open_input_stream(f"{path}/index.json") as f:
        x = json.loads(f.read())
    while slot < x["sequences"]:
        shard, at = divmod(slot, x["per_shard"])
        with store.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(at * x["stride"])
            while body := f.read(x["stride"]):
                yield np.frombuffer(body, x["dtype"])
                slot += 1
