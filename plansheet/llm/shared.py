"""The folder that driver and executors share, lineage cuts in it, and broadcasts that go when later ones come."""

from __future__ import annotations

import atexit
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Least number of partitions of a scan; unset, it follows the cores there are, which change when executors are lost.
_SPLITS = "spark.sql.files.minPartitionNum"
#: Broadcasts whose copies executors keep; older ones are sent again if they are still wanted.
_KEPT = 3

_sent: deque[Broadcast] = deque()
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder in the warehouse of a local session, and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def pin_splits(spark: SparkSession) -> None:
    """From here on, files are split alike in every scan of the session, however many executors are left: a row keeps its partition and its place there."""
    if spark.conf.get(_SPLITS, None) is None:
        # executors may still be on their way: no fewer than a shuffle has
        spark.conf.set(_SPLITS, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared folder: lost executors cost no recomputation beyond it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    for below in [x for x in _written if x == path or x.startswith(path + "/")]:
        _written.pop(below)


@atexit.register
def _remove_all() -> None:
    """Tables that results were read from go when the driver ends."""
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing to do it with
            return


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast; executors' copies of all but the latest ones are dropped (Spark sends one again to whoever still asks for it)."""
    while len(_sent) >= _KEPT:
        old = _sent.popleft()
        if old._jbroadcast is not None and old._sc is spark.sparkContext:
            old.unpersist()
    _sent.append(spark.sparkContext.broadcast(value))
    return _sent[-1]


def write(df: DataFrame, path: str) -> None:
    """Writes Parquet; the shuffle files go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def table(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows read from a Parquet table in the shared folder: a lineage cut that is compressed and read by column."""
    spark, schema = df.sparkSession, df.schema
    path = path or new_path(spark, "table")
    _written[path] = spark
    write(df, path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A table() whose tables go when the block ends; what outlives it must be written by table() within."""
    folder = new_path(spark, "scratch")
    try:
        yield lambda df: table(df, f"{folder}/{uuid.uuid4().hex[:12]}")
    finally:
        remove(spark, folder)
