"""Indexing of commits as they arrive: a file stream of state lines, one micro-batch after the other against the last snapshot.

A micro-batch must hold whole commits: they are dropped as one file each, and
one file a trigger is read.  The index is a folder of Parquet partitioned by
commit, so a batch that is run again replaces its own commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import KEYS, with_status


def state_stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """State rows (drawing, element_id, commit_seq, ...) from Parquet files dropped below path, a commit a file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def index_stream(states: DataFrame, index: str, checkpoint: str, status: Callable[[Column, Column], Column], available_now: bool = True) -> StreamingQuery:
    """Writes states with their status (against the commit before) and rows of what each commit deleted to the index folder."""
    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        seqs = [r[0] for r in df.select("commit_seq").distinct().orderBy("commit_seq").collect()]  # one commit a file
        if not seqs:
            return
        before = spark.createDataFrame([], df.schema)
        try:
            known = spark.read.parquet(index).withColumn("commit_seq", F.col("commit_seq").cast(df.schema["commit_seq"].dataType))
            before = known.filter((F.col("commit_seq") == seqs[0] - 1) & (F.col("status") != "deleted")).select(df.columns)
        except Exception as e:  # noqa: BLE001  the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        found = with_status(before.unionByName(df), status=status).filter(F.col("commit_seq").between(seqs[0], seqs[-1]))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit_seq").parquet(index)
        df.unpersist()

    writer = states.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_per_element(states: DataFrame) -> DataFrame:
    """Streaming: each element's newest row so far, in update mode."""
    rest = [c for c in states.columns if c not in KEYS]
    return states.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "commit_seq").alias("r")).select(*KEYS, "r.*")
