"""A training-data pipeline over the documents table: five stages, each of which keeps rows of documents but the last, which packs them.

Every stage works on all rows that the one before kept, and is written to
Parquet and read again.  Rows of equal text or in one near-duplicate group
leave one document: the largest id in exact dedup, the smallest in the
near-duplicate stage.  Ids needn't be unique or present: a row is known by its
place in the table, a null id counts as smaller than all others in exact dedup
and as larger in the near-duplicate stage (so it stays only where no row of its
group has an id), and of rows with one id the later or the earlier one stays.
Null and empty texts are clean, equal to each other, near copies of nothing,
and packed as an end alone.  An empty table leaves none; other columns, whatever
their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm import decontamination, exact_dedup, ngram_join, packing, shared, toxicity
from plansheet.llm.queries import tokenizer_path


_ROW = "_row_of_stage"


def _keyed(docs: DataFrame, null_first: bool) -> DataFrame:
    """(key, text): a key for every row, ordered by id; the same at every reading of a table, as its splits are pinned."""
    shared.pin_splits(docs.sparkSession)
    absent = F.col("doc_id").isNull() if not null_first else F.col("doc_id").isNotNull()
    return docs.select(F.struct(absent.alias("absent"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"), "text")


def _kept(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose key is among the keys (distinct)."""
    numbered = docs.withColumn(_ROW, F.monotonically_increasing_id())
    return numbered.join(keys.select(F.col("key.row").alias(_ROW)), _ROW, "left_semi").drop(_ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; learnt from all labels of the rows given."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return _kept(docs, exact_dedup.exact_groups(_keyed(docs, True), id_col="key").filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the smallest id stays; documents without words all stay."""
    found = ngram_join.jaccard_components(_keyed(docs, False), id_col="key", n=5, num=80, den=100)
    return _kept(docs, found.filter("key = component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or paraphrased, go."""
    found = decontamination.contamination(_keyed(docs, False), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _kept(docs, found.filter("NOT contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0).drop("ids")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("best_fit_packing", pack)]

#: Most stages (trained models, retrieval, packing) are beyond SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        path = shared.new_path(spark, "stage")
        docs = shared.table(stage(spark, docs, sf_dir), path)
        if before:
            shared.remove(spark, before)
        before = path
    return docs
