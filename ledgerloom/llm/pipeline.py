"""The corpus pipeline: documents to a clean, mixed and sharded corpus.

Every stage works on all rows its predecessor kept.  All but the last return the
columns of documents.  Stages bear null ids, sources and texts, repeated rows, empty
tables and other columns, as the operators they call say: rows without an id or a word
are never near duplicates, and repeated rows are documents of their own except to
``drop_near_duplicates``, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from ledgerloom.llm.common import read, shared_folder

SHARDS = 8


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.3 go."""
    score = quality.scorer(docs, read(spark, sf_dir, "labels"))
    return docs.where(score >= 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8, the smallest id stays."""
    return ngram_join.one_of_each_group(docs, k=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes once for each time it is drawn,
    shard by shard in shuffled order."""
    return mixing.mixed(docs, shards=SHARDS)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

# The classifier's weights, the mix's draws and the ring can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = shared_folder(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
