"""The corpus pipeline: toxic documents and near-duplicates go, benchmark passages go, sources are mixed, shards are dealt.

Each stage takes ``(spark, docs, sf_dir)`` and its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``. Null texts stay (they are neither toxic nor contaminated, and duplicates
of each other); an empty table passes through as one; repeated rows leave one near-duplicate; extra columns are carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from starloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from starloom.session import shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return simhash.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; where a run ends inside one, its words in the run. Documents without words stay once."""
    return mixing.mixed_rows(docs, wordless=True)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and the shard, slot and grown shard of each row."""
    return sharding.shard_documents(docs, keep=docs.columns)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained classifier and XXH64 have no SQL form; the tests run a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Results go to the shared folder; one is deleted when the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            target = spark._jvm.org.apache.hadoop.fs.Path(before)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        before = path
    return docs
