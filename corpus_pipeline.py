"""From raw documents to packed training sequences, stage by stage.

Each stage is written as Parquet and read again before the next one. All but the last give
rows of ``documents``; the last gives the packed pieces.

In all stages a null text counts as an empty one, which is not toxic, equals other empty texts,
is near nothing, has no benchmark words and packs as its end token alone. Rows without an id are
kept unless their text says otherwise. Texts are read whole, whatever their length. Columns
beside those of ``documents`` are kept up to the last stage, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arkloom.llm import decontam, exact_dedup, near_dedup, packing, toxicity
from arkloom.llm.common import work_dir


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.5; repeated rows go or stay alike."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows that repeat it, one."""
    return exact_dedup.distinct_documents(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id; rows that share an id
    are one document."""
    return near_dedup.representatives(docs)


def no_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; an empty benchmark drops none."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 2048 tokens, each row a document."""
    return packing.op8(docs)


STAGES = [("toxicity", not_toxic), ("exact_dedup", distinct_texts), ("near_dedup", no_near_copies), ("decontamination", no_benchmark_text), ("packing", packed)]

#: SQL can express neither the trained scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
