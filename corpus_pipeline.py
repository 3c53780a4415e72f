"""A corpus from raw documents to shards: language, near-duplicates, benchmark passages, mix, shards."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm import decontamination, language, mixing, nearduplicates, sharding
from siltmark.llm.store import discard, swept


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin."""
    dictionaries = language.fit(docs.where(~language.held_out(docs)))
    # columns of docs may be named as those that are found
    names = [f"__in{k}" for k in range(len(docs.columns))]
    found = language.identify(docs.toDF(*names), dictionaries, text=names[docs.columns.index("text")])
    return found.where(~F.col("rejected")).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id."""
    return nearduplicates.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that consist of them for the most part go."""
    clean = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources holds them."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(docs, shards=40)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Compression, sampling and the automaton can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, swept(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
