"""The training-data pipeline: each stage takes what its predecessor kept of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.llm import decontam, mixing, near_dup
from nestfold.llm.queries import KEEP_SCORE, quality_scores, token_digests
from nestfold.llm.words import fresh
from nestfold.session import configure, cut


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    configure(spark)
    name = fresh(docs.columns, "score")
    return quality_scores(spark, docs, sf_dir, name=name).filter(F.col(name) >= KEEP_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    configure(spark)
    return near_dup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    configure(spark)
    name = fresh(docs.columns, "hits")
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.filter(F.size(name) == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    configure(spark)
    name = fresh(docs.columns, "mix")
    taken = mixing.take(docs, mixing.plan_mix(docs), name=name)
    return taken.withColumn(name, F.explode(F.array_repeat(F.lit(1), F.col(f"{name}.times").cast("int")))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b files, read back."""
    configure(spark)
    return token_digests(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

# Trained weights, MinHash and the tokenizer have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again as the next one's input."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) - 1 else docs
    return docs
