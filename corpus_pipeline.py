"""The curation pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; it is written as Parquet and read
again as the next one's docs. Toxic documents go, one document of each near-duplicate class stays,
passages that an earlier document holds are cut, documents that hold a benchmark item go, and the rest is sampled
to the target mix with its weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bagminhash, contamination, langid_ppm, mixing, passages, toxicity
from corpusmill.llm.store import written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, ~langid_ppm.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, model)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.one_of_each(docs)


def stage_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_repeats(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near duplicates", stage_near_duplicates),
    ("passages", stage_passages),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
]

#: The stages learn, align and cluster; tests hold them against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
