"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  ``run`` writes what a stage returns to the shared folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, line_dedup, mixing, near_dedup, quality
from graphloom.session import kept, ship

#: Per cent of similarity from which documents are near duplicates.
NEAR = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    return line_dedup.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a similarity of NEAR per cent."""
    ship(spark)
    return near_dedup.deduplicated(docs, per_cent=NEAR)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the benchmark passages that are left in them."""
    ship(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", boilerplate_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", source_mix),
]

#: The classifier and the near-duplicate stage are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote before it is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with kept(spark) as keep:
        for k, (_, stage) in enumerate(STAGES):
            with kept(spark) as keep_stage:
                docs = (keep if k + 1 == len(STAGES) else keep_stage)(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
