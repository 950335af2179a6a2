"""From raw documents to token files: quality, near duplicates, benchmark leaks, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame; all but the last return the columns of ``documents``. Between stages rows are written as
Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swaplens.llm import decontamination, mixing, near_dedup, quality, token_output
from swaplens.llm.shared import materialize

#: Learned models, pivotal rounding and token files can't be expressed in SQL; stages are tested
#: against brute force instead.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word similarity 0.8 or more."""
    return near_dedup.keep_one_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of the mix, summarised per document copy."""
    return token_output.round_trip(docs, token_output.default_tokenizer())


STAGES = [
    ("quality classifier", classify),
    ("near-duplicate removal", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("token output", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"stage{number + 1}")
    return docs
