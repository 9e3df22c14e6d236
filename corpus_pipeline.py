"""From raw documents to a training mix: five stages, each one of the operators.

Every stage takes all its predecessor kept. Null and empty texts are documents: they score as
empty texts, have no line, link or benchmark item, and of those without words one stays. Rows
that repeat an id or have none are documents by their texts; of rows that repeat wholly one is left
by ``near_duplicates``. Of ties the smallest doc_id stays. Extra columns are carried along,
whatever their names, but for those that ``mixing`` adds. Empty tables give empty ones.
Line dedup comes before near-duplicates, as asked: later copies reach that stage without the
lines that they share, so part of them is already gone or no longer near.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.decontamination import without_contaminated
from quillon.llm.line_dedup import without_repeated_lines
from quillon.llm.mixing import mix
from quillon.llm.ngram_join import one_of_each_class
from quillon.llm.storage import Table
from quillon.llm.toxicity import fit, without_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled documents, rejects go."""
    return without_toxic(docs, fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document go."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates for the documents, to meet the domains' target shares of tokens."""
    return mix(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL expresses neither the classifiers nor the alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents.

    A stage's table goes when the next one is written; the last one stays, the result reads it.
    """
    docs, held = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = Table(stage(spark, docs, sf_dir), name)
        if held is not None:
            held.drop()
        docs, held = after.read(), after
    return docs
