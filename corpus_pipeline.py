"""From raw documents to a training mix: quality, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and gives the next one's documents; what it returns is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finpanel.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from finpanel.llm.common import free_name, table
from finpanel.llm.queries import quality_model
from finpanel.session import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality.keep(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before; one that loses all its lines is a copy and goes. n_chars follows the text."""
    n_lines, n_dropped = free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns)
    lost = F.col(n_dropped)
    found = line_dedup.deduplicate(docs, n_lines=n_lines, n_dropped=n_dropped).filter((lost == 0) | (lost < F.col(n_lines)))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(lost > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.deduplicate(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    return mixing.Mix(docs).taken()


STAGES = [
    ("quality", good_documents),
    ("line dedup", fresh_lines),
    ("near dedup", one_of_each),
    ("decontamination", untested),
    ("mixing", mixed),
]

#: A trained model decides the first stage, which SQL can't express; ``tests/llm`` checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
