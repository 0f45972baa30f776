"""Training-corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

``STAGES`` are (name, function) pairs.  Each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlex.llm.common import stage
from loomlex.llm.decontaminate import drop_contaminated
from loomlex.llm.exact_dedup import drop_exact_copies
from loomlex.llm.near_dedup import drop_near_copies
from loomlex.llm.packing import pack
from loomlex.llm.quality import keep_good
from loomlex.session import read_table, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, 0.8)."""
    return drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean),
          ("packing", packing)]

# Similarity search, a trained model and retrieval are not SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
