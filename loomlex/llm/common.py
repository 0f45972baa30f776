"""Helpers shared by the training-data operators: stage tables, keys, spreading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.operators.joins import join_bounded
from loomlex.session import shuffle_partitions, stage_table

# Characters that separate words: [\x20\x09-\x0D], as a Java regex class.
BLANKS = r"[\x20\x09-\x0D]"


stage = stage_table


def partitions(spark: SparkSession) -> int:
    """Partitions for explicit exchanges: the session's shuffle setting."""
    return shuffle_partitions(spark)


def keyed_docs(docs: DataFrame) -> DataFrame:
    """(row_key, doc_id, text): text null counts as empty; ``row_key`` is ``doc_key``,
    so rows that repeat doc_id and text share a key and a result, and rows that only
    share a doc_id do not."""
    return docs.select(doc_key().alias("row_key"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def order_key() -> Column:
    """64 bits of (doc_id, text) that put rows into an order; nothing is known by them."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def doc_key() -> Column:
    """A 128-bit digest that stands for (doc_id, text) where 64 bits are too few for
    all rows of a large table; the id's length keeps ids and texts apart."""
    doc_id = F.col("doc_id").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.length(doc_id), F.lit(-1)).cast("string"), F.lit(":"),
                                  F.coalesce(doc_id, F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(key, row): ``doc_key`` beside the whole row, so that no column name can clash."""
    return docs.select(doc_key().alias("key"), F.struct("*").alias("row"))


def anti_join_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_key`` is a ``row_key`` of ``keys``.  Keys
    within the measured broadcast bound go to the rows, so no text is shuffled."""
    keys = stage(keys.select(F.col("row_key").alias("key")), "drop-keys")
    return join_bounded(whole_rows(docs), keys, "key", "left_anti").select("row.*")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan only if it has fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
