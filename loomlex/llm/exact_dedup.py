"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition forms a run of (digest, best row, count), sorted by
digest.  Runs are merged in rounds: in each round the runs whose numbers agree
after dropping the lowest bits meet, ``2**bits`` at a time, and per digest only
the row to retain and the row count go on.  The rows of one run are spread over
all tasks by digest, so no task ever holds a whole run, and a digest shared by a
third of all rows reaches each round at most once per run and map task.

Defined cases: null text counts as empty; empty (or blank) texts are equal to
each other; a null doc_id sorts after all others; rows that repeat doc_id and
text form a group of which one is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.llm.common import BLANKS, doc_key, stage, whole_rows
from loomlex.operators.joins import join_bounded

KEY = ["digest", "check", "n_bytes"]


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, run, chars) and the digest of the text without blanks.

    ``check`` and ``n_bytes`` verify the digest: rows are only called equal when
    SHA-256, an independent 64-bit hash and the length all agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = docs.select("doc_id", doc_key().alias("row_key"), F.length(text).cast("long").alias("chars"),
                       F.regexp_replace(text, BLANKS + "+", "").alias("norm"))
    return norm.select(
        "doc_id", "row_key", "chars", F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"), F.octet_length("norm").cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))


def merge_runs(rows: DataFrame, n_runs: int, bits: int = 3) -> DataFrame:
    """Per digest: ``best`` (the row to retain) and ``n`` rows, merged up the tree."""
    best = F.struct((-F.col("chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"),
                    F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    level = rows.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))
    level = level.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    while n_runs > 1:
        level = level.groupBy(F.shiftright("run", bits).alias("run"), *KEY).agg(
            F.min("best").alias("best"), F.sum("n").alias("n"))
        n_runs = (n_runs + (1 << bits) - 1) >> bits
    return level


def exact_groups(docs: DataFrame, bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, keep_id, group_size, kept, text_sha256."""
    rows = stage(digest_rows(docs), "exact-digests")
    n_runs = rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0] + 1
    merged = merge_runs(rows, n_runs, bits).select(*KEY, "best", "n")
    out = rows.join(merged, KEY)
    return out.select(
        F.col("doc_id"), F.col("row_key"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another row stands for; all columns stay.

    The keys of rows that go are sent to the rows within the measured broadcast
    bound.  Only rows that repeat doc_id and text of a kept row are shuffled whole."""
    keys = (exact_groups(docs).groupBy(F.col("row_key").alias("key"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")))
    drop = stage(keys.where("n > 1 OR NOT kept"), "exact-drop")
    rows = whole_rows(docs)
    once = join_bounded(rows, drop.select("key"), "key", "left_anti")
    repeated = join_bounded(rows, drop.where("kept").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return once.unionByName(repeated).select("row.*")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept
  FROM n)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
