"""W2 / A3 for corpora that grow: a dictionary that takes batch after batch.

Token ids never change once given.  Frequencies are kept per batch (version), so the
dictionary of any version can be read again, and a batch that is added twice
replaces itself instead of counting twice.

Rule: a term's id is given in the batch that first holds it, new terms in the order
(first document, term).  So if every batch's documents come after the earlier ones'
(larger ids), the ids after all batches are those of one build over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.operators.ids import dense_ids
from loomlex.operators.tokens import term_stats
from loomlex.session import stage_table


@dataclass
class GrowingDictionary:
    """``ids``: (term, token_id, first_doc, version), one row per term; ``frequencies``: (token_id,
    version, cf, df), one row per term and batch that holds it; ``version`` of the last batch."""

    ids: DataFrame
    frequencies: DataFrame
    version: int
    size: int

    def at(self, version: int | None = None, min_cf: int = 1) -> DataFrame:
        """A3 as of a version: ``(term, token_id, cf, df, first_doc)``, terms with at least ``min_cf``
        occurrences so far.  Rare terms keep their ids for when they come back."""
        version = self.version if version is None else version
        so_far = self.frequencies.where(F.col("version") <= version).groupBy("token_id").agg(
            F.sum("cf").alias("cf"), F.sum("df").alias("df")).where(F.col("cf") >= min_cf)
        return self.ids.where(F.col("version") <= version).select("term", "token_id", "first_doc").join(so_far, "token_id") \
            .select("term", "token_id", "cf", "df", "first_doc")


def start(tf: DataFrame) -> GrowingDictionary:
    """The dictionary of a first batch of ``(doc_id, term, tf)``."""
    empty = term_stats(tf).limit(0).withColumns({"token_id": F.lit(0).cast("long"), "version": F.lit(0)})
    return add_batch(GrowingDictionary(empty.select("term", "token_id", "first_doc", "version"),
                                       empty.select("token_id", "version", "cf", "df"), -1, 0), tf)


def add_batch(known: GrowingDictionary, tf: DataFrame, version: int | None = None) -> GrowingDictionary:
    """The dictionary after a batch of ``(doc_id, term, tf)``, with staged tables.

    ``version`` is the next one by default; the last one again replaces that batch (a job
    that runs twice), as long as no later batch was added.  The known terms are
    joined, not sent around: both sides are partitioned by term."""
    version = known.version + 1 if version is None else version
    if version == known.version:  # take the batch back
        ids = known.ids.where(F.col("version") < version)
        size = ids.count()
        frequencies = known.frequencies.where(F.col("version") < version)
    elif version == known.version + 1:
        ids, size, frequencies = known.ids, known.size, known.frequencies
    else:
        raise ValueError(f"version {version} after version {known.version}")
    stats = stage_table(term_stats(tf.where("term IS NOT NULL")), "batch-terms")
    new = dense_ids(stats.join(ids.select("term"), "term", "left_anti"), ["first_doc", "term"], "n")
    new = stage_table(new.select("term", (F.col("n") + size).cast("long").alias("token_id"), "first_doc",
                                 F.lit(version).alias("version")), "new-terms")
    ids = stage_table(ids.unionByName(new), "term-ids")
    counted = stats.select("term", "cf", "df").join(ids.select("term", "token_id"), "term") \
        .select("token_id", F.lit(version).alias("version"), "cf", "df")
    return GrowingDictionary(ids, stage_table(frequencies.unionByName(counted), "term-frequencies"), version,
                             size + new.count())
