"""M1 TF-IDF, A11 document lengths, A12 vector norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlex.functions.constants import TFIDF_EPS


def doc_lengths(bow: DataFrame) -> DataFrame:
    """Tokens per document ``(doc_id, len)`` from the bag of words."""
    return bow.groupBy("doc_id").agg(F.sum("tf").alias("len"))


def l2_norms(weighted: DataFrame, weight_col: str = "w") -> DataFrame:
    """``(doc_id, norm)`` = sqrt of the sum of squared weights."""
    return weighted.groupBy("doc_id").agg(
        F.sqrt(F.sum(F.col(weight_col) * F.col(weight_col))).alias("norm"))


def tfidf(bow: DataFrame, n_docs: Column | int, eps: float = TFIDF_EPS) -> DataFrame:
    """M1: ``tf * log2(N / df)``, weights <= eps dropped, L2-normalised per doc.

    ``bow`` needs ``(doc_id, token_id, tf, df)``; ``n_docs`` counts every
    document, empty ones included, so a term present in all documents gets
    weight 0 and vanishes.  The per-document norm is a partial+final
    aggregate joined back on ``doc_id``; a very large document is split by
    AQE's skew handling instead of landing in one window task.
    """
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    w = bow.select("doc_id", "token_id",
                   (F.col("tf") * F.log2(n.cast("double") / F.col("df"))).alias("w"))
    w = w.where(F.col("w") > F.lit(eps))
    norms = l2_norms(w)
    return w.join(norms, "doc_id").select(
        "doc_id", "token_id", (F.col("w") / F.col("norm")).alias("weight"))
