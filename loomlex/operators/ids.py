"""Dense, ordered 0-based ids without a single-task global sort.

A plain ``row_number().over(Window.orderBy(...))`` pulls every row into one
task.  Here rows are range-partitioned on the ordering key, sorted inside
each partition, numbered locally, and shifted by the running total of the
preceding partitions' sizes.  Only one row per partition ever meets in a
single task (the offsets table), so the work stays spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlex.session import cut_lineage, shuffle_partitions

_LOW_BITS = (1 << 33) - 1

def dense_ids(df: DataFrame, order_cols: list[str], id_col: str = "id",
              num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = 0-based position of each row in ``order_cols`` order.

    ``order_cols`` must identify rows uniquely (ties would get arbitrary
    consecutive ids).  The range-partitioned, locally numbered rows are
    staged so that the partition sizes and the local numbers always
    describe the same layout, even if executors are lost later.
    """
    n = num_partitions or shuffle_partitions(df.sparkSession)
    ranged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_mono", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    ranged = ranged.select("*", F.shiftright("_mono", 33).alias("_pid"),
                           F.col("_mono").bitwiseAND(F.lit(_LOW_BITS)).alias("_idx"))
    # One row per non-empty partition: bounded by the partition count.
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # at most one row per partition of the range shuffle: a proven bound
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(id_col, F.col("_off") + F.col("_idx")) \
        .drop("_pid", "_idx", "_mono", "_off")


def first_seen_ids(df: DataFrame, key: str | list[str], order: str | list[str],
                   id_col: str = "id") -> DataFrame:
    """Dense ids of distinct keys by their first appearance.

    First appearance = smallest ``order`` value; ties broken by the key.
    Returns one row per key: key columns, ``first_seen`` struct and ``id_col``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    firsts = df.groupBy(*keys).agg(
        F.min(F.struct(*[F.col(o) for o in orders])).alias("_first"))
    flat = firsts.select(*keys, *[F.col("_first")[o].alias(f"_o{i}") for i, o in enumerate(orders)])
    order_cols = [f"_o{i}" for i in range(len(orders))] + keys
    return dense_ids(flat, order_cols, id_col).drop(*[f"_o{i}" for i in range(len(orders))])
