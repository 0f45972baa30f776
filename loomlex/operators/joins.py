"""Join helpers: broadcast only behind a measured size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of at most this many bytes (rows without compression) is sent to every
# executor.  Larger sides are joined with a shuffle (AQE splits skewed partitions).
MAX_BROADCAST_BYTES = 64 << 20

# Rows of tables whose length is a model or configuration parameter (topics,
# labels, types) and is known without counting.
FEW_ROWS = 10_000


def measured_bytes(df: DataFrame) -> int:
    """Size of all rows: variable-length columns by their bytes, others by 8 each.
    One aggregate with a partial sum per task."""
    wide = [f for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    other = [f for f in df.schema.fields if f not in wide]
    if any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) for f in other):
        return MAX_BROADCAST_BYTES + 1  # nested columns are not measured: shuffle
    row = F.lit(16 + 8 * len(other))
    for f in wide:
        row = row + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


def bounded_broadcast(df: DataFrame, known_rows: int | None = None) -> DataFrame:
    """``broadcast(df)`` if its length is known to be small or its measured bytes
    are within the bound, else ``df`` unchanged."""
    if known_rows is not None and known_rows <= FEW_ROWS:
        return F.broadcast(df)
    return F.broadcast(df) if measured_bytes(df) <= MAX_BROADCAST_BYTES else df


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 known_rows: int | None = None) -> DataFrame:
    """Join ``big`` with ``small``, broadcasting ``small`` only behind the bound."""
    return big.join(bounded_broadcast(small, known_rows), on, how)


HEAD_ROWS = 100_000


def join_head_tail(big: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per ``key``) when few keys own
    many rows of ``big``; ``weight`` is a key's row count in ``big``.

    Within the byte bound ``small`` is broadcast.  Beyond it, the keys that own at
    least one in ``HEAD_ROWS`` of all rows (so at most ``HEAD_ROWS`` keys) are
    broadcast and never shuffled; only the rows of the other keys are."""
    if measured_bytes(small) <= MAX_BROADCAST_BYTES:
        return big.join(F.broadcast(small), key)
    total = small.agg(F.sum(weight)).first()[0] or 0
    is_head = F.col(weight) * HEAD_ROWS >= total
    head, tail = small.where(is_head), small.where(~is_head)
    rest = big.join(F.broadcast(head.select(key)), key, "left_anti")
    return big.join(F.broadcast(head), key).unionByName(rest.join(tail, key))
