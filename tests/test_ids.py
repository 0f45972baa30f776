"""Dense ordered ids equal a global row_number, without a single-task sort."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlex.operators.ids import dense_ids, first_seen_ids


def test_dense_ids_match_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("v"))
    got = dense_ids(df, ["k", "v"], "rid", num_partitions=7)
    ref = df.withColumn("rid", F.row_number().over(Window.orderBy("k", "v")) - 1)
    a = sorted((r.k, r.v, r.rid) for r in got.collect())
    b = sorted((r.k, r.v, r.rid) for r in ref.collect())
    assert a == b
    assert [r.rid for r in got.orderBy("rid").collect()] == list(range(5000))


def test_first_seen_ids(spark):
    df = spark.createDataFrame([("b", 1, 0), ("a", 1, 1), ("b", 0, 5), ("c", 2, 0)], "k string, o1 int, o2 int")
    got = {r.k: r.id for r in first_seen_ids(df, "k", ["o1", "o2"], "id").collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def test_dense_ids_do_not_depend_on_partitions(spark):
    """One path at every size: the ids are the positions in key order."""
    df = spark.range(0, 300).select((F.col("id") * 37 % 301).alias("k"))
    want = {k: i for i, k in enumerate(sorted(r.k for r in df.collect()))}
    for n in (1, 7, None):
        assert {r.k: r.rid for r in dense_ids(df, ["k"], "rid", num_partitions=n).collect()} == want
