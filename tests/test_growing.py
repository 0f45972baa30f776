"""Dictionaries that grow batch by batch, and appends that survive a retry."""

import pytest
from pyspark.sql import functions as F

from loomlex.operators import growing as GD
from loomlex.operators import tokens as TK
from loomlex.sinks import writers as W

TF = "doc_id bigint, term string, tf bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_equal_one_build(spark):
    import random
    rng = random.Random(4)
    data = list({(d, f"w{min(rng.randrange(60), rng.randrange(60))}"): None for d in range(60) for _ in range(9)})
    tf = spark.createDataFrame([(d, t, rng.randrange(1, 4)) for d, t in data], TF)
    known = GD.start(tf.where("doc_id < 10"))
    versions = [rows(known.at())]
    for lo, hi in ((10, 11), (11, 40), (40, 40), (40, 60)):
        known = GD.add_batch(known, tf.where(F.col("doc_id").between(lo, hi - 1)))
        versions.append(rows(known.at()))
    whole = TK.assign_token_ids(TK.term_stats(tf)).select("term", "token_id", "cf", "df", "first_doc")
    assert versions[-1] == rows(whole)
    assert [rows(known.at(v)) for v in range(5)] == versions  # every version can be read again
    assert rows(known.at(min_cf=5)) == [r for r in versions[-1] if r[2] >= 5]
    # a batch that is added again replaces itself
    again = GD.add_batch(known, tf.where("doc_id >= 40"), version=4)
    assert rows(again.at()) == versions[-1] and again.size == known.size
    fewer = GD.add_batch(known, tf.where("doc_id >= 50"), version=4)
    assert rows(fewer.at(3)) == versions[3]
    with pytest.raises(ValueError):
        GD.add_batch(known, tf, version=2)


def test_dictionary_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 1)], TF)
    known = GD.add_batch(GD.start(none), spark.createDataFrame([(2, "a", 3)], TF))
    assert rows(known.at()) == [("a", 0, 3, 1, 2)] and rows(known.at(0)) == []


def test_append_once(spark, scratch):
    path = f"{scratch}/out"
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id bigint, text string")
    assert W.append_once(df.where("doc_id < 5"), path, "a")
    assert not W.append_once(df, path, "a")  # the job that runs again
    # an attempt that died before its rename is not read
    df.write.json(f"{path}/_attempt-dead")
    assert W.append_once(df.where("doc_id >= 15"), path, "b")
    got = rows(spark.read.json(path).select("doc_id", "batch"))
    assert got == [(i, "a") for i in range(5)] + [(i, "b") for i in range(15, 20)]
    for name in ("", "a/b", "x.y"):
        with pytest.raises(ValueError):
            W.append_once(df, path, name)


def test_a_write_that_fails_leaves_nothing(spark, scratch):
    path = f"{scratch}/out"
    df = spark.range(40).withColumnRenamed("id", "doc_id").repartition(4)
    bad = df.withColumn("text", F.when(F.col("doc_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")))
    with pytest.raises(Exception, match="lost"):
        W.append_once(bad, path, "a")
    assert W.append_once(df.withColumn("text", F.lit("x")), path, "a")
    assert spark.read.json(path).count() == 40


def test_append_spans_skips_documents_of_earlier_batches(spark, scratch):
    path = f"{scratch}/spans"
    df = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id bigint, text string")
    assert W.append_spans(df.where("doc_id < 4"), path, "one") and W.append_spans(df, path, "two")
    assert rows(W.read_spans(spark, path, df.schema)) == rows(df) and spark.read.json(path).count() == 9
    # two jobs at a time: a document in both batches is read once
    W.append_once(df.where("doc_id = 2").withColumn("text", F.lit("other")), path, "zzz")
    assert rows(W.read_spans(spark, path, df.schema)) == rows(df)
    files = spark.createDataFrame([("/a", 0, 1), ("/b", 0, 2)], "path string, image int, volume int")
    assert W.append_file_list(files, f"{scratch}/lists", "one") and not W.append_file_list(files, f"{scratch}/lists", "one")
    assert rows(spark.read.text(f"{scratch}/lists").select("value", "image", "volume", "batch")) == [("/a", 0, 1, "one"), ("/b", 0, 2, "one")]
