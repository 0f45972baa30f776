"""Exact, near, word-window and byte-string deduplication against plain Python."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from loomlex.llm import exact_dedup, near_dedup, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, ties, nulls, blanks, repeated rows, periodic and long texts."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(5, 160)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", "  \t", 3)) for i, t in enumerate(base[:10])]      # equal without blanks
    passage = words(rng, 60)
    rows += [(200 + i, f"{words(rng, 20)} {passage} {words(rng, 30)}") for i in range(8)]
    long = base[0] + " " + words(rng, 120)
    for i in range(30):                                                          # near copies of one text
        w = long.split()
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((300 + i, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one"), (405, "é ü " * 60), (406, "É ü " * 60),
             (407, "a b " * 80), (408, "z" * 1000), (409, "z" * 250), (7, base[7]), (7, base[7]), (None, passage),
             (None, passage), (None, None), (410, words(rng, 4000)), (411, "\u4e2d\u6587 " * 90)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with columns whose names clash with the operators' own."""
    return (spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("key", F.lit("k")).withColumn("row_key", F.lit(1))
            .withColumn("start", F.lit(0)).withColumn("rep", F.lit(2)).withColumn("kept", F.lit(None).cast("boolean")))


def test_exact_groups(docs, rows, rows_of):
    got = exact_dedup.exact_groups(docs)
    assert rows_of(got.select("doc_id", "keep_id", "group_size", "text_sha256")) == sorted(
        brute.exact(rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got.where("kept").count() == len({r[3] for r in brute.exact(rows)})
    one = got.where("kept").groupBy("text_sha256").count().where("count > 1")
    assert one.count() == 0


def test_exact_tree_has_levels(spark):
    """65 runs and two of them to a merge: seven rounds, the same result."""
    df = spark.range(0, 650, 1, 65).select((F.col("id") % 650).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    for bits in (1, 3, 8):
        got = exact_dedup.exact_groups(df, bits).where("kept").select("doc_id", "group_size").collect()
        assert sorted(r.doc_id for r in got) == list(range(7)) and sum(r.group_size for r in got) == 650


def test_drop_exact_copies_keeps_columns(docs, rows):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({r[3] for r in brute.exact(rows)})


def test_substrings(docs, rows, rows_of):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows_of(substring_dedup.report(docs)) == sorted(brute.substrings(rows), key=key)


def test_suffixes(docs, rows, rows_of):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows_of(suffix_dedup.report(docs)) == sorted(brute.suffixes(rows), key=key)


def test_sketch_overestimates_only(spark, docs, rows, rows_of):
    """A sketch of 256 cells is full; the result stays exact."""
    source = near_dedup.spread(substring_dedup.keyed_docs(docs)).select("row_key", "text")
    small = rows_of(substring_dedup.repeated_spans(source, log2_cells=16).distinct())
    large = rows_of(substring_dedup.repeated_spans(source).distinct())

    def cover(spans):
        return {(k, i) for k, s, e in spans for i in range(s, e)}
    assert cover(small) == cover(large)


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_hot_anchors_are_split(spark, docs, rows_of, module):
    """A phrase in many documents, with different words around it, does not gather in one bucket."""
    rng = random.Random(5)
    line = "the same seventeen words stand in each of these documents again and again with different words around it"
    rows = [(i, f"{words(rng, 40, 9999)} {line} {words(rng, 40, 9999)}") for i in range(200)]
    rows += [(500 + i, rows[i][1] + " end") for i in range(5)]
    tables = [spark.createDataFrame(rows, SCHEMA), docs]
    find = module.candidates if module is substring_dedup else module.slices

    def cover(spans):
        return {(k, i) for k, s, e in rows_of(spans) for i in range(s, e)}
    for table in tables:
        source = substring_dedup.keyed_docs(table).select("row_key", "text").repartition(4)
        want = cover(module.repeated_spans(source))
        assert want and cover(module.repeated_spans(source, hot=100)) == want

    def largest(hot):
        source = substring_dedup.keyed_docs(tables[0]).select("row_key", "text").repartition(4)
        return find(source, hot=hot).where("kind <> 1").groupBy("key").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert largest(1 << 30) > 100 >= largest(100)


def test_rows_are_known_by_128_bits(spark, monkeypatch):
    """Two rows whose 64-bit hashes agree keep spans of their own."""
    from loomlex.llm import common
    monkeypatch.setattr(common.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    rng = random.Random(8)
    shared, other = words(rng, 60, 9999), words(rng, 60, 9999)
    rows = [(1, shared), (2, f"{words(rng, 70, 9999)} {shared}"), (3, f"{other} {words(rng, 90, 9999)}"), (4, other)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, substring_dedup.report(table).collect())) == sorted(brute.substrings(rows))
    assert sorted(map(tuple, suffix_dedup.report(table).collect())) == sorted(brute.suffixes(rows))


def test_small_blocks_sort_the_same(docs, rows, rows_of, monkeypatch):
    """Suffix buckets one at a time."""
    got = []
    import numpy as np
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1600] = text[100:700]
    text[2000:2600] = text[130:730]
    starts = np.arange(len(text) - 200)
    got = suffix_dedup.repeated_suffixes(text, starts, np.ones(len(starts), dtype=np.int64))
    raw = text.tobytes()
    from collections import Counter
    times = Counter(raw[i:i + 200] for i in starts)
    assert got.tolist() == [times[raw[i:i + 200]] > 1 for i in starts]


def test_difference_cover():
    d = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.V for a in d for b in d} == set(range(suffix_dedup.V)) and len(d) < 9


@pytest.mark.parametrize("n", [2, 5])
def test_near_groups(docs, rows, n):
    got = near_dedup.near_groups(docs, n).collect()
    known = [(d, t) for d, t in rows if d is not None]
    want = brute.near(known, n)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)


def test_near_groups_on_given_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.near([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df).collect()}
    assert got == want


def test_chain_of_links(spark):
    """a-b and b-c are similar, a-c are not: one component."""
    w = [f"w{i}" for i in range(200)]
    texts = [" ".join(w), " ".join(w[20:]), " ".join(w[40:]), " ".join(w[60:])]
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], SCHEMA)
    assert {r.component_id for r in near_dedup.near_groups(df, 2).collect()} == {1}


def test_drop_near_copies(docs, rows):
    out = near_dedup.drop_near_copies(docs, 2)
    assert out.columns == docs.columns
    known = brute.near([(d, t) for d, t in rows if d is not None], 2)
    assert sorted({r.doc_id for r in out.collect() if r.doc_id is not None}) == sorted({c for _, c in known.values()})


@pytest.mark.parametrize("run", [
    exact_dedup.exact_groups, exact_dedup.drop_exact_copies, near_dedup.near_groups, near_dedup.drop_near_copies,
    substring_dedup.report, suffix_dedup.report])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_native_plan(spark, docs, capsys):
    exact_dedup.exact_groups(docs).explain()
    assert "Python" not in capsys.readouterr().out
