"""Physical-plan properties the scale design relies on."""

import contextlib
import io

from pyspark.sql import functions as F

import __spark_entry__ as E
from loomlex.operators import entities as EN
from loomlex.operators import tokens as TK
from loomlex.plans.registry import docs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_scan_prunes_columns_and_pushes_filters(spark):
    p = plan(E.queries()["f6_drop_null_docs"](spark, SF))
    assert "PushedFilters: [IsNotNull(text)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,n_chars:bigint>" in p
    p2 = plan(E.queries()["n9_prepare"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p2


def test_term_counts_aggregate_map_side(spark):
    toks = TK.explode_tokens(TK.doc_tokens(docs(spark, SF)))
    p = plan(TK.term_freq(toks))
    assert "partial_count" in p            # map-side combine before the shuffle


def test_top_k_limits_before_shuffle(spark):
    p = plan(E.queries()["t3_top_terms"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_relevant_terms_are_pruned_before_the_shuffle(spark):
    p = plan(E.queries()["t5_relevant_terms"](spark, SF)).split("\n\n")[0]
    assert p.count("MapInArrow") == 2 and "Window" not in p and "Generate" not in p.split("Exchange")[0]


def test_zero_filled_counts_without_cartesian_product(spark):
    d = spark.createDataFrame([(0, "Ann met Bob, in Paris."), (1, "x")], "doc_id bigint, text string")
    p = plan(EN.entity_type_counts(EN.mentions(d), d))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_stop_words_are_an_in_set(spark):
    toks = TK.explode_tokens(TK.doc_tokens(docs(spark, SF)))
    p = plan(TK.drop_stopwords(toks, TK.default_stop_words()))
    assert "INSET" in p.upper() and "Join" not in p


def test_token_expression_is_evaluated_once(spark):
    """The tokenise pattern stands once in the plan: not in an inferred filter, not in a second scan."""
    toks = TK.explode_tokens(TK.doc_tokens(docs(spark, SF)))
    p = plan(TK.term_counts(toks.select("doc_id", "term")))
    split = [line for line in p.splitlines() if "split(" in line and ("Generate" in line or "Condition" in line
                                                                     or "Output" in line or "Arguments" in line or "Input" in line)]
    assert p.count("Scan parquet") == 2 and sum("size(" in line for line in split) == 0      # once in the tree, once below
    f2 = plan(TK.drop_rare(toks.select("doc_id", "term"), 2))
    assert "split(" not in f2                                                                # reads the staged tokens


def test_head_and_tail_join(spark, monkeypatch):
    """Beyond the byte bound hot keys are broadcast, the others shuffled; no row is lost or doubled."""
    from loomlex.operators import joins
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HEAD_ROWS", 4)
    big = spark.range(1000).select(F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("term"), "id")
    small = big.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("term <> 't7'")
    got = joins.join_head_tail(big, small, "term", "df")
    want = big.join(small, "term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "BroadcastHashJoin" in plan(got)


def test_entity_counts_match_any_spelling(spark):
    d = spark.createDataFrame([(0, "Ann met Bob, in Paris.")], "doc_id bigint, text string")
    rows = EN.entity_type_counts(EN.mentions(d), d, ["Person", "ORG"]).collect()
    assert {r.ent_type: r.n for r in rows} == {"Person": 3, "ORG": 0}
