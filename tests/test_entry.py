"""Driver contract: entry() runs; every oracle has a query; queries run."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"doc_id", "rank", "term", "weight"}
    assert df.count() > 0


def test_registry_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90
    for name in q:
        assert name == "pipeline" or "_" in name and name[0] in "acefjkmnopstuwx"


def test_sql_checked_queries_run_small(spark):
    q = E.queries()
    for name in ["n9_prepare", "x2_human_size", "s4_html_to_text", "j5_full_paths", "w1_first_seen_ids"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0


def test_queries_load_without_a_session():
    """The driver lists queries and SQL before it starts Spark."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
