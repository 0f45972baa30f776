"""Model invariants (FIXTURES.md §3.6) and topic-summary properties."""

import pytest
from pyspark.sql import functions as F

from loomlex.operators import topicviews as TV
from loomlex.plans.jobs import line_topic_job, topic_job
from loomlex.session import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def job(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    return topic_job(docs, k=4, max_iter=3, seed=3)


def test_distributions_sum_to_one(job):
    full = job["stats"].topics
    assert full.count() == 4
    sums = job["topic_terms"].groupBy("topic").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 4 and all(abs(r.s - 1) < 1e-6 for r in sums)
    model = job["model"]
    vec = job["corpus"].bow
    assert vec.count() > 0
    theta = job["doc_topics"]
    assert theta.where(F.col("p") < 0.01).count() == 0


def test_doc_topic_rows_sum_to_one(spark, job):
    from loomlex.plans import topics as TM
    corpus = job["corpus"]
    docs = read_table(spark, SF, "documents").select("doc_id")
    vec = TM.bow_vectors(corpus.bow, corpus.vocab_size, "tf", docs)
    full = TM.doc_topics(job["model"], vec, None)
    nonempty = corpus.bow.select("doc_id").distinct()
    sums = full.join(nonempty, "doc_id").groupBy("doc_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in sums)


def test_summary_invariants(job):
    st = job["stats"]
    tot = st.terms.agg(F.sum("tot")).first()[0]
    tfreq = st.topics.agg(F.sum("tfreq")).first()[0]
    assert abs(tot - tfreq) < 1e-6 * max(1.0, tfreq)
    info = job["topic_info"]
    assert info.where(F.col("category") == "Default").count() == 30
    cats = {r.category for r in info.select("category").distinct().collect()}
    assert cats == {"Default", "Topic1", "Topic2", "Topic3", "Topic4"}


def test_js_matrix(job):
    st = job["stats"]
    js = TV.js_distances(job["topic_terms"]).collect()
    assert len(js) == 6
    assert all(0 <= r.js <= 0.6931471805599453 + 1e-12 for r in js)
    coords = TV.topic_coordinates(TV.js_distances(job["topic_terms"]), st.topics).collect()
    assert sorted(r.topic for r in coords) == [1, 2, 3, 4]
    assert abs(sum(r.freq for r in coords) - 100) < 1e-6


def test_same_seed_same_topics(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    a = topic_job(docs, k=3, max_iter=2, seed=11, with_map=False)["topic_terms"]
    b = topic_job(docs, k=3, max_iter=2, seed=11, with_map=False)["topic_terms"]
    ra = {(r.topic, r.term): round(r.p, 12) for r in a.collect()}
    rb = {(r.topic, r.term): round(r.p, 12) for r in b.collect()}
    assert ra == rb


def test_line_job_em(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    out = line_topic_job(docs, k=3, max_iter=2, seed=5)
    sums = out["topic_terms"].groupBy("topic").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 3 and all(abs(r.s - 1) < 1e-6 for r in sums)


def test_relevance_pruned_equals_direct(job):
    base = TV.relevance_base(job["stats"])
    a = {tuple(r) for r in TV.relevant_terms(base).select("topic", "term").collect()}
    b = {tuple(r) for r in TV.relevant_terms_direct(base).collect()}
    assert a == b and len(a) >= 30


def test_js_many_topics_and_gaps(spark):
    """K = 100 with missing topic numbers, against a dense numpy sum."""
    import numpy as np
    rng = np.random.default_rng(1)
    ids = [3 * i for i in range(100)]
    dense = rng.random((100, 40)) * (rng.random((100, 40)) < 0.7)
    dense /= dense.sum(axis=1, keepdims=True)
    rows = [(t, f"w{j}", float(dense[i, j])) for i, t in enumerate(ids) for j in range(40) if dense[i, j] > 0]
    js = {(r.topic_a, r.topic_b): r.js for r in
          TV.js_distances(spark.createDataFrame(rows, "topic int, term string, p double")).collect()}
    assert len(js) == 4950

    def kl(p, m):
        ok = p > 0
        return float((p[ok] * np.log(p[ok] / m[ok])).sum())
    for a, b in [(0, 1), (5, 77), (98, 99)]:
        m = (dense[a] + dense[b]) / 2
        assert abs(js[ids[a], ids[b]] - (kl(dense[a], m) + kl(dense[b], m)) / 2) < 1e-12


def test_label_without_tokens_leaves_a_gap(spark):
    """A label whose documents are empty has a number but no terms: the others keep theirs."""
    tf = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (2, "b", 3)], "doc_id bigint, term string, tf bigint")
    docs = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "doc_id bigint, lang string")
    phi, theta, labels = TV.labelled_model(tf, docs, "lang")
    lengths = spark.createDataFrame([(0, 3), (2, 3)], "doc_id bigint, len bigint")
    st = TV.topic_stats(phi, theta, lengths)
    js = TV.js_distances(phi)
    assert [(r.topic_a, r.topic_b) for r in js.collect()] == [(0, 2)]
    assert TV.topic_coordinates(js, st.topics).count() == 2


def test_relevance_with_few_terms(spark):
    """Fewer terms than the report length: all are kept at every step."""
    phi = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "b", 1.0)], "topic int, term string, p double")
    theta = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "doc_id bigint, topic int, p double")
    lengths = spark.createDataFrame([(0, 4), (1, 2)], "doc_id bigint, len bigint")
    base = TV.relevance_base(TV.topic_stats(phi, theta, lengths))
    assert sorted((r.topic, r.term) for r in TV.relevant_terms(base).collect()) == [(0, "a"), (0, "b"), (1, "b")]


def test_top_level_walk():
    """The level at random points equals a plain ranking; equal lines rank by place."""
    import numpy as np
    rng = np.random.default_rng(0)
    for n, r in ((1, 3), (5, 2), (40, 5), (300, 30)):
        a, b = np.round(rng.normal(size=n), 2), np.round(rng.normal(size=n), 2)
        a[n // 2:n // 2 + 3], b[n // 2:n // 2 + 3] = a[0], b[0]
        walk = TV.level_walk(a, b, r)
        edges = [lam for lam, _ in walk] + [1.0]
        assert edges[0] == 0.0 and edges == sorted(edges)
        for lam in rng.random(200):
            if min(abs(lam - e) for e in edges) < 1e-9:
                continue
            members = [m for (lo, m), hi in zip(walk, edges[1:]) if lo <= lam < hi][-1]
            want = np.argsort(-(b + lam * (a - b)), kind="stable")[:r]
            assert sorted(want.tolist()) == members.tolist()
        ranked = [np.argsort(-np.floor((i / 20 * a + (1 - i / 20) * b) * 1e9 + 0.5), kind="stable")[:r] for i in range(21)]
        assert np.flatnonzero(TV.on_grid(a, b, r, 20)).tolist() == sorted(set(np.concatenate(ranked).tolist()))
        reach = TV.reaching(a, b, r)
        assert all(reach[m].all() for _, m in walk)


def test_levels_list_the_crossings(spark):
    """Three lines, top 1: a until it meets b, then b; c is never on top."""
    rows = [(0, "a", 0.0, 1.0), (0, "b", 1.0, 0.0), (0, "c", 0.1, 0.2), (1, "z", 0.0, 0.0), (1, "y", 0.0, 0.0)]
    base = spark.createDataFrame([(t, w, 0.1, 1.0, 2.0, p, q) for t, w, p, q in rows],
                                 "topic int, term string, phi double, ttf double, tot double, logprob double, loglift double")
    got = sorted(tuple(r) for r in TV.relevance_levels(base.repartition(3), 1).collect())
    assert got == [(0, "a", 0.0, 0.5), (0, "b", 0.5, 1.0), (1, "y", 0.0, 1.0)]
    assert TV.relevance_levels(base.limit(0), 1).count() == 0


def test_relevant_terms_have_no_grid_in_the_plan(spark):
    import __spark_entry__ as E
    plan = E.queries()["t5_relevant_terms"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "0.99" not in plan and "MapInArrow" in plan
