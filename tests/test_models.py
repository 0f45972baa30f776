"""Models kept in tables (LSI, variational topics, fold-in) against numpy on the driver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlex.operators import tokens as TK
from loomlex.operators import weights as WT
from loomlex.plans import lsi as L
from loomlex.plans import variational as VB
from loomlex.session import read_table

SF = "/root/testdata/sf0.001"


def sparse_rows(rng, docs, terms, share=0.3):
    a = rng.random((docs, terms)) * (rng.random((docs, terms)) < share)
    return a, [(int(d), int(t), float(a[d, t])) for d, t in zip(*np.nonzero(a))]


def dense(df, rows, columns, value="value"):
    out = np.zeros((rows, columns))
    for r in df.collect():
        out[r[0], r[1]] = r[value]
    return out


# ------------------------------------------------------------ LSI

def test_lsi_equals_numpy(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    corpus = TK.build_corpus(docs)
    weighted = WT.tfidf(corpus.bow, corpus.n_docs)
    rows = weighted.collect()
    ids = {d: i for i, d in enumerate(sorted({r.doc_id for r in rows}))}
    a = np.zeros((len(ids), corpus.vocab_size))
    for r in rows:
        a[ids[r.doc_id], r.token_id] = r.weight
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    doc_topic, topic_term, values = L.lsi(weighted, 3)
    assert np.allclose(values, s[:3], rtol=1e-10)
    got_v = dense(topic_term, 3, corpus.vocab_size)
    got_u = np.zeros((len(ids), 3))
    for r in doc_topic.collect():
        got_u[ids[r.doc_id], r.component] = r.value
    assert np.linalg.norm(got_v @ got_v.T - np.eye(3)) < 1e-9
    assert np.linalg.norm(got_v.T @ got_v - vt[:3].T @ vt[:3]) < 1e-6  # the same subspace
    assert np.allclose(got_u, a @ got_v.T, atol=1e-8)
    assert (got_v.sum(axis=1) > 0).all()


def test_lsi_of_few_documents_and_of_none(spark):
    rng = np.random.default_rng(2)
    a, rows = sparse_rows(rng, 3, 40)
    df = spark.createDataFrame([(f"d{d}", t, w) for d, t, w in rows], "doc_id string, token_id int, weight double")
    doc_topic, topic_term, values = L.lsi(df, 5)
    assert np.allclose(values, np.linalg.svd(a, compute_uv=False), rtol=1e-9) and doc_topic.count() == 9
    doc_topic, topic_term, values = L.lsi(df.limit(0), 2)
    assert values == [] and doc_topic.count() == topic_term.count() == 0
    assert doc_topic.columns == ["doc_id", "component", "value"]


def test_triangles_are_reduced_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4))
    block = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"b{j} double" for j in range(4))).repartition(9)
    r = L.triangle(block, 4)
    assert np.allclose(r.T @ r, x.T @ x)


# ------------------------------------------------------------ variational topics

def brute_vb(counts, lam, alpha, eta, passes, tol=1e-5, steps=200):
    """Batch variational Bayes, one document after the other, with math.lgamma."""
    def psi(x, h=1e-5):
        return VB.digamma(np.array(x))
    k, bounds = lam.shape[0], []
    for p in range(passes + 1):
        beta = np.exp(psi(lam) - psi(lam.sum(1))[:, None])
        gave, bound = np.zeros_like(lam), 0.0
        for row in counts:
            t = np.flatnonzero(row)
            if not len(t):
                continue
            gamma = np.ones(k)
            for _ in range(steps):
                theta = np.exp(psi(gamma) - psi([gamma.sum()])[0])
                new = alpha + theta * (beta[:, t] @ (row[t] / (theta @ beta[:, t])))
                moved = np.abs(new - gamma).mean()
                gamma = new
                if moved <= tol:
                    break
            logs = psi(gamma) - psi([gamma.sum()])[0]
            theta = np.exp(logs)
            norm = theta @ beta[:, t]
            gave[:, t] += theta[:, None] * beta[:, t] * row[t] / norm
            bound += (row[t] * np.log(norm)).sum() + ((alpha - gamma) * logs).sum() + sum(map(math.lgamma, gamma)) \
                - math.lgamma(gamma.sum()) + math.lgamma(k * alpha) - k * math.lgamma(alpha)
        logs = psi(lam) - psi(lam.sum(1))[:, None]
        bound += ((eta - lam) * logs).sum() + sum(map(math.lgamma, lam.ravel())) - lam.size * math.lgamma(eta) \
            + k * math.lgamma(lam.shape[1] * eta) - sum(map(math.lgamma, lam.sum(1)))
        bounds.append(bound)
        if p < passes:
            lam = eta + gave
    return lam, bounds


def test_digamma_and_log_gamma():
    x = np.concatenate([np.logspace(-3, 5, 200), [1.0, 0.5, 8.0]])
    assert np.allclose(VB.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    h = 1e-4 * x
    slope = (VB.log_gamma(x + h) - VB.log_gamma(x - h)) / (2 * h)
    assert np.allclose(VB.digamma(x), slope, rtol=1e-5, atol=1e-5)
    assert abs(VB.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(6)
    topics = rng.dirichlet(np.full(60, 0.1), 3)
    rows = [rng.multinomial(rng.integers(5, 60), rng.dirichlet([0.2] * 3) @ topics) for _ in range(80)]
    return np.array(rows)


def entries(spark, counts):
    return spark.createDataFrame([(int(d), int(t), int(counts[d, t])) for d, t in zip(*np.nonzero(counts))],
                                 "doc_id bigint, token_id int, tf bigint")


def test_blocks_equal_the_driver_fit(spark, counts):
    used = np.flatnonzero(counts.sum(0))
    start = np.maximum(1 + 0.1 * L.gaussians(used, 3, 5), 0.1).T
    want, want_bounds = brute_vb(counts[:, used], start, 1 / 3, 1 / 3, 6)
    for parts in (1, 7):
        model = VB.fit_blocks(entries(spark, counts).repartition(parts), k=3, passes=6, seed=5)
        got = np.zeros((3, len(used)))
        for r in model.table.collect():
            got[:, np.searchsorted(used, r.token_id)] = [r.l0, r.l1, r.l2]
        assert np.allclose(got, want, rtol=1e-6) and np.allclose(model.bounds, want_bounds, rtol=1e-9)
    assert all(b > a for a, b in zip(model.bounds, model.bounds[1:]))
    words = spark.createDataFrame([(int(t), f"w{t}") for t in used], "token_id bigint, term string")
    sums = model.topic_terms(words).groupBy("topic").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.n == len(used) for r in sums)


def test_topics_beyond_the_broadcast_bound(spark, counts, monkeypatch):
    """The same model when no table is small enough to be sent around."""
    from loomlex.operators import joins
    a = VB.fit_blocks(entries(spark, counts), k=3, passes=2, seed=5)
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    b = VB.fit_blocks(entries(spark, counts), k=3, passes=2, seed=5)
    assert np.allclose(a.bounds, b.bounds, rtol=1e-10)


def test_solving_alike_equals_solving():
    rng = np.random.default_rng(3)
    doc = np.repeat([0, 2, 3, 4, 5, 9], [7, 1, 300, 40, 44, 2])
    weight, terms = rng.integers(1, 5, len(doc)).astype(float), rng.random((len(doc), 4))
    for steps, tolerance in ((200, 1e-6), (3, 1e-6), (200, 1e-2)):
        assert np.allclose(VB.solve_alike(doc, 10, weight, terms, 0.3, tolerance, steps),
                           VB.solve(doc, 10, weight, terms, 0.3, True, tolerance, steps), rtol=1e-9)


def test_a_pass_sends_a_block_each_term_once(spark, monkeypatch):
    """Documents share their terms: what a pass sends grows with the terms, not with the entries."""
    from loomlex.plans import blocks as B
    sent = []

    def step(number, block, rows, state):
        import pyarrow as pa
        return pa.RecordBatch.from_pydict({"block": [number], "docs": [len(block.first)], "rows": [len(rows)], "entries": [len(block.local)],
                                           "sum": [float((rows[block.local, 0] * block.weight).sum())]})

    monkeypatch.setattr(B, "BLOCK_ROWS", 500)
    df = spark.createDataFrame([(f"d{d}" if d else None, t, 1.0 + t) for d in range(100) for t in range(20)],
                               "doc_id string, token_id long, weight double")
    laid = B.lay_out(df, "test")
    assert laid.count == 4 and laid.needs.agg(F.sum("n")).first()[0] == 2000
    rows = spark.createDataFrame([(t, float(t)) for t in range(25)], "token_id long, e0 double")
    for r in B.pass_over(laid, rows, ["e0"], step, "block long, docs long, rows long, entries long, sum double").collect():
        sent.append(r)
        assert r.rows == 20 and r.entries == 20 * r.docs and r.sum == r.docs * sum(t * (1 + t) for t in range(20))
    assert sum(r.docs for r in sent) == 100 and sum(r.rows for r in sent) == 20 * len(sent)


def plain_em(a, share, alpha, eta, iterations):
    """MLlib's EM on a dense table; ``share`` (docs, terms, k)."""
    for _ in range(iterations):
        n = a[:, :, None] * share
        in_doc, in_term = n.sum(axis=1), n.sum(axis=0)
        share = (in_term + eta - 1)[None] * (in_doc + alpha - 1)[:, None] / (in_term.sum(axis=0) + a.shape[1] * (eta - 1))
        share = share / share.sum(axis=2, keepdims=True)
    return (a[:, :, None] * share).sum(axis=0)


@pytest.mark.parametrize("least", [10_000, 100])
def test_em_equals_a_plain_loop(spark, counts, monkeypatch, least):
    """One block or many, parts of a block, rows that repeat; and the same whatever the partitions."""
    from loomlex.plans import expectation as EX
    monkeypatch.setattr(EX, "EM_LEAST_ROWS", least)
    monkeypatch.setattr(EX, "PART_ROWS", 70)
    used = np.flatnonzero(counts.sum(0))
    df = entries(spark, counts)
    marks = {r.doc_id: r.m for r in df.select("doc_id", F.xxhash64("doc_id").alias("m")).distinct().collect()}
    start = np.stack([EX.first_shares(np.full(len(used), marks.get(d, 0), np.int64), used, 3, 5) for d in range(len(counts))])
    want = plain_em(counts[:, used].astype(float), start, 6.0, 1.1, 5)
    odd = df.withColumn("tf", F.lit(1)).union(df.withColumn("tf", F.col("tf") - 1)).union(
        spark.createDataFrame([(None, 1, 3), (1, None, 3), (1, 1, None), (1, 1, 0)], df.schema))
    for rows in (df.repartition(1), odd.repartition(7)):
        model = EX.fit_em(rows, 3, 5, seed=5, alpha=6.0)
        got = np.array([[r.l0, r.l1, r.l2] for r in model.table.orderBy("token_id").collect()])
        assert np.allclose(got, want, rtol=1e-9)
    assert model.table.agg(F.sum("n")).first()[0] == (counts > 0).sum()
    docs = spark.range(82).withColumnRenamed("id", "doc_id")
    theta = model.doc_topics(df, "tf", docs).groupBy("doc_id").agg(F.sum("p").alias("s")).collect()
    assert len(theta) == 82 and all(abs(r.s - 1) < 1e-9 for r in theta)


def test_em_keeps_one_pass_of_files(spark, counts):
    """What the passes stage goes when the next one has read it, and no vector of the vocabulary is made."""
    from glob import glob

    from loomlex.plans import expectation as EX
    from loomlex.session import ensure_checkpoint_dir
    EX.fit_em(entries(spark, counts), 3, 4, seed=5)
    assert not glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/tables/em-sums-*")


def test_doc_topics_of_blocks(spark, counts):
    model = VB.fit_blocks(entries(spark, counts), k=3, passes=4, seed=5)
    docs = spark.range(82).withColumnRenamed("id", "doc_id")
    got = model.doc_topics(entries(spark, counts), all_docs=docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.min("p").alias("least")).collect()
    assert len(got) == 82 and all(r.n == 3 and abs(r.s - 1) < 1e-9 for r in got)
    assert {r.least for r in got if r.doc_id >= 80} == {1 / 3}
    assert model.doc_topics(entries(spark, counts), min_p=0.2).where("p < 0.2").count() == 0


# ------------------------------------------------------------ fold-in

def brute_em(row, phi, alpha, steps):
    theta = np.full(len(phi), 1 / len(phi))
    for _ in range(steps):
        mix = theta @ phi
        got = alpha + sum(n * theta * phi[:, t] / mix[t] for t, n in enumerate(row) if n and mix[t] > 0)
        theta = got / got.sum()
    return theta


def test_fold_in_steps(spark, counts, monkeypatch):
    monkeypatch.setattr(VB, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(1)
    phi = rng.dirichlet(np.full(60, 0.3), 4) * (rng.random((4, 60)) < 0.7)
    phi[:, 7] = 0  # a term that no topic has
    table = spark.createDataFrame([(f"t{k}", int(t), float(phi[k, t])) for k, t in zip(*np.nonzero(phi))],
                                  "topic string, token_id int, p double")
    got = VB.fold_in(entries(spark, counts), table, "token_id", method="em", tolerance=None, max_steps=9)
    for r in got.collect():
        assert abs(r.p - brute_em(counts[r.doc_id], phi, 0.25, 9)[int(r.topic[1:])]) < 1e-12
    far = {(r.doc_id, r.topic): r.p for r in VB.fold_in(entries(spark, counts), table, "token_id", method="em", tolerance=1e-9, max_steps=3000).collect()}
    assert max(abs(far[d, f"t{k}"] - brute_em(counts[d], phi, 0.25, 3000)[k]) for d in range(0, 80, 9) for k in range(4)) < 1e-5
    with pytest.raises(ValueError):
        VB.fold_in(entries(spark, counts), table, "token_id", method="other")


def test_long_documents_span_batches(counts):
    """A document over many Arrow batches is solved whole, as are its neighbours."""
    import pyarrow as pa
    sizes = [3, 25_000, 1, 70_000, 20_000, 2]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    batch = pa.RecordBatch.from_pydict({"doc_id": doc, "x": np.arange(len(doc))})
    parts = list(VB._whole_documents([batch.slice(i, 10_000) for i in range(0, len(doc), 10_000)], ["x"]))
    seen = [int(d) for _, number, first, got in parts for d in np.asarray(doc)[got["x"][first]]]
    assert seen == list(range(len(sizes)))
    assert sum(len(got["x"]) for *_, got in parts) == len(doc)


def test_fold_in_of_nothing(spark):
    table = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0)], "topic int, term string, p double")
    bow = spark.createDataFrame([(1, "a", 2.0), (2, "zz", 1.0), (None, "a", 1.0)], "doc_id bigint, term string, tf double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    got = {(r.doc_id, r.topic): r.p for r in VB.fold_in(bow, table, all_docs=docs).collect()}
    assert got[(2, 0)] == got[(3, 1)] == 0.5 and got[(1, 0)] > 0.8 and len(got) == 6
    assert VB.fold_in(bow.limit(0), table).count() == 0


# ------------------------------------------------------------ sampling

def brute_sweeps(rows, k, iterations, alpha, beta, seed, sync_every):
    """One occurrence after the other; rows of (doc, mark, place, token, topic)."""
    from loomlex.plans import sampling as SP
    rows = sorted([list(r) for r in rows], key=lambda r: (r[0], r[2], r[3]))
    vocab = len({r[3] for r in rows})
    for sweep in range(iterations):
        if sweep % sync_every == 0:
            term, total, held = {}, np.zeros(k), [r[4] for r in rows]
            for r in rows:
                term.setdefault(r[3], np.zeros(k))[r[4]] += 1
                total[r[4]] += 1
        in_doc = {}
        for r in rows:
            in_doc.setdefault(r[0], np.zeros(k))[r[4]] += 1
        for r, was in zip(rows, held):
            own = np.eye(k)[was]
            in_doc[r[0]][r[4]] -= 1
            w = np.cumsum((in_doc[r[0]] + alpha) * (term[r[3]] - own + beta) / (total - own + vocab * beta))
            u = SP.uniforms(np.array([r[1]]), np.array([r[2]]), sweep, seed)[0]
            r[4] = min(int((w <= u * w[-1]).sum()), k - 1)
            in_doc[r[0]][r[4]] += 1
    return [tuple(r) for r in rows]


def test_sampling_does_not_depend_on_partitions(spark, counts):
    from loomlex.plans import sampling as SP
    got = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            model = SP.sample_topics(entries(spark, counts).repartition(parts), k=3, iterations=7, seed=9, sync_every=3)
            got.append(sorted(tuple(r) for r in model.assigned.collect()))
            assert model.counts.agg(F.sum("n")).first()[0] == counts.sum()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1]
    start = SP.sample_topics(entries(spark, counts), k=3, iterations=0, seed=9)
    want = brute_sweeps([tuple(r) for r in start.assigned.collect()], 3, 7, 50 / 3, 0.1, 9, 3)
    assert got[0] == sorted(want)


def test_sampling_finds_planted_topics(spark):
    from loomlex.plans import sampling as SP
    rng = np.random.default_rng(3)
    rows = [(d, 10 * (d % 3) + int(t), 1) for d in range(120) for t in rng.integers(0, 10, 25)]
    bow = spark.createDataFrame(rows, "doc_id bigint, token_id int, tf bigint")
    model = SP.sample_topics(bow, k=3, iterations=60, seed=2, alpha=0.5, sync_every=6)
    assert model.likelihoods[-1] > model.likelihoods[0]
    main = {(r.token_id // 10): [r.c0, r.c1, r.c2].index(max(r.c0, r.c1, r.c2)) for r in model.counts.collect()}
    pure = sum(max(r.c0, r.c1, r.c2) for r in model.counts.collect()) / len(rows)
    assert sorted(main.values()) == [0, 1, 2] and pure > 0.95
    words = spark.createDataFrame([(t, f"w{t}") for t in range(30)], "token_id bigint, term string")
    sums = model.topic_terms(words).groupBy("topic").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 3 and all(abs(r.s - 1) < 1e-9 for r in sums)
    docs = spark.range(121).withColumnRenamed("id", "doc_id")
    theta = model.doc_topics(docs).groupBy("doc_id").agg(F.sum("p").alias("s")).collect()
    assert len(theta) == 121 and all(abs(r.s - 1) < 1e-9 for r in theta)


def test_sampling_of_nothing(spark):
    from loomlex.plans import sampling as SP
    none = spark.createDataFrame([(None, 1, 2), (1, None, 1), (1, 1, 0)], "doc_id bigint, token_id int, tf bigint")
    model = SP.sample_topics(none, k=2, iterations=3)
    assert model.assigned.count() == 0 and model.counts.count() == 0


def test_short_documents_are_swept_together():
    """A sweep's steps are those of the longest document of a chunk: 60,000 occurrences are one
    chunk, and what a document gets does not depend on its chunk."""
    import pyarrow as pa

    from loomlex.plans import sampling as SP
    n, k, calls = 60_000, 3, []
    rng = np.random.default_rng(4)
    doc = np.sort(rng.integers(0, 900, n))
    columns = {"doc_id": doc, "mark": doc * 31, "place": np.arange(n), "token_id": rng.integers(0, 50, n),
               "topic": rng.integers(0, k, n).astype(np.int32)} | {f"c{j}": rng.integers(1, 99, n) for j in range(k)}
    batches = pa.Table.from_pydict(columns).to_batches(max_chunksize=5000)
    whole, SP_sweep = SP.sweep_documents, SP.SWEEP_ROWS

    def counted(*args):
        calls.append(len(args[0]))
        return whole(*args)

    def run():
        calls.clear()
        out = SP._sweep_batches(k, np.full(k, 1e5), range(3), 2.0, 0.1, 50, 8)(iter(batches))
        return np.concatenate([b["topic"].to_numpy() for b in out])
    try:
        SP.sweep_documents = counted
        together = run()
        assert calls == [n]
        SP.SWEEP_ROWS = 7_000
        assert (run() == together).all() and len(calls) > 5
    finally:
        SP.sweep_documents, SP.SWEEP_ROWS = whole, SP_sweep
