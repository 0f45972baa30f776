"""Topic summaries over any ``(topic, term, p)`` / ``(doc_id, topic, p)``
model: proportions, term-topic frequencies, saliency, relevance, topic info,
token table, topic distances and the 2-D topic map.

Inputs are long tables.  Per-topic quantities have K rows (K = number of
topics, a model parameter), so they are broadcast with a proven bound;
per-term work is partitioned by term.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlex.functions.constants import RELEVANCE_STEPS, SUMMARY_TERMS
from loomlex.operators.ids import dense_ids
from loomlex.operators.joins import bounded_broadcast
from loomlex.session import cut_lineage, ship_package


def _ln(c: Column) -> Column:
    return F.ln(c)


@dataclass
class TopicStats:
    topics: DataFrame      # (topic, tfreq, proportion, new_topic)
    ttf: DataFrame         # (topic, term, phi, ttf)
    terms: DataFrame       # (term, tot, pw, distinctiveness, saliency)
    n_topics: int


def topic_proportions(doc_topic: DataFrame, lengths: DataFrame) -> DataFrame:
    """M7 + T6: ``tfreq[t] = sum_d theta[d,t]*len[d]``, proportions, and
    topics renumbered 1..K by descending proportion (ties by topic)."""
    tf = doc_topic.join(lengths, "doc_id").groupBy("topic").agg(
        F.sum(F.col("p") * F.col("len")).alias("tfreq"))
    total = tf.agg(F.sum("tfreq")).scalar()
    # K rows: the single-partition window is bounded by the topic count.
    order = Window.orderBy(F.desc(F.round(F.col("tfreq") / total, 12)), "topic")
    return tf.select("topic", "tfreq", (F.col("tfreq") / total).alias("proportion")) \
        .withColumn("new_topic", F.row_number().over(order))


def topic_stats(topic_term: DataFrame, doc_topic: DataFrame, lengths: DataFrame) -> TopicStats:
    """M7, M8, M9 in one plan."""
    # Model-sized tables (K, K x V, V rows) are materialised once: every
    # summary below reads them several times.
    topics = cut_lineage(topic_proportions(doc_topic, lengths))
    k = topics.count()
    # K rows (K counted above): broadcast only under the checked bound
    ttf = topic_term.join(bounded_broadcast(topics.select("topic", "tfreq", "proportion"),
                                            known_rows=k), "topic") \
        .select("topic", "term", F.col("p").alias("phi"),
                (F.col("p") * F.col("tfreq")).alias("ttf"), "proportion")
    ttf = cut_lineage(ttf)
    per_term = ttf.groupBy("term").agg(F.sum("ttf").alias("tot"), F.sum("phi").alias("phisum"))
    grand = per_term.agg(F.sum("tot")).scalar()
    # distinctiveness: sum_t p(t|w) * ln(p(t|w) / prop[t]) over phi > 0
    kern = ttf.join(per_term.select("term", "phisum"), "term").select(
        "term", (F.col("phi") / F.col("phisum")).alias("ptw"), "proportion")
    dist = kern.groupBy("term").agg(
        F.sum(F.col("ptw") * _ln(F.col("ptw") / F.col("proportion"))).alias("distinctiveness"))
    terms = per_term.join(dist, "term").select(
        "term", "tot", (F.col("tot") / grand).alias("pw"), "distinctiveness",
        (F.col("tot") / grand * F.col("distinctiveness")).alias("saliency"))
    terms = cut_lineage(terms)
    return TopicStats(topics=topics, ttf=ttf.drop("proportion"), terms=terms, n_topics=k)


def relevance_base(st: TopicStats) -> DataFrame:
    """``(topic, term, phi, ttf, tot, logprob, loglift)``."""
    return st.ttf.join(st.terms.select("term", "tot", "pw"), "term").select(
        "topic", "term", "phi", "ttf", "tot",
        _ln(F.col("phi")).alias("logprob"),
        _ln(F.col("phi") / F.col("pw")).alias("loglift"))


def relevance(base: DataFrame, lam: float | Column) -> Column:
    """``lam*logprob + (1-lam)*loglift``."""
    lam_c = F.lit(lam) if not isinstance(lam, Column) else lam
    return lam_c * F.col("logprob") + (F.lit(1.0) - lam_c) * F.col("loglift")


def top_terms(topic_term: DataFrame, n: int = 10) -> DataFrame:
    """Top-n terms per topic by weight (ties by term)."""
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("p", 12)), "term")
    return topic_term.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def salient_terms(st: TopicStats, r: int = SUMMARY_TERMS) -> DataFrame:
    """T4: top-r terms by saliency (ties by term); a top-k report."""
    return st.terms.orderBy(F.desc(F.round("saliency", 12)), "term").limit(r)


# Twice the ranking key's rounding: lines closer than this may change places in it.
RANK_SLACK = 2e-9


def rank_key(x: Column, decimals: int = 9) -> Column:
    """Integer ranking key ``floor(x * 10^d + 0.5)``: values closer than
    10^-d compare equal (and fall back to the term tie-break).  Plain IEEE
    arithmetic, so every engine computes the same key, and it stays inside
    codegen (unlike decimal rounding)."""
    return F.floor(x * F.lit(float(10 ** decimals)) + F.lit(0.5))


def level_walk(a: np.ndarray, b: np.ndarray, r: int) -> list[tuple[float, np.ndarray]]:
    """The top-r level of the lines ``b + lam * (a - b)`` for lam from 0 to 1.

    Returns (lam, members from there on), one entry per crossing, the first at 0.  Lines
    come in the order that decides ties.  At a crossing an outside line with a larger
    slope meets the lowest member; there are few crossings, and each is found by one
    pass over members x lines."""
    slope = a - b
    order = np.lexsort((np.arange(len(a)), -slope, -b))
    members, lam = np.sort(order[:r]), 0.0
    walk = [(0.0, members)]
    outside = np.ones(len(a), dtype=bool)
    outside[members] = False
    while outside.any():
        rest = np.flatnonzero(outside)
        steeper = slope[rest][None, :] - slope[members][:, None]
        gap = b[members][:, None] - b[rest][None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where(steeper > 0, np.maximum(gap / steeper, lam), np.inf)
        first = at.min()
        if not first <= 1.0:
            break
        # of the pairs that meet first: the steepest outside line comes in (of equals the
        # earlier), the flattest member goes (of equals the later)
        m, o = np.nonzero(at == first)
        pick = np.lexsort((-members[m], slope[members[m]], rest[o], -slope[rest[o]]))[0]
        goes, comes = members[m[pick]], rest[o[pick]]
        outside[goes], outside[comes] = True, False
        members = np.sort(np.append(members[members != goes], comes))
        lam = float(first)
        walk.append((lam, members))
    return walk


def reaching(a: np.ndarray, b: np.ndarray, r: int, slack: float = RANK_SLACK) -> np.ndarray:
    """Which lines come within ``slack`` of the top-r level for some lam in [0, 1].

    Between two crossings the lowest member is concave in lam, so a line's distance
    to it is largest at an end of the interval."""
    if len(a) <= r:
        return np.ones(len(a), dtype=bool)
    walk = level_walk(a, b, r)
    keep = np.zeros(len(a), dtype=bool)
    for (lo, members), hi in zip(walk, [lam for lam, _ in walk[1:]] + [1.0], strict=True):
        for lam in (lo, hi):
            y = b + lam * (a - b)
            keep |= y + slack >= y[members].min()
    return keep


_LINES = ["topic", "term", "phi", "ttf", "tot", "logprob", "loglift"]


def on_grid(a: np.ndarray, b: np.ndarray, r: int, steps: int) -> np.ndarray:
    """Which lines are in the top r at some lam = i/steps by :func:`rank_key`; lines come in
    the order that decides ties."""
    near = np.flatnonzero(reaching(a, b, r))
    keep = np.zeros(len(a), dtype=bool)
    x, y = a[near], b[near]
    for i in range(steps + 1):
        lam = i / steps
        key = np.floor((lam * x + (1 - lam) * y) * 1e9 + 0.5)
        if len(key) <= r:
            keep[near] = True
            break
        least = np.partition(key, len(key) - r)[len(key) - r]
        above = np.flatnonzero(key > least)
        keep[near[above]] = True
        keep[near[np.flatnonzero(key == least)[:r - len(above)]]] = True
    return keep


def on_level(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """Which lines are in the top r for some lam in [0, 1].  Values that differ only by the
    order of float sums are one line."""
    keep = np.zeros(len(a), dtype=bool)
    for _, members in level_walk(np.round(a, 10), np.round(b, 10), r):
        keep[members] = True
    return keep


def _pruned(choose):
    """Rows of a task -> those that ``choose`` keeps per topic, while the batches go by: a
    row in the whole's top r is in its part's top r."""
    def run(batches):
        held: dict = {}
        for batch in batches:
            topics = batch["topic"].to_numpy()
            for t in np.unique(topics):
                rows = pa.Table.from_batches([batch.filter(pa.array(topics == t))])
                rows = pa.concat_tables([held[t], rows]) if t in held else rows
                rows = rows.take(pc.sort_indices(rows, [("term", "ascending")]))
                held[t] = rows.filter(pa.array(choose(rows["logprob"].to_numpy(), rows["loglift"].to_numpy())))
        for rows in held.values():
            yield from rows.to_batches()
    return run


def _by_topic(batches):
    """Sorted rows -> one table per topic (what the pruning left of it)."""
    held = []
    for batch in batches:
        topics = batch["topic"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(topics[1:] != topics[:-1]) + 1, [len(topics)]]) if len(topics) else []
        for lo, hi in zip(edges, edges[1:]):
            part = batch.slice(lo, hi - lo)
            if held and held[0]["topic"][0] != part["topic"][0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _chosen(choose):
    def run(batches):
        for rows in _by_topic(batches):
            keep = choose(rows["logprob"].to_numpy(), rows["loglift"].to_numpy())
            yield from rows.filter(pa.array(keep)).to_batches()
    return run


def _level_intervals(r: int):
    def run(batches):
        for rows in _by_topic(batches):
            a, b = (np.round(rows[c].to_numpy(), 10) for c in ("logprob", "loglift"))
            since: dict = {}
            out = []
            walk = level_walk(a, b, r)
            for lam, members in [*walk, (1.0, np.zeros(0, dtype=np.int64))]:
                now = set(members.tolist())
                out += [(i, since.pop(i), lam) for i in list(since) if i not in now]
                since |= {i: lam for i in now if i not in since}
            i = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "topic": rows["topic"].combine_chunks().take(i), "term": rows["term"].combine_chunks().take(i),
                "lam_from": pa.array([x[1] for x in out], pa.float64()), "lam_to": pa.array([x[2] for x in out], pa.float64())})
    return run


def _candidates(base: DataFrame, choose) -> DataFrame:
    """What can be in a topic's top r, a few times r rows per topic and task, by topic and term."""
    ship_package(base.sparkSession)
    lines = base.select(*_LINES)
    return lines.mapInArrow(_pruned(choose), lines.schema).repartition("topic").sortWithinPartitions("topic", "term")


def relevant_terms(base: DataFrame, r: int = SUMMARY_TERMS, steps: int = RELEVANCE_STEPS) -> DataFrame:
    """T5: per topic the distinct union over lam = i/steps (i = 0..steps)
    of the top-r terms by relevance (ranked by :func:`rank_key`, ties by
    term).

    Relevance is a line in lam.  Each task walks the top-r level of its own lines
    (:func:`level_walk`), ranks on the grid what comes within the ranking key's
    rounding of it, and passes on only that; the few lines that are left of a topic
    are ranked together."""
    choose = partial(on_grid, r=r, steps=steps)
    few = _candidates(base, choose)
    return few.mapInArrow(_chosen(choose), few.schema)


def relevance_levels(base: DataFrame, r: int = SUMMARY_TERMS) -> DataFrame:
    """T5 for every lam in [0, 1]: ``(topic, term, lam_from, lam_to)``, the intervals in
    which a term is among its topic's r most relevant; their ends are the crossing
    points of the top-r level, at which the lines that meet are equal.  Equal lines
    rank by term."""
    few = _candidates(base, partial(on_level, r=r))
    kinds = {f.name: f.dataType.simpleString() for f in few.schema.fields}
    return few.mapInArrow(_level_intervals(r), f"topic {kinds['topic']}, term {kinds['term']}, lam_from double, lam_to double")


def relevant_terms_direct(base: DataFrame, r: int = SUMMARY_TERMS, steps: int = RELEVANCE_STEPS) -> DataFrame:
    """T5 by ranking the whole grid; for checks of :func:`relevant_terms`."""
    lam = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)]))
    grown = base.select("topic", "term", "logprob", "loglift", lam.alias("lam"))
    rank = Window.partitionBy("topic", "lam").orderBy(F.desc(rank_key(relevance(grown, F.col("lam")))), "term")
    return grown.withColumn("_rk", F.row_number().over(rank)).where(F.col("_rk") <= r).select("topic", "term").distinct()


def topic_info(st: TopicStats, r: int = SUMMARY_TERMS, steps: int = RELEVANCE_STEPS) -> DataFrame:
    """``Default`` rows (top-r by saliency) and ``Topic<n>`` rows (T5).

    Columns: category, term, freq, total, logprob, loglift."""
    sal = salient_terms(st, r)
    rk = Window.orderBy(F.desc(F.round("saliency", 12)), "term")
    default = sal.withColumn("_rk", F.row_number().over(rk)).select(
        F.lit("Default").alias("category"), "term",
        F.floor("tot").cast("double").alias("freq"), F.floor("tot").cast("double").alias("total"),
        (F.lit(r + 1) - F.col("_rk")).cast("double").alias("logprob"),
        (F.lit(r + 1) - F.col("_rk")).cast("double").alias("loglift"))
    base = relevance_base(st)
    rel = relevant_terms(base, r, steps).join(
        bounded_broadcast(st.topics.select("topic", "new_topic"), known_rows=st.n_topics), "topic")
    per_topic = rel.select(
        F.concat(F.lit("Topic"), F.col("new_topic").cast("string")).alias("category"), "term",
        F.col("ttf").alias("freq"), F.col("tot").alias("total"),
        F.round("logprob", 4).alias("logprob"), F.round("loglift", 4).alias("loglift"))
    return default.unionByName(per_topic)


def token_table(st: TopicStats, info: DataFrame) -> DataFrame:
    """For the terms shown in ``info``: per topic with ttf >= 0.5,
    ``freq = round_half_even(ttf) / tot``; columns term, topic, freq."""
    shown = info.select("term").distinct()
    t = st.ttf.join(shown, "term", "left_semi").where(F.col("ttf") >= 0.5) \
        .join(bounded_broadcast(st.topics.select("topic", "new_topic"), known_rows=st.n_topics), "topic") \
        .join(st.terms.select("term", "tot"), "term")
    return t.select("term", F.col("new_topic").alias("topic"),
                    (F.bround("ttf", 0) / F.col("tot")).alias("freq"))


def js_distances(topic_term: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (natural log) for every pair
    ``topic_a < topic_b`` of the topics that have terms.

    Each term's weights become one row; a task adds up the K x K pair sums of
    its terms in numpy, one topic against all later ones at a time, and sends
    one row per pair to the final sum.  K is the model's topic count.
    """
    ids = sorted(r["topic"] for r in topic_term.select("topic").distinct().collect())  # K rows
    place = {t: i for i, t in enumerate(ids)}
    wide = topic_term.groupBy("term").agg(F.collect_list("topic").alias("t"), F.collect_list("p").alias("p"))

    def pair_sums(batches):
        k = len(ids)
        total = np.zeros((k, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sizes = pc.list_value_length(part["t"]).to_numpy()
                dense = np.zeros((part.num_rows, k))
                columns = [place[t] for t in part["t"].flatten().to_pylist()]
                dense[np.repeat(np.arange(part.num_rows), sizes), columns] = part["p"].flatten().to_numpy()
                for a in range(k - 1):
                    p, q = dense[:, a, None], dense[:, a + 1:]
                    m = (p + q) / 2
                    with np.errstate(divide="ignore", invalid="ignore"):
                        half = np.where(p > 0, p * np.log(p / m), 0) + np.where(q > 0, q * np.log(q / m), 0)
                    total[a, a + 1:] += 0.5 * half.sum(axis=0)
        a, b = np.triu_indices(k, 1)
        topics = np.array(ids, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(topics[a].astype(np.int32)), pa.array(topics[b].astype(np.int32)),
                                          pa.array(total[a, b])], names=["topic_a", "topic_b", "c"])

    return wide.select("t", "p").mapInArrow(pair_sums, "topic_a int, topic_b int, c double") \
        .groupBy("topic_a", "topic_b").agg(F.sum("c").alias("js"))


def topic_coordinates(js: DataFrame, topics: DataFrame) -> DataFrame:
    """Classical scaling of the K x K JS matrix to two dimensions.

    Only the K x K matrix (K = topic count) reaches the driver; the
    eigen-decomposition of that small matrix is plain numpy.
    Columns: topic (1..K order), x, y, cluster, freq (= 100 * proportion)."""
    spark = js.sparkSession
    t = topics.select("topic", "new_topic", "proportion").orderBy("topic").collect()
    k = len(t)
    idx = {r["topic"]: i for i, r in enumerate(t)}
    d = np.zeros((k, k))
    for r in js.collect():  # K(K-1)/2 rows
        if r["topic_a"] in idx and r["topic_b"] in idx:
            a, b = idx[r["topic_a"]], idx[r["topic_b"]]
            d[a, b] = d[b, a] = r["js"]
    h = np.eye(k) - np.ones((k, k)) / k
    bmat = -h.dot(d ** 2).dot(h) / 2
    vals, vecs = np.linalg.eigh(bmat)
    order = np.argsort(vals)[::-1][:2]
    vals, vecs = vals[order], vecs[:, order]
    vals[np.isclose(vals, 0)] = 0
    vals = np.clip(vals, 0, None)
    for j in range(vecs.shape[1]):   # deterministic sign
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    xy = vecs * np.sqrt(vals)
    rows = [(int(r["new_topic"]), float(xy[i, 0]), float(xy[i, 1]) if xy.shape[1] > 1 else 0.0,
             1, float(r["proportion"]) * 100) for i, r in enumerate(t)]
    return spark.createDataFrame(rows, "topic int, x double, y double, cluster int, freq double")


def format_topics(topic_term: DataFrame, n: int = 10) -> DataFrame:
    """K6: per topic ``0.123*"term" + ...`` for its top-n terms."""
    top = top_terms(topic_term, n)
    g = top.groupBy("topic").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.format_number("p", 3).alias("w"), "term"))).alias("_t"))
    return g.select("topic", F.array_join(F.transform(
        "_t", lambda x: F.concat(x["w"], F.lit('*"'), x["term"], F.lit('"'))), " + ").alias("topic_str"))


def labelled_model(bow_terms: DataFrame, docs: DataFrame, label_col: str):
    """Deterministic 'topic model' from labels (topic = label): phi from
    term counts per label, theta = 1 for the document's own label.

    ``bow_terms`` = (doc_id, term, tf). Returns (topic_term, doc_topic,
    labels) where labels = (label, topic)."""
    distinct = docs.select(label_col).distinct()
    n_labels = distinct.count()
    labels = dense_ids(distinct, [label_col], "topic", num_partitions=1)
    dl = docs.select("doc_id", label_col).join(bounded_broadcast(labels, known_rows=n_labels), label_col)
    counts = bow_terms.join(dl.select("doc_id", "topic"), "doc_id") \
        .groupBy("topic", "term").agg(F.sum("tf").alias("n"))
    totals = counts.groupBy("topic").agg(F.sum("n").alias("_tot"))
    phi = counts.join(bounded_broadcast(totals, known_rows=n_labels), "topic").select(
        "topic", "term", (F.col("n") / F.col("_tot")).alias("p"))
    theta = dl.select("doc_id", "topic", F.lit(1.0).alias("p"))
    return phi, theta, labels
