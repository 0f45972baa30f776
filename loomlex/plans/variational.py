"""Topic models as joins: M2/M5 with the topic-term matrix as a table, and M3/M4/F15
for any topic-term table.

The matrix is a table with a row per term, partitioned like any other: a pass sends
each block of documents the rows of its own terms, solves the documents, and sums
what they give back by term.  No task and not the driver holds terms x topics; the
driver sees one number per topic and pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.functions.constants import DEFAULT_TOPICS
from loomlex.operators.joins import bounded_broadcast, join_bounded
from loomlex.plans.blocks import lay_out, pass_over
from loomlex.plans.lsi import gaussians
from loomlex.session import ship_package, stage_table

# Entries solved together: documents are gathered up to this many; of a block, up to SOLVE_ROWS.
CHUNK_ROWS = 50_000
SOLVE_ROWS = 250_000


def _shifted(x: np.ndarray, up: int = 8):
    """x moved up to at least ``up`` and the steps it took: for asymptotic series."""
    x = np.array(x, dtype=np.float64)
    passed = []
    while (low := x < up).any():
        passed.append((low, x.copy()))
        x[low] += 1
    return x, passed


def _digamma_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, c) with digamma(x) = log(y) - c, for x > 0: the asymptotic series at y = x + 8, and the
    8 reciprocals up to there as one fraction in x (x + 7)."""
    p = x + 7
    p *= x
    q = p + 10
    a, b = p * (p + 6), q * (q + 2)
    c = (2 * p + 6) * b
    c += (2 * p + 22) * a
    a *= b
    c /= a
    c *= 2 * x + 7
    y = x + 8
    r = 1 / (y * y)
    c += 0.5 / y
    c += r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return y, c


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma, for x > 0."""
    y, c = _digamma_parts(np.asarray(x, dtype=np.float64))
    return np.log(y) - c


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)), without the logarithm."""
    y, c = _digamma_parts(x)
    y *= np.exp(np.negative(c, out=c), out=c)
    return y


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma, for x > 0."""
    y, passed = _shifted(x)
    r = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    for low, at in passed:
        out[low] -= np.log(at[low])
    return out


def expected_log(x: np.ndarray) -> np.ndarray:
    """Of Dirichlet rows."""
    return digamma(x) - digamma(x.sum(axis=1))[:, None]


def solve(doc: np.ndarray, n_docs: int, weight: np.ndarray, terms: np.ndarray, alpha: float, variational: bool,
          tolerance: float | None, max_steps: int) -> np.ndarray:
    """Topic weights (n_docs, k) of documents whose entries are sorted by ``doc``.

    ``terms`` (entries, k) holds each entry's row of the topic-term matrix.
    Variational: Dirichlet parameters gamma = alpha + sum of the responsibilities.
    Otherwise: the proportions of smoothed EM.  A document stops when its mean
    change is at most ``tolerance`` (None: never), on its own, so that its result does
    not depend on the documents it is solved with."""
    k = terms.shape[1]
    out = np.full((n_docs, k), 1.0 if variational else 1.0 / k)
    live = np.unique(doc)
    place = np.searchsorted(live, doc)
    for _ in range(max_steps):
        if not len(live):
            break
        starts = np.searchsorted(place, np.arange(len(live)))
        t = np.exp(expected_log(out[live])) if variational else out[live]
        norm = (t[place] * terms).sum(axis=1)
        ratio = np.divide(weight, norm, out=np.zeros_like(norm), where=norm > 0)
        new = alpha + t * np.add.reduceat(ratio[:, None] * terms, starts, axis=0)
        if not variational:
            new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - out[live]).mean(axis=1)
        out[live] = new
        if tolerance is None:
            continue
        on = moved > tolerance
        if not on.all():
            rows = on[place]
            live, doc, weight, terms = live[on], doc[rows], weight[rows], terms[rows]
            place = np.searchsorted(live, doc)
    return out


def solve_alike(doc: np.ndarray, n_docs: int, weight: np.ndarray, terms: np.ndarray, alpha: float, tolerance: float,
                max_steps: int) -> np.ndarray:
    """``solve``, variational, for many documents at a time: a few of about one length take their
    steps together, in one matrix product each, until they are done."""
    out = np.ones((n_docs, terms.shape[1]))
    live, first, size = np.unique(doc, return_index=True, return_counts=True)
    by_size = np.argsort(size, kind="stable")
    live, first, size = live[by_size], first[by_size], size[by_size]
    steps, done = FIRST_STEPS, 0
    while len(live) and done < max_steps:  # those that are not done after some steps are grouped anew
        steps = min(steps, max_steps - done)
        on, lo = np.zeros(len(live), dtype=bool), 0
        while lo < len(live):
            # documents of about one length, filled up with entries of weight 0: a product per document
            hi = int(np.searchsorted(size, size[lo] * FILL + 1, side="right"))
            hi = min(hi, lo + max(1, GROUP_ROWS // int(size[hi - 1])))
            place = np.arange(size[hi - 1])
            there = place < size[lo:hi, None]
            at = np.where(there, first[lo:hi, None] + place, first[lo:hi, None])
            rows = np.ascontiguousarray(terms[at].transpose(0, 2, 1))
            out[live[lo:hi]], on[lo:hi] = _solve_group(np.where(there, weight[at], 0.0), rows, out[live[lo:hi]],
                                                       alpha, tolerance, steps)
            lo = hi
        live, first, size = live[on], first[on], size[on]
        steps, done = 2 * steps, done + steps
    return out


def _solve_group(weight: np.ndarray, terms: np.ndarray, out: np.ndarray, alpha: float, tolerance: float,
                 steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of as many entries each (``terms``: documents, k, entries), ``steps`` further from their weights ``out`` (documents, k):
    their weights, and which are not done."""
    old, left = out, np.arange(len(weight))
    on = np.ones(len(weight), dtype=bool)
    for _ in range(steps):
        t = exp_digamma(old)  # a document's total would cancel in what follows
        norm = np.matmul(t[:, None, :], terms)[:, 0]
        norm += 1e-100
        new = np.matmul(terms, np.divide(weight, norm, out=norm)[:, :, None])[:, :, 0]
        new *= t
        new += alpha
        moved = np.abs(new - old).mean(axis=1)
        out[left[on]] = new[on]
        old = new
        on &= moved > tolerance
        n = np.count_nonzero(on)
        if not n:
            break
        if n < 0.8 * len(on):  # those that are done leave
            weight, terms, left, old = weight[on], terms[on], left[on], old[on]
            on = np.ones(n, dtype=bool)
    still = np.zeros(len(out), dtype=bool)
    still[left[on]] = True
    return out, still


# Documents of at most this ratio of lengths are solved side by side, of about this many
# entries in all, for this many steps before those that are left are grouped anew.
FILL = 1.3
GROUP_ROWS = 16_000
FIRST_STEPS = 40


def _whole_documents(batches, columns: list[str], chunk: int = CHUNK_ROWS):
    """Sorted entries -> (document per entry, first entry per document, other columns) of
    whole documents, about ``chunk`` entries or one long document at a time."""
    def emit(held):
        doc = pa.concat_arrays([b["doc_id"] for b in held])
        ids = doc.dictionary_encode() if not pa.types.is_integer(doc.type) else None
        number = ids.indices.to_numpy() if ids is not None else doc.to_numpy()
        new = np.concatenate([[True], number[1:] != number[:-1]])
        arrays = {c: np.concatenate([b[c].to_numpy() for b in held]) for c in columns}
        return doc, np.cumsum(new) - 1, np.flatnonzero(new), arrays

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < chunk or held[0]["doc_id"][0] == batch["doc_id"][-1]:
            continue
        last = batch["doc_id"][-1]
        cut = batch.num_rows
        while cut and batch["doc_id"][cut - 1] == last:
            cut -= 1
        if not cut and any(b["doc_id"][-1] == last for b in held[:-1]):
            continue  # the last document began in an earlier batch: wait for its end
        if cut:
            yield emit([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            yield emit(held[:-1])
            held = [batch]
        rows = held[0].num_rows
    if held:
        yield emit(held)


def _topics(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(k)]


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy() for c in names])


# ------------------------------------------------------------ fold-in

def _fold_batches(k: int, alpha: float, variational: bool, tolerance: float | None, max_steps: int):
    def run(batches):
        for doc, number, first, got in _whole_documents(batches, ["weight", *_topics("e", k)]):
            terms = np.column_stack([got[c] for c in _topics("e", k)])
            theta = solve(number, len(first), got["weight"], terms, alpha, variational, tolerance, max_steps)
            theta /= theta.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_pydict({"doc_id": doc.take(pa.array(first))} | dict(zip(_topics("t", k), theta.T.copy())))
    return run


def fold_in(bow: DataFrame, topic_terms: DataFrame, key: str = "term", value_col: str = "tf",
            all_docs: DataFrame | None = None, alpha: float | None = None, method: str = "variational",
            tolerance: float | None = 1e-6, max_steps: int = 200, min_p: float | None = None) -> DataFrame:
    """M3 (``value_col`` = counts) and M4 (weights) for any topic-term table: ``(doc_id, topic, p)``.

    ``topic_terms`` is (topic, ``key``, p), a missing pair has p = 0; entries of terms
    that no topic has are left out.  ``method`` is "variational" (Dirichlet with
    ``alpha``, 1/k by default) or "em" (proportions smoothed by ``alpha``); each document
    is solved until its mean change is at most ``tolerance`` or for ``max_steps`` steps
    (exactly that many if ``tolerance`` is None).  Documents of ``all_docs`` without a
    known term have 1/k per topic.  ``min_p`` drops smaller rows (F15)."""
    if method not in ("variational", "em"):
        raise ValueError(f"method is 'variational' or 'em', not {method!r}")
    ship_package(bow.sparkSession)
    names = sorted(r.topic for r in topic_terms.select("topic").distinct().collect())  # k rows
    k = len(names)
    wide = topic_terms.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.col("topic") == F.lit(t), F.col("p"))), F.lit(0.0)).cast("double").alias(c)
        for t, c in zip(names, _topics("e", k))])
    wide = stage_table(wide, "topic-terms")
    entries = bow.select("doc_id", key, F.col(value_col).cast("double").alias("weight")).where("doc_id IS NOT NULL")
    joined = join_bounded(entries, wide, key)
    kind = bow.schema["doc_id"].dataType.simpleString()
    solved = joined.repartition("doc_id").sortWithinPartitions("doc_id", key).mapInArrow(
        _fold_batches(k, 1.0 / k if alpha is None else alpha, method == "variational", tolerance, max_steps),
        f"doc_id {kind}" + "".join(f", {c} double" for c in _topics("t", k)))
    if all_docs is not None:
        solved = all_docs.select("doc_id").join(solved, "doc_id", "left").fillna(1.0 / k, _topics("t", k))
    pairs = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(c).alias("p")) for t, c in zip(names, _topics("t", k))])
    out = solved.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.topic", "x.p")
    return out if min_p is None else out.where(F.col("p") >= min_p)


# ------------------------------------------------------------ fitting

@dataclass
class BlockModel:
    """``table``: (token_id, n, l0 .. l(k-1)), Dirichlet parameters of every topic by term;
    ``bounds``: the variational bound before each pass and after the last; ``tolerance`` and
    ``max_steps`` of the fold-in."""

    table: DataFrame
    k: int
    alpha: float
    eta: float
    bounds: list[float]
    tolerance: float = 1e-6
    max_steps: int = 200

    def topic_terms(self, dictionary: DataFrame) -> DataFrame:
        """M5: ``(topic, term, p)``, each topic's weights summing to 1."""
        totals = _totals(self.table, self.k)
        pairs = F.array(*[F.struct(F.lit(j).alias("topic"), (F.col(c) / F.lit(float(t))).alias("p"))
                          for j, (c, t) in enumerate(zip(_topics("l", self.k), totals))])
        rows = self.table.select("token_id", F.explode(pairs).alias("x")).select("token_id", "x.topic", "x.p")
        return join_bounded(rows, dictionary.select("token_id", "term"), "token_id").select("topic", "term", "p")

    def doc_topics(self, bow: DataFrame, value_col: str = "tf", all_docs: DataFrame | None = None,
                   min_p: float | None = None) -> DataFrame:
        """M3 / M4 on this model: fold-in with the expected logs of its topics."""
        beta = _beta(self.table, _totals(self.table, self.k), self.k)
        pairs = F.array(*[F.struct(F.lit(j).alias("topic"), F.col(c).alias("p")) for j, c in enumerate(_topics("e", self.k))])
        topics = beta.select("token_id", F.explode(pairs).alias("x")).select("token_id", "x.topic", "x.p")
        return fold_in(bow, topics, "token_id", value_col, all_docs, self.alpha,
                       tolerance=self.tolerance, max_steps=self.max_steps, min_p=min_p)


def _totals(table: DataFrame, k: int) -> np.ndarray:
    return np.array(table.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in _topics("l", k)]).first(), dtype=np.float64)


def _beta_batches(k: int, totals: np.ndarray):
    def run(batches):
        for batch in batches:
            with np.errstate(divide="ignore"):  # a parameter of 0 has the weight 0
                e = np.exp(digamma(_columns(batch, _topics("l", k))) - digamma(totals))
            yield pa.RecordBatch.from_pydict({"token_id": batch["token_id"], "n": batch["n"]} | dict(zip(_topics("e", k), e.T.copy())))
    return run


def _beta(table: DataFrame, totals: np.ndarray, k: int) -> DataFrame:
    """exp of the expected log of every topic's weight of a term."""
    return table.mapInArrow(_beta_batches(k, totals), "token_id long, n long" + "".join(f", {c} double" for c in _topics("e", k)))


def _topic_bound(k: int, totals: np.ndarray, eta: float):
    """The bound's part of a block of terms, without the terms of the totals."""
    def run(batches):
        bound = 0.0
        for batch in batches:
            lam = _columns(batch, _topics("l", k))
            bound += float(((eta - lam) * (digamma(lam) - digamma(totals)) + log_gamma(lam)).sum()
                           - lam.size * log_gamma(np.array([eta]))[0])
        yield pa.RecordBatch.from_pydict({"bound": pa.array([bound])})
    return run


def _pass_step(k: int, alpha: float, tolerance: float, max_steps: int):
    """A block -> what its documents add to each term's parameters; their bound as term -1."""
    def run(_, block, rows, __):
        sums, bound = np.zeros((len(block.tokens), k)), 0.0
        ends = np.concatenate([block.first[1:], [len(block.local)]])
        lo = 0
        while lo < len(ends):  # whole documents, SOLVE_ROWS entries at a time or a long one
            hi = max(lo + 1, int(np.searchsorted(ends, block.first[lo] + SOLVE_ROWS, side="right")))
            part = slice(block.first[lo], ends[hi - 1])
            number = np.repeat(np.arange(hi - lo), ends[lo:hi] - block.first[lo:hi])
            local, weight = block.local[part], block.weight[part]
            terms = rows[local]
            gamma = solve_alike(number, hi - lo, weight, terms, alpha, tolerance, max_steps)
            logs = expected_log(gamma)
            share = np.exp(logs)[number]
            share *= terms
            norm = share.sum(axis=1)
            share *= (weight / norm)[:, None]
            for j in range(k):
                sums[:, j] += np.bincount(local, weights=share[:, j], minlength=len(sums))
            bound += float((weight * np.log(norm)).sum() + ((alpha - gamma) * logs + log_gamma(gamma)).sum()
                           - log_gamma(gamma.sum(axis=1)).sum()
                           + (hi - lo) * (log_gamma(np.array([k * alpha]))[0] - k * log_gamma(np.array([alpha]))[0]))
            lo = hi
        sums = np.vstack([sums, [[bound] + [0.0] * (k - 1)]])
        return pa.RecordBatch.from_pydict({"token_id": np.concatenate([block.tokens, [-1]])}
                                          | dict(zip(_topics("s", k), sums.T.copy())))
    return run


def _start_batches(k: int, seed: int):
    """Parameters near 1 (mean 1, standard deviation 0.1), from the term's id alone."""
    def run(batches):
        for batch in batches:
            lam = np.maximum(1 + 0.1 * gaussians(batch["token_id"].to_numpy(), k, seed), 0.1)
            yield pa.RecordBatch.from_pydict({"token_id": batch["token_id"], "n": batch["n"]} | dict(zip(_topics("l", k), lam.T.copy())))
    return run


def fit_blocks(bow: DataFrame, k: int = DEFAULT_TOPICS, passes: int = 20, seed: int = 1, alpha: float | None = None,
               eta: float | None = None, value_col: str = "tf", rate=lambda i: 1.0, tolerance: float = 1e-5,
               max_steps: int = 200) -> BlockModel:
    """M2 on ``bow`` (doc_id, token_id, tf): variational Bayes over all documents in every pass.

    ``rate(i)`` is the weight of pass i's parameters against the ones before: 1 is
    batch learning, whose bound rises with every pass; ``lambda i: (1 + i) ** -0.5`` is the
    online schedule.  The result is the same for any number of partitions up to the order
    of float sums."""
    spark = bow.sparkSession
    ship_package(spark)
    alpha, eta = (1.0 / k if x is None else x for x in (alpha, eta))
    entries = stage_table(bow.select("doc_id", F.col("token_id").cast("long").alias("token_id"),
                                     F.col(value_col).cast("double").alias("weight")), "lda-entries")
    kinds = "token_id long, n long" + "".join(f", {c} double" for c in _topics("l", k))
    blocks = lay_out(entries, "lda")
    table = stage_table(blocks.needs.select("token_id", "n").mapInArrow(_start_batches(k, seed), kinds), "lda-topics")
    vocab = table.count()
    bounds = []
    for i in range(passes + 1):
        totals = _totals(table, k)
        beta = _beta(table, totals, k)
        gave = pass_over(blocks, beta, _topics("e", k), _pass_step(k, alpha, tolerance, max_steps),
                         "token_id long" + "".join(f", {c} double" for c in _topics("s", k)))
        gave = stage_table(gave.groupBy("token_id").agg(*[F.sum(c).alias(c) for c in _topics("s", k)]), "lda-sums")
        own = table.mapInArrow(_topic_bound(k, totals, eta), "bound double").agg(F.sum("bound")).first()[0] or 0.0
        docs = gave.where("token_id = -1").agg(F.sum("s0")).first()[0] or 0.0
        bounds.append(float(own + docs + k * log_gamma(np.array([max(vocab, 1) * eta]))[0] - log_gamma(np.maximum(totals, 1e-9)).sum()))
        if i == passes:
            break
        step = float(rate(i))
        mixed = [((1 - step) * F.col(f"l{j}") + step * (eta + F.coalesce(f"s{j}", F.lit(0.0)))).alias(f"l{j}") for j in range(k)]
        table = stage_table(table.join(bounded_broadcast(gave), "token_id", "left").select("token_id", "n", *mixed), "lda-topics")
    return BlockModel(table, k, alpha, eta, bounds)
