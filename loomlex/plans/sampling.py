"""An iteration-controlled topic model by collapsed sampling.

Every occurrence of a term has a topic.  A sweep draws each topic anew from the
document's other occurrences and the term's counts.  Documents are swept side by
side; within a document occurrences are drawn one after the other.  The counts of
terms and topics are tables, taken anew every ``sync_every`` sweeps; in between a
task works with the last ones, less the occurrence's own part.

The random number of a draw is a hash of (seed, sweep, document, occurrence), so the
result does not depend on partitions, batches or retries: it is the same for the same
seed, and it is whole after a lost executor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.functions.constants import DEFAULT_LINE_ITERATIONS, DEFAULT_TOPICS
from loomlex.operators.joins import join_bounded
from loomlex.plans.blocks import _STATE, Block, entry_counts, held_state, notes, pack, pass_sums, stage_messages
from loomlex.plans.variational import _topics, _whole_documents, log_gamma
from loomlex.session import drop_stage, ship_package, stage_table

# FIXED VALUES: prior weight of all topics of a document together, and of a term in a topic.
TOTAL_ALPHA = 50.0
BETA = 0.1

# Occurrences swept together.  A sweep takes as many steps as the longest document has
# occurrences, whatever is swept beside it, so that few large chunks take few steps.
SWEEP_ROWS = 400_000

# Occurrences of a block.
SAMPLED_BLOCK_ROWS = 4_000_000
SAMPLED_LEAST_ROWS = 50_000


def uniforms(mark: np.ndarray, place: np.ndarray, sweep: int, seed: int) -> np.ndarray:
    """In [0, 1): one number per document mark and occurrence, for this sweep and seed."""
    def mix(h):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + sweep * 0xD6E8FEB86659FD93 + 1) & (1 << 64) - 1)
    h = mix(mark.view(np.uint64) ^ start)
    h = mix(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sweep_documents(number: np.ndarray, first: np.ndarray, topic: np.ndarray, terms: np.ndarray, totals: np.ndarray,
                    mark: np.ndarray, place: np.ndarray, sweeps: range, alpha: float, beta: float, vocab: int, seed: int) -> np.ndarray:
    """New topics of documents whose occurrences are sorted by (document, place)."""
    k, n_docs = terms.shape[1], len(first)
    size = np.diff(np.concatenate([first, [len(number)]]))
    # the term's part of a draw, from the counts without the occurrence itself
    own = np.zeros_like(terms)
    own[np.arange(len(topic)), topic] = 1.0
    part = (terms - own + beta) / (totals[None, :] - own + vocab * beta)
    # laid out by step, longest document first: a step works on slices, a row per topic
    longest = np.argsort(-size, kind="stable")
    rank = np.empty(n_docs, dtype=np.int64)
    rank[longest] = np.arange(n_docs)
    row = rank[number]
    lay = np.lexsort((row, np.arange(len(number)) - first[number]))
    active = np.searchsorted(-size[longest], -np.arange(size.max()), side="left")  # documents with more than j occurrences
    edges = np.concatenate([[0], np.cumsum(active)]).tolist()
    counts = np.bincount(topic * n_docs + row, minlength=k * n_docs).astype(np.float64)
    in_doc = counts.reshape(k, n_docs)
    # each step's weights together, as it takes them; its occurrences by their place in the counts
    parts = [np.ascontiguousarray(part[lay[lo:hi]].T) for lo, hi in zip(edges, edges[1:])]
    mark, place, every = mark[lay], place[lay], np.arange(n_docs)
    at = topic[lay] * n_docs + row[lay]
    small = np.uint8 if k < 256 else np.int64
    for sweep in sweeps:
        draw = uniforms(mark, place, sweep, seed)
        for lo, hi, own in zip(edges, edges[1:], parts):
            here = at[lo:hi]
            counts[here] -= 1
            weight = in_doc[:, :hi - lo] + alpha
            weight *= own
            for j in range(1, k):
                weight[j] += weight[j - 1]
            below = weight[:-1] <= draw[lo:hi] * weight[-1]
            here = np.multiply(below.view(np.uint8).sum(axis=0, dtype=small), n_docs, dtype=np.int64)
            here += every[:hi - lo]
            counts[here] += 1
            at[lo:hi] = here
    out = np.empty_like(topic)
    out[lay] = at // n_docs
    return out


def _sweep_batches(k: int, totals: np.ndarray, sweeps: range, alpha: float, beta: float, vocab: int, seed: int):
    """Sweeps over rows sorted by (document, place) that hold their term's counts, without blocks."""
    def run(batches):
        columns = ["token_id", "topic", "mark", "place", *_topics("c", k)]
        for doc, number, first, got in _whole_documents(batches, columns, SWEEP_ROWS):
            terms = np.column_stack([got[c] for c in _topics("c", k)]).astype(np.float64)
            new = sweep_documents(number, first, got["topic"].astype(np.int64), terms, totals, got["mark"], got["place"],
                                  sweeps, alpha, beta, vocab, seed)
            yield pa.RecordBatch.from_pydict({"doc_id": doc, "mark": got["mark"], "place": got["place"],
                                              "token_id": got["token_id"], "topic": new.astype(np.int32)})
    return run


def _sweep_step(k: int, sweeps: range, alpha: float, beta: float, vocab: int, seed: int):
    """A block of occurrences -> its terms' counts, and its topics as its state.  Topics start as the weights."""
    kind = np.uint8 if k <= 256 else np.int32

    def run(block, rows, totals, state):
        topic = block.weight.astype(np.int64) if state is None else np.frombuffer(state, kind).astype(np.int64)
        if len(sweeps):
            sizes = block.ends - block.first
            # a chunk takes the steps of its longest document: those of like length are swept together
            longest = np.argsort(-sizes, kind="stable")
            chunk = (np.cumsum(sizes[longest]) - sizes[longest]) // SWEEP_ROWS
            for docs in np.split(longest, np.flatnonzero(np.diff(chunk)) + 1):
                size = sizes[docs]
                first = np.cumsum(size) - size
                at = np.repeat(block.first[docs] - first, size) + np.arange(size.sum())
                number = np.repeat(np.arange(len(docs)), size)
                topic[at] = sweep_documents(number, first, topic[at], rows[block.local[at]], totals, block.mark[docs][number],
                                            block.place[at], sweeps, alpha, beta, vocab, seed)
        counts = np.bincount(block.local.astype(np.int64) * k + topic, minlength=len(block.tokens) * k)
        return counts.reshape(-1, k).astype(np.float64), topic.astype(kind).tobytes()
    return run


def _assigned_batches(k: int):
    kind = np.uint8 if k <= 256 else np.int32

    def run(batches):
        for batch in batches:
            for data, state, docs in zip(batch["data"], batch["state"], batch["docs"]):
                block, topic = Block.from_bytes(data.as_buffer()), np.frombuffer(held_state(state.as_buffer(), k), kind)
                for lo, hi in block.parts(SWEEP_ROWS):
                    part = slice(block.first[lo], block.ends[hi - 1])
                    number = np.repeat(np.arange(lo, hi), block.ends[lo:hi] - block.first[lo:hi])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": docs.values.take(pa.array(number)), "mark": block.mark[number], "place": block.place[part],
                        "token_id": block.tokens[block.local[part]], "topic": topic[part].astype(np.int32)})
    return run


@dataclass
class SampledModel:
    """``assigned``: (doc_id, mark, place, token_id, topic), a row per occurrence; ``counts``:
    (token_id, n, c0 .. c(k-1)); ``likelihoods``: of terms given topics, after each sync."""

    assigned: DataFrame
    counts: DataFrame
    k: int
    vocab: int
    alpha: float
    beta: float
    likelihoods: list[float]

    def topic_terms(self, dictionary: DataFrame) -> DataFrame:
        """``(topic, term, p)``, smoothed by beta, each topic summing to 1."""
        totals = _totals(self.counts, self.k)
        pairs = F.array(*[F.struct(F.lit(j).alias("topic"), ((F.col(c) + self.beta) / float(t + self.vocab * self.beta)).alias("p"))
                          for j, (c, t) in enumerate(zip(_topics("c", self.k), totals))])
        rows = self.counts.select("token_id", F.explode(pairs).alias("x")).select("token_id", "x.topic", "x.p")
        return join_bounded(rows, dictionary.select("token_id", "term"), "token_id").select("topic", "term", "p")

    def doc_topics(self, all_docs: DataFrame | None = None) -> DataFrame:
        """``(doc_id, topic, p)``, smoothed by alpha; documents without terms have 1/k per topic."""
        per = self.assigned.groupBy("doc_id").agg(*[F.sum((F.col("topic") == j).cast("long")).alias(c)
                                                    for j, c in enumerate(_topics("c", self.k))])
        if all_docs is not None:
            per = all_docs.select("doc_id").join(per, "doc_id", "left").fillna(0, _topics("c", self.k))
        size = sum((F.col(c) for c in _topics("c", self.k)), F.lit(0))
        pairs = F.array(*[F.struct(F.lit(j).alias("topic"), ((F.col(c) + self.alpha) / (size + self.k * self.alpha)).alias("p"))
                          for j, c in enumerate(_topics("c", self.k))])
        return per.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.topic", "x.p")


def _totals(counts: DataFrame, k: int) -> np.ndarray:
    return np.array(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _topics("c", k)]).first(), dtype=np.float64)


def _counted(assigned: DataFrame, k: int) -> DataFrame:
    return stage_table(assigned.groupBy("token_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("topic") == j).cast("long")).alias(c)
                                       for j, c in enumerate(_topics("c", k))]), "sampled-counts")


def _likelihood_note(beta: float):
    """The likelihood's part of some terms' counts."""
    start = float(log_gamma(np.array([beta]))[0])
    return lambda counts: float(log_gamma(counts + beta).sum() - counts.size * start)


def sample_topics(bow: DataFrame, k: int = DEFAULT_TOPICS, iterations: int = DEFAULT_LINE_ITERATIONS, seed: int = 1,
                  alpha: float | None = None, beta: float = BETA, sync_every: int = 10) -> SampledModel:
    """M6 on ``bow`` (doc_id, token_id, tf): ``iterations`` sweeps over all occurrences.

    ``alpha`` is 50 / k by default.  Rows that repeat (doc_id, token_id) are added up; rows
    with a null or a count below 1 are left out.  Occurrences lie in blocks of documents
    (``plans/blocks.py``) from the first sweep to the last; a sync sends a block one row of
    counts per distinct term."""
    ship_package(bow.sparkSession)
    alpha = TOTAL_ALPHA / k if alpha is None else alpha
    clean = bow.where("doc_id IS NOT NULL AND token_id IS NOT NULL AND tf >= 1").groupBy(
        "doc_id", F.col("token_id").cast("long").alias("token_id")).agg(F.sum("tf").cast("long").alias("tf"))
    rows = clean.select("doc_id", F.xxhash64("doc_id").alias("mark"), "token_id",
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("tf"))).alias("nth"))
    # the n-th occurrence of a term has a place of its own; places only order and mark draws
    rows = rows.withColumn("place", F.xxhash64("token_id", "nth")).drop("nth")
    start = F.pmod(F.xxhash64("mark", "place", F.lit(seed)), F.lit(k)).cast("double")
    entries = stage_table(rows.select("doc_id", "token_id", start.alias("weight"), "place"), "sampled-entries")
    packed, count = pack(entries, "sampled", SAMPLED_BLOCK_ROWS, SAMPLED_LEAST_ROWS)
    drop_stage(entries)
    vocab = entry_counts(packed).count()

    def synced(before, sweeps):
        step = _sweep_step(k, sweeps, alpha, beta, vocab, seed)
        return stage_messages(pass_sums(packed, count, before, k, step, private=False, note=_likelihood_note(beta)), "sampled-sums")

    now = synced(None, range(0))
    likelihoods, done = [], 0
    while done < iterations:
        sweeps = range(done, min(done + sync_every, iterations))
        before, now = now, synced(now, sweeps)
        drop_stage(before)
        told = notes(now, k)
        totals = told[0, 1:] if len(told) else np.zeros(k)
        likelihoods.append(float(told[:, 0].sum() + k * log_gamma(np.array([max(vocab, 1) * beta]))[0]
                                 - log_gamma(totals + max(vocab, 1) * beta).sum()))
        done = sweeps.stop
    states = now.where(F.col("kind") == _STATE).select("block", F.col("data").alias("state"))
    kind = bow.schema["doc_id"].dataType.simpleString()
    assigned = stage_table(packed.join(states.hint("merge"), "block").mapInArrow(
        _assigned_batches(k), f"doc_id {kind}, mark long, place long, token_id long, topic int"), "sampled")
    for table in (packed, now):
        drop_stage(table)
    return SampledModel(assigned, _counted(assigned, k), k, vocab, alpha, beta, likelihoods)
