"""Text quality: random-indexing word vectors, pooled, then a small calibrated network.

1. Random indexing over all documents: every word bucket owns a fixed sparse
   ternary index vector; a word's context vector is the sum of the index vectors
   of its neighbours (two on each side) wherever it occurs.  Tasks add up a dense
   table of ``BUCKETS x DIMS`` counts and merge it block by block; the merged table
   (2 MB, fixed by these parameters) is the only corpus statistic that is sent out.
2. A document is the mean and the spread of its words' unit vectors, the mean
   similarity and share of equal neighbours, the share of distinct words and the
   logarithm of their number.
3. A two-layer numpy network learns the label on at most ``max_train`` labelled
   documents (a documented bound, picked by a hash of the id) outside the held-out
   quarter; a temperature fitted on a part it has not seen calibrates it.
4. Every whole text is scored in an Arrow UDF, without a join or a shuffle.

Only the text enters a score.  Defined cases: null text counts as empty and gets
the network's score for an empty pool; labels that are null or lack a document
are not used, and of several labels of one document the smallest counts; with no
usable label every score is 0.5; rows that repeat are scored each; an empty table
gives no rows; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlex.llm.arrays import byte_class, giving_back, joined_bytes, text_chunks, word_hashes
from loomlex.llm.common import partitions, spread

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 32, 4, 2
PART_BYTES = 1 << 18  # of text worked on together: its words' rows take some hundred times that
BLOCK = 256  # word buckets in a block of the merged table
HELD_OUT = 2  # remainder of crc32(doc_id) modulo 4 that is never trained on
THRESHOLD = 0.7

_BLANK = byte_class(b" \t\n\x0b\x0c\r")
_KIND = np.full(256, 2, np.uint8)  # 0 blank, 1 letter or digit, 2 other
_KIND[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = 1
_KIND[_BLANK] = 0


def _index_vectors():
    rng = np.random.default_rng(4409)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


_PLACE, _SIGN = _index_vectors()


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, index of each text's first token): tokens are runs
    of letters and digits or of other signs, case kept."""
    kind = _KIND[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    lead = np.ones(len(kind), dtype=bool)
    lead[1:] = kind[1:] != kind[:-1]
    lead[offs[(offs > 0) & (offs < len(kind))]] = True
    starts = np.flatnonzero(lead)
    ends = np.append(starts[1:], len(kind))
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return (word_hashes(data, starts, ends) >> np.uint64(50)).astype(np.int64), np.searchsorted(starts, offs)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(BUCKETS * DIMS)
    for batch in batches:
        for _, _, offs, data in text_chunks(batch["text"], PART_BYTES):
            bucket, first = tokens(data, offs)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            cell, add = [], []
            for step in range(1, REACH + 1):
                near = np.flatnonzero(doc[step:] == doc[:-step]) if len(doc) > step else np.zeros(0, np.int64)
                for word, other in ((bucket[near], bucket[near + step]), (bucket[near + step], bucket[near])):
                    cell.append((word[:, None] * DIMS + _PLACE[other]).ravel())
                    add.append(_SIGN[other].ravel())
            if cell:
                table += np.bincount(np.concatenate(cell), np.concatenate(add), BUCKETS * DIMS)
    rows = table.astype(np.int64).reshape(-1, BLOCK * DIMS)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)),
                                      pa.array([rows[b].astype(np.int64).tobytes() for b in used], pa.binary())],
                                     names=["block", "sums"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}  # at most BUCKETS / BLOCK blocks of fixed size
    for batch in batches:
        sums = np.frombuffer(joined_bytes(batch["sums"]), np.int64).reshape(-1, BLOCK * DIMS)
        for block, row in zip(batch["block"].to_pylist(), sums, strict=True):
            total[block] = total[block] + row if block in total else row
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                      pa.array([x.tobytes() for x in total.values()], pa.binary())],
                                     names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors, one row per word bucket, from every word of ``docs``."""
    merged = (docs.select("text").mapInArrow(giving_back(_contexts), "block int, sums binary")
              .repartition(min(partitions(docs.sparkSession), BUCKETS // BLOCK), "block")
              .mapInArrow(giving_back(_add_blocks), "block int, sums binary"))
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIMS))
    for r in merged.collect():  # BUCKETS / BLOCK rows: 4 MB whatever the input
        table[r.block] = np.frombuffer(r.sums, np.int64)
    table = table.reshape(BUCKETS, DIMS)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norm, 1e-12)).astype(np.float32)


FEATURES = 2 * DIMS + 4


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``pool`` of all texts, ``PART_BYTES`` or one longer text at a time."""
    out, row = np.zeros((len(offs) - 1, FEATURES), np.float32), 0
    while row < len(out):
        end = int(np.searchsorted(offs, offs[row] + PART_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(out))
        out[row:end] = pool(data[offs[row]:offs[end]], offs[row:end + 1] - offs[row], vectors)
        row = end
    return out


def pool(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its word vectors, mean similarity and share
    of equal neighbours, share of distinct words, log word count; zeros for an
    empty text."""
    bucket, first = tokens(data, offs)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        lead, count = first[some], n[some, None]
        found = vectors[bucket]
        mean = np.add.reduceat(found, lead, axis=0) / count
        square = np.add.reduceat(found * found, lead, axis=0) / count
        out[some, :DIMS] = mean
        out[some, DIMS:2 * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
        inner = np.ones(len(bucket))
        inner[lead] = 0  # a text's first word has no neighbour before it
        pairs = np.maximum(n[some] - 1, 1)
        near = np.zeros(len(bucket))
        near[1:] = np.einsum("ij,ij->i", found[1:], found[:-1])
        same = np.zeros(len(bucket))
        same[1:] = bucket[1:] == bucket[:-1]
        distinct = np.unique(np.repeat(np.arange(len(n)), n) * BUCKETS + bucket) // BUCKETS
        out[some, -4] = np.add.reduceat(near * inner, lead) / pairs
        out[some, -3] = np.add.reduceat(same * inner, lead) / pairs
        out[some, -2] = np.bincount(distinct, minlength=len(n))[some] / n[some]
        out[some, -1] = np.log1p(n[some])
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, calibrated probability of label 1."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-z))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on the logistic loss; every fifth row is kept for the temperature."""
    x = x.astype(np.float64)
    if len(x) == 0 or len(np.unique(y)) == 0:
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0)
    calibrate = np.arange(len(x)) % 5 == 4
    fit_x, fit_y = x[~calibrate], y[~calibrate].astype(np.float64)
    rng = np.random.default_rng(seed)
    net = Network(fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6,
                  rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    scaled, step = (fit_x - net.centre) / net.scale, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(scaled)), max(len(scaled) // 256, 1)):
            a, t = scaled[rows], fit_y[rows]
            pre = a @ params[0] + params[1]
            h = np.maximum(pre, 0)
            z = h @ params[2] + params[3]
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - t) / len(rows)
            dh = np.outer(d, params[2]) * (pre > 0)
            grads = [a.T @ dh + 1e-4 * params[0], dh.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(params[3][0])
    if calibrate.any():
        z, t = net.logit(x[calibrate]), y[calibrate]
        grid = np.exp(np.linspace(-0.7, 3, 101))
        net.temperature = float(grid[np.argmin([_loss(z / g, t) for g in grid])])
    return net


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors over all of ``docs``; the network on a bounded labelled sample."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    share = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 20))
    total = max(known.count(), 1)
    sample = F.broadcast(known.where(share < int((1 << 20) * min(1.0, 0.98 * max_train / total)) + 1))
    handle = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            for lo, hi, offs, data in text_chunks(batch["text"]):
                x = pooled(data, offs, handle.value)
                yield pa.RecordBatch.from_arrays(
                    [batch["quality"][lo:hi], pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])

    picked = docs.join(sample, "doc_id").select("quality", "text")
    rows = picked.mapInArrow(giving_back(features), "quality int, x binary").collect()  # about max_train rows
    rows.sort(key=lambda r: (r.x, r.quality))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, FEATURES)
    y = np.array([r.quality for r in rows])
    mixed = np.random.default_rng(3).permutation(len(y))
    return vectors, train(x[mixed], y[mixed])


def score_column(spark, vectors: np.ndarray, net: Network):
    """A function text column -> score column."""
    handle = spark.sparkContext.broadcast((vectors, net))

    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors, net = handle.value
        for text in texts:
            out = [net.probability(pooled(data, offs, vectors)) for _, _, offs, data in text_chunks(text)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(scores)(texts)

    return score


def report(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    source = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    score = score_column(docs.sparkSession, *fit(source, labels, max_train))
    return (source.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """``docs`` without the rows scored below the threshold; all columns stay."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    score = score_column(docs.sparkSession, *fit(spread(source), labels, max_train))
    return docs.where(score(F.coalesce("text", F.lit(""))) >= THRESHOLD)
