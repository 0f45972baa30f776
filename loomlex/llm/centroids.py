"""Centroid clustering with exact integer distances by bit planes.

A vector of 64 integers is packed plane by plane: bit k of every component goes
into one 64-bit word, the top plane holds the signs (two's complement).  A dot
product is then a weighted sum of popcounts of ANDed planes,

    x . c = sum over planes j, k of w_j * w_k * popcount(X_j & C_k),

with w_k = 2**k, the sign plane negative, and a squared distance is
x . x - 2 x . c + c . c: exact, without an unpacked vector.  A vector takes as
many planes as the widest vector of its Arrow batch; missing upper planes repeat
the sign plane.

A round sends the centroids (at most k x 64 integers) to the tasks; every task
returns one sum per centroid and component, so neither a popular centroid nor a
vector that a third of all rows repeat moves more rows.

Defined cases: vectors that are null, of another length, or with a null, NaN or
infinite component are left out; components of 2**21 and more saturate at
+-2**27 units of 1/64, so that every distance fits a long, and sums beyond a long
saturate there; rows that repeat a vec_id are vectors of their own; a null vec_id
hashes as ``null``; equal hashes are ordered by components; with fewer vectors
than centroids each is one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.llm.common import spread, stage

WIDTH = 64
SCALE = 64
SATURATE = 1 << 27
ROWS = 4096  # rows worked on at a time
LONG_MAX = (1 << 63) - 1


def pack(ints: np.ndarray) -> np.ndarray:
    """(n, 64) integers -> (n, planes) words, lowest plane first, signs last."""
    widest = int(max(ints.max(initial=0), (~ints).max(initial=0)))
    planes = widest.bit_length() + 1
    out = np.empty((len(ints), planes), dtype=np.uint64)
    for k in range(planes):
        bits = ((ints >> k) & 1).astype(np.uint8)
        out[:, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def plane_weights(planes: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def unpacked_sum(words: np.ndarray) -> np.ndarray:
    """Componentwise sums of packed vectors: counts of each plane's bits, weighted."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64).reshape(words.shape[1], WIDTH)
    return plane_weights(words.shape[1]) @ counts


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, planes) and (k, planes) words -> (n, k) exact dot products."""
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for j, wj in enumerate(plane_weights(x.shape[1])):
        for k, wk in enumerate(plane_weights(c.shape[1])):
            out += np.bitwise_count(x[:, j, None] & c[None, :, k]).astype(np.int64) * (wj * wk)
    return out


def own_dots(x: np.ndarray) -> np.ndarray:
    """x . x of every row."""
    out = np.zeros(len(x), dtype=np.int64)
    weights = plane_weights(x.shape[1])
    for j in range(len(weights)):
        for k in range(j + 1):
            both = np.bitwise_count(x[:, j] & x[:, k]).astype(np.int64) * (weights[j] * weights[k])
            out += both if j == k else 2 * both
    return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k)."""
    return own_dots(x)[:, None] - 2 * dots(x, c) + own_dots(c)[None, :]


def _packed_batches(batches):
    for batch in batches:
        whole = pc.equal(pc.fill_null(pc.list_value_length(batch["embedding"]), -1), WIDTH)
        batch = batch.filter(whole)
        if not batch.num_rows:
            continue
        values = batch["embedding"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        finite = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            ints = np.clip(np.floor(values[finite] * SCALE), -SATURATE, SATURATE).astype(np.int64)
        words = pack(ints)
        at = np.arange(len(words) + 1, dtype=np.int32) * np.int32(words.shape[1])
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch["vec_id"].filter(pa.array(finite)),
            "planes": pa.ListArray.from_arrays(pa.array(at), pa.array(words.reshape(-1).view(np.int64)))})


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, planes) of the vectors that are kept."""
    return spread(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).mapInArrow(
        _packed_batches, "vec_id long, planes array<long>")


def _words(column: pa.Array) -> np.ndarray:
    """The planes of a batch as one array; shorter rows repeat their sign plane."""
    offs = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    size = np.diff(offs)
    at = np.minimum(np.arange(size.max())[None, :], size[:, None] - 1) + offs[:-1, None]
    return flat[at]


def _chunks(batches, c):
    """(row ids, words, nearest centroid, its distance) of at most ROWS rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            x = _words(part["planes"])
            far = distances(x, c)
            near = far.argmin(axis=1)  # the first, so the smaller number, on ties
            yield part["vec_id"], x, near, far[np.arange(len(x)), near]


def _sums(c: np.ndarray):
    def run(batches):
        sums, n = np.zeros((len(c), WIDTH), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        for _, x, near, _ in _chunks(batches, c):
            for k in np.unique(near):
                sums[k] += unpacked_sum(x[near == k])
            n += np.bincount(near, minlength=len(c))
        if n.any():
            yield pa.RecordBatch.from_pydict({
                "cluster": np.repeat(np.arange(len(c), dtype=np.int32), WIDTH),
                "component": np.tile(np.arange(WIDTH, dtype=np.int32), len(c)),
                "total": sums.reshape(-1), "n": np.repeat(n, WIDTH)})
    return run


def _assignments(c: np.ndarray):
    def run(batches):
        for ids, _, near, far in _chunks(batches, c):
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": near.astype(np.int32), "distance": far})
    return run


def seeds(points: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest SHA-256, in hash order."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = points.select(mark.alias("mark"), "planes").orderBy("mark", "planes").limit(k).collect()
    return [[int(v) for v in unpacked_sum(np.array([r.planes], dtype=np.int64).view(np.uint64))] for r in first]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    points = stage(packed(vectors), "cluster-planes")
    centroids = seeds(points, k)
    for _ in range(rounds if centroids else 0):
        words = pack(np.array(centroids, dtype=np.int64))
        part = points.mapInArrow(_sums(words), "cluster int, component int, total long, n long")
        # at most k x 64 rows come back
        for r in part.groupBy("cluster", "component").agg(
                F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            if r.n:
                centroids[r.cluster][r.component] = int(r.total) // r.n
    words = pack(np.array(centroids, dtype=np.int64).reshape(-1, WIDTH))
    if not centroids:
        return points.select("vec_id", F.lit(0).alias("cluster"), *[
            F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"))
    near = stage(points.mapInArrow(_assignments(words), "vec_id long, cluster int, distance long"), "cluster-nearest")
    inertia = {r.cluster: int(r.total) for r in near.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    table = [(i, min(inertia.get(i, 0), LONG_MAX), min(sum(inertia.values()), LONG_MAX),
              hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(facts), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3) -> str:
    """DuckDB SQL with plain sums of squares."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT i, any_value(vec_id) AS vec_id, any_value(x) AS x, min((d, c)) AS best FROM (
    SELECT v.i, v.vec_id, v.x, c{r}.c,
           CAST(list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v CROSS JOIN c{r}) GROUP BY i)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM (
    SELECT c, place, sum(y) AS s, count(*) AS n FROM (
      SELECT best[2] AS c, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{r}) GROUP BY c, place)
  GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id,
         list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark) - 1 AS c, x
  FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS mark, x FROM v ORDER BY mark LIMIT {k})),
{",".join(steps)}
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} z ON z.c = best[2]
"""
