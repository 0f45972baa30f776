"""Source mixing, bit-plane clustering and the conversation prefix trie."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlex.llm import centroids, mixing, prefix_trie
from loomlex.llm.spill_queue import SpillQueue

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

# ------------------------------------------------------------ mixing

DOCS = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        if not free:
            return {s: most * sizes[s] for s in names}
        level = (total - sum(most * sizes[s] for s in stopped)) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in stopped else level * weight[s] for s in names}
        stopped |= above


def mix_rows(n=600):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "a", "a", "b", "c", None, "é", ""])) for i in range(n)]
    rows += [(7000, "same text here", "a")] * (n // 2) + [(7001, None, "b"), (7002, "", None), (None, "x y", "c")]
    rows += [(7003, "long " * 30000, "b"), (7004, "solo", "z"), (7004, "other text", "z"), (7005, "", "only empty")]
    return rows


def check_mix(rows, got, **kw):
    want_size = defaultdict(int)
    for _, t, s in rows:
        want_size[s] += len(WORDS.findall(t or ""))
    targets = brute_targets(want_size, **kw)
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r)
    assert sum(r.size for r in got) == sum(want_size.values()) and len(got) == len(rows)
    for s, size in want_size.items():
        (key,) = [k for k in by if k[0] == size and math.isclose(k[1], targets[s], rel_tol=1e-12, abs_tol=1e-9)]
        taken, largest = sum(r.taken for r in by[key]), max(r.size for r in by[key])
        same = sum(1 for z in want_size.values() if z == size)
        assert abs(taken - targets[s] * same) <= same * largest / 2 + 1e-6
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_mix_meets_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("h1", F.lit(1)).withColumn("mark", F.lit(2))
    got = mixing.mix(df).collect()
    check_mix(rows, got)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    # among repeated rows exactly as many are taken as the budget holds
    same = [r for r in got if r.doc_id == 7000]
    assert len(same) == 300 and len({r.copies for r in same}) <= 2


def test_budgets_are_nested(spark):
    df = spark.createDataFrame(mix_rows(300)[:300], DOCS)
    parts = [{r.doc_id: r.copies for r in mixing.mix(df, share=s).collect()} for s in (0.2, 0.5, 0.9, 1.5)]
    for small, large in zip(parts, parts[1:]):
        assert all(large[d] >= n for d, n in small.items())


def test_mix_opens_deep_buckets(spark, monkeypatch):
    """With one bit a level the budget is found after many openings, at the same place."""
    rows = mix_rows(80)
    df = spark.createDataFrame(rows, DOCS)
    want = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "DIGIT", 4)
    monkeypatch.setattr(mixing, "LEVELS", [(w, s) for w, b in mixing.PLACE.items() for s in range((60 if w != "h3" else 64) - 4, -1, -4)])
    assert sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df).collect()) == want


def test_mix_edge_tables(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], DOCS)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in none] == [(0, 0, 0.0, 0)] * 2
    every = mixing.mix(spark.createDataFrame([(1, "a b", "a"), (2, "c", "b")], DOCS), share=9).collect()
    assert {(r.doc_id, r.taken) for r in every} == {(1, 4), (2, 2)}


# ------------------------------------------------------------ clustering

def brute_clusters(rows, k=16, rounds=3):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            ints = [max(-centroids.SATURATE, min(centroids.SATURATE, math.floor(64 * float(np.float32(v))))) for v in x]
            kept.append((vec_id, ints))
    mark = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    c = [list(x) for _, x in sorted(kept, key=lambda r: mark(r[0]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, z)), j) for j, z in enumerate(c)) for _, x in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            own = [x for (_, x), (_, i) in zip(kept, near) if i == j]
            if own:
                c[j] = [sum(v) // len(own) for v in zip(*own)]
    near = assign()
    inertia = defaultdict(int)
    for d, j in near:
        inertia[j] += d
    return sorted(((-1 if i is None else i), j, d, inertia[j], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near))


def got_clusters(df, **kw):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, centroids.cluster(df, **kw).collect()))


VECTORS = "vec_id long, embedding array<float>"


def test_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=64) * (1 + i % 3)]) for i in range(150)]
    rows += [(500, [0.25] * 64)] * 60 + [(501, None), (502, []), (503, [1.0] * 63), (504, [1.0] * 65), (None, [0.5] * 64)]
    rows += [(505, [None] + [1.0] * 63), (506, [float("nan")] + [1.0] * 63), (507, [float("inf")] * 64), (508, [-0.001] * 64)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("x")).withColumn("planes", F.lit(0))
    want = brute_clusters(rows)
    assert got_clusters(df) == want == got_clusters(df.repartition(5))
    assert got_clusters(df, k=3, rounds=0) == brute_clusters(rows, 3, 0)


def test_few_and_huge_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None)], VECTORS)).count() == 0
    rows = [(1, [1.0] * 64), (2, [1e30] + [-1e30] * 63), (3, [0.0] * 64)]
    assert got_clusters(spark.createDataFrame(rows, VECTORS)) == brute_clusters(rows)


def test_planes_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 5, 300, centroids.SATURATE):
        x, c = rng.integers(-top, top + 1, (40, 64)), rng.integers(-3 * top // 4, top, (7, 64))
        px, pc = centroids.pack(x), centroids.pack(c)
        assert (centroids.dots(px, pc) == x @ c.T).all()
        assert (centroids.distances(px, pc) == ((x[:, None] - c[None]) ** 2).sum(2)).all()
        assert (centroids.unpacked_sum(px) == x.sum(0)).all()


# ------------------------------------------------------------ prefix trie

TALKS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, mark[:30]), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    kids = defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(WORDS.findall(n[-1][1])) if n else 0
    return sorted((min(m), len(n), -1 if not n else min(members[n[:-1]]), len(m), kids.get(n, 0), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def got_trie(df, **kw):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, prefix_trie.trie(df, **kw).collect()))


def talks():
    rng = random.Random(5)
    rows = []
    for c in range(260):
        kind = rng.choice(["copy", "first", "own"])
        for t in range(rng.randrange(1, 7)):
            text = "the same words" if kind == "copy" or kind == "first" and t < 2 else f"turn {rng.randrange(5)} of {rng.randrange(3)}"
            rows.append((c, t, rng.choice(["user", "assistant"]) if kind == "own" else "user", text))
    rows += [(1001, None, None, None), (1001, 1, "user", "b"), (1001, 1, "user", "a"), (1001, 1, "user", "a"), (1002, 0, "x", "")]
    rows += [(None, 0, "user", "lost"), (5003, None, "user", "one"), (5003, None, "user", "two"), (5007, 3, "user", None)]
    rows += [(5020, t, "user", "long " * (t % 3)) for t in range(400)] + [(5021, 0, "user", "w " * 50000)]
    return rows


@pytest.mark.parametrize("min_heavy", [1, 20, 1000])
def test_trie(spark, min_heavy):
    rows = talks()
    df = spark.createDataFrame(rows, TALKS).withColumn("depth", F.lit("x")).withColumn("k1", F.lit(1)).repartition(3)
    assert got_trie(df, min_heavy=min_heavy) == brute_trie(rows)


def test_trie_edges(spark):
    assert got_trie(spark.createDataFrame([], TALKS)) == []
    assert got_trie(spark.createDataFrame([(None, 0, "u", "t")], TALKS)) == []
    rows = [(3, 0, "u", "t")]  # crc32("3") % 4 turns are borrowed, from nobody
    assert got_trie(spark.createDataFrame(rows, TALKS)) == brute_trie(rows)
    turnless = [(c, 0, "u", "t") for c in range(1, 20)]
    assert got_trie(spark.createDataFrame(turnless, TALKS)) == brute_trie(turnless)


def test_long_conversation_over_many_partitions(spark):
    """A run that goes through whole partitions is carried on."""
    rows = [(40, t, "user", f"t{t % 7}") for t in range(300)] + [(41, 0, "user", "x"), (39, 0, "user", "y")]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert got_trie(spark.createDataFrame(rows, TALKS)) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_ends_in_pieces(monkeypatch):
    """A list in pieces, over several batches, has the digest of the whole list."""
    import pyarrow as pa
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = {1: list(range(100)), 2: [5], 3: list(range(50, 81))}
    flat = [(k, c) for k, v in ids.items() for c in v]
    batch = pa.RecordBatch.from_pydict({
        c: pa.array([k for k, _ in flat], type=pa.int64()) for c in ("depth", "k1", "k2")} | {
        "conv_id": pa.array([c for _, c in flat], type=pa.int64())})
    pieces = list(prefix_trie._pieces([batch.slice(0, 30), batch.slice(30)]))
    assert max(len(x.split(",")) for p in pieces for x in p["ids"].to_pylist()) == 7
    got = pa.Table.from_batches(list(prefix_trie._digests(pieces))).to_pylist()
    assert {r["k1"]: r["ends_sha256"] for r in got} == {
        k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}


def test_spill_queue():
    rng = random.Random(1)
    for limit, fan in ((3, 2), (10, 4), (1000, 16)):
        queue, have = SpillQueue(limit, fan), []
        for _ in range(3000):
            if rng.random() < 0.6 or not have:
                x = (rng.randrange(50), rng.randrange(10))
                queue.push(x)
                have.append(x)
            else:
                assert queue.peek() == min(have)
                have.remove(queue.pop())
        assert [queue.pop() for _ in range(len(have))] == sorted(have) and queue.peek() is None


def test_time_forward_spills(spark):
    """A shard's totals with a queue of three messages in memory."""
    import pyarrow as pa
    parent = {i: (i - 1) // 3 for i in range(1, 200)}
    depth = {0: 1}
    for i in range(1, 200):
        depth[i] = depth[parent[i]] + 1
    nodes = sorted(depth, key=lambda i: (-depth[i], i))
    cols = {"depth": [depth[i] for i in nodes], "k1": nodes, "k2": nodes, "p1": [parent.get(i) for i in nodes],
            "p2": [parent.get(i) for i in nodes], "own": [i for i in nodes]} | {
        c: [0] * 200 for c in ("in_n", "in_leaves", "in_saved")} | {c: [None] * 200 for c in ("q1", "q2")}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, type=pa.int64()) for k, v in cols.items()})
    out = pa.Table.from_batches(list(prefix_trie.time_forward([batch.slice(0, 60), batch.slice(60)], limit=3))).to_pylist()
    (top,) = [r for r in out if r["k1"] == 0]
    assert top["saved_tokens"] == sum(range(200)) and top["n_leaves"] == 200 - len(set(parent.values()))
    assert {r["k1"]: r["n_children"] for r in out} == {i: sum(p == i for p in parent.values()) for i in range(200)}
