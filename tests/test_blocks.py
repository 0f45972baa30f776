"""Blocks of documents and the passes over them (plans/blocks.py)."""

import numpy as np
from pyspark.sql import functions as F

from loomlex.plans import blocks as B
from loomlex.session import stage_table


def test_blocks_keep_small_weights_as_bytes():
    """Whole weights up to 255 take a byte an entry, all others stay as they are."""
    first, tokens = np.array([0, 2]), np.array([3, 8], np.int64)
    for weight, size in ((np.array([1.0, 255.0, 2.0]), 1), (np.array([1.0, 256.0, 2.0]), 8), (np.array([0.5, 1.0, 2.0]), 8)):
        for place in (None, np.array([5, -7, 9], np.int64)):
            block = B.Block(first, np.array([7, -9], np.int64), np.array([0, 1, 1]), weight, tokens, place)
            data = block.to_bytes()
            got = B.Block.from_bytes(data)
            assert len(data) == 40 + 3 * 16 + 3 * (4 + size + (8 if place is not None else 0))
            assert got.weight.dtype == np.float64 and (got.weight == weight).all() and (got.local == block.local).all()
            assert (got.tokens == tokens).all() and (got.place is None if place is None else (got.place == place).all())


def test_repeated_entries_are_added_up_in_the_block(spark, monkeypatch):
    """In a block whatever the order of the rows, sorted by document and term, null first."""
    monkeypatch.setattr(B, "LEAST_ROWS", 4)
    rows = [(d, t, float(w)) for d in (None, "b", "a", "ü") for t in (5, 2) for w in (1, 2)]
    df = stage_table(spark.createDataFrame(rows, "doc_id string, token_id long, weight double").repartition(5))
    packed, count = B.pack(df, "test", 8, 4, merge=True)
    got = [B.Block.from_bytes(r.data) for r in packed.collect()]
    assert count == 4 and sum(len(b.first) for b in got) == 4
    for b in got:
        assert (np.sort(b.tokens) == [2, 5]).all() and (b.local == [0, 1] * len(b.first)).all() and (b.weight == 3).all()
    # A pass sends a row per block and distinct term, so that small tables have a block per core
    assert B.pack(df, "test", 1000, 2)[1] == min(8, spark.sparkContext.defaultParallelism)
    packed, _ = B.pack(df, "test", 1000, 1000)
    one = B.Block.from_bytes(packed.first().data)
    assert len(one.local) == 16 and one.mark.tolist() == [r.m for r in df.select("doc_id", F.xxhash64("doc_id").alias("m")).distinct().orderBy("doc_id").collect()]


def test_terms_of_one_block_do_not_travel(spark):
    """After the first pass a block keeps the sums of terms that no other block has; the result is the same."""
    rows = [(d, t, 1.0 + d) for d in range(40) for t in (0, d + 1)]
    df = stage_table(spark.createDataFrame(rows, "doc_id long, token_id long, weight double"))
    packed, count = B.pack(df, "test", 25, 10)

    def step(block, rows, totals, state):
        seen = 0 if state is None else int(np.frombuffer(state, np.int64)[0])
        sums = np.column_stack([np.bincount(block.local, weights=block.weight, minlength=len(block.tokens))] * 2)
        if rows is not None:
            assert np.allclose(totals, rows_total(seen)) and (rows[:, 0] > 0).all()
            sums = sums + rows
        return sums, np.array([seen + 1]).tobytes()

    def rows_total(seen):
        # the shared term's sums are added by every block, the others' once
        shared, own, weight = 0.0, 0.0, sum(1.0 + d for d in range(40))
        for _ in range(seen):
            shared, own = weight + count * shared, weight + own
        return shared + own

    out = {}
    for private in (True, False):
        now = None
        for i in range(3):
            now = B.stage_messages(B.pass_sums(packed, count, now, 2, step, private=private), "test")
            sent = now.where(F.col("kind") == B._SUMS).agg(F.sum(F.length("data"))).first()[0]
            if i:
                assert sent == 16 * count * count + (count if private else count + 40) * 16
        table = B.pass_sums(packed, count, now, 2, step, ["a", "b"], private=private)
        out[private] = {r.token_id: (r.a, r.b) for r in table.collect()}
    assert out[True] == out[False] and len(out[True]) == 41 and out[True][5] == (20.0, 20.0)


def test_notes_of_a_pass(spark):
    """A part's note has a number from its terms' sums and the sums over all terms."""
    df = stage_table(spark.createDataFrame([(d, t, 1.0) for d in range(20) for t in range(30)], "doc_id long, token_id long, weight double"))
    packed, count = B.pack(df, "test", 200, 10)

    def step(block, rows, totals, state):
        return np.bincount(block.local, minlength=len(block.tokens))[:, None].astype(float), b""

    now = B.stage_messages(B.pass_sums(packed, count, None, 1, step, private=False, note=lambda x: float((x ** 2).sum())), "test")
    got = B.notes(now, 1)
    assert got[:, 0].sum() == 30 * 20 ** 2 and (got[:, 1] == 600).all()


def test_long_documents_are_swept_apart(monkeypatch):
    """A chunk takes as many steps as its longest document; topics do not depend on the chunks."""
    from loomlex.plans import sampling as SP
    rng = np.random.default_rng(4)
    sizes = rng.permutation([400, 390] + [3] * 300)
    first, n, k = np.cumsum(sizes) - sizes, int(sizes.sum()), 3
    block = B.Block(first, np.arange(len(sizes)) * 31, rng.integers(0, 40, n), rng.integers(0, k, n).astype(float), np.arange(40),
                    rng.integers(-9, 1 << 40, n))
    whole, steps = SP.sweep_documents, []

    def counted(number, *args):
        steps.append(int(np.bincount(number).max()))
        return whole(number, *args)

    monkeypatch.setattr(SP, "sweep_documents", counted)
    rows = rng.integers(1, 99, (40, k)).astype(float)
    got = []
    start = block.weight.astype(np.uint8).tobytes()
    for chunk in (10_000, 200):
        monkeypatch.setattr(SP, "SWEEP_ROWS", chunk)
        steps.clear()
        got.append(SP._sweep_step(k, range(4), 2.0, 0.1, 40, 8)(block, rows, rows.sum(axis=0), start))
    assert sorted(steps)[-3:] == [3, 390, 400] and got[0][1] == got[1][1] and (got[0][0] == got[1][0]).all()
    assert got[0][0].sum() == n and got[0][1] != start
