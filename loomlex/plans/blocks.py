"""Entries of a bag of words in blocks of documents, for fits that pass over them many times.

The entries are laid out once: one row per block, its entries packed in flat arrays
that name a term by its place among the block's distinct terms.  A pass sends every
block the row of each of its distinct terms once, instead of once per entry, and
gets back one row per distinct term.  No task holds more than a block, and nothing of
the size of the entries or of the terms goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.session import ship_package, stage_table

# Entries of a block: blocks are filled by the hash of the document, a longer document is not split.
BLOCK_ROWS = 2_000_000
# Small tables still make blocks for all cores, of no fewer entries than this.
LEAST_ROWS = 10_000


@dataclass
class Blocks:
    """``packed``: (block, data), a row per block; ``needs``: (token_id, n, blocks), a row per
    term: its entries and the blocks that hold it; ``count`` of blocks."""

    packed: DataFrame
    needs: DataFrame
    count: int


@dataclass
class Block:
    """Entries sorted by document: ``first`` entry of each document, ``local`` place of each entry's
    term among ``tokens`` (distinct, rising), ``weight``, a hash ``mark`` per document, and
    optionally a hash ``place`` per entry.  Weights that are small whole numbers are kept as bytes."""

    first: np.ndarray
    mark: np.ndarray
    local: np.ndarray
    weight: np.ndarray
    tokens: np.ndarray
    place: np.ndarray | None = None

    @property
    def ends(self) -> np.ndarray:
        """The end of each document's entries."""
        return np.concatenate([self.first[1:], [len(self.local)]])

    @property
    def number(self) -> np.ndarray:
        """The document of each entry."""
        return np.repeat(np.arange(len(self.first)), self.ends - self.first)

    def parts(self, rows: int):
        """(first document, end) of whole documents of about ``rows`` entries or a long one, in turn."""
        ends, lo = self.ends, 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, self.first[lo] + rows, side="right")))
            yield lo, hi
            lo = hi

    def to_bytes(self) -> bytes:
        weight = np.asarray(self.weight, np.float64)
        small = bool(((weight >= 0) & (weight <= 255) & (weight == np.floor(weight))).all())
        sizes = np.array([len(self.first), len(self.local), len(self.tokens), small, self.place is not None], dtype=np.int64)
        return b"".join(x.tobytes() for x in (sizes, self.first.astype(np.int64), self.mark, self.tokens,
                                              *([] if self.place is None else [self.place]),
                                              *([] if small else [weight]), self.local.astype(np.int32),
                                              *([weight.astype(np.uint8)] if small else [])))

    @staticmethod
    def from_bytes(data: bytes) -> Block:
        docs, rows, terms, small, placed = np.frombuffer(data, np.int64, 5).tolist()
        at, parts = 40, []
        for kind, n in ((np.int64, docs), (np.int64, docs), (np.int64, terms), (np.int64, rows if placed else 0),
                        (np.float64, 0 if small else rows), (np.int32, rows), (np.uint8, rows if small else 0)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        first, mark, tokens, place, weight, local, byte = parts
        return Block(first, mark, local, byte.astype(np.float64) if small else weight, tokens, place if placed else None)


def _runs(batches, key: str):
    """(value of ``key``, rows as batches) of sorted batches, one run of equal values at a time."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            if held and values[lo] != now:
                yield now, held
                held = []
            now = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, held


def _ranks(doc: pa.Array) -> np.ndarray:
    """The place of each entry's document among the distinct ones in order, null first."""
    code = doc.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(code.dictionary, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[code.indices.to_numpy()]


def _pack_batches(placed: bool, merge: bool):
    """All rows of a block, in any order -> its entries, sorted here."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        doc = pa.concat_arrays([b["doc_id"] for b in held])
        token, weight, mark, *place = (np.concatenate([b[c].to_numpy() for b in held])
                                       for c in ("token_id", "weight", "mark", *["place"] * placed))
        block = held[0]["block"][0].as_py()
        del held
        tokens, local = np.unique(token, return_inverse=True)
        rank = _ranks(doc)
        order = np.lexsort((local, place[0], rank)) if placed else np.argsort(rank * len(tokens) + local, kind="stable")
        rank, local, weight = rank[order], local[order], weight[order]
        if merge:
            new = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (local[1:] != local[:-1])]))
            order, rank, local, weight = order[new], rank[new], local[new], np.add.reduceat(weight, new)
        first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        data = Block(first, mark[order[first]], local, weight, tokens, place[0][order] if placed else None).to_bytes()
        row = {"block": pa.array([block], pa.int32()), "data": pa.array([data], pa.binary())}
        if placed:
            docs = doc.take(pa.array(order[first]))
            row["docs"] = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        yield pa.RecordBatch.from_pydict(row)
    return run


def _need_batches(batches):
    for batch in batches:
        for number, data in zip(batch["block"].to_pylist(), batch["data"]):
            block = Block.from_bytes(data.as_buffer())
            n = np.bincount(block.local, minlength=len(block.tokens))
            yield pa.RecordBatch.from_pydict({"token_id": block.tokens, "n": n.astype(np.int64),
                                              "block": np.full(len(n), number, np.int32)})


def pack(entries: DataFrame, name: str, block_rows: int | None = None, least_rows: int | None = None,
         merge: bool = False) -> tuple[DataFrame, int]:
    """Blocks (block, data) of a staged table (doc_id, token_id long, weight double), of about
    ``block_rows`` entries (``BLOCK_ROWS`` and ``LEAST_ROWS`` by default), and their number.

    Small tables have a block per core: a pass sends a row per block and distinct term, so that
    more blocks cost more.  ``merge`` adds up rows of one document and term.  With a column
    ``place`` (long) the entries of a document are in its order, and the blocks list their
    documents as ``docs``."""
    spark = entries.sparkSession
    ship_package(spark)
    rows = entries.count()
    cores = spark.sparkContext.defaultParallelism
    count = max(-(-rows // (block_rows or BLOCK_ROWS)), min(cores, -(-rows // (least_rows or LEAST_ROWS))), 1)
    placed = [c for c in entries.columns if c == "place"]
    mark = F.xxhash64("doc_id")
    marked = entries.select("doc_id", "token_id", "weight", mark.alias("mark"), *placed,
                            F.pmod(F.xxhash64(mark), F.lit(count)).cast("int").alias("block"))
    kind = entries.schema["doc_id"].dataType.simpleString()
    # a partition is a block
    return stage_table(marked.repartitionById(count, F.col("block")).mapInArrow(
        _pack_batches(bool(placed), merge), "block int, data binary" + (f", docs array<{kind}>" if placed else "")),
        f"{name}-blocks"), count


def entry_counts(packed: DataFrame) -> DataFrame:
    """(token_id, n, blocks): a term's entries and the blocks that hold it."""
    return packed.mapInArrow(_need_batches, "token_id long, n long, block int").groupBy("token_id").agg(
        F.sum("n").alias("n"), F.collect_list("block").alias("blocks"))


def lay_out(entries: DataFrame, name: str) -> Blocks:
    """Blocks of a staged table (doc_id, token_id long, weight double)."""
    packed, count = pack(entries, name)
    needs = entry_counts(packed)
    return Blocks(packed, stage_table(needs, f"{name}-needs"), count)


def _block_batches(step, columns: list[str]):
    def run(batches):
        for number, held in _runs(batches, "block"):
            data = states = None
            rows = []
            for part in held:
                kind = part["kind"].to_numpy()
                if kind[0] == 0:
                    data = part["data"][0].as_buffer()
                for i in np.flatnonzero(kind == 1).tolist():
                    states = part["data"][i].as_buffer()
                own = part.slice(int(np.searchsorted(kind, 2)))
                rows.append(np.column_stack([own[c].to_numpy() for c in columns]))
            yield step(int(number), Block.from_bytes(data), np.concatenate(rows), states)
    return run


def pass_over(blocks: Blocks, rows: DataFrame, columns: list[str], step, schema: str,
              states: DataFrame | None = None) -> DataFrame:
    """``step(number, Block, rows, state)`` on every block, giving a RecordBatch of ``schema``.

    ``rows`` (token_id, *columns) has one row of doubles per term; a block gets those of its
    terms as an array in the order of ``Block.tokens``.  ``states`` (block, data) is an optional
    row of bytes per block, from the pass before."""
    # joined by a shuffle: a row per term, but with as many columns as the model has
    sent = rows.join(blocks.needs.select("token_id", "blocks").hint("merge"), "token_id").select(
        F.explode("blocks").alias("block"), F.lit(2).alias("kind"), "token_id", F.lit(None).cast("binary").alias("data"), *columns)
    none = [F.lit(0.0).alias(c) for c in columns]
    together = blocks.packed.select("block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("token_id"), "data", *none) \
        .unionByName(sent)
    if states is not None:
        together = together.unionByName(states.select("block", F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("token_id"),
                                                      "data", *none))
    return together.repartitionById(blocks.count, F.col("block")).sortWithinPartitions("block", "kind", "token_id") \
        .mapInArrow(_block_batches(step, columns), schema)


# Rows of a pass of ``pass_sums``: a block's entries, its state, sums of a part of the terms, and
# a note of a part.
_ENTRIES, _STATE, _SUMS, _NOTE = 0, 1, 2, 3
_MESSAGES = "kind int, block int, part int, data binary"


def _part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` adds up a term."""
    return ((tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _messages(kinds: list[int], blocks, parts, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "block": pa.array(blocks, pa.int32()),
                                       "part": pa.array(parts, pa.int32()), "data": pa.array(data, pa.binary())})


def stage_messages(df: DataFrame, name: str) -> DataFrame:
    """A staged table of messages.  Their numbers do not compress, so that trying costs more than it saves."""
    return stage_table(df, name, compression="none", **{"parquet.enable.dictionary": "false"})


@dataclass
class _Held:
    """What a block keeps from pass to pass: the step's ``state``, and ``rows`` that no other block
    has a part in: after the first pass all, then those of ``private`` terms (in the order of parts)."""

    private: np.ndarray | None
    rows: np.ndarray
    state: bytes

    def to_bytes(self) -> bytes:
        private = b"" if self.private is None else self.private.astype(np.uint8).tobytes()
        sizes = np.array([len(private), self.rows.size], dtype=np.int64)
        return b"".join((sizes.tobytes(), np.ascontiguousarray(self.rows).tobytes(), private, self.state))

    @staticmethod
    def from_bytes(data: pa.Buffer, k: int) -> _Held:
        terms, size = np.frombuffer(data, np.int64, 2).tolist()
        rows, at = np.frombuffer(data, np.float64, size, 16).reshape(-1, k), 16 + 8 * size
        return _Held(np.frombuffer(data, np.uint8, terms, at).view(bool) if terms else None, rows, data[at + terms:])


def held_state(data: pa.Buffer, k: int) -> pa.Buffer:
    """The step's state in a message of kind ``_STATE``."""
    return _Held.from_bytes(data, k).state


def _step_batches(step, k: int, parts: int, private: bool, last: bool):
    def run(batches):
        for number, held in _runs(batches, "block"):
            data = before = None
            got = []  # of each part in turn: the sums over all terms, then those of the block's terms, then which it shares
            for batch in held:
                for kind, x in zip(batch["kind"].to_pylist(), batch["data"]):
                    if kind == _SUMS:
                        got.append(x.as_buffer())
                    elif kind == _STATE:
                        before = _Held.from_bytes(x.as_buffer(), k)
                    else:
                        data = x.as_buffer()
            block = Block.from_bytes(data)
            place = _part_of(block.tokens, parts)
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(parts + 1))
            own = rows = totals = None
            if got:
                totals, rows = np.frombuffer(got[0], np.float64, k), np.empty((len(order), k))
                own = before.private
                if private and own is None:
                    sizes = np.diff(edges).tolist()
                    own = ~np.concatenate([np.frombuffer(x, np.uint8, n, x.size - n) for x, n in zip(got, sizes)]).view(bool)
                    mine = before.rows[order[own]]
                    got = [x.slice(0, x.size - n) for x, n in zip(got, sizes)]
                else:
                    mine = before.rows
                shared = order if own is None else order[~own]
                rows[shared] = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, k)[1:] for x in got])
                if own is not None:
                    rows[order[own]] = mine
            sums, state = step(block, rows, totals, None if before is None else before.state)
            kept = np.zeros((0, k)) if not private else sums if own is None else sums[order[own]]
            state = _Held(own, kept, state).to_bytes()
            total = sums.sum(axis=0).tobytes()
            if own is not None and not last:
                order = order[~own]
                edges = np.searchsorted(place[order], np.arange(parts + 1))
            tokens, sums, edges = block.tokens[order], sums[order], edges.tolist()
            out = [total + tokens[lo:hi].tobytes() + sums[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])]
            yield _messages([_STATE] + [_SUMS] * parts, [int(number)] * (parts + 1), [int(number) % parts, *range(parts)], [state, *out])
    return run


def _sum_batches(k: int, columns: list[str] | None, mark_shared: bool, note):
    """What the blocks sent to a part -> the sums, to each block in the order it sent its terms;
    with ``columns`` a row per term."""
    def run(batches):
        for part, held in _runs(batches, "part"):
            blocks, totals, tokens, sums = [], np.zeros(k), [], []
            for batch in held:
                for kind, number, x in zip(batch["kind"].to_pylist(), batch["block"].to_pylist(), batch["data"]):
                    raw = x.as_buffer()
                    if kind == _STATE:
                        if columns is None:
                            yield _messages([_STATE], [number], [part], [raw.to_pybytes()])
                        continue
                    n = (raw.size - 8 * k) // (8 * (k + 1))
                    blocks.append(number)
                    totals = totals + np.frombuffer(raw, np.float64, k)
                    tokens.append(np.frombuffer(raw, np.int64, n, 8 * k))
                    sums.append(np.frombuffer(raw, np.float64, n * k, 8 * (k + n)).reshape(n, k))
            if not blocks:
                continue
            edges = np.cumsum([0, *map(len, tokens)]).tolist()
            distinct, at = np.unique(np.concatenate(tokens), return_inverse=True)
            total_of = np.zeros((len(distinct), k))
            for lo, hi, rows in zip(edges, edges[1:], sums):  # a block names a term once
                total_of[at[lo:hi]] += rows
            if columns is not None:
                yield pa.RecordBatch.from_pydict({"token_id": distinct} | dict(zip(columns, total_of.T.copy())))
                continue
            shared = np.bincount(at, minlength=len(distinct)) > 1 if mark_shared else None
            total = totals.tobytes()
            for number, lo, hi in zip(blocks, edges, edges[1:]):
                own = at[lo:hi]
                if mark_shared:
                    both = shared[own]
                    yield _messages([_SUMS], [number], [part], [total + total_of[own[both]].tobytes() + both.tobytes()])
                else:
                    yield _messages([_SUMS], [number], [part], [total + total_of[own].tobytes()])
            if note is not None:
                yield _messages([_NOTE], [-1], [part], [np.concatenate([[note(total_of)], totals]).tobytes()])
    return run


def pass_sums(packed: DataFrame, count: int, before: DataFrame | None, k: int, step, columns: list[str] | None = None,
              private: bool = True, note=None) -> DataFrame:
    """``step(Block, rows, totals, state)`` on every block, giving k sums per term of the block and
    a state in bytes; the sums of a term are added up over the blocks.

    ``before`` is the staged result of the last pass: a block gets its terms' sums from it as
    ``rows`` in the order of ``Block.tokens``, the sums over all terms and its own state; in the
    first pass (None) these are None.  With ``columns`` the result is (token_id, *columns).

    Sums travel as packed arrays, between ``count`` blocks and as many parts of the terms, and are
    added in the order of the blocks, so that a result does not depend on what came first.  With
    ``private`` the terms of one block stay with it between the first and the last pass; without,
    ``note`` may give a number from the sums of a part's terms (``notes``)."""
    rows = packed.select(F.lit(_ENTRIES).alias("kind"), "block", F.lit(-1).alias("part"), "data")
    if before is not None:
        rows = rows.unionByName(before.where(F.col("kind") != _NOTE)).repartitionById(count, F.col("block")) \
            .sortWithinPartitions("block", "kind", "part")
    sent = rows.mapInArrow(_step_batches(step, k, count, private, columns is not None), _MESSAGES)
    schema = _MESSAGES if columns is None else "token_id long" + "".join(f", {c} double" for c in columns)
    return sent.repartitionById(count, F.col("part")).sortWithinPartitions("part", "kind", "block") \
        .mapInArrow(_sum_batches(k, columns, private and before is None, note), schema)


def notes(passed: DataFrame, k: int) -> np.ndarray:
    """The notes of a staged pass, a row per part that has terms: the number, then the k sums over all terms."""
    rows = passed.where(F.col("kind") == _NOTE).select("data").collect()
    return np.array([np.frombuffer(r.data, np.float64) for r in rows]).reshape(-1, k + 1)
