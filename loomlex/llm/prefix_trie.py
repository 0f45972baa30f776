"""Conversation prefix trie by time-forward processing.

Conversations are rebuilt (each starts with the head of a donor conversation),
every distinct sequence of first turns becomes a node, and every node learns how
many leaves and how many saved tokens its subtree has.

* Rows are put in order by a range partition on (conversation, place), so that a
  conversation of any length is spread over tasks; places and prefix hashes are
  counted within a partition and carried into the next (one carry a partition).
* A node is a 128-bit hash of its turns, made of 120 bits of SHA-256 a turn.
* A node is heavy if more than ``max(min_heavy, conversations / HEAVY_PARTS)``
  conversations start with it, so each depth has at most HEAVY_PARTS heavy nodes.
  The other nodes hang in light subtrees below heavy nodes or the root.
* Light subtrees are dealt to shards by their top node.  A shard's nodes are sorted
  outside memory (Spark's sort) by reverse level, and each passes its totals
  forward to its parent through a priority queue that spills (``spill_queue``):
  memory is bounded whatever the size of a shard.
* The totals of the shard roots are summed by parent, and the heavy nodes and the
  root are processed in the same way as one last, bounded shard.

Defined cases: rows of a null conv_id belong to no conversation; null turns come
first; rows of one turn number are ordered by the hash of role and text; rows that
repeat are turns of their own; null roles and texts are empty; a conversation left
without turns is a member of the root alone; a negative id has SQL's remainder; an
empty table gives no rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.llm.common import partitions, stage
from loomlex.llm.mixing import WORD
from loomlex.llm.spill_queue import SpillQueue
from loomlex.operators.joins import join_bounded

DONOR_EVERY = 20
HEADS = 4  # a conversation borrows fewer turns than this
HEAVY_PARTS = 100_000
MIN_HEAVY = 64
PIECE = 20_000  # conversation ids in a row on their way into one digest

NODE = ["depth", "k1", "k2"]

# Odd multipliers of the two 64-bit prefix hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1


# ------------------------------------------------------------ ordered scan

SCAN_SCHEMA = ("conv_id long, place long, h1 long, h2 long, words long, k1 long, k2 long, p1 long, p2 long, "
               "part int, head boolean, run struct<first:long,n:long,s1:long,s2:long,last:long,ln:long,l1:long,l2:long>")


def _signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _scan(batches):
    """Rows of sorted conversations -> place in the conversation and prefix hashes, as
    far as this partition knows; at last one row that tells its first and last runs."""
    part = TaskContext.get().partitionId()
    run = None       # (conv_id, rows, s1, s2) of the run that is open
    first = None     # the partition's first run, once it has ended
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch["conv_id"].to_numpy()
        turns = [batch[h].to_numpy().astype(np.uint64) for h in ("h1", "h2")]
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(conv)]]))
        at = np.arange(len(conv)) - np.repeat(starts, sizes)  # place in the run, in this batch
        state = (0, 0, 0)
        if run is not None and run[0] == conv[0]:
            state = run[1:]
        elif run is not None and first is None:
            first = run
        head = first is None
        keys, parents = [], []
        for h, base, carried in zip(turns, BASES, state[1:]):
            power = _powers(base, len(conv))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[at], dtype=np.uint64)])
            inner = sums[1:] - np.repeat(sums[starts], sizes)
            before = sums[:-1] - np.repeat(sums[starts], sizes)
            shift = np.uint64(pow(base, state[0], 1 << 64))
            inner[:sizes[0]] = np.uint64(carried) + shift * inner[:sizes[0]]
            before[:sizes[0]] = np.uint64(carried) + shift * before[:sizes[0]]
            keys.append(inner)
            parents.append(before)
        place = at.astype(np.int64)
        place[:sizes[0]] += state[0]
        if head and len(starts) > 1:
            end = sizes[0] - 1
            first = (int(conv[0]), int(place[end]) + 1, int(keys[0][end]), int(keys[1][end]))
        run = (int(conv[-1]), int(place[-1]) + 1, int(keys[0][-1]), int(keys[1][-1]))
        is_head = np.zeros(len(conv), dtype=bool)
        is_head[:sizes[0]] = head
        yield _scanned({
            "conv_id": batch["conv_id"], "place": place, "h1": batch["h1"], "h2": batch["h2"], "words": batch["words"],
            "k1": keys[0].view(np.int64), "k2": keys[1].view(np.int64), "p1": parents[0].view(np.int64),
            "p2": parents[1].view(np.int64), "part": np.full(len(conv), part, dtype=np.int32), "head": is_head})
    if run is not None:
        first = first or run
        told = [first[0], first[1], *map(_signed, first[2:]), run[0], run[1], *map(_signed, run[2:])]
        yield _scanned({"part": np.array([part], dtype=np.int32)},
                       dict(zip(("first", "n", "s1", "s2", "last", "ln", "l1", "l2"), told)))


_RUN = pa.struct([(n, pa.int64()) for n in ("first", "n", "s1", "s2", "last", "ln", "l1", "l2")])
_SCAN = pa.schema([(n, pa.int64()) for n in ("conv_id", "place", "h1", "h2", "words", "k1", "k2", "p1", "p2")]
                  + [("part", pa.int32()), ("head", pa.bool_()), ("run", _RUN)])


def _scanned(columns: dict, told: dict | None = None) -> pa.RecordBatch:
    n = len(columns["part"])
    full = [pa.array([told] * n, type=_RUN) if f.name == "run"
            else pa.nulls(n, f.type) if f.name not in columns
            else pa.array(columns[f.name], type=f.type) for f in _SCAN]
    return pa.RecordBatch.from_arrays(full, schema=_SCAN)


def carries(runs: list) -> dict[int, tuple]:
    """Per partition whose first run goes on from earlier ones: (rows, s1, s2) of that run so far."""
    out, open_run = {}, None
    for r in sorted(runs, key=lambda r: r.part):
        x = r.run
        before = (0, 0, 0)
        if open_run is not None and open_run[0] == x.first:
            before = out[r.part] = open_run[1]
        if x.first == x.last:
            last = tuple([before[0] + x.n, *[
                (c + pow(b, before[0], 1 << 64) * (s & MASK)) & MASK
                for c, b, s in zip(before[1:], BASES, (x.s1, x.s2))]])
        else:
            last = (x.ln, x.l1 & MASK, x.l2 & MASK)
        open_run = (x.last, last)
    return out


def _carry(found: dict[int, tuple]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [found[p] for p in batch["part"].to_pylist()]
            columns = {n: batch[n] for n in batch.schema.names}
            columns["place"] = pc.add(batch["place"], pa.array([g[0] for g in got], type=pa.int64()))
            for i, base in enumerate(BASES):
                memo = {n: pow(base, n, 1 << 64) for n in {g[0] for g in got}}
                shift = np.array([memo[g[0]] for g in got], dtype=np.uint64)
                start = np.array([g[i + 1] for g in got], dtype=np.uint64)
                for name in (f"k{i + 1}", f"p{i + 1}"):
                    value = batch[name].to_numpy().view(np.uint64)
                    columns[name] = pa.array((start + shift * value).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def scan(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows (conv_id, h1, h2, words) with ``place`` (0-based, by ``order`` within the
    conversation), prefix hash k1, k2 and the prefix hash without the row, p1, p2."""
    columns = ["conv_id", "h1", "h2", "words"]
    by = [F.col("conv_id"), *order]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    table = stage(ranged.select(*columns).mapInArrow(_scan, SCAN_SCHEMA), name)
    found = carries(table.where("run IS NOT NULL").select("part", "run").collect())  # one row a partition
    out = [*columns, "place", "k1", "k2", "p1", "p2"]
    data = table.where("run IS NULL")
    if not found:
        return data.select(*out)
    goes_on = F.col("head") & F.col("part").isin(list(found))
    fixed = data.where(goes_on).select(*out, "part")
    return data.where(~goes_on).select(*out).unionByName(fixed.mapInArrow(_carry(found), fixed.schema).select(*out))


# ------------------------------------------------------------ rebuilding

def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, words) of every row of a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    long = [F.conv(F.substring("mark", at, 15), 16, 10).cast("long") for at in (1, 16)]
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), mark.alias("mark")).select(
        "conv_id", "turn", "words", long[0].alias("h1"), long[1].alias("h2"))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns with prefix hashes, all conversation ids)."""
    rows = stage(turns(conversations), "trie-rows")  # the range partition reads it twice
    own = scan(rows, [F.asc_nulls_first("turn"), F.col("h1"), F.col("h2")], "trie-own")
    ids = stage(own.where("place = 0").select("conv_id"), "trie-ids")
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    donor = F.col("conv_id") - F.col("conv_id") % DONOR_EVERY
    heads = own.where((F.col("place") < HEADS - 1) & (F.col("conv_id") == donor)) \
        .select(F.col("conv_id").alias("donor"), "place", "h1", "h2", "words")
    takes = ids.select("conv_id", donor.alias("donor"), borrowed.alias("h")).where("h > 0")
    start = takes.join(heads, "donor").where("place < h").select("conv_id", "place", "h1", "h2", "words")
    rest = own.where(F.col("place") >= borrowed).select("conv_id", "place", "h1", "h2", "words")
    built = stage(start.unionByName(rest).withColumnRenamed("place", "seq"), "trie-built")
    return scan(built, [F.col("seq")], "trie-turns"), ids


# ------------------------------------------------------------ subtree totals

SHARD = ["depth", "k1", "k2", "p1", "p2", "q1", "q2", "own", "in_n", "in_leaves", "in_saved"]
TOTALS = "depth long, k1 long, k2 long, q1 long, q2 long, n_children long, n_leaves long, saved_tokens long"


def time_forward(batches, limit: int = 100_000):
    """Nodes of a shard by falling depth, then key -> their totals.  A node's totals
    start from what shards below sent (in_*), take in the messages addressed to it,
    and go on to its parent (p1, p2) in this shard; q1, q2 is a parent outside."""
    queue = SpillQueue(limit)
    for batch in batches:
        cols = [batch[c].to_pylist() for c in ("depth", "k1", "k2", "p1", "p2", "own", "in_n", "in_leaves", "in_saved")]
        out = ([], [], [])
        for depth, k1, k2, p1, p2, own, children, leaves, saved in zip(*cols):
            here = (-depth, k1, k2)
            while (top := queue.peek()) is not None and top[:3] == here:
                queue.pop()
                children += 1
                leaves += top[3]
                saved += top[4]
            leaves = leaves or 1
            saved += own
            for column, x in zip(out, (children, leaves, saved)):
                column.append(x)
            if p1 is not None:
                queue.push((1 - depth, p1, p2, leaves, saved))
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict(
                {c: batch[c] for c in (*NODE, "q1", "q2")} | {c: pa.array(x, type=pa.int64()) for c, x in zip(
                    ("n_children", "n_leaves", "saved_tokens"), out)})


def _totals(shards: DataFrame, n: int, *by) -> DataFrame:
    """The nodes of each shard meet in one task, sorted by Spark."""
    return shards.repartition(n, *by).sortWithinPartitions(F.desc("depth"), "k1", "k2") \
        .select(*SHARD).mapInArrow(time_forward, TOTALS)


def subtree_totals(light: DataFrame, heavy: DataFrame, built: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_children, n_leaves, saved_tokens) of all nodes and the root (depth 0)."""
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = ((F.col("n_convs") - 1) * F.col("words")).alias("own")
    # the top of the light subtree on each conversation's way down, looked up by a node's smallest member
    way = built.select("conv_id", (F.col("place") + 1).alias("depth"), "k1", "k2")
    tops = join_bounded(way, heavy.select(*NODE, F.lit(True).alias("heavy")), NODE, "left").where("heavy IS NULL") \
        .groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("top"))
    at_top = F.struct(*NODE) == F.col("top")
    shards = light.join(tops, "conv_id").select(
        *NODE, "top", own, *[zero.alias(c) for c in ("in_n", "in_leaves", "in_saved")],
        *[F.when(~at_top, F.col(f"p{i}")).alias(f"p{i}") for i in (1, 2)],
        *[F.when(at_top, F.col(f"p{i}")).alias(f"q{i}") for i in (1, 2)])
    low = stage(_totals(shards, partitions(light.sparkSession), "top"), "trie-light")
    # what the shard roots send, summed by parent: a heavy node or the root
    sent = low.where("q1 IS NOT NULL").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(
        F.count(F.lit(1)).alias("in_n"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved"))
    root = light.sparkSession.range(1).select(
        *[zero.alias(c) for c in NODE], null.alias("p1"), null.alias("p2"), zero.alias("own"))
    upper = heavy.select(*NODE, "p1", "p2", own).unionByName(root).join(sent, NODE, "left") \
        .fillna(0, ["in_n", "in_leaves", "in_saved"]).select("*", null.alias("q1"), null.alias("q2"))
    top = stage(_totals(upper, 1), "trie-heavy")  # at most HEAVY_PARTS nodes a depth
    return low.unionByName(top).drop("q1", "q2")


# ------------------------------------------------------------ members that end at a node

def _pieces(batches):
    """Sorted (node, conv_id) -> decimal ids, comma-joined, at most PIECE a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[c].to_numpy() for c in NODE]
        conv = batch["conv_id"].to_numpy()
        new = np.zeros(len(conv), dtype=bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(conv)]])
        cut = [(lo, min(lo + PIECE, end)) for start, end in zip(starts, ends) for lo in range(start, end, PIECE)]
        at = np.array([lo for lo, _ in cut])
        yield pa.RecordBatch.from_pydict(
            {c: pa.array(k[at]) for c, k in zip(NODE, keys)}
            | {"first": pa.array(conv[at]), "ids": pa.array([",".join(map(str, conv[lo:hi].tolist())) for lo, hi in cut])})


def _digests(batches):
    """Pieces by node and first id -> one SHA-256 a node, a piece at a time."""
    node, digest = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*[batch[c].to_pylist() for c in (*NODE, "ids")]):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], [*NODE, "ends_sha256"])


def end_digests(built: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end; turnless ones end at the root.

    A digest is a chain over its whole list, so one task has to pass over a node's
    list; it gets it as pieces of PIECE ids and keeps one at a time."""
    n = partitions(built.sparkSession)
    last = built.groupBy("conv_id").agg(F.max(F.struct((F.col("place") + 1).alias("depth"), "k1", "k2")).alias("node"))
    zero = F.lit(0).cast("long")
    ends = ids.join(last, "conv_id", "left").select(*[F.coalesce(f"node.{c}", zero).alias(c) for c in NODE], "conv_id")
    order = [*NODE, "conv_id"]
    pieces = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        _digests, "depth long, k1 long, k2 long, ends_sha256 string")


# ------------------------------------------------------------ the trie

def trie(conversations: DataFrame, min_heavy: int = MIN_HEAVY) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    built, ids = rebuild(conversations)
    nodes = stage(built.groupBy((F.col("place") + 1).alias("depth"), "k1", "k2", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "trie-nodes")
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    crowd = max(min_heavy, total.n // HEAVY_PARTS)
    heavy, light = stage(nodes.where(F.col("n_convs") > crowd), "trie-crowds"), nodes.where(F.col("n_convs") <= crowd)
    totals = subtree_totals(light, heavy, built)
    # a heavy parent is looked up by a bounded join; a light one has at most ``crowd`` children
    above = ["depth", "p1", "p2"]
    as_parent = [(F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                 F.col("conv_id").alias("parent_conv_id")]
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(total.least))
    deeper = join_bounded(nodes.where("depth > 1"), heavy.select(*as_parent), above, "left")
    by_heavy = deeper.where("parent_conv_id IS NOT NULL")
    by_light = deeper.where("parent_conv_id IS NULL").drop("parent_conv_id").join(light.select(*as_parent), above)
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *[zero.alias(c) for c in NODE], "conv_id", "n_convs", F.lit(None).cast("long").alias("parent_conv_id"))
    columns = [*NODE, "conv_id", "n_convs", "parent_conv_id"]
    every = first.select(*columns)
    for part in (by_heavy, by_light, root):
        every = every.unionByName(part.select(*columns))
    none = hashlib.sha256(b"").hexdigest()
    return every.join(totals, NODE).join(end_digests(built, ids), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


# CRC-32 of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, mark) AS turns FROM t GROUP BY conv_id),
c AS (SELECT *, CAST({_CRC} % 4 AS BIGINT) AS h FROM own),
built AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(d.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 20),
members AS (
  SELECT conv_id, d AS depth, turns[1:d] AS node, turns[1:d - 1] AS parent, len(turns) = d AS at_end
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM built)),
n AS MATERIALIZED (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN at_end THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), ''))
           AS ends_sha256,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE
           len(regexp_extract_all(any_value(node[depth].text), '[^\x20\x09-\x0D]+')) END AS own
  FROM members GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
k AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, node)),
below AS (
  SELECT depth, node[1:depth] AS node, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT node, own, n_children, unnest(range(depth + 1)) AS depth FROM k) GROUP BY 1, 2)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN below b USING (depth, node) LEFT JOIN n p ON p.depth = k.depth - 1 AND p.node = k.parent
"""
