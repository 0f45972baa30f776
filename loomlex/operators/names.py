"""Gazetteer names of any length, matched while text is tokenised.

A name is the list of its lowercased tokens.  Matching is leftmost-longest: of the
names that start at a token the longest counts, and tokens inside a matched name
start no other.

Within a measured byte bound the names become a token trie, built once and sent to
the tasks: sorted ``state << 32 | token`` keys, so that a step for all live starts
of a text part is one binary search.  Beyond the bound the tasks get a Bloom filter
of fixed size over the names' token prefixes; starts that pass it are joined with
the table of names on the whole name, so the result is exact, no name is too
long, and no name table is held in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.operators.joins import MAX_BROADCAST_BYTES
from loomlex.session import stage_table

NAMES_SCHEMA = "tokens array<string>, ent_type string"

# Bytes a trie edge takes besides its token.
EDGE_BYTES = 64


@dataclass
class TokenTrie:
    """``keys`` sorted; ``after[i]`` is the state behind ``keys[i]``; ``types[s]`` the
    index of the type of the name that ends in state ``s``, -1 if none does."""

    vocab: list[str]
    keys: np.ndarray
    after: np.ndarray
    types: np.ndarray
    type_names: list[str]

    @classmethod
    def build(cls, names: list[tuple[list[str], str]]) -> TokenTrie:
        ids: dict[str, int] = {}
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        kinds: dict[str, int] = {}
        for tokens, kind in names:
            state = 0
            for t in tokens:
                state = edges.setdefault(state << 32 | ids.setdefault(t, len(ids)), len(edges) + 1)
            ends[state] = kinds.setdefault(kind, len(kinds))
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        after = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order]
        types = np.full(len(edges) + 1, -1, dtype=np.int32)
        types[list(ends)] = list(ends.values())
        return cls(list(ids), keys[order], after, types, list(kinds))

    def longest(self, lowered: pa.Array, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, tokens, type index) of the longest name at each token that starts
        one; ``room`` is the number of tokens from each token to its text's end."""
        if not len(self.keys):
            return (np.zeros(0, dtype=np.int64),) * 3
        token = pc.fill_null(pc.index_in(lowered, value_set=pa.array(self.vocab, pa.string())), -1).to_numpy() \
            .astype(np.int64)
        live = np.flatnonzero(token >= 0)
        state = np.zeros(len(live), dtype=np.int64)
        length = np.zeros(len(token), dtype=np.int64)
        kind = np.full(len(token), -1, dtype=np.int64)
        depth = 0
        while len(live):
            step = token[live + depth]
            key = state << 32 | np.maximum(step, 0)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = (self.keys[at] == key) & (step >= 0)
            live, state = live[goes], self.after[at[goes]]
            depth += 1
            named = self.types[state] >= 0
            length[live[named]] = depth
            kind[live[named]] = self.types[state[named]]
            more = room[live] > depth
            live, state = live[more], state[more]
        starts = np.flatnonzero(length)
        return starts, length[starts], kind[starts]


def leftmost(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the matches, in order of their starts, stay when matches must not overlap."""
    keep, free = np.zeros(len(starts), dtype=bool), -1
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
        if s >= free:
            keep[i] = True
            free = s + n
    return keep


# ------------------------------------------------------------ beyond the bound

BLOOM_BITS_MAX = 27
BLOOM_BITS_PER_PREFIX = 16

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, by prefix sums over all their bytes."""
    tokens = tokens.cast(pa.large_string())
    if not len(tokens):
        return np.zeros(0, dtype=np.uint64)
    offs = np.frombuffer(tokens.buffers()[1], dtype=np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
    raw = np.frombuffer(tokens.buffers()[2] or b"", dtype=np.uint8)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    power = np.full(len(raw) + 1, _MULT, dtype=np.uint64)
    back = np.full(len(raw) + 1, _INV, dtype=np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * power[:-1], dtype=np.uint64)])
    return _mix((sums[offs[1:]] - sums[offs[:-1]]) * back[offs[:-1]] + np.uint64(1))


def _extend(prefix: np.ndarray, token: np.ndarray) -> np.ndarray:
    return _mix(prefix * np.uint64(_MULT) + token)


@dataclass
class PrefixFilter:
    """A Bloom filter over all token prefixes of the names; whole names are set twice,
    the second time with their hash mixed again."""

    bits: int
    words: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> np.uint64(64 - self.bits)
        low = hashes & np.uint64((1 << self.bits) - 1)
        return self._set(cell) & self._set(low)

    def _set(self, cell: np.ndarray) -> np.ndarray:
        return (self.words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) > 0

    def candidates(self, lowered: pa.Array, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, tokens) of every run of tokens that may be a name."""
        token = token_hashes(lowered)
        live = np.arange(len(token))
        prefix = np.zeros(len(token), dtype=np.uint64)
        starts, lengths, depth = [], [], 0
        while len(live):
            prefix = _extend(prefix, token[live + depth])
            goes = self.has(prefix)
            live, prefix = live[goes], prefix[goes]
            depth += 1
            named = self.has(_mix(prefix + np.uint64(1)))
            starts.append(live[named])
            lengths.append(np.full(named.sum(), depth, dtype=np.int64))
            more = room[live] > depth
            live, prefix = live[more], prefix[more]
        return np.concatenate(starts or [live]), np.concatenate(lengths or [live])


def _prefix_hashes(batches):
    """Names -> the hashes that the filter has to hold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch["tokens"]
        token = token_hashes(names.flatten())
        size = pc.list_value_length(names).to_numpy()
        first = np.cumsum(size) - size
        live, out, depth = np.arange(len(size)), [], 0
        prefix = np.zeros(len(size), dtype=np.uint64)
        while len(live):
            prefix = _extend(prefix, token[first[live] + depth])
            depth += 1
            ends = size[live] == depth
            out += [prefix, _mix(prefix[ends] + np.uint64(1))]
            live, prefix = live[~ends], prefix[~ends]
        yield pa.RecordBatch.from_pydict({"h": np.unique(np.concatenate(out)).view(np.int64)})


def prefix_filter(names: DataFrame) -> PrefixFilter:
    """The filter of all names; its size is at most ``2**BLOOM_BITS_MAX`` bits, so at
    most that many bits come to the driver, 64 a row."""
    hashes = names.select("tokens").mapInArrow(_prefix_hashes, "h long").distinct()
    hashes = stage_table(hashes, "name-prefixes")
    bits = min(max(int(hashes.count() * BLOOM_BITS_PER_PREFIX).bit_length(), 10), BLOOM_BITS_MAX)
    high = F.shiftrightunsigned("h", 64 - bits)
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    cells = hashes.select(F.explode(F.array(high, low)).alias("cell"))
    rows = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 AS int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return PrefixFilter(bits, words)


def trie_bytes(names: DataFrame) -> int:
    """Bytes that a trie of the names takes at most, from one aggregate."""
    size = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + EDGE_BYTES)
    return int(names.agg(F.sum(size)).first()[0] or 0)


def compile_names(names: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> TokenTrie | PrefixFilter:
    """The trie of all names within ``max_bytes``, else their prefix filter."""
    if trie_bytes(names) > max_bytes:
        return prefix_filter(names)
    rows = names.select("tokens", "ent_type").toArrow().to_pylist()
    return TokenTrie.build(sorted((r["tokens"], r["ent_type"]) for r in rows))
