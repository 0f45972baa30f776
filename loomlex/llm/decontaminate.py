"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised windows of all test questions and answers form one automaton.
Each text is normalised once, scanned once, and matches are mapped back to word
numbers; ``spans`` maps them on to code point offsets of the original text.

A benchmark of up to ``SLICE_BYTES`` of text is one slice; its automaton is split
only beyond ``max_windows`` windows.  A larger benchmark is cut into slices.  The
driver holds one slice at a time, each is scanned in a stage of its own, whose
result is written, and carries on the hits of those before: neither the driver
nor a task ever holds two, and no item is left out.

Defined cases: null text has no words; an item without words never occurs; an
item shorter than a window is one window; repeated item rows count once; items
with a null id are scanned and their id left out of the digest; an empty
benchmark or table gives zero hits or no rows; other columns are ignored (``spans``
and ``drop_contaminated`` keep or drop whole rows, whatever their columns are called).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.llm.arrays import LOWER, giving_back, text_chunks
from loomlex.llm.common import anti_join_keys, doc_key, spread, stage

WINDOW = 13
# A word is a run of [0-9a-z] and non-ASCII characters, after lower-casing A-Z.
_NORMAL = bytearray(b" " * 256)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _NORMAL[_b] = int(LOWER[_b])
_NORMAL = bytes(_NORMAL)


def normal_words(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return raw.translate(_NORMAL).split()


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The distinct windows of one item, words joined by single spaces."""
    found = normal_words((text or "").encode())
    if not found:
        return []
    return sorted({b" ".join(found[i:i + window]) for i in range(max(len(found) - window, 0) + 1)})


def window_blocks(items: list[tuple[str | None, str | None]], window: int, max_windows: int):
    """Split (window, ids of its items, word count) into blocks of at most ``max_windows``."""
    owners: dict[bytes, set] = {}
    for item_id, text in items:
        for w in item_windows(text, window):
            owners.setdefault(w, set()).add(item_id)
    rows = [(w.decode("latin-1"), tuple(ids), w.count(b" ") + 1) for w, ids in sorted(owners.items())]
    return [rows[i:i + max_windows] for i in range(0, len(rows), max_windows)]


def automaton(block):
    """Automaton over ' w1 w2 ... ' so that matches end at word borders."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for k, (w, _, n) in enumerate(block):
        a.add_word(f" {w} ", (k, n))
    a.make_automaton()
    return a


def _automata(handle):
    """The automatons of a broadcast, built once per Python worker."""
    if getattr(handle, "automata", None) is None:
        handle.automata = [(block, automaton(block)) for block in handle.value]
    return handle.automata


def hit_words(found: list[bytes], automata) -> tuple[np.ndarray, set]:
    """(which words lie in an occurring window, ids of the items they belong to)."""
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    starts, ends, items = [], [], set()
    ids = None
    for block, machine in automata:
        for end, (k, n) in machine.iter(line):
            if ids is None:
                # word number of the space that ends a match: spaces before it
                ids = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            last = int(ids[end]) - 1
            starts.append(last - n)
            ends.append(last)
            items.update(block[k][1])
    hit = np.zeros(len(found), dtype=bool)
    if starts:
        delta = np.bincount(starts, minlength=len(found) + 1) - np.bincount(ends, minlength=len(found) + 1)
        hit = np.cumsum(delta[:-1]) > 0
    return hit, items


def hit_spans(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every maximal run of hit words, in code points of the
    original text: normalising keeps the length in bytes, so a word's bytes are
    its place there, and the bytes that begin a code point are counted up to it."""
    if not hit.any():
        return []
    word = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(a), int(b)) for a, b in zip(points[starts[first]], points[ends[last]])]


def scan(handle, last: bool):
    """Scan every text; ``hits`` (packed bits per word) and ``item_ids`` of an
    earlier slice of the benchmark, if there, are carried on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(handle)
        for batch in batches:
            carried = "hits" in batch.schema.names
            for lo, hi, offs, data in text_chunks(batch["text"]):
                raw = data.tobytes()
                n_words, n_hit, item_ids, hits, spans = [], [], [], [], []
                for i in range(hi - lo):
                    text = raw[offs[i]:offs[i + 1]]
                    found = normal_words(text)
                    hit, items = hit_words(found, automata)
                    if carried:
                        old = np.frombuffer(batch["hits"][lo + i].as_py(), np.uint8)
                        hit |= np.unpackbits(old, count=len(found)).astype(bool)
                        items |= set(batch["item_ids"][lo + i].as_py())
                    n_words.append(len(found))
                    n_hit.append(int(hit.sum()))
                    item_ids.append(sorted(x for x in items if x is not None))
                    if last:
                        spans.append([{"start": a, "end": b} for a, b in hit_spans(text, hit)])
                    else:
                        hits.append(np.packbits(hit).tobytes())
                columns = [batch["row_key"][lo:hi], batch["doc_id"][lo:hi], pa.array(n_words, pa.int64()),
                           pa.array(n_hit, pa.int64()), pa.array(item_ids, pa.list_(pa.string()))]
                names = ["row_key", "doc_id", "n_words", "n_hit", "item_ids"]
                if last:
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                    names.append("spans")
                else:
                    columns += [pa.array(hits, pa.binary()), batch["text"][lo:hi]]
                    names += ["hits", "text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


# Text of one slice; its windows are at most WINDOW times as much, and the nodes
# of its automaton at most one a byte of them.
SLICE_BYTES = 1 << 20


def slice_count(benchmark: DataFrame) -> int:
    """In how many slices the benchmark is scanned."""
    return int(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES + 1


def benchmark_slices(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The distinct items in slices of about SLICE_BYTES of text, one at a time,
    cut by a hash of the item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    n = slice_count(items)
    pick = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for s in range(n):
        yield [(r.item_id, r.text) for r in (items.where(pick == s) if n > 1 else items).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_windows: int = 500_000) -> DataFrame:
    """Per row of ``docs``: row_key, doc_id, n_words, n_hit, item_ids (items with an
    occurring window), spans (maximal runs of hit words, in code points)."""
    spark = docs.sparkSession
    out = spread(docs.select(doc_key().alias("row_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row_key binary, doc_id {kind}, n_words long, n_hit long, item_ids array<string>"
    ends, more = ", spans array<struct<start:bigint,end:bigint>>", ", hits binary, text string"
    slices = benchmark_slices(benchmark)
    items = next(slices)
    while items is not None:
        following = next(slices, None)
        blocks = spark.sparkContext.broadcast(window_blocks(items, window, max_windows))
        out = out.mapInArrow(giving_back(scan(blocks, following is None)), schema + (ends if following is None else more))
        if following is not None:
            out = stage(out, "benchmark-slice")
            blocks.unpersist()
        items = following
    return out


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, start, end, match: one row per maximal run of hit words, where it
    stands in the original text (code points, end exclusive) and what stands there."""
    found = contamination(docs, benchmark).where(F.size("spans") > 0).select("row_key", F.explode("spans").alias("s"))
    # rows that repeat doc_id and text repeat their spans: one of them is enough to look them up
    texts = docs.select(doc_key().alias("row_key"), "doc_id", "text")
    return (texts.join(found.distinct(), "row_key")
            .select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                    F.expr("substring(text, int(s.start) + 1, int(s.end - s.start))").alias("match")))


def contaminated():
    """The rule: any hit, and hit words at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark)
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay."""
    return anti_join_keys(docs, contamination(docs, benchmark).where(contaminated()).select("row_key").distinct())


SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
       FROM benchmark, up WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS win
        FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, up),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM dw),
ns AS (SELECT DISTINCT n FROM win),
cand AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM pos, ns WHERE i + n - 1 <= len(ws)),
hit AS (SELECT c.doc_id, c.i, c.n, w.item_id FROM cand c JOIN win w ON w.win = c.win AND w.n = c.n),
hw AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM hw GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
