"""Repeated word windows removed: a count-min prefilter, then exact grouping.

Equal windows contain the same smallest 12-word gram at the same place (their
anchor), so a window occurs no more often than its anchor does.

Pass 1 counts anchors in a count-min sketch: every task packs the cells it
touched, equal cells of all partitions are added up, and the cells with a total
of two or more come back as two bitmaps whose size is fixed by ``log2_cells``
(16 MB each at the default).  The sketch only overestimates, so a window whose
anchor is estimated below two cannot be repeated.

Pass 2 groups exactly the windows estimated repeated: their 64-bit hashes travel
in runs that share an anchor, keyed by the anchor, and two windows are equal if
both 64-bit hashes agree.  Runs that are equal within one task's chunk travel
once with their count, so a passage found in a third of all rows reaches its
reducer at most once per chunk.  An anchor with more than ``HOT`` such windows (a
phrase in a third of all rows, say, with different words around it) is split: its
windows travel one by one, keyed by anchor and window hash, so that only equal
windows meet.  The windows per anchor are counted exactly beforehand.  On larger inputs the sketch gets less selective;
results stay the same, only more windows are grouped.

Defined cases: null text has no words; windows never cross documents; rows that
repeat doc_id and text count as two documents with the same result; texts
shorter than a window lose nothing; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.llm.arrays import (
    gram_hashes, joined_bytes, key_column, key_longs, key_values, merge_spans, minimiser, mix, text_chunks, window_starts,
    word_hashes, words)
from loomlex.llm.common import keyed_docs, partitions, spread

WINDOW, GRAM = 35, 12
HOT = 1 << 19  # windows of one anchor beyond which they are spread by their own hash
BLOCK = 16  # a block of the sketch has 2**BLOCK cells
_SEEDS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x2545F4914F6CDD1D))


def cells(anchors: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    """Cell of each anchor in one row of the sketch."""
    return (mix(anchors ^ _SEEDS[row]) >> np.uint64(64 - log2_cells)).astype(np.int64)


def windows_of(data: np.ndarray, offs: np.ndarray, window: int, gram: int):
    """(word counts, word hashes, window starts, anchor place per window, gram hashes)."""
    starts, ends, first = words(data, offs)
    h = word_hashes(data, starts, ends)
    lengths = np.diff(first)
    at = window_starts(lengths, window)
    grams = gram_hashes(h, gram)
    place = minimiser(grams, window - gram + 1)
    return first, h, at, place[at] if len(at) else at, grams


def sketch_anchors(find, log2_cells: int):
    """Pack the sketch cells of all anchors of a partition, block by block.

    ``find`` gives the distinct anchor hashes' occurrences of one chunk of texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for _, _, offs, data in text_chunks(batch["text"]):
                found.append(find(data, offs))
            anchors = np.concatenate(found)
            if not len(anchors):
                continue
            out = {"row": [], "block": [], "once": [], "more": []}
            for row in range(len(_SEEDS)):
                cell, n = np.unique(cells(anchors, row, log2_cells), return_counts=True)
                lead = np.flatnonzero(np.diff(cell >> BLOCK, prepend=-1))
                for lo, hi in zip(lead, [*lead[1:], len(cell)], strict=True):
                    low = (cell[lo:hi] & ((1 << BLOCK) - 1)).astype(np.uint16)
                    out["row"].append(row)
                    out["block"].append(int(cell[lo]) >> BLOCK)
                    out["once"].append(low[n[lo:hi] == 1].tobytes())
                    out["more"].append(low[n[lo:hi] > 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["row"], pa.int32()), pa.array(out["block"], pa.int32()),
                 pa.array(out["once"], pa.binary()), pa.array(out["more"], pa.binary())], names=list(out))
    return run


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the cells of equal blocks; bitmap of those with two or more."""
    def bitmap(row, block, total):
        bits = np.packbits(total > 1).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()),
                                           pa.array([bits], pa.binary())], names=["row", "block", "bits"])
    key, total = None, None
    for batch in batches:
        for row, block, once, more in zip(*(batch[c] for c in ("row", "block", "once", "more")), strict=True):
            now = (row.as_py(), block.as_py())
            if now != key:
                if key is not None and (total > 1).any():
                    yield bitmap(*key, total)
                key, total = now, np.zeros(1 << BLOCK, np.uint8)
            a, b = (np.frombuffer(x.as_buffer(), np.uint16) for x in (once, more))
            total[a] = np.minimum(total[a] + 1, 2)
            total[b] = 2
    if key is not None and (total > 1).any():
        yield bitmap(*key, total)


def word_anchors(window: int, gram: int):
    def find(data, offs):
        _, _, _, place, grams = windows_of(data, offs, window, gram)
        return grams[np.unique(place)] if len(place) else np.zeros(0, np.uint64)
    return find


def repeated_cells(docs: DataFrame, find, log2_cells: int) -> list[np.ndarray]:
    """The two bitmaps of cells counted at least twice over all documents."""
    packed = docs.mapInArrow(sketch_anchors(find, log2_cells), "row int, block int, once binary, more binary")
    merged = (packed.repartition(partitions(docs.sparkSession), "row", "block")
              .sortWithinPartitions("row", "block")
              .mapInArrow(_merge_blocks, "row int, block int, bits binary"))
    maps = [np.zeros(1 << log2_cells >> 3, np.uint8) for _ in _SEEDS]
    size = 1 << BLOCK >> 3
    for r in merged.collect():  # at most two bitmaps of fixed size
        maps[r.row][r.block * size:(r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return maps


def estimated_repeated(anchors: np.ndarray, maps: list[np.ndarray], log2_cells: int) -> np.ndarray:
    ok = np.ones(len(anchors), dtype=bool)
    for row, bits in enumerate(maps):
        cell = cells(anchors, row, log2_cells)
        ok &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return ok


def hot_keys(docs: DataFrame, find, size, limit: int) -> np.ndarray:
    """Sorted anchors whose runs (of ``find``, without marks) add up to more than ``limit``;
    ``size`` gives a run's size from its number of windows.  At most total size /
    ``limit`` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in find(batches):
            real = batch.filter(pc.not_equal(batch["kind"], 1))
            key, which = np.unique(real["key"].to_numpy(), return_inverse=True)
            total = np.bincount(which, size(real["n"].to_numpy()), minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total.astype(np.int64))], names=["key", "size"])

    sizes = docs.mapInArrow(run, "key long, size long").groupBy("key").agg(F.sum("size").alias("size"))
    found = [r.key for r in sizes.where(F.col("size") > limit).select("key").collect()]
    return np.sort(np.array(found, dtype=np.int64).view(np.uint64))


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def joined_marks(at: np.ndarray, n: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first run, windows) of marked runs, those that follow each other as one."""
    if not len(marks):
        return marks, n[marks]
    lead = np.flatnonzero(np.append(True, at[marks[1:]] != at[marks[:-1]] + n[marks[:-1]]))
    return marks[lead], np.add.reduceat(n[marks], lead)


def _candidates(handle, window: int, gram: int, log2_cells: int, hot: np.ndarray):
    """Runs of windows with a common anchor: (kind, key, row_key, start, n, hashes).

    kind 0: one run; kind 1: windows already known to be repeated (spread by
    document); kind 2: an equal run stands for several, all of them known.
    Windows of a hot anchor are runs of their own, keyed by anchor and window.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = key_values(batch["row_key"])
            for lo, hi, offs, data in text_chunks(batch["text"], 4 << 20):
                first, h, at, place, grams = windows_of(data, offs, window, gram)
                if not len(at):
                    continue
                keep = estimated_repeated(grams[place], handle.value, log2_cells)
                at, place = at[keep], place[keep]
                if not len(at):
                    continue
                wins = gram_hashes(h, window)[at]
                single = among(grams[place], hot)
                cut = (np.diff(at, prepend=-2) != 1) | (np.diff(place, prepend=-1) != 0) | single
                lead = np.flatnonzero(cut)
                n = np.diff(np.append(lead, len(at)))
                anchor = grams[place[lead]]
                anchor = np.where(single[lead], mix(anchor ^ wins[lead]), anchor).view(np.int64)
                doc = np.searchsorted(first, at[lead], side="right") - 1
                start = at[lead] - first[doc]
                # equal runs within the chunk: same anchor and same windows
                whole = mix(np.add.reduceat(wins * np.uint64(3) + np.uint64(1), lead) + n.astype(np.uint64))
                _, rep, count = np.unique(np.stack([anchor.view(np.uint64), whole]), axis=1,
                                          return_index=True, return_counts=True)
                solo = np.zeros(len(lead), dtype=bool)
                solo[rep[count == 1]] = True
                stand = np.zeros(len(lead), dtype=bool)
                stand[rep[count > 1]] = True
                raw = wins.tobytes()
                rows = np.flatnonzero(solo | stand)
                hashes = [raw[8 * lead[i]:8 * (lead[i] + n[i])] for i in rows]
                marks, covered = joined_marks(at[lead], n, np.flatnonzero(~solo))
                blank = [b""] * len(marks)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.where(stand[rows], 2, 0), np.ones(len(marks), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([anchor[rows], key_longs(keys[lo + doc[marks]])])),
                    key_column(keys[lo + np.concatenate([doc[rows], doc[marks]])]),
                    pa.array(np.concatenate([start[rows], start[marks]])),
                    pa.array(np.concatenate([n[rows], covered])),
                    pa.array(hashes + blank, pa.binary())],
                    names=["kind", "key", "row_key", "start", "n", "hashes"])
    return run


def _exact(window: int):
    """Group the windows of each anchor exactly; yield covered word spans.

    Rows come sorted by anchor; whole anchors are gathered until about 2**19
    windows are there; hot anchors come split, so no group is much larger.
    """
    def spans(rows):
        kind = np.concatenate([r[0] for r in rows])
        anchor = np.concatenate([r[1] for r in rows])
        doc = np.concatenate([r[2] for r in rows])
        start = np.concatenate([r[3] for r in rows])
        n = np.concatenate([r[4] for r in rows])
        wins = np.concatenate([r[5] for r in rows])
        mark = kind == 1
        out = [(doc[mark], start[mark], start[mark] + n[mark] + window - 1)]
        real = ~mark
        kind, anchor, doc, start, n = (x[real] for x in (kind, anchor, doc, start, n))
        if len(n):
            run = np.repeat(np.arange(len(n)), n)
            base = np.cumsum(n) - n
            offset = np.arange(len(wins)) - base[run]
            order = np.lexsort((wins, anchor[run]))
            w, a = wins[order], anchor[run][order]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1])
            group = np.cumsum(new) - 1
            weight = np.bincount(group, np.where(kind[run][order] == 2, 2, 1))
            again = np.zeros(len(w), dtype=bool)
            again[order] = weight[group] > 1
            again &= kind[run] == 0  # what a stand-in stands for is marked already
            # neighbours of one run that are both repeated make one span
            joined = again.copy()
            joined[1:] &= ~(again[:-1] & (run[1:] == run[:-1]))
            head = np.flatnonzero(joined)
            tail = again.copy()
            tail[:-1] &= ~(again[1:] & (run[1:] == run[:-1]))
            end = np.flatnonzero(tail)
            out.append((doc[run[head]], start[run[head]] + offset[head],
                        start[run[end]] + offset[end] + window))
        d, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([key_column(d), pa.array(s), pa.array(e)], names=["row_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key = batch["key"].to_numpy()
            cols = [batch[c].to_numpy() for c in ("kind", "key", "start", "n")]
            cols.insert(2, key_values(batch["row_key"]))
            n = cols[4]
            wins = np.frombuffer(joined_bytes(batch["hashes"]), np.uint64)
            held.append([*cols, wins])
            size += len(wins)
            if size > 1 << 19 and key[0] != key[-1]:
                # the last anchor may go on in the next batch: hold it back
                cut = int(np.searchsorted(key, key[-1]))
                real = int(n[:cut][cols[0][:cut] != 1].sum())
                rest = [[*(c[cut:] for c in cols), wins[real:]]]
                held[-1] = [*(c[:cut] for c in cols), wins[:real]]
                yield spans(held)
                held, size = rest, len(rest[0][5])
        if held:
            yield spans(held)
    return run


def _removal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            found = text.as_buffer().to_pybytes().split()
            n_words.append(len(found))
            if spans.is_valid and len(spans):
                flat = spans.values
                gone = merge_spans(flat.field(0).to_numpy(), flat.field(1).to_numpy(), len(found))
                n_removed.append(int(gone.sum()))
                found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
            else:
                n_removed.append(0)
            digests.append(hashlib.sha256(b" ".join(found)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def candidates(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, log2_cells: int = 27, hot: int = HOT) -> DataFrame:
    """Runs of the windows estimated repeated, keyed by anchor (hot ones by window)."""
    maps = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, word_anchors(window, gram), log2_cells))

    def find(split):
        return _candidates(maps, window, gram, log2_cells, split)
    split = hot_keys(docs, find(np.zeros(0, np.uint64)), lambda n: n, hot)
    return docs.mapInArrow(find(split), "kind int, key long, row_key binary, start long, n long, hashes binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, log2_cells: int = 27,
                   hot: int = HOT) -> DataFrame:
    """(row_key, start, end): word spans covered by windows that start more than once.

    ``docs`` is (row_key, text).
    """
    rows = candidates(docs, window, gram, log2_cells, hot)
    return (rows.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key")
            .mapInArrow(_exact(window), "row_key binary, start long, end long"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    source = spread(keyed_docs(docs))
    spans = repeated_spans(source.select("row_key", "text"))
    by_doc = spans.groupBy("row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (source.join(by_doc, "row_key", "left").select("doc_id", "text", "spans")
            .mapInArrow(_removal, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
hs AS (SELECT doc_id, list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' '))) AS hs FROM w),
win AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM hs),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM rep)),
cov AS (SELECT p.doc_id, p.i, word, max(CASE WHEN s.i IS NOT NULL THEN 1 ELSE 0 END)
          OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
        FROM p LEFT JOIN starts s ON s.doc_id = p.doc_id AND s.i = p.i),
agg AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
               string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""
