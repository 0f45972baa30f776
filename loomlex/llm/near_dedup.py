"""Near-duplicate groups: one-permutation MinHash with optimal densification.

1. Each text's set of distinct word shingles is hashed once.  The hash's bin
   (``ROWS * BANDS`` bins) and the smallest hash per bin form the sketch; an
   empty bin borrows from a bin chosen by a fixed random walk (optimal
   densification), so short texts have full sketches too.
2. Texts with the same set are collapsed before anything else: a group of exact
   copies enters the search as one representative.
3. ``BANDS`` buckets of ``ROWS`` bins each.  In a bucket every member is paired
   with the bucket's centre only (a star), never with all others.  The centre is
   the member that meets most others over all its buckets.  At a similarity of
   0.8 a pair shares no bucket with probability (1 - 0.8**5)**32 = 3e-6.
4. Links are confirmed on the full sets, after a filter by set size.  In buckets
   that still hold several components, further centres are tried on the members
   outside their component (``CENTRES`` rounds).  What is still outside then is
   compared with all members of its buckets' components block by block, through
   an inverted index, without a row per pair.  So every two members of a bucket
   end in one component or were compared.
5. Components by smallest identifier (hooking and pointer jumping on tables).

Defined cases: null or blank text has an empty set and is linked with nothing;
a text with fewer words than a shingle has its whole sequence as the one
shingle; equal sets are linked; ``component_id`` is the smallest doc_id, so rows
that repeat a doc_id fall together; a null doc_id is its own component and is
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.llm.arrays import LOWER, giving_back, gram_hashes, mix, text_chunks, word_hashes, words
from loomlex.llm.common import partitions, spread, stage

ROWS, BANDS = 5, 32
CENTRES = 2
THRESHOLD_PERCENT = 80


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int):
    """Per text: sorted distinct 64-bit hashes of its ``n``-word shingles."""
    starts, ends, first = words(data, offs)
    h = word_hashes(LOWER[data], starts, ends)
    grams = gram_hashes(h, n)
    for d in range(len(offs) - 1):
        lo, hi = int(first[d]), int(first[d + 1])
        if hi - lo >= n:
            yield np.unique(grams[lo:hi - n + 1])
        elif hi > lo:
            # a whole shorter sequence; its length keeps it apart from true shingles
            yield mix(gram_hashes(h[lo:hi], hi - lo) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def _walk(bins: int, attempts: int) -> np.ndarray:
    """Where an empty bin looks at each attempt: fixed, the same in every worker."""
    return np.random.default_rng(977).integers(0, bins, (attempts, bins))


_WALK = _walk(ROWS * BANDS, 64 * ROWS * BANDS)


def sketch(found: np.ndarray, bins: int = ROWS * BANDS) -> np.ndarray:
    """Smallest hash per bin of a sorted, non-empty set; empty bins are densified."""
    where = ((found >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    lead = np.flatnonzero(np.diff(where, prepend=-1))
    out = np.zeros(bins, np.uint64)
    full = np.zeros(bins, dtype=bool)
    out[where[lead]] = found[lead]
    full[where[lead]] = True
    empty = np.flatnonzero(~full)
    step = 0
    while len(empty):
        if step < len(_WALK):
            source = _WALK[step][empty]
        else:  # practically never reached; ends the walk with the first full bin
            source = np.full(len(empty), where[0])
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
        step += 1
    return out


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offs, data in text_chunks(batch["text"]):
                sizes, a, b, bands = [], [], [], []
                for found in shingle_sets(data, offs, n):
                    sizes.append(len(found))
                    if not len(found):
                        a.append(None)
                        b.append(None)
                        bands.append(None)
                        continue
                    # two independent sums over the set stand for the whole set
                    a.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    rows = sketch(found).reshape(BANDS, ROWS)
                    key = np.zeros(BANDS, np.uint64)
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
                    bands.append((key + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][lo:hi], pa.array(sizes, pa.int64()), pa.array(a, pa.int64()),
                     pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])
    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offs, data in text_chunks(batch["text"]):
                found = [x.tobytes() for x in shingle_sets(data, offs, n)]
                yield pa.RecordBatch.from_arrays([batch["rep"][lo:hi], pa.array(found, pa.binary())],
                                                 names=["rep", "shingles"])
    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["set_x"], batch["set_y"], strict=True):
                a = np.frombuffer(x.as_buffer(), np.uint64)
                b = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["hub"].filter(keep), batch["rep"].filter(keep)],
                                             names=["hub", "rep"])
    return run


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, label): smallest rep reachable, for every rep of ``nodes``.

    Each round hooks every node's label to the smallest label among its
    neighbours and then jumps to the label's label; ends when nothing changes.
    """
    both = stage(edges.select("hub", "rep").union(edges.select("rep", "hub")).distinct(), "near-links")
    labels = nodes.select("rep", F.col("rep").alias("label"))
    near = both.groupBy("rep").agg(F.min("hub").alias("label"))
    labels = stage(labels.join(near.withColumnRenamed("label", "other"), "rep", "left")
                   .select("rep", F.least("label", "other").alias("label")), "near-labels")
    while True:
        low = (both.join(labels.select(F.col("rep").alias("hub"), "label"), "hub")
               .groupBy("rep").agg(F.min("label").alias("other")))
        hooked = labels.join(low, "rep", "left").select("rep", "label", F.least("label", "other").alias("new"))
        jump = labels.select(F.col("rep").alias("new"), F.col("label").alias("next"))
        after = stage(hooked.join(jump, "new", "left")
                      .select("rep", F.least("new", "next").alias("label"),
                              (F.least("new", "next") < F.col("label")).alias("moved")), "near-labels")
        moved = not after.where("moved").isEmpty()
        labels = after.select("rep", "label")
        if not moved:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after new links: only the components that they connect are searched."""
    name = {c: labels.select(F.col("rep").alias(c), F.col("label").alias(f"{c}_label")) for c in ("hub", "rep")}
    between = stage(links.join(name["hub"], "hub").join(name["rep"], "rep")
                    .select(F.col("hub_label").alias("hub"), F.col("rep_label").alias("rep"))
                    .where("hub <> rep").distinct(), "near-between")
    if between.isEmpty():
        return labels
    ends = between.select("rep").union(between.select("hub")).distinct()
    low = components(ends, between).select(F.col("rep").alias("label"), F.col("label").alias("low"))
    return stage(labels.join(low, "label", "left").select("rep", F.coalesce("low", "label").alias("label")), "near-labels")


def near_groups(docs: DataFrame, shingle_words: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    source = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(source.mapInArrow(
        giving_back(_sketches(shingle_words)), f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>"),
        "near-sketches")
    same = ["set_a", "set_b", "n_shingles"]
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets have equal bands: one representative per task and set is shuffled
    reps = stage(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-reps")
    member = known.select("doc_id", *same).join(reps.select(*same, "rep"), same)
    keys = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stage(keys.join(full, "key"), "near-buckets")
    weight = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    buckets = stage(met.select("key", "rep", "n").join(weight, "rep"), "near-buckets")
    nodes = stage(buckets.select("rep").distinct(), "near-nodes")
    text = source.withColumnRenamed("doc_id", "rep").join(nodes, "rep", "left_semi")
    sets = stage(text.mapInArrow(giving_back(_sets(shingle_words)), f"rep {kind}, shingles binary"), "near-sets")

    labels = nodes.select("rep", F.col("rep").alias("label"))
    checked = used = None
    for step in range(CENTRES):
        now = buckets.join(labels, "rep")
        if step:
            split = now.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
            now = stage(now.join(split.select("key"), "key", "left_semi"), "near-split")
            if now.isEmpty():
                break
            buckets = now.drop("label")
        free = now if used is None else now.join(used, ["key", "rep"], "left_anti")
        hubs = _centres(free)
        done = hubs.select("key", F.col("hub").alias("rep"))
        used = stage(done if used is None else used.union(done), "near-used")
        small, large = F.least("n", "hub_n"), F.greatest("n", "hub_n")
        stars = (now.join(hubs, "key").where((F.col("label") != F.col("hub_label")) & (100 * small >= percent * large))
                 .select(F.least("hub", "rep").alias("hub"), F.greatest("hub", "rep").alias("rep")).distinct())
        if checked is not None:
            stars = stars.join(checked, ["hub", "rep"], "left_anti")
        stars = stage(stars, "near-stars")
        checked = stars if checked is None else checked.union(stars)
        labels = merged(labels, stage(confirm(stars, sets, percent, kind), "near-links"))
    labels = merged(labels, leftover_links(buckets.join(labels, "rep"), sets, percent, kind))
    of = (member.select("doc_id", "n_shingles", "rep").join(labels, "rep", "left")
          .select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id")))
    rest = rows.where("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return of.union(rest).select("doc_id", "n_shingles", "component_id",
                                 F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


BLOCK_SETS = 2048


def _blocks(percent: int):
    """Compare the outsiders (role 1) of each block with its sets (role 0, sorted
    first) through an inverted index; one link per outsider and component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reps, labels, sizes, held, index = None, [], [], [], [], None
        for batch in batches:
            hubs, others = [], []
            columns = [batch[c].to_pylist() for c in ("main", "salt", "role", "rep", "label")]
            for main, salt, role, rep, label, raw in zip(*columns, batch["shingles"], strict=True):
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                if (main, salt) != block:
                    block, reps, labels, sizes, held, index = (main, salt), [], [], [], [], None
                if role == 0:
                    reps.append(rep)
                    labels.append(label)
                    sizes.append(len(found))
                    held.append(found.copy())
                    continue
                if not held:
                    continue
                if index is None:
                    values = np.concatenate(held)
                    order = np.argsort(values, kind="stable")
                    index = values[order], np.repeat(np.arange(len(held)), sizes)[order], np.array(sizes)
                values, owner, size = index
                lo, hi = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(owner[at], minlength=len(size))
                close = np.flatnonzero((both > 0) & (100 * both >= percent * (size + len(found) - both)))
                linked = {labels[i]: reps[i] for i in close.tolist() if labels[i] != label}
                hubs += [rep] * len(linked)
                others += linked.values()
            kind = batch["rep"].type
            yield pa.RecordBatch.from_arrays([pa.array(hubs, kind), pa.array(others, kind)], names=["hub", "rep"])
    return run


def leftover_links(members: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links of the members that the centres left outside.

    Buckets with several components are grouped by the component of their centre.
    A group's sets are dealt to blocks of about ``BLOCK_SETS``; the outsiders go to
    every block of their group.  What is shuffled grows with the sets and with
    outsiders times blocks, and no pair of texts ever becomes a row unless linked.
    """
    spread_out = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    now = stage(members.join(spread_out.select("key"), "key", "left_semi"), "near-split")
    main = _centres(now).select("key", F.col("hub_label").alias("main"))
    inside = stage(now.join(main, "key").select("main", "rep", "label").distinct(), "near-groups")
    blocks = inside.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    dealt = inside.join(blocks, "main").join(sets, "rep")
    own = dealt.select("main", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("salt"), F.lit(0).alias("role"),
                       "rep", "label", "shingles")
    outside = dealt.where("label <> main").select(
        "main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(1).alias("role"),
        "rep", "label", "shingles")
    rows = own.union(outside)
    return stage(rows.repartition(partitions(members.sparkSession), "main", "salt").sortWithinPartitions("main", "salt", "role")
                 .mapInArrow(_blocks(percent), f"hub {kind}, rep {kind}"), "near-links")


def _centres(members: DataFrame) -> DataFrame:
    """(key, hub, hub_n, hub_label): per bucket the member of the largest weight."""
    best = F.max(F.struct("weight", "rep", "n", "label")).alias("h")
    return members.groupBy("key").agg(best).select(
        "key", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label"))


def confirm(stars: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """The stars whose full sets are similar enough."""
    pairs = (stars.join(sets.select("rep", F.col("shingles").alias("set_y")), "rep")
             .join(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("set_x")), "hub"))
    return pairs.select("hub", "rep", "set_x", "set_y").mapInArrow(_similar(percent), f"hub {kind}, rep {kind}")


def drop_near_copies(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; all columns stay."""
    gone = near_groups(docs, shingle_words).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                                          ELSE ws END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS h FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
rep AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS rep FROM sets),
r AS (SELECT s.sh, s.doc_id AS rep, p.n FROM s JOIN rep p ON p.doc_id = s.doc_id AND p.rep = p.doc_id),
pair AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM r a JOIN r b ON a.sh = b.sh AND a.rep < b.rep
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * k >= 80 * (na + nb - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS rep, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(rep.n, 0) AS n_shingles, coalesce(comp.c, rep.rep, d.doc_id) AS component_id,
       d.doc_id = coalesce(comp.c, rep.rep, d.doc_id) AS kept
FROM documents d LEFT JOIN rep USING (doc_id) LEFT JOIN comp ON comp.rep = rep.rep
"""
