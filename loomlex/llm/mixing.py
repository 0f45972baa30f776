"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place on a line of hashes.  Per source, words are summed by
hash bucket; the running sums show in which bucket the source's budget ends.
Only that bucket is opened again, by the next bits of the hash, until it holds
one row or the budget ends on an edge.  The budget is then a threshold, and the
documents below it are found by a filter: nothing is sorted or ranked.  Budgets
are nested: what a smaller budget takes, a larger one takes too.

A budget above a source's size is whole passes over the source plus a threshold
for the rest.  Documents are taken whole, and the rest ends on the document edge
nearest to it.

Defined cases: null text counts as empty and has size 0; null is a source of its
own, after all others; empty texts take nothing; rows that repeat doc_id and text
share their hashes and are told apart by a row number, so that exactly as many of
them are taken as the budget holds; an empty table gives no rows; a table without
any word has targets of 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlex.llm.common import stage
from loomlex.operators.ids import dense_ids
from loomlex.operators.joins import join_bounded

WORD = r"[^\x20\x09-\x0D]+"

# The line of hashes: two words of 60 bits from the MD5 of doc_id and text, then
# the row number.  A bucket is opened DIGIT bits at a time.
DIGIT = 12
PLACE = {"h1": 60, "h2": 60, "h3": 72}
LEVELS = [(word, shift) for word, bits in PLACE.items() for shift in range(bits - DIGIT, -1, -DIGIT)]

SOURCE = ["no_source", "source_key"]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place on the line of hashes) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))
    return docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), mark.alias("mark")).select(
        "doc_id", *SOURCE, "size", F.conv(F.substring("mark", 1, 15), 16, 10).cast("long").alias("h1"),
        F.conv(F.substring("mark", 16, 15), 16, 10).cast("long").alias("h2"),
        F.monotonically_increasing_id().alias("h3"))


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt to the sources by
    weight (sources in code-point order, ``weights`` repeating); a target above
    ``most`` times its source stops there and the excess is dealt again by weight.

    Each round is one aggregate of the sources; the level (words per weight) only
    rises and every round but the last stops at least one more source."""
    sizes = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    turn = F.col("place") % len(weights)
    table = stage(dense_ids(sizes, SOURCE, "place").withColumn("turn", turn.cast("int")), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)
    cap = F.lit(float(most)) * F.col("source_size")
    level = None
    while True:
        over = F.lit(False) if level is None else cap < F.lit(level) * weight
        got = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size"))).alias("stopped"),
            *[F.count(F.when(~over & (F.col("turn") == i), 1)).alias(f"n{i}") for i in range(len(weights))]).first()
        free = sum(got[f"n{i}"] * float(w) for i, w in enumerate(weights))
        if not free:  # every source stopped
            return table.select(*SOURCE, "source_size", cap.alias("target"))
        new = (share * (got["all"] or 0) - most * (got["stopped"] or 0)) / free
        if new == level:
            return table.select(*SOURCE, "source_size",
                                F.when(over, cap).otherwise(F.lit(level) * weight).alias("target"))
        level = new


def _digit(word: str, shift: int) -> Column:
    return F.shiftrightunsigned(F.col(word), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the place (t1, t2, t3) below which its ``budget`` words lie.

    A level sums the open buckets' rows by source and digit, a histogram of at most
    ``2**DIGIT`` rows a source whatever the source's size; its rows alone are
    ordered.  ``left`` is the part of the budget that the open bucket has to hold."""
    state = budgets.select(*SOURCE, F.col("budget").alias("left"), *[
        F.lit(0).cast("long").alias(t) for t in ("t1", "t2", "t3")])
    closed = []
    for word, shift in LEVELS:
        edge = word.replace("h", "t")
        step = F.lit(1 << shift).cast("long")
        hist = rows.groupBy(*SOURCE, _digit(word, shift).alias("digit")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("words").over(Window.partitionBy(*SOURCE).orderBy("digit")
                                   .rowsBetween(Window.unboundedPreceding, 0))
        hist = join_bounded(hist.withColumn("upto", upto), state, SOURCE)
        before = F.col("upto") - F.col("words")
        full = F.col("upto") <= F.col("left")
        cut = (before < F.col("left")) & ~full
        found = hist.groupBy(*SOURCE, "left", "t1", "t2", "t3").agg(
            F.max(F.when(full, F.col("digit"))).alias("full"), F.max(F.when(cut, F.col("digit"))).alias("cut"),
            F.max(F.when(cut, before)).alias("before"), F.max(F.when(cut, F.col("words"))).alias("words"),
            F.max(F.when(cut, F.col("n"))).alias("n"))
        rest = F.col("left") - F.coalesce("before", F.lit(0))
        one = (F.col("n") == 1) & F.col("cut").isNotNull()
        # a single row is taken if that brings the sum nearer to the budget
        digit = F.when(F.col("cut").isNull(), F.coalesce(F.col("full") + 1, F.lit(0))) \
            .when(one & (2 * rest >= F.col("words")), F.col("cut") + 1).otherwise(F.col("cut"))
        found = stage(found.select(
            *SOURCE, "cut", (F.col("cut").isNotNull() & ~one).alias("open"), rest.alias("left"),
            *[(F.col(t) + digit * step if t == edge else F.col(t)).alias(t) for t in ("t1", "t2", "t3")]), "mix-cuts")
        closed.append(found.where(~F.col("open")).select(*SOURCE, "t1", "t2", "t3"))
        state = found.where("open")
        if state.isEmpty():
            break
        rows = stage(join_bounded(
            rows.withColumn("digit", _digit(word, shift)),
            state.select(*SOURCE, F.col("cut").alias("digit")), [*SOURCE, "digit"]).drop("digit"), "mix-open")
        state = state.drop("cut", "open")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    ``copies`` is how often the mix repeats the document, ``taken`` its words with
    the repeats counted; ``share`` is the length of the mix in lengths of all
    documents, ``most`` the largest target of a source in lengths of the source."""
    rows = stage(sized(docs), "mix-sizes")
    targets = source_targets(rows, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = stage(targets.withColumn("passes", passes.cast("long"))
                    .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    cuts = thresholds(rows, targets)
    plan = stage(targets.join(cuts, SOURCE), "mix-plan")
    below = (F.col("h1") < F.col("t1")) | ((F.col("h1") == F.col("t1")) & (
        (F.col("h2") < F.col("t2")) | ((F.col("h2") == F.col("t2")) & (F.col("h3") < F.col("t3")))))
    copies = F.col("passes") + below.cast("long")
    return join_bounded(rows, plan, SOURCE).select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 30) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
q AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER before, 0) AS stopped, coalesce(sum(weight) OVER before, 0.0) AS gone
  FROM s WINDOW before AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - 2.0::DOUBLE * CAST(stopped AS DOUBLE)) / (weights - gone) AS level
  FROM q),
t AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size,
               weight * (SELECT max(level) FROM l WHERE level * weight <= 2.0::DOUBLE * source_size)) AS target
  FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (
  SELECT d.*, source_size, target, passes, target - passes * source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (passes + CASE WHEN before + size / 2.0 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
