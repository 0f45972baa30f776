r"""Personal data: base patterns, then bootstrapped contextual extraction (DataFrame functions only).

1. Base spans per kind by regular expressions, leftmost and non-overlapping, with
   checks (octets, Luhn, digit counts); positions are running sums of the lengths
   of what lies between matches, one row per match.
2. Instances are whole identifiers: runs of non-blanks with a digit or ``@``, or digit
   groups joined by blanks, brackets, dots and hyphens, without the punctuation around
   them.  An instance that a base span touches is a seed of that kind and stands for
   the whole base span; one that begins inside a base span is part of it.  A pattern is
   the two words before the instance within ``CONTEXT`` characters together with the
   instance's coarse form (address sign, digit count, dots).
3. The pattern-instance graph has one edge per pattern and distinct value.  Seeds score
   1 for their kind; a pattern's score for a kind is the sum of its values' scores over
   the number of its values plus ``SMOOTHING``.  A pattern is accepted with a score of
   ``ACCEPT`` or more (about half of its values) and ``SUPPORT`` values known to be of
   the kind.  Other values take the best score of the accepted patterns they occur in
   and so support further patterns.  Scores only rise, and rounds go on until the
   accepted patterns stay the same.
4. Every instance without a base span in an accepted pattern gets the pattern's kind (of
   several the best score's, then the first by name).  Counts cover all documents.

The possessive quantifiers keep the scans linear and free of recursion on long
texts.  Defined cases: null text is empty; rows that repeat doc_id and text get
the same result each; documents without a span have zero counts and digests of
the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlex.llm.common import doc_key, stage

KINDS = ["email", "ip", "card", "phone"]
LOCAL, LABEL = r"A-Za-z0-9._%+\-", r"A-Za-z0-9\-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that any match passes.
NEEDS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
         "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+")}
BLANK = r"\x20\x09-\x0D"
_GROUP = rf"""[0-9][0-9().\-]*+(?=[,;:!?\]}}"']*+(?:[{BLANK}]|\z))"""  # digits up to the end of a word
TOKEN = (rf"(?<![^{BLANK}])(?:[+(]{{0,2}}+{_GROUP}(?:\x20{{1,2}}+[(]?+{_GROUP})*+"
         rf"|[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+)")
HEAD, TAIL = "\"'<[{,;:=*_", ".,;:!?\"'>]}*_"  # not part of an identifier at its ends
CONTEXT, ACCEPT, SUPPORT, SMOOTHING = 80, 0.5, 5, 1.0


def _octets(match: Column) -> Column:
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))

    def add(total, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def valid(kind: Column, match: Column) -> Column:
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", _octets(match))
            .when(kind == "card", _luhn(match)).otherwise(_phone(match)))


def scan(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(uid, row_key, kind, start, end, match, before) of every match of every pattern.

    A text is cut by ``(gap)(match or end)``; gaps and matches alternate, so a
    running sum of their lengths gives code point positions.
    """
    piece = "array<struct<kind:string,gap:int,size:int,before:string,match:string>>"

    def cut(kind):
        regex = rf"(?s)(.*?)({patterns[kind]}|\z)"
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(regex), F.lit(1)).alias("gap"),
                            F.regexp_extract_all("text", F.lit(regex), F.lit(2)).alias("match"))
        need = NEEDS[kind](F.col("text")) if kind in NEEDS else F.col("text").rlike("[0-9@]")
        pieces = F.transform(both, lambda x: F.struct(
            F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"),
            F.substring(x["gap"], -CONTEXT, CONTEXT).alias("before"), x["match"].alias("match")))
        return F.when(need, pieces).otherwise(F.array().cast(piece))

    rows = texts.select("uid", "row_key", F.posexplode(F.concat(*[cut(k) for k in patterns])).alias("at", "m"))
    order = Window.partitionBy("uid", "m.kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(order)
    return (rows.withColumn("end", end).where("m.size > 0")
            .select("uid", "row_key", F.col("m.kind").alias("kind"), (F.col("end") - F.col("m.size")).alias("start"),
                    "end", F.col("m.match").alias("match"), F.col("m.before").alias("before")))


def form(match: Column) -> Column:
    """Coarse form of an identifier: an address sign, or how many digits and dots."""
    digits = F.length(_digits(match))
    return (F.when(match.contains("@"), "@")
            .otherwise(F.concat(F.when(digits < 4, "few").when(digits < 9, "some").otherwise("many"),
                                F.when(match.rlike(r"[0-9]\.[0-9]"), ".").otherwise(""))))


def trimmed(match: Column) -> tuple[Column, Column]:
    """(identifier, characters before it): ``match`` without quotes, commas and
    the like at its ends, and without brackets that only enclose it."""
    core = F.rtrim(F.ltrim(match, F.lit(HEAD)), F.lit(TAIL))
    opens = core.startswith("(") & (core.endswith(")") | ~core.contains(")"))
    closes = core.endswith(")") & (core.startswith("(") | ~core.contains("("))
    skip = F.length(match) - F.length(F.ltrim(match, F.lit(HEAD))) + opens.cast("int")
    core = F.substr(core, opens.cast("int") + 1, F.length(core) - opens.cast("int") - closes.cast("int"))
    return F.rtrim(core, F.lit(TAIL)), skip


def instances(base: DataFrame, tokens: DataFrame) -> DataFrame:
    """(row_key, start, end, value, form, pattern, seed) of every identifier with two
    words before it; ``seed`` is the kind of a touching base span (null: unseen)."""
    is_base = F.col("kind") != "token"
    events = base.select("uid", "row_key", "kind", "start", "end", "match", F.lit("").alias("before")).union(
        tokens.select("uid", "row_key", "kind", "start", "end", "match", "before"))
    upto = Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("uid").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = (events.withColumn("last", F.max(F.when(is_base, F.struct("end", "start", "kind", "match"))).over(upto))
            .withColumn("next", F.last(F.when(is_base, F.struct("start", "kind", "match")), ignorenulls=True).over(down))
            .where("kind = 'token'"))
    inside = F.coalesce(F.col("last.end") > F.col("start"), F.lit(False))
    span = (F.when(inside, F.struct(F.col("last.kind").alias("kind"), F.col("last.match").alias("match")))
            .when(F.col("next.start") < F.col("end"), F.struct(F.col("next.kind"), F.col("next.match"))))
    word = rf"[^{BLANK}]++"
    words = F.lower(F.regexp_extract("before", rf"({word}[{BLANK}]++{word})[{BLANK}]*+\z", 1))
    core, skip = trimmed(F.col("match"))
    found = (seen.where(~(inside & (F.col("last.start") < F.col("start"))))
             .select("row_key", (F.col("start") + skip).alias("start"), core.alias("core"), span.alias("span"),
                     F.regexp_replace(words, rf"[{BLANK}]+", " ").alias("pattern"))
             .where("pattern <> '' AND core <> ''"))
    value = F.coalesce(F.col("span.match"), F.col("core"))
    return found.select("row_key", "start", (F.col("start") + F.length("core")).alias("end"), value.alias("value"),
                        form(value).alias("form"), "pattern", F.col("span.kind").alias("seed"))


def score_patterns(found: DataFrame) -> DataFrame:
    """(pattern, form, kind, score) accepted when another round accepts no more."""
    edges = stage(found.groupBy("pattern", "form", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    size = edges.groupBy("pattern", "form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    seeds = stage(found.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct(), "pii-seeds")
    # fewer values than the support cannot be accepted
    edges = stage(edges.select("pattern", "form", "value").join(size, ["pattern", "form"]), "pii-graph")
    known, before = seeds.withColumn("score", F.lit(1.0)), 0
    while True:
        scored = edges.join(known, "value").groupBy("pattern", "form", "kind").agg(
            (F.sum("score") / (F.max("n") + SMOOTHING)).alias("score"), F.count(F.lit(1)).alias("support"))
        accepted = stage(scored.where((F.col("score") >= ACCEPT) & (F.col("support") >= SUPPORT)), "pii-patterns")
        count = accepted.count()
        if count == before:
            return accepted.select("pattern", "form", "kind", "score")
        before = count
        others = (edges.join(accepted.select("pattern", "form", "kind", "score"), ["pattern", "form"])
                  .groupBy("value", "kind").agg(F.max("score").alias("score"))
                  .join(seeds.select("value").distinct(), "value", "left_anti"))
        known = stage(seeds.withColumn("score", F.lit(1.0)).unionByName(others), "pii-known")


def discover(found: DataFrame) -> DataFrame:
    """(row_key, start, end, kind) of unseen identifiers."""
    best = F.min(F.struct((-F.col("score")).alias("low"), F.col("kind")))
    return (found.where("seed IS NULL").join(score_patterns(found), ["pattern", "form"])
            .groupBy("row_key", "start", "end").agg(best["kind"].alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end in order, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs``."""
    texts = (docs.select(doc_key().alias("row_key"), "text", F.monotonically_increasing_id().alias("uid"))
             .where(F.col("text").rlike("[0-9@+]")))
    rows = stage(scan(texts, PATTERNS | {"token": TOKEN}), "pii-matches")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    base = rows.where(F.col("kind") != "token").where(valid(F.col("kind"), F.col("match")))
    found = stage(instances(base, rows.where("kind = 'token'")), "pii-instances")
    spans = (base.select("row_key", "start", "end", "kind", F.lit(True).alias("base"))
             .union(discover(found).select("row_key", "start", "end", "kind", F.lit(False))))
    one = F.struct(F.col("start"), rank.alias("rank"), F.col("end"))
    per_doc = spans.groupBy("row_key").agg(
        F.collect_set(F.when(F.col("base"), one)).alias("base"), F.collect_set(one).alias("spans"))
    out = docs.select("doc_id", doc_key().alias("row_key")).join(per_doc, "row_key", "left")

    def count(kind):
        k = KINDS.index(kind) + 1
        return F.coalesce(F.size(F.filter("base", lambda s: s["rank"] == k)), F.lit(0)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k in KINDS],
                      F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
                      F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"))
