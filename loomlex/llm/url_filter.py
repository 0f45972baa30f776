"""URL verdicts from rules and from a path-template tree (DataFrame functions only).

Rules come first: the longest rule whose domain is the host or a parent of it and
whose path starts the url's path gives the verdict.  Urls with a rule are the
labelled rows; the others are judged by their path template:

1. Runs of digits become ``#`` and urls are added up per (host, path shape), so
   a host with a third of all rows enters the tree as its distinct shapes.
2. A shape's pooled share is the blocked share of the labelled urls of its first
   segments over all hosts, segment by segment, each smoothed towards the one before
   and the first towards that of all labelled rows.
3. Level by level, a host's branches are named: a segment that is one of many
   rare children of its branch becomes the wildcard ``*``; children of one kind
   (mostly blocked, mostly allowed, mixed: by their labels, or by the pooled share
   if they have none) whose blocked share does not differ from that of their kind by
   a two-proportion test are merged into one branch.  So unlabelled branches join
   labelled ones, and labels reach them.
4. A template's purity is its blocked share, smoothed towards the pooled share of
   its shapes; a template of purity ``REJECT`` or more is blocked.

Counts of a branch's children are aggregates that are joined back, so a host with a
third of all urls is not ordered or gathered anywhere.

Defined cases: a null url or one without ``://`` has empty host and path and is
judged like any url without a rule; segments beyond ``LEVELS`` are one wildcard ``**``; rows that
repeat are judged each; without labelled rows everything is allowed; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlex.llm.common import stage
from loomlex.llm.html_text import host_of

# (verdict, domain and path)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]

LEVELS = 4
MANY, RARE = 8, 0.05  # children of a branch from which on rare ones become a wildcard
Z = 2.58
PRIOR, REJECT = 2.0, 0.8


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if out is None else out.otherwise(none)


def kind_of(share: Column) -> Column:
    return F.when(share >= 0.8, "blocked").when(share <= 0.2, "allowed").otherwise("mixed")


def pooled_shares(shapes: DataFrame, prior: float, levels: int = LEVELS) -> DataFrame:
    """``shapes`` plus ``pooled``: the blocked share of the same first segments over all hosts."""
    out = shapes.withColumn("pooled", F.lit(prior))
    for d in range(1, levels + 1):
        start = F.array_join(F.slice(F.split("shape", "/"), 1, d + 1), "/")
        out = out.withColumn("start", start)
        seen = out.groupBy("start").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
        out = out.join(seen, "start").withColumn("pooled", (F.col("b") + PRIOR * F.col("pooled")) / (F.col("l") + PRIOR)) \
            .drop("start", "b", "l")
    return out.withColumn("pooled", F.round("pooled", 9))


def templates(shapes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(host, shape, n, labelled, blocked, pooled) plus ``template``: its branch of the tree."""
    segs = F.split("shape", "/")
    tree = shapes.withColumn("template", F.lit(""))
    for d in range(1, levels + 1):
        seg = F.when(F.size(segs) > d, F.element_at(segs, d + 1)).otherwise("$")
        if d == levels:
            seg = F.when(F.size(segs) > d, F.lit("**")).otherwise("$")
        tree = tree.withColumn("seg", seg)
        kids = tree.groupBy("host", "template", "seg").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"),
            F.round(F.sum(F.col("n") * F.col("pooled")) / F.sum("n"), 6).alias("expected"))
        share = F.col("blocked") / F.nullif("labelled", F.lit(0))
        total = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all"))
        kids = kids.join(total, ["host", "template"]).select(
            "host", "template", "seg", "labelled", "blocked",
            ((F.col("children") >= MANY) & (F.col("n") < RARE * F.col("all"))).alias("many"),
            kind_of(F.coalesce(share, "expected")).alias("label"))
        kind = ["host", "template", "label", "many"]
        of_kind = kids.groupBy(*kind).agg(
            (F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0))).alias("together"), F.count(F.lit(1)).alias("alike"))
        kids = kids.join(of_kind, kind)
        spread = Z * F.sqrt(F.col("together") * (1 - F.col("together")) / F.nullif("labelled", F.lit(0))) + 0.05
        similar = (F.col("labelled") == 0) | (F.abs(share - F.col("together")) <= spread)
        name = (F.when(F.col("seg").isin("$", "**"), F.col("seg"))
                .when(F.col("many") & similar, F.concat(F.lit("*"), F.col("label")))
                .when((F.col("alike") > 1) & similar, F.concat(F.lit("+"), F.col("label")))
                .otherwise(F.col("seg")))
        kids = kids.select("host", "template", "seg", name.alias("name"))
        # staged level by level: the plan stays small however deep the tree is
        tree = stage(tree.join(kids, ["host", "template", "seg"])
                     .withColumn("template", F.concat("template", F.lit("/"), "name"))
                     .drop("seg", "name"), "url-tree")
    return tree


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("given"),
                    F.regexp_replace("path", "[0-9]+", "#").alias("shape")))
    shapes = stage(urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("given").alias("labelled"),
        F.count(F.when(F.col("given") == "block", 1)).alias("blocked")), "url-shapes")
    blocked, labelled = shapes.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = float(blocked) / labelled if labelled else 0.0
    tree = templates(stage(pooled_shares(shapes, prior), "url-pooled"))
    pure = tree.groupBy("host", "template").agg(
        F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"),
        F.round(F.sum(F.col("n") * F.col("pooled")) / F.sum("n"), 6).alias("expected")).select(
        "host", "template",
        F.round((F.col("blocked") + PRIOR * F.col("expected")) / (F.col("labelled") + PRIOR), 12).alias("purity"))
    judged = tree.select("host", "shape", "template").join(pure, ["host", "template"])
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return urls.join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template", "purity")


def sql(rules: list[tuple[str, str]] = RULES, levels: int = LEVELS) -> str:
    """The same in DuckDB SQL."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    fits = [f"(host = '{d}' OR host LIKE '%.{d}') AND path LIKE '/{p}%'"
            for d, _, p in (r.partition("/") for _, r in ordered)]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, (_, r) in zip(fits, ordered, strict=True))
    given = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _) in zip(fits, ordered, strict=True))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ctes = [f"""u0 AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
            f"""u AS (SELECT *, CASE {rule} END AS rule, CASE {given} END AS given,
  regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM u0)""",
            """g AS (SELECT host, shape, count(*) AS n, count(given) AS labelled,
  count(*) FILTER (WHERE given = 'block') AS blocked FROM u GROUP BY host, shape)""",
            f"""p0 AS (SELECT *, coalesce((SELECT CASE WHEN sum(labelled) > 0
  THEN CAST(sum(blocked) AS DOUBLE) / sum(labelled) END FROM g), 0) AS pooled FROM g)"""]
    for d in range(1, levels + 1):
        start = f"array_to_string(string_split(shape, '/')[1:{d + 1}], '/')"
        ctes.append(f"""p{d} AS (SELECT host, shape, n, labelled, blocked,
  (sum(blocked) OVER w + CAST({PRIOR} AS DOUBLE) * pooled) / (sum(labelled) OVER w + CAST({PRIOR} AS DOUBLE)) AS pooled
  FROM p{d - 1} WINDOW w AS (PARTITION BY {start}))""")
    ctes.append(f"t0 AS (SELECT host, shape, n, labelled, blocked, round(pooled, 9) AS pooled, '' AS template FROM p{levels})")
    for d in range(1, levels + 1):
        seg = "'**'" if d == levels else f"string_split(shape, '/')[{d + 1}]"
        ctes.append(f"""s{d} AS (SELECT *, CASE WHEN len(string_split(shape, '/')) > {d} THEN {seg} ELSE '$' END AS seg
  FROM t{d - 1})""")
        ctes.append(f"""k{d} AS (SELECT host, template, seg, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked,
  round(sum(n * pooled) / sum(n), 6) AS expected
  FROM s{d} GROUP BY host, template, seg)""")
        ctes.append(f"""l{d} AS (SELECT *,
  count(*) OVER (PARTITION BY host, template) >= {MANY}
    AND n < CAST({RARE} AS DOUBLE) * sum(n) OVER (PARTITION BY host, template) AS many,
  CASE WHEN seen >= CAST(0.8 AS DOUBLE) THEN 'blocked' WHEN seen <= CAST(0.2 AS DOUBLE) THEN 'allowed' ELSE 'mixed' END AS label
  FROM (SELECT *, CASE WHEN labelled > 0 THEN CAST(blocked AS DOUBLE) / labelled ELSE expected END AS seen FROM k{d}))""")
        ctes.append(f"""m{d} AS (SELECT *, CASE WHEN labelled > 0 THEN CAST(blocked AS DOUBLE) / labelled END AS own,
  CASE WHEN sum(labelled) OVER w > 0 THEN CAST(sum(blocked) OVER w AS DOUBLE) / sum(labelled) OVER w END AS pooled,
  count(*) OVER w AS alike FROM l{d} WINDOW w AS (PARTITION BY host, template, label, many))""")
        ctes.append(f"""n{d} AS (SELECT *, labelled = 0 OR abs(own - pooled) <=
  CAST({Z} AS DOUBLE) * sqrt(pooled * (1 - pooled) / labelled) + CAST(0.05 AS DOUBLE) AS similar FROM m{d})""")
        ctes.append(f"""t{d} AS (SELECT s.host, s.shape, s.n, s.labelled, s.blocked, s.pooled, s.template || '/' ||
  CASE WHEN s.seg IN ('$', '**') THEN s.seg WHEN k.many AND k.similar THEN '*' || k.label
       WHEN k.alike > 1 AND k.similar THEN '+' || k.label ELSE s.seg END AS template
  FROM s{d} s JOIN n{d} k ON s.host = k.host AND s.template = k.template AND s.seg = k.seg)""")
    ctes.append(f"""p AS (SELECT host, template, round((sum(blocked) + CAST({PRIOR} AS DOUBLE) * round(sum(n * pooled) / sum(n), 6))
  / (sum(labelled) + CAST({PRIOR} AS DOUBLE)), 12) AS purity FROM t{levels} GROUP BY host, template)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT u.page_id, u.host, u.path, u.rule,
       coalesce(u.given, CASE WHEN p.purity >= CAST({REJECT} AS DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict,
       t.template, p.purity
FROM u JOIN t{levels} t ON u.host = t.host AND u.shape = t.shape
JOIN p ON p.host = t.host AND p.template = t.template
"""
