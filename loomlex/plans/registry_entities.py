"""Registered queries, part 4: entity mentions (E1-E3, A7-A10, W1, W4, W5,
J8, F12, C4) on ``documents``; ``events`` and ``conversations`` as the
stand-in mention tables named in FIXTURES.md."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomlex.operators import entities as EN
from loomlex.operators.ids import first_seen_ids
from loomlex.plans import sqlparts as Q
from loomlex.plans.registry import _scan_docs, docs, query
from loomlex.session import read_table

TYPES = EN.DEFAULT_ENABLED_TYPES
TYPES_SQL = Q.in_list(TYPES)

_RULE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(token, {Q.lit(p)}) THEN {Q.lit(t)}" for t, p in EN.ENTITY_RULES) + " ELSE '' END"

_TOK_CTES = f"""
pl AS (SELECT doc_id, regexp_extract_all(text, {Q.lit(EN.TOKEN_RE + '|[ \\t\\n\\r\\f\\x0b]+')}) AS ps
       FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pidx FROM pl),
offs AS (SELECT doc_id, pidx, piece,
                CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pidx
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(piece) AS INTEGER) AS char_start
         FROM pieces),
toks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pidx) - 1 AS INTEGER) AS pos,
                piece AS token, char_start, CAST(char_start + length(piece) AS INTEGER) AS char_end,
                regexp_matches(piece, {Q.lit('^' + EN.PUNCT_CLASS + '$')}) AS is_punct
         FROM offs WHERE NOT regexp_matches(piece, '^[ \\t\\n\\r\\f\\x0b]+$')),
nx AS (SELECT *, min(CASE WHEN NOT is_punct THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_word,
              max(pos) OVER (PARTITION BY doc_id) AS last_pos FROM toks),
se AS (SELECT a.doc_id, a.pos, a.token, a.char_start, a.char_end, a.is_punct, b.char_end AS span_end,
              CAST(a.last_pos + 1 AS INTEGER) AS n_tokens
       FROM nx a JOIN toks b ON a.doc_id = b.doc_id AND b.pos = coalesce(a.next_word - 1, a.last_pos)),
tagged AS (SELECT *, {_RULE_CASE} AS ent_type FROM se),
ments AS (SELECT doc_id, pos, token, ent_type, char_start, span_end FROM tagged
          WHERE pos < n_tokens - 1 AND (ent_type IN {TYPES_SQL} OR lower(ent_type) IN {TYPES_SQL}))"""


# A gazetteer out of the given tables: nations, regions, and runs of 1 to 12 words of the
# benchmark items (some documents hold items), with a type by item.
def _gazetteer(spark, sf):
    words = read_table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    runs = words.select("item_id", "w", F.posexplode("w").alias("p", "_"))
    size = 1 + (F.col("item_id") * 5 + F.col("p")) % 12
    kinds = F.array(*[F.lit(t) for t in ("GPE", "ORG", "PERSON")])
    runs = runs.select(F.array_join(F.slice("w", F.col("p") + 1, size.cast("int")), " ").alias("term"),
                       F.element_at(kinds, (1 + F.col("item_id") % 3).cast("int")).alias("ent_type"))
    return runs.unionByName(EN.places(read_table(spark, sf, "nation"), read_table(spark, sf, "region")))


# The same gazetteer, and its names matched leftmost-longest: the longest name at each token,
# then a walk from each cluster of overlapping matches' first one.
_NAME_CTES = f"""
bw AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
bp AS (SELECT item_id, w, unnest(range(len(w))) AS p FROM bw),
gaz AS (SELECT array_to_string(w[p + 1 : p + 1 + (item_id * 5 + p) % 12], ' ') AS term,
               ['GPE', 'ORG', 'PERSON'][1 + item_id % 3] AS ent_type FROM bp
        UNION ALL SELECT n_name, 'GPE' FROM nation UNION ALL SELECT r_name, 'GPE' FROM region),
gt AS (SELECT regexp_extract_all(lower(term), {Q.lit(EN.TOKEN_RE)}) AS tk, ent_type FROM gaz),
names AS MATERIALIZED (SELECT row_number() OVER () AS id, tk, len(tk) AS n, ent_type
          FROM (SELECT tk, min(ent_type) AS ent_type FROM gt WHERE len(tk) > 0 GROUP BY tk)),
nt AS (SELECT id, unnest(tk) AS tok, generate_subscripts(tk, 1) - 1 AS i FROM names),
lt AS MATERIALIZED (SELECT doc_id, pos, lower(token) AS tok, token, char_start, span_end, n_tokens FROM se),
cand AS (SELECT t.doc_id, t.pos, n.id, n.n, n.ent_type FROM lt t JOIN names n ON n.tk[1] = t.tok),
hit AS (SELECT c.doc_id, c.pos, c.n, any_value(c.ent_type) AS ent_type
        FROM cand c JOIN nt ON nt.id = c.id JOIN lt t ON t.doc_id = c.doc_id AND t.pos = c.pos + nt.i AND t.tok = nt.tok
        GROUP BY c.doc_id, c.pos, c.id, c.n HAVING count(*) = c.n),
best AS (SELECT doc_id, pos, max(n) AS n, arg_max(ent_type, n) AS ent_type FROM hit GROUP BY doc_id, pos),
hd AS (SELECT *, coalesce(max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= pos AS head FROM best),
cl AS MATERIALIZED (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM hd),
follow AS MATERIALIZED (SELECT a.doc_id, a.pos, a.n, a.ent_type, a.head, min(b.pos) AS nxt
       FROM cl a LEFT JOIN cl b ON b.doc_id = a.doc_id AND b.c = a.c AND b.pos >= a.pos + a.n
       GROUP BY a.doc_id, a.pos, a.n, a.ent_type, a.head),
walk AS (SELECT * FROM follow WHERE head
         UNION ALL SELECT n.* FROM walk w JOIN follow n ON n.doc_id = w.doc_id AND n.pos = w.nxt),
wp AS (SELECT doc_id, pos, n, ent_type, unnest(range(n)) AS i FROM walk),
nm AS MATERIALIZED (SELECT w.doc_id, w.pos, w.n, any_value(w.ent_type) AS ent_type, string_agg(t.token, ' ' ORDER BY t.pos) AS token,
              min(t.char_start) AS char_start, max(t.span_end) AS span_end
       FROM wp w JOIN lt t ON t.doc_id = w.doc_id AND t.pos = w.pos + w.i GROUP BY w.doc_id, w.pos, w.n),
ntag AS (SELECT t.doc_id, t.pos, coalesce(m.token, t.token) AS token, t.char_start, coalesce(m.span_end, t.span_end) AS span_end,
                t.n_tokens, CASE WHEN m.token IS NOT NULL THEN m.ent_type WHEN i.doc_id IS NOT NULL THEN '' ELSE t.ent_type END AS ent_type
         FROM tagged t LEFT JOIN nm m ON m.doc_id = t.doc_id AND m.pos = t.pos
         LEFT JOIN (SELECT doc_id, pos + i AS pos FROM wp WHERE i > 0) i ON i.doc_id = t.doc_id AND i.pos = t.pos),
nments AS (SELECT doc_id, pos, token, ent_type, char_start, span_end FROM ntag
           WHERE pos < n_tokens - 1 AND (ent_type IN {TYPES_SQL} OR lower(ent_type) IN {TYPES_SQL}))"""


def _docs(spark, sf):
    return _scan_docs(spark, sf)


def _mentions(spark, sf):
    return EN.mentions(_docs(spark, sf))


@query("e1_tag_entities", f"""
WITH {_TOK_CTES}
SELECT doc_id, pos, token, ent_type FROM tagged WHERE ent_type <> ''
""")
def e1(spark, sf):
    t = EN.tag_entities(EN.offset_tokens(_docs(spark, sf)))
    return t.where(F.col("ent_type") != "").select("doc_id", "pos", "token", "ent_type")


_NAMES_SQL = f"""
WITH RECURSIVE {_TOK_CTES}, {_NAME_CTES}
SELECT doc_id, pos, token AS name, ent_type, CAST(n AS INTEGER) AS n_tokens, char_start, span_end FROM nm
"""


def _names(spark, sf, **kw):
    named = EN.named_tokens(_docs(spark, sf), _gazetteer(spark, sf), **kw).where("name IS NOT NULL")
    return named.select("doc_id", "pos", "name", F.col("name_type").alias("ent_type"), F.col("name_n").alias("n_tokens"),
                        "char_start", F.col("name_end").alias("span_end"))


@query("e1_gazetteer_names", _NAMES_SQL)
def e1_names(spark, sf):
    """Names of 1 to 12 words, matched by the broadcast token trie."""
    return _names(spark, sf)


@query("e1_large_gazetteer", _NAMES_SQL)
def e1_large(spark, sf):
    """The same names by the way of a gazetteer beyond the byte bound: prefix filter and join."""
    return _names(spark, sf, max_bytes=0)


@query("e1_gazetteer_tags", f"""
WITH RECURSIVE {_TOK_CTES}, {_NAME_CTES}
SELECT doc_id, pos, token, ent_type FROM ntag WHERE ent_type <> ''
""")
def e1_tags(spark, sf):
    """Names and rules together: every tagged token or name."""
    t = EN.tag_entities(EN.named_tokens(_docs(spark, sf), _gazetteer(spark, sf)))
    return t.where(F.col("ent_type") != "").select("doc_id", "pos", "token", "ent_type")


TITLE_LIMIT = 4000


def title_tagger(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """A caller's tagger: the first line is a title, numbers of four digits and more are
    cardinals; it cannot deal with texts of more than TITLE_LIMIT characters."""
    found = []
    for text in texts:
        if len(text) > TITLE_LIMIT:
            raise ValueError("too long")
        title = len(text.split("\n", 1)[0])
        spans = [(m.start(), m.end(), "CARDINAL") for m in re.finditer(r"[0-9]{4,}", text)]
        found.append(spans + [(0, title, "WORK_OF_ART")] * (title > 0))
    return found


@query("e1_tagger_hook", f"""
WITH {_TOK_CTES},
ok AS (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN strpos(text, chr(10)) - 1 ELSE length(text) END AS title
       FROM documents WHERE length(text) <= {TITLE_LIMIT})
SELECT doc_id, pos, token, CASE WHEN char_start < title THEN 'WORK_OF_ART' ELSE 'CARDINAL' END AS ent_type
FROM se JOIN ok USING (doc_id) WHERE char_start < title OR regexp_matches(token, '[0-9]{{4,}}')
UNION ALL SELECT doc_id, -1, 'ValueError: too long', 'failed' FROM documents WHERE length(text) > {TITLE_LIMIT}
""")
def e1_tagger(spark, sf):
    """The tagger hook: tokens of the tagger's spans, and the documents it failed on."""
    d = _docs(spark, sf)
    tagged = EN.tagger_tokens(d, title_tagger, align="overlap").where("ent_type <> ''")
    failed = EN.tagger_failures(d, title_tagger).select(
        "doc_id", F.lit(-1).alias("pos"), F.col("error").alias("token"), F.lit("failed").alias("ent_type"))
    return tagged.select("doc_id", "pos", "token", "ent_type").unionByName(failed)


@query("w4_span_bounds", f"""
WITH {_TOK_CTES}
SELECT doc_id, pos, char_start, char_end, span_end FROM se
""")
def w4(spark, sf):
    return EN.offset_tokens(_docs(spark, sf)).select("doc_id", "pos", "char_start", "char_end", "span_end")


@query("w5_drop_last", f"""
WITH {_TOK_CTES}
SELECT doc_id, count(*) AS n_kept FROM se WHERE pos < n_tokens - 1 GROUP BY doc_id
""")
def w5(spark, sf):
    return EN.drop_last(EN.offset_tokens(_docs(spark, sf))).groupBy("doc_id") \
        .agg(F.count(F.lit(1)).alias("n_kept"))


@query("e2_mentions", f"""
WITH {_TOK_CTES}
SELECT * FROM ments
""")
def e2(spark, sf):
    return _mentions(spark, sf)


@query("a9_collect_spans", f"""
WITH {_TOK_CTES}
SELECT doc_id, count(*) AS n_spans,
       string_agg(CAST(char_start AS VARCHAR) || ':' || CAST(span_end AS VARCHAR) || ':' || ent_type, ';'
                  ORDER BY char_start) AS spans
FROM ments GROUP BY doc_id
""")
def a9(spark, sf):
    s = EN.collect_spans(_mentions(spark, sf))
    return s.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"),
                    F.array_join(F.transform("spans", EN.span_label), ";").alias("spans"))


@query("a7_entity_type_counts", f"""
WITH RECURSIVE {_TOK_CTES}, {_NAME_CTES},
ty AS (SELECT unnest([{', '.join(Q.lit(t) for t in TYPES)}]) AS ent_type),
alld AS (SELECT DISTINCT doc_id FROM documents),
cnt AS (SELECT doc_id, lower(ent_type) AS ent_type, count(*) AS n FROM nments GROUP BY 1, 2)
SELECT d.doc_id, ty.ent_type, coalesce(c.n, 0) AS n
FROM alld d CROSS JOIN ty LEFT JOIN cnt c ON c.doc_id = d.doc_id AND c.ent_type = ty.ent_type
""")
def a7(spark, sf):
    found = EN.mentions(_docs(spark, sf), gazetteer=_gazetteer(spark, sf))
    return EN.entity_type_counts(found, docs(spark, sf), TYPES)


@query("a8_entity_histogram", f"""
WITH {_TOK_CTES}
SELECT lower(ent_type) AS ent_type, token AS surface, count(*) AS n FROM ments GROUP BY 1, 2
""")
def a8(spark, sf):
    return EN.entity_histogram(_mentions(spark, sf))


_POINTS_SQL = """
b AS (SELECT img, doc, ent, o1, o2 FROM src),
fi0 AS (SELECT img, o1, o2, row_number() OVER (PARTITION BY img ORDER BY o1, o2) AS r FROM b),
fi AS (SELECT img, row_number() OVER (ORDER BY o1, o2, img) - 1 AS x FROM fi0 WHERE r = 1),
fd0 AS (SELECT doc, o1, o2, row_number() OVER (PARTITION BY doc ORDER BY o1, o2) AS r FROM b),
fd AS (SELECT doc, row_number() OVER (ORDER BY o1, o2, doc) - 1 AS y FROM fd0 WHERE r = 1),
fe0 AS (SELECT ent, o1, o2, row_number() OVER (PARTITION BY ent ORDER BY o1, o2) AS r FROM b),
fe AS (SELECT ent, row_number() OVER (ORDER BY o1, o2, ent) - 1 AS z FROM fe0 WHERE r = 1)
SELECT DISTINCT fi.x, fd.y, fe.z FROM b JOIN fi USING (img) JOIN fd USING (doc) JOIN fe USING (ent)
"""


@query("a10_distinct_points", f"""
WITH {_TOK_CTES},
src AS (SELECT d.source AS img, m.doc_id AS doc, m.token AS ent, m.doc_id AS o1, m.pos AS o2
        FROM ments m JOIN documents d USING (doc_id)),
{_POINTS_SQL}
""")
def a10(spark, sf):
    m = _mentions(spark, sf).join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return EN.encode_points(m, "source", "doc_id", "token", ["doc_id", "pos"])


def _events(spark, sf):
    return read_table(spark, sf, "events")


@query("j8_encode_points", f"""
WITH src AS (SELECT event_type AS img, user_id AS doc, props AS ent,
                    ts AS o1, event_id AS o2 FROM events),
{_POINTS_SQL}
""")
def j8(spark, sf):
    return EN.encode_points(_events(spark, sf), "event_type", "user_id", "props", ["ts", "event_id"])


EVENT_TYPES = ["click", "purchase", "error"]


@query("f12_keep_mentions", f"""
SELECT event_id, user_id, event_type FROM events
WHERE event_type IN {Q.in_list(EVENT_TYPES)} OR lower(event_type) IN {Q.in_list(EVENT_TYPES)}
""")
def f12(spark, sf):
    ev = _events(spark, sf).select("event_id", "user_id", "event_type")
    return EN.keep_mentions(ev, EVENT_TYPES, "event_type")


@query("a7_event_type_counts", f"""
WITH ty AS (SELECT unnest([{', '.join(Q.lit(t) for t in EVENT_TYPES)}]) AS ent_type),
u AS (SELECT DISTINCT user_id AS doc_id FROM events),
c AS (SELECT user_id AS doc_id, lower(event_type) AS ent_type, count(*) AS n FROM events
      WHERE event_type IN {Q.in_list(EVENT_TYPES)} OR lower(event_type) IN {Q.in_list(EVENT_TYPES)} GROUP BY 1, 2)
SELECT u.doc_id, ty.ent_type, coalesce(c.n, 0) AS n
FROM u CROSS JOIN ty LEFT JOIN c ON c.doc_id = u.doc_id AND c.ent_type = ty.ent_type
""")
def a7_events(spark, sf):
    ev = _events(spark, sf).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("ent_type"))
    m = EN.keep_mentions(ev, EVENT_TYPES)
    return EN.entity_type_counts(m, ev, EVENT_TYPES)


@query("a8_event_histogram", """
SELECT lower(event_type) AS ent_type, props AS surface, count(*) AS n FROM events GROUP BY 1, 2
""")
def a8_events(spark, sf):
    ev = _events(spark, sf).select(F.col("event_type").alias("ent_type"), "props")
    return EN.entity_histogram(ev, "props")


@query("w1_first_seen_ids", """
WITH b AS (SELECT unnest(string_split(text, ' ')) AS word, conv_id, turn FROM conversations),
f AS (SELECT word, min((conv_id, turn)) AS first FROM b GROUP BY word)
SELECT word, row_number() OVER (ORDER BY first, word) - 1 AS id FROM f
""")
def w1(spark, sf):
    c = read_table(spark, sf, "conversations").select(
        F.explode(F.split("text", " ")).alias("word"), "conv_id", "turn")
    return first_seen_ids(c, "word", ["conv_id", "turn"], "id").select("word", "id")


@query("e3_entity_report", f"""
WITH {_TOK_CTES}
SELECT lower(ent_type) AS ent_type, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs,
       count(DISTINCT token) AS n_surfaces FROM ments GROUP BY 1
""")
def e3(spark, sf):
    m = _mentions(spark, sf)
    return m.groupBy(F.lower("ent_type").alias("ent_type")).agg(
        F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"),
        F.countDistinct("token").alias("n_surfaces"))


@query("c4_entity_job", f"""
WITH RECURSIVE {_TOK_CTES}, {_NAME_CTES},
alld AS (SELECT DISTINCT doc_id FROM documents),
c AS (SELECT doc_id, count(*) AS n_spans,
             count(*) FILTER (WHERE lower(ent_type) = 'person') AS n_person,
             count(*) FILTER (WHERE lower(ent_type) = 'gpe') AS n_gpe,
             count(*) FILTER (WHERE lower(ent_type) = 'org') AS n_org FROM nments GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_spans, 0) AS n_spans, coalesce(n_person, 0) AS n_person,
       coalesce(n_gpe, 0) AS n_gpe, coalesce(n_org, 0) AS n_org
FROM alld d LEFT JOIN c USING (doc_id)
""")
def c4(spark, sf):
    from loomlex.plans.jobs import entity_job
    rep = entity_job(_docs(spark, sf), gazetteer=_gazetteer(spark, sf))
    counts = rep["type_counts"].groupBy("doc_id").pivot("ent_type", TYPES).agg(F.first("n"))
    spans = rep["spans"].select("doc_id", F.size("spans").cast("bigint").alias("n_spans"))
    out = counts.join(spans, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
                      *[F.col(t).alias(f"n_{t}") for t in TYPES])


@query("e3_full_report", f"""
WITH {_TOK_CTES},
src AS (SELECT d.source AS img, m.doc_id AS doc, m.token AS ent, m.doc_id AS o1, m.pos AS o2
        FROM ments m JOIN documents d USING (doc_id)),
pts AS (WITH {_POINTS_SQL})
SELECT 'span' AS section, CAST(doc_id AS VARCHAR) AS a,
       CAST(char_start AS VARCHAR) || ':' || CAST(span_end AS VARCHAR) || ':' || ent_type AS b, 1 AS n FROM ments
UNION ALL SELECT 'surface', lower(ent_type), token, count(*) FROM ments GROUP BY 2, 3
UNION ALL SELECT 'point', CAST(x AS VARCHAR), CAST(y AS VARCHAR) || ':' || CAST(z AS VARCHAR), 1 FROM pts
""")
def e3_full(spark, sf):
    """The whole report of the entity job in one table: spans, surfaces, points."""
    from loomlex.plans.jobs import entity_job
    rep = entity_job(_scan_docs(spark, sf, "source"), image_col="source")
    one = F.lit(1).cast("bigint").alias("n")
    spans = rep["spans"].select(F.lit("span").alias("section"), F.col("doc_id").cast("string").alias("a"),
                                F.explode(F.transform("spans", EN.span_label)).alias("b"), one)
    surfaces = rep["histogram"].select(F.lit("surface"), "ent_type", "surface", "n")
    points = rep["points"].select(F.lit("point"), F.col("x").cast("string"),
                                  F.concat_ws(":", F.col("y").cast("string"), F.col("z").cast("string")), one)
    return spans.union(surfaces).union(points)
