"""Registered queries, part 3: sources, line documents, count maps, set
operations, scalar functions and catalog stand-ins (S4-S9, U1, U3, A4, A6,
F13, F14, J5-J7, X1-X11, P6, P7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlex.functions import text as X
from loomlex.functions.constants import RARE_TRIM_STOP_WORDS
from loomlex.operators import tokens as TK
from loomlex.operators.joins import join_bounded
from loomlex.plans import sqlparts as Q
from loomlex.plans.registry import base_tokens, docs, query, spread
from loomlex.session import read_table
from loomlex.sources import catalog as CT
from loomlex.sources import files as FS


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# ------------------------------------------------------------ S4 HTML

def _html_sql(col: str) -> str:
    s = col
    for pat in (X.SCRIPT_RE, X.STYLE_RE, X.COMMENT_RE):
        s = Q.rx(s, pat, " ")
    s = Q.rx(s, X.TAG_RE, " ")
    names = ", ".join(f"{Q.lit(k)}: {Q.lit(v)}" for k, v in sorted(X.named_references().items()))
    code = ("CASE WHEN regexp_matches(p, '^&#[0-9]+;$') THEN CAST(p[3:-2] AS BIGINT) "
            "WHEN regexp_matches(p, '^&#[xX][0-9a-fA-F]+;$') THEN CAST('0x' || p[4:-2] AS BIGINT) END")
    one = (f"CASE WHEN NOT regexp_matches(p, '^&.+;$') THEN p "
           f"WHEN p[2] <> '#' THEN coalesce(MAP {{{names}}}[p[2:-2]], p) "
           f"WHEN ({code}) = 160 THEN ' ' "
           f"WHEN ({code}) BETWEEN 1 AND 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343 THEN chr(CAST(({code}) AS INTEGER)) "
           f"ELSE p END")
    s = f"array_to_string(list_transform(regexp_extract_all({s}, {Q.lit(X.REFERENCE_RE)}), lambda p: {one}), '')"
    return f"trim({Q.rx(s, X.SPACE_RUN_RE, ' ')})"


@query("s4_html_to_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def s4(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.html_to_text("html").alias("text"))


# ------------------------------------------------------------ S5 / S9 lines

def _lines_sql(src: str) -> str:
    return f"""
s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {src}),
t AS (SELECT doc_id, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM s)
SELECT doc_id, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS line FROM t"""


@query("s5_line_docs", f"""
WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
{_lines_sql('src')}
""")
def s5(spark, sf):
    return FS.line_docs(docs(spark, sf).where(F.col("text").isNotNull()), "doc_id", "text")


@query("s9_line_corpus", f"""
WITH src AS (SELECT doc_id, {Q.remove_digits(Q.remove_punct('text'))} AS text FROM documents WHERE length(text) > 0),
{_lines_sql('src')}
""")
def s9(spark, sf):
    d = FS.drop_empty_docs(docs(spark, sf))
    d = d.select("doc_id", X.remove_digits(X.remove_punctuation("text")).alias("text"))
    return FS.line_docs(d, "doc_id", "text")


# ------------------------------------------------------------ U1 / U3

@query("u1_union_docs", """
SELECT 'documents' AS corpus, doc_id AS doc_key, length(text) AS n_chars FROM documents
UNION ALL SELECT 'conversations', conv_id * 100 + turn, length(text) FROM conversations
UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark
""")
def u1(spark, sf):
    d = docs(spark, sf).select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("doc_key"), "text")
    c = _t(spark, sf, "conversations").select(
        F.lit("conversations").alias("corpus"), (F.col("conv_id") * 100 + F.col("turn")).alias("doc_key"), "text")
    b = _t(spark, sf, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("doc_key"), "text")
    u = TK.union_docs(d, c, b)
    return u.select("corpus", "doc_key", F.length("text").cast("bigint").alias("n_chars"))


@query("u3_stop_union", f"""
WITH {Q.corpus_ctes().split('kept AS')[0].rstrip().rstrip(',')}
SELECT term, count(*) AS n FROM tok WHERE term IN {Q.STOP} GROUP BY term
""")
def u3(spark, sf):
    from loomlex.functions.constants import CONFIG_EXCLUDE_WORDS, EN_STOP_WORDS
    a = spark.createDataFrame([(w,) for w in EN_STOP_WORDS], "word string")
    b = spark.createDataFrame([(w,) for w in CONFIG_EXCLUDE_WORDS], "word string")
    words = TK.stop_union(a, b).withColumnRenamed("word", "term")
    toks = base_tokens(spark, sf).select("term")
    return join_bounded(toks, words, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ A4 / F14 / F13

_CONV_TOK = f"""
ct AS (SELECT conv_id, turn, unnest({Q.tokenize('text')}) AS term FROM conversations WHERE text IS NOT NULL),
cc AS (SELECT conv_id, turn, term, count(*) AS n FROM ct GROUP BY 1, 2, 3)"""


@query("a4_count_words", f"""
WITH {_CONV_TOK}
SELECT conv_id, turn, string_agg(term || ':' || CAST(n AS VARCHAR), ' ' ORDER BY term) AS counts
FROM cc GROUP BY conv_id, turn
""")
def a4(spark, sf):
    m = TK.count_words(_t(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    return m.select("conv_id", "turn", _map_str("counts").alias("counts"))


def _map_str(c: str):
    ents = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(ents, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")


@query("f14_map_drop_keys", f"""
WITH {_CONV_TOK}
SELECT conv_id, turn, string_agg(term || ':' || CAST(n AS VARCHAR), ' ' ORDER BY term) AS counts
FROM cc WHERE term NOT IN {Q.STOP} GROUP BY conv_id, turn
""")
def f14(spark, sf):
    m = TK.count_words(_t(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    m = m.select("conv_id", "turn", TK.map_drop_keys("counts", TK.default_stop_words()).alias("counts"))
    return m.where(F.size("counts") > 0).select("conv_id", "turn", _map_str("counts").alias("counts"))


@query("f13_trim_rare", f"""
WITH lt AS (SELECT doc_id, unnest({Q.tokenize(Q.remove_digits(Q.remove_punct('text')))}) AS term
            FROM documents WHERE length(text) > 0)
SELECT doc_id, term, count(*) AS n FROM lt WHERE term NOT IN {Q.in_list(RARE_TRIM_STOP_WORDS)}
GROUP BY doc_id, term HAVING count(*) >= 2
""")
def f13(spark, sf):
    d = FS.drop_empty_docs(docs(spark, sf))
    d = spread(d.select("doc_id", "text"))
    toks = d.select("doc_id", F.explode_outer(X.tokenize(X.remove_digits(X.remove_punctuation("text")))).alias("term"))
    return TK.trimmed_counts(toks.where("term IS NOT NULL"), "doc_id", 2, RARE_TRIM_STOP_WORDS)


# ------------------------------------------------------------ scalar functions

@query("x1_file_ext", f"SELECT page_id, regexp_extract(url, {Q.lit(X.FILE_EXT_RE)}, 1) AS ext FROM pages")
def x1(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.file_ext("url").alias("ext"))


_DIRNAME_SQL = ("CASE WHEN regexp_matches(regexp_extract(url, '^(.*/)', 1), '^/+$') "
                "THEN regexp_extract(url, '^(.*/)', 1) "
                "ELSE regexp_replace(regexp_extract(url, '^(.*/)', 1), '/+$', '') END")


@query("x5_basename_dirname", f"""
SELECT page_id, regexp_extract(url, '[^/]*$') AS base, {_DIRNAME_SQL} AS dir FROM pages
""")
def x5(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.basename("url").alias("base"), X.dirname("url").alias("dir"))


@query("x6_to_txt", f"""
SELECT page_id, substr(url, 1, length(url) - length(regexp_extract(url, {Q.lit(X.FILE_EXT_RE)}, 1))) || '.txt' AS txt_name
FROM pages
""")
def x6(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.to_txt("url").alias("txt_name"))


@query("x7_stream_name", """
SELECT page_id, CASE WHEN contains(url, ':') THEN split_part(url, ':', 2) END AS stream FROM pages
""")
def x7(spark, sf):
    return _t(spark, sf, "pages").select("page_id", X.stream_name("url").alias("stream"))


@query("x8_export_name", """
WITH b AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS base,
                  CASE WHEN contains(url, ':') THEN split_part(url, ':', 2) END AS stream FROM pages)
SELECT page_id, 'out/' || CASE WHEN stream IS NOT NULL AND stream <> '' THEN base || '.' || stream ELSE base END AS export
FROM b
""")
def x8(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", X.export_name(F.lit("out"), "url", X.stream_name("url")).alias("export"))


@query("x10_file_list_name", """
SELECT page_id, regexp_extract(url, '[^/]*$') || '_filelist_' || CAST(page_id AS VARCHAR) AS list_name FROM pages
""")
def x10(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", X.file_list_name(X.basename("url"), "page_id").alias("list_name"))


@query("x11_join_path", f"""
SELECT page_id, '/' || array_to_string(list_filter(string_split(concat_ws('/', {_DIRNAME_SQL},
       regexp_extract(url, '[^/]*$')), '/'), lambda s: s <> ''), '/') AS path FROM pages
""")
def x11(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", X.join_path(X.dirname("url"), X.basename("url")).alias("path"))


def _size_sql(col: str) -> str:
    def scaled(base: int, units: list[str]) -> tuple[str, str]:
        mag = "CASE " + " ".join(f"WHEN {col} >= {base ** k} THEN {k}" for k in range(6, 0, -1)) + " ELSE 0 END"
        val = "CASE " + " ".join(
            f"WHEN {col} >= {base ** k} THEN " + f"CAST({col} AS DOUBLE)" + f" / {float(base)}" * k
            for k in range(6, 0, -1)) + f" ELSE CAST({col} AS DOUBLE) END"
        unit = "CASE " + " ".join(f"WHEN {col} >= {base ** k} THEN {Q.lit(units[k])}"
                                  for k in range(6, 0, -1)) + " ELSE 'B' END"
        return mag, f"printf('%.1f', {val}) || {unit}"
    m1000, s1000 = scaled(1000, X.UNITS_1000)
    m1024, s1024 = scaled(1024, X.UNITS_1024)
    return (f"CASE WHEN ({m1000}) > 0 AND ({m1024}) > 0 THEN {s1024} || ' / ' || {s1000} || ' (' || "
            f"CAST({col} AS VARCHAR) || ' B)' ELSE CAST({col} AS VARCHAR) || ' B' END")


@query("x2_human_size", f"""
WITH e AS (SELECT event_id, event_id * event_id AS size FROM events)
SELECT event_id, {_size_sql('size')} AS human FROM e
""")
def x2(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", X.human_size(F.col("event_id") * F.col("event_id")).alias("human"))


@query("x3_iso_utc", """
SELECT event_id, strftime(make_timestamp(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000),
                          '%Y-%m-%dT%H:%M:%SZ') AS mtime FROM events
""")
def x3(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", X.iso_utc(X.epoch_seconds_ntz("ts")).alias("mtime"))


@query("x4_name_slug", """
SELECT conv_id, turn, CASE WHEN contains(text, ' ') THEN replace(text, ' ', '%20') ELSE 'None' END AS name_slug
FROM conversations
""")
def x4(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.name_slug("text").alias("name_slug"))


@query("x9_offset_label", """
SELECT l_orderkey, l_linenumber, printf('%d (0x%08x)', l_partkey * 512, l_partkey * 512) AS label FROM lineitem
""")
def x9(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.offset_label(F.col("l_partkey") * 512).alias("label"))


@query("p6_deleted_flag", """
SELECT event_id, CASE WHEN (user_id & 1) = 0 THEN 'Yes' ELSE 'No' END AS deleted FROM events
""")
def p6(spark, sf):
    return _t(spark, sf, "events").select("event_id", X.deleted_flag("user_id").alias("deleted"))


@query("p7_is_dir", """
SELECT event_id, (CASE WHEN event_type = 'view' THEN 2 ELSE 1 END) = 2 AS isdir FROM events
""")
def p7(spark, sf):
    e = _t(spark, sf, "events")
    t = F.when(F.col("event_type") == "view", 2).otherwise(1)
    return e.select("event_id", X.is_dir(t).alias("isdir"))


# ------------------------------------------------------------ catalog stand-ins

def _raw_entries(spark, sf):
    e = _t(spark, sf, "events")
    secs = X.epoch_seconds_ntz("ts")
    return e.select(
        F.lit(0).alias("image_index"), F.lit(0).alias("partition"),
        F.concat_ws(" ", "event_type", "props").alias("name"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"), F.lit(33188).alias("mode"),
        F.col("event_id").alias("addr"), F.col("user_id").alias("par_addr"),
        secs.alias("mtime"), secs.alias("atime"), secs.alias("ctime"),
        F.when(F.col("event_type") == "view", 2).otherwise(1).alias("type"),
        F.col("user_id").alias("flags"))


_SECS = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


@query("s6_file_catalog", f"""
SELECT 0 AS image_index, 0 AS partition, event_type || ' ' || props AS name,
       CAST(floor(value * 100) AS BIGINT) AS size, 33188 AS mode, event_id AS inode, user_id AS p_inode,
       strftime(make_timestamp({_SECS} * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS mtime,
       {_SECS} AS atime, {_SECS} AS ctime, event_type = 'view' AS isdir,
       CASE WHEN (user_id & 1) = 0 THEN 'Yes' ELSE 'No' END AS deleted,
       CASE WHEN contains(event_type || ' ' || props, ' ')
            THEN replace(event_type || ' ' || props, ' ', '%20') ELSE 'None' END AS name_slug
FROM events
""")
def s6(spark, sf):
    return CT.file_catalog(_raw_entries(spark, sf))


def _volumes(spark, sf):
    li = _t(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("image_index"),
                     F.concat(F.lit("image_"), F.col("l_orderkey").cast("string")).alias("image_path"),
                     F.col("l_linenumber").alias("addr"), (F.col("l_linenumber") - 2).alias("slot_num"),
                     F.col("l_partkey").alias("start"),
                     F.concat("l_returnflag", "l_linestatus").alias("desc"),
                     (F.col("l_returnflag") != "R").alias("fs_ok"))


def _images(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("image_index"),
                    F.concat(F.lit("image_"), F.col("o_orderkey").cast("string")).alias("image_path"),
                    F.when(F.col("o_orderstatus") == "F", "FAT12").when(F.col("o_orderstatus") == "O", "ISO9660")
                    .otherwise("NTFS").alias("fs_type"))


_PARTS_SQL = """
vol AS (SELECT l_orderkey AS image_index, 'image_' || CAST(l_orderkey AS VARCHAR) AS image_path,
               l_linenumber AS addr, l_linenumber - 2 AS slot_num, l_partkey AS start,
               l_returnflag || l_linestatus AS "desc", l_returnflag <> 'R' AS fs_ok FROM lineitem),
img AS (SELECT o_orderkey AS image_index, 'image_' || CAST(o_orderkey AS VARCHAR) AS image_path,
               CASE o_orderstatus WHEN 'F' THEN 'FAT12 file system' WHEN 'O' THEN 'ISO file system'
                    ELSE 'Unknown file system' END AS fs_desc FROM orders),
parts AS (SELECT image_index, image_path, CAST(addr AS INTEGER) AS addr, CAST(slot_num AS INTEGER) AS slot_num,
                 CAST(start AS BIGINT) AS start_offset, "desc" FROM vol WHERE slot_num >= 0 AND fs_ok
          UNION ALL
          SELECT image_index, image_path, 0, 0, CAST(0 AS BIGINT), fs_desc FROM img
          WHERE image_index NOT IN (SELECT image_index FROM vol))"""


@query("s7_partition_catalog", f"WITH {_PARTS_SQL} SELECT * FROM parts")
def s7(spark, sf):
    return CT.partition_catalog(_volumes(spark, sf), _images(spark, sf))


@query("a6_partition_counts", f"""
WITH {_PARTS_SQL}
SELECT image_index, count(*) AS n_partitions FROM parts GROUP BY image_index
""")
def a6(spark, sf):
    return CT.partition_counts(CT.partition_catalog(_volumes(spark, sf), _images(spark, sf)))


@query("j7_partition_offset", f"""
WITH {_PARTS_SQL}
SELECT l.l_orderkey AS image_index, CAST(l.l_linenumber - 3 AS INTEGER) AS partition, l.l_suppkey,
       p.start_offset * 512 AS offset
FROM lineitem l JOIN parts p ON p.image_index = l.l_orderkey AND p.slot_num = l.l_linenumber - 3
""")
def j7(spark, sf):
    parts = CT.partition_catalog(_volumes(spark, sf), _images(spark, sf))
    rows = _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_index"), (F.col("l_linenumber") - 3).cast("int").alias("partition"),
        "l_suppkey")
    return CT.partition_offset(rows, parts)


# ------------------------------------------------------------ J5 / J6 on the URL tree

_URL_TREE_SQL = r"""
up AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''),
                                                    '[?#].*$', ''), '/'), lambda s: s <> '') AS segs FROM pages),
pre AS (SELECT DISTINCT array_to_string(segs[1:i], '/') AS key
        FROM up, range(1, greatest(len(segs), 1) + 1) r(i)),
keys AS (SELECT key FROM pre WHERE key <> '' UNION SELECT ''),
ids AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS inode FROM keys),
dirs AS (SELECT DISTINCT regexp_replace(key, '/[^/]*$', '') AS key FROM keys WHERE contains(key, '/')
         UNION SELECT '' WHERE EXISTS (SELECT 1 FROM keys WHERE key <> ''))"""


@query("j5_full_paths", f"""
WITH {_URL_TREE_SQL}
SELECT inode, '/' || key AS path FROM ids WHERE key NOT IN (SELECT key FROM dirs)
""")
def j5(spark, sf):
    entries = CT.url_tree(_t(spark, sf, "pages"))
    tree = CT.full_paths(entries.drop("key"))
    return CT.files_only(tree).select("inode", "path")


@query("j6_inode_of", f"""
WITH {_URL_TREE_SQL},
req AS (SELECT page_id, '/' || array_to_string(segs, '/') AS path FROM up
        UNION ALL SELECT page_id, '/none/' || CAST(page_id AS VARCHAR) FROM pages)
SELECT r.page_id, r.path, coalesce(i.inode, -1) AS inode FROM req r LEFT JOIN ids i ON '/' || i.key = r.path
""")
def j6(spark, sf):
    pages = _t(spark, sf, "pages")
    tree = CT.full_paths(CT.url_tree(pages).drop("key"))
    path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    segs = F.filter(F.split(path, "/"), lambda s: s != F.lit(""))
    req = pages.select("page_id", F.concat(F.lit("/"), F.array_join(segs, "/")).alias("path")).unionByName(
        pages.select("page_id", F.concat(F.lit("/none/"), F.col("page_id").cast("string")).alias("path")))
    return CT.inode_of(req, tree).select("page_id", "path", "inode")
