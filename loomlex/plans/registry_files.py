"""Registered queries, part 5: files, catalogs and sinks (S1-S3, N8, F4, F5,
F7, F9-F11, F16, J4, T1, U2, W3, K1-K5, K7, C2, C5).

The files are derived from the given tables: rows are written to the shared
folder first and then scanned, or what a sink wrote is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomlex.functions import text as X
from loomlex.functions.constants import CONFIG_EXCLUDE_FORMATS, EXTRACTABLE_SUFFIXES
from loomlex.operators import entities as EN
from loomlex.operators import tokens as TK
from loomlex.operators import weights as WT
from loomlex.operators.ids import dense_ids
from loomlex.plans import sqlparts as Q
from loomlex.plans.jobs import catalog_documents, catalog_job, list_files
from loomlex.plans.registry import _scan_docs, docs, query
from loomlex.plans.registry_entities import _TOK_CTES
from loomlex.plans.registry_sources import _URL_TREE_SQL
from loomlex.session import ensure_checkpoint_dir, read_table, stage_table
from loomlex.sinks import writers as W
from loomlex.sources import catalog as CT
from loomlex.sources import files as FS


def _folder(spark, name: str) -> str:
    """A new folder beside the stage tables, gone when the application ends."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def _role_files(spark, sf) -> str:
    """``conversations`` as text files below one folder per role."""
    path = _folder(spark, "role-files")
    read_table(spark, sf, "conversations").where("text IS NOT NULL AND role IS NOT NULL") \
        .select("role", "text").write.partitionBy("role").text(path)
    return path


def _role():
    return F.regexp_extract("path", "role=([^/]+)/", 1).alias("role")


_SAID = "said AS (SELECT role, text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)"


@query("s1_scan_files", f"""
WITH {_SAID} SELECT role, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM said GROUP BY role
""")
def s1(spark, sf):
    files = FS.scan_files(spark, _role_files(spark, sf), "*.txt")
    return files.select(_role(), "length").groupBy("role").agg(F.sum("length").alias("n_bytes"))


@query("s2_read_text", f"""
WITH {_SAID}
SELECT role, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_chars,
       CAST(sum(length({Q.ascii_only('text')}) + 1) AS BIGINT) AS n_ascii FROM said GROUP BY role
""")
def s2(spark, sf):
    t = FS.read_text_docs(FS.scan_files(spark, _role_files(spark, sf)))
    return t.select(_role(), F.length("text").alias("n"), F.length(X.ascii_only("text")).alias("a")) \
        .groupBy("role").agg(F.sum("n").alias("n_chars"), F.sum("a").alias("n_ascii"))


@query("s3_extract_text", f"""
WITH {_SAID}
SELECT role, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM said GROUP BY role
""")
def s3(spark, sf):
    t = FS.drop_null_docs(FS.extract_text(FS.scan_files(spark, _role_files(spark, sf))))
    return t.select(_role(), F.size(FS.split_lines("text")).cast("long").alias("n")) \
        .groupBy("role").agg(F.sum("n").alias("n_lines"))


@query("n8_strict_utf8", "SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0")
def n8(spark, sf):
    # every third document gets a byte that UTF-8 does not have
    content = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    d = docs(spark, sf).where("text IS NOT NULL").select("doc_id", content.alias("content"))
    return FS.strict_utf8(d).select("doc_id", F.length("text").cast("long").alias("n"))


_SUFFIXES = ["txt", "TXT", "jpg", "JPG", "html", "pdf", "wav", "bin", "txt.span"]
_PATH_SQL = ("'d/' || CAST(page_id AS VARCHAR) || '.' || (" + "[" + ", ".join(Q.lit(s) for s in _SUFFIXES)
             + f"])[CAST(page_id % {len(_SUFFIXES)} AS INTEGER) + 1]")
_EXT_SQL = "regexp_extract(path, '(\\.[^./]*)$', 1)"


def _paths(spark, sf):
    """One path per page, with suffixes dealt by page_id; every fifth file is empty."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("page_id") % len(_SUFFIXES) + 1).cast("int"))
    return read_table(spark, sf, "pages").select(
        F.concat(F.lit("d/"), F.col("page_id").cast("string"), F.lit("."), suffix).alias("path"),
        F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.octet_length("html")).cast("long").alias("length"))


_F4_SQL = f"""
WITH f AS (SELECT {_PATH_SQL} AS path FROM pages)
SELECT path FROM f WHERE path LIKE '%.txt' OR path LIKE '%.TXT' OR {_EXT_SQL} NOT IN {Q.in_list(CONFIG_EXCLUDE_FORMATS)}
"""


@query("f4_exclude_formats", _F4_SQL)
def f4(spark, sf):
    return FS.exclude_formats(_paths(spark, sf)).select("path")


@query("j4_format_anti_join", _F4_SQL)
def j4(spark, sf):
    exts = spark.createDataFrame([(e,) for e in CONFIG_EXCLUDE_FORMATS], "ext string")
    return FS.exclude_formats(_paths(spark, sf), exts).select("path")


@query("f5_is_extractable", f"""
WITH f AS (SELECT {_PATH_SQL} AS path FROM pages)
SELECT path FROM f WHERE ({' OR '.join(f"path LIKE '%{s}'" for s in EXTRACTABLE_SUFFIXES)})
  AND {_EXT_SQL} NOT IN {Q.in_list(CONFIG_EXCLUDE_FORMATS)}
""")
def f5(spark, sf):
    return _paths(spark, sf).where(FS.is_extractable("path")).select("path")


@query("f7_drop_empty_files", f"""
WITH f AS (SELECT {_PATH_SQL} AS path, CASE WHEN page_id % 5 = 0 THEN 0 ELSE strlen(html) END AS length FROM pages)
SELECT path, length FROM f WHERE length > 0
""")
def f7(spark, sf):
    return FS.drop_empty_files(_paths(spark, sf))


@query("f16_skip_outputs", f"""
WITH f AS (SELECT {_PATH_SQL} AS path FROM pages) SELECT path FROM f WHERE path NOT LIKE '%.span'
""")
def f16(spark, sf):
    return FS.skip_outputs(_paths(spark, sf)).select("path")


@query("f9_files_only", "SELECT event_id FROM events WHERE event_id % 4 <> 0")
def f9(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", (F.col("event_id") % 4 == 0).alias("is_dir"))
    return CT.files_only(e).select("event_id")


@query("f10_select_stream", """
SELECT event_id, event_type AS stream FROM events WHERE user_id % 2 = 0 OR event_type = 'click'
""")
def f10(spark, sf):
    e = read_table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("stream"), F.when(F.col("user_id") % 2 != 0, "click").alias("wanted"))
    return CT.select_stream(e).select("event_id", "stream")


@query("f11_enabled_types", """
SELECT event_type AS ent_type FROM events GROUP BY event_type HAVING count(*) % 2 = 1
""")
def f11(spark, sf):
    t = read_table(spark, sf, "events").groupBy(F.col("event_type").alias("ent_type")).agg(
        (F.count(F.lit(1)) % 2).alias("flag"))
    return EN.enabled(t)


@query("t1_order_volumes", """
SELECT CAST(s_suppkey AS VARCHAR) AS volume_id, row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS place
FROM supplier
""")
def t1(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("volume_id"))
    return dense_ids(CT.order_volumes(s), ["volume_id"], "place")


@query("w3_image_index", """
SELECT s_name AS image, row_number() OVER (ORDER BY s_suppkey) - 1 AS image_index FROM supplier
""")
def w3(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_name").alias("image"), F.col("s_suppkey").alias("ord"))
    return CT.image_index(s).select("image", "image_index")


@query("u2_scan_images", """
SELECT CAST(user_id % 4 AS INTEGER) AS image_index, CAST(sum(strlen(props) + 1) AS BIGINT) AS n_bytes
FROM events WHERE user_id % 4 < 3 GROUP BY 1
""")
def u2(spark, sf):
    root = _folder(spark, "staged.files")
    e = read_table(spark, sf, "events")
    for i in range(4):
        e.where(F.col("user_id") % 4 == i).select("props").write.text(f"{root}/{i}")
    images = e.where("user_id % 4 < 3").select((F.col("user_id") % 4).cast("int").alias("image_index")).distinct()
    return FS.scan_images(spark, root, images).groupBy("image_index").agg(F.sum("length").alias("n_bytes"))


# ------------------------------------------------------------ sinks, read back

def _read_mm(spark, path):
    """(doc_id, token_id, value) of a written Matrix Market folder, ids from 0."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value RLIKE '^[0-9]+ [0-9]+ [^ ]+$'").select(
        (parts[0].cast("long") - 1).alias("doc_id"), (parts[1].cast("long") - 1).alias("token_id"), parts[2].alias("v"))


@query("k1_matrix_market", f"""
WITH {Q.corpus_ctes()}
SELECT doc_id, token_id, CAST(tf AS BIGINT) AS tf FROM bow
UNION ALL SELECT (SELECT max(doc_id) FROM docs), (SELECT count(*) FROM dict) - 1, (SELECT count(*) FROM bow)
""")
def k1(spark, sf):
    """The written entries and, as one more row, the size line."""
    d = _scan_docs(spark, sf)
    c = TK.build_corpus(d)
    path = _folder(spark, "bow.mm")
    W.write_mm(c.bow, path, "tf", docs=d, n_terms=c.vocab_size)
    return _read_mm(spark, path).select("doc_id", "token_id", F.col("v").cast("long").alias("tf"))


@query("k2_matrix_market_tfidf", f"""
WITH {Q.corpus_ctes()} SELECT doc_id, token_id, round(weight, 6) AS weight FROM tfidf
""")
def k2(spark, sf):
    d = _scan_docs(spark, sf)
    c = TK.build_corpus(d)
    path = _folder(spark, "tfidf.mm")
    W.write_mm(WT.tfidf(c.bow, c.n_docs), path, "weight", docs=d, n_terms=c.vocab_size)
    # the size line is the first row; weights are written with a point, counts without
    return _read_mm(spark, path).where("v RLIKE '[.E]'").select(
        "doc_id", "token_id", F.round(F.col("v").cast("double"), 6).alias("weight"))


@query("k3_dictionary", f"WITH {Q.corpus_ctes()} SELECT token_id, term, df, cf FROM dict")
def k3(spark, sf):
    path = _folder(spark, "dictionary")
    W.write_dictionary(TK.build_corpus(_scan_docs(spark, sf)).dictionary, path)
    return spark.read.parquet(path).select("token_id", "term", "df", "cf")


@query("k4_file_list", """
SELECT event_type AS image, CAST(user_id % 3 AS INTEGER) AS volume, '/f/' || CAST(event_id AS VARCHAR) AS path
FROM events WHERE event_type IS NOT NULL
""")
def k4(spark, sf):
    path = _folder(spark, "file-lists")
    W.write_file_list(read_table(spark, sf, "events").where("event_type IS NOT NULL").select(
        F.concat(F.lit("/f/"), F.col("event_id").cast("string")).alias("path"), F.col("event_type").alias("image"),
        (F.col("user_id") % 3).cast("int").alias("volume")), path)
    return spark.read.text(path).select("image", F.col("volume").cast("int").alias("volume"), F.col("value").alias("path"))


@query("k5_span_documents", f"""
WITH {_TOK_CTES},
g AS (SELECT doc_id, count(*) AS n_spans, count(DISTINCT token) AS n_entities FROM ments GROUP BY doc_id)
SELECT d.doc_id, length(d.text) AS n_chars, coalesce(g.n_spans, 0) AS n_spans, coalesce(g.n_entities, 0) AS n_entities
FROM documents d LEFT JOIN g USING (doc_id) WHERE d.text IS NOT NULL
""")
def k5(spark, sf):
    """Half of the records are written first; the second write skips them."""
    d = _scan_docs(spark, sf).where("text IS NOT NULL")
    records = stage_table(W.span_records(d, EN.mentions(d)), "span-records")  # written in two steps
    path = _folder(spark, "spans")
    W.write_spans(records.where("doc_id % 2 = 0"), path)
    W.write_spans(records, path, spark.read.schema(records.schema).json(path))
    return spark.read.schema(records.schema).json(path).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.size("spans").cast("long").alias("n_spans"),
        F.size("entities").cast("long").alias("n_entities"))


@query("k5_append_once", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS batch, length(text) AS n_chars
FROM documents WHERE text IS NOT NULL
""")
def k5_once(spark, sf):
    """Two batches, the first written twice and the second with all documents: every
    document is there once, by the batch that brought it."""
    d = _scan_docs(spark, sf).where("text IS NOT NULL")
    records = d.select("doc_id", "text")
    path = _folder(spark, "span-batches")
    W.append_spans(records.where("doc_id % 2 = 0"), path, "first")
    W.append_spans(records.where("doc_id % 2 = 0"), path, "first")
    W.append_spans(records, path, "second")
    return spark.read.json(path).select("doc_id", "batch", F.length("text").cast("long").alias("n_chars"))


@query("k7_staged_layout", """
SELECT CAST(page_id % 4 AS INTEGER) AS image_index, '/stage/' || CAST(page_id % 4 AS VARCHAR) || '/p/' || CAST(page_id AS VARCHAR)
  AS staged_path, strlen(html) AS n_bytes FROM pages
""")
def k7(spark, sf):
    path = _folder(spark, "staged")
    W.write_staged(read_table(spark, sf, "pages").select(
        (F.col("page_id") % 4).cast("int").alias("image_index"),
        F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("path"),
        F.encode("html", "UTF-8").alias("content")), path, "/stage")
    return spark.read.parquet(path).select("image_index", "staged_path", F.octet_length("content").cast("long").alias("n_bytes"))


# ------------------------------------------------------------ line documents out of files

def _language_files(spark, sf) -> str:
    """``documents`` without their non-ASCII letters as one folder of text files per language,
    in id order over its files."""
    path = _folder(spark, "language-files")
    d = read_table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    d.select("doc_id", "lang", X.ascii_only("text").alias("text")).repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id") \
        .select("lang", "text").write.partitionBy("lang").text(path)
    return path


_LANGUAGE_LINES = f"""
t AS (SELECT doc_id, lang, string_split({Q.ascii_only('text')}, chr(10)) AS parts FROM documents
      WHERE text IS NOT NULL AND lang IS NOT NULL),
u AS (SELECT doc_id, lang, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM t),
l AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS line_no, line FROM u)"""

def _lang_of():
    return F.regexp_extract("path", "lang=([^/]*?)(\\.txt)?$", 1).alias("lang")


@query("s5_numbered_lines", f"WITH {_LANGUAGE_LINES} SELECT lang, line_no, line FROM l")
def s5_numbered(spark, sf):
    """The lines of files with their numbers."""
    return FS.read_line_docs(spark, _language_files(spark, sf), parts=True).select(_lang_of(), "line_no", "line")


@query("s9_folder_lines", f"""
WITH {_LANGUAGE_LINES}
SELECT lang, CAST(line_no AS INTEGER) AS line_no, {Q.remove_digits(Q.remove_punct('line'))} AS line FROM l
""")
def s9_folder(spark, sf):
    """The line corpus of a folder of text files."""
    return FS.folder_line_corpus(spark, _language_files(spark, sf), parts=True).select(_lang_of(), "line_no", "line")


# ------------------------------------------------------------ catalog jobs

def _one_image(spark, sf):
    """The url tree as the entries of one image without a partition table."""
    entries = CT.url_tree(read_table(spark, sf, "pages")).select(
        F.lit(0).alias("image_index"), F.lit(0).alias("partition"), "inode", "p_inode", "name", "is_dir")
    images = read_table(spark, sf, "region").where("r_regionkey = 0").select(
        F.lit(0).alias("image_index"), F.concat(F.lit("/img/"), "r_name").alias("image_path"), F.lit("NTFS").alias("fs_type"))
    volumes = spark.createDataFrame([], "image_index int, image_path string, addr int, slot_num int, start bigint, "
                                        "desc string, fs_ok boolean")
    return entries, volumes, images


@query("c5_list_files", f"""
WITH {_URL_TREE_SQL}
SELECT 0 AS image_index, 0 AS "partition", '/' || key AS path,
       (SELECT r_name FROM region WHERE r_regionkey = 0) || '_filelist_0' AS list_name
FROM ids WHERE key NOT IN (SELECT key FROM dirs)
""")
def c5(spark, sf):
    return list_files(*_one_image(spark, sf))


@query("c2_catalog_documents", f"""
WITH {_URL_TREE_SQL},
p AS (SELECT min(page_id) AS page_id, '/' || array_to_string(segs, '/') AS path FROM up GROUP BY 2)
SELECT 'stage/0' || path AS path, row_number() OVER (ORDER BY 'stage/0' || path) - 1 AS doc_id
FROM p WHERE path LIKE '%.html' AND substr(path, 2) NOT IN (SELECT key FROM dirs)
""")
def c2(spark, sf):
    """The documents that the catalog selects among the staged pages."""
    return catalog_documents(*_staged_catalog(spark, sf))["documents"].select("path", "doc_id")


def _staged_catalog(spark, sf):
    """Raw entries, volumes, images and staged files out of the pages."""
    entries, volumes, images = _one_image(spark, sf)
    raw = entries.select("image_index", "partition", "name", F.lit(10).cast("bigint").alias("size"),
                         F.lit(33188).alias("mode"), F.col("inode").alias("addr"), F.col("p_inode").alias("par_addr"),
                         F.lit(0).cast("bigint").alias("mtime"), F.lit(0).cast("bigint").alias("atime"),
                         F.lit(0).cast("bigint").alias("ctime"), F.when(F.col("is_dir"), 2).otherwise(1).alias("type"),
                         F.lit(1).alias("flags"))
    path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    segs = F.filter(F.split(path, "/"), lambda s: s != F.lit(""))
    staged = read_table(spark, sf, "pages").select(
        F.lit(0).alias("image_index"), F.concat(F.lit("stage/0/"), F.array_join(segs, "/")).alias("path"), "page_id", "html") \
        .groupBy("image_index", "path").agg(F.min_by("html", "page_id").alias("html")) \
        .select("image_index", "path", F.encode("html", "UTF-8").alias("content"))
    return raw, volumes, images, staged


@query("c2_catalog_topics")
def c2_topics(spark, sf):
    """The whole catalog job with its defaults: the topic report of the selected pages."""
    return catalog_job(*_staged_catalog(spark, sf), seed=7)["topic_info"]
