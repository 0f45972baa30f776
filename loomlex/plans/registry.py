"""Registered queries (Spark) and their DuckDB oracles, part 1: text
normalisation, tokens, dictionary, bag of words, TF-IDF.

Every query reads whole driver tables from ``sf_dir``; oracles use the
pre-registered views of the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlex.functions import text as X
from loomlex.operators import tokens as TK
from loomlex.operators import topicviews as TV
from loomlex.operators import weights as WT
from loomlex.operators.joins import join_head_tail
from loomlex.plans import sqlparts as Q
from loomlex.session import read_table, stage_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def _scan_docs(spark, sf, *more: str) -> DataFrame:
    return spread(docs(spark, sf).select("doc_id", "text", *more))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores only when it has fewer input splits than
    the cluster has cores (a small single-file table); a large scan already
    has enough splits and is left unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def base_tokens(spark, sf) -> DataFrame:
    """(doc_id, pos, term) after N9 -> N6 -> N7."""
    return TK.explode_tokens(TK.doc_tokens(_scan_docs(spark, sf)))


# ---------------------------------------------------------------- N1 - N9

@query("n1_ascii_only", f"SELECT doc_id, {Q.ascii_only('text')} AS text_ascii FROM documents")
def n1(spark, sf):
    return docs(spark, sf).select("doc_id", X.ascii_only("text").alias("text_ascii"))


@query("n2_strip_punctuation",
       f"SELECT doc_id, {Q.strip_punct('text')} AS text_np FROM documents")
def n2(spark, sf):
    return docs(spark, sf).select("doc_id", X.strip_punctuation("text").alias("text_np"))


@query("n3_strip_numeric", f"SELECT doc_id, {Q.strip_num('text')} AS text_nd FROM documents")
def n3(spark, sf):
    return docs(spark, sf).select("doc_id", X.strip_numeric("text").alias("text_nd"))


@query("n4_remove_punctuation",
       f"SELECT doc_id, {Q.remove_punct('text')} AS text_np FROM documents")
def n4(spark, sf):
    return docs(spark, sf).select("doc_id", X.remove_punctuation("text").alias("text_np"))


@query("n5_remove_digits", f"SELECT doc_id, {Q.remove_digits('text')} AS text_nd FROM documents")
def n5(spark, sf):
    return docs(spark, sf).select("doc_id", X.remove_digits("text").alias("text_nd"))


@query("n6_tokenize", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {Q.tokenize(Q.prepare('text'))} AS toks FROM documents WHERE text IS NOT NULL)
""")
def n6(spark, sf):
    t = TK.doc_tokens(docs(spark, sf))
    return t.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


@query("n7_explode_tokens", f"""
SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS term
FROM (SELECT doc_id, {Q.tokenize(Q.prepare('text'))} AS toks FROM documents WHERE text IS NOT NULL)
""")
def n7(spark, sf):
    return base_tokens(spark, sf)


@query("n9_prepare", f"SELECT doc_id, {Q.prepare('text')} AS prepared FROM documents")
def n9(spark, sf):
    return docs(spark, sf).select("doc_id", X.prepare("text").alias("prepared"))


# ---------------------------------------------------------------- filters

_TOK_SQL = f"""
tok AS (SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS term
        FROM (SELECT doc_id, {Q.tokenize(Q.prepare('text'))} AS toks
              FROM documents WHERE text IS NOT NULL))"""


@query("f1_drop_stopwords", f"WITH {_TOK_SQL} SELECT doc_id, pos, term FROM tok WHERE term NOT IN {Q.STOP}")
def f1(spark, sf):
    return TK.drop_stopwords(base_tokens(spark, sf), TK.default_stop_words())


@query("f2_drop_rare", f"""
WITH {_TOK_SQL},
s AS (SELECT * FROM tok WHERE term NOT IN {Q.STOP}),
c AS (SELECT *, count(*) OVER (PARTITION BY term) AS cf FROM s)
SELECT doc_id, pos, term FROM c WHERE cf >= 2
""")
def f2(spark, sf):
    return TK.drop_rare(TK.drop_stopwords(base_tokens(spark, sf), TK.default_stop_words()), 2)


BATCHES = 4


@query("w2_batched_dictionary", f"""
WITH {Q.corpus_ctes(min_cf=1)}
SELECT term, token_id, cf, df, first_doc FROM dict
""")
def w2_batches(spark, sf):
    """The dictionary built from four batches of documents in id order: token ids and
    frequencies of one build over all of them."""
    from loomlex.operators import growing as GD
    tf = stage_table(TK.build_corpus(_scan_docs(spark, sf), min_cf=1).tf, "batched-counts")  # read by every batch
    last = tf.agg(F.max("doc_id")).first()[0] or 0
    part = F.floor(F.col("doc_id") * BATCHES / F.lit(last + 1))
    known = GD.start(tf.where(part == 0))
    for b in range(1, BATCHES):
        known = GD.add_batch(known, tf.where(part == b))
    return known.at()


@query("f3_min_length", f"WITH {_TOK_SQL} SELECT doc_id, pos, term FROM tok WHERE length(term) >= 3")
def f3(spark, sf):
    return TK.min_length(base_tokens(spark, sf), 3)


@query("f6_drop_null_docs", "SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL")
def f6(spark, sf):
    return docs(spark, sf).where(F.col("text").isNotNull()).select("doc_id", "n_chars")


@query("f8_drop_empty_docs", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 0")
def f8(spark, sf):
    return docs(spark, sf).where(F.length("text") > 0).select("doc_id", "n_chars")


# ---------------------------------------------------------------- corpus

@query("a1_term_freq", f"""
WITH {_TOK_SQL}
SELECT term, count(*) AS cf FROM tok WHERE term NOT IN {Q.STOP} GROUP BY term
""")
def a1(spark, sf):
    return TK.term_freq(TK.drop_stopwords(base_tokens(spark, sf), TK.default_stop_words()))


@query("a2_bow", f"WITH {Q.corpus_ctes()} SELECT doc_id, token_id, tf FROM bow")
def a2(spark, sf):
    return TK.build_corpus(_scan_docs(spark, sf)).bow.select("doc_id", "token_id", "tf")


@query("a3_dictionary", f"WITH {Q.corpus_ctes()} SELECT token_id, term, df, cf FROM dict")
def a3(spark, sf):
    return TK.build_corpus(_scan_docs(spark, sf)).dictionary.select("token_id", "term", "df", "cf")


@query("w2_token_ids", f"WITH {Q.corpus_ctes()} SELECT term, first_doc, token_id FROM dict")
def w2(spark, sf):
    return TK.build_corpus(_scan_docs(spark, sf)).dictionary.select("term", "first_doc", "token_id")


@query("j1_encode", f"WITH {Q.corpus_ctes()} SELECT doc_id, term, token_id, tf FROM bow")
def j1(spark, sf):
    c = TK.build_corpus(_scan_docs(spark, sf))
    return TK.encode(c.tf, c.dictionary, c.vocab_size).join(
        c.dictionary.select("token_id", "term"), "token_id").select("doc_id", "term", "token_id", "tf")


@query("j2_stop_anti_join", f"""
WITH {_TOK_SQL}
SELECT doc_id, pos, term FROM tok WHERE term NOT IN {Q.STOP}
""")
def j2(spark, sf):
    words = spark.createDataFrame([(w,) for w in TK.default_stop_words()], "word string")
    return TK.drop_stopwords(base_tokens(spark, sf), words)


@query("j3_freq_semi_join", f"""
WITH {Q.corpus_ctes()}
SELECT doc_id, term, tf FROM tf_all WHERE term IN (SELECT term FROM stats)
""")
def j3(spark, sf):
    c = TK.build_corpus(_scan_docs(spark, sf))
    return c.tf


@query("a5_num_docs", "SELECT count(*) AS n_docs FROM documents WHERE text IS NOT NULL")
def a5(spark, sf):
    return docs(spark, sf).where(F.col("text").isNotNull()).agg(F.count(F.lit(1)).alias("n_docs"))


@query("a11_doc_lengths", f"WITH {Q.corpus_ctes()} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS len FROM bow GROUP BY doc_id")
def a11(spark, sf):
    return WT.doc_lengths(TK.build_corpus(_scan_docs(spark, sf)).bow)


@query("a12_l2_norms", f"WITH {Q.corpus_ctes()} SELECT doc_id, round(norm, 6) AS norm FROM norms")
def a12(spark, sf):
    c = TK.build_corpus(_scan_docs(spark, sf))
    n = c.n_docs
    w = c.bow.select("doc_id", (F.col("tf") * F.log2(n.cast("double") / F.col("df"))).alias("w")) \
        .where(F.col("w") > 1e-12)
    return WT.l2_norms(w).select("doc_id", F.round("norm", 6).alias("norm"))


@query("t2_sorted_bow", f"""
WITH {Q.corpus_ctes()}
SELECT doc_id, string_agg(CAST(token_id AS VARCHAR) || ':' || CAST(tf AS VARCHAR), ' ' ORDER BY token_id) AS bow
FROM bow GROUP BY doc_id
""")
def t2(spark, sf):
    s = TK.sorted_bow(TK.build_corpus(_scan_docs(spark, sf)).bow)
    return s.select("doc_id", F.array_join(F.transform(
        "bow", lambda x: F.concat(x["token_id"].cast("string"), F.lit(":"), x["tf"].cast("string"))),
        " ").alias("bow"))


@query("m1_tfidf", f"WITH {Q.corpus_ctes()} SELECT doc_id, token_id, round(weight, 6) AS weight FROM tfidf")
def m1(spark, sf):
    c = TK.build_corpus(_scan_docs(spark, sf))
    return WT.tfidf(c.bow, c.n_docs).select("doc_id", "token_id", F.round("weight", 6).alias("weight"))


def top_terms_per_doc(spark: SparkSession, sf: str, n: int = 5) -> DataFrame:
    """Minimum slice: top-n TF-IDF terms per document (ties by term)."""
    c = TK.build_corpus(_scan_docs(spark, sf))
    w = WT.tfidf(c.bow, c.n_docs)
    # frequent terms come by broadcast, so that their rows stay with their documents
    w = join_head_tail(w, c.dictionary.select("token_id", "term", "df"), "token_id", "df").drop("df")
    rank = Window.partitionBy("doc_id").orderBy(F.desc(TV.rank_key(F.col("weight"))), "term")
    return w.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n) \
        .select("doc_id", "rank", "term", F.round("weight", 6).alias("weight"))


TOP_TERMS_SQL = f"""
WITH {Q.corpus_ctes()},
r AS (SELECT doc_id, term, weight,
             row_number() OVER (PARTITION BY doc_id ORDER BY floor(weight * 1e9 + 0.5) DESC, term) AS rank
      FROM tfidf)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 5
"""

QUERIES["c1_top_terms_per_doc"] = top_terms_per_doc
ORACLES["c1_top_terms_per_doc"] = TOP_TERMS_SQL.strip()


_PARTS = ("loomlex.plans.registry_topics", "loomlex.plans.registry_sources",
          "loomlex.plans.registry_entities", "loomlex.plans.registry_files")


def _load_parts() -> None:
    import importlib
    for mod in _PARTS:
        try:
            importlib.import_module(mod)
        except ModuleNotFoundError as e:
            if e.name != mod:
                raise


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_parts()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_parts()
    return dict(ORACLES)
