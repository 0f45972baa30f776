"""Tokens, stop words, frequencies, dictionary and bag of words.

Long form is the working shape: ``(doc_id, pos, term)`` for tokens and
``(doc_id, term, tf)`` for per-document counts.  Every aggregate below is a
hash aggregate with a map-side partial step, so a hot term or a huge
document is pre-combined inside each task before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlex.functions.constants import CONFIG_EXCLUDE_WORDS, DIGITS, EN_STOP_WORDS, PUNCTUATION
from loomlex.functions.text import prepare, tokenize
from loomlex.operators.ids import dense_ids
from loomlex.operators.joins import join_bounded, join_head_tail
from loomlex.session import ship_package, stage_table


def default_stop_words(extra: list[str] | None = None) -> list[str]:
    """The English list followed by configured words (duplicates kept
    out)."""
    words = list(EN_STOP_WORDS)
    for w in (CONFIG_EXCLUDE_WORDS if extra is None else extra):
        if w not in words:
            words.append(w)
    return words


def stop_union(a: DataFrame, b: DataFrame, col: str = "word") -> DataFrame:
    """U3 on tables: union of two word tables, distinct."""
    return a.select(col).unionByName(b.select(col)).distinct()


# --------------------------------------------------------------------------
# N6 / N7 / F1 / F3
# --------------------------------------------------------------------------

def doc_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keep_unicode: bool = False) -> DataFrame:
    """N9 + N6: ``(doc_id, tokens ARRAY<STRING>)``; NULL texts are dropped
    (F6), empty texts give an empty array and still count as documents."""
    return docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        tokenize(prepare(text_col, keep_unicode)).alias("tokens"))


def explode_tokens(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """One row per token with its 0-based position.

    The outer explode keeps Catalyst from inferring ``size(tokens) > 0`` and
    evaluating the whole token expression a second time below the filter."""
    others = [c for c in df.columns if c != tokens_col]
    return df.select(*others, F.posexplode_outer(tokens_col).alias("pos", "term")).where("pos IS NOT NULL")


def drop_stopwords(df: DataFrame, words: list[str] | DataFrame, col: str = "term",
                   word_col: str = "word") -> DataFrame:
    """Remove stop words from the long form.

    A Python list becomes an ``IN`` set evaluated inside codegen (no join);
    a word table is anti-joined, broadcast only under a checked size."""
    if isinstance(words, DataFrame):
        table = words.select(F.col(word_col).alias(col)).distinct()
        return join_bounded(df, table, col, "left_anti")
    return df.where(~F.col(col).isin(list(words)))


def drop_stopwords_array(tokens: Column | str, words: list[str]) -> Column:
    """F1 on arrays: keeps duplicates and order (unlike ``array_except``)."""
    arr = F.array(*[F.lit(w) for w in words])
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(col, lambda x: ~F.array_contains(arr, x))


def min_length(df: DataFrame, n: int = 3, col: str = "term") -> DataFrame:
    """keep tokens of at least ``n`` characters."""
    return df.where(F.length(col) >= n)


# --------------------------------------------------------------------------
# A1 / A2 / F2 / A3 / W2 / J1
# --------------------------------------------------------------------------

def term_counts(tokens: DataFrame) -> DataFrame:
    """A2 (before ids): ``(doc_id, term, tf)``."""
    return tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _plain_bytes() -> tuple[bytes, bytes]:
    """N9 + the lower case of N6 on the bytes of a text: what every byte becomes (punctuation
    and whitespace a space), and the bytes that go (digits, non-ASCII characters)."""
    space = b"\t\n\x0b\f\r\x1c\x1d\x1e\x1f" + PUNCTUATION.encode()
    table = bytes(0x20 if b in space else b for b in range(256)).lower()
    return table, DIGITS.encode() + bytes(range(0x80, 0x100))


# Documents and entries of one Arrow batch of counts.
COUNT_DOCS, COUNT_ROWS = 256, 200_000


def _count_batches(batches):
    """(doc_id, UTF-8 text) -> (doc_id, term, tf), one row per document row and term."""
    table, gone = _plain_bytes()

    def counted(held):
        ids, sizes, terms, counts = zip(*held)
        term = pa.array([t for part in terms for t in part], pa.binary()).cast(pa.string())
        at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        return pa.RecordBatch.from_pydict({"doc_id": pa.concat_arrays(ids).take(at), "term": term,
                                           "tf": pa.array([n for part in counts for n in part], pa.int64())})

    held, rows = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, COUNT_DOCS):
            part = batch.slice(lo, COUNT_DOCS)
            for i, text in enumerate(part["text"].to_pylist()):
                tf = Counter(text.translate(table, gone).split())
                held.append((part["doc_id"].slice(i, 1), len(tf), list(tf), list(tf.values())))
                rows += len(tf)
                if rows >= COUNT_ROWS:
                    yield counted(held)
                    held, rows = [], 0
    if held:
        yield counted(held)


def doc_term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """N9 + N6 + A2: ``(doc_id, term, tf)``, staged.

    Each text is cleaned, split and counted where it is read, so its tokens never become
    rows; only if a document id comes in several rows are the counts added up
    by a shuffle."""
    ship_package(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    tf = stage_table(texts.mapInArrow(_count_batches, f"doc_id {kind}, term string, tf bigint"), "term-counts")
    if texts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        tf = stage_table(tf.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")), "term-counts")
    return tf


def term_freq(df: DataFrame) -> DataFrame:
    """A1: corpus frequency ``(term, cf)`` from tokens or from ``tf`` rows."""
    if "tf" in df.columns:
        return df.groupBy("term").agg(F.sum("tf").alias("cf"))
    return df.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def drop_rare(df: DataFrame, min_cf: int = 2) -> DataFrame:
    """Drop tokens whose corpus frequency is below ``min_cf``.

    The tokens are read twice (count and filter), so they are staged first."""
    df = stage_table(df, "tokens")
    keep = stage_table(term_freq(df).where(F.col("cf") >= min_cf), "term-counts")
    return join_head_tail(df, keep.withColumnRenamed("cf", "_cf"), "term", "_cf").select(*df.columns)


def term_stats(tf: DataFrame) -> DataFrame:
    """A3: per term: corpus frequency, document frequency, first document."""
    return tf.groupBy("term").agg(
        F.sum("tf").alias("cf"),
        F.count(F.lit(1)).alias("df"),
        F.min("doc_id").alias("first_doc"))


def assign_token_ids(stats: DataFrame) -> DataFrame:
    """Token ids by first document, then term order inside it."""
    return dense_ids(stats, ["first_doc", "term"], "token_id")


def encode(tf: DataFrame, dictionary: DataFrame, dict_rows: int | None = None) -> DataFrame:
    """J1 + A2: ``(doc_id, token_id, tf)``; the dictionary is broadcast only
    within the measured byte bound, otherwise a shuffle join (skew handled by
    AQE)."""
    d = dictionary.select("term", "token_id")
    return join_bounded(tf, d, "term", "inner", known_rows=dict_rows) \
        .select("doc_id", "token_id", "tf")


def sorted_bow(bow: DataFrame) -> DataFrame:
    """Per document, ``(token_id, tf)`` pairs ordered by token id."""
    return bow.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("token_id", "tf"))).alias("bow"))


def num_docs(docs: DataFrame, text_col: str = "text") -> Column:
    """A5: number of (non-NULL) documents as a lazy scalar column."""
    return docs.where(F.col(text_col).isNotNull()).select(F.count(F.lit(1))).scalar()


@dataclass
class Corpus:
    """Outputs of the corpus build (C1 stages up to the bag of words)."""
    tf: DataFrame          # (doc_id, term, tf) after F1/F3/F2
    dictionary: DataFrame  # (token_id, term, df, cf, first_doc)
    bow: DataFrame         # (doc_id, token_id, tf, df)
    n_docs: Column         # all documents, empty ones included
    vocab_size: int


def build_corpus(docs: DataFrame, stop_words: list[str] | DataFrame | None = None,
                 min_cf: int = 2, min_len: int = 3, id_col: str = "doc_id",
                 text_col: str = "text", keep_unicode: bool = False) -> Corpus:
    """N9 -> N6 -> F1 -> F3 -> F2 -> W2 -> A2 in one plan.

    F1 and F3 only look at the token itself, so they commute with the count
    and with F2.  The counts are staged once: the dictionary and the bag of
    words both read them.
    """
    words = default_stop_words() if stop_words is None else stop_words
    if keep_unicode:
        toks = explode_tokens(doc_tokens(docs, id_col, text_col, keep_unicode))
        toks = min_length(drop_stopwords(toks.select("doc_id", "term"), words), min_len)
        tf_all = stage_table(term_counts(toks), "term-counts")
    else:
        tf_all = min_length(drop_stopwords(doc_term_counts(docs, id_col, text_col), words), min_len)
    stats = term_stats(tf_all).where(F.col("cf") >= min_cf)
    dictionary = assign_token_ids(stats)
    vocab = dictionary.count()
    bow_full = join_head_tail(tf_all, dictionary.select("term", "token_id", "df"), "term", "df")
    tf = bow_full.select("doc_id", "term", "tf")
    bow = bow_full.select("doc_id", "token_id", "tf", "df")
    return Corpus(tf=tf, dictionary=dictionary, bow=bow,
                  n_docs=num_docs(docs, text_col), vocab_size=vocab)


# --------------------------------------------------------------------------
# Word-count maps of line documents
# --------------------------------------------------------------------------

def count_words(df: DataFrame, id_cols: str | list[str], text_col: str = "text") -> DataFrame:
    """A4: per document a ``MAP<term, count>`` of lowercased whitespace
    tokens (built from a grouped count, never a per-row Python dict)."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    toks = df.select(*ids, F.explode_outer(tokenize(text_col)).alias("term")).where("term IS NOT NULL")
    counts = toks.groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*ids).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("counts"))


def map_drop_keys(m: Column | str, words: list[str]) -> Column:
    """remove stop-word keys from a count map."""
    arr = F.array(*[F.lit(w) for w in words])
    col = F.col(m) if isinstance(m, str) else m
    return F.map_filter(col, lambda k, v: ~F.array_contains(arr, k))


def trim_rare(tokens: DataFrame, group_col: str, threshold: int = 2,
              words: list[str] | None = None) -> DataFrame:
    """per group (file), keep tokens seen at least ``threshold`` times
    in that group and not in ``words``: the token rows, semi-joined to the kept
    ``(group, term)`` pairs."""
    t = tokens if not words else drop_stopwords(tokens, words)
    counts = trimmed_counts(t, group_col, threshold)
    return t.join(counts.select(group_col, "term"), [group_col, "term"], "left_semi")


def trimmed_counts(tokens: DataFrame, group_col: str, threshold: int = 2,
                   words: list[str] | None = None) -> DataFrame:
    """F13 as counts: ``(group, term, n)`` of the kept tokens, one row each
    however often a term is repeated."""
    t = tokens if not words else drop_stopwords(tokens, words)
    return t.groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def union_docs(*dfs: DataFrame) -> DataFrame:
    """Concatenate document collections (by column name)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
