"""Reusable SQL fragments for the DuckDB oracles (same regex text as the
Spark expressions, so both sides implement the same definition)."""

from __future__ import annotations

from loomlex.functions import text as T
from loomlex.functions.constants import DIGITS, PUNCTUATION
from loomlex.operators.tokens import default_stop_words


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def rx(col: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({col}, {lit(pattern)}, {lit(repl)}, 'g')"


def ascii_only(col: str) -> str:
    return rx(col, T.NON_ASCII_RE, "")


def strip_punct(col: str) -> str:
    return rx(col, T.PUNCT_RUN_RE, " ")


def strip_num(col: str) -> str:
    return rx(col, T.DIGIT_RUN_RE, "")


def prepare(col: str) -> str:
    return strip_num(strip_punct(ascii_only(col)))


def tokenize(col: str) -> str:
    return (f"list_filter(string_split_regex(lower({col}), {lit(T.WHITESPACE_RUN_RE)}), "
            f"lambda x: x <> '')")


def remove_punct(col: str) -> str:
    return f"translate({col}, {lit(PUNCTUATION)}, '')"


def remove_digits(col: str) -> str:
    return f"translate({col}, {lit(DIGITS)}, '')"


STOP = in_list(default_stop_words())


def corpus_ctes(min_cf: int = 2, min_len: int = 3, stop: str = STOP) -> str:
    """docs -> tokens -> F1/F3 -> tf_all -> dict (W2) -> bow -> tfidf."""
    return f"""
docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
prep AS (SELECT doc_id, {tokenize(prepare('text'))} AS toks FROM docs),
tok AS (SELECT doc_id, unnest(toks) AS term FROM prep),
kept AS (SELECT doc_id, term FROM tok WHERE term NOT IN {stop} AND length(term) >= {min_len}),
tf_all AS (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY doc_id, term),
stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, min(doc_id) AS first_doc
          FROM tf_all GROUP BY term HAVING sum(tf) >= {min_cf}),
dict AS (SELECT term, cf, df, first_doc,
                row_number() OVER (ORDER BY first_doc, term) - 1 AS token_id FROM stats),
bow AS (SELECT t.doc_id, d.token_id, t.term, t.tf, d.df FROM tf_all t JOIN dict d USING (term)),
ndocs AS (SELECT count(*) AS n FROM docs),
wraw AS (SELECT doc_id, token_id, term, tf * log2(CAST((SELECT n FROM ndocs) AS DOUBLE) / df) AS w FROM bow),
wpos AS (SELECT * FROM wraw WHERE w > 1e-12),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wpos GROUP BY doc_id),
tfidf AS (SELECT doc_id, token_id, term, w / norm AS weight FROM wpos JOIN norms USING (doc_id))
"""
