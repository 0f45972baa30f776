"""FIXTURES.md §3.1 corpus: tokens, dictionary ids, BoW and TF-IDF goldens."""

import pytest

from loomlex.operators import tokens as TK
from loomlex.operators import weights as WT

TEXTS = ["The café-cat sat; the CAT sat 3.14 times!",
         "Cat times cats, excludeme dog_dog abc123def abcdef",
         "1234 !!!",
         "sat cats on"]
STOP = ["the", "on", "excludeme", "andme"]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    return TK.build_corpus(docs, STOP)


def test_dictionary(corpus):
    got = {r["term"]: (r["token_id"], r["df"]) for r in corpus.dictionary.collect()}
    assert got == {"cat": (0, 2), "sat": (1, 2), "times": (2, 2), "abcdef": (3, 1),
                   "cats": (4, 2), "dog": (5, 1)}
    assert corpus.vocab_size == 6


def test_bow(corpus):
    got = sorted((r.doc_id, r.token_id, r.tf) for r in corpus.bow.collect())
    assert got == [(0, 0, 2), (0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 2, 1), (1, 3, 2), (1, 4, 1),
                   (1, 5, 2), (3, 1, 1), (3, 4, 1)]


def test_tfidf(corpus):
    w = {(r.doc_id, r.token_id): round(r.weight, 6) for r in WT.tfidf(corpus.bow, corpus.n_docs).collect()}
    assert w == {(0, 0): 0.666667, (0, 1): 0.666667, (0, 2): 0.333333,
                 (1, 0): 0.169031, (1, 2): 0.169031, (1, 3): 0.676123, (1, 4): 0.169031, (1, 5): 0.676123,
                 (3, 1): 0.707107, (3, 4): 0.707107}


def test_corpus_frequency_before_rare_filter(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    toks = TK.drop_stopwords(TK.explode_tokens(TK.doc_tokens(docs)), STOP)
    cf = {r.term: r.cf for r in TK.term_freq(toks).collect()}
    assert {k: cf[k] for k in ["caf", "cat", "sat", "times", "cats", "dog", "abcdef"]} == \
        {"caf": 1, "cat": 3, "sat": 3, "times": 2, "cats": 2, "dog": 2, "abcdef": 2}


def test_stopwords_array_keeps_duplicates(spark):
    df = spark.createDataFrame([(["a", "the", "a", "b"],)], "t array<string>")
    assert df.select(TK.drop_stopwords_array("t", ["the"])).first()[0] == ["a", "a", "b"]


def test_count_words_and_map_drop(spark):
    df = spark.createDataFrame([(1, "b a b The")], "id int, text string")
    m = TK.count_words(df, "id", "text")
    got = m.select(TK.map_drop_keys("counts", ["the"]).alias("m")).first()["m"]
    assert dict(got) == {"a": 1, "b": 2}


def test_trim_rare(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "y"), (2, "y"), (2, "the"), (2, "the")],
                               "doc_id int, term string")
    got = sorted(tuple(r) for r in TK.trim_rare(df, "doc_id", 2, ["the"]).collect())
    assert got == [(1, "x"), (1, "x"), (2, "y"), (2, "y")]


def test_counts_are_taken_where_texts_are_read(spark):
    """Counts of the cleaned tokens without a shuffle of token rows; an id that comes twice, or
    is null, has one count per term."""
    texts = ["Ab,ab\x1fCAFÉ caf1\x0b9 x", "", "ab ab ab", None, "don't Don T", "ab\x00 \x7fab\r\nİi"]
    rows = [(i // 2 if i < 4 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = TK.term_counts(TK.explode_tokens(TK.doc_tokens(docs)).select("doc_id", "term"))
    for d in (docs, docs.where("doc_id = 0").limit(1)):
        got = [tuple(r) for r in TK.doc_term_counts(d).collect()]
        ids = {r.doc_id for r in d.collect()}
        assert sorted(got, key=str) == sorted((tuple(r) for r in TK.term_counts(
            TK.explode_tokens(TK.doc_tokens(d)).select("doc_id", "term")).collect()), key=str) and {g[0] for g in got} <= ids
    assert len([tuple(r) for r in want.collect()]) == TK.doc_term_counts(docs).count()
