"""Gazetteer names of any length and the tagger hook."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomlex.operators import entities as EN
from loomlex.operators import names as NM

DOCS = "doc_id bigint, text string"
GAZ = "term string, ent_type string"


def brute(docs, gaz):
    names = {}
    for term, kind in gaz:
        key = tuple(m[0].lower() for m in re.finditer(EN.TOKEN_RE, term or ""))
        if key and kind is not None:
            names[key] = min(kind, names.get(key, kind))
    out = []
    for doc, text in docs:
        toks = [m[0] for m in re.finditer(EN.TOKEN_RE, text or "")]
        low, i = [t.lower() for t in toks], 0
        while i < len(toks):
            size = max((n for n in range(1, len(toks) - i + 1) if tuple(low[i:i + n]) in names), default=0)
            if size:
                out.append((doc, i, " ".join(toks[i:i + size]), names[tuple(low[i:i + size])], size))
            i += max(size, 1)
    return sorted(out, key=str)


def marked(df):
    return sorted(((r.doc_id, r.pos, r.name, r.name_type, r.name_n) for r in df.where("name IS NOT NULL").collect()), key=str)


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_names_of_any_length(spark, max_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["new", "York", "of", "É", "x.y", "the", "St.", "AND", "zz"])
    gaz = [(" ".join(word() for _ in range(rng.randrange(1, 13))), rng.choice(["GPE", "ORG"])) for _ in range(120)]
    gaz += [("saint vincent and the grenadines", "GPE"), (" ".join(["long"] * 40), "ORG"), (None, "GPE"), ("x", None), ("", "GPE"), ("  ", "ORG")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 80)))) for i in range(150)]
    docs += [(900, "In Saint  Vincent\nand the GRENADINES, new york."), (901, None), (902, ""), (903, "long " * 130), (904, "...")]
    df = spark.createDataFrame(docs, DOCS).withColumn("name", F.lit("x")).repartition(3)
    got = EN.named_tokens(df, spark.createDataFrame(gaz, GAZ), max_bytes=max_bytes)
    assert marked(got) == brute(docs, gaz)
    assert got.count() == EN.offset_tokens(df).count()  # every token once
    inside = {(r.doc_id, r.pos) for r in got.where("in_name").collect()}
    assert inside == {(d, p + k) for d, p, _, _, n in brute(docs, gaz) for k in range(1, n)}


def test_overfull_filter_stays_exact(spark, monkeypatch):
    """With a filter that lets nearly everything through the join still decides."""
    monkeypatch.setattr(NM, "BLOOM_BITS_MAX", 10)
    rng = random.Random(8)
    gaz = [(f"w{rng.randrange(60)} w{rng.randrange(60)} w{rng.randrange(60)}", "GPE") for _ in range(900)]
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(60))) for i in range(60)]
    got = EN.named_tokens(spark.createDataFrame(docs, DOCS), spark.createDataFrame(gaz, GAZ), max_bytes=0)
    assert marked(got) == brute(docs, gaz)


def test_empty_gazetteer_and_tables(spark):
    docs, none = spark.createDataFrame([(1, "Ann in Rome")], DOCS), spark.createDataFrame([], GAZ)
    for limit in (1 << 26, -1):
        assert marked(EN.named_tokens(docs, none, max_bytes=limit)) == []
        assert EN.named_tokens(docs.limit(0), spark.createDataFrame([("a", "b")], GAZ), max_bytes=limit).count() == 0


def test_name_stands_before_rules(spark):
    docs = spark.createDataFrame([(0, "Ann Lee of New York City saw Bob.")], DOCS)
    gaz = spark.createDataFrame([("new york city", "GPE"), ("York", "ORG")], GAZ)
    got = [(r.token, r.ent_type) for r in EN.mentions(docs, gazetteer=gaz).orderBy("pos").collect()]
    assert got == [("Ann", "PERSON"), ("Lee", "PERSON"), ("New York City", "GPE"), ("Bob", "PERSON")]


# ------------------------------------------------------------ tagger hook

def taggers():
    """Nested functions travel to the workers by value."""
    def upper(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("cannot")
        return [[(m.start(), m.end(), "ORG") for m in re.finditer(r"[A-Z]+( [A-Z]+)*", t)] for t in texts]

    def odd(texts):
        return [[(0, 99, "X")] if "bad" in t else [(2, 7, "B"), (0, 9, "A"), (0, 9, "C")] for t in texts]

    def short(texts):
        return [[] for _ in texts[1:]] if len(texts) > 1 else [[(0, 1, "ONE")]]
    return upper, odd, short


upper_tagger, odd_tagger, short_tagger = taggers()


def test_tagger_skips_failing_documents(spark):
    docs = spark.createDataFrame([(0, "the ACME CORP, é UN here"), (1, "this will fail"), (2, None), (3, ""), (4, "  "), (5, "IBM")], DOCS).coalesce(1)
    got = [(r.doc_id, r.token, r.ent_type) for r in EN.tagger_tokens(docs, upper_tagger).orderBy("doc_id", "pos").collect()]
    assert got == [(0, "the", ""), (0, "ACME", "ORG"), (0, "CORP", "ORG"), (0, ",", ""), (0, "é", ""), (0, "UN", "ORG"),
                   (0, "here", ""), (5, "IBM", "ORG")]
    assert [tuple(r) for r in EN.tagger_failures(docs, upper_tagger).collect()] == [(1, "RuntimeError: cannot")]
    m = EN.mentions(docs, ["org"], tagger=upper_tagger)
    assert [(r.token, r.char_start, r.span_end) for r in m.orderBy("doc_id", "pos").collect()] == [("ACME", 4, 8), ("CORP", 9, 14), ("UN", 17, 19)]


def test_tagger_spans_are_aligned(spark):
    docs = spark.createDataFrame([(0, "abc defgh ij"), (1, "bad")], DOCS)
    inside = [(r.token, r.ent_type) for r in EN.tagger_tokens(docs, odd_tagger).orderBy("pos").collect()]
    assert inside == [("abc", "A"), ("defgh", "A"), ("ij", "")]
    assert EN.tagger_failures(docs, odd_tagger).count() == 1
    part = spark.createDataFrame([(0, "abcd defgh ij")], DOCS)
    over = [(r.token, r.ent_type) for r in EN.tagger_tokens(part, odd_tagger, align="overlap").orderBy("pos").collect()]
    within = [(r.token, r.ent_type) for r in EN.tagger_tokens(part, odd_tagger).orderBy("pos").collect()]
    assert over == [("abcd", "A"), ("defgh", "A"), ("ij", "")] and within == [("abcd", "A"), ("defgh", ""), ("ij", "")]
    with pytest.raises(ValueError):
        EN.tagger_tokens(docs, odd_tagger, align="near")


def test_tagger_with_wrong_number_of_results(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "c d")], DOCS).coalesce(1)
    assert {r.ent_type for r in EN.tagger_tokens(docs, short_tagger).where("pos = 0").collect()} == {"ONE"}
