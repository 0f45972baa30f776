"""FIXTURES.md §3.5 entity goldens (gazetteer-tagged)."""

import pytest

from loomlex.operators import entities as EN
from loomlex.plans.jobs import entity_job


@pytest.fixture(scope="module")
def report(spark):
    docs = spark.createDataFrame([(0, "Ann met Bob, in Paris."), (1, "Paris")], "doc_id bigint, text string")
    gaz = spark.createDataFrame([("ann", "PERSON"), ("bob", "PERSON"), ("paris", "GPE")],
                                "term string, ent_type string")
    types = spark.createDataFrame([("person", 1), ("gpe", 1), ("org", 1), ("date", 0)],
                                  "ent_type string, flag int")
    # no regex rules: the gazetteer alone decides the types
    return entity_job(docs, types, rules=[], gazetteer=gaz), docs


def test_tokens_offsets(spark):
    docs = spark.createDataFrame([(0, "Ann met Bob, in Paris.")], "doc_id bigint, text string")
    toks = [(r.token, r.char_start, r.char_end, r.is_punct, r.span_end)
            for r in EN.offset_tokens(docs).orderBy("pos").collect()]
    assert toks == [("Ann", 0, 3, False, 3), ("met", 4, 7, False, 7), ("Bob", 8, 11, False, 12),
                    (",", 11, 12, True, 12), ("in", 13, 15, False, 15), ("Paris", 16, 21, False, 22),
                    (".", 21, 22, True, 22)]


def test_spans(report):
    out, _ = report
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in out["spans"].collect()}
    assert spans == {0: [(0, 3, "PERSON"), (8, 12, "PERSON"), (16, 22, "GPE")]}


def test_type_counts(report):
    out, _ = report
    got = {(r.doc_id, r.ent_type): r.n for r in out["type_counts"].collect()}
    assert got == {(0, "person"): 2, (0, "gpe"): 1, (0, "org"): 0,
                   (1, "person"): 0, (1, "gpe"): 0, (1, "org"): 0}


def test_histogram_and_points(report):
    out, _ = report
    hist = sorted(tuple(r) for r in out["histogram"].collect())
    assert hist == [("gpe", "Paris", 1), ("person", "Ann", 1), ("person", "Bob", 1)]
    pts = sorted(tuple(r) for r in out["points"].collect())
    assert pts == [(0, 0, 0), (0, 0, 1), (0, 0, 2)]


def test_keep_mentions_table(spark):
    df = spark.createDataFrame([("PERSON",), ("person",), ("ORG",), ("date",)], "ent_type string")
    types = spark.createDataFrame([("person",), ("PERSON",)], "ent_type string")
    assert sorted(r[0] for r in EN.keep_mentions(df, types).collect()) == ["PERSON", "person"]


def test_keep_mentions_table_keeps_repeats(spark):
    df = spark.createDataFrame([("PERSON",)] * 3 + [("date",)], "ent_type string")
    types = spark.createDataFrame([("person",), ("PERSON",)], "ent_type string")
    assert [r[0] for r in EN.keep_mentions(df, types).collect()] == ["PERSON"] * 3
    assert EN.keep_mentions(df, types).columns == ["ent_type"]


def test_gazetteer_clash_and_long_names(spark):
    docs = spark.createDataFrame([(0, "Washington saw New  York City, New York."), (1, "x New")], "doc_id bigint, text string")
    gaz = spark.createDataFrame([("Washington", "PERSON"), ("washington", "GPE"), ("new york", "GPE"),
                                 ("New York City", "GPE"), ("New", "ORG")], "term string, ent_type string")
    m = EN.mentions(docs, ["gpe", "org"], rules=[], gazetteer=gaz)
    got = sorted((r.doc_id, r.char_start, r.token, r.ent_type, r.span_end) for r in m.collect())
    assert got == [(0, 0, "Washington", "GPE", 10), (0, 15, "New York City", "GPE", 30), (0, 31, "New York", "GPE", 40)]


def test_upper_case_type_names_are_counted(spark):
    docs = spark.createDataFrame([(0, "Ann met Bob, in Paris.")], "doc_id bigint, text string")
    m = EN.mentions(docs, ["PERSON"])
    got = {r.ent_type: r.n for r in EN.entity_type_counts(m, docs, ["PERSON", "it's"]).collect()}
    assert got == {"PERSON": 3, "it's": 0}


def test_badly_encoded_documents_are_skipped(spark):
    docs = spark.createDataFrame([(0, bytearray(b"Ann met Bob")), (1, bytearray(b"Ann \xff Bob")), (2, None)],
                                 "doc_id bigint, content binary")
    assert [r.doc_id for r in EN.mentions(docs, ["person"]).collect()] == [0]


def test_places(spark):
    nation = spark.createDataFrame([("NATION_0",)], "n_name string")
    region = spark.createDataFrame([("MIDDLE EAST",)], "r_name string")
    docs = spark.createDataFrame([(0, "in the middle east of it")], "doc_id bigint, text string")
    got = [(r.token, r.ent_type) for r in EN.mentions(docs, gazetteer=EN.places(nation, region)).collect()]
    assert got == [("middle east", "GPE")]


def test_offsets_equal_a_regex_scan(spark):
    """Non-ASCII letters, runs of marks, blanks only, empty and null texts."""
    import random
    import re
    rng = random.Random(5)
    texts = ["", "  ", "é", "...", "a", ".a.", "x\u00a0y \U0001f600!", None] + [
        "".join(rng.choice("ab é\u4e2d.,! \n\t") for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {}
    for r in EN.offset_tokens(docs).collect():
        got.setdefault(r.doc_id, {})[r.pos] = (r.token, r.char_start, r.char_end, r.is_punct, r.span_end, r.n_tokens)
    for d, text in enumerate(texts):
        ms = list(re.finditer(EN.TOKEN_RE, text or ""))
        want = {}
        for i, m in enumerate(ms):
            j = i
            while j + 1 < len(ms) and re.fullmatch(EN.PUNCT_CLASS, ms[j + 1][0]):
                j += 1
            want[i] = (m[0], m.start(), m.end(), bool(re.fullmatch(EN.PUNCT_CLASS, m[0])), ms[j].end(), len(ms))
        assert got.get(d, {}) == want


def test_candidates_hold_all_mentions(spark):
    """Tokens that no enabled rule matches stay in the task; the mentions are those of all tokens."""
    text = "Anna met IBM in Paris, in 1999. anna \u00c9mile Zo\u00e9 NATO\u2028 x End"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "no names here")], "doc_id bigint, text string")
    java = [("ORG", r"^\p{Lu}{2,}$"), ("PERSON", "^[A-Z&&[^B]][a-z]+$")]
    for types, rules in ((["person", "org"], EN.ENTITY_RULES), (["date"], EN.ENTITY_RULES), (["", "person"], EN.ENTITY_RULES),
                         (["person", "org"], java), (["none"], EN.ENTITY_RULES)):
        got = EN.mentions(docs, types, rules)
        want = EN.keep_mentions(EN.drop_last(EN.tag_entities(EN.offset_tokens(docs), rules)), types).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = EN.candidate_tokens(docs, ["person", "org"])
    assert kept.count() < EN.offset_tokens(docs).count()
    assert [r.token for r in kept.where("doc_id = 4").collect()] == []


def test_mentions_are_read_from_a_table(spark):
    """The report's parts and the two writes of K5 do not tokenise the texts again."""
    docs = spark.createDataFrame([(1, "a", "Anna met IBM there."), (2, "b", "Bob saw Anna twice.")], "doc_id bigint, source string, text string")
    rep = entity_job(docs, image_col="source")
    for part in ("mentions", "spans", "type_counts", "histogram", "points"):
        assert "MapInArrow" not in rep[part]._jdf.queryExecution().executedPlan().toString(), part
    assert {(r.ent_type, r.surface, r.n) for r in rep["histogram"].collect()} >= {("person", "Anna", 2), ("org", "IBM", 1)}


def test_written_records_and_batches_are_staged(spark, monkeypatch):
    """K5's records and the counts of the batched dictionary are built once, then read."""
    import __spark_entry__ as E
    from loomlex.operators import growing as GD
    from loomlex.sinks import writers as W
    plans = []

    def spy(fn):
        def run(*args, **kwargs):
            frame = next(a for a in reversed(args) if hasattr(a, "schema")) if fn is not W.write_spans else args[0]
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
            return fn(*args, **kwargs)
        return run

    for module, name in ((W, "write_spans"), (GD, "start"), (GD, "add_batch")):
        monkeypatch.setattr(module, name, spy(getattr(module, name)))
    for query in ("k5_span_documents", "w2_batched_dictionary"):
        E.queries()[query](spark, "/root/testdata/sf0.001")
    assert len(plans) >= 6 and not any("MapInArrow" in p or "Join" in p for p in plans)
