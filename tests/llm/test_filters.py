"""Quality, decontamination, URL filters, HTML text and personal data."""

import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlex.llm import decontaminate, html_text, pii, quality, url_filter

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


# ------------------------------------------------------------ quality

@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return quality.report(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_ranking(scored):
    """Held-out area under the curve, and agreement at the threshold."""
    x = scored[scored.held_out & scored.quality.notna()]
    good, bad = x.score[x.quality == 1].to_numpy(), x.score[x.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (x.predicted == x.quality).mean() > 0.93
    assert (x.predicted[x.quality == 1] == 1).mean() > 0.95


def test_scores_are_probabilities(scored):
    import zlib
    assert len(scored) == 1000 and scored.score.between(0, 1).all()
    assert (scored.predicted == (scored.score >= 0.7)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in zip(scored.doc_id, scored.held_out))


def test_only_the_text_counts(spark):
    """Other columns and ids do not change a score; edge texts get one."""
    rows = [(i, ("fine plain words here " if i % 3 else "bad!! ###$$$ *** ") * (i % 5 + 2)) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "fine plain words here " * 5000), (None, "fine"), (903, "x"), (903, "x")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(901, None), (None, 1), (12345, 0), (3, 0)],
                                   "doc_id long, quality int")
    a = quality.report(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")), labels)
    got = {(r.doc_id, r.score) for r in a.collect()}
    assert a.count() == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = {}
    for r in a.collect():
        by[r.doc_id] = r.score
    assert by[900] == by[901] and by[4] > 0.7 > by[3]
    assert quality.report(spark.createDataFrame([], SCHEMA), labels).count() == 0
    none = quality.report(spark.createDataFrame(rows, SCHEMA), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}


def test_a_chunk_is_worked_off_in_parts():
    """The rows of a chunk's words, some hundred times its bytes, are never held all at once,
    and a text's features do not depend on the texts beside it."""
    import tracemalloc

    import pyarrow as pa
    texts = [" ".join(f"w{(i * 7 + j) % 911}" for j in range(i % 300)) for i in range(3000)] + ["", "one " * 100_000]
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    assert len(data) > 2 << 20
    short = len(texts) - 1  # without the long text, which cannot be parted
    tracemalloc.start()
    quality.pooled(data[:offs[short]], offs[:short + 1], vectors)
    pooled = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    list(quality._contexts(iter([pa.RecordBatch.from_pydict({"text": texts[:short]})])))
    contexts = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pooled < 50 << 20 and contexts < 90 << 20
    assert np.array_equal(quality.pooled(data, offs, vectors), quality.pool(data, offs, vectors))


def test_keep_good_keeps_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("_lx_score", F.lit("x")).withColumn("score", F.lit(0))
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and 500 < out.count() < 1000


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, quality.FEATURES))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = quality.train(x[:3000], y[:3000])
    p = net.probability(x[3000:])
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = (p >= lo) & (p < lo + 0.25)
        assert abs(p[part].mean() - y[3000:][part].mean()) < 0.1


# ------------------------------------------------------------ decontamination

def test_contamination(spark, rows_of):
    rng = random.Random(2)
    items = [(i, " ".join(f"q{rng.randrange(40)}" for _ in range(rng.choice([3, 12, 13, 14, 40])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "!!"), (23, items[0][1]), (0, items[0][1]), (None, "nullid word")]
    rows = [(i, " ".join(f"q{rng.randrange(40)}" for _ in range(50))) for i in range(20)]
    rows += [(100 + i, f"Before, {t.upper()}!? after" if t else t) for i, (_, t) in enumerate(items)]
    rows += [(200, None), (201, ""), (202, "?!"), (203, "NULLID\tword"), (204, "xnullid word"), (205, "é q1 " * 3000),
             (206, "nullid word " * 400), (206, "nullid word " * 400), (None, items[3][1])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("hits", F.lit(0)).withColumn("item_ids", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    want = sorted(brute.benchmark(rows, items), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows_of(decontaminate.report(docs, bench)) == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in want)


def test_benchmark_in_slices(spark, rows_of, monkeypatch):
    """A benchmark over the broadcast bound is scanned slice by slice, with the same result."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = rows_of(decontaminate.report(docs, bench))
    places = rows_of(decontaminate.spans(docs, bench))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 3000)
    sizes = [sum(len(t) for _, t in items) for items in decontaminate.benchmark_slices(bench)]
    assert len(sizes) > 2 and max(sizes) < 6000
    assert rows_of(decontaminate.report(docs, bench)) == whole
    assert sum(r[5] for r in whole) > 0
    assert rows_of(decontaminate.spans(docs, bench)) == places and places


def test_spans_in_the_original(spark, rows_of):
    """Hit runs as code points of the original text, against a word-by-word map."""
    import re
    rng = random.Random(4)
    letters = ["é", "q", "Z", "中", "\U0001f600", "7"]
    gaps = [" ", "!? ", "\n\t", " - ", "_", "\x00"]
    word = lambda: "".join(rng.choice(letters) for _ in range(2))
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 2, 15])))) for i in range(8)]
    rows = []
    for i in range(40):
        parts = [word() if rng.random() < 0.6 else rng.choice(items)[1].upper() for _ in range(30)]
        rows.append((i, rng.choice(["", "¿", "("]) + "".join(p + rng.choice(gaps) for p in parts)))
    rows += [(100, None), (101, ""), (102, "é" * 5_000_000 + " " + items[0][1]), (3, rows[3][1]), (None, rows[4][1])]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for _, t in items:
        ws = pattern.findall(brute.lower(t))
        windows |= {tuple(ws[k:k + 13]) for k in range(max(len(ws) - 13, 0) + 1)}
    want = []
    for d, t in rows:
        found = list(pattern.finditer(brute.lower(t or "")))
        hit = [False] * len(found)
        for n in {len(w) for w in windows}:
            for k in range(len(found) - n + 1):
                if tuple(m[0] for m in found[k:k + n]) in windows:
                    hit[k:k + n] = [True] * n
        k = 0
        while k < len(found):
            if hit[k]:
                first = k
                while k + 1 < len(found) and hit[k + 1]:
                    k += 1
                a, b = found[first].start(), found[k].end()
                want.append((d, a, b, t[a:b]))
            k += 1
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("s", F.lit("x")).withColumn("row_key", F.lit(0))
    bench = spark.createDataFrame(items, "item_id string, text string")
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert rows_of(decontaminate.spans(docs, bench)) == sorted(want, key=order)


def test_long_items_in_the_sql(spark, rows_of):
    """An item of any length takes part in the oracle."""
    long_item = " ".join(f"w{i}" for i in range(11_000))
    rows, items = [(1, "x " + " ".join(f"w{i}" for i in range(10_500, 10_520))), (2, "none")], [("a", long_item)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = decontaminate.report(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(got) == sorted(con.execute(decontaminate.SQL).fetchall(), key=str)


def test_drops_keep_clashing_columns(spark):
    """Columns with the names the steps use inside stay as they are; repeated rows leave one."""
    from loomlex.llm import exact_dedup
    rows = [(1, "a b"), (1, "a b"), (2, "ab "), (3, "c"), (None, None), (None, None), (4, "bench mark item")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "row", "row_key", "_lx_key", "n", "kept", "spans"):
        docs = docs.withColumn(name, F.lit(name))
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(docs.columns[2:])}
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (1, "a b"), (3, "c"), (4, "bench mark item")]
    bench = spark.createDataFrame([("i", "bench mark item")], "item_id string, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 1, 2, 3]


def test_automaton_blocks(spark, rows_of):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    a = decontaminate.contamination(docs, bench).select("doc_id", "n_hit")
    b = decontaminate.contamination(docs, bench, max_windows=50).select("doc_id", "n_hit")
    assert rows_of(a) == rows_of(b)


def test_contamination_of_empty_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    clean = decontaminate.report(docs, bench.limit(0))
    assert clean.where("contaminated OR n_hit > 0").count() == 0 and clean.count() == 1000


# ------------------------------------------------------------ urls

URLS = ["http://www.example.com/en/1", "http://example.com/en/", "http://sub.EXAMPLE.com/en/2?x=/fr/", "http://example.com/EN/1",
        "https://a.net/es/3#top", "https://a.net/fr", "https://a.net/fr/", "https://net/es/", "https://xnet/es/1", "http://b.org",
        "http://b.org/x/y/z/1/2/3", "http://com/", "http://com", "ftp://q.com?x", "no scheme/en/", "", None, "://", "a://b://c/d",
        "http://wexample.com/en/1", "http://a.net/es", "http://\u00dc.net/es/\u00e9"]


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("x"))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(URLS)

    def plain(url):
        import re
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (brute.lower(m[1]), m[2]) if m else ("", "")
        fit = [r for _, r in url_filter.RULES
               if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fit, key=len) if fit else None
    verdict = {r: v for v, r in url_filter.RULES}
    for i, url in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == plain(url), url
        assert r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert got[16].verdict == "allow" and got[16].host == ""


def test_template_is_rejected_by_its_labels(spark):
    """Paths that differ from blocked ones only in what the rules do not cover join their branch."""
    rows = [(i, f"http://h.net/es/{i}") for i in range(40)] + [(100 + i, f"http://h.net/en/{i}") for i in range(40)]
    rows += [(200, "http://h.net/es"), (201, "http://h.net/")]
    rules = [("block", "net/es/"), ("allow", "net/en/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[0].verdict == "block" and got[100].verdict == "allow" and got[201].verdict == "allow"
    assert got[0].template != got[100].template


def test_labels_reach_urls_without_a_rule(spark):
    """A host that no rule names is judged by what its path shapes are elsewhere."""
    rows = [(i, f"http://h{i % 4}.net/es/{i}") for i in range(40)] + [(100 + i, f"http://h{i % 4}.net/en/{i}") for i in range(40)]
    rows += [(200 + i, f"http://plain.org/{'es' if i % 2 else 'en'}/{900 + i}") for i in range(20)] + [(300, "http://plain.org/zz")]
    rules = [("block", "net/es/"), ("allow", "net/en/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    free = [got[200 + i] for i in range(20)]
    assert all(r.rule is None for r in free)
    assert [r.verdict for r in free] == ["block" if i % 2 else "allow" for i in range(20)]
    assert got[300].verdict == "allow" and len({r.purity for r in free + [got[300]]}) >= 3


def test_unlabelled_branches_join_labelled_ones(spark):
    """On one host the slugs of a blocked directory's kind share its template."""
    rows = [(i, f"http://h.net/es/{i}") for i in range(30)] + [(50 + i, f"http://k.net/fr/{i}") for i in range(30)]
    rows += [(100 + i, f"http://h.net/fr/{i}") for i in range(10)]
    rules = [("block", "h.net/es/"), ("block", "k.net/fr/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[100].rule is None and got[100].verdict == "block" and got[100].template == got[0].template


def test_url_sql(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(url_filter.sql()).fetchall()
    got = url_filter.judge(df).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert url_filter.judge(df.limit(0)).count() == 0


# ------------------------------------------------------------ pages

def page(article, nav="Home", ad="Buy", foot="Foot", more=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            f"<nav><ul><li><a href='/'>{nav}</a></li></ul></nav><!-- x --><div class=\"ad\">{ad}</div>"
            f"<article>{article}</article>{more}<footer>{foot}</footer></body></html>")


def test_extraction(spark):
    comments = "<section class='comments'><article class='comment'><p>Nice!</p></article></section>"
    aside = "<aside>side</aside><form><p>Name</p><button>Go</button></form><div id='cookie-notice'>We use cookies</div>"
    pages = [("http://a.com/1", page("<h1>One &amp; two</h1><p>First\n  line<br>more</p><p><b>Open<p>Next &eacute; &#233;</p>"), "One & two\nFirst line more\nOpen\nNext é é"),
             ("http://a.com/2", page("<h1>Other</h1><p>Text</p>" + aside, more=comments), "Other\nText"),
             ("http://a.com/3", page("<p>Same</p>"), "Same"), ("http://a.com/4", page("<p>Same</p>"), "Same"),
             ("http://a.com/4", page("<p>Same</p>"), "Same"),
             ("http://b.com/", "", ""), (None, None, ""), (None, page("<p>no url</p>"), "no url"),
             ("http://c.com/", "<p>just <i>text</i></p><p>two</p", "just text\ntwo"),
             ("http://d.com/", page("<p>cut off")[:-len("</article><footer>Foot</footer></body></html>")] + "<p cla", "cut off"),
             ("http://e.com/", page("<p>" + "long " * 30000 + "</p>"), ("long " * 30000).strip()),
             ("http://f.com/", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep")]
    for i in range(6):  # a host whose sidebar has no telling name: constant nodes are template
        pages.append((f"http://g.com/{i}", f"<div class=x><p>Always the same words</p></div><div class=y><p>Varies {i} here</p></div>",
                      f"Varies {i} here"))
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string") \
        .withColumn("text", F.lit(1)).withColumn("host", F.lit(""))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    for i, (_, _, want) in enumerate(pages):
        assert got[i] == (want, len(want)), pages[i][0]
    assert html_text.extract(df.limit(0)).count() == 0


def test_extraction_of_given_pages(spark):
    """The articles of the given pages, cut out by a plain pattern."""
    import html
    import re
    df = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in df.collect()}
    for r in html_text.extract(df).collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)
        body = re.sub(r"<[^>]*$", "", m[1] if m else "")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_constancy_over_the_hosts_pages(spark):
    """A host whose pages all differ in layout keeps its articles; what most of its
    pages repeat in one aligned place is template, a part of one page is content."""
    parts = ["<p>a{i}</p><ul><li>b{i}</li></ul>", "<p>a{i}</p><h2>c{i}</h2><p>d{i}</p>", "<h2>c{i}</h2><p>a{i}</p>",
             "<p>a{i}</p><table><tr><td>e{i}</td></tr></table>", "<p>a{i}</p><ul><li>b{i}</li></ul><p>d{i}</p>",
             "<p>a{i}</p><ol><li>f{i}</li></ol>"]
    bodies = [p.format(i=i) for i, p in enumerate(parts)]
    rows = [(i, f"http://h.com/{i}", f"<div class=x><p>Always the same words</p></div><article>{b}</article>")
            for i, b in enumerate(bodies)]
    # without an article the constant slot itself shows, and a text twice on a page counts once
    rows += [(10 + i, f"http://k.com/{i}", f"<div class=x><p>The same</p></div><div class=y>{b}<h5>{'<b>z</b>'}</h5>"
              + (f"<h6>r{i}</h6>" * 9 if i < 3 else "") + "</div>") for i, b in enumerate(bodies)]
    got = {r.page_id: r.text.split("\n") for r in
           html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, b in enumerate(bodies):
        want = [w for w in b.replace("<", " <").replace(">", "> ").split() if "<" not in w and ">" not in w]
        assert got[i] == want
        assert got[10 + i] == want + [f"r{i}"] * (9 if i < 3 else 0)


def test_skeletons_of_a_hot_host_are_merged_in_a_tree(spark):
    """No part of a host holds all its skeletons; the merged masters place every slot."""
    import itertools
    import json
    layouts = list(itertools.product(["<p>{}</p>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<div>{}</div>"], repeat=4))
    rows, want = [], {}
    for i, parts in enumerate(layouts):
        want[i] = "\n".join(f"t{i}x{k}" for k in range(4))
        body = "".join(p.format(f"t{i}x{k}") for k, p in enumerate(parts))
        rows.append((i, f"http://h.com/{i}", f"<section>Always the same words</section><article>{body}</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages, group=16).collect()} == want

    trees = {}
    for _, _, page in rows:
        tree = html_text.skeleton(html_text.parse(page))[0]
        trees.setdefault(json.dumps(tree), len(trees))
    shapes = spark.createDataFrame([("h", k, t, 1) for t, k in trees.items()] + [("i", 1, next(iter(trees)), 1)],
                                   "host string, shape_key long, shape string, n long")
    held = [r["count"] for r in html_text.parts_of(shapes, 16).groupBy("host", "part").count().collect()]
    assert max(held) < 48 < len(trees)
    placed, masters = html_text.align_hosts(shapes, 16, 2)
    labels, masters = {}, {r.host: json.loads(r.tree) for r in masters.collect()}
    assert set(masters) == {"h", "i"}

    def labelled(node):
        return [node[0]] + [x for c in node[1] for x in labelled(c)]
    for r in placed.collect():
        labels.setdefault((r.host, r.shape_key), {})[r.slot] = (r.node, labelled(masters[r.host])[r.node])
    for t, k in trees.items():
        found = [labels["h", k][s] for s in range(len(labels["h", k]))]
        assert [x for _, x in found] == labelled(json.loads(t)) and len({n for n, _ in found}) == len(found)


def test_tree_matching():
    """Alignment keeps order and inserts what has no partner."""
    m = html_text.Master("r")
    slots = []
    html_text._align(m, ["r", [["a", []], ["b", []]]], [], slots)
    tree = ["r", [["a", []], ["x", []], ["b", []]]]
    score, pairs = html_text._match(m, tree)
    assert score == 3 and [(i, j) for i, j, _ in pairs] == [(0, 0), (1, 2)]


# ------------------------------------------------------------ personal data

TEXTS = [None, "", "mail a.b@c.d, x@y.zz.q. and a@b.c_d@e.f g@h", "1.2.3.4 256.1.1.1 9.1.2.3.4.5.6.7 1.2.3 001.02.3.255",
         "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111x 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+1 (017) 555-7713 +49.30.1234567 +1 2 +123456789012345678",
         "+1 (017) 555-7713. 4111111111111111@x.yy 10.0.0.1@a.b", "é\U0001f600 ü a@b.cc \u4e2d 1.2.3.4", "1 " * 20000, "a@" * 5000, "1." * 9000,
         "a.b." * 9000 + "@c.d", "x@" + "y." * 9000 + "z", "+" * 9000, "+1" + "-" * 9000, "9" * 30000, "token = \"24be64\""]


def test_base_spans(spark):
    rows = list(enumerate(TEXTS)) + [(2, TEXTS[2]), (None, TEXTS[4])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("kind", F.lit(1)).withColumn("uid", F.lit("u"))
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    text = dict(enumerate(TEXTS)) | {None: TEXTS[4]}
    for r in got:
        spans = brute.base_pii(text[r.doc_id])
        assert r.base_sha256 == brute.base_digest(text[r.doc_id]), (r.doc_id, spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in (1, 2, 3, 4))
        kinds = ["", *brute.PII]
        assert {f"{kinds[k]}:{s}:{e}" for s, k, e in spans} <= set(r.spans.split(","))
    assert pii.report(df.limit(0)).count() == 0


def test_contexts_discover_unseen(spark):
    """After 'write to me' stand addresses; one that the base pattern misses is found there, and nothing elsewhere."""
    rows = [(i, f"hello number {i} you can write to u{i}@mail{i % 5}.example.com for more") for i in range(40)]
    rows += [(100, "hello you can write to u77@intranet for more"), (101, "other words u78@intranet for more"),
             (102, "plain clean words without any"), (103, "you can write to 5 for more")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100].spans == "email:23:35" and got[100].n_email == 0
    assert got[101].spans == "" and got[102].spans == "" and got[103].spans == ""
    assert all(got[i].n_email == 1 for i in range(40))


def test_whole_identifiers_are_discovered(spark):
    """Contexts where two fifths of the values are unseen: phones with blanks, addresses
    without a dot and numbers in brackets are found with whole spans."""
    rows = [(i, f"please call me at +1 (2{i:02d}) 555-{1000 + i}, today") for i in range(60)]
    rows += [(100 + i, f"please call me at ({300 + i}) 555-{2000 + i}. today") for i in range(20)]
    rows += [(150 + i, f"please call me at 1 ({300 + i}) 555-{2000 + i} today") for i in range(20)]
    rows += [(200 + i, f"or write to u{i}@mail.example.com now") for i in range(60)]
    rows += [(300 + i, f"or write to (v{i}@localhost), now") for i in range(40)]
    rows += [(400 + i, f"it cost us {i} 000 or 1990. 12 in all") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == "phone:18:35" and got[103] == "phone:18:32" and got[155] == "phone:18:34"
    assert got[303] == "email:13:25" and got[335] == "email:13:26"
    assert all(got[d].count(":") == 2 for d, _ in rows if d < 400) and not any(got[400 + i] for i in range(60))


def test_discovered_values_support_further_patterns(spark):
    """A pattern without seeds is accepted by values that another pattern discovered."""
    rows = [(i, f"or write to u{i}@mail.example.com now") for i in range(30)]
    rows += [(100 + i, f"or write to v{i}@localhost now") for i in range(10)]
    rows += [(200 + i, f"his own box v{i}@localhost again") for i in range(10)] + [(300, "his own box w@remote again")]
    rows += [(400, "no such box w@remote again")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[204] == "email:12:24" and got[300] == "email:12:20" and got[400] == ""


def test_pattern_scores(spark):
    rng = random.Random(5)
    found = []
    for _ in range(1500):
        value = f"v{rng.randrange(400)}"
        kind = ["email", "phone", None, None, None][int(value[1:]) % 5]
        found.append((f"p{min(int(rng.expovariate(0.05)), 40 + int(value[1:]) % 5)}", "@" if int(value[1:]) % 3 else "few", value, kind))
    found += [(f"q{int(v[1:]) % 2}", f, v, s) for _, f, v, s in found if s == "email"]
    found += [(f"q{k % 2}", "@", f"w{k}", None) for k in range(40)] + [("r", "@", f"w{k}", None) for k in range(12)]
    df = spark.createDataFrame(found, "pattern string, form string, value string, seed string").repartition(5)
    got = {(r.pattern, r.form, r.kind): r.score for r in pii.score_patterns(df).collect()}
    want = brute.bootstrap(found)
    assert got.keys() == want.keys() and ("r", "@", "email") in want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rows_whose_64_bit_hash_collides_stay_apart(spark, monkeypatch):
    """Row keys are 128-bit digests: nothing depends on xxhash64 telling rows apart."""
    from loomlex.llm import exact_dedup
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(1, "a@b.cc is here"), (2, "and there 1.2.3.4"), (3, "none")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "email:0:6", 2: "ip:10:17", 3: ""}
    docs = spark.createDataFrame(rows, SCHEMA)
    assert exact_dedup.drop_exact_copies(docs).count() == 3
    bench = spark.createDataFrame([("i", "there")], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {1, 3}


def test_native_plans(spark, capsys):
    pii.report(spark.createDataFrame([(1, "a@b.cc")], SCHEMA)).explain()
    url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")).explain()
    assert "Python" not in capsys.readouterr().out
