"""Plain-Python model of N1 -> N2 -> N3 -> N6 -> F1 -> F2 -> F3 -> W2 -> A2 -> M1
on the sf0.001 documents, compared with the Spark pipeline entry by entry."""

import math
import re
from collections import Counter

import pyarrow.parquet as pq

from loomlex.functions.constants import PUNCTUATION
from loomlex.operators import tokens as TK
from loomlex.operators import weights as WT
from loomlex.session import read_table

SF = "/root/testdata/sf0.001"
PUNCT_RUN = re.compile("[" + re.escape(PUNCTUATION) + "]+")
WS = re.compile(r"[ \t\n\x0b\x0c\r\x1c-\x1f]+")


def python_model(rows, stop):
    texts = []
    for doc_id, text in rows:
        t = text.encode("ascii", "ignore").decode("ascii")
        t = PUNCT_RUN.sub(" ", t)
        t = re.sub("[0-9]+", "", t)
        toks = [w for w in WS.split(t.lower()) if w and w not in stop]
        texts.append((doc_id, toks))
    freq = Counter(w for _, toks in texts for w in toks)
    texts = [(d, [w for w in toks if freq[w] > 1 and len(w) > 2]) for d, toks in texts]
    ids = {}
    for _, toks in sorted(texts):
        for w in sorted(set(toks) - set(ids)):
            ids[w] = len(ids)
    bow = {d: Counter(ids[w] for w in toks) for d, toks in texts}
    n = len(texts)
    df = Counter(t for c in bow.values() for t in c)
    tfidf = {}
    for d, c in bow.items():
        w = {t: tf * math.log2(n / df[t]) for t, tf in c.items()}
        w = {t: x for t, x in w.items() if abs(x) > 1e-12}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            tfidf[(d, t)] = x / norm
    return ids, bow, tfidf


def test_pipeline_matches_python_model(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    stop = set(TK.default_stop_words())
    ids, bow, tfidf = python_model([(r["doc_id"], r["text"]) for r in rows], stop)
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    c = TK.build_corpus(docs)
    got_ids = {r.term: r.token_id for r in c.dictionary.collect()}
    assert got_ids == ids
    got_bow = {(r.doc_id, r.token_id): r.tf for r in c.bow.collect()}
    want_bow = {(d, t): tf for d, cnt in bow.items() for t, tf in cnt.items()}
    assert got_bow == want_bow
    got_w = {(r.doc_id, r.token_id): r.weight for r in WT.tfidf(c.bow, c.n_docs).collect()}
    assert got_w.keys() == tfidf.keys()
    assert max(abs(got_w[k] - tfidf[k]) for k in tfidf) < 1e-12
