"""Packing: an exact round trip, and the encoder against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomlex.llm import packing

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(4)
    alphabet = "abcXYZ''stré ÜßÿÑ×÷ªµ²½09 \t\n\r.,!?&$-_\u00a0\u00ad\u4e2d\u0130\u03a3\u0301\U0001f600<|>"
    texts = ["", " ", "It's we'll I'd've", "STRASSE straße", "<|endoftext|>x", "\x85a\x1cb", "e\u0301", "ΑΣ"] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    enc = packing.Encoder(packing.default_tokenizer())
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check(pieces, rows, tokenizer, length=packing.SEQUENCE):
    """Every id of every row lies in one piece; sequences are gapless and unpadded."""
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    for d, own in ids.items():
        found = [p for p in pieces if p.doc_id == d or (p.doc_id is None and d is None)]
        assert sum(p.length for p in found) == sum(map(len, own))
        for one in {a.tobytes(): a for a in own}.values():
            part = [p for p in found if p.doc_tokens == len(one)
                    and zlib.crc32(one[p.start:p.start + p.length].tobytes()) == p.ids_crc32]
            cover = np.zeros(len(one), dtype=int)
            for p in part:
                cover[p.start:p.start + p.length] += 1
            assert (cover == sum(a.tobytes() == one.tobytes() for a in own)).all()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length and at & (at - 1) == 0
    return sequences


def test_round_trip_on_given_table(spark, tokenizer):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    check(packing.pack(df).collect(), rows, tokenizer)


def test_edge_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "word " * 20000), (None, "null id"), (5, "same text"), (6, "same text")]
    rows += [(10 + i, f"copy of one {'text ' * 50}") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("x")).withColumn("mark", F.lit(0))
    check(packing.pack(df).collect(), rows, tokenizer)
    check(packing.pack(df, shard_tokens=500).collect(), rows, tokenizer)
    check(packing.pack(df, length=64).collect(), rows, tokenizer, 64)
    assert packing.pack(df.limit(0)).count() == 0


def test_neighbours_share_terms():
    """The seed's window takes the documents about its subject first."""
    docs = [np.array([100, 101, 102, 103] * 8), np.array([900] * 40), np.array([100, 101, 102, 104] * 8), np.array([901] * 40)]
    df = np.ones(1 << 16)
    idf = np.log1p((4 - df + 0.5) / (df + 0.5))
    pieces = list(packing.pack_shard(docs, idf, 36.0, length=64))
    first = [p[0] for p in pieces if p[3] == 0]
    assert first == [0, 2]


def test_shard_ranking_equals_brute_force():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 30, rng.integers(5, 40)) for _ in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    idf = np.log1p((50 - df + 0.5) / (df + 0.5))
    mean = float(np.mean([len(d) for d in docs]))
    shard = packing.Shard(docs, idf, mean)
    got = shard.neighbours(0, np.arange(50) > 0, 100, 49)
    score = np.zeros(50)
    for d in range(1, 50):
        for t in np.unique(docs[0]):
            tf = (docs[d] == t).sum()
            norm = packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)
            own = (docs[0] == t).sum()
            score[d] += idf[t] * tf * (packing.K1 + 1) / (tf + norm) * (own > 0)
    want = sorted((d for d in range(1, 50) if score[d] > 0), key=lambda d: (-score[d], d))
    assert np.allclose(score[got], score[want])


def test_seed_is_asked_until_the_window_is_full():
    """More than 48 short neighbours, half of them only by terms that are not among the
    seed's heaviest: all come before the documents of another subject."""
    common, rare = list(range(100, 116)), list(range(200, 230))
    docs = [np.array(common * 2 + rare)]
    docs += [np.array([900 + i, 901 + i]) for i in range(40)]
    docs += [np.array([common[i % 16], 3]) for i in range(70)] + [np.array([rare[i % 30], 3]) for i in range(70)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    pieces = list(packing.pack_shard(docs, idf, 2.2, length=256))
    first = {p[0] for p in pieces if p[3] == 0}
    assert len([p for p in pieces if p[3] == 0]) > 97 and not first & set(range(1, 41))


def test_another_tokenizer(spark):
    """A file with other splitting rules gives its own ids; ids beyond 16 bits are refused."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    rows = [(1, "Plain words, It's 1999 and  blanks\n"), (2, "é ü"), (3, None)]
    check(packing.pack(spark.createDataFrame(rows, SCHEMA), tokenizer=path).collect(), rows, own)


def test_large_vocabulary_is_refused(tmp_path):
    from tokenizers import models
    path = str(tmp_path / "large.json")
    Tokenizer(models.WordLevel({f"w{i}": i for i in range((1 << 16) + 1)}, unk_token="w0")).save(path)
    with pytest.raises(ValueError):
        packing.checked_tokenizer(path)


def test_shards_follow_the_tokens(spark, tokenizer):
    """Repeated rows are cut into several shards, whose number does not depend on the cores."""
    rows = [(1, "one row again " * 10)] * 400
    packed = packing.pack(spark.createDataFrame(rows, SCHEMA), shard_tokens=2000)
    pieces = packed.collect()
    check(pieces, rows, tokenizer)
    shards = {p.sequence_id >> 32 for p in pieces}
    total = sum(p.length for p in pieces)
    assert total // 2000 - 1 <= len(shards) <= total // 2000 + 1
    assert max(sum(p.length for p in pieces if p.sequence_id >> 32 == s) for s in shards) < 4 * 2000
