"""Training sequences packed by lexical retrieval over sharded BM25 indexes.

1. Every text is tokenised once; its ids are written to a stage table.
2. Document frequencies of all token ids are counted over all documents (at most
   one row per id of the vocabulary, so the table that is sent out is bounded).
3. Documents are ranged into shards of about ``shard_tokens`` by a one-value
   MinHash of their token pairs, so that similar documents meet, then by key and
   row number, so that a large group of copies or of repeated rows is cut into
   several shards.  The number of shards follows from the tokens alone.
4. Each shard builds a BM25 inverted index.  The next unused document seeds a
   window; the index returns its best unused neighbours, which fill the window
   greedily: whole documents first, then the best one is cut to the exact room,
   and its rest seeds the next window.  The index is asked for further neighbours
   of the same seed, first by its heaviest terms and then by all of them, until
   the window is full or nothing unused shares a term with it.
5. What is left of a shard's last window is split into sequences whose lengths
   are powers of two, which need no padding.

Defined cases: null or empty text is the closing id alone; rows that repeat are
packed each; an empty table gives no rows; other columns are ignored; a tokenizer
whose ids do not fit 16 bits raises ValueError before any text is read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.llm.arrays import giving_back, joined_bytes, mix, text_chunks
from loomlex.llm.common import order_key, spread, stage

SEQUENCE, CLOSING_ID = 2048, 1
K1, B = 1.2, 0.75
CACHE_WORDS = 400_000

# Letters and numbers of Latin-1 after lower-casing: for texts made of these and
# plain blanks alone, the tokenizer's normaliser and splitter are this pattern.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
# The settings of a tokenizer file that ``_PIECES`` stands for.
_NORMALISER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Encoder:
    """Token ids as little-endian 16-bit bytes; equal to the tokenizer's own.

    Pieces (words, digits, sign runs) are encoded one by one by the tokenizer's
    model and remembered, up to a bounded number; any text outside Latin-1 goes
    through the whole tokenizer, as does every text if the tokenizer's normaliser
    and splitter are others than ``_PIECES`` stands for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        parts = json.loads(self.tokenizer.to_str())
        self.by_pieces = (parts["normalizer"], parts["pre_tokenizer"]) == (_NORMALISER, _SPLITTER)
        self.model = self.tokenizer.model
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.known: dict[str, bytes] = {}

    def piece(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(x for x, _ in self.bytes_of(word))
        ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u2").tobytes()
        if len(self.known) < CACHE_WORDS:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_pieces or _PLAIN.fullmatch(text) is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        known, piece = self.known.get, self.piece
        return b"".join([known(w) or piece(w) for w in _PIECES.findall(text.lower())])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def checked_tokenizer(path: str) -> str:
    """``path`` if all its ids fit the 16 bits that ``ids`` gives each."""
    from tokenizers import Tokenizer
    largest = max(Tokenizer.from_file(path).get_vocab().values(), default=0)
    if largest >= 1 << 16:
        raise ValueError(f"{path}: largest id {largest}, at most 65535 fit")
    return path


def _tokenise(path: str):
    closing = np.array([CLOSING_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi, offs, data in text_chunks(batch["text"]):
                raw = data.tobytes()
                ids, sizes, marks = [], [], []
                for i in range(hi - lo):
                    one = enc.encode(raw[offs[i]:offs[i + 1]].decode()) + closing
                    ids.append(one)
                    sizes.append(len(one) // 2)
                    t = np.frombuffer(one, "<u2").astype(np.uint64)
                    pairs = mix((t[:-1] << np.uint64(16) | t[1:]) + np.uint64(1)) if len(t) > 1 else t
                    marks.append(int(pairs.min() >> np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch["row"][lo:hi], batch["row_key"][lo:hi], batch["doc_id"][lo:hi], pa.array(ids, pa.binary()),
                     pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())],
                    names=["row", "row_key", "doc_id", "ids", "n_ids", "mark"])
    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch["ids"][lo:lo + 256]
            flat = np.frombuffer(joined_bytes(part), "<u2").astype(np.int64)
            sizes = batch["n_ids"][lo:lo + 256].to_numpy()
            seen = np.unique(np.repeat(np.arange(len(sizes)) << 16, sizes) | flat)
            total += np.bincount(seen & 0xFFFF, minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])


class Shard:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), sizes)
        pair, tf = np.unique(owner << 16 | flat, return_counts=True)
        doc, term = pair >> 16, pair & 0xFFFF
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean_length))
        # per document: its heaviest terms are its query
        self.first = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.terms, self.weights = term, weight
        order = np.argsort(term, kind="stable")
        self.posting_doc, self.posting_weight = doc[order], weight[order]
        self.posting_first = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.n = len(docs)

    def scores(self, seed: int, query_terms: int | None = None) -> np.ndarray:
        """Every document's score against the seed's heaviest terms (None: all terms)."""
        lo, hi = self.first[seed], self.first[seed + 1]
        terms = self.terms[lo:hi]
        if query_terms is not None and hi - lo > query_terms:
            terms = terms[np.argpartition(-self.weights[lo:hi], query_terms)[:query_terms]]
        score = np.zeros(self.n)
        for t in terms:
            a, b = self.posting_first[t], self.posting_first[t + 1]
            score[self.posting_doc[a:b]] += self.posting_weight[a:b]
        return score

    def neighbours(self, seed: int, unused: np.ndarray, query_terms: int, top: int) -> np.ndarray:
        """The best ``top`` unused documents by falling score against the seed's heaviest terms."""
        return next(self.ranked(self.scores(seed, query_terms), unused, top), np.zeros(0, np.int64))

    @staticmethod
    def ranked(score: np.ndarray, unused: np.ndarray, top: int) -> Iterator[np.ndarray]:
        """Unused documents that score, by falling score, at most ``top`` at a time."""
        found = np.flatnonzero(unused & (score > 0))
        if len(found) > top:
            best = np.argpartition(-score[found], top)
            head, found = found[best[:top]], found[best[top:]]
            yield head[np.lexsort((head, -score[head]))]
        order = found[np.lexsort((found, -score[found]))]
        for lo in range(0, len(order), top):
            yield order[lo:lo + top]

    def rounds(self, seed: int, unused: np.ndarray, query_terms: int, top: int) -> Iterator[np.ndarray]:
        """All unused documents that share a term with the seed, in answers of at most
        ``top``: those that its heaviest terms find, then those that only the rest finds."""
        yield from self.ranked(self.scores(seed, query_terms), unused, top)
        if self.first[seed + 1] - self.first[seed] > query_terms:
            yield from self.ranked(self.scores(seed), unused, top)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, length: int = SEQUENCE,
               query_terms: int = 16, top: int = 48):
    """Yield (document, start, length, sequence, offset) pieces covering every id once.

    ``query_terms`` and ``top`` set how much the index answers at a time; a seed is
    asked for again until its window is full or it has no unused neighbour left."""
    index = Shard(docs, idf, mean_length)
    size = [len(d) for d in docs]
    unused = np.ones(len(docs), dtype=bool)
    next_doc, sequence, at = 0, 0, 0
    pieces = []
    rest = None  # (document, start) of a cut document

    def put(doc, start):
        """Place what fits of a document; what remains, if any, becomes ``rest``."""
        nonlocal at, rest
        n = min(size[doc] - start, length - at)
        pieces.append((doc, start, n, sequence, at))
        at += n
        rest = (doc, start + n) if start + n < size[doc] else None

    while True:
        if rest is not None:
            seed = rest[0]
            put(*rest)
        else:
            while next_doc < len(docs) and not unused[next_doc]:
                next_doc += 1
            if next_doc == len(docs):
                break
            seed = next_doc
            unused[seed] = False
            put(seed, 0)
        if at < length:
            for near in index.rounds(seed, unused, query_terms, top):
                left = []
                for d in near:
                    if size[d] <= length - at:
                        unused[d] = False
                        put(int(d), 0)
                    else:
                        left.append(int(d))
                    if at == length:
                        break
                if at < length and left:  # longer than the room: fills it
                    unused[left[0]] = False
                    put(left[0], 0)
                if at == length:
                    break
        if at == length:
            sequence, at = sequence + 1, 0
    # the last, unfinished window: cut into power-of-two sequences
    tail = [p for p in pieces if p[3] == sequence] if at else []
    yield from (p for p in pieces if p[3] != sequence or not at)
    room, used = 1 << (at.bit_length() - 1) if at else 0, 0
    for doc, start, n, _, _ in tail:
        while n:
            take = min(n, room - used)
            yield doc, start, take, sequence, used
            start, n, used, at = start + take, n - take, used + take, at - take
            if used == room and at:
                sequence, room, used = sequence + 1, 1 << (at.bit_length() - 1), 0


def _pack(handle, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs = [], []
        for batch in batches:  # one shard: bounded by the number of shards
            keys.append(batch["doc_id"])
            docs += [np.frombuffer(x.as_buffer().to_pybytes(), "<u2") for x in batch["ids"]]
        if not docs:
            return
        idf, mean_length = handle.value
        ids = pa.concat_arrays(keys)
        rows = np.array(list(pack_shard(docs, idf, mean_length, length)), dtype=np.int64).reshape(-1, 5)
        base = TaskContext.get().partitionId() << 32
        for lo in range(0, len(rows), 4096):
            doc, start, n, sequence, offset = rows[lo:lo + 4096].T
            crc = [zlib.crc32(docs[d][s:s + k].astype("<u4").tobytes()) for d, s, k in zip(doc, start, n, strict=True)]
            total = np.array([len(docs[d]) for d in doc], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(doc)), *(pa.array(np.ascontiguousarray(x)) for x in (start, n)),
                 pa.array(crc, pa.int64()), pa.array(total), pa.array(sequence + base),
                 pa.array(np.ascontiguousarray(offset))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE,
         shard_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = checked_tokenizer(tokenizer or default_tokenizer())
    source = spread(docs.select(F.monotonically_increasing_id().alias("row"), order_key().alias("row_key"), "doc_id",
                                F.coalesce("text", F.lit("")).alias("text")))
    rows = stage(source.mapInArrow(giving_back(_tokenise(path)), f"row long, row_key long, doc_id {kind}, ids binary, "
                                   "n_ids long, mark long"), "pack-ids")
    counts = rows.select("ids", "n_ids").mapInArrow(_frequencies, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    n_docs, n_ids = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    df = np.zeros(1 << 16)
    for r in counts.collect():  # at most one row per id of the vocabulary
        df[r.id] = r.n
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    handle = spark.sparkContext.broadcast((idf, max(n_ids / max(n_docs, 1), 1.0)))
    shards = int(n_ids // shard_tokens) + 1
    return (rows.repartitionByRange(shards, "mark", "row_key", "row")
            .sortWithinPartitions("mark", "row_key", "row").select("doc_id", "ids")
            .mapInArrow(giving_back(_pack(handle, length)),
                        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                        "sequence_id long, offset long"))
