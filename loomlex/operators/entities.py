"""Entity mentions: E1-E3, A7-A10, W1, W4, W5, J8, F11, F12.

Tokens with character offsets come from one numpy pass over the bytes of an
Arrow batch (``mapInArrow``), without a loop over tokens.  Spark's own functions
return no match offsets; a running sum of piece lengths would give them, but
only after shuffling and sorting every token of the corpus by document, so the
scan is left where the text is read.  Everything after that - tagging,
filtering, counting, ids, points - is Spark joins and aggregates on the long
token table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlex.functions.constants import PUNCTUATION
from loomlex.operators import names as NM
from loomlex.operators.ids import first_seen_ids
from loomlex.operators.joins import MAX_BROADCAST_BYTES, join_bounded
from loomlex.session import cut_lineage, ship_package

# A token is a run of characters that are neither ASCII whitespace nor ASCII
# punctuation, or a single ASCII punctuation mark.
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
WORD_RE = r"[^ \t\n\r\f\x0b!-/:-@\[-`{-~]+"
TOKEN_RE = WORD_RE + "|" + PUNCT_CLASS

# FIXED VALUES: default rule tagger, (entity type, token pattern), first
# match wins; patterns are valid in Java regex and RE2.
ENTITY_RULES = [
    ("DATE", r"^(January|February|March|April|May|June|July|August|September|October|November|December)$"),
    ("DATE", r"^(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)$"),
    ("DATE", r"^(1[5-9]|20)[0-9]{2}$"),
    ("TIME", r"^([01]?[0-9]|2[0-3])(am|pm|AM|PM|h)$"),
    ("ORG", r"^[A-Z]{2,}$"),
    ("CARDINAL", r"^[0-9]+$"),
    ("PERSON", r"^[A-Z][a-z]+$"),
]

# FIXED VALUES: entity types enabled by default (flag 1).
DEFAULT_ENABLED_TYPES = ["person", "gpe", "org"]

TOKEN_SCHEMA = ("doc_id bigint, pos int, token string, char_start int, char_end int, "
                "is_punct boolean, span_end int, n_tokens int")


_KIND = np.full(256, 2, np.uint8)  # 0 blank, 1 punctuation, 2 word
_KIND[list(b" \t\n\r\x0c\x0b")] = 0
_KIND[list(PUNCTUATION.encode())] = 1

PART_BYTES = 1 << 20


def _token_part(doc: pa.Array, offs: np.ndarray, data: np.ndarray) -> tuple[dict, np.ndarray]:
    """(columns, tokens left in the text from each token on) for the tokens of whole
    texts laid end to end (byte offsets from 0)."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    word = kind == 2
    before, behind = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    if len(data) == 0:
        before = behind = word
    starts = np.flatnonzero((kind == 1) | (word & (~before | edge[:-1])))
    ends = np.flatnonzero((kind == 1) | (word & (~behind | edge[1:]))) + 1
    row = np.searchsorted(offs, starts, side="right") - 1
    # characters: bytes that do not continue a UTF-8 sequence
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[offs[row]]
    first = np.searchsorted(row, np.arange(len(offs)))
    n = len(starts)
    char_end = chars[ends] - base
    punct = kind[starts] == 1 if n else np.zeros(0, dtype=bool)
    # The span reaches over the punctuation that follows, up to the next word or the end
    stop = np.minimum.accumulate(np.where(punct, n, np.arange(n))[::-1])[::-1] if n else np.zeros(0, np.int64)
    after = np.concatenate([stop[1:], [n]]) if n else stop
    last = np.minimum(after, first[row + 1]) - 1
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    gather = np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))
    token = pa.StringArray.from_buffers(
        n, pa.py_buffer(np.concatenate([at, [sizes.sum()]]).astype(np.int32)), pa.py_buffer(data[gather]))
    return {"doc_id": doc.take(pa.array(row)), "pos": pa.array((np.arange(n) - first[row]).astype(np.int32)),
            "token": token, "char_start": pa.array((chars[starts] - base).astype(np.int32)),
            "char_end": pa.array(char_end.astype(np.int32)), "is_punct": pa.array(punct),
            "span_end": pa.array(char_end[last].astype(np.int32)),
            "n_tokens": pa.array((first[row + 1] - first[row]).astype(np.int32))}, first[row + 1] - np.arange(n)


def _parts(batches):
    """(first row, end row, batch, byte offsets from 0, bytes) of whole texts, PART_BYTES at
    most or a long text by itself."""
    for batch in batches:
        text = batch["text"].cast(pa.large_string())
        if not len(text):
            continue
        offs = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(text):
            hi = int(np.searchsorted(offs, offs[lo] + PART_BYTES, side="right")) - 1
            hi = min(max(hi, lo + 1), len(text))
            yield lo, hi, batch, offs[lo:hi + 1] - offs[lo], data[offs[lo]:offs[hi]]
            lo = hi


def _token_batches(batches):
    for lo, hi, batch, offs, data in _parts(batches):
        yield pa.RecordBatch.from_pydict(_token_part(batch["doc_id"][lo:hi], offs, data)[0])


def _doc_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def offset_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens with character offsets, punctuation flag, W4 span end and the
    document's token count (for W5)."""
    return _doc_texts(docs, id_col, text_col).mapInArrow(_token_batches, TOKEN_SCHEMA)


# Patterns that Java and RE2 read alike on ASCII tokens: no escapes, options, possessive
# repetitions or classes inside classes.
_ALIKE = re.compile(r"(?!.*(\(\?|[*+?}]\+|\[[^\]]*\[))[A-Za-z0-9^$|()\[\]{},?*+-]*")


def _enabled_pattern(types, rules: list[tuple[str, str]]) -> str | None:
    """One pattern that every mention of an enabled type matches; None if the tasks cannot tell."""
    if isinstance(types, DataFrame) or "" in types:
        return None
    patterns = [p for t, p in rules if t in types or t.lower() in types]
    return "|".join(f"({p})" for p in patterns) if patterns and all(_ALIKE.fullmatch(p) for p in patterns) else None


def _maybe_batches(pattern: str):
    """Tokens that may be a mention: each distinct token is looked at once per part, those that
    are not ASCII stay."""
    def run(batches):
        for lo, hi, batch, offs, data in _parts(batches):
            cols, _ = _token_part(batch["doc_id"][lo:hi], offs, data)
            token = cols["token"].dictionary_encode()
            maybe = pc.or_(pc.match_substring_regex(token.dictionary, pattern), pc.invert(pc.string_is_ascii(token.dictionary)))
            yield pa.RecordBatch.from_pydict(cols).filter(maybe.take(token.indices))
    return run


def candidate_tokens(docs: DataFrame, types, rules: list[tuple[str, str]] = ENTITY_RULES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``offset_tokens`` without those that no rule of an enabled type can match, which never
    leave the task that reads the text.  ``tag_entities`` decides on the rest; rules that
    cannot be told here, or a table of types, give all tokens."""
    pattern = _enabled_pattern(types, rules)
    if pattern is None:
        return offset_tokens(docs, id_col, text_col)
    return _doc_texts(docs, id_col, text_col).mapInArrow(_maybe_batches(pattern), TOKEN_SCHEMA)


# ------------------------------------------------------------ names (gazetteer)

NAME_SCHEMA = "name_type string, name_n int, name string, name_end int, in_name boolean"


def _name_lists(batches):
    """(number, text, ent_type) -> the lowercased tokens of each name."""
    for lo, hi, batch, offs, data in _parts(batches):
        cols, _ = _token_part(pa.array(np.arange(lo, hi)), offs, data)
        first = np.searchsorted(cols["doc_id"].to_numpy(), np.arange(lo, hi + 1))
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pc.utf8_lower(cols["token"]))
        yield pa.RecordBatch.from_pydict({"tokens": lists, "ent_type": batch["ent_type"][lo:hi]})


def name_table(gazetteer: DataFrame) -> DataFrame:
    """``(tokens, ent_type)``, one row per name: the term's tokens, lowercased.  A term
    listed with several types has the first in alphabetical order; terms without
    a token and rows with a null are left out."""
    ship_package(gazetteer.sparkSession)
    rows = gazetteer.where("term IS NOT NULL AND ent_type IS NOT NULL").select(F.col("term").alias("text"), "ent_type")
    return rows.mapInArrow(_name_lists, NM.NAMES_SCHEMA).where(F.size("tokens") > 0) \
        .groupBy("tokens").agg(F.min("ent_type").alias("ent_type"))


def _named_batches(trie):
    def run(batches):
        names = trie.value
        kinds = pa.array(names.type_names, pa.string())
        for lo, hi, batch, offs, data in _parts(batches):
            cols, room = _token_part(batch["doc_id"][lo:hi], offs, data)
            at, size, kind = names.longest(pc.utf8_lower(cols["token"]), room)
            keep = NM.leftmost(at, size)
            yield pa.RecordBatch.from_pydict(cols | _name_columns(cols, at[keep], size[keep], kinds.take(pa.array(kind[keep]))))
    return run


def _name_columns(cols: dict, at: np.ndarray, size: np.ndarray, kind: pa.Array) -> dict:
    """NAME_SCHEMA for tokens at which the names (start, tokens, type) begin."""
    n = len(cols["token"])
    slot = np.full(n, -1, dtype=np.int64)
    slot[at] = np.arange(len(at))
    where = pa.array(slot, mask=slot < 0)
    inside = np.zeros(n + 1, dtype=np.int64)
    np.add.at(inside, at + 1, 1)
    np.add.at(inside, at + size, -1)
    return {"name_type": kind.take(where), "name_n": pa.array(size.astype(np.int32)).take(where),
            "name": _joined(cols["token"], at, size).take(where),
            "name_end": cols["span_end"].take(pa.array(at + size - 1)).take(where),
            "in_name": pa.array(np.cumsum(inside[:-1]) > 0)}


def _joined(token: pa.Array, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The tokens of each run, joined by one blank."""
    return pc.binary_join(_runs(token, at, size), " ")


def _runs(token: pa.Array, at: np.ndarray, size: np.ndarray) -> pa.ListArray:
    ends = np.cumsum(size)
    gather = np.repeat(at - (ends - size), size) + np.arange(int(size.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), token.take(pa.array(gather)))


def _candidate_batches(found):
    def run(batches):
        for lo, hi, batch, offs, data in _parts(batches):
            cols, room = _token_part(batch["doc_id"][lo:hi], offs, data)
            lowered = pc.utf8_lower(cols["token"])
            at, size = found.value.candidates(lowered, room)
            yield pa.RecordBatch.from_pydict({
                "doc_id": cols["doc_id"].take(pa.array(at)), "pos": cols["pos"].take(pa.array(at)),
                "tokens": _runs(lowered, at, size), "name": _joined(cols["token"], at, size),
                "name_n": pa.array(size.astype(np.int32)), "name_end": cols["span_end"].take(pa.array(at + size - 1))})
    return run


def _leftmost_batches(batches):
    """Matches by document, position and falling length -> those that stay."""
    doc, free = None, 0
    for batch in batches:
        keep = []
        for d, p, n in zip(*[batch[c].to_pylist() for c in ("doc_id", "pos", "name_n")]):
            if d != doc:
                doc, free = d, 0
            keep.append(p >= free)
            if p >= free:
                free = p + n
        yield batch.filter(pa.array(keep, pa.bool_()))


def named_tokens(docs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``offset_tokens`` with the gazetteer names marked: at a name's first token its
    type, number of tokens, text (tokens joined by one blank) and span end; ``in_name``
    for its other tokens.

    A gazetteer of more than ``max_bytes`` is not sent to the tasks: they send the
    runs of tokens that may be names to the table of names instead, and documents
    are told apart by their id."""
    spark = docs.sparkSession
    names = cut_lineage(name_table(gazetteer))
    found = NM.compile_names(names, max_bytes)
    texts = _doc_texts(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(found)
    if isinstance(found, NM.TokenTrie):
        return texts.mapInArrow(_named_batches(shared), TOKEN_SCHEMA + ", " + NAME_SCHEMA)
    maybe = texts.mapInArrow(_candidate_batches(shared), "doc_id bigint, pos int, tokens array<string>, name string, "
                             "name_n int, name_end int")
    hits = maybe.join(names.withColumnRenamed("ent_type", "name_type"), "tokens").drop("tokens")
    hits = hits.repartition("doc_id").sortWithinPartitions("doc_id", "pos", F.desc("name_n"))
    hits = cut_lineage(hits.mapInArrow(_leftmost_batches, hits.schema))
    inside = hits.where("name_n > 1").select(
        "doc_id", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("name_n") - 1)).alias("pos"))
    marks = hits.select("doc_id", "pos", "name_type", "name_n", "name", "name_end", F.lit(False).alias("in_name")) \
        .unionByName(inside.withColumn("in_name", F.lit(True)), allowMissingColumns=True)
    out = join_bounded(offset_tokens(docs, id_col, text_col), marks, ["doc_id", "pos"], "left")
    return out.withColumn("in_name", F.coalesce("in_name", F.lit(False)))


def tag_entities(tokens: DataFrame, rules: list[tuple[str, str]] = ENTITY_RULES) -> DataFrame:
    """Add ``ent_type`` ('' when untagged).

    Names marked by ``named_tokens`` take precedence over the rules: the row of a
    name's first token stands for the whole name (``token`` becomes the name, the
    span reaches over it), its other tokens are untagged."""
    rule = F.lit("")
    for ent_type, pattern in reversed(rules):
        rule = F.when(F.col("token").rlike(pattern), F.lit(ent_type)).otherwise(rule)
    if "name_type" not in tokens.columns:
        return tokens.withColumn("ent_type", rule)
    tagged = tokens.withColumn("ent_type", F.when(F.col("in_name"), F.lit("")).otherwise(F.coalesce("name_type", rule)))
    return tagged.withColumn("token", F.coalesce("name", "token")) \
        .withColumn("span_end", F.coalesce("name_end", "span_end")) \
        .drop("name_type", "name_n", "name", "name_end", "in_name")


# ------------------------------------------------------------ tagger hook

def _spans_of(tagger, texts: list[str]) -> list:
    """Per text its spans, or the error that tagging it gave."""
    def checked(got, text):
        spans = [(int(s), int(e), str(t)) for s, e, t in got]
        for s, e, _ in spans:
            if not 0 <= s < e <= len(text):
                raise ValueError(f"span {s}:{e} of a text of {len(text)} characters")
        return sorted(spans, key=lambda x: (x[0], -x[1], x[2]))

    def alone(text):
        try:
            (got,) = tagger([text])
            return checked(got, text)
        except Exception as error:  # noqa: BLE001 - a failing text is skipped
            return error

    try:
        every = list(tagger(texts))
        if len(every) != len(texts):
            raise ValueError(f"{len(every)} results for {len(texts)} texts")
        return [checked(got, text) for got, text in zip(every, texts)]
    except Exception:  # noqa: BLE001 - find the failing texts one by one
        return [alone(text) for text in texts]


def _tagged_batches(tagger, align: str):
    def run(batches):
        for lo, hi, batch, offs, data in _parts(batches):
            found = _spans_of(tagger, batch["text"][lo:hi].to_pylist())
            cols, _ = _token_part(batch["doc_id"][lo:hi], offs, data)
            n = len(cols["token"])
            begin, end = cols["char_start"].to_numpy(), cols["char_end"].to_numpy()
            firsts = np.flatnonzero(cols["pos"].to_numpy() == 0)
            sizes = np.diff(np.concatenate([firsts, [n]]))
            has = _with_tokens(offs, data)
            kind, drop = np.full(n, "", dtype=object), np.zeros(n, dtype=bool)
            for spans, at, size in zip([found[i] for i in has], firsts, sizes):
                if isinstance(spans, Exception):
                    drop[at:at + size] = True
                    continue
                for s, e, t in reversed(spans):  # the first span of a token decides
                    if align == "inside":
                        a = np.searchsorted(begin[at:at + size], s)
                        b = np.searchsorted(end[at:at + size], e, side="right")
                    else:
                        a = np.searchsorted(end[at:at + size], s, side="right")
                        b = np.searchsorted(begin[at:at + size], e)
                    kind[at + a:at + max(a, b)] = t
            out = pa.RecordBatch.from_pydict(cols | {"ent_type": pa.array(kind, pa.string())})
            yield out.filter(pa.array(~drop))
    return run


def _with_tokens(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Numbers of the texts that have a token."""
    some = np.concatenate([[0], np.cumsum(_KIND[data] != 0)])
    return np.flatnonzero(some[offs[1:]] > some[offs[:-1]])


def tagger_tokens(docs: DataFrame, tagger, id_col: str = "doc_id", text_col: str = "text",
                  align: str = "inside") -> DataFrame:
    """E1 with a tagger of the caller's: ``offset_tokens`` with ``ent_type``.

    ``tagger(texts)`` gets a list of whole texts and returns, per text, a list of
    (start, end, type) in characters.  It runs inside the tasks, on Arrow batches of
    at most PART_BYTES (or one long text), and has to be picklable.  A token has the
    type of the first span (smallest start, then longest, then smallest type) that
    holds it whole (``align="inside"``) or in part (``"overlap"``).  If a call fails, its
    texts are tagged one by one; a text that fails alone, or has a span outside it, is
    skipped: it has no tokens here and a row in ``tagger_failures``."""
    if align not in ("inside", "overlap"):
        raise ValueError(f"align is 'inside' or 'overlap', not {align!r}")
    return _doc_texts(docs, id_col, text_col).mapInArrow(_tagged_batches(tagger, align), TOKEN_SCHEMA + ", ent_type string")


def _failure_batches(tagger):
    def run(batches):
        for lo, hi, batch, _, _ in _parts(batches):
            found = _spans_of(tagger, batch["text"][lo:hi].to_pylist())
            bad = [i for i, x in enumerate(found) if isinstance(x, Exception)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"][lo:hi].take(pa.array(bad, pa.int64())),
                "error": pa.array([f"{type(found[i]).__name__}: {found[i]}" for i in bad], pa.string())})
    return run


def tagger_failures(docs: DataFrame, tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, error)`` of the documents that ``tagger`` fails on."""
    return _doc_texts(docs, id_col, text_col).mapInArrow(_failure_batches(tagger), "doc_id bigint, error string")


def places(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A gazetteer of geo-political names from tables of nations and regions."""
    return nation.select(F.col("n_name").alias("term")).union(region.select("r_name")) \
        .select("term", F.lit("GPE").alias("ent_type"))


def enabled(types: DataFrame) -> DataFrame:
    """entity types whose flag is 1."""
    return types.where(F.col("flag").cast("int") == 1).select("ent_type")


def keep_mentions(tagged: DataFrame, types: list[str] | DataFrame = DEFAULT_ENABLED_TYPES,
                  type_col: str = "ent_type") -> DataFrame:
    """keep rows whose type is enabled as-is or lowercased; every such row
    stays, repeated ones too.  A type table is joined twice, on either spelling."""
    t = F.col(type_col)
    if isinstance(types, DataFrame):
        allowed = types.select(F.col("ent_type").alias("_k")).distinct()
        raw = join_bounded(tagged.withColumn("_k", t), allowed.withColumn("_raw", F.lit(True)), "_k", "left")
        both = join_bounded(raw.withColumn("_k", F.lower(t)), allowed.withColumn("_low", F.lit(True)), "_k", "left")
        return both.where(F.coalesce("_raw", "_low", F.lit(False))).drop("_k", "_raw", "_low")
    allowed = list(types)
    return tagged.where(t.isin(allowed) | F.lower(t).isin(allowed))


def drop_last(tokens: DataFrame) -> DataFrame:
    """The last token of each document is never tagged."""
    return tokens.where(F.col("pos") < F.col("n_tokens") - 1)


def mentions(docs: DataFrame, types: list[str] | DataFrame = DEFAULT_ENABLED_TYPES,
             rules: list[tuple[str, str]] = ENTITY_RULES, gazetteer: DataFrame | None = None,
             id_col: str = "doc_id", text_col: str = "text", tagger=None) -> DataFrame:
    """Documents -> tagged tokens -> enabled mentions (last token
    dropped).  Documents given as bytes (``content`` without a text column) that
    are not valid UTF-8 are skipped (N8), as are documents that ``tagger`` fails on.
    A ``tagger`` stands in for the rules and the gazetteer.
    Columns: doc_id, pos, token, ent_type, char_start, span_end."""
    if text_col not in docs.columns and "content" in docs.columns:
        docs = docs.where(F.is_valid_utf8(F.col("content").cast("string"))) \
            .withColumn(text_col, F.col("content").cast("string"))
    if tagger is not None:
        tagged = tagger_tokens(docs, tagger, id_col, text_col)
    elif gazetteer is not None:
        tagged = tag_entities(named_tokens(docs, gazetteer, id_col, text_col), rules)
    else:
        tagged = tag_entities(candidate_tokens(docs, types, rules, id_col, text_col), rules)
    m = keep_mentions(drop_last(tagged), types)
    return m.select("doc_id", "pos", "token", "ent_type", "char_start", "span_end")


# ------------------------------------------------------------ E3 report

def collect_spans(m: DataFrame) -> DataFrame:
    """Per document the spans ``(start, end, type)`` in text order."""
    return m.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("char_start").alias("start"), F.col("span_end").alias("end"),
        F.col("ent_type").alias("type")))).alias("spans"))


def entity_type_counts(m: DataFrame, docs: DataFrame,
                       types: list[str] = DEFAULT_ENABLED_TYPES) -> DataFrame:
    """Per document and enabled type the mention count, zero-filled.

    A pivot over the fixed type list plus a left join from all documents
    gives the zero rows without a documents x types cross join."""
    names = list(types)
    keyed = m.select("doc_id", F.lower("ent_type").alias("t"))
    wide = keyed.groupBy("doc_id").pivot("t", sorted({t.lower() for t in names})).count()
    full = docs.select("doc_id").distinct().join(wide, "doc_id", "left")
    pairs = F.array(*[F.struct(F.lit(t).alias("ent_type"), F.coalesce(F.col(f"`{t.lower()}`"), F.lit(0)).alias("n"))
                      for t in names])
    return full.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.ent_type", "x.n")


def entity_histogram(m: DataFrame, surface_col: str = "token") -> DataFrame:
    """``(ent_type, surface, n)`` for every type (lowercased)."""
    return m.groupBy(F.lower("ent_type").alias("ent_type"), F.col(surface_col).alias("surface")) \
        .agg(F.count(F.lit(1)).alias("n"))


def encode_points(m: DataFrame, image_col: str, doc_col: str, entity_col: str,
                  order_cols: list[str]) -> DataFrame:
    """W1 + J8 + A10: image, document and entity ids by first appearance
    (in ``order_cols`` order), joined back, distinct ``(x, y, z)`` points."""
    base = cut_lineage(m.select(F.col(image_col).alias("_img"), F.col(doc_col).alias("_doc"),
                                F.col(entity_col).alias("_ent"), *order_cols))
    img = first_seen_ids(base, "_img", order_cols, "x")
    doc = first_seen_ids(base, "_doc", order_cols, "y")
    ent = first_seen_ids(base, "_ent", order_cols, "z")
    pts = base.select("_img", "_doc", "_ent").distinct()
    pts = join_bounded(pts, img.select("_img", "x"), "_img")
    pts = pts.join(doc.select("_doc", "y"), "_doc").join(ent.select("_ent", "z"), "_ent")
    return pts.select("x", "y", "z").distinct()


def span_label(c: Column) -> Column:
    """K5 helper: ``start:end:type`` text for one span struct."""
    return F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), c["type"])
