"""Main text of web pages by wrapper induction.

1. Every page is parsed once into a tree of block elements.  Equal neighbouring
   siblings collapse into one repeated node, which gives the page's skeleton;
   each text block knows its node (slot).  The blocks go to a stage table.
2. Per host the distinct skeletons are aligned by simple tree matching into one
   master tree; every slot of a skeleton gets its master slot.  Parts of about
   ``GROUP`` skeletons give partial masters, which are aligned ``FAN`` at a time
   by the same matching, staged level by level, so no task holds all skeletons
   of a host; what it holds grows with the size of the masters only.
3. Statistics cover all pages: per host and master slot, on how many of the
   distinct pages that hold the slot each text occurs, and how much of it is link
   text.  Slots whose text is constant over the host's pages are template,
   and so are menus, headers, footers, sidebars, notices, adverts, forms and
   comments by their tag, class or role, and slots made of links; what varies
   inside the article (or, without one, elsewhere) is content.
4. Pages are joined with their host's wrapper and the content blocks are joined
   in page order.

Scripts, styles and comments never become blocks.  An unfinished tag at the end
of a cut-off page is markup and goes.  ``<br>`` is white space inside a block.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own; a slot that fewer than ``MIN_PAGES`` distinct pages hold is not
constant; copies of a page count once; rows that repeat are extracted each; an
empty table gives no rows; other columns are ignored; elements nested deeper
than ``MAX_DEPTH`` are read as children of their ancestor at that depth.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlex.llm.common import partitions, spread, stage
from loomlex.operators.joins import join_bounded

MIN_PAGES, CONSTANT, LINKS, MAX_DEPTH = 4, 0.9, 0.6, 64
GROUP, FAN = 256, 8  # skeletons of a first master; masters of a level merged into one

# Elements by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr "
                   "picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEMPLATE_TAGS = frozenset("head nav header footer aside form button select option dialog menu fieldset legend "
                          "figure object audio video canvas".split())
RAW = "script|style|noscript|template|iframe|textarea|svg|math"
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|pager|pagination|header|"
    r"masthead|footer|foot|copyright|sidebar|side|aside|widget\w*|related|recommend\w*|share|sharing|social|"
    r"subscribe|newsletter|signup|login|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|toolbar|comments?|"
    r"commentlist|respond|replies|reply|disqus|contentinfo|complementary|navigation|search|hidden)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")\b.*?(?:</\1\s*+>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>|<[!?][^>]*+>", re.S | re.I)
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?\Z", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "label", "hint", "items")

    def __init__(self, tag: str, attrs: str = ""):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
        names = " ".join(found.get(k, "") for k in ("class", "id", "role")).strip()
        first = re.sub(r"\d+", "#", (found.get("class") or found.get("id") or "").split(" ")[0])
        self.tag = tag
        self.hint = tag in TEMPLATE_TAGS or bool(names and HINT.search(names))
        self.label = f"{tag}.{first}{'!' if self.hint else ''}" if first else tag
        self.items: list = []  # child nodes and [text, characters inside links]


def parse(page: str) -> Node:
    """Tree of block elements; inline markup becomes text of its block."""
    root = Node("html")
    stack, text, link, links, at = [root], [], 0, 0, 0

    def flush():
        nonlocal text, links
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                stack[-1].items.append([block, min(links, len(block))])
        text, links = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            text.append(piece)
            links += len(piece) if link else 0
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing = tag.lower(), m.group(2) == "/"
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif tag in ("br", "img", "wbr"):
                text.append(" " if tag != "wbr" else "")
            continue
        if tag in ("html", "body") and not closing and any(n.tag == tag for n in stack):
            continue
        flush()
        link = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        # end tags HTML leaves out
        shut = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p" or stack[i].tag in shut:
                del stack[i:]
            elif stack[i].tag in ("ul", "ol", "dl", "table", "div", "article", "section", "td", "th"):
                break
        node = Node(tag, m.group(4))
        stack[-1].items.append(node)
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    rest = _CUT_OFF.sub("", page[at:])
    if rest:
        text.append(rest)
        links += len(rest) if link else 0
    flush()
    return root


def skeleton(root: Node) -> tuple[list, list[tuple[int, str, int]]]:
    """([label, children] with repeated siblings collapsed, blocks as (slot, text,
    link characters) in page order).  Slots number the skeleton in preorder."""
    def shape(node):
        children = []
        for item in node.items:
            if isinstance(item, Node):
                s = shape(item)
                if children and children[-1][0] == s:
                    children[-1][1].append(item)
                else:
                    children.append((s, [item]))
        groups[id(node)] = children
        return [node.label, [c[0] for c in children]]

    groups: dict[int, list] = {}
    tree = shape(root)
    blocks: list[tuple[int, str, int]] = []

    def number(node, at):
        """Slots of the subtree of ``node`` from ``at``; returns the next free slot."""
        slot_of = {}
        free = at + 1
        for _, nodes in groups[id(node)]:
            for n in nodes:
                slot_of[id(n)] = free
            free += size(nodes[0])
        for item in node.items:
            if isinstance(item, Node):
                number(item, slot_of[id(item)])
            else:
                blocks.append((at, item[0], item[1]))
        return free

    sizes: dict[int, int] = {}

    def size(node):
        if id(node) not in sizes:
            sizes[id(node)] = 1 + sum(size(nodes[0]) for _, nodes in groups[id(node)])
        return sizes[id(node)]

    number(root, 0)
    return tree, blocks


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("link", pa.int32()), ("first", pa.bool_())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            shapes, keys, found = [], [], []
            for page in part["html"].to_pylist():
                tree, blocks = skeleton(parse(page))
                shapes.append(json.dumps(tree, separators=(",", ":")))
                keys.append(int.from_bytes(hashlib.blake2b(shapes[-1].encode(), digest_size=8).digest(), "big", signed=True))
                seen: set[tuple[int, str]] = set()
                one = []
                for s, t, k in blocks:
                    one.append({"slot": s, "text": t, "link": k, "first": (s, t) not in seen})
                    seen.add((s, t))
                found.append(one)
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], part["host"], pa.array(keys, pa.int64()),
                 pa.array(shapes, pa.string()), pa.array(found, kind)],
                names=["page_id", "url", "host", "shape_key", "shape", "blocks"])


class Master:
    """A node of the master tree."""

    __slots__ = ("label", "children")

    def __init__(self, label: str):
        self.label, self.children = label, []


def _match(a: Master, b: list) -> tuple[int, list]:
    """Simple tree matching: (matched nodes, pairs of aligned children) of two
    trees whose roots have the same label."""
    m, n = len(a.children), len(b[1])
    if m * n == 0:
        return 1, []
    score = [[None] * n for _ in range(m)]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            if a.children[i].label == b[1][j][0]:
                score[i][j] = _match(a.children[i], b[1][j])
            w = score[i][j][0] if score[i][j] else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w)
    pairs, i, j = [], m, n
    while i and j:
        w = score[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w[0]:
            pairs.append((i - 1, j - 1, w[1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[m][n], pairs[::-1]


def _align(master: Master, tree: list, pairs: list, slots: list) -> None:
    """Append the master node of every slot of ``tree`` in preorder; nodes without
    a partner become new nodes of the master tree."""
    slots.append(master)
    partner = {j: (master.children[i], inner) for i, j, inner in pairs}
    new = []
    for j, child in enumerate(tree[1]):
        if j in partner:
            _align(partner[j][0], child, partner[j][1], slots)
        else:
            node = Master(child[0])
            new.append(node)
            _align(node, child, [], slots)
    master.children += new


def induce(trees: list[tuple[int, list]]) -> tuple[list, dict[int, list[int]]]:
    """(master tree, per key the master slot of each of its slots) of (key, tree),
    the most frequent first.  Slots number the master tree in preorder."""
    master = Master(trees[0][1][0])
    placed = []
    for key, tree in trees:
        slots: list[Master] = []
        _align(master, tree, _match(master, tree)[1], slots)
        placed.append((key, slots))
    numbers: dict[int, int] = {}

    def number(node):
        numbers[id(node)] = len(numbers)
        return [node.label, [number(child) for child in node.children]]

    tree = number(master)
    return tree, {key: [numbers[id(node)] for node in slots] for key, slots in placed}


def grades(tree: list, stats: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """Master slots of content: 2 inside the article, 1 elsewhere.

    ``stats``: per master slot (chars, link chars, constant chars).
    """
    out: dict[int, int] = {}

    def judge(node, at, template, article):
        """Judges the subtree from slot ``at``; returns the next free slot."""
        label = node[0]
        tag = label.split(".")[0].rstrip("!")
        template = template or label.endswith("!") or tag in TEMPLATE_TAGS and not (article and tag == "header")
        article = article or tag in ("article", "main")
        chars, links, constant = stats.get(at, (0, 0, 0))
        if chars and not template and constant < CONSTANT * chars and links <= LINKS * chars:
            out[at] = 2 if article else 1
        at += 1
        for child in node[1]:
            at = judge(child, at, template, article)
        return at

    judge(tree, 0, False, False)
    return out


_PLACED = "host string, part long, key long, slot int, node int, tree string, n long, parts long"


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The master slot (``node``) of every slot of every tree (``key``), and one row per
    part of a host with its master tree.  Rows come sorted by part, the most frequent
    tree first."""
    names = ["host", "part", "key", "slot", "node", "tree", "n", "parts"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def emit(host, part, parts, n, trees):
        tree, found = induce(trees)
        yield rows([host], [part], [None], [None], [None], [json.dumps(tree, separators=(",", ":"))], [n], [parts])
        for key, slots in found.items():
            k = len(slots)
            yield rows([host] * k, [part] * k, [key] * k, range(k), slots, *[[None] * k] * 3)

    last, trees, n = None, [], 0
    for batch in batches:
        for r in batch.to_pylist():
            now = (r["host"], r["part"], r["parts"])
            if trees and now != last:
                yield from emit(*last, n, trees)
                trees, n = [], 0
            last = now
            trees.append((r["key"], json.loads(r["shape"])))
            n += r["n"]
    if trees:
        yield from emit(*last, n, trees)


def parts_of(shapes: DataFrame, group: int) -> DataFrame:
    """(host, part, parts, key, shape, n): a host's skeletons dealt to parts of about ``group``."""
    parts = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).cast("long").alias("parts"))
    return join_bounded(shapes, parts, "host").select(
        "host", F.pmod(F.xxhash64("shape_key"), F.col("parts")).alias("part"), "parts",
        F.col("shape_key").alias("key"), "shape", "n")


def align_hosts(shapes: DataFrame, group: int = GROUP, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(host, shape_key, slot, node) and (host, tree): the master tree of every host and
    the places of all skeletons in it, of (host, shape_key, shape, n)."""
    level, placed = parts_of(shapes, group), None
    while True:
        aligned = stage(level.repartition(partitions(shapes.sparkSession), "host", "part")
                        .sortWithinPartitions("host", "part", F.desc("n"), "key")
                        .select("host", "part", "parts", "key", "shape", "n").mapInArrow(_induce, _PLACED), "html-aligned")
        here = aligned.where("tree IS NULL").select("host", "part", "key", "slot", "node")
        if placed is None:
            placed = here.withColumnRenamed("key", "shape_key")
        else:
            inner = placed.select("host", "shape_key", "slot", F.col("part").alias("key"), F.col("node").alias("inner"))
            placed = stage(join_bounded(inner, here.withColumnRenamed("slot", "inner"), ["host", "key", "inner"])
                           .select("host", "shape_key", "slot", "part", "node"), "html-placed")
        trees = aligned.where("tree IS NOT NULL")
        if (trees.agg(F.max("parts")).first()[0] or 1) == 1:
            return placed.select("host", "shape_key", "slot", "node"), trees.select("host", "tree")
        level = trees.select("host", F.floor(F.col("part") / fan).alias("part"),
                             F.ceil(F.col("parts") / fan).cast("long").alias("parts"),
                             F.col("part").alias("key"), F.col("tree").alias("shape"), "n")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per content slot of each host's master tree."""
    for batch in batches:
        for r in batch.to_pylist():
            found = grades(json.loads(r["tree"]),
                           {s["node"]: (s["chars"], s["links"], s["constant"]) for s in r["stats"]})
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["host"]] * len(found), pa.string()), pa.array(list(found), pa.int32()),
                 pa.array(list(found.values()), pa.int32())], names=["host", "node", "grade"])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    source = spread(pages.select("page_id", "url", host_of(F.col("url")).alias("host"),
                                 F.coalesce("html", F.lit("")).alias("html")))
    rows = stage(source.mapInArrow(
        _blocks, f"page_id {kind}, url string, host string, shape_key long, shape string, "
                 "blocks array<struct<slot:int,text:string,link:int,first:boolean>>"), "html-blocks")
    # only slots, hashes and lengths of the blocks are shuffled; copies of a page count once
    brief = F.transform("blocks", lambda b: F.struct(
        b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("text"), F.length(b["text"]).alias("chars"),
        b["link"].alias("link"), b["first"].alias("first")))
    one = (rows.select("host", "shape_key", brief.alias("brief"))
           .groupBy("host", "shape_key", F.xxhash64("brief").alias("page")).agg(F.min("brief").alias("brief")))
    one = stage(one.select("host", "shape_key", "brief"), "html-pages")
    sizes = one.groupBy("host", "shape_key").agg(F.count(F.lit(1)).alias("n"))
    shapes = rows.groupBy("host", "shape_key").agg(F.min("shape").alias("shape")).join(sizes, ["host", "shape_key"])
    placed, trees = align_hosts(stage(shapes, "html-shapes"), group)
    # the pages that hold a master slot, and those of them on which a text occurs in it
    holding = placed.join(sizes, ["host", "shape_key"]).groupBy("host", "node").agg(F.sum("n").alias("pages"))
    blocks = one.select("host", "shape_key", F.explode("brief").alias("b")).select(
        "host", "shape_key", F.col("b.slot").alias("slot"), F.col("b.text").alias("text"),
        F.col("b.chars").alias("chars"), F.col("b.link").alias("link"), F.col("b.first").alias("first"))
    texts = (join_bounded(blocks, placed, ["host", "shape_key", "slot"]).groupBy("host", "node", "text")
             .agg(F.count_if("first").alias("times"), F.sum("chars").alias("chars"), F.sum("link").alias("links")))
    fixed = (F.col("pages") >= MIN_PAGES) & (2 * F.col("times") >= F.col("pages"))
    stats = (join_bounded(texts, holding, ["host", "node"]).groupBy("host", "node")
             .agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"),
                  F.sum(F.when(fixed, F.col("chars")).otherwise(0)).alias("constant"))
             .groupBy("host").agg(F.collect_list(F.struct("node", "chars", "links", "constant")).alias("stats")))
    graded = stage(trees.join(stats, "host").select("host", "tree", "stats")
                   .mapInArrow(_judge, "host string, node int, grade int"), "html-grades")
    inside, outside = (F.collect_list(F.when(F.col("grade") == g, F.col("slot"))) for g in (2, 1))
    induced = stage(join_bounded(placed, graded, ["host", "node"]).groupBy("host", "shape_key")
                    .agg(inside.alias("inside"), outside.alias("outside"))
                    .select("host", "shape_key", F.array_join(
                        F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("outside")).cast("array<string>"),
                        ",").alias("content")), "html-wrappers")
    wanted = F.split("content", ",")
    text = F.array_join(F.transform(
        F.filter("blocks", lambda b: F.array_contains(wanted, b["slot"].cast("string"))), lambda b: b["text"]), "\n")
    # wrappers within the byte bound are broadcast, so that no text is shuffled
    out = (join_bounded(rows.select("page_id", "url", "host", "shape_key", "blocks"), induced, ["host", "shape_key"], "left")
           .select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
