"""Main text of pages by consensus host paths.

1. Every page is parsed as tag soup.  Each element has a generalised tag-class
   path: the tags from the root on, with their classes (digits as ``#``,
   sorted), without positions.  A block element scores its own text and half of
   its children's scores, less its links; the best one gets the page's vote.
2. Spark adds the votes by host and path.  A host's winning paths are those
   with at least KEEP of the leading path's votes and a MOST-th of all the host's
   votes, so there are MOST of them at most.
3. Pages are parsed once more; the text of all elements on the first winning
   path that the page has is its main text.  A page without any gets its own
   best element's.

Votes are summed before the shuffle, which holds a row for each host and path of
a task.  The winners are written first, so Spark knows their size when it plans the
join: it broadcasts them below spark.sql.autoBroadcastJoinThreshold, and the pages
are not shuffled; beyond it both sides are shuffled by host, and AQE splits the
partition of a host that has very many pages.  Parsing takes time in proportion to the
page, whatever is left open in it.

Defined results: a null page has text null and method ``none``; a page without
any text, as an empty one, has the empty text; a very long page is parsed whole.
Pages without a host (a null url too) don't vote and have method ``own``.  Of equal
scores the outer, earlier element wins; of equal votes the path first in the
alphabet.  Repeated rows vote each time, and come out each time; an empty table
gives no rows.  Columns that are not carried may have any name; a carried one named
as a result column is replaced by it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _shared

KEEP, MOST = 0.5, 64
BLOCKS = frozenset("html body article aside blockquote center dd details div dl fieldset figure footer form header li main nav ol section table tbody td th tr ul".split())
BREAKS = BLOCKS | frozenset("address br caption dt figcaption h1 h2 h3 h4 h5 h6 hr legend option p pre summary thead tfoot title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object select textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: An opening tag ends these open ones first, up to the nearest block that holds them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.DOTALL)
CLASS = re.compile(r"""(?<![\w-])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "segment", "parent", "children", "own", "links", "parts", "hidden", "link", "score")

    def __init__(self, tag: str, segment: str, parent: Node | None):
        self.tag, self.segment, self.parent = tag, segment, parent
        self.children: list[Node] = []
        self.parts: list = []  # texts, breaks (None) and children in order
        self.own = self.links = 0
        self.hidden = parent is not None and parent.hidden or tag in HIDDEN
        self.link = parent is not None and parent.link or tag == "a"
        self.score = 0.0


def segment(tag: str, attributes: str) -> str:
    m = CLASS.search(attributes) if attributes and "class" in attributes.lower() else None
    if not m:
        return tag
    names = sorted({DIGITS.sub("#", c) for c in (m[1] or m[2] or m[3] or "").split()})
    return ".".join([tag, *names])


class Open:
    """The open elements of a page, from the root on, with the depths of each tag's and of the blocks, so that nothing is searched for."""

    def __init__(self, root: Node):
        self.nodes, self.depths, self.blocks = [root], {}, [0]

    def nearest(self, tags: tuple[str, ...]) -> int:
        """The greatest depth at which one of the tags is open; 0 where none is."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        tag = self.nodes.pop().tag
        self.depths[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()

    def cut(self, depth: int) -> None:
        """Close all from this depth on."""
        while len(self.nodes) > depth:
            self.pop()


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are put up with."""
    root = Node("", "", None)
    stack, at, raw = Open(root), 0, None
    for m in TOKEN.finditer(page):
        if raw:  # only its own end tag ends it
            if m[2] is None or not m[1] or m[2].lower() != raw:
                continue
            raw = None
        if m.start() < at:
            continue
        node = stack.nodes[-1]
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = stack.nearest((tag,))
            if depth and (tag in BLOCKS or depth > stack.blocks[-1]):  # a tag that is no block ends nothing outside of one
                stack.cut(depth)
            if tag in BREAKS:
                stack.nodes[-1].parts.append(None)
            continue
        if tag in BREAKS:
            # A block or a paragraph closes an open paragraph and what is open in it.
            depth = stack.nearest(ENDS.get(tag, ("p",)))
            if depth and depth >= stack.blocks[-1]:
                stack.cut(depth)
                while tag == "tr" and stack.nodes[-1].tag in ("td", "th", "tr"):
                    stack.pop()
            elif tag in BLOCKS or tag == "p":
                while stack.nodes[-1].tag and stack.nodes[-1].tag not in BREAKS:  # inline elements end at a block
                    stack.pop()
            stack.nodes[-1].parts.append(None)
        if tag in VOID or m[3].endswith("/"):
            continue
        node = stack.nodes[-1]
        child = Node(tag, segment(tag, m[3]), node)
        node.children.append(child)
        node.parts.append(child)
        stack.push(child)
        if tag in RAW:
            raw = tag
    if at < len(page) and not raw:
        stack.nodes[-1].parts.append(page[at:])
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, a parent before its children, in order of the page."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.children))
    return out


def score(root: Node) -> Node | None:
    """Score the blocks; the best one, or None on a page without text."""
    nodes = walk(root)
    holder: dict[int, Node] = {}
    for n in nodes:
        holder[id(n)] = n if n.tag in BLOCKS or n is root else holder[id(n.parent)]
        if not n.hidden:
            size = sum(len(SPACE.sub(" ", p)) for p in n.parts if p.__class__ is str and not p.isspace())
            holder[id(n)].own += size
            holder[id(n)].links += size if n.link else 0
    best = None
    for n in reversed(nodes):
        if holder[id(n)] is n:
            n.score += n.own - 2.0 * n.links
            if n.parent is not None:
                holder[id(n.parent)].score += max(0.0, n.score) / 2
    for n in nodes:
        if holder[id(n)] is n and (n.own or n.score > 0) and (best is None or n.score > best.score):
            best = n
    return best


def path(node: Node) -> str:
    parts = []
    while node.parent is not None:
        parts.append(node.segment)
        node = node.parent
    return "/".join(reversed(parts))


def text(nodes: list[Node]) -> str:
    """The visible text, a line for each paragraph."""
    out: list[str] = []
    for top in nodes:
        stack: list = [None, *reversed(top.parts)] if not top.hidden else []
        while stack:
            p = stack.pop()
            if p is None:
                out.append("\n")
            elif p.__class__ is str:
                out.append(SPACE.sub(" ", p))
            elif not p.hidden:
                stack.extend(reversed(p.parts))
    lines = (SPACE.sub(" ", entities.unescape(line)).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def matching(root: Node, paths: list[str]) -> list[Node]:
    """The nodes on the first of the paths that the page has; inside one of them no other counts."""
    for wanted in paths:
        if not wanted:
            return [root]
        found = [root]
        for s in wanted.split("/"):
            found = [c for n in found for c in n.children if c.segment == s]
        found = [n for n in found if not n.hidden]
        if found:
            return found
    return []


def host(url: Column) -> Column:
    """The host in lower case, without port and a leading www; null where there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def vote(page: str) -> str | None:
    best = score(parse(page))
    return None if best is None else path(best)


def votes(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, votes)."""
    kept = pages.select(host(pages[url]).alias("host"), pages[html].alias("html")).where("host IS NOT NULL AND html IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = vote(page)
                if p is not None:
                    total[h, p] += 1
            if len(total) > 100_000:
                yield _votes(total)
                total = Counter()
        yield _votes(total)

    return kept.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def _votes(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["host", "path", "votes"])


def winners(voted: DataFrame, keep: float = KEEP, most: int = MOST) -> DataFrame:
    """(host, paths): the winning paths, at most ``most`` of a host, the leading one first."""
    leads = voted.groupBy("host").agg(F.max("votes").alias("top"), F.sum("votes").alias("all"))
    led = voted.join(leads, "host").where((F.col("votes") >= keep * F.col("top")) & (F.col("votes") * most >= F.col("all")))
    return led.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", carry: tuple[str, ...] = ("page_id", "url"), keep: float = KEEP) -> DataFrame:
    """The carried columns, host, text, path (of the element taken) and method (consensus, own or none) of each page."""
    names = [c for c in carry if c not in ("host", "text", "path", "method")]
    body, paths = _shared.fresh(names, "__html", "__paths")
    voted, path = _shared.write_table(votes(pages, html, url), "votes")
    won, _ = _shared.write_table(winners(voted, keep).withColumnRenamed("paths", paths), "winners")
    _shared.remove(pages.sparkSession, path)
    kept = pages.select(*names, host(pages[url]).alias("host"), pages[html].alias(body))
    joined = kept.join(won, "host", "left").select(*names, "host", paths, body)
    schema = T.StructType([*(joined.schema[c] for c in names), *(T.StructField(n, T.StringType()) for n in ("host", "text", "path", "method"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns
            out = [one(p, w) for p, w in zip(batch.column(at - 1).to_pylist(), batch.column(at - 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at - 2], *(pa.array([o[i] for o in out], pa.string()) for i in range(3))], names=schema.names)

    return joined.mapInArrow(run, schema)


def one(page: str | None, paths: list[str] | None) -> tuple[str | None, str | None, str]:
    """(text, path, method) of a page, given its host's winning paths."""
    if page is None:
        return None, None, "none"
    root = parse(page)
    found = matching(root, paths or [])
    if found:
        return text(found), path(found[0]), "consensus"
    best = score(root)
    return ("", None, "own") if best is None else (text([best]), path(best), "own")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
