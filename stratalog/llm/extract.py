"""Main-text extraction by wrapper induction.

Of each host a few different pages (``REFERENCES``, those with the smallest digests of their html) are parsed, and the smallest
of them is the frame.  All pages of the host are aligned with it by simple tree matching: children are matched in order so that most
nodes pair up, equal labels only; a label is the tag with the words of class, id and role.  Over all different pages of the host each node of the frame then is
- template text, if its own text is the same on most pages;
- a menu, if the node is at its place on most pages and most of the text under it is in links, whatever the links say, unless it holds most of the
  page or is part of an article or of the innermost body;
- the body, if it is at its place on most pages and holds most of the text: there, doubtful class words do not count;
- a slot otherwise.
Each page is aligned with its host's wrapper once more: what falls on template text or a menu is dropped, and what fills slots or the body or has
no counterpart is content.  The page's own markup is the prior that goes with it, and all there is on hosts with too few pages: navigation,
headers, footers, asides, forms, scripts, adverts, notices and reader comments go by tag, role or class words, doubtful words among them only
where the wrapper does not call the place the body; where there is an article or main element, only what it holds counts.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one space in page order.

Defined results: null and empty html give an empty text; a null or hostless URL has the host ""; hosts with fewer than ``LEAST_REFERENCES``
different pages have no template; repeated pages are extracted alike; broken markup is read as far as it
goes, at any depth and length; an empty table has no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html as references
import math
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm import common

REFERENCES, LEAST_REFERENCES = 5, 3
#: A host's pages meet its wrapper in so many shares, so that a host with a third of all pages is no single task.
SALTS = 16
#: Scores of pairs of shapes are kept for the next pages; beyond so many, they are forgotten and found anew.
KEPT_SCORES = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends open elements of these kinds.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
PARAGRAPH_ENDS = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: Elements inside which an open element is not looked for.
FENCES = frozenset("table ul ol dl div article section main nav aside form body td th blockquote".split())

DROPPED_TAGS = frozenset("nav footer aside form button select input script style noscript template iframe textarea title head menu dialog svg object canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement advertising sponsored sidebar nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr newsletter signup login comment comments replies disqus toolbar pagination pager".split()
)
#: Words that also stand on what holds an article.
DOUBTFUL_WORDS = frozenset("sponsor promo promotion banner menu masthead notice popup modal subscribe share sharing social related recommended widget".split())
STRONG, DOUBTFUL = 2, 1
#: What a node of a frame is: link text of a menu and text of the body, in tenths of what there is.
MENU, BODY = 1, 2
MENU_TENTHS, BODY_TENTHS = 6, 5
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_NONE_SHOWN = re.compile(r"display\s*:\s*none", re.I)


class Node:
    __slots__ = ("chars", "doubtful", "dropped", "inner", "kids", "label", "links", "part", "shape", "size", "tag", "template")

    def __init__(self, tag: str, prior: int = 0, words: str = "") -> None:
        self.tag, self.dropped, self.doubtful, self.kids = tag, prior == STRONG, prior == DOUBTFUL, []
        self.label = f"{tag} {words}" if words else tag
        self.template: int | None = None
        self.part = self.shape = self.size = self.chars = self.links = 0
        self.inner: list[Node] = []

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def own_text(self) -> str:
        return " ".join("".join(k if isinstance(k, str) else " " for k in self.kids).split())

    def measured(self) -> Node:
        """Sets the shape (what tags are where), the size and the elements of every subtree, in one walk without recursion."""
        for node in reversed(list(self.walk())):
            kids = node.inner = node.elements()
            node.size = 1 + sum(k.size for k in kids)
            node.shape = hash((node.label, *(k.shape for k in kids)))
        return self

    def weighed(self) -> Node:
        """Sets the characters of text under every node of a measured tree, and how many of them are in links; elements that are dropped count for themselves only."""
        for node in reversed(list(self.walk())):
            node.chars = sum(len(k.split()) and len(" ".join(k.split())) for k in node.kids if isinstance(k, str))
            node.links = 0
            for k in node.inner:
                if not k.dropped:
                    node.chars, node.links = node.chars + k.chars, node.links + k.links
            if node.tag == "a":
                node.links = node.chars
        return self

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.elements())


def prior(tag: str, attributes: str) -> tuple[int, str]:
    """How sure an element is none of the main text by its tag, role, class, id or style; and the words of its class, id and role."""
    sure, words = STRONG if tag in DROPPED_TAGS else 0, []
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "role" and value in DROPPED_ROLES or name == "style" and _NONE_SHOWN.search(value):
            sure = STRONG
        if name in ("class", "id", "role"):
            found = [w for w in _SPLIT.split(value) if w and not w.isdigit()]
            words += found
            if name != "role":
                sure = max(sure, 0 if DROPPED_WORDS.isdisjoint(found) else STRONG, 0 if DOUBTFUL_WORDS.isdisjoint(found) else DOUBTFUL)
    return sure, " ".join(words)


def parse(page: str) -> Node:
    """The page as a tree; never fails."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    # where the open elements of each tag are, and the fences: no search through a deep stack
    places: dict[str, list[int]] = {}
    fences: list[int] = []

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in FENCES:
                fences.pop()

    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            stack[-1].kids.append(references.unescape(page[at:]))
            break
        if found.start() > at:
            stack[-1].kids.append(references.unescape(page[at : found.start()]))
        at = found.end()
        closing, name, attributes = found[1] or found[4], found[2] or found[5], found[3] or found[6] or ""
        if not name:
            continue
        tag = name.lower()
        if closing:
            inside = last(tag)
            if inside and (tag in FENCES or not fences or inside > fences[-1]):
                close(inside)
            else:
                stack[-1].kids.append(Node(tag))  # it closes nothing, but a block's end parts what is around it
            continue
        ended = ENDS.get(tag) or ({"p"} if tag in PARAGRAPH_ENDS else None)
        if ended:
            inside = max(last(t) for t in ended)
            if inside and (not fences or inside >= fences[-1]):
                close(inside)
        node = Node(tag, *prior(tag, attributes))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            if tag in FENCES:
                fences.append(len(stack))
            stack.append(node)
    return root


# -- simple tree matching ---------------------------------------------------------------------


_SCORES: dict[tuple[int, int], int] = {}


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """How many nodes of two measured trees pair up at most, and the pairs."""
    if a.label != b.label:
        return 0, []
    if len(_SCORES) > KEPT_SCORES:
        _SCORES.clear()
    pairs: list[tuple[Node, Node]] = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.shape == y.shape:
            pairs += zip(x.walk(), y.walk(), strict=True)
            continue
        pairs.append((x, y))
        left, right, like = unlike(x, y)
        todo += like
        if left and right:
            todo += between(left, right)
    return len(pairs), pairs


def unlike(a: Node, b: Node) -> tuple[list[Node], list[Node], list[tuple[Node, Node]]]:
    """The children between like subtrees at both ends, and those, which pair up wholly: nothing can be better."""
    left, right = a.inner, b.inner
    head, tail = 0, 0
    most = min(len(left), len(right))
    while head < most and left[head].shape == right[head].shape:
        head += 1
    while tail < most - head and left[-1 - tail].shape == right[-1 - tail].shape:
        tail += 1
    ends = [*zip(left[:head], right[:head], strict=True), *zip(left[len(left) - tail :], right[len(right) - tail :], strict=True)]
    return left[head : len(left) - tail], right[head : len(right) - tail], ends


def score(a: Node, b: Node) -> int:
    """How many nodes of two subtrees pair up at most: by shapes, each pair of shapes once, without recursion."""

    def known(x: Node, y: Node) -> int | None:
        return 0 if x.label != y.label else x.size if x.shape == y.shape else _SCORES.get((x.shape, y.shape))

    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if known(x, y) is not None:
            todo.pop()
            continue
        left, right, like = unlike(x, y)
        lefts, rights = {n.shape: n for n in left}.values(), {n.shape: n for n in right}.values()
        missing = [(p, q) for p in lefts for q in rights if known(p, q) is None]
        if missing:
            todo += missing
            continue
        best = 0
        if left and right:
            best = int(rows_of(table(left, right), np.zeros(len(right) + 1, np.int64), 0, len(left))[0][0])
        _SCORES[x.shape, y.shape] = 1 + sum(p.size for p, _ in like) + best
        todo.pop()
    found = known(a, b)
    return found if found is not None else 0


class Table(NamedTuple):
    """The scores of all pairs of two lists by kinds of shapes: row by row without a cell for each pair."""

    scores: np.ndarray
    left: list[int]
    right: np.ndarray


def table(left: list[Node], right: list[Node]) -> Table:
    """Of lists whose scores are known."""
    lefts, rights = {n.shape: n for n in left}, {n.shape: n for n in right}
    scores = np.array([[score(p, q) for q in rights.values()] for p in lefts.values()], dtype=np.int64)
    rows, columns = {s: k for k, s in enumerate(lefts)}, {s: k for k, s in enumerate(rights)}
    return Table(scores, [rows[n.shape] for n in left], np.array([columns[n.shape] for n in right]))


def rows_of(t: Table, below: np.ndarray, start: int, stop: int, every: int = 0) -> list[np.ndarray]:
    """The best sums from row start (first) to the given one below row stop - 1: only the first, or each that every divides, or all if every is 1."""
    kept = []
    for i in range(stop - 1, start - 1, -1):
        pair = t.scores[t.left[i]][t.right]
        row = np.empty_like(below)
        row[-1] = 0
        row[:-1] = np.where(pair > 0, np.maximum(below[:-1], pair + below[1:]), below[:-1])
        below = np.maximum.accumulate(row[::-1])[::-1]
        if i == start or every and i % every == 0:
            kept.append(below)
    return kept[::-1]


def between(left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
    """The pairs of an in-order matching of unlike children with the largest score; some rows are kept, the others found again block by block."""
    # scores first: no pair of shapes is looked at twice
    t, n = table(left, right), len(left)
    block = math.isqrt(n - 1) + 1
    last = np.zeros(len(right) + 1, np.int64)
    marks = [*rows_of(t, last, 0, n, block), last]
    out, i, j = [], 0, 0
    for k in range(len(marks) - 1):
        stop = min(n, (k + 1) * block)
        rows = [*rows_of(t, marks[k + 1], k * block, stop, 1), marks[k + 1]]
        while i < stop and j < len(right):
            here, below = rows[i - k * block], rows[i - k * block + 1]
            pair = t.scores[t.left[i], t.right[j]]
            if pair and here[j] == pair + below[j + 1]:
                out.append((left[i], right[j]))
                i, j = i + 1, j + 1
            elif here[j] == below[j]:
                i += 1
            else:
                j += 1
    return out


# -- wrappers ---------------------------------------------------------------------------------


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def induce(pages: list[str]) -> Node | None:
    """The smallest of the different references, the frame of the host's wrapper; None if they are too few."""
    trees = sorted((parse(p).measured() for p in sorted(set(pages))), key=lambda t: t.size)
    return trees[0] if len(trees) >= LEAST_REFERENCES else None


def marks(places: dict[int, int], frame: Node, page: str) -> list[dict[str, int | None]]:
    """What of a page falls on nodes of the frame, by the nodes' places in it: own texts, and the weight of blocks."""
    out: list[dict[str, int | None]] = []
    for x, y in align(frame, parse(page).measured().weighed())[1]:
        text, block = y.own_text(), y.tag in BLOCKS or y.tag == "#root"
        if text or block:
            out.append({"node": places[id(x)], "text": signed(text_key(text)) if text else None, "chars": y.chars if block else 0, "links": y.links if block else 0})
    return out


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def packed(node: Node) -> bytes:
    """A wrapper as bytes: tags, labels, template keys, parts and numbers of children in page order."""
    return pickle.dumps([(n.tag, n.label, n.template, n.part, len(n.elements())) for n in node.walk()])


def unpacked(raw: bytes) -> Node:
    root = Node("")
    open_nodes = [[root, 1]]
    for tag, label, template, part, n in pickle.loads(raw):
        while not open_nodes[-1][1]:
            open_nodes.pop()
        node = Node(tag)
        node.label, node.template, node.part = label, template, part
        open_nodes[-1][0].kids.append(node)
        open_nodes[-1][1] -= 1
        open_nodes.append([node, n])
    return root.kids[0].measured()


def main_text(page: str | None, wrapper: Node | None = None) -> str:
    """The page's main text."""
    if not page:
        return ""
    tree = parse(page)
    template: set[int] = set()
    if wrapper is not None:
        for x, y in align(wrapper, tree.measured())[1]:
            if x.template is not None and text_key(y.own_text()) == x.template:
                template.add(id(y))
            if x.part == MENU:
                y.dropped = True
            elif x.part == BODY:
                y.doubtful = False
    tops, todo = [], [tree]
    while todo:  # the outermost bodies that are not inside a dropped element
        node = todo.pop()
        if node.dropped or node.doubtful:
            continue
        if node.tag in ("article", "main"):
            tops.append(node)
        else:
            todo += reversed(node.elements())
    blocks: list[str] = []
    for top in tops or [tree]:
        collect(top, template, blocks, bool(tops))
    return " ".join(t for b in blocks if (t := " ".join(b.split())))


def collect(top: Node, template: set[int], blocks: list[str], in_article: bool) -> None:
    """Appends the blocks of a subtree in page order."""
    current: list[str] = []

    def flush() -> None:
        blocks.append("".join(current))
        current.clear()

    todo: list[object] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            current.append(x[0])
        elif not (x.dropped or x.doubtful or x.tag == "header" and not in_article):
            block, fixed = x.tag in BLOCKS or x.tag == "#root", id(x) in template
            if block:
                flush()
                todo.append(None)
            todo += reversed([k if isinstance(k, Node) else (" " if fixed else k,) for k in x.kids])
        elif x.tag in BLOCKS:  # what is dropped still parts what is around it
            flush()
    flush()


# -- over tables ------------------------------------------------------------------------------


def host(url: object) -> object:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0))), F.lit(""))


def frames(known: DataFrame, different: DataFrame) -> DataFrame:
    """host, wrapper without a template, for each host with enough different pages."""
    # chosen on narrow rows, so that only references carry their html; a task passes on REFERENCES rows a host at most
    place = F.row_number().over(Window.partitionBy("host").orderBy("digest"))
    chosen = common.written(different.withColumn("place", place).where(F.col("place") <= REFERENCES).select("host", "digest", "rank"), "references")
    # one row a reference, however often the page is repeated
    found = known.join(chosen, ["host", "digest", "rank"]).select("host", "digest", "html").dropDuplicates(["host", "digest"]).select("host", "html")

    def run(table: pa.Table) -> pa.Table:
        frame = induce(table.column("html").to_pylist())
        made = [(table.column("host")[0].as_py(), packed(frame))] if frame is not None else []
        return pa.table({"host": pa.array([h for h, _ in made], pa.string()), "wrapper": pa.array([w for _, w in made], pa.binary())})

    return found.groupBy("host").applyInArrow(run, "host string, wrapper binary")


def salted(pages: DataFrame, learned: DataFrame, how: str) -> DataFrame:
    """Pages with their host's wrapper."""
    shares = learned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(shares, ["host", "salt"], how)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper for each host that has one, from pages (page_id, url, host, html)."""
    known = pages.where(F.length("html") > 0).withColumns({"digest": F.unhex(F.md5(F.col("html").cast("binary"))), "rank": F.xxhash64("page_id", "url")})
    different = common.written(known.groupBy("host", "digest").agg(F.min("rank").alias("rank")), "different")
    learned = common.written(frames(known, different), "frames")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, frame, places = None, Node(""), {}
        for piece in common.pieces(batches, "html"):
            found = []
            for page, raw in zip(piece.column("html").to_pylist(), piece.column("wrapper").to_pylist(), strict=True):
                if raw != last:
                    last, frame = raw, unpacked(raw)
                    places = {id(n): k for k, n in enumerate(frame.walk())}
                found.append(marks(places, frame, page))
            kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]))
            yield pa.RecordBatch.from_arrays([piece.column("host"), piece.column("digest"), pa.array(found, kind)], names=["host", "digest", "marks"])

    # every page of the host has its say, copies together one; only keys of texts and sums travel
    said = salted(known, learned, "inner").select("host", "digest", "html", "wrapper").mapInArrow(aligned, "host string, digest binary, marks array<struct<node: int, text: long, chars: long, links: long>>")
    counts = said.dropDuplicates(["host", "digest"]).select("host", F.inline("marks")).groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    # a text that more than half of the pages have is the most frequent one of its node
    best = F.max(F.when(F.col("text").isNotNull(), F.struct("n", "text"))).alias("best")
    nodes = counts.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), best)
    sizes = different.groupBy("host").agg(F.count("*").alias("pages"))
    most = nodes.join(sizes, "host").where((F.col("n") >= LEAST_REFERENCES) & (2 * F.col("n") > F.col("pages")))
    text = F.when((F.col("best.n") >= LEAST_REFERENCES) & (2 * F.col("best.n") > F.col("pages")), F.col("best.text"))
    template = most.groupBy("host").agg(F.collect_list(F.struct("node", text.alias("text"), "chars", "links")).alias("nodes"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for raw, nodes in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "nodes")), strict=True):
                frame = unpacked(raw)
                decide(frame, nodes)
                made.append(packed(frame))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.binary())], names=["host", "wrapper"])

    return learned.join(template, "host").select("host", "wrapper", "nodes").mapInArrow(marked, "host string, wrapper binary")


def decide(frame: Node, nodes: list[dict]) -> None:
    """Sets what each node of a frame is, from what most pages of the host have there."""
    every = list(frame.walk())
    whole = max((x["chars"] for x in nodes if not x["node"]), default=0)
    bodies = [x["node"] for x in nodes if whole and 10 * x["chars"] >= BODY_TENTHS * whole]
    inner = every[max((k for k in bodies if any(n.tag in BLOCKS - {"br", "hr"} for n in every[k].elements())), default=0)]
    holds = {id(n) for n in every if n.tag in ("article", "main")} | ({id(inner)} if inner.tag not in ("#root", "html", "body") else set())
    for node in every:  # lists of links in an article, or in the innermost body, are its text
        if id(node) in holds:
            holds.update(id(k) for k in node.elements())
    for x in nodes:
        node = every[x["node"]]
        if x["text"] is not None:
            node.template = x["text"] % (1 << 64)
        if x["node"] in bodies:
            node.part = BODY
        elif x["chars"] and 10 * x["links"] >= MENU_TENTHS * x["chars"] and id(node) not in holds:
            node.part = MENU


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars."""
    narrow = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host(F.col(url_column)).alias("host"), F.col(html_column).alias("html"))
    learned = common.written(wrappers(narrow), "wrappers")
    both = salted(narrow, learned, "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, Node | None] = (None, None)
        for piece in common.pieces(batches, "html"):
            texts = []
            for page, raw in zip(piece.column("html").to_pylist(), piece.column("wrapper").to_pylist(), strict=True):
                if raw != last[0]:
                    last = (raw, unpacked(raw) if raw else None)
                texts.append(main_text(page, last[1]))
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(narrow.dtypes)["page_id"]
    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_column, "url": url_column})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_extract: the main text of every page of the table."""
    return extract(common.read(spark, sf_dir, "pages"))
