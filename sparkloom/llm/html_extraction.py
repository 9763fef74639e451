"""HTML extraction by union-free regular-expression inference.

A page is a stream of tags and texts. Runs of like siblings become repeated groups, and every element's own text a slot;
that is the page's skeleton. The skeletons of a host are aligned one with another into the host's wrapper, a union-free
regular expression: what both have is matched, what one lacks becomes optional, what stands twice becomes repeated, equal
texts stay constants and differing ones become slots. The wrapper decides what is read:

* the article is its article or main element, else the node down to which most of the running text in slots goes;
* constants of the wrapper are template text and are left out, unless a page has them as its title;
* lists and boxes whose text is nearly all links over the whole host are menus, whatever their names.

A page is matched with its host's wrapper from the root down; one that lacks the wrapper's article node is read by its
own skeleton. Constants and menus need at least ``SUPPORT`` different pages of the host.

Partial wrappers are made map-side: pages of one structure are added up without alignment, other structures aligned.
Partial wrappers of a host meet in ``BUCKETS`` groups, then these. So a host with a third of all pages sends some wrappers
a task. Wrappers are joined to pages by host; Spark broadcasts them only while their file is under its own size limit.

Style: Arrow batches for pages, grouped pandas for the few wrappers. Elements nested deeper than ``DEEP`` count as breaks
in the text of their ancestor at that depth, so no page is too deep. Defined results: null or empty html gives an empty
text; a null url is a host of its own; broken markup never fails; repeated rows are read alike and count once as different
pages; very long pages are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.llm.common import cut, table

BUCKETS = 64
#: Different pages of a host from which constants and menus are told; share of link text that makes a menu.
SUPPORT, LINKED = 5, 0.75
#: Levels of elements that a tree has; children of one node that are aligned in order, more being taken by key.
DEEP, ALIGNED = 120, 64
#: Structures of pages that a task keeps before it aligns them.
HELD = 2000

# Fixed values of HTML: elements without an end, with raw text, that start a block, and that end by themselves.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes|svg|math|select|object"
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": set("div article section main td li blockquote body aside nav header footer form".split())}
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Blocks that end the way down to an article, and that may be menus.
STOPS = CLOSES_P - {"div", "section", "article", "main", "table"}
BOXES = set("ul ol dl div section table".split())
#: Names of page furniture, as tags and as words of class, id or role.
FURNITURE_TAGS = set("nav aside footer form button dialog menu head".split())
FURNITURE = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner topbar footer foot sidebar aside widget related recommended recommendations promo promotion "
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social comment comments commentlist respond reply replies disqus discussion login search pagination pager toolbar copyright "
    "legal disclaimer complementary contentinfo form".split())
#: Words that make a name a remark on the layout, as in has-sidebar.
REMARKS = {"has", "with", "no", "without", "is", "not"}
#: Never furniture themselves, but for articles that these name.
FRAMES = {"html", "body", "main", "article"}
NOTES = {"comment", "comments", "reply", "replies", "respond", "related", "recommended"}
#: Furniture only outside an article, where these name its own head.
HEADS = {"header", "hd"}
ARTICLE = {"article", "main"}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|</([a-z][^\s/>]*)[^>]*(?:>|$)"
    r"""|<([a-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<([a-z][^\s/>]*)([^>]*)(?:>|$)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


class Node:
    """An element of a page: its key, direct content in order, and whether it is furniture."""

    __slots__ = ("tag", "key", "furniture", "content", "holds", "depth")

    def __init__(self, tag: str, attributes: str = "", in_article: bool = False):
        self.tag, self.content, self.holds = tag, [], False
        self.depth = 0
        names, hidden = [], False
        words: set[str] = set()
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or "").strip("\"'")
                if name in ("class", "id", "role"):
                    names.append(value)
                    for one in value.split():
                        parts = [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", one) if w]
                        if parts and parts[0] not in REMARKS:
                            words.update(parts)
                elif name == "style":
                    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                else:
                    hidden |= name == "hidden" or value.lower() == "true"
        # digits in names tell pages apart, not templates
        self.key = tag + "".join("." + re.sub(r"\d+", "0", ".".join(n.split())) for n in names if n)
        head = tag == "header" or bool(words & HEADS)
        named = words & NOTES if tag == "article" else set() if tag in FRAMES else words & FURNITURE
        self.furniture = hidden or bool(named) or tag in FURNITURE_TAGS or (head and not in_article and tag not in FRAMES)

    def dropped(self) -> bool:
        """Furniture that is no frame around an article: not what holds an article or main element, or a form around most of the
        page's text."""
        return self.furniture and not self.holds


def parse(page: str) -> Node:
    """The tree of a page; text stands in content as strings."""
    root = Page("#page")
    root.title = entities.unescape(m[1]) if (m := TITLE.search(page)) else ""
    stack = [root]  # deep elements stand here too, but their content goes to the last node of the tree
    tree = [root]
    articles = chars = 0
    forms: dict[int, tuple[Node, int]] = {}  # open forms, and the characters before them

    def close(to: int) -> None:
        nonlocal articles
        for node in stack[to:]:
            articles -= node.tag in ARTICLE
            if id(node) in forms:
                forms[id(node)] = node, chars - forms[id(node)][1]
            if node.depth:
                tree.pop()
            else:
                tree[-1].content.append(Node("#break"))
        del stack[to:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            tree[-1].content.append(page[at : m.start()])
            chars += m.start() - at
        at = m.end()
        tag = m[3] or m[5]
        if m[2]:
            name = m[2].lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    close(i)
                    break
        elif tag:
            tag = tag.lower()
            attributes = m[4] or m[6] or ""
            ends = ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if ends:
                scope = SCOPES.get(tag, set()) | (SCOPES["p"] if "p" in ends else set())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in scope:
                        break
            node = Node(tag, attributes, articles > 0)
            void = tag in VOID or attributes.rstrip().endswith("/")
            if void or len(tree) < DEEP or (node.furniture and len(tree) == DEEP):
                tree[-1].content.append(node)
                node.depth = len(tree)
            else:
                tree[-1].content.append(Node("#break"))
            if not void:
                stack.append(node)
                if tag == "form" and not articles:
                    forms[id(node)] = node, chars
                if node.depth:
                    tree.append(node)
                articles += tag in ARTICLE
                if tag in ARTICLE and not node.furniture:
                    for above in tree[:-1]:
                        above.holds = True
        # comments, raw elements and declarations leave nothing
    if at < len(page):
        tree[-1].content.append(page[at:])
        chars += len(page) - at
    close(1)
    for node, n in forms.values():
        node.holds |= 2 * n > chars
    return root


class Wrapper:
    """A node of a skeleton or wrapper: what is known of it over all pages.

    ``text`` is None without text of its own, the digest of a constant, or "" for a slot.
    """

    __slots__ = ("key", "repeated", "optional", "text", "pages", "chars", "links", "children")

    def __init__(self, key, repeated=False, optional=False, text=None, pages=1, chars=0, links=0, children=()):
        self.key, self.repeated, self.optional, self.text = key, repeated, optional, text
        self.pages, self.chars, self.links, self.children = pages, chars, links, list(children)

    def structure(self) -> str:
        return f"{self.key}{'+' * self.repeated}({' '.join(c.structure() for c in self.children)})"

    def to_list(self) -> list:
        return [self.key, int(self.repeated), int(self.optional), self.text, self.pages, self.chars, self.links, [c.to_list() for c in self.children]]

    @staticmethod
    def from_list(x: list) -> Wrapper:
        return Wrapper(x[0], bool(x[1]), bool(x[2]), *x[3:7], map(Wrapper.from_list, x[7]))

    def add(self, other: Wrapper, pages: bool = True) -> None:
        """Own facts of another node of the same place; ``pages`` if it is from other pages."""
        self.repeated |= other.repeated
        self.optional |= other.optional
        if other.text is not None:
            self.text = other.text if self.text in (None, other.text) else ""
        self.pages += other.pages * pages
        self.chars += other.chars
        self.links += other.links

    def add_alike(self, other: Wrapper) -> None:
        """A wrapper of the same structure."""
        self.add(other)
        for a, b in zip(self.children, other.children, strict=True):
            a.add_alike(b)


def digest(text: str) -> str:
    return blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def skeleton(node: Node) -> Wrapper:
    """The skeleton of a page's node: inline elements dissolved, like neighbours folded, furniture closed."""
    own = Wrapper(node.key)
    parts: list[str] = []

    def gather(n: Node, linked: bool) -> None:
        for x in n.content:
            if isinstance(x, str):
                size = len(x.strip())
                if size:
                    parts.append(x)
                    own.chars += size
                    own.links += size * linked
            elif x.dropped():
                own.children.append(Wrapper("!" + x.key))
            elif x.tag in INLINE:
                gather(x, linked or x.tag == "a")
            elif x.tag not in VOID and x.tag != "#break":
                own.children.append(skeleton(x))

    gather(node, False)
    if parts:
        own.text = digest(" ".join(parts))
    own.children = fold(own.children)
    return own


def fold(children: list[Wrapper]) -> list[Wrapper]:
    """Neighbours with one key are one repeated group; of very many children all with one key are."""
    out: list[Wrapper] = []
    known: dict[str, Wrapper] = {}
    for c in children:
        like = out[-1] if out and out[-1].key == c.key else known.get(c.key) if len(children) > ALIGNED else None
        if like is None:
            out.append(c)
            known[c.key] = c
        else:
            like.add(c, pages=False)
            like.repeated = True
            like.children = align(like.children, c.children)
    return out


def align(a: list[Wrapper], b: list[Wrapper]) -> list[Wrapper]:
    """Children of a wrapper and of another: matched, or optional."""
    out: list[Wrapper] = []
    for what, i, j, k, n in SequenceMatcher(None, [x.key for x in a], [x.key for x in b], autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:n], strict=True):
                x.add(y)
                x.children = align(x.children, y.children)
                out.append(x)
        else:
            for x in a[i:j] + b[k:n]:
                x.optional = True
                out.append(x)
    return fold(out)


def expression(nodes: list[Wrapper]) -> str:
    """A wrapper as a union-free regular expression: # is a slot, = a constant."""
    return " ".join(
        f"{x.key}({'' if x.text is None else '#' if x.text == '' else '='}{' ' * bool(x.text is not None and x.children)}{expression(x.children)}){'+' * x.repeated}{'?' * x.optional}" for x in nodes)


class Reader:
    """A host's wrapper, ready to read pages by."""

    def __init__(self, root: Wrapper, different: int):
        self.root, self.sure = root, different >= SUPPORT
        self.total: dict[int, tuple[int, int]] = {}
        self._sum(root)
        self.article = self._article()

    def constant(self, w: Wrapper | None) -> bool:
        return self.sure and w is not None and bool(w.text) and w.pages >= SUPPORT

    def menu(self, w: Wrapper | None) -> bool:
        if w is None or not self.sure or w.pages < SUPPORT or w.key.split(".")[0] not in BOXES:
            return False
        total, links = self.total[id(w)]
        return bool(w.children) and links >= LINKED * total > 0

    def _sum(self, w: Wrapper) -> tuple[int, int]:
        """Characters and link characters in slots below a node."""
        total, links = (0, 0) if self.constant(w) else (w.chars, w.links)
        for c in w.children:
            if c.key[0] != "!":
                t, k = self._sum(c)
                total += t
                links += k
        self.total[id(w)] = total, links
        return total, links

    def running(self, w: Wrapper) -> int:
        total, links = self.total[id(w)]
        return total - links

    def _below(self, w: Wrapper) -> Iterator[Wrapper]:
        for c in w.children:
            if c.key[0] != "!" and not self.menu(c):
                yield c
                yield from self._below(c)

    def _article(self) -> Wrapper:
        named = [w for w in self._below(self.root) if w.key.split(".")[0] in ARTICLE or "main" in w.key.split(".")[1:]]
        articles = [w for w in named if w.key.split(".")[0] == "article"]
        if named:
            return max(articles or named, key=lambda w: (self.running(w), w.key))
        here = self.root
        while True:
            below = [c for c in here.children if c.key[0] != "!" and not self.menu(c)]
            best = max(below, key=lambda w: (self.running(w), w.key), default=None)
            if best is None or self.running(best) < 0.6 * self.running(here) or best.key.split(".")[0] in STOPS:
                return here
            here = best

    def read(self, page: Node) -> str | None:
        """The article of a page, or None if it lacks the wrapper's article node."""
        found: list[tuple[Node, Wrapper]] = []
        title = ""

        def seek(node: Node, w: Wrapper) -> None:
            if w is self.article:
                found.append((node, w))
                return
            for x, c in matched(node, w):
                if c is not None and c.children or c is self.article:
                    seek(x, c)

        seek(page, self.root)
        if not found:
            return None
        blocks: list[list[str]] = [[]]

        def texts(node: Node, w: Wrapper | None) -> None:
            pairs = dict((id(x), c) for x, c in matched(node, w))
            own = "" if not self.constant(w) else " ".join(own_text(node))
            silent = bool(own) and digest(own) == w.text and " ".join(own.split()) != title

            def walk(n: Node) -> None:
                for x in n.content:
                    if isinstance(x, str):
                        if not silent:
                            blocks[-1].append(x)
                    elif x.dropped():
                        continue
                    elif x.tag == "br":
                        blocks[-1].append(" ")
                    elif x.tag == "#break":
                        blocks.append([])
                    elif x.tag in INLINE:
                        walk(x)
                    elif not self.menu(c := pairs.get(id(x))):
                        blocks.append([])
                        texts(x, c)
                        blocks.append([])

            walk(node)

        title = " ".join(page.title.split()) if isinstance(page, Page) else ""
        for node, w in found:
            texts(node, w)
            blocks.append([])
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


class Page(Node):
    """The root of a page's tree, with the page's title."""

    __slots__ = ("title",)


def own_text(node: Node) -> list[str]:
    """The non-blank texts of a node and its inline elements, as its skeleton takes them."""
    out: list[str] = []
    for x in node.content:
        if isinstance(x, str):
            if not x.isspace():
                out.append(x)
        elif x.tag in INLINE and not x.dropped():
            out += own_text(x)
    return out


def matched(node: Node, w: Wrapper | None) -> list[tuple[Node, Wrapper | None]]:
    """Child elements of a page's node (inline ones dissolved), each with its node of the wrapper."""
    out: list[tuple[Node, Wrapper | None]] = []
    children = w.children if w is not None else []
    at = 0

    def walk(n: Node) -> None:
        nonlocal at
        for x in n.content:
            if isinstance(x, str) or x.dropped() or x.tag in VOID or x.tag == "#break":
                continue
            if x.tag in INLINE:
                walk(x)
                continue
            # in order, as the expression has them; else wherever the key stands
            for i in (*range(at, len(children)), *range(at)):
                if children[i].key == x.key:
                    at = i
                    out.append((x, children[i]))
                    break
            else:
                out.append((x, None))

    walk(node)
    return out


def read(page: str | None, reader: Reader | None) -> str:
    """The article of one page, by its host's wrapper or, without the node there, by its own skeleton."""
    if not page:
        return ""
    root = parse(page)
    text = reader.read(root) if reader else None
    return text if text is not None else Reader(skeleton(root), 1).read(root) or ""


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


class Partial:
    """The partial wrapper of a host: its root and the digests of up to SUPPORT different pages."""

    def __init__(self, root: Wrapper, pages: set[str]):
        self.root, self.pages = root, pages

    def add(self, other: Partial, alike: bool = False) -> None:
        if alike:
            self.root.add_alike(other.root)
        else:
            self.root.add(other.root)
            self.root.children = align(self.root.children, other.root.children)
        self.pages = set(sorted(self.pages | other.pages)[:SUPPORT])

    def dump(self) -> str:
        return json.dumps([self.root.to_list(), sorted(self.pages)], separators=(",", ":"))

    @staticmethod
    def load(value: str) -> Partial:
        root, pages = json.loads(value)
        return Partial(Wrapper.from_list(root), set(pages))


def united(parts: list[Partial]) -> Partial:
    """Partial wrappers of one host as one: most pages first, so that the common structure leads."""
    parts = sorted(parts, key=lambda x: (-x.root.pages, x.root.structure()))
    for other in parts[1:]:
        parts[0].add(other)
    return parts[0]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers by host: pages of one structure are added up, other structures aligned."""
    held: dict[tuple[str, str], Partial] = {}

    def flush() -> pa.RecordBatch:
        hosts: dict[str, list[Partial]] = {}
        for (host, _), part in held.items():
            hosts.setdefault(host, []).append(part)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([united(x).dump() for x in hosts.values()], pa.string())], names=["host", "value"])

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not page:
                continue
            part = Partial(skeleton(parse(page)), {digest(page)})
            key = host_of(url), part.root.structure()
            if key in held:
                held[key].add(part, alike=True)
            else:
                held[key] = part
            if len(held) >= HELD:
                yield flush()
    if held:
        yield flush()


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (its expression) and value (the wrapper itself)."""
    parts = cut(pages.select("url", "html").mapInArrow(_survey, "host string, value string"))

    def unite(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "value": [united([Partial.load(x) for x in rows["value"]]).dump()]})

    some = parts.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(BUCKETS))).groupBy("host", "bucket").applyInPandas(unite, "host string, value string")
    whole = some.groupBy("host").applyInPandas(unite, "host string, value string")

    def express(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [expression(Partial.load(x).root.children) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), batch.column(1)], names=["host", "wrapper", "value"])

    return whole.mapInArrow(express, "host string, wrapper string, value string")


@lru_cache(256)
def reader_of(value: str) -> Reader:
    part = Partial.load(value)
    return Reader(part.root, len(part.pages))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    learned = cut(wrappers(pages))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    source = pages.select("page_id", "url", "html", host.alias("_host")).join(learned.select(F.col("host").alias("_host"), "value"), "_host", "left").select("page_id", "url", "html", "value")
    schema = StructType([source.schema["page_id"], source.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read(page, reader_of(value) if value else None) for page, value in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
