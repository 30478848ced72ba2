"""HTML extraction by a site style tree.

The DOM trees of all pages of a host are merged. An element of the tree has presentations, the sequences
of its children's tags that pages show (a run of equal tags counts once), and each presentation has its
own children, by place: run, and number in the run or last of it. So an element stands for what
pages show at one place, and collects the presentations and the own texts seen there. Its importance is the
larger of the entropy of its presentations and the spread of its texts: what looks the same and says the
same on most pages of a host has neither. From each page go the branches in which no element is
important and no text is the page's own.

Copies of one article must not make its text look like noise: what only pages with the same text
throughout show counts as seen on one page. And entropy says little about a place that few pages share
(`LEAST_PAGES`, and `LEAST_SHARE` of the pages that show the element around it), so the declared role of an
element comes first: what is declared as menu, footer, form, advert, comment and so on always goes, and a
page with an article or main gives only that, else its body. In both the tree then removes its branches,
but never the article itself, and nothing from an article that would lose half of its text: that is one
article at several addresses. Elements without content are not branches, and inline elements in a line
of text go only with their line.

Counting is pre-aggregated in each task, and the tree is made by grouping (host, element), so a host with
a third of all pages is not gathered anywhere. The noise lists are broadcast after a check of their
size, so pages stay where they are; larger lists are joined, where Spark splits a host that is too large.

Defined cases: null or empty html gives an empty text; broken markup is read as far as it goes;
equal pages give equal texts; a null url is a host of its own; extra columns are kept when named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import WHOLE_BATCH, map_batches, stored

#: An element is noise when its importance is lower and so many pages show something at its place.
LEAST_IMPORTANCE = 0.25
LEAST_PAGES = 4
LEAST_SHARE = 0.25
#: Noise lists up to this size are broadcast.
LIST_BYTES = 32_000_000

# HTML's elements without content, inline elements, and those that end an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Tags that a start tag of the kind ends, and those beyond which it ends none.
_ENDINGS = {
    "p": (("p",), ("article", "body", "div", "section", "td", "li", "blockquote")),
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_RULES = tuple(_ENDINGS)
_KIND = {"dd": "dt", "th": "td"} | {r: r for r in _RULES if r != "p"}
#: For each tag, the kinds of ending that meet it on their way up.
_MET = {tag: tuple(i for i, r in enumerate(_RULES) if tag in _ENDINGS[r][0] + _ENDINGS[r][1])
        for r in _RULES for tag in _ENDINGS[r][0] + _ENDINGS[r][1]}

# Roles by tag, ARIA role, and words of class and id.
MAIN = frozenset(("article", "main"))
FRAME = frozenset(("html", "body"))
NOISE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe object head button select textarea"
    " dialog svg canvas input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
#: Whole names; a compound is one too when it is made of these words and of those in ROLE_PARTS only.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment"
    " comments disqus respond replies cookie cookies consent newsletter subscribe"
    " share sharing related popup modal toolbar pagination pager widget".split())
ROLE_PARTS = frozenset(
    "site page main top bottom left right side primary secondary global reader readers user users link"
    " links list bar box block area wrap wrapper container inner outer section button buttons icon icons"
    " item items post posts articles form text header head notice social media".split())
#: Names that tell no role by themselves: the style tree decides.
DOUBTFUL = frozenset("notice social".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Ids that stay noise under a heading of the same name.
COMMENTS = frozenset("comment comments disqus respond replies".split())
#: Elements that never hold readable text.
UNREAD = frozenset(
    "script style noscript template iframe object head button select textarea svg canvas input".split())


def noise_name(name: str) -> bool:
    """Whether a class or id names a noise role as a whole: cookie-banner, but not market-share."""
    parts = [w for w in re.split("[-_]+", name) if w]
    return name == "side-bar" or (not NOISE_WORDS.isdisjoint(parts)
                                  and all(w in NOISE_WORDS or w in ROLE_PARTS for w in parts))


class Node:
    """An element: tag, place in the style tree, children (nodes and strings), role."""

    __slots__ = ("children", "gone", "inside", "key", "looks", "named", "near", "noise", "parent", "said", "sign",
                 "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: list[tuple[str, str | None]]):
        self.tag, self.parent, self.children, sign, self.gone = tag, parent, [], tag, False
        # For each kind of ending, the nearest element from here up that it meets.
        self.near = parent.near if parent else [None] * len(_RULES)
        if tag in _MET:
            self.near = self.near.copy()
            for i in _MET[tag]:
                self.near[i] = self
        self.inside = parent is not None and (parent.inside or parent.tag in MAIN)
        self.noise = tag in NOISE_TAGS or (tag == "header" and not self.inside)
        self.named = None  # the id, where nothing else makes the element noise; "" for a class
        if attrs:
            kept = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role")}
            if kept:
                named = sorted(kept.get("class", "").split())
                sign += "".join(f".{w}" for w in named)
                ids = [] if tag in HEADINGS else kept.get("id", "").split()
                self.noise = self.noise or kept.get("role") in NOISE_ROLES
                if not self.noise and tag not in FRAME:
                    def role(names):
                        if tag in MAIN:
                            return not NOISE_WORDS.isdisjoint(names)
                        return any(map(noise_name, names)) or (
                            not self.inside and any("header" in re.split("[-_]+", n) and noise_name(
                                n.replace("header", "banner")) for n in names))
                    if role(named):
                        parts = {w for n in named for w in re.split("[-_]+", n)}
                        self.noise, self.named = True, None if parts & COMMENTS else ""
                    elif role(ids):
                        self.noise, self.named = True, kept["id"].strip()
        self.sign = sign


class _Builder(HTMLParser):
    """Builds the tree in linear time: no walk up passes an element twice without closing it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", None, [])
        self.named: list[Node] = []
        self.open: dict[str, list[Node]] = {}
        self.closing, self.open_comments, self.lasts = False, set(), {}

    def close(self):
        self.closing = True
        super().close()

    def updatepos(self, i, j):
        return j  # line numbers are not asked for

    # What has no end further on is found to have none once, not at each of its beginnings.

    def _ends(self, i, sign=">"):
        """Whether the sign stands anywhere behind place i."""
        known = len(self.rawdata), sign
        if known not in self.lasts:
            self.lasts[known] = self.rawdata.rfind(sign)
        return self.lasts[known] >= i

    def check_for_whole_start_tag(self, i):
        return super().check_for_whole_start_tag(i) if self._ends(i) else -1

    def parse_pi(self, i):
        return super().parse_pi(i) if self._ends(i) else -1

    def parse_comment(self, i, report=1):
        """An open comment takes the rest of the page."""
        if len(self.rawdata) not in self.open_comments:
            end = super().parse_comment(i, report)
            if end >= 0:
                return end
            self.open_comments.add(len(self.rawdata))
        return len(self.rawdata) if self.closing else -1

    def parse_html_declaration(self, i):
        section = self.rawdata.startswith("<![", i)
        return super().parse_html_declaration(i) if self._ends(i) and (
            not section or self._ends(i, "]>")) else -1

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end("p")
        if tag in _KIND:
            self._end(_KIND[tag])
        node = Node(tag, self.at, attrs)
        self.at.children.append(node)
        if node.noise and (node.named is not None or tag == "form"):
            self.named.append(node)
        if tag not in VOID:
            self.at = node
            self.open.setdefault(tag, []).append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:  # a slash means nothing in HTML, except in foreign content
            if tag in ("script", "style"):
                self.clear_cdata_mode()
            self._leave(self.at)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self._leave(self.open[tag][-1])

    def handle_data(self, data):
        self.at.children.append(data)

    def _end(self, kind):
        node = self.at.near[_RULES.index(kind)]
        if node is not None and node.tag in _ENDINGS[kind][0]:
            self._leave(node)

    def _leave(self, node):
        while True:
            last, self.at = self.at, self.at.parent
            self.open[last.tag].pop()
            if last is node:
                return


def parse(html: str | None) -> Node:
    """The DOM tree of a page, as far as it can be read."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    if builder.named:
        _reconsider(builder)
    return builder.root


def place(root: Node) -> None:
    """Sets looks, own text and key of every element: its key is made of that of its parent, the parent's
    looks and its place in them."""
    root.key, stack = 0, [root]
    while stack:
        node = stack.pop()
        tags: list[str] = []
        children: list[tuple[Node, int]] = []  # and number in its run
        own = []
        for child in node.children:
            if isinstance(child, str):
                own.append(child)
            elif tags and tags[-1] == child.tag:
                children.append((child, children[-1][1] + 1))
            else:
                tags.append(child.tag)
                children.append((child, 0))
        node.looks = _number(" ".join(tags))
        text = " ".join(" ".join(own).split()) if own else ""
        node.said = xxhash.xxh64_intdigest(text) if text else 0
        run = -1
        for at, (child, i) in enumerate(children):
            run += i == 0
            last = 0 < i and (at + 1 == len(children) or children[at + 1][1] == 0)
            # Hashes of tuples of numbers are the same in every process.
            child.key = hash((node.key, node.looks, run, -1 if last else i, _number(child.sign))) & _MASK
            stack.append(child)


_MASK = (1 << 63) - 1


@lru_cache(1 << 16)
def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def _read(node: Node, links: bool = False) -> tuple[int, int]:
    """The characters of readable text in an element, and how many of them are in links."""
    total, linked, stack = 0, 0, [(node, links)]
    while stack:
        at, link = stack.pop()
        if isinstance(at, str):
            n = len("".join(at.split()))
            total, linked = total + n, linked + n * link
        elif at.tag not in UNREAD:
            stack.extend((c, link or at.tag == "a") for c in at.children)
    return total, linked


def _reconsider(builder: _Builder) -> None:
    """Noise that is none after all: sections whose id only repeats their heading, and a form or a
    named element outside articles that holds most of the page's text, and not as links."""
    for node in builder.named:
        if node.named and not COMMENTS.intersection(re.split("[-_]+", node.named)):
            head = next((c for c in node.children if isinstance(c, Node) and c.tag in HEADINGS), None)
            if head is not None:
                own = " ".join(c for c in head.children if isinstance(c, str)).lower()
                if re.findall(r"\w+", own) == re.findall(r"[^\W_]+", node.named):
                    node.noise = False
    whole = None
    for node in builder.named:
        if node.noise and (node.tag == "form" or not node.inside) and not (
                node.named and COMMENTS.intersection(re.split("[-_]+", node.named))):
            whole = _read(builder.root)[0] if whole is None else whole
            own, linked = _read(node)
            if 2 * own > whole and 2 * linked < own:
                node.noise = False


def styles(root: Node) -> Iterator[Node]:
    """Every element that is not below a declared noise element, which goes whatever it holds."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.noise:
            yield node
            stack.extend(c for c in node.children if isinstance(c, Node))


@dataclass(frozen=True)
class Noise:
    """The elements of a host that are noise, and the texts that several pages show in them."""

    nodes: frozenset[int]
    said: frozenset[tuple[int, int]]


def mark(root: Node, noise: Noise) -> None:
    """Sets gone on the branches that go: all elements are noise, and no text is the page's own."""
    place(root)
    for node in reversed(list(styles(root))):
        node.gone = (node.key in noise.nodes and (not node.said or (node.key, node.said) in noise.said)
                     and all(c.noise or c.gone for c in node.children if isinstance(c, Node)))


def main_text(root: Node, low: Noise | None = None) -> str:
    """The blocks of the main text, in page order."""
    # The outermost articles; under elements declared as noise only where there is no other.
    tops, hidden, stack = [], [], [(root, False)]
    while stack:
        node, under = stack.pop()
        under = under or node.noise
        if node.tag in MAIN and not node.noise:
            (hidden if under else tops).append(node)
        elif node.tag not in NOISE_TAGS or not node.noise:
            stack.extend((c, under) for c in reversed(node.children) if isinstance(c, Node))
    tops = tops or hidden
    blocks = _blocks(tops or [root], False)
    if low and low.said:
        mark(root, low)
        left = _blocks(tops or [root], True)
        # An article that loses half of its text is one that stands at several addresses.
        if left and (not tops or 2 * sum(map(len, left)) > sum(map(len, blocks))):
            blocks = left
    return "\n\n".join(blocks)


def _blocks(tops: list[Node], cut: bool) -> list[str]:
    """The blocks of text of the elements, without noise and, if cut, without the branches that go."""
    blocks, run = [], []

    def end():
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    for top in tops:
        stack = [(top, False)]
        while stack:
            node, over = stack.pop()
            if isinstance(node, str):
                run.append(node)
            elif over:
                end()
            elif node is not top and (node.noise or (
                    cut and node.gone and node.tag not in VOID
                    and not (node.tag in INLINE and node.parent.said))):  # inline in a line of text
                end()
            else:
                inline = node.tag in INLINE
                if node.tag in ("br", "img", "wbr"):
                    run.append(" " if node.tag == "br" else "")
                if not inline:
                    end()
                    stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))
        end()
    return blocks


def _unsigned(x: int) -> int:
    return x % (1 << 64)


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)", 1)),
                      F.lit(""))


def site_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Stored rows host, node, parent, kind (0 looks, 1 text), value, n: what is seen at each element of a
    host's style tree on n pages; value is null for all that one page alone (or copies of one) shows, n
    then counts such pages."""
    narrow = pages.select(_host(url).alias("h"), F.col(html).cast("string").alias("t"))

    def count(batch):
        seen: dict[tuple, list[int]] = {}
        for host, t in zip(batch["h"].to_pylist(), batch["t"].to_pylist(), strict=True):
            root = parse(t)
            place(root)
            nodes = list(styles(root))
            page = xxhash.xxh64_intdigest(np.array([n.said for n in nodes], np.uint64).tobytes()) >> 1
            for node in nodes:
                parent = node.parent.key if node.parent else 0
                for kind, value in ((0, node.looks), (1, node.said)):
                    if kind == 0 or value:
                        own = seen.setdefault((host, node.key, parent, kind, value), [0, page, page])
                        own[0] += 1
                        own[1], own[2] = min(own[1], page), max(own[2], page)
        hosts, nodes, parents, kinds, values = zip(*seen, strict=True)
        n, low, high = zip(*seen.values(), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()),
             *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, parents, values)),
             pa.array(kinds, pa.int32()), *(pa.array(x, pa.int64()) for x in (n, low, high))],
            ["host", "node", "parent", "value", "kind", "n", "low", "high"])

    rows = map_batches(narrow, count, "host string, node bigint, parent bigint, value bigint, kind int, n bigint,"
                                      " low bigint, high bigint", WHOLE_BATCH)
    keys = ["host", "node", "parent", "kind"]
    things = rows.groupBy(*keys, "value").agg(F.sum("n").alias("n"), (F.min("low") < F.max("high")).alias("many"))
    shared = F.when(F.col("many") | (F.col("kind") == 0) & (F.col("n") > 1), F.col("value")).alias("value")
    return stored(things.groupBy(*keys, shared).agg(F.sum("n").alias("n")), "style-tree")


def importance(tree: DataFrame) -> DataFrame:
    """host, node, parent, n_pages, importance of every element of the style trees."""
    looks, said, n = F.col("kind") == 0, F.col("kind") == 1, F.col("n")
    own = F.when(F.col("value").isNotNull(), n * F.log("n")).otherwise(0.0)
    totals = tree.groupBy("host", "node", "parent").agg(
        F.sum(F.when(looks, n)).alias("m"), F.sum(F.when(looks, own)).alias("s"),
        F.sum(F.when(said, n)).alias("mt"), F.sum(F.when(said, own)).alias("st"))
    # The entropy of the looks in base m (their number), and one less the mean commonness of a
    # text, which is log_m n for one that n of m show. Seen once means important.
    return totals.select(
        "host", "node", "parent", F.col("m").alias("n_pages"), F.greatest(
            F.when(F.col("m") > 1, 1 - F.col("s") / F.col("m") / F.log("m")).otherwise(1.0),
            F.when(F.col("mt") > 1, 1 - F.col("st") / F.col("mt") / F.log("mt"))
            .when(F.col("mt") == 1, 1.0).otherwise(0.0)).alias("importance"))


def noise_lists(tree: DataFrame, least: float, least_pages: int, least_share: float = LEAST_SHARE) -> DataFrame:
    """Stored rows host, nodes, said: the elements of low importance, and what several pages say there;
    a host where that is nothing has no row, as no text would go."""
    every = importance(tree)
    around = every.select("host", F.col("node").alias("parent"), F.col("n_pages").alias("around"))
    low = every.where((F.col("importance") < least) & (F.col("n_pages") >= least_pages)).join(
        around, ["host", "parent"], "left").where(
        F.col("around").isNull() | (F.col("n_pages") >= least_share * F.col("around")))
    texts = tree.where("kind = 1 AND value IS NOT NULL").select("host", "node", "value")
    found = low.select("host", "node").join(texts, ["host", "node"], "left").groupBy("host").agg(
        F.collect_set("node").alias("nodes"),
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("node", "value"))).alias("said"))
    return stored(found.where(F.size("said") > 0), "noise-lists")


def extract(pages: DataFrame, keep: Sequence[str], url: str = "url", html: str = "html",
            least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES,
            list_bytes: int = LIST_BYTES) -> DataFrame:
    """The columns in keep, text (main text, empty if none) and n_chars (its code points)."""
    lists = noise_lists(site_tree(pages, url, html), least, least_pages)
    size = lists.agg(F.sum(F.octet_length("host") + 64 + 8 * F.size("nodes") + 32 * F.size("said"))).first()[0]
    names = [f"k{i}" for i in range(len(keep))]
    cols = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    narrow = pages.select(*cols, _host(url).alias("host"), F.col(html).cast("string").alias("t"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    lists = F.broadcast(lists) if (size or 0) <= list_bytes else lists
    joined = narrow.join(lists, "host", "left").select(*names, "host", "t", "nodes", "said")

    def work(batch):
        known: dict[str, Noise | None] = {}
        texts = []
        for i, (host, t) in enumerate(zip(batch["host"].to_pylist(), batch["t"].to_pylist(), strict=True)):
            if host not in known:
                nodes, said = batch["nodes"][i].as_py(), batch["said"][i].as_py()
                known[host] = nodes and Noise(
                    frozenset(_unsigned(x) for x in nodes),
                    frozenset((_unsigned(x["node"]), _unsigned(x["value"])) for x in said))
            texts.append(main_text(parse(t), known[host]))
        return pa.RecordBatch.from_arrays(
            [*(batch[n] for n in names), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "text string, n_chars bigint"])
    done = map_batches(joined, work, schema)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text", "n_chars")
