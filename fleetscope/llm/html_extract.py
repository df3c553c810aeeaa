"""HTML extraction by union-free wrappers.

Each host gets a wrapper from all of its pages: their token streams, as trees of elements, are aligned one after the other.
Elements that match are generalised, texts that differ become slots, elements that only one side has become optional, and
neighbours of one label become a repeated group. The wrapper says what is content: the article or main element whose slots
hold most, or, on hosts that mark none, all but the template, which is what stays constant from page to page. Parts that are
never content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) don't enter it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg object select option datalist canvas audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav header footer aside form button menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark parts which are no content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot adsbygoogle banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars aside footer masthead"
    " topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond"
    " response responses reply replies discussion pagination pager search searchform widget widgets skip hidden".split()
)
#: Words that may stand beside a marking word; any other word (``share-price``, ``hidden-gems``) takes the mark away.
BESIDE = frozenset(
    "site page main global top bottom left right inner outer primary secondary mobile desktop sticky fixed post posts article articles entry reader readers user users visitor list items item box block boxes bar links link"
    " buttons button icons icon wrapper wrap container section area panel slot unit zone content body form field input message msg text title header heading links group row col column grid card cards by g js the and to in up"
    " media bottombar policy alert dialog overlay google third party content more story stories".split()
)
P_CLOSERS = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[a-z]+")
SPACE, DIGITS = re.compile(r"\s+"), re.compile(r"\d+")


@dataclass(frozen=True)
class Token:
    """kind: open, close or text; name: the element with its class for open and close; content: False within a part that never is."""

    kind: str
    name: str
    text: str = ""
    path: tuple[str, ...] = ()
    content: bool = True
    block: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw else {}


def marked(word: str) -> bool:
    """Whether a class or id names a part that is no content: one of its words marks it, and the others go with that (``share-price`` and ``has-sidebar`` do not)."""
    parts = WORD.findall(word)
    if "header" in parts and len(parts) <= 2:
        return len(parts) == 1 or parts[0] in ("site", "page", "top", "main", "global")
    return any(p in MARKS for p in parts) and all(p in MARKS or p in BESIDE for p in parts)


def never_content(name: str, attributes: dict[str, str], stack: list[tuple[str, str, bool]]) -> bool:
    """Whether an element holds no content. A header within an article is the article's own if the page has none around it."""
    if name in NEVER:
        return not (name == "header" and any(s[0] in ("article", "main") for s in stack))
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if name in ("article", "main", "body", "html"):
        return False
    if any(k.startswith("data-ad") and k[7:8] in ("", "-", "s") for k in attributes):
        return True
    return any(marked(w) for k in ("class", "id") for w in attributes.get(k, "").lower().split())


def tokens(html: str) -> list[Token]:
    """The page as a token stream; every text knows its open elements. Unclosed and stray tags are put up with."""
    out: list[Token] = []
    stack: list[tuple[str, str, bool]] = []  # tag, label, content
    paths: list[tuple[str, ...]] = [()]  # the labels up to each depth; tokens of equal paths share one tuple
    known: dict[tuple[int, str], tuple[str, ...]] = {}
    at, n = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            out.append(Token("text", "", unescape(piece), paths[-1], not stack or stack[-1][2]))

    def close(to: int) -> None:
        while len(stack) > to:
            tag, label, content = stack.pop()
            paths.pop()
            out.append(Token("close", label, path=paths[-1], content=content, block=tag in BLOCKS))

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[1]:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[1].lower()
        if m[0][1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in ("svg", "math") and m[2].endswith("/"):
            continue
        if tag in RAW:  # its text is no markup; a missing end tag ends it with its parent, a script's or the like with the page, the head's at the body
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if tag == "head" and (body := re.compile(r"<body[\s>]", re.I).search(html, at)) and (not end or body.start() < end.start()):
                at = body.start()
            elif end:
                at = end.end()
            elif tag not in ("head", "select", "option", "object"):
                outer = [] if tag in ("script", "style", "textarea", "title") else [s[0] for s in reversed(stack)]
                ends = (re.compile(rf"</{re.escape(o)}\s*>", re.I).search(html, at) for o in outer)
                at = next((e.start() for e in ends if e), n)
            continue
        if tag in P_CLOSERS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in ("li", "dd", "dt", "tr", "td", "th"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or {stack[i][0], tag} == {"dd", "dt"} or tag == "tr" and stack[i][0] in ("td", "th"):
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "tr", "menu") and not (tag == "tr" and stack[i][0] == "tr"):
                    break
        attributes = _attributes(m[2])
        label = tag + "".join(f".{c}" for c in sorted(DIGITS.sub("", attributes.get("class", "")).lower().split())[:2])
        content = (not stack or stack[-1][2]) and not never_content(tag, attributes, stack)
        out.append(Token("open", label, path=paths[-1], content=content, block=tag in BLOCKS))
        if tag in VOID:
            continue
        stack.append((tag, label, content))
        key = (id(paths[-1]), label)
        paths.append(known[key] if key in known else known.setdefault(key, (*paths[-1], label)))
    close(0)
    return out


# Wrappers. A wrapper is a union-free regular expression over the elements of a host's pages, kept as a tree.


@dataclass(slots=True, eq=False)
class Node:
    """An element, or a run of elements of one label (``plus``), or a text (label ``#``).

    digest: of the whole subtree with its texts while that is the same on all pages that have it, else None; a text without
    digest is a slot. chars: of the texts, over all pages. pages: how many have it. maybe: not all have it. bag: the children
    are a repeated group of optional elements, one a tag.
    """

    label: str
    kids: list[Node]
    digest: int | None
    chars: int = 0
    pages: int = 1
    plus: bool = False
    maybe: bool = False
    bag: bool = False

    def packed(self) -> list:
        return [self.label, [k.packed() for k in self.kids], self.digest, self.chars, self.pages, self.plus, self.maybe, self.bag]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], [Node.unpacked(k) for k in x[1]], *x[2:])

    def pattern(self) -> str:
        """The expression as text: ``#`` a slot, ``=`` a text that all pages share, ``+`` and ``?`` as usual."""
        if self.label == "#":
            return ("#" if self.digest is None else "=") + "+" * self.plus + "?" * self.maybe
        inner = " ".join(k.pattern() for k in self.kids)
        return f"<{self.label}>({f'({inner})+' if self.bag else inner})" + "+" * self.plus + "?" * self.maybe


#: Elements that are nested deeper count to their ancestor of this depth; in longer lists of children runs of one label are one
#: repeated group, and lists that are still longer become bags.
DEEPEST, LONGEST = 200, 64


def _digest(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)))


def joined(a: Node, b: Node, pages: int, plus: bool = False) -> Node:
    """What generalises two nodes of one label; ``plus``: they stand side by side."""
    same = a.digest if a.digest == b.digest and not plus else None
    bag = a.bag or b.bag
    kids = _bag([*a.kids, *b.kids]) if bag else _bounded(align(a.kids, b.kids, plus))
    if len(kids) > LONGEST and not bag:
        kids, bag = _bag(kids), True
    return Node(a.label, kids, same, a.chars + b.chars, pages, a.plus or b.plus or plus, a.maybe or b.maybe, bag)


def _bounded(kids: list[Node]) -> list[Node]:
    """A longer list with its runs of one label as repeated groups."""
    if len(kids) <= LONGEST:
        return kids
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label:
            last = out.pop()
            k = joined(last, k, max(last.pages, k.pages), plus=True)
        out.append(k)
    return out


def _bag(kids: list[Node]) -> list[Node]:
    """One optional node for each tag, in order of first appearance: ``(a? b? c?)+``."""
    found: dict[str, Node] = {}
    for k in kids:
        tag = k.label.split(".")[0]
        k = Node(tag, k.kids, k.digest, k.chars, k.pages, k.plus, True, k.bag)
        found[tag] = joined(found[tag], k, max(found[tag].pages, k.pages), plus=True) if tag in found else k
    return list(found.values())


def best_match(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of places with one label, in order: as many as can be, those of equal digest counting twice; of several ways the one that matches earliest in a."""
    if [x.label for x in a] == [x.label for x in b]:
        return [(i, i) for i in range(len(a))]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, label, digest = table[i], table[i + 1], a[i].label, a[i].digest
        for j in range(len(b) - 1, -1, -1):
            best = below[j] if below[j] >= row[j + 1] else row[j + 1]
            if b[j].label == label:
                met = below[j + 1] + (2 if digest is not None and b[j].digest == digest else 1)
                best = met if met > best else best
            row[j] = best
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        met = table[i + 1][j + 1] + (2 if a[i].digest is not None and a[i].digest == b[j].digest else 1) if a[i].label == b[j].label else -1
        if met == table[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i][j + 1] == table[i][j]:
            j += 1
        else:
            i += 1
    return out


def align(a: list[Node], b: list[Node], within: bool = False) -> list[Node]:
    """Two lists of children as one: matched nodes are generalised; others become optional, and part of a repeated group beside one of their label that varies.

    ``within``: both stand on the same page, so page counts don't add up.
    """
    out: list[Node] = []

    def add(x: Node, new: bool) -> None:
        x.maybe = x.maybe or new
        last = out[-1] if out else None
        if last is not None and last.label == x.label and (new and (last.plus or last.digest is None or last.maybe) or last.maybe and x.plus):
            out.pop()
            maybe = last.maybe and x.maybe
            x = joined(last, x, max(last.pages, x.pages), plus=True)
            x.maybe = maybe
        out.append(x)

    i = j = 0
    for p, q in [*best_match(a, b), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            add(x, True)
        if p < len(a):
            add(joined(a[p], b[q], max(a[p].pages, b[q].pages) if within else a[p].pages + b[q].pages), False)
        i, j = p + 1, q + 1
    return out


class Page:
    """A page's content tokens as a tree, folded: which texts stand below which folded node."""

    def __init__(self, page: list[Token]) -> None:
        self.root = Node("", [], None)
        self.texts: dict[int, list[int]] = {}  # id of a node: places of its texts in the token list
        stack: list[tuple[Node, str]] = [(self.root, "")]
        self.texts[id(self.root)] = []
        self.kept: list[Node] = [self.root]
        deep = 0
        for i, t in enumerate(page):
            if not t.content:
                continue
            if t.kind == "text":
                said = SPACE.sub(" ", t.text).strip()
                if said:
                    self._add(stack[-1][0], Node("#", [], _digest("#", said), len(said)), [i])
            elif t.kind == "open":
                if t.name.split(".")[0] in VOID:
                    continue
                if len(stack) > DEEPEST:
                    deep += 1
                    continue
                node = Node(t.name, [], None)
                self.texts[id(node)] = []
                self.kept.append(node)
                stack.append((node, t.name))
            elif deep:
                deep -= 1
            elif len(stack) > 1:
                self._close(stack)
        while len(stack) > 1:
            self._close(stack)
        self._finish(self.root)

    def _add(self, parent: Node, node: Node, texts: list[int]) -> None:
        """Append a finished child; neighbouring texts are one."""
        if node.label == "#" and parent.kids and parent.kids[-1].label == "#":
            self._take_up(parent.kids, node, texts)
        else:
            parent.kids.append(node)
            self.texts[id(node)] = texts
            self.kept.append(node)  # ids stay unique while the nodes live

    def _take_up(self, kids: list[Node], node: Node, texts: list[int]) -> None:
        """Make the last of ``kids`` a group with a neighbour of its label."""
        last = kids.pop()
        group = joined(last, node, 1, plus=True)
        group.digest = _digest(last.digest, node.digest)
        kids.append(group)
        self.texts[id(group)] = self.texts[id(last)] + texts
        self.kept.append(group)

    def _finish(self, node: Node) -> None:
        """The digest of all below, and the bounds on the list of children."""
        node.digest = _digest(node.label, *(k.digest for k in node.kids))
        node.chars = sum(k.chars for k in node.kids)
        self.texts[id(node)] = [x for k in node.kids for x in self.texts[id(k)]]
        if len(node.kids) > LONGEST:
            below: list[Node] = []
            for k in node.kids:
                if below and below[-1].label == k.label:
                    self._take_up(below, k, self.texts[id(k)])
                else:
                    below.append(k)
            node.kids = below
        if len(node.kids) > LONGEST:
            below = node.kids
            node.kids, node.bag = _bag(below), True
            self.kept += node.kids
            for k in node.kids:
                self.texts[id(k)] = [x for b in below if b.label.split(".")[0] == k.label for x in self.texts[id(b)]]

    def _close(self, stack: list[tuple[Node, str]]) -> None:
        node, _ = stack.pop()
        self._finish(node)
        if node.kids:
            self._add(stack[-1][0], node, self.texts[id(node)])

    def texts_of(self, node: Node) -> list[int]:
        return self.texts[id(node)]


def infer(pages: list[str]) -> Node:
    """A union-free wrapper that fits all of the pages, aligned one after the other."""
    out: Node | None = None
    for html in pages:
        page = Page(tokens(html)).root
        out = page if out is None else joined(out, page, out.pages + page.pages)
    return out or Node("", [], None)


#: A subtree without slots is the host's template if it is on so many pages and on so large a share of them.
LEAST_PAGES, SHARE = 3, 0.8


@dataclass(frozen=True)
class Decision:
    """What a host's wrapper says: the element that holds the main text, and the template's subtrees (keys of path and digest)."""

    element: str | None = None
    template: frozenset[int] = frozenset()


def _slots(node: Node, path: tuple[str, ...], found: Counter[str]) -> int:
    """Characters in slots below the node; those of article and main elements are put down by label."""
    if node.label == "#":
        return node.chars if node.digest is None else 0
    total = sum(_slots(k, (*path, node.label), found) for k in node.kids)
    tag = node.label.split(".")[0]
    if total and tag in ("article", "main") and not any(p.split(".")[0] == tag for p in path):
        found[node.label] += total
    return total


def _largest(held: Counter[str]) -> str | None:
    """The label of the article that holds most, or of the main element if that holds over twice as much."""
    best = {tag: max(((n, label) for label, n in held.items() if label.split(".")[0] == tag), default=(0, None)) for tag in ("article", "main")}
    return best["main" if best["main"][0] > 2 * best["article"][0] else "article"][1]


def decide(wrapper: Node) -> Decision:
    """The article or main element whose slots hold most, and what is constant outside of those on most of the host's pages."""
    found: Counter[str] = Counter()
    _slots(wrapper, (), found)
    element = _largest(found)
    template: set[int] = set()
    least = max(LEAST_PAGES, SHARE * wrapper.pages)

    def walk(node: Node, path: int) -> None:
        for k in node.kids:
            if k.label.split(".")[0] in ("article", "main"):
                continue
            if k.digest is not None:
                if k.pages >= least:
                    template.add(_digest(path, k.digest))
            elif not k.plus:
                walk(k, _digest(path, k.label))

    if wrapper.digest is None:
        walk(wrapper, 0)
    return Decision(element, frozenset(template))


def _template_texts(page: list[Token], template: frozenset[int]) -> set[int]:
    """Places of the texts that stand in a subtree of the template."""
    if not template:
        return set()
    tree = Page(page)
    out: set[int] = set()

    def walk(node: Node, path: int) -> None:
        for k in node.kids:
            if k.label.split(".")[0] in ("article", "main"):
                continue
            if _digest(path, k.digest) in template:
                out.update(tree.texts_of(k))
            elif k.label != "#" and not k.plus:
                walk(k, _digest(path, k.label))

    walk(tree.root, 0)
    return out


def _element(page: list[Token], decision: Decision) -> str | None:
    """The label of the elements that hold the page's main text: what the wrapper names if the page has it, else the article or main that holds most."""
    held: Counter[str] = Counter()
    by_path: dict[int, set[str]] = {}
    for t in page:
        if t.kind == "text" and t.content and t.text.strip():
            if id(t.path) not in by_path:
                by_path[id(t.path)] = {x for x in t.path if x.split(".")[0] in ("article", "main")}
            for label in by_path[id(t.path)]:
                held[label] += len(t.text)
    return decision.element if decision.element in held else _largest(held)


def main_text(html: str | None, decision: Decision = Decision()) -> str:
    """The blocks of the main text: those of the host's content element, else of the largest article or main, else of the whole page without its host's template."""
    page = tokens(html or "")
    element = _element(page, decision)
    dropped = _template_texts(page, decision.template) if element is None else set()
    blocks: list[str] = []
    part: list[str] = []
    inside: dict[int, bool] = {}  # by path, which tokens share

    def taken(path: tuple[str, ...]) -> bool:
        if element is None:
            return True
        if id(path) not in inside:
            inside[id(path)] = element in path
        return inside[id(path)]

    def end() -> None:
        line = SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if line:
            blocks.append(line)

    for i, t in enumerate(page):
        if t.kind == "text":
            if t.content and taken(t.path) and i not in dropped:
                part.append(t.text)
        elif t.block:
            end()
        elif t.kind == "open" and t.name.split(".")[0] in ("br", "img"):
            part.append(" ")
    end()
    return "\n".join(blocks)


def host_column() -> str:
    return r"lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1))"


_PARTS = "host string, part long, wrapper binary"


def _pack(wrapper: Node) -> bytes:
    return zlib.compress(json.dumps(wrapper.packed()).encode(), 1)


def _unpack(data: bytes) -> Node:
    return Node.unpacked(json.loads(zlib.decompress(data)))


#: Partial wrappers of a host that one task aligns; more are aligned over several rounds.
FAN_IN = 64


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper): one for each host, from all of its pages.

    Each task aligns its pages host by host; the partial wrappers of a host are aligned FAN_IN at a time until one is left, so
    a host with a third of all pages takes a round or two more, not one long task.
    """

    def partial(batches):
        for b in batches:
            held: dict[str, Node] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(tokens(html)).root
                held[host] = joined(held[host], page, held[host].pages + 1) if host in held else page
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(range(len(held)), pa.int64()), pa.array(map(_pack, held.values()), pa.binary())], names=["host", "part", "wrapper"])

    def merged(batches):
        for b in batches:
            said = []
            for part in b.column(2).to_pylist():
                out = None
                for w in sorted(part):  # any order fits; this one repeats
                    node = _unpack(w)
                    out = node if out is None else joined(out, node, out.pages + node.pages)
                said.append(_pack(out))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.binary())], names=["host", "part", "wrapper"])

    cur = scratch.cut(map_arrow(pages.where("html IS NOT NULL").select("host", "html"), partial, _PARTS).select("host", F.monotonically_increasing_id().alias("part"), "wrapper"))
    while True:
        most = cur.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return cur.select("host", "wrapper")
        bucket = F.pmod(F.xxhash64("part"), F.lit(-(-most // FAN_IN)))
        grouped = cur.groupBy("host", bucket.alias("part")).agg(F.collect_list("wrapper").alias("wrappers"))
        nxt = scratch.cut(map_arrow(grouped, merged, _PARTS))
        scratch.drop(cur)
        cur = nxt


def decisions(learnt: DataFrame) -> DataFrame:
    """(host, element, template: array<long>) of (host, wrapper)."""

    def run(batches):
        for b in batches:
            found = [decide(_unpack(w)) for w in b.column(1).to_pylist()]
            template = [np.array(sorted(d.template), np.uint64).view(np.int64) for d in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d.element for d in found], pa.string()), pa.array(template, pa.list_(pa.int64()))], names=["host", "element", "template"])

    return map_arrow(learnt, run, "host string, element string, template array<long>")


#: Hosts whose decisions are broadcast at most; beyond, those of the hosts with most pages are, and the rest is joined.
MOST_HOSTS = 4096


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, text, n_chars) of each row.

    Null or empty html has an empty text. A null url counts as one host. A host's wrapper is that of all its pages, in whatever
    order they are aligned; of content elements that hold equally much the one of the larger label is taken. Pages that share
    no template (and hosts of one or two pages) have no constant subtree that counts, so nothing is cut for it. Repeated rows
    give repeated results; other columns are not read.
    """
    rows = pages.selectExpr("page_id", "url", "html", f"{host_column()} AS host")
    learnt = scratch.cut(decisions(wrappers(rows, scratch)))
    if learnt.count() <= MOST_HOSTS:
        joined = rows.join(F.broadcast(learnt), "host", "left")
    else:
        counts = rows.groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        hot = scratch.cut(learnt.join(hot_keys(counts, scratch).select(F.col("key").alias("host"), F.lit(True).alias("hot")), "host"))
        marked = rows.join(F.broadcast(hot), "host", "left")
        rest = marked.where("hot IS NULL").select("page_id", "url", "html", "host").join(learnt, "host", "left")
        joined = marked.where("hot").drop("hot").unionByName(rest)

    def run(batches):
        for b in batches:
            known: dict[tuple, Decision] = {}
            texts = []
            for h, e, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                key = (e, tuple(t or ()))
                if key not in known:
                    known[key] = Decision(e, frozenset(x % 2**64 for x in key[1]))
                texts.append(main_text(h, known[key]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(joined.select("page_id", "url", "html", "element", "template"), run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark))
