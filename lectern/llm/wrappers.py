"""HTML extraction by wrapper induction: pages of a host are aligned with a template, whose slots tell content from frame.

Every page is read to a tree of blocks. Runs of equal siblings (paragraphs, list items, rows) are one node; other siblings
of one label are told apart by their number. The outlines of all pages vote by host: nodes that at least half of a host's
pages have are its template. Simple tree matching aligns every page with the template, and each template node becomes a
slot: its texts on the host's pages are either all the same (constant: template) or vary (content or furniture). The slots
also say where the content is: from the page down to the node that holds most of the varying text outside links. Tags and
names of elements only break ties: where a host has too few different pages, or no slot holds most, and for furniture
inside the content, such as reader comments, which varies like content does.

All counts are partial aggregates over (host, node), so a host with a third of all pages is never gathered.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle

#: Different pages of a host (told apart by their longest blocks) that must agree before a slot counts as constant.
LEAST_PAGES = 4
#: Bytes of all wrappers up to which they are broadcast together; beyond it only those of hosts with a HOT_HOSTS-th of all
#: pages are, of which there can be HOT_HOSTS at most, and other pages are shuffled by host.
BROADCAST_BYTES = 16_000_000
HOT_HOSTS = 1_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and elements that show no text of an article.
_RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
_SILENT = frozenset("template object svg canvas select button audio video".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text: inside an article they are its own even if all pages of a host have the same ones.
_TEXTS = _HEADINGS | frozenset("#text p blockquote pre ul ol li dl dt dd table caption thead tbody tfoot tr th td figure figcaption".split())
#: Siblings of these tags that follow each other are one node of an outline, however many they are.
_RUNS = frozenset("p li dt dd tr td th tbody hr blockquote pre #text".split())
#: A whole article may be in one of these without further blocks.
_BOXES = frozenset("div section article main td center body details figure fieldset".split())
#: An end of these is implied by a start of those.
_ENDS_P = _BLOCKS - {"body", "html", "caption", "legend", "summary", "figcaption", "tbody", "thead", "tfoot", "tr", "td", "th"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Names of furniture. A class or id counts if all its parts are names or places; the second kind only if the element
#: holds links or labels rather than sentences.
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement"
    " sponsor sponsored promo promos banner cookie cookies consent notice notices alert popup modal newsletter subscribe login"
    " signup comment comments disqus hidden".split()
)
_WEAK_NAMES = frozenset("share sharing social related recommended recommendations search toolbar widget replies reply discussion skip tags pagination pager".split())
_PLACES = frozenset(
    "box bar list section block container wrapper area top bottom left right site page global primary secondary inner item items"
    " link links panel slot unit row col body form thread user reader post sr only main bottom mobile desktop buttons button".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

_TOKEN = re.compile(
    r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|[!?/][^>]*+>?)"
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SENTENCE = re.compile(r"[.!?…。！？]")


# --- Pages as trees of blocks --------------------------------------------------------------------------------------


class Linked(str):
    """Text inside a link."""


class Node:
    """A block: tag, label (tag with class and id), and in page order its blocks and the text between them."""

    __slots__ = ("tag", "label", "parent", "items", "odd", "weak", "silent", "drop")

    def __init__(self, tag: str, label: str, parent: Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.items: list[Node | str] = []
        self.odd = self.weak = self.silent = self.drop = False


def _named(names: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture, surely or perhaps."""
    odd = weak = False
    for token in names.split():
        parts = [x for x in re.split(r"[-_0-9]+|(?<=[a-z])(?=[A-Z])", token) if x]
        low = [x.lower() for x in parts]
        if low and all(x in _NAMES or x in _WEAK_NAMES or x in _PLACES for x in low):
            odd |= any(x in _NAMES for x in low)
            weak |= any(x in _WEAK_NAMES for x in low)
    return odd, weak


def _opened(tag: str, attributes: str, at: Node) -> Node | None:
    """The node that a start tag opens; None for one that is only a mark inside a block."""
    given: dict[str, str] = {}
    if attributes and not attributes.isspace():
        for k, a, b, c in _ATTRIBUTE.findall(attributes):
            given.setdefault(k.lower(), a or b or c)
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "none" in given.get("style", "") and bool(re.search(r"display\s*:\s*none", given["style"]))
    if tag not in _BLOCKS and tag not in _SILENT and not hidden:
        return None
    names = " ".join(filter(None, (given.get("class"), given.get("id"))))
    node = Node(tag, tag + "".join(f".{re.sub(r'[0-9]+', '0', x)}" for x in names.split()[:3]) if names else tag, at)
    node.silent = hidden or tag in _SILENT
    if tag not in ("article", "main", "body", "html"):
        odd, weak = _named(names) if names else (False, False)
        up: Node | None = at
        while tag == "header" and up is not None and up.tag not in ("article", "main"):
            up = up.parent
        own = tag in _FURNITURE and not (tag == "header" and up is not None)
        node.odd = odd or own or given.get("role") in _ROLES
        node.weak = weak
    return node


def read_page(html: str | None) -> Node:
    """The tree of a page; never fails on broken markup. A cut-off tag ends the page; an open comment holds the rest."""
    html = (html or "").replace("\x00", "")
    root = at = Node("#page", "#page", None)
    link: Node | None = None  # the block in which a link was opened
    pos, end = 0, len(html)
    while pos < end:
        i = html.find("<", pos)
        if i != pos:
            text = html[pos : i if i >= 0 else end]
            text = entities.unescape(text) if "&" in text else text
            at.items.append(Linked(text) if link is not None else text)
            if i < 0:
                break
        m = _TOKEN.match(html, i)
        if m is None:
            if i + 1 < end and (html[i + 1].isascii() and html[i + 1].isalpha()):
                break
            at.items.append("<")
            pos = i + 1
            continue
        pos = m.end()
        comment, closing, tag, attributes = m.groups()
        if comment:
            if html.startswith((">", "->"), pos):
                pos = html.index(">", pos) + 1
            else:
                over = re.compile(r"--!?>").search(html, pos)
                pos = over.end() if over else end
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                link = None
            elif tag in _BLOCKS or tag in _SILENT or at.tag == tag:
                node: Node | None = at
                while node is not None and node.tag != tag:
                    node = node.parent
                if node is not None and node.parent is not None:
                    if link is not None and tag in _BLOCKS:
                        link = None
                    at = node.parent
            continue
        if tag == "br":
            at.items.append(" ")
            continue
        if tag in _RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            pos = over.end() if over else end
            continue
        if tag in _VOID and tag != "hr":
            continue
        if tag == "a":
            link = at
        if tag in _ENDS_P:
            at = _implied(at, {"p"}, _BLOCKS - {"p"})
        if tag in _SIBLINGS:
            at = _implied(at, *_SIBLINGS[tag])
        node = _opened(tag, attributes, at)
        if node is not None:
            at.items.append(node)
            if tag != "hr":
                at = node
    return root


def _implied(at: Node, these: set[str], within: set[str] | frozenset[str]) -> Node:
    """Where an element goes whose start ends the open ones of these."""
    node: Node | None = at
    found = None
    while node is not None and node.tag not in within:
        if node.tag in these:
            found = node
        node = node.parent
    return found.parent if found is not None and found.parent is not None else at


def words_of(nodes: list[Node], choose: bool = False) -> str:
    """All text below nodes, white space as one space; blocks and line breaks stand apart, inline marks do not.

    choose: leaves out furniture and what is marked as template, but never the given nodes themselves.
    """
    out: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    own = set(map(id, nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.silent or choose and id(x) not in own and (x.drop or x.odd or x.weak and _labels_only(x)):
            out.append(" " if x.tag in _BLOCKS else "")
        elif x.tag in _BLOCKS:
            todo += [" ", *reversed(x.items), " "]
        else:
            todo += reversed(x.items)
    return " ".join("".join(out).split())


def _labels_only(node: Node) -> bool:
    """Whether a node holds links or labels rather than sentences."""
    text, linked, todo = [], 0, [node]
    while todo:
        for x in todo.pop().items:
            if isinstance(x, Node):
                todo.append(x)
            else:
                text.append(x)
                linked += len(x) if isinstance(x, Linked) else 0
    return 2 * linked >= sum(map(len, text)) or not _SENTENCE.search("".join(text))


# --- Outlines ------------------------------------------------------------------------------------------------------


class Outline:
    """A page's nodes in page order: label, parent, the page's blocks (or pieces of text), text digest, size, furniture."""

    def __init__(self, page: Node):
        self.labels: list[str] = []
        self.ups: list[int] = []
        self.blocks: list[list] = []
        todo: list[tuple[int, str, list]] = [(-1, "#page", [page])]
        while todo:
            up, label, blocks = todo.pop()
            at = len(self.labels)
            self.labels.append(label)
            self.ups.append(up)
            self.blocks.append(blocks)
            if label != "#text":
                todo += [(at, *kid) for kid in reversed(_kids(blocks))]
        self.kids = kids_of(self.ups)
        n = len(self.labels)
        self.digest, self.size = [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            if self.kids[k]:
                parts = [self.digest[c] for c in self.kids[k]]
                self.size[k] = sum(self.size[c] for c in self.kids[k])
                self.digest[k] = _hash(repr(parts)) if any(parts) else 0
            else:
                text, plain = _own(self.blocks[k], self.labels[k])
                self.size[k] = plain
                self.digest[k] = _hash(text) if text else 0

    def odd(self, k: int) -> bool:
        return self.labels[k] != "#text" and all(x.odd or x.weak and _labels_only(x) for x in self.blocks[k])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def kids_of(ups: list[int]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in ups]
    for k, up in enumerate(ups):
        if up >= 0:
            kids[up].append(k)
    return kids


def _kids(blocks: list[Node]) -> list[tuple[str, list]]:
    """Label and blocks of each child of a run of blocks. Text beside blocks is a child of its own: (block, place) pairs."""
    if not any(isinstance(x, Node) and x.tag in _BLOCKS and not x.silent for b in blocks for x in b.items):
        return []
    out: list[tuple[str, list]] = []
    for b in blocks:
        for i, x in enumerate(b.items):
            if isinstance(x, Node):
                if x.silent or x.tag not in _BLOCKS:
                    continue
                label, one = x.label, x
            elif x.isspace() or not x:
                continue
            else:
                label, one = "#text", (b, i)
            if out and out[-1][0] == label and label.split(".")[0] in _RUNS:
                out[-1][1].append(one)
            else:
                out.append((label, [one]))
    return out


def _own(blocks: list, label: str) -> tuple[str, int]:
    """A leaf's text as words, and its characters outside links."""
    if label == "#text":
        parts = [b.items[i] for b, i in blocks]
    else:
        parts = [x for b in blocks for x in [*b.items, " "] if isinstance(x, str)]
    plain = sum(len(x) for x in parts if not isinstance(x, Linked))
    return " ".join("".join(parts).split()), plain


# --- Alignment -----------------------------------------------------------------------------------------------------


class Tree:
    """Labels and children of an outline or template, with what tells equal subtrees."""

    def __init__(self, labels: list[str], ups: list[int]):
        self.labels, self.kids = labels, kids_of(ups)
        order, n = [0] if labels else [], len(labels)
        for k in order:
            order += self.kids[k]
        self.size, self.shape = [1] * n, [0] * n
        for k in reversed(order):
            self.size[k] += sum(self.size[c] for c in self.kids[k])
            self.shape[k] = hash((labels[k], tuple(self.shape[c] for c in self.kids[k])))


#: Pairs of children that one alignment compares; what is wider is aligned by equal subtrees and by place.
MOST_CELLS = 1 << 16


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (i, j), sorted by i, in which j rises too."""
    ends: list[int] = []
    chain: list[tuple[int, int]] = []  # place in pairs, place of the one before
    for i, j in pairs:
        k = bisect_left(ends, j, key=lambda e: pairs[e][1])
        chain.append((len(chain), ends[k - 1] if k else -1))
        ends[k : k + 1] = [len(chain) - 1]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = chain[at][1]
    return out[::-1]


def _once(items: list) -> dict:
    """Items that occur once, with their places."""
    seen: dict = {}
    for i, x in enumerate(items):
        seen[x] = -1 if x in seen else i
    return {x: i for x, i in seen.items() if i >= 0}


def _split(a: Tree, b: Tree, rows: list[int], cols: list[int], cells: int) -> tuple[list[tuple[int, int]], list[tuple[list[int], list[int]]], int]:
    """How two lists of children are compared: pairs that are settled, parts that are compared each with each, cells left.

    Equal subtrees at both ends belong to a largest match, so they are settled first. If the rest is wider than `cells`,
    subtrees that stand once on both sides are settled in the longest order-keeping chain, and between them what is
    still too wide is paired by place: the n-th child of a label with the n-th.
    """
    lo, n, m = 0, len(rows), len(cols)
    while lo < min(n, m) and a.shape[rows[lo]] == b.shape[cols[lo]]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a.shape[rows[n - 1 - hi]] == b.shape[cols[m - 1 - hi]]:
        hi += 1
    settled = list(zip(rows[:lo], cols[:lo])) + list(zip(rows[n - hi :], cols[m - hi :]))
    rows, cols = rows[lo : n - hi], cols[lo : m - hi]
    if len(rows) * len(cols) <= cells:
        return settled, [(rows, cols)] if rows and cols else [], cells - len(rows) * len(cols)
    there = _once([b.shape[d] for d in cols])
    once = _once([a.shape[c] for c in rows])
    anchors = _in_order(sorted((i, there[x]) for x, i in once.items() if x in there))
    settled += [(rows[i], cols[j]) for i, j in anchors]
    parts = []
    for (i, j), (k, l) in zip([(-1, -1), *anchors], [*anchors, (len(rows), len(cols))]):
        some, others = rows[i + 1 : k], cols[j + 1 : l]
        if len(some) * len(others) <= cells:
            cells -= len(some) * len(others)
            parts += [(some, others)] if some and others else []
            continue
        places: dict[tuple[str, int], int] = {}
        times: Counter = Counter()
        for y, d in enumerate(others):
            places[b.labels[d], times[b.labels[d]]] = y
            times[b.labels[d]] += 1
        times.clear()
        both = []
        for x, c in enumerate(some):
            y = places.get((a.labels[c], times[a.labels[c]]))
            times[a.labels[c]] += 1
            if y is not None:
                both.append((x, y))
        settled += [(some[x], others[y]) for x, y in _in_order(both)]
    return settled, parts, cells


def match_trees(a: Tree, b: Tree, cells: int = MOST_CELLS) -> tuple[int, dict[int, int]]:
    """Simple tree matching: size of the largest top-down, order-keeping match of two trees, and its places in b to those in a.

    Equal subtrees match as they are. Otherwise the work for two nodes is the product of their numbers of children, without
    equal subtrees at both ends; runs of equal siblings count as one. Beyond `cells` compared pairs the match keeps order and labels
    but need not be the largest (_split).
    """
    if not a.labels or not b.labels or a.labels[0] != b.labels[0]:
        return 0, {}
    pairs, best, split, table = [(0, 0)], {}, {}, {}
    for x, y in pairs:
        if a.shape[x] != b.shape[y]:
            settled, parts, cells = split_ = _split(a, b, a.kids[x], b.kids[y], cells)
            split[x, y] = split_
            pairs += settled
            pairs += [(c, d) for rows, cols in parts for c in rows for d in cols if a.labels[c] == b.labels[d]]
    for x, y in reversed(pairs):
        if a.shape[x] == b.shape[y]:
            best[x, y] = a.size[x]
            continue
        settled, parts, _ = split[x, y]
        total = 1 + sum(best[p] for p in settled)
        for k, (rows, cols) in enumerate(parts):
            t = [[0] * (len(cols) + 1)]
            for c in rows:
                prior, row = t[-1], [0]
                for j, d in enumerate(cols):
                    row.append(max(prior[j + 1], row[j], prior[j] + best.get((c, d), 0)))
                t.append(row)
            table[x, y, k] = t
            total += t[-1][-1]
        best[x, y] = total
    found: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[y] = x
        if (x, y) not in split:
            todo += zip(a.kids[x], b.kids[y])
            continue
        settled, parts, _ = split[x, y]
        todo += settled
        for k, (rows, cols) in enumerate(parts):
            t, i, j = table[x, y, k], len(rows), len(cols)
            while i and j:
                w = best.get((rows[i - 1], cols[j - 1]), 0)
                if w and t[i][j] == t[i - 1][j - 1] + w:
                    todo.append((rows[i - 1], cols[j - 1]))
                    i, j = i - 1, j - 1
                elif t[i][j] == t[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
    return best[0, 0], found


# --- Slots and their verdicts --------------------------------------------------------------------------------------

KEEP, DROP, ROOT = 0, 1, 2


def decide(labels: list[str], ups: list[int], odd: list[bool], low: list[int], high: list[int], sizes: list[int], seen: list[int]) -> list[int]:
    """KEEP, DROP or ROOT for each slot.

    low, high: least and greatest digest of a slot's texts (zero: no text); sizes: characters outside links on all pages;
    seen: 64 bits, of which each different longest block of a page sets one. A slot is constant if its text is the same on
    LEAST_PAGES different pages or more, and on all that have it; copies of one page prove nothing. Constant boxes are dropped
    wherever they stand; constant headings, paragraphs, lists, quotes and tables stay inside an article element, or inside a main
    without one.
    """
    kids, n = kids_of(ups), len(labels)
    constant = [low[k] == high[k] != 0 and seen[k].bit_count() >= LEAST_PAGES for k in range(n)]
    proven = n > 0 and seen[0].bit_count() >= LEAST_PAGES
    tag = [x.split(".")[0] for x in labels]
    mass, stated = [0] * n, [False] * n
    order = [0] if n else []
    for k in order:
        order += kids[k]
    for k in reversed(order):
        mass[k] = 0 if constant[k] else sizes[k] - sum(sizes[c] - mass[c] for c in kids[k])
        stated[k] = not odd[k] and (tag[k] in ("article", "main") or any(stated[c] for c in kids[k]))
    t = 0
    while n and tag[t] not in ("article", "main"):
        open_ = [c for c in kids[t] if mass[c] > 0 and labels[c] != "#text" and (kids[c] or tag[c] in _BOXES)]
        plain = [c for c in open_ if not odd[c]]
        here = sum(mass[c] for c in kids[t] if not odd[c])
        by_mass = [c for c in open_ if 2 * mass[c] >= mass[t] and (not odd[c] or proven and 20 * mass[c] >= 19 * mass[t])]
        by_tag = [c for c in plain if stated[c]]
        by_rest = [c for c in plain if 2 * mass[c] >= here]
        ways = (by_mass, by_tag, by_rest) if proven else (by_tag, by_rest, by_mass)
        choice = next((w for w in ways if w), [])
        if not choice:
            break
        best = max(choice, key=lambda c: (mass[c], -c))
        # A varying heading before the best part belongs to it: both stand in the content's root.
        if any(tag[c] in _HEADINGS and mass[c] > 0 for c in kids[t][: kids[t].index(best)]):
            break
        t = best
    holds = [x == "article" for x in tag]
    for k in reversed(order):
        holds[k] |= any(holds[c] for c in kids[k])
    inside = [False] * n
    for k in order:
        inside[k] = tag[k] == "article" or tag[k] == "main" and not holds[k] or k > 0 and inside[ups[k]]
    verdict = [DROP if c and not (inside[k] and tag[k] in _TEXTS) else KEEP for k, c in enumerate(constant)]
    if n:
        verdict[t] = ROOT
    return verdict


def content(page: Node, outline: Outline, found: dict[int, int], verdict: list[int]) -> str:
    """The article's text: what stands below the content's root and is neither constant nor furniture.

    found: places of the page to slots. A page without the root's place is decided on its own.
    """
    root = next((k for k, s in found.items() if verdict[s] == ROOT), None)
    if root is None:
        found = {k: k for k in range(len(outline.labels))}
        digest = outline.digest
        verdict = decide(outline.labels, outline.ups, [outline.odd(k) for k in found], digest, digest, outline.size, [0] * len(digest))
        root = verdict.index(ROOT)
    for k, s in found.items():
        if verdict[s] == DROP:
            for b in outline.blocks[k]:
                if isinstance(b, Node):
                    b.drop = True
                else:
                    b[0].items[b[1]] = " "
    return words_of(_articles(outline, root, found, verdict), choose=True)


def _articles(outline: Outline, root: int, found: dict[int, int], verdict: list[int]) -> list:
    """The blocks of the content's root and, if it is an article element, of the page's other outermost ones, in page order.

    Articles inside furniture, and constant ones, are none of the page's.
    """
    tags = [x.split(".")[0] for x in outline.labels]
    if tags[root] != "article":
        return outline.blocks[root]
    roots, todo = [], [0]
    while todo:
        k = todo.pop()
        if k == root or tags[k] == "article" and not outline.odd(k):
            roots += [] if k != root and k in found and verdict[found[k]] == DROP else outline.blocks[k]
        elif k == 0 or not outline.odd(k):
            todo += reversed(outline.kids[k])
    return roots if any(b is r for b in roots for r in outline.blocks[root]) else outline.blocks[root]


# --- Induction over all pages --------------------------------------------------------------------------------------


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))


_NODES = "array<struct<id:bigint,up:bigint,label:string,odd:boolean,digest:bigint,size:bigint>>"


def outlines(pages: DataFrame) -> DataFrame:
    """(host, nodes, longest): each page's outline, in page order. A node's id is a hash of its path, in which siblings of
    one label are numbered; longest is the digest of its longest block. pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, longest = [], []
            for html in batch.column(1).to_pylist():
                o = Outline(read_page(html))
                ids, times = [], {}
                for k, label in enumerate(o.labels):
                    up = ids[o.ups[k]] if k else 0
                    times[up, label] = nth = times.get((up, label), 0) + 1
                    ids.append(_hash(f"{up}/{label}/{nth}"))
                nodes.append([
                    (i, ids[up] if up >= 0 else 0, label, o.odd(k), o.digest[k], o.size[k])
                    for k, (i, up, label) in enumerate(zip(ids, o.ups, o.labels))
                ])
                leaves = [k for k in range(len(ids)) if not o.kids[k]]
                longest.append(o.digest[max(leaves, key=lambda k: (o.size[k], -k))])
            kind = pa.list_(pa.struct([("id", pa.int64()), ("up", pa.int64()), ("label", pa.string()), ("odd", pa.bool_()), ("digest", pa.int64()), ("size", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, kind), pa.array(longest, pa.int64())], ["host", "nodes", "longest"])

    return pages.select("host", "html").mapInArrow(run, f"host string, nodes {_NODES}, longest bigint")


def templates(outlines: DataFrame) -> DataFrame:
    """(host, pages, template): the nodes that at least half of a host's pages have, in their mean order."""
    each = outlines.select("host", F.posexplode("nodes").alias("pos", "node")).select("host", "pos", "node.*")
    votes = each.groupBy("host", "id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pos").alias("pos"), F.min("up").alias("up"), F.min("label").alias("label"),
        F.avg(F.col("odd").cast("int")).alias("odd"),
    )
    # Every page has the node at the top, so its votes are the host's pages.
    total = votes.where("up = 0").select("host", F.col("n").alias("pages"))
    kept = votes.join(total, "host").where("2 * n >= pages")
    node = F.struct("pos", "id", "up", "label", (F.col("odd") >= 0.5).alias("odd"))
    return kept.groupBy("host").agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list(node)).alias("template"))


def _template(nodes: list[dict]) -> tuple[list[str], list[int], list[bool]]:
    """Labels, parents and furniture flags of a template; parents first, siblings in their order."""
    kids: dict[int, list[dict]] = {}
    for x in nodes:
        kids.setdefault(x["up"], []).append(x)
    labels, ups, odd = [], [], []
    todo = [(-1, x) for x in kids.get(0, [])]
    while todo:
        up, x = todo.pop()
        todo += [(len(labels), c) for c in reversed(kids.get(x["id"], []))]
        labels.append(x["label"])
        ups.append(up)
        odd.append(x["odd"])
    return labels, ups, odd


class _Kept(dict):
    """Values by their key, made when first asked for; emptied when full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def slots(outlines: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, slot, low, high, size, seen): what the host's aligned pages say about each node of its template."""
    shape = F.col("template").cast("array<struct<pos:double,id:bigint,up:bigint,label:string,odd:boolean>>")
    given = templates.select("host", F.to_json(shape).alias("template"))
    joined = _with_wrappers(outlines.select("host", "nodes", "longest"), templates.select("host", "pages").join(given, "host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Kept(lambda text: Tree(*_template(json.loads(text))[:2]), 4_096)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for host, nodes, longest, template in zip(*(c.to_pylist() for c in batch.columns)):
                place = {x["id"]: k for k, x in enumerate(nodes)}
                page = Tree([x["label"] for x in nodes], [place.get(x["up"], -1) for x in nodes])
                for k, slot in match_trees(trees[template], page)[1].items():
                    if nodes[k]["digest"]:
                        for column, value in zip(out, (host, slot, nodes[k]["digest"], nodes[k]["size"], 1 << (longest % 63))):
                            column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "slot", "digest", "size", "bit"])

    rows = joined.select("host", "nodes", "longest", "template").mapInArrow(run, "host string, slot int, digest long, size long, bit long")
    return rows.groupBy("host", "slot").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high"), F.sum("size").alias("size"), F.bit_or("bit").alias("seen")
    )


def induce(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper): each host's template with a verdict on every node, as JSON. pages: host, html; all are read."""
    drawn = settle(outlines(pages))
    made = settle(templates(drawn))
    found = slots(drawn, made).groupBy("host").agg(F.collect_list(F.struct("slot", "low", "high", "size", "seen")).alias("slots"))
    joined = made.join(found, "host", "left").select("host", "pages", F.to_json("template").alias("template"), "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for template, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                labels, ups, odd = _template(json.loads(template))
                stats = np.zeros((4, len(labels)), np.int64)
                for x in given or ():
                    stats[:, x["slot"]] = x["low"], x["high"], x["size"], x["seen"]
                out.append(json.dumps([labels, ups, decide(labels, ups, odd, *stats.tolist())], separators=(",", ":"), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["host", "pages", "wrapper"])

    wrappers = settle(joined.mapInArrow(run, "host string, pages long, wrapper string"))
    for table in (drawn, made):
        drop_settled(table)
    return wrappers


def _with_wrappers(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages with their host's row of wrappers (host, pages and a string column), broadcast as far as a bound allows."""
    text = next(c for c in wrappers.columns if c not in ("host", "pages"))
    size, total = wrappers.agg(F.sum(F.octet_length(text) + F.octet_length("host")), F.sum("pages")).first()
    if (size or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(wrappers), "host", "left")
    hot = F.broadcast(wrappers.where(F.col("pages") * HOT_HOSTS >= total).select("host", F.col(text).alias("_hot")))
    marked = pages.join(hot, "host", "left")
    rare = wrappers.where(F.col("pages") * HOT_HOSTS < total)
    cold = marked.where("_hot IS NULL").drop("_hot").join(rare, "host", "left")
    return marked.where("_hot IS NOT NULL").withColumnRenamed("_hot", text).unionByName(cold.drop("pages"), allowMissingColumns=True)


def extract(pages: DataFrame, aligned: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html and any other columns).

    text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments, with character references decoded and white space as single spaces. Null or empty html, and pages without
    text, give an empty text. A null or broken url has the empty host. Repeated rows stay. Whole pages are read, at any
    depth. aligned=False switches the wrappers off and gives all visible text, for comparison.
    """
    given = pages.select(F.col("page_id").cast("long"), "url", "html", _host("url").alias("host"))
    if aligned:
        given = _with_wrappers(given, induce(given.select("host", "html")))
    else:
        given = given.withColumn("wrapper", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(text: str):
            labels, ups, verdict = json.loads(text)
            return Tree(labels, ups), verdict

        kept = _Kept(load, 4_096)
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = read_page(html)
                if wrapper is None:
                    texts.append(words_of([page]))
                    continue
                tree, verdict = kept[wrapper]
                outline = Outline(page)
                texts.append(content(page, outline, match_trees(tree, Tree(outline.labels, outline.ups))[1], verdict))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"]
            )

    chosen = given.select("page_id", "url", "html", "wrapper")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
