"""Main text of web pages, by a tree-structured graphical model over the DOM.

Every structural element is a node that is content or not.  A child depends on its parent through a table for the
child's kind (its tag, or what its class and role say), and what can be seen of a node - how much text it has itself,
how much of that is links, whether it has sentences - depends on its label.  The tables are counts over labelled pages.
Messages passed from the leaves up and from the root down give each node's probability of being content given the
whole page; the texts of those above one half are the main text.

Messages are passed for a whole batch of pages at once, one depth after the other.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text_blocks as tb
from larder.llm.labelled_pages import LABELLED_PAGES
from larder.llm.shared import with_fields

BATCH_BYTES = 1 << 22

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""",
    re.S,
)
_UNTAGGED = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)  # of _TOKEN, what needs no >
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript title textarea iframe object svg math canvas noframes".split())
RAW = frozenset("script style textarea title iframe noframes noscript".split())  # these end only at their own end tag
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre section table ul".split()
)
# An opening tag ends an open element of these, up to the nearest of the stops.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}

# What class, id and role say.  Matched against whole words of the attribute.
MARKS = {
    "comments": "comment comments commentlist discussion replies reply disqus respond reviews",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager tabs toc skip topbar toolbar",
    "side": "sidebar aside side related recommended recommendations popular trending widget rail complementary more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription signup"
    " paywall toast announcement",
    "share": "share sharing social follow byline meta author tags tagcloud rating print tools",
    "foot": "footer foot copyright legal colophon disclaimer contentinfo",
    "head": "header masthead branding logo site-header",
    "content": "article content main post entry story body text page prose hentry articlebody",
}
_MARK_OF = {word: mark for mark, words in MARKS.items() for word in words.split()}
_WORDS = re.compile(r"[a-z]+")

TAG_KINDS = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure"
    " figcaption nav header footer aside form fieldset button select option menu dialog details summary address".split()
)


@dataclass
class Node:
    kind: str
    parent: int
    depth: int
    texts: list[tuple[int, str]] = field(default_factory=list)  # (order in the page, block text)
    links: int = 0  # characters of own text within links
    chars: int = 0
    label: int | None = None


def _kind(tag: str, attributes: str) -> tuple[str, dict[str, str]]:
    values = {}
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), html.unescape(a or b or c))
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", ""):
        return "hidden", values
    for name in ("role", "class", "id"):
        found = {_MARK_OF[w] for w in _WORDS.findall(values.get(name, "").lower()) if w in _MARK_OF}
        if found:
            # Where several speak, what is not content wins: "post-comments", "article-footer".
            other = sorted(found - {"content"})
            return f"marked {other[0] if other else 'content'}", values
    return tag if tag in TAG_KINDS else "other", values


def parse(page: str) -> list[Node]:
    """Structural elements of a page in document order; the first is the root.

    Where the open elements of each tag stand is kept, so that no tag has to look through all that are open.
    """
    nodes = [Node("root", -1, 0)]
    stack: list[tuple[str, int]] = [("", 0)]  # (tag, structural node it belongs to)
    places: defaultdict[str, list[int]] = defaultdict(list)  # on the stack, ascending
    blocks = [0]  # places of those that are not inline
    last_end = page.rfind(">")
    pieces: list[str] = []
    linked = order = links_open = 0
    at, end = 0, len(page)

    def flush() -> None:
        """The text since the last break is a block of the structural element that is open."""
        nonlocal linked, order
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            pieces.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.texts.append((order, text))
                node.chars += len(text)
                node.links += min(linked, len(text))
                order += 1
        linked = 0

    def leave(depth: int) -> None:
        nonlocal links_open
        while len(stack) > depth:
            if stack[-1][0] == "a":
                links_open -= 1
            if stack[-1][0] not in INLINE:
                flush()
                blocks.pop()
            places[stack.pop()[0]].pop()

    def enter(tag: str, node: int) -> None:
        places[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, node))

    def close(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        # The outermost of the tags within the innermost stop.
        stop = max((places[s][-1] for s in stops if places[s]), default=0)
        within = [places[t][bisect_right(places[t], stop)] for t in tags if places[t] and places[t][-1] > stop]
        if within:
            leave(min(within))

    while at < end:
        # Behind the last ">" no tag ends, and trying each would read on to the end of the page.
        m = _TOKEN.search(page, at, last_end + 1)
        if m is None:
            m = _UNTAGGED.search(page, at)
        elif m[2] is None:
            m = _UNTAGGED.match(page, m.start())  # it may go on behind the last ">"
        stop = m.start() if m else end
        if stop > at:
            text = page[at:stop]
            pieces.append(text)
            if links_open:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m.re is _UNTAGGED or m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            # An inline end tag does not end a block.
            if places[tag] and (tag not in INLINE or places[tag][-1] > blocks[-1]):
                leave(places[tag][-1])
            continue
        if tag in UNSEEN:
            if tag not in INLINE and tag not in ("noscript", "script", "style", "template"):
                flush()
            if not m[3].endswith("/") or tag in RAW:
                ending = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = ending.end() if ending else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                links_open += 1
            enter(tag, stack[-1][1])
            continue
        if tag in CLOSES_P:
            close(("p",), ("button", "table", "td", "th"))
        if tag in CLOSES:
            close(*CLOSES[tag])
        flush()
        parent = stack[-1][1]
        kind, values = _kind(tag, m[3])
        nodes.append(Node(kind, parent, nodes[parent].depth + 1))
        if "data-keep" in values:
            nodes[-1].label = 1
        elif "data-drop" in values:
            nodes[-1].label = 0
        enter(tag, len(nodes) - 1)
    leave(1)
    flush()
    return nodes


# Observations, each with its number of values.
SEEN = (("length", 5), ("links", 4), ("sentences", 3))


def observe(node: Node) -> tuple[int, int, int]:
    """Buckets of own text length, share of links and sentence ends."""
    length = 0 if not node.chars else 1 + sum(node.chars > x for x in (25, 80, 240))
    share = node.links / node.chars if node.chars else 0.0
    links = 0 if not node.links else 1 if share < 0.3 else 2 if share < 0.7 else 3
    ends = sum(len(re.findall(r"[.!?](?=\s|$)", t)) for _, t in node.texts)
    return length, links, min(ends, 2)


# Kinds that say nothing by themselves.  As the only thing in an element without text, one is just another wrapper.
NEUTRAL = frozenset(("div", "section", "other"))
WRAPPED = np.log(np.array([[0.9995, 0.0005], [0.0005, 0.9995]]))


def wrappers(nodes: list[Node]) -> list[bool]:
    """Which nodes are neutral and alone in a parent without text, and so are content exactly if the parent is."""
    children = [0] * len(nodes)
    for node in nodes[1:]:
        children[node.parent] += 1
    return [i > 0 and n.kind in NEUTRAL and children[n.parent] == 1 and not nodes[n.parent].chars for i, n in enumerate(nodes)]


@dataclass
class Model:
    """Logarithms: child label given parent label by kind, and each observation given the label."""

    kinds: dict[str, int]
    child: np.ndarray  # (kinds, parent label, child label)
    seen: list[np.ndarray]  # (values, label)
    root: np.ndarray


def labels_of(nodes: list[Node]) -> np.ndarray:
    """1 for elements marked data-keep and what they hold unless marked data-drop, and for elements around kept text."""
    out = np.zeros(len(nodes), np.int64)
    for i, node in enumerate(nodes):
        out[i] = node.label if node.label is not None else out[node.parent] if i else 0
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[nodes[i].parent] = 1
    return out


def train(pages: list[str], smoothing: float = 0.02, trust: float = 0.3) -> Model:
    """Counts over pages whose content is marked with data-keep, and what is not content within it with data-drop.

    The observations of an element depend on one another, so each counts only by ``trust``.
    """
    parsed = [parse(p) for p in pages]
    kinds = {k: i for i, k in enumerate(["other", *sorted({n.kind for nodes in parsed for n in nodes} - {"other"})])}
    child = np.full((len(kinds), 2, 2), smoothing)
    seen = [np.full((size, 2), smoothing) for _, size in SEEN]
    root = np.full(2, smoothing)
    for nodes in parsed:
        labels = labels_of(nodes)
        alone = wrappers(nodes)
        for i, node in enumerate(nodes):
            if i and not alone[i]:
                child[kinds[node.kind], labels[node.parent], labels[i]] += 1
                child[0, labels[node.parent], labels[i]] += 0.05  # kinds that no page shows
            elif not i:
                root[labels[i]] += 1
            if node.chars:
                for table, value in zip(seen, observe(node), strict=True):
                    table[value, labels[i]] += 1
    # An element that is not content holds none, whatever its kind; few kinds are seen often enough to tell.
    child[:, 0, 0] += 2
    return Model(
        kinds,
        np.log(child / child.sum(axis=2, keepdims=True)),
        [trust * np.log(t / t.sum(axis=0)) for t in seen],
        np.log(root / root.sum()),
    )


def marginals(model: Model, pages: list[list[Node]]) -> list[np.ndarray]:
    """Probability of being content for all nodes of all pages, by messages up and down the trees."""
    sizes = [len(p) for p in pages]
    first = np.cumsum([0, *sizes])
    total = int(first[-1])
    parent, depth, kind = np.zeros((3, total), np.int64)
    own = np.zeros((total, 2))
    alone = np.zeros(total, bool)
    i = 0
    for nodes, start in zip(pages, first, strict=False):
        alone[start : start + len(nodes)] = wrappers(nodes)
        for node in nodes:
            parent[i], depth[i], kind[i] = node.parent + start, node.depth, model.kinds.get(node.kind, 0)
            if node.chars:
                for table, value in zip(model.seen, observe(node), strict=True):
                    own[i] += table[value]
            i += 1
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    table = model.child[kind]
    table[alone] = WRAPPED
    own[depth == 0] += model.root
    below = own.copy()
    message = np.zeros((total, 2))
    for level in reversed(levels[1:]):
        for p in (0, 1):
            message[level, p] = np.logaddexp(table[level, p, 0] + below[level, 0], table[level, p, 1] + below[level, 1])
        np.add.at(below, parent[level], message[level])
    whole = below.copy()
    for level in levels[1:]:
        # What the parent believes without this child, sent down through the table.
        rest = whole[parent[level]] - message[level]
        rest -= rest.max(axis=1, keepdims=True)
        for c in (0, 1):
            whole[level, c] += np.logaddexp(rest[:, 0] + table[level, 0, c], rest[:, 1] + table[level, 1, c])
        whole[level] -= whole[level].max(axis=1, keepdims=True)
    p = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -700, 700)))
    return np.split(p, first[1:-1]) if pages else []


def main_text(nodes: list[Node], p: np.ndarray) -> tuple[str, int, float | None]:
    """Blocks of content nodes in page order, how many, and the least probability among them."""
    kept = [(order, text, q) for node, q in zip(nodes, p.tolist(), strict=True) if q > 0.5 for order, text in node.texts]
    kept.sort()
    return "\n\n".join(t for _, t, _ in kept), len(kept), min((q for _, _, q in kept), default=None)


def extract(
    pages: DataFrame, *, html: str = "html", text: str = "text", model: Model | None = None
) -> DataFrame:
    """All columns of the input but the html, with ``text``, ``n_blocks`` and ``least_certain`` (null without blocks).

    A null or empty page has an empty text.  White space within a block is one space, blocks are joined by an empty
    line; nothing is shortened.  Repeated pages get equal texts.  Columns already called like the three are replaced.
    The model defaults to one trained on LABELLED_PAGES.
    """
    model = model or train(LABELLED_PAGES)
    kept = [c for c in pages.columns if c not in (html, text, "n_blocks", "least_certain")]
    frame = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in tb.text_blocks(batch.column("__html"), BATCH_BYTES):
                raw = data.tobytes()
                parsed = [parse(raw[a:b].decode("utf-8")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                rows = [main_text(*x) for x in zip(parsed, marginals(model, parsed), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(start, stop - start) for c in kept]
                    + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.float64()), strict=True)],
                    names=[*kept, text, "n_blocks", "least_certain"],
                )

    schema = with_fields(
        frame.drop("__html"), (text, T.StringType()), ("n_blocks", T.IntegerType()), ("least_certain", T.DoubleType())
    )
    return frame.mapInArrow(tb.tidy(run), schema)
