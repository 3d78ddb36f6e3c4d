"""Operator 10, main text of web pages by a tree-structured graphical model.

A page's block elements and text blocks form a tree.  Every node is in one of four
states: all its text is main text, none is, or some is, in an element around the main
text or within it.  A node's potential comes from
what is seen of it (tag, words of its class, id and role, how much text, how much of
that in links); the potential between a node and its parent from how often their states
go together.  All are counted on labelled pages.  Sum-product message passing, upward
from the leaves and downward from the root, gives exact marginals; text blocks that are
more likely main text than not make up the text of the page.

Pages are independent: Spark deals them out and each is worked on whole, in time in
proportion to its length, without a shuffle.

Defined results: null or empty html gives an empty text; unclosed and misplaced tags
are put right as browsers do for the common cases; an element whose content is not
shown (``svg``, ``canvas``, ``object`` and the like) and that nothing closes is taken
as empty; a page without tags is one block;
repeated rows give repeated results; an empty table gives an empty result.  Other
columns of the input are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.llm.common import map_batches
from dawnchorus.llm.labelled_pages import labelled_pages

#: A node's text: none of it is main text; some, in an element around the main text or
#: within it; or all of it.
NONE, AROUND, WITHIN, ALL = range(4)
STATES = 4
DIVIDED = np.array([0.0, -np.inf, -np.inf, 0.0])

#: Kinds of HTML elements.
INLINE = frozenset("annotation-xml a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small "
                   "span strike strong sub sup time tt u var wbr math menclose merror mfrac mi mmultiscripts mn mo mover "
                   "mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
                   "munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of text that is not shown and in which nothing but their own end is a tag.
RAW = frozenset("script style iframe title textarea".split())
#: Elements whose content is markup but not shown.
UNSEEN = frozenset("noscript template svg object canvas video audio annotation".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 "
                           "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that ends an open one of the same group before its list, table or definition begins.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "option": ("option",)}
#: Elements that hold a single text as often in main text as elsewhere.
PLAIN = frozenset("#root #text html body p div li h1 h2 h3 h4 h5 h6 blockquote td th tr dt dd pre figcaption".split())
HOLDS_ITEMS = frozenset("ul ol menu dl table select".split())

TAG_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
#: The end of a tag, or a quoted value in it.
TAG_PART = re.compile(r""">|=\s*(["'])""")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LABEL = re.compile(r"""data-label='(\w+)'""")
NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Page:
    """The tree in page order: a node's parent stands before it.  Node 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    names: list[str] = field(default_factory=lambda: [""])
    text: list[str | None] = field(default_factory=lambda: [None])
    words: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    label: list[str] = field(default_factory=lambda: [""])

    def add(self, parent: int, tag: str, names: str = "", text: str | None = None, words: int = 0, linked: int = 0,
            label: str = "") -> int:
        for column, value in zip((self.parent, self.tag, self.names, self.text, self.words, self.linked, self.label),
                                 (parent, tag, names, text, words, linked, label), strict=True):
            column.append(value)
        return len(self.parent) - 1


class Scanner:
    """The tags of a page, found in one pass forwards: (start, end, closing, name, attributes).

    Every search that fails, fails once for a page: what is not found from one place on
    is not there from later ones on either.
    """

    def __init__(self, source: str):
        self.source = source
        self.quoted = {'"', "'"}
        self.missing: set[str] = set()
        self.closings: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Place after the tag's ``>``, -1 without one.  A ``>`` in a quoted value is none, as long
        as quotes close and the tag ends behind them."""
        place = at
        while self.quoted:
            part = TAG_PART.search(self.source, place)
            if part is None:
                self.quoted.clear()
                break
            place = part.end()
            if part[1] is None:
                return place
            if part[1] in self.quoted:
                close = self.find(part[1], place)
                if close < 0:
                    self.quoted.discard(part[1])
                else:
                    place = close + 1
        end = self.find(">", at)
        return end + 1 if end >= 0 else -1

    def tags(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """``self.at`` may be moved forwards between two tags."""
        self.at = 0
        while found := TAG_START.search(self.source, self.at):
            start, self.at = found.span()
            if found[2]:
                end = self.tag_end(self.at)
            elif found[0] == "<!--":
                close = self.find("-->", self.at)
                end = close + 3 if close >= 0 else len(self.source)
            else:
                end = self.find(">", self.at) + 1 or -1
            if end < 0:
                return  # no tag ends from here on
            inner = self.source[self.at:end - 1] if found[2] else ""
            self.at = end
            yield start, end, bool(found[1]), (found[2] or "").lower(), inner

    def last_closing(self, name: str) -> int:
        """Place of the last closing tag of the name."""
        if name not in self.closings:
            last = -1
            for m in re.finditer(f"</{re.escape(name)}[\\s/>]", self.source, re.I):
                last = m.start()
            self.closings[name] = last
        return self.closings[name]


def parse(source: str) -> Page:
    """Tree of block elements and text blocks; inline elements belong to the text around them."""
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the block they are in
    open_tags: Counter = Counter()
    held: list[str] = []
    in_links = [0, 0]  # open links; words of the held text inside links
    unseen = [0]  # open elements that are not shown
    holders: list[int] = []  # places in the stack of open elements that hold items
    items: defaultdict[str, list[int]] = defaultdict(list)  # and of open items, by name

    def flush() -> None:
        if held:
            words = "".join(held).split()
            held.clear()
            if words:
                page.add(stack[-1][1], "#text", text=" ".join(words), words=len(words), linked=min(in_links[1], len(words)))
        in_links[1] = 0

    def take(raw: str) -> None:
        if raw and not unseen[0]:
            plain = html.unescape(raw) if "&" in raw else raw
            held.append(plain)
            if in_links[0]:
                in_links[1] += len(plain.split())

    def close(tag: str) -> None:
        """End the innermost open element of the name, and all inside it."""
        while True:
            name, _ = stack[-1]
            if name not in INLINE and not unseen[0]:
                flush()
            stack.pop()
            open_tags[name] -= 1
            if name == "a":
                in_links[0] -= 1
            elif name in UNSEEN:
                unseen[0] -= 1
            elif name in HOLDS_ITEMS:
                holders.pop()
            elif name in ITEMS:
                items[name].pop()
            if name == tag:
                return

    def enter(name: str, block: int) -> None:
        if name in HOLDS_ITEMS:
            holders.append(len(stack))
        elif name in ITEMS:
            items[name].append(len(stack))
        stack.append((name, block))
        open_tags[name] += 1

    scanner, at = Scanner(source), 0
    for start, end, closing, name, attributes in scanner.tags():
        take(source[at:start])
        at = end
        if not name:
            continue
        if closing:
            if open_tags[name] > 0:
                close(name)
            elif name == "p":
                flush()
        elif name in RAW:
            if scanner.last_closing(name) >= end:
                ending = re.compile(f"</{name}[\\s/>]", re.I).search(source, end)
                scanner.at = at = ending.start()
            elif name in ("script", "style"):
                scanner.at = at = len(source)
            if name not in ("script", "style") and not unseen[0]:
                flush()
        elif name in UNSEEN:
            if not attributes.endswith("/") and scanner.last_closing(name) >= end:
                if name not in ("svg", "annotation") and not unseen[0]:
                    flush()
                enter(name, stack[-1][1])
                unseen[0] += 1
        elif unseen[0]:
            # Opened so that its end is told from that of an element around it.
            if name not in VOID and not attributes.endswith("/"):
                enter(name, stack[-1][1])
                in_links[0] += name == "a"
        elif name == "br":
            held.append(" ")
        elif name in VOID:
            if name == "hr":
                flush()
        elif name in INLINE:
            enter(name, stack[-1][1])
            in_links[0] += name == "a"
        else:
            flush()
            if name in ENDS_PARAGRAPH and open_tags["p"] > 0:
                close("p")
            for item in ITEMS.get(name, ()):
                if items[item] and items[item][-1] > (holders[-1] if holders else -1):
                    close(item)
            names = " ".join(x for m in NAMES.finditer(attributes) for x in m.groups() if x).lower() if attributes else ""
            label = LABEL.search(attributes) if attributes else None
            enter(name, page.add(stack[-1][1], name, names, label=label[1] if label else ""))
    take(source[at:])
    flush()
    return page


@dataclass
class Tree:
    """What inference works on: text blocks and the elements in which several texts meet.

    An element with a single text-bearing child has that child's state, so such chains
    are one node, with the tags and names of all; deep nesting adds no evidence.
    """

    node: list[int]  # number in the page
    parent: list[int]
    marks: list[tuple]  # distinct (tag, names) of the chain
    words: list[int]
    linked: list[int]


def contract(page: Page) -> Tree:
    n = len(page.parent)
    words, linked = page.words[:], page.linked[:]
    for i in range(n - 1, 0, -1):
        words[page.parent[i]] += words[i]
        linked[page.parent[i]] += linked[i]
    children = [0] * n
    for i in range(1, n):
        if words[i]:
            children[page.parent[i]] += 1
    tree = Tree([], [], [], [], [])
    place = [-1] * n  # of the node, or else of the nearest kept one above
    chain: list[dict] = [{}] * n  # marks in order; handed down, not copied, as only one node goes on with it
    for i in range(n):
        if not words[i]:
            continue
        above = page.parent[i]
        chain[i] = chain[above] if i and children[above] == 1 else {}
        chain[i][page.tag[i], page.names[i]] = None
        if page.text[i] is None and children[i] == 1:
            place[i] = place[above] if i else -1
            continue
        tree.node.append(i)
        tree.parent.append(place[above] if i else -1)
        tree.marks.append(tuple(chain[i]))
        tree.words.append(words[i])
        tree.linked.append(linked[i])
        place[i] = len(tree.node) - 1
    return tree


def _look(page: Page, tree: Tree, i: int) -> tuple:
    """All that a node's potential depends on."""
    text, words, linked = page.text[tree.node[i]], tree.words[i], tree.linked[i]
    share = 0 if not linked else 1 if 4 * linked < words else 2 if 2 * linked < words else 3
    ending = None if text is None else text[-1] in ".!?:\u2026\"'\u201d\u00bb"
    return tree.marks[i], min(words.bit_length(), 8), share, ending


def _features(look: tuple) -> Iterator[tuple]:
    marks, size, share, ending = look
    kind = "element" if ending is None else "text"
    yield from (("tag landmark" if kind == "text" and t not in PLAIN else "tag " + kind, t) for t in {tag for tag, _ in marks})
    parts = {p for _, names in marks for p in NAME_PART.findall(names)}
    yield from (("name", p) for p in parts)
    yield "named " + kind, bool(parts)
    yield from (("size " + kind, size), ("links " + kind, share))
    if ending is not None:
        yield "end", ending


#: Kinds of features.  Those of one node depend on one another, so each kind's log probabilities
#: count by a factor that is fitted, see ``fit_weights``.
KINDS = ("tag element", "tag landmark", "tag text", "name", "named element", "named text", "size element", "size text", "links element", "links text", "end")


@dataclass(frozen=True)
class Model:
    """Log probabilities counted on labelled pages."""

    between: np.ndarray  # [parent's state][state]
    first: np.ndarray  # of the root's state
    seen: dict[tuple, np.ndarray]  # of a feature in each state; one not met in training says nothing
    weights: dict[str, float]
    longest: int = 0  # letters of the longest name met in training

    def evidence(self, look: tuple) -> dict[str, np.ndarray]:
        """Per kind of feature the sum of the log probabilities."""
        found: dict[str, np.ndarray] = {}
        for f in _features(look):
            f = f if f in self.seen or f[0] != "name" else ("name", self.known_part(f[1]))
            if f in self.seen:
                found[f[0]] = found.get(f[0], 0.0) + self.seen[f]
        return found

    def known_part(self, name: str) -> str:
        """The longest name met in training, of four letters or more, that a compound ends or begins with."""
        for size in range(min(len(name) - 1, self.longest), 3, -1):
            for part in (name[-size:], name[:size]):
                if ("name", part) in self.seen:
                    return part
        return name

    def potential(self, look: tuple) -> tuple[float, ...]:
        log = sum((self.weights[kind] * e for kind, e in self.evidence(look).items()), np.zeros(STATES))
        if look[3] is not None:
            log = log + DIVIDED  # one block is all or nothing
        return tuple(np.exp(log - log.max()).tolist())


def _states(page: Page) -> tuple[Tree, list[int]]:
    """The tree and its nodes' states as the labels of the page tell them."""
    label = page.label[:]
    other, main = np.zeros(len(label), bool), np.zeros(len(label), bool)
    for i in range(1, len(label)):
        label[i] = label[i] or label[page.parent[i]]
        if page.text[i] is not None:
            (main if label[i] == "main" else other)[i] = True
    for i in range(len(label) - 1, 0, -1):
        main[page.parent[i]] |= main[i]
        other[page.parent[i]] |= other[i]
    tree = contract(page)
    return tree, [(WITHIN if label[node] == "main" else AROUND) if main[node] and other[node] else ALL if main[node] else NONE
                  for node in tree.node]


def count(labelled: list[tuple[Page, Tree, list[int]]], weights: dict[str, float], smooth: float) -> Model:
    between, first = np.full((STATES, STATES), smooth), np.full(STATES, smooth)
    counts: defaultdict = defaultdict(lambda: np.zeros(STATES))
    for page, tree, states in labelled:
        for i, state in enumerate(states):
            if i == 0:
                first[state] += 1
            else:
                between[states[tree.parent[i]], state] += 1
            for f in _features(_look(page, tree, i)):
                counts[f][state] += 1
    totals: defaultdict = defaultdict(lambda: np.zeros(STATES))
    values = Counter(f[0] for f in counts)
    for f, c in counts.items():
        totals[f[0]] += c
    seen = {f: np.log((c + smooth) / (totals[f[0]] + smooth * values[f[0]])) for f, c in counts.items()}
    return Model(np.log(between / between.sum(axis=1, keepdims=True)), np.log(first / first.sum()), seen, weights,
                 max((len(f[1]) for f in seen if f[0] == "name"), default=0))


def fit_weights(model: Model, labelled: list[tuple[Page, Tree, list[int]]], ridge: float = 1.0, rounds: int = 20) -> dict[str, float]:
    """The factors of the kinds that make the pages' states likeliest as a whole.

    The gradient is what the marginals expect of each kind's evidence less what the labels
    show of it; steps are scaled by the spread of the evidence and bounded.  The ridge draws
    the factors to 1/2.
    """
    given = []
    for page, tree, states in labelled:
        rows, fixed = [], []
        for i in range(len(states)):
            look = _look(page, tree, i)
            found = model.evidence(look)
            rows.append([found.get(kind, np.zeros(STATES)) for kind in KINDS])
            fixed.append(np.zeros(STATES) if look[3] is None else DIVIDED)
        if rows:
            given.append((tree.parent, np.array(rows), np.array(fixed), np.array(states)))
    w = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        gradient, curve = ridge * (w - 0.5), ridge * np.eye(len(KINDS))
        for parent, evidence, fixed, states in given:
            log = np.einsum("k,nks->ns", w, evidence) + fixed
            p = np.array(sum_product(parent, np.exp(log - log.max(axis=1, keepdims=True)).tolist(), model))
            mean = np.einsum("ns,nks->nk", p, evidence)
            gradient = gradient + mean.sum(axis=0) - evidence[np.arange(len(states)), :, states].sum(axis=0)
            curve = curve + np.einsum("ns,nks,nls->kl", p, evidence, evidence) - mean.T @ mean
        step = np.linalg.solve(curve, gradient) / 2
        w = np.maximum(w - step * min(1.0, 0.3 / max(np.abs(step).max(), 1e-12)), 0.0)
    return dict(zip(KINDS, w.tolist(), strict=True))


def train(pages: list[str], smooth: float = 0.5) -> Model:
    """Count states, transitions and features on pages whose ``data-label`` tells main text.

    The factors are fitted on every other page with the counts of the rest; then all are counted.
    """
    labelled = []
    for source in pages:
        page = parse(source)
        labelled.append((page, *_states(page)))
    weights = dict.fromkeys(KINDS, 0.5)
    weights = fit_weights(count(labelled[::2], weights, smooth), labelled[1::2])
    return count(labelled, weights, smooth)


def content_marginals(page: Page, tree: Tree, model: Model, known: dict | None = None) -> list[tuple[float, ...]]:
    """Exact P(state) of each node of the tree by messages up and down."""
    known = {} if known is None else known
    potentials = []
    for i in range(len(tree.node)):
        look = _look(page, tree, i)
        if look not in known:
            if len(known) > 50_000:
                known.clear()
            known[look] = model.potential(look)
        potentials.append(known[look])
    return sum_product(tree.parent, potentials, model)


def sum_product(parent: list[int], potentials: list, model: Model) -> list[tuple[float, ...]]:
    between, first = np.exp(model.between).tolist(), np.exp(model.first).tolist()
    columns = list(zip(*between, strict=True))
    n = len(parent)
    inside = [list(p) for p in potentials]
    up: list = [None] * n
    for i in range(n - 1, -1, -1):
        own = inside[i]
        s = sum(own)
        own = inside[i] = [x / s for x in own]
        if i:
            up[i] = [sum(p * x for p, x in zip(row, own, strict=True)) for row in between]
            above = inside[parent[i]]
            for k, m in enumerate(up[i]):
                above[k] *= m
            if sum(above) < 1e-100:
                s = sum(above)
                above[:] = [x / s for x in above]
    beliefs: list = [None] * n
    for i in range(n):
        if i == 0:
            found = [x * p for x, p in zip(inside[0], first, strict=True)]
        else:
            # What the parent believes without this child's own message.
            rest = [p / m for p, m in zip(beliefs[parent[i]], up[i], strict=True)]
            found = [x * sum(p * r for p, r in zip(column, rest, strict=True))
                     for x, column in zip(inside[i], columns, strict=True)]
        s = sum(found)
        beliefs[i] = tuple(x / s for x in found)
    return beliefs


def main_text(source: str | None, model: Model, known: dict | None = None) -> str:
    if not source:
        return ""
    page = parse(source)
    tree = contract(page)
    beliefs = content_marginals(page, tree, model, known)
    blocks = ((page.text[node], p) for node, p in zip(tree.node, beliefs, strict=True))
    return "\n".join(text for text, p in blocks if text is not None and p[ALL] >= 0.5)


def extract_main_text(pages: DataFrame, labelled: list[str] | None = None, page_id: str = "page_id", url: str = "url",
                      html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; ``labelled``: pages to train on, by default the built-in ones."""
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([given.schema["page_id"], given.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    model = train(labelled if labelled is not None else labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = [main_text(source, model, known) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(given, run, schema)
