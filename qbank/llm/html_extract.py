"""Main text of web pages by a tree-structured graphical model.

A page's elements and text runs are the nodes of a tree of binary variables,
content or not.  Node potentials come from the tag, the words of class, id and
role, and the shape of the text below (length, links, sentence ends); each edge
has a parent-child potential, by kind of child.  Sum-product messages pass
upward and downward once, and give every node's content marginal exactly.  The
weights maximise the likelihood of labelled pages (a tree CRF, trained by
gradient on the same messages).  A bounded, generated set of labelled pages comes
with the module (``labelled.py``), and so do the weights that it gives
(``html_weights.json``); ``train`` takes any other pages.

Text runs whose marginal is at least one half are the page's text: character
references decoded, white space inside a block one space, blocks in page order.
Inline elements, buttons, formulas and drawings do not part a block; block
elements do.  Parsing takes time in proportion to the page, whatever it holds.

Defined results: null, empty and text-free html give an empty text; unclosed and
stray tags are taken as browsers take them, roughly; plain text without markup
is one block; repeated pages come out alike; other columns are not read.  Each
page is worked whole where it is read, without a shuffle.
"""

from __future__ import annotations

import html
import json
import math
import pkgutil
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from qbank.llm.common import text_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is no text of the page: code, controls to fill in, and what stands in for media that cannot be shown.
SILENT = frozenset("script style noscript template title textarea iframe object select datalist head canvas audio video desc metadata annotation annotation-xml".split())
RAW = frozenset("script style title textarea iframe noscript template".split())
#: They do not part a block: formatting, buttons, formulas, drawings, and silent ones that stand in the run of a text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark meter output picture progress q rb rp rt rtc ruby s samp slot small span "
    "strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction svg g path text tspan textpath use defs symbol rect circle ellipse line polyline polygon".split()
)
INLINE_SILENT = frozenset("script style title noscript template textarea iframe object select datalist canvas audio video desc metadata annotation annotation-xml".split())
#: An open element of the first kind ends where one of the second begins.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav form header footer".split())

OPEN = re.compile(r"/?[a-zA-Z][^\s/>]*|!--|!\[CDATA\[|[!?]")
#: What may end a tag: its bracket, or a quoted value that may hold one.
STOP = re.compile(r""">|=\s*+(["'])""")
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Where a name in camel case goes on with another word.
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SPACES = re.compile(r"\s+")
RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9-])", re.I) for tag in RAW}
#: References to numbers beyond Unicode, or with leading zeros.
LONG_NUMBER = re.compile(r"&#(?:0*([0-9]+)|[xX]0*([0-9a-fA-F]+));?")


def decoded(text: str) -> str:
    """Character references resolved; numbers beyond Unicode become the replacement sign, however long they are."""

    def short(m: re.Match) -> str:
        if m[1] is not None:
            return f"&#{m[1]};" if len(m[1]) < 8 else "\ufffd"
        return f"&#x{m[2]};" if len(m[2]) < 7 else "\ufffd"

    return html.unescape(LONG_NUMBER.sub(short, text)) if "&" in text else text


class Scanner:
    """Tags of a page in one pass: ``(start, end, name, attributes)``; name ``""`` for comments and the like.

    Quotes count after an equals sign only.  If a quoted value isn't closed, no
    quotes count from there on; a tag that is never closed is none, and ends where
    the next one begins.  So no part of a page is searched more than a few times.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def tag(self, at: int) -> tuple[int, int, str, str] | None:
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            m = OPEN.match(page, start + 1)
            if m is None:
                at = start + 1
                continue
            if m[0] == "!--":
                return start, self._after("-->", m.end()), "", ""
            if m[0] == "![CDATA[":
                return start, self._after("]]>", m.end()), "", ""
            if m[0] in "!?":
                return start, self._closed(m.end())[1], "", ""
            ends = m.end() <= self.last
            inner, end = self._closed(m.end())
            return start, end, m[0].lower() if ends else "", page[m.end() : inner] if ends else ""

    def _after(self, mark: str, at: int) -> int:
        end = self.page.find(mark, at)
        return len(self.page) if end < 0 else end + len(mark)

    def _closed(self, at: int) -> tuple[int, int]:
        page = self.page
        if at > self.last:
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            return end, end
        now = at
        while self.quotes:
            m = STOP.search(page, now)
            if m is None:
                self.quotes = False
            elif m[1] is None:
                return m.start(), m.end()
            else:
                now = page.find(m[1], m.end()) + 1
                self.quotes = now > 0
        end = page.find(">", at)
        return end, end + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the text of a raw element ends."""
        m = RAW_END[tag].search(self.page, at)
        if m is None:
            return len(self.page)
        end = self.page.find(">", m.end())
        return len(self.page) if end < 0 else end + 1


class Node:
    __slots__ = (
        "belief", "below", "chars", "children", "ends", "label", "link", "mark", "names", "own", "parent", "rest", "tag", "text", "up",
    )

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None) -> None:
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.text = ""
        self.chars = self.link = self.ends = 0
        self.own = self.up = self.belief = self.below = self.rest = 0.0
        self.mark: bool | None = None
        self.label: int | None = None


def parse(page: str) -> Node:
    """The page's tree: elements, and text runs (tag ``#``) as leaves."""
    root = Node("html", (), None)
    here, silent, anchor = root, 0, 0
    run: list[tuple[str, bool]] = []
    stack: list[Node] = [root]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    scopes = [0]

    def flush() -> None:
        if run:
            text = SPACES.sub(" ", decoded("".join(t for t, _ in run))).strip()
            if text:
                leaf = Node("#", (), here)
                leaf.text = text
                leaf.chars = len(text)
                leaf.link = sum(len(t) for t, a in run if a)
                leaf.ends = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?:…")
                here.children.append(leaf)
            run.clear()

    def close(at: int) -> None:
        nonlocal here, silent
        flush()
        while len(stack) > at:
            gone = stack.pop()
            places[gone.tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()
            silent -= gone.tag in SILENT
        here = stack[-1]

    scanner, at = Scanner(page), 0
    hidden: list[str] = []  # silent elements in the run of a text
    while True:
        found = scanner.tag(at)
        text = page[at : found[0] if found else len(page)]
        if text and not silent and not hidden:
            run.append((text, anchor > 0))
        if found is None:
            break
        _, at, tag, attributes = found
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if hidden:
                if tag == hidden[-1]:
                    hidden.pop()
                    continue
                if tag in INLINE or tag in INLINE_SILENT:
                    continue
                hidden.clear()  # the block around it ends
            if tag == "a":
                anchor = max(0, anchor - 1)
            if tag not in INLINE and places.get(tag):
                close(places[tag][-1])
            elif tag == "p":  # an empty paragraph
                flush()
            continue
        if tag in INLINE_SILENT and here.tag != "head":
            if tag in RAW:
                at = scanner.raw_end(tag, at)
            elif not attributes.rstrip().endswith("/"):
                hidden.append(tag)
            continue
        if hidden:
            continue
        if tag in INLINE:
            if tag == "br":
                run.append((" ", False))
            elif tag == "a":
                anchor += 1
            continue
        if tag in ("html", "body"):
            flush()
            if places.get("head"):
                close(places["head"][-1])
            continue
        flush()
        ends = ("p",) if tag in ENDS_P else ENDS.get(tag, ())
        last = max((places[t][-1] for t in ends if places.get(t)), default=0)
        if last > scopes[-1]:
            close(last)
        if tag in VOID:
            continue
        names = tuple(WORD.findall(HUMP.sub(" ", " ".join(a or b or c for a, b, c in NAMES.findall(attributes))).lower())) if attributes else ()
        node = Node(tag, names, here)
        if attributes and "data-content=" in attributes:
            node.mark = 'data-content="1"' in attributes
        here.children.append(node)
        anchor = 0
        if attributes.rstrip().endswith("/") and tag not in ENDS_P:
            continue
        if tag in RAW:
            at = scanner.raw_end(tag, at)
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(node)
        here = node
        silent += tag in SILENT
    flush()
    return root


def ordered(root: Node) -> list[Node]:
    """Parents before their children, in page order; sums of the text below are filled in."""
    out, going = [], [root]
    while going:
        node = going.pop()
        out.append(node)
        going += node.children[::-1]
    for node in reversed(out):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link += node.link
            node.parent.ends += node.ends
    return out


@lru_cache(maxsize=65536)
def _shape(chars: int, share: int, ends: int) -> tuple[str, ...]:
    size = min(6, chars.bit_length() // 2)
    return (f"s{size}", f"k{share}", f"e{min(ends, 3)}", f"s{size}k{share}")


def features(node: Node) -> list[str]:
    share = 0 if not node.link else 1 + min(3, 4 * node.link // max(1, node.chars))
    shape = _shape(min(node.chars, 4095), share, min(node.ends, 4))
    if node.tag == "#":
        up = node.parent.tag if node.parent is not None else ""
        return ["#", f"#{up}", *("#" + x for x in shape)]
    up = node.parent.tag if node.parent is not None else ""
    return [f"<{node.tag}", f"<{node.tag}^{up}", *("." + n for n in node.names), *("<" + x for x in shape)]


def kind(node: Node) -> int:
    """Edges differ by child: 0 a text run, a paragraph-like element, or any other element."""
    return 0 if node.tag == "#" else 1 if node.tag in ("p", "li", "h1", "h2", "h3", "h4", "td", "tr", "blockquote", "pre", "dd", "dt") else 2


@dataclass
class Model:
    """Weights of features, and of edges: by kind of child, its log potential of content with the parent off, and on."""

    weights: dict[str, float] = field(default_factory=dict)
    edges: list[list[float]] = field(default_factory=lambda: [[-1.0, 1.0] for _ in range(3)])
    bias: float = 0.0

    def potentials(self, nodes: list[Node]) -> None:
        get = self.weights.get
        for node in nodes:
            node.own = self.bias + sum(get(f, 0.0) for f in features(node))

    def marginals(self, nodes: list[Node]) -> None:
        """Log odds of content into ``belief``: sum-product upward, then downward, in log odds."""
        for node in nodes:
            node.belief = node.own
        for node in reversed(nodes):  # the messages from below are in ``belief``
            if node.parent is not None:
                w0, w1 = self.edges[kind(node)]
                node.below = node.belief
                node.up = _soft(node.belief + w1) - _soft(node.belief + w0)
                node.parent.belief += node.up
        for node in nodes:
            if node.parent is not None:
                w0, w1 = self.edges[kind(node)]
                node.rest = rest = node.parent.belief - node.up  # the parent without this child
                node.belief += _add(w0, rest + w1) - _soft(rest)


def _soft(x: float) -> float:
    """log(1 + e^x)"""
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def _add(a: float, b: float) -> float:
    return a + _soft(b - a)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def train(pages: Iterable[str], rounds: int = 10, rate: float = 0.5, decay: float = 2e-4) -> Model:
    """Maximum likelihood by stochastic gradient over labelled pages.

    Labels are ``data-content`` attributes, which hold for an element and what
    is below it up to the next one; an element without any label above it
    counts as content if most of its text is.
    """
    trees = []
    for page in pages:
        nodes = ordered(parse(page))
        for node in nodes:
            if node.mark is None and node.parent is not None:
                node.mark = node.parent.mark
        content = dict.fromkeys(map(id, nodes), 0)
        for node in reversed(nodes):
            if node.tag == "#":
                content[id(node)] = node.chars if node.mark else 0
            if node.parent is not None:
                content[id(node.parent)] += content[id(node)]
        for node in nodes:
            node.label = int(bool(node.mark)) if node.mark is not None else int(2 * content[id(node)] > node.chars)
        trees.append((nodes, [features(n) for n in nodes]))
    model, seen = Model(), {}
    for turn in range(rounds):
        for nodes, found in trees:
            model.potentials(nodes)
            model.marginals(nodes)
            step = rate / (1 + turn)
            for node, fs in zip(nodes, found, strict=True):
                slope = node.label - sigmoid(node.belief)
                if abs(slope) > 1e-4:
                    for f in fs:
                        seen[f] = seen.get(f, 1.0) + slope * slope
                        w = model.weights.get(f, 0.0)
                        model.weights[f] = w + step * slope / math.sqrt(seen[f]) - decay * step * w
                    model.bias += 0.02 * step * slope
                if node.parent is not None:
                    edge = model.edges[kind(node)]
                    on = [node.below + edge[0], node.rest + node.below + edge[1]]  # child on, parent off or on
                    total = _add(_add(on[0], on[1]), _soft(node.rest))
                    for state in (0, 1):
                        slope = (node.label and node.parent.label == state) - math.exp(on[state] - total)
                        edge[state] = max(-5.0, min(5.0, edge[state] + 0.05 * step * slope))
    return model


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes = ordered(parse(page))
    if all(n.tag == "#" for n in nodes[1:]):  # no markup
        return "\n".join(n.text for n in nodes[1:])
    model.potentials(nodes)
    model.marginals(nodes)
    return "\n".join(n.text for n in nodes if n.tag == "#" and n.belief >= 0)


#: The weights that ``trained()`` gives, as a file beside this module; written by ``python -m qbank.llm.html_extract``.
WEIGHTS = "html_weights.json"


def trained(pages: int = 1400, seed: int = 5) -> Model:
    """The model of the generated labelled pages; ``pages`` bounds the sample."""
    from qbank.llm.labelled import labelled_pages

    model = train(labelled_pages(pages, seed))
    near = lambda x: round(x, 6)
    return Model({k: near(v) for k, v in sorted(model.weights.items())}, [[near(x) for x in e] for e in model.edges], near(model.bias))


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The trained model, from its file."""
    held = json.loads(pkgutil.get_data(__package__, WEIGHTS))
    return Model(held["weights"], held["edges"], held["bias"])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = model or default_model()
    names = ["page_id", "url", "text", "n_chars"]

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in got:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [extract(x, model) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names
                )

    rows = text_batches(pages).select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    model = trained()
    Path(__file__).with_name(WEIGHTS).write_text(json.dumps({"bias": model.bias, "edges": model.edges, "weights": model.weights}, indent=0) + "\n")
