"""Operator 3, HTML extraction: a tree-structured graphical model over the DOM.

Each element that is more than inline markup is a node, content or not. A node's potential adds up weights of
its tag, of the words of its class, id and role, and of the length, links and sentences of its text; one more
table of potentials joins every node to its parent. Sum-product messages pass up and down the tree once, and
what stands in nodes whose content marginal is at least one half is the main text.

Weights are learned from labelled pages (``labelled_pages.py`` holds the ones used here: layouts with an article
among menus, headers, footers, sidebars, notices, adverts, forms and reader comments, each element marked),
by the gradient of the likelihood, whose expectations the same messages give.

Pages are independent rows: parsing, messages and text happen where the page lies, without a shuffle. A page's
work is linear in its length.

Defined results: null, empty and textless pages give an empty text. Open elements end with the page; stray end
tags and broken tags are skipped or taken as text. Character references are decoded once, in texts. Repeated rows
give equal rows. Other columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmill.llm.labelled_pages import STEMS, labelled_pages
from prefmill.llm.tables import map_batches

# A quote opens a value only after an equals sign; one that never closes is plain text of its tag.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S
)
#: What markup there can be after the last ``>`` of a page.
_UNENDED = re.compile(r"<!--.*\Z|<[!?][^>]*+\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|data-y|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])", re.I)
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)\]]?\s*$")

# Fixed values of the markup language: elements without content, with raw text, without readable text, and inline.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNREAD = frozenset("script style textarea title iframe noembed noframes template noscript select button svg math object canvas audio video head".split())
#: Elements that stay in an open head; any other, and text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
FOREIGN = frozenset(["svg", "math"])
#: Elements that hold ordinary markup again inside foreign ones.
_ORDINARY = frozenset("foreignobject desc title annotation-xml".split())
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I | re.A) for name in RAW}
# A slash at the end of an unquoted value belongs to the value.
_SLASH_OF_VALUE = re.compile(r"=\s*[^\s\"']*/\Z")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Start tags that end an open element of the same group, up to the element that holds the group.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


_known_marks: dict[tuple[str, str], tuple[str, ...]] = {}


def _marks_of(kind: str, word: str) -> tuple[str, ...]:
    """A word of a name, and known words that it contains."""
    found = _known_marks.get((kind, word))
    if found is None:
        plain = word.lower().removesuffix("s")
        found = (kind + plain, *(kind + stem for stem in STEMS if stem in plain and stem != plain))
        if len(_known_marks) < 100_000:
            _known_marks[kind, word] = found
    return found


class _Open:
    """Open elements, outermost first, and at which depths each name is open; the innermost of some names is found without a search."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.depths: dict[str, list[int]] = {}

    def push(self, name: str, node: int) -> None:
        self.depths.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, node))

    def pop(self) -> tuple[str, int]:
        name, node = self.stack.pop()
        self.depths[name].pop()
        return name, node

    def innermost(self, *names: str) -> int:
        """The depth of the innermost open element of these names; 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def in_foreign(self) -> bool:
        """Whether the innermost element that decides it is foreign markup."""
        return self.innermost(*FOREIGN) > self.innermost(*_ORDINARY)


class Page:
    """Nodes in page order: parent, tag, words of attributes, own text; and the text pieces with their nodes."""

    def __init__(self, html: str):
        self.parent, self.tag, self.marks, self.label = [-1], ["#page"], [()], [None]
        self.own, self.linked = [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        open_ = _Open()
        stack = open_.stack  # open elements and the nodes their text belongs to
        unread = anchors = 0
        at, n = 0, len(html)
        last = html.rfind(">")  # no tag ends after it, so none is looked for there
        while at < n:
            found = (_MARKUP if at <= last else _UNENDED).search(html, at)
            start = found.start() if found else n
            if unread and start > at and stack[-1][0] == "head" and html[at:start].strip():
                unread, anchors = self._close(open_, len(stack) - 1, unread, anchors)
            if start > at and not unread:
                self._text(stack[-1][1], html[at:start], anchors > 0)
            if not found:
                break
            at = found.end()
            name = (found[2] or "").lower() if found.re is _MARKUP else ""
            if not name:
                continue
            if found[1]:
                depth = open_.innermost(name)
                if depth:
                    unread, anchors = self._close(open_, depth, unread, anchors)
                elif name in ("p", "br"):
                    self._gap(stack[-1][1])
                continue
            if unread and name not in IN_HEAD:
                depth = open_.innermost("head")
                if depth and (name == "body" or open_.innermost("template", "noscript") < depth):
                    unread, anchors = self._close(open_, depth, unread, anchors)
            if name in CLOSES_P:
                depth = open_.innermost("p")
                if depth and open_.innermost("td", "th", "button", "object") < depth:
                    unread, anchors = self._close(open_, depth, unread, anchors)
            if name in SIBLINGS:
                same, within = SIBLINGS[name]
                while (depth := open_.innermost(*same)) > open_.innermost(*within):
                    unread, anchors = self._close(open_, depth, unread, anchors)
                    if name != "tr":
                        break
            if name in VOID:
                if name in ("br", "hr"):
                    self._gap(stack[-1][1])
                continue
            attributes = found[3]
            if attributes.endswith("/") and (name in FOREIGN or (unread and open_.in_foreign())) and not _SLASH_OF_VALUE.search(attributes):
                continue
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                at = end.start() if end else n
            unread += name in UNREAD
            anchors += name == "a"
            node = stack[-1][1]
            if name not in INLINE or (name in ("span", "ins") and attributes and ("class" in attributes or "id" in attributes)):
                if name not in INLINE:
                    self._gap(node)
                node = self._node(node, name, attributes)
            open_.push(name, node)

    def _close(self, open_: _Open, depth: int, unread: int, anchors: int) -> tuple[int, int]:
        for name, node in open_.stack[depth:]:
            unread -= name in UNREAD
            anchors -= name == "a"
            if name not in INLINE:
                self._gap(node)
        while len(open_.stack) > depth:
            open_.pop()
        return unread, anchors

    def _node(self, parent: int, tag: str, attributes: str) -> int:
        marks, label = [], self.label[parent]
        if "hidden" in attributes and _HIDDEN.search(attributes):
            marks.append("is:hidden")
        if "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "data-y":
                    label = value == "1"
                elif key == "style":
                    marks += ["is:hidden"] * bool(_UNSHOWN.search(value))
                else:
                    marks += [mark for w in _PARTS.findall(value) for mark in _marks_of("role:" if key == "role" else "w:", w)]
        self.parent.append(parent)
        self.tag.append(tag)
        self.marks.append(tuple(dict.fromkeys(marks)))
        self.label.append(label)
        self.own.append(0)
        self.linked.append(0)
        return len(self.parent) - 1

    def _gap(self, node: int) -> None:
        self.pieces.append((node, " "))

    def _text(self, node: int, raw: str, linked: bool) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append((node, text))
        size = len(text.strip())
        self.own[node] += size
        if linked:
            self.linked[node] += size

    def features(self) -> list[list[str]]:
        n = len(self.parent)
        total, links = self.own[:], self.linked[:]
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += total[i]
            links[self.parent[i]] += links[i]
        ends = [False] * n
        for node, text in self.pieces:
            if text != " " and text.strip():
                ends[node] = bool(_SENTENCE.search(text[-8:]))
        before = 0
        whole = max(1, total[0])
        rights = [False] * n
        for node, text in self.pieces:
            if "©" in text or "(c)" in text.lower()[:40]:
                rights[node] = True
        out = []
        for i in range(n):
            own, size = self.own[i], total[i]
            row = ["tag:" + self.tag[i], f"own:{_bin(own)}", f"size:{_bin(size)}", *self.marks[i]]
            if not self.marks[i]:
                row.append("bare:" + self.tag[i])
            row.append(f"links:{0 if not size else min(3, 4 * links[i] // size)}{size > 0}")
            if own:
                row.append(f"sentence:{ends[i]}:{_bin(own) > 2}")
                row.append(f"linked:{2 * self.linked[i] > own}")
                if rights[i]:
                    row.append("rights")
            row.append(f"place:{min(3, 4 * before // whole)}")
            row.append(f"share:{min(3, 4 * size // whole)}")
            before += own
            out.append(row)
        return out

    def text(self, marginal: list[float]) -> str:
        keep = [p >= 0.5 for p in marginal]
        joined = "".join(text if keep[node] else " " for node, text in self.pieces)
        return " ".join(joined.split())


def _bin(size: int) -> int:
    return 0 if size == 0 else 1 if size < 20 else 2 if size < 60 else 3 if size < 150 else 4 if size < 600 else 5


@dataclass(frozen=True)
class Model:
    """Log-potentials: of a node being content, by feature; of (parent, child) states."""

    weights: dict[str, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]


def marginals(parent: list[int], potential: list[float], pairs: tuple[tuple[float, float], tuple[float, float]]) -> list[float]:
    """Each node's content marginal by one pass of messages up the tree and one down; parents come before children."""
    n = len(parent)
    (e00, e01), (e10, e11) = [[exp(x) for x in row] for row in pairs]
    belief0, belief1 = [1.0] * n, [exp(max(-30.0, min(30.0, u))) for u in potential]
    up0, up1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        b0, b1 = belief0[i], belief1[i]
        scale = b0 + b1
        b0, b1 = b0 / scale, b1 / scale
        belief0[i], belief1[i] = b0, b1
        m0, m1 = e00 * b0 + e01 * b1, e10 * b0 + e11 * b1
        m0, m1 = m0 / (m0 + m1), m1 / (m0 + m1)
        up0[i], up1[i] = m0, m1
        p = parent[i]
        # A node with very many children would leave the range of floats; beliefs are kept in proportion.
        q0, q1 = belief0[p] * m0, belief1[p] * m1
        if q0 + q1 < 1e-200:
            q0, q1 = q0 * 1e200, q1 * 1e200
        belief0[p], belief1[p] = max(q0, 1e-300), max(q1, 1e-300)
    out = [0.0] * n
    out[0] = belief1[0] / (belief0[0] + belief1[0])
    for i in range(1, n):
        p = out[parent[i]]
        rest0, rest1 = (1 - p) / max(up0[i], 1e-300), p / max(up1[i], 1e-300)
        m0, m1 = rest0 * e00 + rest1 * e10, rest0 * e01 + rest1 * e11
        b0, b1 = belief0[i] * m0, belief1[i] * m1
        out[i] = b1 / max(1e-300, b0 + b1)
    return out


def _labelled(pages: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """All nodes of the pages: features, label, parent and depth; roots have parent -1."""
    features, labels, parents, depths = [], [], [], []
    for html in pages:
        page = Page(html)
        n, base = len(page.parent), len(labels)
        good = [0] * n
        for i in range(n - 1, -1, -1):
            good[i] += page.own[i] * (page.label[i] is True)
            if i:
                good[page.parent[i]] += good[i]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[page.parent[i]] + 1
        features += page.features()
        labels += [(page.label[i] is True) if page.own[i] else good[i] > 0 for i in range(n)]
        parents += [-1, *(base + page.parent[i] for i in range(1, n))]
        depths += depth
    return features, np.array(labels, np.int64), np.array(parents), np.array(depths)


def train(pages: list[str] | None = None, rounds: int = 250, rate: float = 0.2, ridge: float = 1e-5) -> Model:
    """Weights from pages whose elements carry ``data-y`` (1 content, 0 not; inherited by what they hold).

    A node with text of its own takes its mark; one without is content if any text below it is. The
    likelihood of all labels is raised by its gradient: what is seen less what the marginals expect. Messages of
    all pages go up and down together, depth by depth.
    """
    features, y, parent, depth = _labelled(labelled_pages() if pages is None else pages)
    names = {f: k + 1 for k, f in enumerate(dict.fromkeys(f for row in features for f in row))}
    ids = np.zeros((len(y), max(map(len, features))), np.int64)
    for i, row in enumerate(features):
        ids[i, : len(row)] = [names[f] for f in row]
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    child = parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[child]], y[child]), 1)
    size = 1 + len(names)
    w, first, second = np.zeros(size + 4), 0.0, 0.0
    for t in range(1, rounds + 1):
        w[0] = 0.0
        pairs = np.exp(w[size:].reshape(2, 2))
        log_belief = np.column_stack([np.zeros(len(y)), w[ids].sum(1)])
        up = np.ones((len(y), 2))
        for nodes in levels[:0:-1]:
            message = _normal(np.exp(log_belief[nodes] - log_belief[nodes].max(1, keepdims=True))) @ pairs.T
            up[nodes] = _normal(message)
            for state in (0, 1):
                log_belief[:, state] += np.bincount(parent[nodes], np.log(up[nodes, state]), minlength=len(y))
        belief = _normal(np.exp(log_belief - log_belief.max(1, keepdims=True)))
        marginal = belief.copy()
        expected = np.zeros((2, 2))
        for nodes in levels[1:]:
            rest = marginal[parent[nodes]] / up[nodes]
            joint = rest[:, :, None] * pairs[None] * belief[nodes][:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            marginal[nodes] = joint.sum(1)
            expected += joint.sum(0)
        error = y - marginal[:, 1]
        slope = np.concatenate([np.bincount(ids.reshape(-1), np.repeat(error, ids.shape[1]), minlength=size), (seen - expected).reshape(-1)])
        slope = slope / len(y) - ridge * w
        slope[0] = 0.0
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8) * min(1.0, 60 / t)
    table = w[size:]
    return Model({f: float(w[k]) for f, k in names.items()}, ((float(table[0]), float(table[1])), (float(table[2]), float(table[3]))))


def _normal(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1e-300)
    return x / x.sum(1, keepdims=True)


def main_text(html: str | None, model: Model) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    weight = model.weights.get
    potential = [sum([weight(f, 0.0) for f in row]) for row in page.features()]
    return page.text(marginals(page.parent, potential, model.pairs))


def extract(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(batch.column(2)[i].as_py(), model) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    chosen = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return map_batches(chosen, run, "page_id long, url string, text string, n_chars long")
