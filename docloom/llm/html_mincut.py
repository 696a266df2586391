"""Main text of web pages by minimum-cut labelling.

A page becomes text blocks with their places in the element tree. A classifier over tags, roles, names of enclosing
elements, link share, length and ending gives each block the log-odds of content against boilerplate, which
are the capacity of its edge to one of two terminals. Consecutive blocks, and consecutive blocks of one
container, are joined by edges that cost what it takes to label them differently, by their distance in the tree.
A minimum cut labels the blocks at the least total cost. Blocks whose log-odds outweigh all of their edges are
settled beforehand, which doesn't change the cut; what is left goes through augmenting paths of least length.

Terminal and edge costs are fitted on pages with known labels that the writers of ``html_training`` make, by the likelihood of
each block's label given its features, and given its neighbours' labels beside them, so both are log-odds. Features speak
one way: length, sentences, paragraphs and articles for content, links and telling names against it (SPEAKS); what a
writer's habits say to the contrary counts as nothing. No single name decides: a name of which only a part speaks for
boilerplate weighs less than one that does whole, and a form that holds most of a page's words is no form.

Pages are handled one by one where they are read; nothing is shuffled.

Defined results: a null or empty page, and a page without content, give an empty text. Repeated pages and pages
without page_id or url are extracted each on its own; an empty table gives an empty one; pages of any length are
read whole. Columns other than the three named play no part, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.columns import pick

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|\Z)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAMES = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")
END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}

BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head svg audio video canvas select datalist button".split())
#: An element that opens closes these at the top of the stack.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
PAGE_PARTS = frozenset("nav footer aside menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note".split())
APART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register sidebar rail aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar header comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations widget widgets tags skip search form copyright legal disclaimer".split()
)
OWN = frozenset("article content post entry story main body text".split())
#: Steps in the tree from which on two blocks count as equally far, and characters below which a block is a line.
FAR, LINE = 6, 60
#: What a line says that tells who owns the page.
OWNERS = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights reserved\b|\btous droits réservés\b|\balle rechte vorbehalten\b|\btodos los derechos reservados\b", re.I)


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    part: bool  # in a part of the page by tag, role or style
    whole: bool  # a name that speaks for boilerplate as a whole
    half: bool  # a name of which a part does
    article: bool
    own: bool
    form: Element | None = None  # the form it stands in


@dataclass
class Block:
    text: str
    at: Element
    linked: int
    in_form: bool = False


def names(attributes: str) -> tuple[list[set[str]], str, bool]:
    """The words of each class and of the id, the role, and whether the element is hidden."""
    words, role, hidden = [], "", False
    if "=" not in attributes and "hidden" not in attributes:
        return words, role, hidden
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            words += [{x.lower() for x in NAMES.findall(name)} for name in value.split()]
        elif key == "role":
            role = value.lower()
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "hidden" or value.lower() == "true":
            hidden = True
    return words, role, hidden


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; silent elements and comments are gone, references decoded."""
    root = Element("", None, 0, False, False, False, False, False)
    stack, found, parts, at, links, linked, mute = [root], [], [], 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, stack[-1], min(linked, len(text))))
            parts.clear()
        linked = 0

    def words(s: str) -> None:
        nonlocal linked
        if s and not mute:
            s = html.unescape(s)
            parts.append(s)
            if links:
                linked += len(s.strip())

    while (m := TOKEN.search(page, at)) is not None:
        words(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
            continue
        if not closing and tag in END:
            end = END[tag].search(page, at)
            at = end.start() if end else len(page)
            close = page.find(">", at)
            at = close + 1 if close >= 0 else len(page)
            continue
        if tag in SILENT:
            mute = max(0, mute - 1) if closing else mute + (not attributes.rstrip().endswith("/"))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        if tag in ("body", "article", "main"):
            mute = 0
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID or tag == "html":
            continue
        if stack[-1].tag == "p":
            stack.pop()
        while stack[-1].tag in CLOSES.get(tag, ()):
            stack.pop()
        up = stack[-1]
        seen, role, hidden = names(attributes)
        part = up.part or hidden or tag in PAGE_PARTS or role in ROLES or tag == "header" and not up.article
        whole, half = up.whole, up.half
        if tag not in ("body", "article", "main"):
            said = [x for x in seen if x & APART and not (up.article and "header" in x)]
            whole |= any(x <= APART for x in said)
            half |= any(not x <= APART for x in said)
        stack.append(Element(tag, up, up.depth + 1, part, whole, half, up.article or tag in ("article", "main"), up.own or any(x & OWN for x in seen), up.form))
        if tag == "form":
            stack[-1].form = stack[-1]
    words(page[at:])
    flush()
    held: dict[int, int] = {}
    for b in found:
        if b.at.form is not None:
            held[id(b.at.form)] = held.get(id(b.at.form), 0) + len(b.text) - b.linked
    most = sum(len(b.text) - b.linked for b in found) / 2
    for b in found:
        b.in_form = b.at.form is not None and held[id(b.at.form)] <= most
    return found


def features(b: Block) -> list[float]:
    e, n = b.at, len(b.text)
    return [
        1.0, min(1.0, n / 40), min(1.0, n / 150), b.linked / n, b.text[-1] in ".!?…。！？:;»\"”",
        e.tag in ("p", "blockquote", "pre"), e.tag[:1] == "h" and e.tag[1:].isdigit(), e.tag in ("li", "td", "th", "dt", "dd"),
        e.part or b.in_form, e.whole, e.half, e.article, e.own, n < 4 * LINE and not e.article and e.tag != "p" and OWNERS.search(b.text) is not None,
    ]


#: Which way each feature may speak: 1 for content, -1 against, 0 either.
SPEAKS = np.array([0, 1, 1, -1, 1, 1, 0, 0, -1, -1, -1, 1, 1, -1])


def steps(a: Element, b: Element) -> int:
    """Steps in the tree from one element to the other; FAR if there are more."""
    n = 0
    while a is not b and n < FAR:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        n += 1
    return n


#: Kinds of edges: steps in the tree, and one more for consecutive blocks of a container; each for blocks that are alike, of unlike length, and in elements of which only one is marked as a part of the page.
KINDS = 3 * (FAR + 2)


def marked(b: Block) -> bool:
    return b.at.part or b.at.whole or b.in_form


def unlike(a: Block, b: Block) -> int:
    return 2 if marked(a) != marked(b) else int((len(a.text) < LINE) != (len(b.text) < LINE))


def neighbours(page: list[Block]) -> list[tuple[int, int, int]]:
    """Pairs of blocks with an edge, and its kind."""
    edges: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}

    def join(i: int, j: int, kind: int) -> None:
        edges.append((i, j, kind + (FAR + 2) * unlike(page[i], page[j])))

    for i, b in enumerate(page):
        if i:
            join(i - 1, i, steps(page[i - 1].at, b.at))
        box = id(b.at.parent)
        if box in last and last[box] != i - 1:
            join(last[box], i, FAR + 1)
        last[box] = i
    return edges


@dataclass
class Costs:
    """Log-odds of content for each feature, and the costs of edges for each kind."""

    weights: np.ndarray
    edges: list[float]


@cache
def fitted() -> Costs:
    """Costs from labelled pages: a logistic regression of each block's label on its features, then one on its neighbours' labels by kind of edge, beside what the features say. An edge that would cost less than nothing costs nothing."""
    from docloom.llm.html_training import labelled_pages

    rows, labels, near = [], [], []
    for page, known in labelled_pages():
        found = blocks(page)
        side = [known[b.text[0]] for b in found]
        beside = np.zeros((len(found), KINDS))
        for i, j, kind in neighbours(found):
            beside[i, kind] += 2 * side[j] - 1
            beside[j, kind] += 2 * side[i] - 1
        for b in found:
            b.text = b.text[1:]
        rows += [features(b) for b in found]
        labels += side
        near.append(beside)
    x, beside, y = np.array(rows, float), np.concatenate(near), np.array(labels, float)
    weights = logistic(x, y, np.zeros(len(y)), SPEAKS)
    return Costs(weights, logistic(beside, y, x @ weights, np.ones(KINDS)).tolist())


def logistic(x: np.ndarray, y: np.ndarray, known: np.ndarray, speaks: np.ndarray) -> np.ndarray:
    """Weights of x beside known log-odds, with a unit penalty; Newton steps. A weight that would speak the wrong way is nothing, and the others are fitted without it."""
    free = np.ones(x.shape[1], bool)
    while True:
        w, part = np.zeros(int(free.sum())), x[:, free]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(known + part @ w, -30, 30)))
            w += np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.eye(len(w)), part.T @ (y - p) - w)
        wrong = w * speaks[free] < 0
        if not wrong.any():
            out = np.zeros(x.shape[1])
            out[free] = w
            return out
        free[np.flatnonzero(free)[wrong]] = False


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut; gain: capacity from the source if positive, to the sink if negative."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    gain, side = list(gain), [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if side[i] is not None or abs(gain[i]) < sum(near[i].values()):
            continue
        side[i] = gain[i] > 0
        for j, c in near[i].items():
            del near[j][i]
            gain[j] += c if side[i] else -c
            if side[j] is None:
                waiting.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        content = reached(rest, gain, near)
        for i in rest:
            side[i] = i in content
    return side


LEAST = 1e-12


def reached(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes on the source's side after a maximum flow: each round floods the residual edges in levels, then fills shortest paths until none is left."""
    out = {i: gain[i] for i in nodes if gain[i] > LEAST}
    into = {i: -gain[i] for i in nodes if gain[i] < -LEAST}
    while True:
        level, queue, ends = dict.fromkeys(out, 0), deque(out), False
        while queue:
            i = queue.popleft()
            ends |= i in into
            for j, c in near[i].items():
                if c > LEAST and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return set(level)
        todo = {i: iter(list(near[i])) for i in level}
        for start in list(out):
            path = [start]
            while path and start in out:
                i = path[-1]
                if i in into:
                    flow = min([out[start], into[i], *(near[a][b] for a, b in zip(path, path[1:], strict=False))])
                    for spent, at in ((out, start), (into, i)):
                        spent[at] -= flow
                        if spent[at] <= LEAST:
                            del spent[at]
                    cut = len(path)
                    for k in range(len(path) - 1, 0, -1):
                        a, b = path[k - 1], path[k]
                        near[a][b] -= flow
                        near[b][a] = near[b].get(a, 0.0) + flow
                        if near[a][b] <= LEAST:
                            cut = k
                    # go on from where the path is still open; a used-up sink or edge is passed over
                    path = path[:cut]
                    if cut > 1 and path[-1] == i and i not in into:
                        continue
                    continue
                for j in todo[i]:
                    if near[i].get(j, 0.0) > LEAST and level.get(j) == level[i] + 1:
                        # the edge may carry more later
                        todo[i] = _again(j, todo[i])
                        path.append(j)
                        break
                else:
                    path.pop()
                    if path:
                        next(todo[path[-1]], None)


def _again(first: int, rest: Iterator[int]) -> Iterator[int]:
    yield first
    yield from rest


def labels(found: list[Block], costs: Costs) -> list[bool]:
    gain = np.array([features(b) for b in found], float) @ costs.weights
    return minimum_cut(gain.tolist(), [(i, j, costs.edges[kind]) for i, j, kind in neighbours(found)])


def main_text(page: str | None, costs: Costs) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, k in zip(found, labels(found, costs), strict=True) if k)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    source, costs = pick(df, page_id=key, url=url, html=page), fitted()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), costs) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
