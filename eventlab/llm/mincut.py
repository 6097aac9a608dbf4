"""Main text of web pages: a minimum cut between content and boilerplate over the blocks of a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

# Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg iframe select option button textarea".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
# Of these the page goes on where they are not ended, or where a tag stands that cannot be inside.
SOFT = frozenset("title iframe noscript".split())
PAGE = frozenset("html head body article main".split())
IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Words of classes, ids and roles that tell a block's part on many sites.
_FOREIGN = (
    "nav navi navigation menu sidebar footer masthead banner cookie consent gdpr notice advert advertisement advertising ad adv sponsor sponsored "
    "promo promotion popup modal overlay newsletter subscribe subscription subscriber signup login search breadcrumb paginate pagination paginator pager "
    "share sharing social related recommend recommended recommendation readmore widget toolbar topbar copyright disclaimer complementary header skip alert legal "
    "outbrain taboola dfp"
).split()
_REMARKS = "comment disqus reply replies respond discussion guestbook".split()


def _words(names: list[str], more: str = "") -> re.Pattern:
    """Whole words, alone or with what often stands before or behind them without a gap; not what is free of them."""
    front = "top|main|site|sub|side|left|right|page|mobile|mega|google|text|post|article|user|reader"
    behind = "s|es|bar|box|list|links?|form|field|wrap|wrapper|area|block|buttons?|container|unit|slot|left|right|section|thread|body|meta"
    return re.compile(rf"\b(?:(?:{front})?(?:{'|'.join(names)})(?:{behind})?{more})\b(?! free\b)")


FOREIGN = _words(_FOREIGN, "|side bar|sign up|log in|read more|top bar")
REMARKS = _words(_REMARKS)
OWN = re.compile(r"article|\bmain\b|content|\bpost\b|\bentry\b|story|\bprose\b|body text")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_\d]+")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_HIDING = re.compile(r"hidden|style", re.I)
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none(?![\w-])", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:"[^"]*"|'[^']*')?)*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)

# Blocks whose part is known, to train the classifier from: (where it stands, tag, characters, share of them
# in links, ends like a sentence, the page marks its own text elsewhere, own text).
# Where: a article or main, o named like one, n nav, footer or aside, f named like page furniture,
# c remarks of readers, h header, m a form; capitals are blocks of a list.
LABELLED = [
    ("a", "p", 900, 0.0, 1, 0, 1), ("a", "p", 300, 0.1, 1, 0, 1), ("a", "p", 60, 0.0, 1, 0, 1), ("a", "p", 12, 0.0, 1, 0, 1),
    ("a", "h1", 60, 0.0, 0, 0, 1), ("a", "h2", 30, 0.0, 0, 0, 1), ("a", "li", 40, 0.0, 0, 0, 1), ("a", "td", 8, 0.0, 0, 0, 1),
    ("a", "blockquote", 200, 0.0, 1, 0, 1), ("a", "p", 8, 0.0, 0, 0, 1), ("a", "li", 25, 1.0, 0, 0, 1), ("ah", "h1", 50, 0.0, 0, 0, 1),
    ("ah", "p", 150, 0.0, 1, 0, 1), ("a", "pre", 120, 0.0, 0, 0, 1), ("a", "figcaption", 60, 0.0, 1, 0, 1), ("a", "div", 40, 0.0, 1, 0, 1),
    ("ao", "p", 400, 0.05, 1, 0, 1), ("ao", "p", 15, 0.0, 1, 0, 1), ("o", "p", 500, 0.0, 1, 0, 1), ("o", "p", 20, 0.0, 1, 0, 1),
    ("o", "h1", 50, 0.0, 0, 0, 1), ("o", "li", 30, 0.0, 0, 0, 1), ("o", "h2", 20, 0.0, 0, 0, 1), ("", "p", 700, 0.0, 1, 0, 1),
    ("", "p", 250, 0.1, 1, 0, 1), ("", "p", 90, 0.0, 1, 0, 1), ("", "h1", 60, 0.0, 0, 0, 1), ("", "div", 600, 0.05, 1, 0, 1),
    ("", "p", 40, 0.0, 1, 0, 1), ("", "blockquote", 150, 0.0, 1, 0, 1),
    ("n", "li", 8, 1.0, 0, 1, 0), ("n", "li", 20, 1.0, 0, 0, 0), ("n", "p", 200, 0.1, 1, 1, 0), ("n", "div", 60, 0.0, 1, 1, 0),
    ("n", "footer", 80, 0.2, 1, 1, 0), ("n", "p", 400, 0.0, 1, 0, 0), ("an", "p", 200, 0.0, 1, 0, 0), ("an", "li", 20, 1.0, 0, 0, 0),
    ("an", "p", 60, 0.0, 1, 0, 0), ("f", "div", 80, 0.0, 1, 1, 0), ("f", "p", 300, 0.0, 1, 1, 0), ("f", "div", 60, 0.2, 1, 0, 0),
    ("f", "p", 250, 0.1, 1, 0, 0), ("af", "div", 90, 0.0, 1, 0, 0), ("af", "p", 250, 0.0, 1, 0, 0), ("of", "p", 120, 0.1, 1, 0, 0),
    ("af", "li", 30, 1.0, 0, 0, 0), ("c", "p", 300, 0.0, 1, 1, 0), ("c", "p", 40, 0.0, 1, 1, 0), ("c", "div", 100, 0.0, 1, 0, 0),
    ("ac", "p", 300, 0.0, 1, 0, 0), ("ac", "li", 90, 0.0, 1, 0, 0), ("oc", "p", 200, 0.0, 1, 0, 0), ("c", "h3", 15, 0.0, 0, 1, 0),
    ("h", "h1", 20, 1.0, 0, 1, 0), ("h", "p", 60, 0.0, 0, 1, 0), ("h", "div", 30, 0.5, 0, 0, 0), ("h", "p", 90, 0.0, 1, 1, 0),
    ("m", "div", 40, 0.0, 0, 1, 0), ("m", "p", 120, 0.0, 1, 0, 0), ("am", "p", 80, 0.0, 1, 0, 0), ("am", "div", 20, 0.0, 0, 0, 0),
    ("", "div", 20, 1.0, 0, 1, 0), ("", "p", 60, 0.0, 1, 1, 0), ("", "div", 15, 0.0, 0, 1, 0), ("", "p", 250, 0.0, 1, 1, 0),
    ("", "li", 15, 1.0, 0, 0, 0), ("", "div", 12, 0.9, 0, 0, 0), ("", "div", 25, 0.0, 0, 0, 0), ("", "td", 10, 1.0, 0, 0, 0),
    ("af", "p", 700, 0.0, 1, 0, 0), ("an", "p", 600, 0.0, 1, 0, 0), ("ac", "p", 900, 0.0, 1, 0, 0), ("am", "label", 30, 0.0, 0, 0, 0),
]
NEAR = 0.5  # smoothness between neighbours in the page
AKIN = 0.7  # and between neighbours under one parent


def _features(where: str, tag: str, size: int, links: float, ends: bool, elsewhere: bool) -> list[float]:
    has = lambda x: float(x in where)
    return [
        1.0, has("a"), has("o"), has("n"), has("f"), has("c"), has("m"), float("h" in where and "a" not in where), links,
        float(np.log1p(size)) / 4, float(ends), float(tag in ("h1", "h2", "h3")), float(tag in ("p", "blockquote", "pre")),
        float(tag == "li"), float(elsewhere), links * has("a"),
    ]


def classifier() -> list[float]:
    """Weights of a logistic regression on the labelled blocks."""
    x = np.array([_features(*row[:6]) for row in LABELLED])
    y = np.array([row[6] for row in LABELLED], float)
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) + 0.02 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(w)), grad)
    return w.tolist()


def _hidden(attrs: str) -> bool:
    """Whether the attributes of an element, read by name (the first of each counts), keep it from being shown."""
    named: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attrs):
        quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
        named.setdefault(name.lower(), unescape(value[1:-1] if quoted else value))
    return "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(named.get("style", "")))


def _tokens(html: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """(text, tag, whether it ends, attributes, place behind it) in order; text has no tag.

    Behind the last ``>`` there is no tag to look for, so that part is text, up to a comment.
    """
    last, token = html.rfind(">") + 1, None
    for token in _TOKEN.finditer(html, 0, last):
        name, s = token[2] or token[5], token[0]
        if name is not None:
            yield "", name.lower(), (token[1] or token[4]) == "/", token[3] or token[6] or "", token.end()
        elif s[0] != "<" or s == "<":
            yield s, "", False, "", token.end()
    if last < len(html) and (token is None or not token[0].startswith("<!--") or token[0].endswith("-->")):
        yield html[last:len(html) if (at := html.find("<!--", last)) < 0 else at], "", False, "", len(html)


def blocks(html: str) -> list[tuple]:
    """(text, tag, where, share of characters in links, number of the parent) of each block of a page, in order."""
    out: list[tuple] = []
    # Open elements: tag, where, unseen, in a link, and of the nearest block element: tag, where, number, number of the one around it.
    stack: list[tuple] = [("", "", False, False, ("", "", 0, 0))]
    opened: dict[str, int] = {}
    text: list[str] = []
    linked = 0
    number = 0
    skip = ""
    ended: dict[str, int] = {}  # where the next end tag of a soft element is, as far as looked for
    small = ""

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                tag, where, _, around = stack[-1][4]
                out.append((joined, tag, where, min(1.0, linked / len(joined)), around))
            text.clear()
            linked = 0

    def close(tag: str) -> None:
        while len(stack) > 1:
            top = stack.pop()
            opened[top[0]] -= 1
            if top[0] == tag:
                break

    for s, tag, end, attrs, behind in _tokens(html):
        if not tag:
            if skip:
                continue
            if stack[-1][0] == "head" and s.strip():
                close("head")
            if not stack[-1][2]:
                text.append(s)
                if stack[-1][3]:
                    linked += len(s.strip())
            continue
        if skip:  # inside script and the like only its own end counts
            if end and tag == skip:
                skip = ""
            if end and tag not in PAGE or not (skip in SOFT and (tag in PAGE or tag == skip)):
                continue
            skip = ""
        if end:
            if tag in BLOCKS:
                flush()
            if opened.get(tag):
                close(tag)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if opened.get("head") and tag not in IN_HEAD:
            close("head")
        if tag == "a" and stack[-1][0] == "a":
            close("a")
        if tag in BLOCKS:
            flush()
            if opened.get("p"):
                close("p")
            for other in CLOSES.get(tag, ()):
                if opened.get(other) and stack[-1][0] == other:
                    close(other)
        if tag in VOID:
            continue
        if tag in RAW:
            if tag in SOFT and 0 <= ended.get(tag, 0) < behind:
                small = small or html.lower()
                ended[tag] = small.find(f"</{tag}", behind)
            if ended.get(tag, 0) >= 0:
                skip = tag
            continue
        _, where, unseen, link, block = stack[-1]
        if tag in ("article", "main"):
            where += "a"
        elif tag in ("nav", "footer", "aside"):
            where += "n"
        elif tag == "form":
            where += "m"
        elif tag == "header":
            where += "h"
        if attrs and tag not in ("body", "html"):
            named = " ".join(x.strip("\"'") for x in _NAMED.findall(attrs))
            if named:
                named = _CAMEL.sub(" ", named).lower()
                if REMARKS.search(named):
                    where += "c"
                elif FOREIGN.search(named) and tag not in ("article", "main"):
                    where += "h" if "a" in where and "header" in named else "f"
                elif OWN.search(named):
                    where += "o"
            unseen = unseen or bool(_HIDING.search(attrs)) and _hidden(attrs)
        if tag in BLOCKS:
            number += 1
            block = (tag, where, number, block[2])
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, where, unseen or tag in UNSEEN, link or tag == "a", block))
    flush()
    return out


def cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut.

    ``gain`` is a node's capacity from the source less that to the sink (what both share flows
    straight through). Edges have one capacity both ways. Flow goes over single edges
    first, then in phases: levels by distance from nodes with something left to give, and from
    each of them depth first along rising levels to nodes that can take, where no arc is tried twice.
    """
    n = len(gain)
    left = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    tiny = 1e-9
    for i in range(n):
        for j, c in near[i].items():
            if left[i] <= tiny:
                break
            if left[j] < -tiny:
                flow = min(left[i], -left[j], c)
                left[i] -= flow
                left[j] += flow
                near[i][j] -= flow
                near[j][i] += flow
    while True:
        level = {i: 0 for i in range(n) if left[i] > tiny}
        givers, front, met = list(level), list(level), False
        while front and not met:
            further = []
            for i in front:
                for j, c in near[i].items():
                    if c > tiny and j not in level:
                        level[j] = level[i] + 1
                        further.append(j)
                        met = met or left[j] < -tiny
            front = further
        if not met:
            return [i in level for i in range(n)]
        arcs: dict[int, list[int]] = {}  # those of a node that are not used up, the one in use last
        for giver in givers:
            path = [giver]
            while left[giver] > tiny:
                i = path[-1]
                if left[i] < -tiny:
                    flow = min(left[giver], -left[i], *(near[a][b] for a, b in zip(path, path[1:])))
                    left[giver] -= flow
                    left[i] += flow
                    full = len(path)
                    for k in range(len(path) - 2, -1, -1):
                        a, b = path[k], path[k + 1]
                        near[a][b] -= flow
                        near[b][a] += flow
                        if near[a][b] <= tiny:
                            full = k + 1
                    del path[full:]
                    continue
                if i not in arcs:
                    arcs[i] = [j for j in near[i] if level.get(j) == level[i] + 1]
                while arcs[i] and near[i][arcs[i][-1]] <= tiny:
                    arcs[i].pop()
                if arcs[i]:
                    path.append(arcs[i][-1])
                    continue
                path.pop()
                if not path:
                    break
                arcs[path[-1]].pop()


def main_blocks(html: str, weights: list[float]) -> list[str]:
    """Blocks of the content side."""
    found = blocks(html)
    marked = any("a" in b[2] and not set(b[2]) & set("nfcm") for b in found)
    gain = []
    for text, tag, where, links, _ in found:
        elsewhere = marked and "a" not in where
        f = _features(where, tag, len(text), links, text[-1] in ".!?\"'”’»…:;", elsewhere)
        gain.append(sum(a * b for a, b in zip(f, weights)))
    edges, before = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR if found[i - 1][2] == b[2] else NEAR / 5))
        if b[4] in before:
            edges.append((before[b[4]], i, AKIN if found[before[b[4]]][2] == b[2] else AKIN / 5))
        before[b[4]] = i
    return [b[0] for b, own in zip(found, cut(gain, edges)) if own]


def extracted(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``text``, the main text of a page, and ``n_chars``; columns of these names are replaced.

    A page is cut into blocks at block elements; character references are decoded, white
    space within a block becomes one space. A logistic regression on where a block stands, its
    length and its links gives each block's capacities to the two
    terminals; neighbours in the page and under one parent are tied. The blocks on
    the content side of the minimum cut are joined by line feeds. Null, empty and
    broken pages give what text there is, at least the empty one. Rows stay as they are; no shuffle.
    """
    added = ["text", "n_chars"]
    kept = [c for c in df.columns if c not in added]
    base = df.select(*[f"`{c}`" for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), "text string, n_chars bigint"])
    weights = classifier()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pages = batch.column(kept.index(html))
        texts = ["\n".join(main_blocks(p.as_py() or "", weights)) for p in pages]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, *added])

    return in_arrow(base, schema, run)
