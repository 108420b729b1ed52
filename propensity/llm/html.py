"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with its root-to-leaf path of tags (inline tags left
out).  Only what isn't shown is left out at once: scripts, styles, the head, comments of the
markup, hidden elements.  All other blocks, of menus as of articles, are scored:

* ratio: for each path, text length and punctuation are aggregated over its nodes in the
  whole page, and ``length / nodes * (1 + ln(1 + punctuation / nodes))`` scores the path;
* smooth: the blocks of one container (the nearest sectioning element that holds more than
  one block, so that a wrapper of a single block isn't one) share the mean of their paths'
  ratios, weighted by length, so a heading stands with the paragraphs it heads; an ``article``
  or ``main`` element is one container;
* fuse: a block's score is the larger of its path's ratio and its container's, times the prior
  weight of the elements around it: ``DECLARED`` inside ``article`` or ``main``, ``AWAY`` for tags and
  roles of menus, headers, footers, sidebars, notices and forms (a header inside an article heads
  it), ``DOUBTFUL`` for class and id names that speak of adverts, comments and the like.  An article
  that isn't inside such a tag, a comment or a list of related pages starts anew, whatever the names around it;
* threshold: blocks that reach ``THRESHOLD`` of the best container, and ``LEAST``, are content.
  The best container is the one with the largest weighted ratio times its share of the page's text.

All content blocks are returned in page order: character references decoded,
white space turned into one space, blocks joined by an empty line.  One pass over the
pages, without a shuffle.

Defined results: null or empty html, and pages without text outside menus and the like, give
an empty string; unclosed and truncated markup is read as far as it goes; each of several equal
rows gets the same result; ``extract`` is a column, so all other columns, whatever their names,
stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.2
LEAST = 1.0
DECLARED, DOUBTFUL, AWAY = 50.0, 0.02, 0.001

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|noscript|textarea|title|svg|math|iframe|object|select)\b"
    r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"""([a-z][a-z0-9_:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PUNCT = re.compile(r"[.,;:!?…¿¡。、，！？；：]")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
           "tt", "u", "var", "br", "img", "wbr"}
_SECTION = {"html", "body", "article", "main", "section", "div", "td", "form", "aside", "nav", "header", "footer"}
#: An opening tag of the key ends an open element of these, inside the nearest of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Tags, roles and words of class and id names that lower a block's weight.
AWAY_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog",
              "menu", "menubar", "toolbar", "form", "status"}
DOUBTFUL_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header",
    "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "comment", "comments", "disqus", "replies", "share", "sharing", "social", "related", "recommended", "newsletter",
    "subscribe", "subscription", "signup", "login", "toolbar", "pagination", "pager", "widget", "skip", "aside"}
#: Names of what holds articles of its own, and of such articles.
FOREIGN_NAMES = {"comment", "comments", "reply", "replies", "disqus", "teaser", "promo", "related", "recommended"}
_FOREIGN_TAGS = {"nav", "aside", "footer"}
_HEADS = {"header", "masthead", "banner"}  # inside an article they hold its title


class _Node:
    """An open element: its path's number, the prior weight of its blocks, the outermost article
    around it (``own``) and the innermost section, with the section around that."""

    __slots__ = ("tag", "parent", "path", "weight", "own", "section", "foreign", "hidden", "block")

    def __init__(self, tag: str, parent: "_Node | None", attrs: str, paths: dict):
        self.tag, self.parent = tag, parent
        inline = tag in _INLINE and parent is not None
        self.path = parent.path if inline else paths.setdefault((parent.path if parent else -1, tag), len(paths))
        self.block = parent.block if inline else self  # innermost block element
        self.weight, self.own, self.foreign, self.hidden = (
            (parent.weight, parent.own, parent.foreign, parent.hidden) if parent else (1.0, None, False, False))
        self.section = parent.section if parent and tag not in _SECTION else self
        self.weigh(tag, attrs)

    def weigh(self, tag: str, attrs: str) -> None:
        names, role = set(), ""
        if attrs.strip():
            got = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attrs)}
            if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
                self.hidden = True
            role = got.get("role", "").lower()
            names = {x.lower() for x in _SPLIT.split(f"{got.get('class', '')} {got.get('id', '')}") if x}
        self.hidden |= tag == "head"
        if tag in ("html", "body", "h1"):
            return
        if tag in ("article", "main") and not self.foreign and not (names & FOREIGN_NAMES):
            if self.own is None:
                self.own, self.weight = self, DECLARED
            return
        if tag in AWAY_TAGS and not (tag == "header" and self.own) or role in AWAY_ROLES:
            self.weight *= AWAY
        if names & (DOUBTFUL_NAMES - _HEADS if self.own else DOUBTFUL_NAMES) or tag == "article" and names & FOREIGN_NAMES:
            self.weight *= DOUBTFUL
        self.foreign |= tag in _FOREIGN_TAGS or bool(names & FOREIGN_NAMES)


def blocks(html: str) -> list[tuple[_Node, str]]:
    """The page's text blocks in order, each with the innermost block element around it."""
    paths: dict[tuple[int, str], int] = {}  # a path's number, by that of the path above and the tag
    stack, out, text = [_Node("html", None, "", paths)], [], []
    count = Counter()  # open elements by tag: no token walks a deep stack in vain

    def flush() -> None:
        words = " ".join(unescape("".join(text)).split())
        text.clear()
        if words and not stack[-1].hidden:
            out.append((stack[-1].block, words))

    for m in _TOKEN.finditer(html):
        if m["text"] is not None:
            text.append(m["text"])
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            text.append(" ")
        if m["end"]:
            if count[tag]:
                while True:
                    top = stack.pop().tag
                    count[top] -= 1
                    if top == tag:
                        break
            continue
        if tag == "html":
            continue
        closes, within = _ENDS.get(tag, (set(), set()))
        if tag not in _INLINE and tag not in _VOID and count["p"]:
            closes, within = closes | {"p"}, within | _SECTION
        for i in range(len(stack) - 1 if any(count[x] for x in closes) else 0, 0, -1):
            if stack[i].tag in closes:
                count.subtract(x.tag for x in stack[i:])
                del stack[i:]
                break
            if stack[i].tag in within:
                break
        if tag in _VOID or m["attrs"].endswith("/") and tag in _INLINE:
            continue
        new = _Node(tag, stack[-1], m["attrs"], paths)
        stack.append(new)
        count[tag] += 1
    flush()
    return out


def scored(html: str) -> list[tuple[float, float, str]]:
    """The page's blocks in order: score, weighted score of the best container, and text."""
    found = blocks(html)
    holds = Counter()  # blocks that a section holds, as far as two
    for node, _ in found:
        at = node.section if node.own is None else None
        while at is not None and holds[id(at)] < 2:
            holds[id(at)] += 1
            at = at.parent.section if at.parent else None
    length, punct, nodes, placed = Counter(), Counter(), Counter(), []
    for node, words in found:
        at = node.section
        while node.own is None and holds[id(at)] < 2 and at.parent is not None:
            at = at.parent.section
        placed.append((node, id(node.own or at), words))
        length[node.path] += len(words)
        punct[node.path] += len(_PUNCT.findall(words))
        nodes[node.path] += 1
    ratio = {k: length[k] / nodes[k] * (1 + math.log1p(punct[k] / nodes[k])) for k in nodes}
    total, smooth, weighted = Counter(), defaultdict(float), defaultdict(float)
    for node, own, words in placed:
        total[own] += len(words)
        smooth[own] += ratio[node.path] * len(words)
        weighted[own] += node.weight * ratio[node.path] * len(words)
    # ``weighted`` is a container's weighted ratio times its length: the largest one belongs to the best
    best = max(weighted, key=weighted.__getitem__, default=None)
    top = weighted[best] / total[best] if placed else 0.0
    return [(node.weight * max(ratio[node.path], smooth[own] / total[own]), top, words) for node, own, words in placed]


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """``threshold`` 0 keeps every block."""
    least = LEAST if threshold > 0 else 0.0
    return "\n\n".join(words for score, top, words in scored(html or "") if score >= max(threshold * top, least))


def extract(html: Column) -> Column:
    """The main text of ``html``, a string that is never null."""

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(x.as_py()) for x in pages], pa.string())

    texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(texts, "string")(html)
