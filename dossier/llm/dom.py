"""A tolerant HTML tokeniser and the block tree that classifiers look at."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np

from dossier.llm.common import ASCII_LOWER

#: Fixed value: elements that flow within a block of text.
INLINE = frozenset("canvas object a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Fixed value: elements of MathML and SVG, which flow likewise.
INLINE |= frozenset("math semantics annotation annotation-xml maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split())
INLINE |= frozenset("svg animate animatemotion animatetransform circle clippath defs desc ellipse filter foreignobject g image line lineargradient marker mask metadata mpath path pattern polygon polyline radialgradient rect set stop switch symbol text textpath tspan use view".split())
#: Fixed value: elements of forms that stand within a paragraph and don't close it.
CHOICE = frozenset("select datalist optgroup option".split())
#: Fixed value: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed value: elements whose content is no text of the page.
RAW = frozenset("script style noscript template title textarea iframe".split())
#: Fixed value: an open element of the key is closed by a start tag of these.
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "head": frozenset(["body"]),
    "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
}
#: Where the search for an element to close stops.
SCOPE = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select", "datalist"]), "optgroup": frozenset(["select"])}
#: Words in class, id or role, by what they say of an element.
HINTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toc pager pagination", "head": "header masthead banner logo topbar brand", "foot": "footer copyright colophon bottom legal",
    "side": "sidebar side aside rail widget widgets secondary complementary", "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion adsense teaser", "notice": "cookie cookies consent notice alert popup modal gdpr overlay warning message subscribe newsletter",
    "share": "share social sharing follow related recommended more links tags meta", "talk": "comment comments reply replies discussion disqus respond respondent reviews", "form": "form search login signup register input button",
    "text": "article content main post entry body story text page copy prose blog news",
}
_HINT = {word: k for k, words in enumerate(HINTS.values()) for word in words.split()}
#: Element kinds that a classifier tells apart; the rest are "other".
KINDS = "html body main article section div p h li list nav header footer aside form table cell figure pre other".split()
_KIND = {t: t for t in KINDS} | {f"h{k}": "h" for k in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "figcaption": "figure", "blockquote": "pre", "fieldset": "form", "button": "form", **dict.fromkeys(CHOICE, "form"), "menu": "nav", "dialog": "aside"}

_begin = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_attributes = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
#: Where a script or style without an end tag ends: at the next block of text.
_block = re.compile(r"<(?:article|aside|body|div|footer|form|h[1-6]|header|main|nav|ol|p|section|table|ul)\b", re.I)
_attr = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_label = re.compile(r'data-label="(\d)"')
_parts = re.compile(r"[A-Za-z][a-z]*")


class Page:
    """Elements in document order: kind, parent, depth, last (its last descendant),
    hints (bits), label (of training pages); and the runs of text: (element, text, link characters)."""

    def __init__(self, source: str):
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.hints: list[int] = []
        self.label: list[int] = []
        self.last: list[int] = []
        self.runs: list[tuple[int, str, int]] = []
        self._open: list[tuple[str, int]] = []
        self._levels: dict[str, list[int]] = {}  # by name, where it is open
        self._text: list[str] = []
        self._linked = 0
        self._links = 0
        self._start("html", "")
        self._parse(source)
        self._flush()
        while self._open:
            self._pop()

    def _start(self, tag: str, attrs: str) -> None:
        self._flush()
        bits = 0
        for found in _attr.finditer(attrs):
            for word in _parts.findall(found[1] or found[2] or found[3] or ""):
                k = _HINT.get(word.lower())
                if k is not None:
                    bits |= 1 << k
        label = _label.search(attrs)
        self.parent.append(self._open[-1][1] if self._open else -1)
        self.depth.append(len(self._open))
        self.kind.append(KINDS.index(_KIND.get(tag, "other")))
        self.hints.append(bits)
        self.label.append(int(label[1]) if label else -1)
        self.last.append(-1)
        self._levels.setdefault(tag, []).append(len(self._open))
        self._open.append((tag, len(self.kind) - 1))

    def _pop(self) -> None:
        tag, k = self._open.pop()
        self._levels[tag].pop()
        self.last[k] = len(self.kind) - 1

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        """Closes the innermost element of that name, unless one of `stop` is open within it."""
        at = (self._levels.get(tag) or [0])[-1]
        if at and not any((self._levels.get(x) or [0])[-1] > at for x in stop):
            self._flush()
            self._links = 0
            while len(self._open) > at:
                self._pop()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.runs.append((self._open[-1][1], text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _say(self, text: str) -> None:
        self._text.append(text)
        if self._links:
            self._linked += len(text)

    def _parse(self, source: str) -> None:
        """In time that grows with the length of the source, whatever is in it: what isn't
        found once (an end of comments, of scripts, a matching quote) isn't looked for again."""
        at, end, last = 0, len(source), source.rfind(">")
        low, unclosed = None, set()
        spare = 4 * end + 10_000  # characters that may be read in vain for quotes that don't match
        while at < end:
            found = _begin.search(source, at)
            if not found or found.start() > last:  # a tag that never closes is text
                self._say(source[at:])
                return
            if found.start() > at:
                self._say(source[at : found.start()])
            at = found.end()
            tag = found[4]
            if not tag:
                mark = "-->" if found[1] else "]]>" if found[2] else ">"
                close = source.find(mark, found.start() + 2) if mark not in unclosed else -1
                if close < 0:
                    unclosed.add(mark)
                    at = at if found[2] else source.find(">", at - 1) + 1 or end
                    continue
                if found[2]:
                    self._say(source[at:close])
                at = close + len(mark)
                continue
            to = _attributes.match(source, at).end() if spare > 0 else end
            if to == end or source[to] != ">":
                spare -= to - at
                to = source.find(">", at)
            attrs, at = source[at:to], to + 1
            tag = tag.lower()
            if found[3]:
                if tag == "a":
                    self._links = max(0, self._links - 1)
                elif tag == "br":
                    self._say(" ")
                elif tag not in INLINE and tag != "html" and tag != "body":
                    self._close(tag)
                continue
            if tag in RAW:
                if not attrs.endswith("/"):
                    if low is None:
                        low = source.lower()
                        low = low if len(low) == end else source.translate(ASCII_LOWER)
                    close = low.find(f"</{tag}", at) if tag not in unclosed else -1
                    if close >= 0:
                        at = source.find(">", close) + 1 or end
                    else:
                        unclosed.add(tag)
                        block = _block.search(source, at) if tag in ("script", "style") else None
                        at = block.start() if block else end if tag in ("script", "style") else at
                continue
            if tag in INLINE:
                if tag == "a":
                    self._links = 1
                elif tag in ("br", "img", "wbr"):
                    self._say(" " if tag == "br" else "")
                continue
            if tag in ("html", "head"):
                continue
            if tag in VOID:
                self._flush()
                continue
            if tag not in CHOICE and any(t == "p" for t, _ in self._open[-1:]):
                self._close("p")
            for kind in [k for k, by in CLOSED_BY.items() if tag in by]:
                self._close(kind, SCOPE.get(kind, frozenset()))
            self._start(tag, attrs)


FEATURES = [*(f"is_{k}" for k in KINDS), *(f"up_{k}" for k in KINDS), *(f"hint_{k}" for k in HINTS), *(f"over_{k}" for k in HINTS), "depth", "chars", "own", "words_a_run", "longest", "links", "runs", "share", "rank", "siblings", "alike", "before", "stops", "below", "hinted_below", "widest_sibling"]


def features(page: Page) -> np.ndarray:
    """A row per element."""
    return np.concatenate(list(feature_blocks(page)))


def feature_blocks(page: Page, most: int = 50_000) -> Iterator[np.ndarray]:
    """The rows of features, at most so many at once."""
    n = len(page.kind)
    kind, parent, depth, last = (np.array(x, np.int64) for x in (page.kind, page.parent, page.depth, page.last))
    bits = np.array(page.hints, np.int64)
    own = np.zeros((n, 5))
    for k, text, linked in page.runs:
        row = own[k]
        row[0] += len(text)
        row[1] += linked
        row[2] += 1
        row[3] += text.count(" ") + 1
        row[4] += text.count(".") + text.count(",")
    longest = np.zeros(n)
    for k, text, _ in page.runs:
        longest[k] = max(longest[k], len(text))
    for k in range(n - 1, 0, -1):
        p = parent[k]
        if longest[k] > longest[p]:
            longest[p] = longest[k]
    over = bits.copy()
    for k in range(1, n):
        over[k] |= over[parent[k]]
    total = np.concatenate((np.zeros((1, 5)), np.cumsum(own, 0)))
    below = total[last + 1] - total[:-1]
    chars, links, runs, words, stops = below.T
    up = np.maximum(parent, 0)
    size = np.maximum(chars[0], 1)
    first = np.arange(n)
    siblings = np.bincount(up, minlength=n)[up]
    order = np.lexsort((first, up))
    rank = np.empty(n)
    group = up[order]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    rank[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    pair = up * len(KINDS) + kind
    _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
    widest = np.zeros(n)
    np.maximum.at(widest, up[1:], chars[1:])
    hinted = np.concatenate(([0], np.cumsum(bits > 0)))
    k = len(KINDS)
    tail = (
        depth, np.log1p(chars), own[:, 0] / np.maximum(chars, 1), words / np.maximum(runs, 1), np.log1p(longest), links / np.maximum(chars, 1), np.log1p(runs), chars / size, rank, siblings,
        times[inverse] / np.maximum(siblings, 1), total[:-1, 0] / size, 100 * stops / np.maximum(chars, 1), np.log1p(last - first), (hinted[last + 1] - hinted[:-1]) / (last - first + 1), chars / np.maximum(widest[up], 1),
    )
    for i in range(0, n, most):
        part = slice(i, min(n, i + most))
        at = np.arange(part.stop - i)
        out = np.zeros((len(at), len(FEATURES)), np.float32)
        out[at, kind[part]] = 1
        out[at, k + kind[up[part]]] = 1
        if i == 0:
            out[0, k : 2 * k] = 0  # the root has no parent
        for j in range(len(HINTS)):
            out[:, 2 * k + j] = bits[part] >> j & 1
            out[:, 2 * k + len(HINTS) + j] = over[part] >> j & 1
        for j, column in enumerate(tail, 2 * k + 2 * len(HINTS)):
            out[:, j] = column[part]
        yield out
