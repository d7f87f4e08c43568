"""Main text of HTML pages by tag-path ratios.

A page becomes blocks of text, each with its tag path: the open elements from the root to the block, with their first
class. What HTML itself keeps from the text never counts: scripts, styles, forms, navigation, footers, asides, hidden
elements, and a header outside of an article.

Each path has two ratios: text length over its blocks, and punctuation over its blocks, both smoothed along the page by a
Gaussian, where blocks count by their length. They are fused by their product, and with the length of all the text that the path's container (the element its
blocks lie in) holds. The score is lessened by the share of the text that stands in links, and by names of classes and ids like
``comments`` or ``related``, which alone don't keep a path out. A path whose score reaches :data:`THRESHOLD` of the best one is
content.

What lies below the container of a content path (headings, lists, quotes, sections) is content with it, and so is the rest of
an article of which a path is content. Only a part with such a name is not taken along: it is judged by its own score. Inside
an article a name has to be a whole class or id, so that a section about ``ad-hoc-networks`` or ``comment-on-hegel`` stays.

One Arrow function of the html column does this, page by page, over whole pages, in time linear in the page; other columns
pass untouched. A null or empty page has the text "". Repeated pages get equal texts. Broken markup never raises: a start
tag closes what it must, an end tag without a start is ignored, and an open comment or script runs to the end of the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMOOTH = 0.4
#: Share of the best score that a path's score must reach, and the least that the threshold may be set to.
THRESHOLD, FLOOR = 0.2, 0.01
#: Power of the length of a container's text within the score.
TOGETHER = 2.0
#: Weight of a path, as a logarithm, for each name that hints at something else: alone it keeps a path just above the threshold.
NAMED = -1.6

# Names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
NEVER = frozenset("head nav footer aside form button select option fieldset menu dialog svg math object canvas audio video map".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dd dt td th tr tbody thead tfoot".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html article section div main td th".split())
BOUNDS = frozenset("article body html table".split())
FREE = frozenset("article section main body html table div".split())
KEEP_P = frozenset("button td th table".split())
# Names of classes and ids that hint at something else than the main text.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side nav navbar navigation menu breadcrumb breadcrumbs header footer masthead topbar toolbar banner comment comments reply replies respond disqus cookie cookies consent gdpr notice notices notification alert newsletter subscribe signup login popup modal overlay pagination pager social share sharing related recommended recommendations widget form search copyright legal disclaimer".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…。、，！？؛،]")


def _element(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Step of the path, whether HTML keeps the element from the text, and whether a class or id is one of the names, whole or in part."""
    step, out, whole, part = name, name in NEVER, False, False
    if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "hidden" in attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" and m[0].lower() == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
                out = True
            elif key in ("class", "id"):
                words = value.split()
                whole = whole or not NAMES.isdisjoint(words)
                part = part or any(not NAMES.isdisjoint(re.split(r"[-_]", x)) for x in words)
                if key == "class" and words:
                    step = f"{name}.{words[0]}"
    if name in ("html", "body", "article", "main"):
        whole = part = False
    return step, out, whole, part


@dataclass
class Paths:
    """The tag paths of a page as a tree; a path is a number, greater than that of its parent."""

    parent: list[int] = field(default_factory=lambda: [0])
    barred: list[bool] = field(default_factory=lambda: [False])
    weight: list[float] = field(default_factory=lambda: [0.0])
    within: list[int] = field(default_factory=lambda: [0])  # the outermost article or main
    named: list[bool] = field(default_factory=lambda: [False])
    top: list[bool] = field(default_factory=lambda: [True])  # the page itself, no container
    known: dict = field(default_factory=dict)

    def below(self, path: int, name: str, attributes: str) -> int:
        step, never, whole, part = _element(name, attributes)
        article = name in ("article", "main")
        inside = self.within[path]
        if name == "header" and not inside:
            never = True
        named = whole if inside else part
        key = (path, step, never, article, named)
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.within.append(inside or (len(self.parent) if article else 0))
            self.parent.append(path)
            self.barred.append(self.barred[path] or never)
            self.weight.append(self.weight[path] + (NAMED if named else 0.0))
            self.named.append(named)
            self.top.append(self.top[path] and name in ("html", "body"))
        return self.known[key]


def blocks(html: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The paths, and (path, text, characters within links) of each block that may be content, in page order."""
    paths, out = Paths(), []
    names: list[str] = []
    at_path: list[int] = [0]
    places: dict[str, list[int]] = {}  # where each name is open
    scopes: list[int] = []
    bounds: list[int] = []
    keep_p: list[int] = []
    text: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            if not paths.barred[at_path[-1]]:
                clean = " ".join(unescape("".join(text)).split())
                if clean:
                    out.append((at_path[-1], clean, linked))
            text.clear()
        linked = 0

    def last(of) -> int:
        own = places.get(of) if isinstance(of, str) else of
        return own[-1] if own else -1

    def close(at: int) -> None:
        while len(names) > at:
            name = names.pop()
            at_path.pop()
            places[name].pop()
            for kind in (scopes, bounds, keep_p):
                if kind and kind[-1] == len(names):
                    kind.pop()

    at, end = 0, html.rfind(">") + 1
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            break
        if m.start() > at:
            text.append(html[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        if name in INLINE:
            if name == "br":
                text.append("\n")
            elif name == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if closing:
            own = last(name)
            if own >= 0 and (name in FREE or last(bounds) < own):
                close(own)
            continue
        if name in CLOSES_P and last("p") > last(keep_p):
            close(last("p"))
        for other in SAME_CLOSES.get(name, ()):
            if last(other) > max((x for x in scopes[-2:] if names[x] != other), default=-1):
                close(last(other))
                break
        attributes = m[3] if m[2] else m[6]
        if name in RAW and not attributes.endswith("/"):
            done = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = done.end() if done else len(html)
            continue
        if name in VOID:
            continue
        places.setdefault(name, []).append(len(names))
        for kind, of in ((scopes, SCOPES), (bounds, BOUNDS), (keep_p, KEEP_P)):
            if name in of:
                kind.append(len(names))
        names.append(name)
        at_path.append(paths.below(at_path[-1], name, attributes))
    if at < len(html):  # no tag ends here, but a comment or CDATA may begin
        text.append(html[at:].partition("<!--")[0].replace("<![CDATA[", "", 1))
    flush()
    return paths, out


def _smooth(values: np.ndarray) -> np.ndarray:
    reach = max(1, math.ceil(4 * SMOOTH))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SMOOTH**2))
    return np.convolve(values, kernel, "same") / np.convolve(np.ones(len(values)), kernel, "same") if len(values) > 2 * reach else values


def fused_ratios(length: np.ndarray, marks: np.ndarray, of: np.ndarray, container: np.ndarray) -> np.ndarray:
    """By path: length ratio times punctuation ratio, and the length of the container's whole text. ``of``: the path of each block."""
    total = np.bincount(of, length)
    long, dotted = (np.bincount(of, length * _smooth(v)) / total for v in (length, marks))
    together = np.bincount(container, total)[container]
    return long * (1 + dotted) * together**TOGETHER


def main_text(html: str | None) -> str:
    paths, found = blocks(html or "")
    if not found:
        return ""
    own, of = np.unique([p for p, _, _ in found], return_inverse=True)
    length = np.array([len(t) for _, t, _ in found], dtype=float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t, _ in found], dtype=float)
    linked = np.array([x for _, _, x in found], dtype=float)
    unlinked = np.maximum(0.0, 1 - 2 * np.bincount(of, linked) / np.maximum(np.bincount(of, length), 1))
    # text right in the body is a container of its own
    box = np.array([p if paths.top[paths.parent[p]] else paths.parent[p] for p in own.tolist()])
    container = np.unique(box, return_inverse=True)[1]
    weight = np.array(paths.weight)
    score = fused_ratios(length, marks, of, container) * unlinked * np.exp(weight[own])
    least = max(THRESHOLD, FLOOR) * score.max()
    # the container of a content path, and the article it is in, take along what lies below them
    taken = np.zeros(len(weight), dtype=bool)
    for p, x in zip(own.tolist(), score.tolist(), strict=True):
        if x >= least:
            for up in (paths.parent[p], paths.within[p]):
                taken[up] |= not paths.top[up]
    for p in range(1, len(weight)):
        taken[p] |= taken[paths.parent[p]] and not paths.named[p]
    # a list of links is no content by its place alone
    content = (score >= least) | (taken[own] & (unlinked > 0))
    return " ".join(t for (_, t, _), i in zip(found, of.tolist(), strict=True) if content[i])


def text_of(html: Column) -> Column:
    """The main text; never null."""

    @F.arrow_udf("string")
    def tag_paths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(h.as_py()) for h in batch], type=pa.string())

    return tag_paths(html)


def digest(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and its code points."""
    found = pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
