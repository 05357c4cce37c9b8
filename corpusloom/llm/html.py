"""Main text of web pages by tag-path ratios.

A page is read once into elements and blocks of text. Blocks with the same
root-to-leaf path of block-level tags (with class and id) are taken together:
the path's text ratio is its characters per block and its punctuation ratio its
punctuation marks per block, links counted against it. Both are smoothed over
the paths in page order, with weights that fall with distance, and fused by
multiplication, together with the path's prior. Paths whose fused score reaches a share of the
scores' spread are content, and their blocks are the main text.

Names are features, not rules: the prior of a path is the product of what its tags, roles, classes and ids weigh. Menus,
footers, asides and the like weigh ``BOILER``; class or id tokens of NAMES, or with a word of SURE, weigh ``NAMED``. Tokens of
which a word is in NAMES (``share-price``) only hint: what they name is judged by its own score, and joins no other text. On a page with an ``article`` or ``main``
what is outside of them weighs ``OUTSIDE``. A part named only by class or id has no weight of its own where an ``article`` or
``main`` is in it, or, on a page without those, four fifths of the text. Only scripts, styles, forms and what a browser doesn't show are left
out whatever their scores. A path of low prior without a long text has no score (``PROSE``).

Short blocks. Headings, list items and cells have few marks, so a block whose path
is below the threshold, and has no name against it, joins content beside it: any content in the outermost
``article`` or ``main`` around it; elsewhere, if it isn't mostly links, that of the nearest
element that can hold a text, of whose characters ``HELD`` must lie on content paths. What is only hinted at joins
the content of the element with that name, as far as it holds such a share.

Cases. Null or empty html, or no text: empty text. An empty table gives an empty
table. Markup that never closes ends with the page; a tag whose quotes never
close ends at its next ``>``, and quotes aren't trusted from there on. ``<`` before
anything but a tag is text. Repeated rows are read each; paths of equal score are kept or
left out together. Character references are decoded once, those beyond Unicode to
U+FFFD; white space in a block becomes one space. Nothing is dropped for length, and the
time of a page grows with its length. Columns other than page_id, url and html
are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>")
#: Used where quotes are not trusted.
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARK = re.compile(r"[.,;:!?。，；：！？]")
WHITE = re.compile(r"\s+")
LEADING_ZEROS = re.compile(r"&#0+(?=[0-9])")
BEYOND = re.compile(r"&#[0-9]{8,};?")

#: Least text ratio of a path.
FAINT = 1e-3
#: A path is content from ``SPREAD`` standard deviations and ``SHARE`` of the best score on.
SPREAD, SHARE = 0.5, 0.4
#: Weights in a path's prior, the least prior, and the score that a path of low prior must reach to be content.
OUTSIDE, BOILER, NAMED, LEAST, PROSE = 1 / 8, 1 / 64, 1 / 64, 1 / 64, 30.0
#: Share of a container's characters on content paths from which its other blocks join.
HELD = 0.25

# Tag names by what they mean here.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATTRIBUTES = frozenset("class id role hidden aria-hidden".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
NOT_TEXT = frozenset("head form script style textarea title noscript template iframe xmp button select option svg math canvas object video audio map datalist fieldset".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
REGIONS = frozenset("html body div section article main td tr tbody table center".split())
ARTICLE = ("article", "main")
P_ENDS_AT = REGIONS | {"li", "td", "th", "button"}
LIST_ENDS_AT = frozenset("ul ol dl table select".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words that name what is not the article, in whatever token of a class or id they stand.
SURE = frozenset(
    "advert adverts advertisement advertising adsense sponsored promo navbar nav navigation menu breadcrumb breadcrumbs masthead footer sidebar widget comment comments disqus "
    "respond replies cookie cookies consent gdpr popup modal newsletter subscribe subscription pagination pager".split()
)
# Tokens of a class or id that name what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended comment comments disqus respond reply replies cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar pagination pager skip copyright legal".split()
)


def named(label: str) -> tuple[float, bool]:
    """What the tokens of a class and an id weigh, and whether they only hint."""
    hint = False
    for token in label.split():
        words = re.split(r"[_-]+", token)
        if token in NAMES or not SURE.isdisjoint(words):
            return NAMED, False
        hint = hint or not NAMES.isdisjoint(words)
    return 1.0, hint


class Page:
    """Elements (parent, tag, path, whether left out, weights of tag and of names) and blocks (element, text, linked characters); ``hint`` is the outermost element around that a name hints at, or 0."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.hard, self.boiler, self.name, self.hint = [-1], [""], [0], [False], [False], [1.0], [0]
        self.block_of: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self._paths: dict[tuple, int] = {}
        self._open = [0]
        self._places: dict[str, list[int]] = {}  # tag -> its places among the open elements
        self._in_link = False
        self._now: list[str] = []
        self._links = 0
        self._read(source)

    def _read(self, s: str) -> None:
        at, last, trusted = 0, s.rfind(">"), True
        while 0 <= (lt := s.find("<", at)) < last:
            if lt > at:
                self._add(s[at:lt])
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = len(s) if end < 0 else end + 3
                continue
            if s.startswith(("<!", "<?"), lt):
                at = s.find(">", lt) + 1
                continue
            m = TAG.match(s, lt) if trusted else None
            if not m and (m := LOOSE_TAG.match(s, lt)):
                trusted = False
            if not m:
                self._add("<")
                at = lt + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._end(name)
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(s, at)
                at = s.find(">", close.end()) + 1 if close else 0
                at = at or len(s)
                self._now.append(" ")
            else:
                self._start(name, m[3])
        if (comment := s.find("<!--", at)) >= 0:
            self._add(s[at:comment])
        else:
            self._add(s[at:])
        self._flush()

    def _add(self, raw: str) -> None:
        text = entities.unescape(BEYOND.sub("\ufffd", LEADING_ZEROS.sub("&#", raw))) if "&" in raw else raw
        self._now.append(text)
        if self._in_link:
            self._links += len(text.strip())

    def _flush(self) -> None:
        text = WHITE.sub(" ", "".join(self._now)).strip()
        if text:
            self.block_of.append(self._open[-1])
            self.text.append(text)
            self.linked.append(self._links)
        self._now, self._links = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self._flush()
            self._now.append(" ")
            return
        if name in INLINE:
            self._in_link |= name == "a"
            return
        self._flush()
        if name in CLOSES_P:
            self._pop({"p"}, P_ENDS_AT)
        if name in ENDS:
            self._pop(ENDS[name], LIST_ENDS_AT)
        self._in_link = False
        found = {n: a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(attributes)) if (n := k.lower()) in ATTRIBUTES} if len(attributes) > 1 else {}
        label = f"{found.get('class', '')} {found.get('id', '')}".lower() if found else " "
        up = self._open[-1]
        key = (self.path[up], name, label)
        self.parent.append(up)
        self.tag.append(name)
        self.path.append(self._paths.setdefault(key, len(self._paths) + 1))
        self.hard.append(name in NOT_TEXT or "hidden" in found or found.get("aria-hidden") == "true" or self.hard[up])
        boiler = name in BOILERPLATE or found.get("role", "").lower() in ROLES
        self.boiler.append(boiler or name == "header" and not any(self._places.get(t) for t in ARTICLE))
        weight, hint = named(label) if label != " " and name not in ("html", "body", *ARTICLE) else (1.0, False)
        self.name.append(weight)
        self.hint.append(self.hint[up] or (len(self.hint) if hint else 0))
        self._places.setdefault(name, []).append(len(self._open))
        self._open.append(len(self.tag) - 1)

    def _innermost(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((places[-1] for n in names if (places := self._places.get(n))), default=0)

    def _cut(self, place: int) -> None:
        while len(self._open) > place:
            self._places[self.tag[self._open.pop()]].pop()

    def _pop(self, names: Iterable[str], barrier: Iterable[str]) -> None:
        place = self._innermost(names)
        if place and place > self._innermost(barrier):
            self._cut(place)

    def _end(self, name: str) -> None:
        if name in INLINE:
            self._in_link &= name != "a"
        elif place := self._innermost((name,)):
            self._flush()
            self._in_link = False
            self._cut(place)
        elif name == "p":
            self._flush()
        elif name == "br":
            self._now.append(" ")

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Each element's total of a weight of blocks, its descendants' included."""
        total = np.bincount(self.block_of, weight, len(self.tag)).tolist()
        for k in range(len(self.tag) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return np.array(total)

    def around_articles(self) -> tuple[list[bool], list[int]]:
        """Whether an ``article`` or ``main`` is in an element, and the outermost one that it is or lies in (-1: none)."""
        holds, within = [False] * len(self.tag), [-1] * len(self.tag)
        for k in range(1, len(self.tag)):
            up = within[self.parent[k]]
            within[k] = up if up >= 0 else k if self.tag[k] in ARTICLE else -1
        for k in range(len(self.tag) - 1, 0, -1):
            if holds[k] or self.tag[k] in ARTICLE:
                holds[self.parent[k]] = True
        return holds, within

    def containers(self) -> list[int]:
        """For each element itself or the nearest one around it that can hold a text."""
        out = [0] * len(self.tag)
        for k in range(1, len(self.tag)):
            out[k] = k if self.tag[k] in REGIONS else out[self.parent[k]]
        return out


def priors(page: Page, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block the prior, whether nothing names it as boilerplate, and the outermost article around it (-1: none)."""
    at = np.array(page.block_of)
    holds, within = page.around_articles()
    some = any(t in ARTICLE for t in page.tag)
    weight = np.ones(len(page.tag))
    held = None
    for k in range(1, len(page.tag)):
        own = BOILER if page.boiler[k] else 1.0
        if page.name[k] < 1 and not holds[k]:
            if held is None and not some:
                held = page.sums(np.array([len(t) for t in page.text], float) * kept)
            if some or held[k] <= 0.8 * held[0]:
                own *= page.name[k]
        weight[k] = max(weight[page.parent[k]] * own, LEAST)
    inside = np.array(within)[at]
    return np.maximum(weight[at] * np.where((inside >= 0) | (not some), 1.0, OUTSIDE), LEAST), weight[at] == 1.0, inside


def path_scores(page: Page, kept: np.ndarray, prior: np.ndarray | None = None, sigma: float = 1.0) -> np.ndarray:
    """The fused score of each kept block's path: its smoothed ratios and its prior (of its blocks the highest); zero for blocks that are not kept."""
    paths = np.array(page.path)[page.block_of]
    order: dict[int, int] = {}
    which = np.array([order.setdefault(p, len(order)) for p in paths[kept].tolist()], int)
    n = len(order)
    size = np.array([len(t) for t in page.text])[kept]
    plain = np.maximum(size - np.array(page.linked)[kept], 0)
    marks = np.array([len(MARK.findall(t)) for t in page.text])[kept]
    nodes = np.bincount(which, minlength=n)
    text_ratio = np.bincount(which, plain * (plain / np.maximum(size, 1)), n) / nodes + FAINT  # a text that is all links is better than none
    mark_ratio = (np.bincount(which, marks, n) + 1) / nodes
    likely = np.zeros(n)
    np.maximum.at(likely, which, (priors(page, kept)[0] if prior is None else prior)[kept])
    radius = min(3, n - 1)
    reach = np.arange(-radius, radius + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma * sigma))
    even, *sums = (np.convolve(r, kernel)[radius : radius + n] for r in (np.ones(n), text_ratio, mark_ratio))
    smooth = [x / even for x in sums]
    scores = np.zeros(len(paths))
    fused = np.sqrt(text_ratio * smooth[0]) * np.sqrt(mark_ratio * smooth[1]) * likely
    scores[kept] = np.where((likely > NAMED) | (fused >= PROSE), fused, 0.0)[which]
    return scores


def extract(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    if not page.text:
        return ""
    at = np.array(page.block_of)
    size = np.array([len(t) for t in page.text], float)
    kept = ~np.array(page.hard)[at]
    if not kept.any():
        return ""
    _, unnamed, article = priors(page, kept)
    scores = path_scores(page, kept)
    _, first = np.unique(np.array(page.path)[at][kept], return_index=True)
    each = scores[kept][first]
    content = kept & (scores >= min(SPREAD * each.std() + SHARE * each.max(), each.max())) & (scores > 0)
    # Blocks of low score join the content that they share a container with.
    hint = np.array(page.hint)[at]
    inside, free = (article >= 0) & (hint == 0), kept & unnamed
    box = np.where(hint > 0, hint, np.where(inside, article, np.array(page.containers())[at]))
    on_content = page.sums(size * content)[box]
    share = on_content >= HELD * page.sums(size * (free | content))[box]
    plain = 2 * np.array(page.linked) < size
    taken = content | (free & np.where(inside, on_content > 0, share & plain))
    return " ".join(t for t, keep in zip(page.text, taken.tolist()) if keep)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""
    @F.pandas_udf("string")
    def extracted(sources: pd.Series) -> pd.Series:
        return sources.map(extract)

    found = pages.select("page_id", "url", extracted("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
