"""Main text by tag-path scores: the scores against brute force, what they decide, broken pages, odd tables."""

import re
import time
from math import exp, sqrt

import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import html

SF = "/root/testdata/sf0.001"
PAGE = """<body><div><a href=x>Home</a></div><section><p>Buy now, here.</p></section>
<div><h2>Head</h2><p>Long words, more words; and so on. <a href=y>Really, yes.</a></p><p>Short.</p><ul><li>item one<li>item two, three</ul>
<p>More words again, and more; it goes on. And on, as ever.</p></div><section><p>Bye.</p></section></body>"""


def brute_scores(page, kept):
    """path -> fused ratio, from sums by path and weights by distance, one path at a time."""
    order, size, plain, marks, nodes = [], {}, {}, {}, {}
    for k, (at, text, linked) in enumerate(zip(page.block_of, page.text, page.linked)):
        if kept[k]:
            p = page.path[at]
            if p not in nodes:
                order.append(p)
            free = max(len(text) - linked, 0)
            plain[p] = plain.get(p, 0) + free * free / len(text)
            marks[p] = marks.get(p, 0) + len(re.findall(r"[.,;:!?。，；：！？]", text))
            nodes[p] = nodes.get(p, 0) + 1
    text_ratio = {p: plain[p] / nodes[p] + 1e-3 for p in order}
    mark_ratio = {p: (marks[p] + 1) / nodes[p] for p in order}

    def smooth(ratio, i):
        near = [j for j in range(len(order)) if abs(i - j) <= 3]
        weight = {j: exp(-((i - j) ** 2) / 2) for j in near}
        return sum(weight[j] * ratio[order[j]] for j in near) / sum(weight.values())

    priors = html.priors(page, kept)[0]
    prior = {p: max(x for at, x, keep in zip(page.block_of, priors, kept) if keep and page.path[at] == p) for p in order}
    fused = {p: sqrt(text_ratio[p] * smooth(text_ratio, i)) * sqrt(mark_ratio[p] * smooth(mark_ratio, i)) * prior[p] for i, p in enumerate(order)}
    return {p: x if prior[p] > 1 / 64 or x >= 30 else 0.0 for p, x in fused.items()}


@pytest.mark.parametrize("source", [PAGE, "<p>a", "<div><p>One, two.</p></div><table><tr><td>3<td>4, 5</table>", *pd.read_parquet(f"{SF}/pages.parquet").html[:20]])
def test_scores_path_by_path(source):
    page = html.Page(source)
    for kept in (np.ones(len(page.text), bool), np.arange(len(page.text)) % 3 < 2):
        want = brute_scores(page, kept)
        got = html.path_scores(page, kept)
        for at, score, keep in zip(page.block_of, got, kept):
            assert score == pytest.approx(want[page.path[at]] if keep else 0.0)


def test_scores_select_the_blocks():
    assert html.extract(PAGE) == "Head Long words, more words; and so on. Really, yes. Short. item one item two, three More words again, and more; it goes on. And on, as ever."


def test_without_names_the_scores_decide(monkeypatch):
    """Most pages without names are read rightly by score; with one score for all, or with random ones, hardly any."""
    pages = pd.read_parquet(f"{SF}/pages.parquet").html
    bare = [re.sub(r' (class|id)="[^"]*"', "", re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b", r"<\1div", h)) for h in pages]
    want = [html.extract(h) for h in pages]
    right = lambda: sum(html.extract(h) == t for h, t in zip(bare, want)) / len(bare)
    assert right() > 0.8
    monkeypatch.setattr(html, "path_scores", lambda page, kept: np.where(kept, 1.0, 0.0))
    assert right() < 0.1
    rng = np.random.default_rng(3)
    monkeypatch.setattr(html, "path_scores", lambda page, kept: np.where(kept, rng.random(max(page.path) + 1)[np.array(page.path)[page.block_of]], 0.0))
    assert right() < 0.3


def test_scores_decide_on_the_given_pages(monkeypatch):
    """With one score for all paths no page comes out the same, with random ones hardly any."""
    pages = pd.read_parquet(f"{SF}/pages.parquet").html
    want = [html.extract(h) for h in pages]
    same = lambda: sum(html.extract(h) == t for h, t in zip(pages, want)) / len(pages)
    monkeypatch.setattr(html, "path_scores", lambda page, kept: np.where(kept, 1.0, 0.0))
    assert same() == 0
    rng = np.random.default_rng(3)
    monkeypatch.setattr(html, "path_scores", lambda page, kept: np.where(kept, rng.random(max(page.path) + 1)[np.array(page.path)[page.block_of]], 0.0))
    assert same() < 0.3


PROSE = "Prices rose again, as ever. Nobody knew why, and few asked; it went on. "


@pytest.mark.parametrize("around", ["main", "div"])
@pytest.mark.parametrize(("name", "stays"), [("share-price", True), ("social-security", True), ("notice-period", True), ("header-2", True), ("legal-analysis", True), ("cookie-notice", False), ("comment-list", False), ("ad", False), ("share", False), ("sidebar-right", False)])
def test_words_in_names_hint_only(around, name, stays):
    """What only a word of a name speaks against is judged by its score, and keeps its own heading; whole names weigh heavily."""
    got = html.extract(f"<body><nav><a href=x>Home</a></nav><{around}><h1>T</h1><p>{PROSE * 3}</p><div class='{name}'><h3>Inner head</h3><p>{PROSE * 2}</p></div><p>{PROSE * 2}</p></{around}></body>")
    assert got.count("Prices") == (7 if stays else 5) and ("Inner head" in got) == stays and "Home" not in got
    assert "Buy" not in html.extract(f"<body><{around}><h1>T</h1><p>{PROSE * 3}</p><div class='ad-box'><p>Buy it now.</p></div><p>{PROSE}</p></{around}></body>")


def test_names_yield_to_long_texts_only():
    assert html.extract("<nav><a href=1>Home</a></nav><footer>&copy; Some, name.</footer>") == ""
    assert html.extract(f"<footer>{PROSE * 20}</footer>").count("Prices") == 20
    assert html.extract(f"<article><p><a href=x>{PROSE}</a></p></article>") == PROSE.strip()
    assert html.extract(f"<form><p>{PROSE * 20}</p></form><p hidden>{PROSE * 20}</p><p>One, two.") == "One, two."


def test_text_outside_an_article():
    """Prose outside of the article scores less; what is in the article stays, also lists and tables."""
    assert html.extract("<article><p>A b, c. D e, f. G.</p><table><tr><td>1<td>2</table></article><div><p>Other words, here. And more.</p></div>") == "A b, c. D e, f. G. 1 2"


@pytest.mark.parametrize("broken", ["<a " * 200_000, '<b x=">" ' * 60_000, "<div>" * 60_000 + "</p>" * 60_000, "<div>" * 40_000 + "<li></li>" * 40_000, "<article>" * 40_000, "<b>" * 60_000 + "</i>" * 60_000, "<!-- " * 60_000, "<p title='" * 60_000, "<p>a &#" + "1" * 60_000 + ";", "<script>" + "</script " * 60_000, "<style></style " * 60_000, "<textarea></textarea></script" * 40_000])
def test_broken_pages_take_linear_time(broken):
    html.extract("<p>warm</p>")
    began = time.process_time()
    html.extract(broken)
    assert time.process_time() - began < 3


def test_references():
    assert html.extract("<p>&#65;&#0000000000000000065; &#x41; &amp;amp; &#99999999; &nosuch; &#" + "9" * 6000 + ";</p>") == "AA A &amp; � &nosuch; �"


def test_odd_tables(spark):
    rows = [(1, "u", None, 1, "p"), (2, None, "", 2, "p"), (None, "u", "<p>One, two.", 3, None), (3, "u", "<article><p>A b.</p></article>", 4, "p"), (3, "u", "<article><p>A b.</p></article>", 4, "p"), (4, "u", "<p>" + "long words, " * 50_000, 5, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = sorted((tuple(r) for r in html.main_text(pages).collect()), key=str)
    long = ("long words, " * 50_000).strip()
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "One, two.", 9), (3, "u", "A b.", 4), (3, "u", "A b.", 4), (4, "u", long, len(long))]
    assert got == sorted(want, key=str)
    empty = html.main_text(pages.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]
