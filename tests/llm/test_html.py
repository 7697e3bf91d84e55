import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from dupscan.llm import html
from dupscan.llm.html import extract, extract_pages

LONG = "This is a sentence of the article that goes on for quite a while, so that it counts as prose."
CASES = [
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("<article></article>", ""),
    ("no markup at all but a text that is long enough to be the text of a page, isn't it? It is, we think so.", "no markup at all but a text that is long enough to be the text of a page, isn't it? It is, we think so."),
    (f"<nav><a href='/x'>Home</a></nav><article><h1>T</h1><p><b>{LONG}<br><p>Two  \n words &amp; more&nbsp;here</p><p>x</article><footer>&copy; f</footer>", f"T\n{LONG}\nTwo words & more here\nx"),
    (f"<header><p>{LONG}</p></header><div class='sidebar'><p>{LONG}</p></div><div><h2>Head</h2><p>{LONG}</p><p>{LONG} 2</p></div><div id=comments><p>{LONG}</p></div>", f"Head\n{LONG}\n{LONG} 2"),
    (f"<ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>{LONG}<script>var t='</p>';</script></p><form><p>{LONG}</form><div class='cookie-notice'>{LONG}</div>", LONG),
    (f"<p>{LONG}</p><!-- <p>{LONG}</p> --><style>p{{margin:0}}</style><p hidden>{LONG}</p><p style='display:none'>x", LONG),
    (f"<main><p>{LONG}</p><aside>{LONG}</aside></main><p>{LONG}</p>", LONG),
    (f"<article><p>{LONG}</p><section class=comments><article><p>{LONG}</p></article></section></article>", LONG),
    (f"<article><p>a < b and a<b>c</b> d</p><p>{LONG}", f"a < b and ac d\n{LONG}"),
    (f"<article class=card><h3>Teaser</h3><p>A card.</article><div><p>{LONG} {LONG} {LONG}<p>{LONG} {LONG}</div>", f"Teaser\nA card.\n{LONG} {LONG} {LONG}\n{LONG} {LONG}"),
    (f"<main><p>{LONG}</p><p>{LONG}</p></main><div><p>{LONG} {LONG} {LONG}</p></div><p>short</p>", f"{LONG}\n{LONG}\n{LONG} {LONG} {LONG}"),
    ("<nav>a menu with words</nav><div><p>Few words.</p></div><footer>the end of it all</footer>", "Few words."),
    ("<article><p>unclosed <a href='x'>link</p><p>next", "unclosed link\nnext"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert extract(page) == text


def _pages():
    return [r["html"] for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]


class _Second(HTMLParser):
    """Another reading of simple pages: lines with their weights before marks, and whether they are in an article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.own, self.drop, self.article, self.link = [], "", 0, [], 0, 0

    def flush(self):
        if text := " ".join(self.text.split()):
            self.lines.append(("", 0, 0) if self.drop else (text, self.own, self.article))
        self.text, self.own = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "b", "br", "meta"):
            self.link += tag == "a"
            self.text += " " * (tag == "br")
            return
        self.flush()
        if tag in ("nav", "footer", "script", "style", "title") or dict(attrs).get("class") == "ad":
            self.drop.append(tag)
        self.article += tag == "article"

    def handle_endtag(self, tag):
        if tag in ("a", "b"):
            self.link -= tag == "a"
            return
        self.flush()
        if self.drop and tag == self.drop[-1]:
            self.drop.pop()
        self.article -= tag == "article"

    def handle_data(self, data):
        if "script" in self.drop or "style" in self.drop or "title" in self.drop:
            return
        self.text += data
        self.own += 0 if self.link else len(data.strip())


def _second(page):
    parser = _Second()
    parser.feed(page)
    parser.close()
    parser.flush()
    weights = [(w + html.LIFT if a else max(0, w - html.DOUBT)) if t else 0 for t, w, a in parser.lines]
    sums = [sum(weights[i : i + html.LINES]) for i in range(len(weights))]
    surges = [j for j, x in enumerate(sums) if weights[j] and x >= min(html.SURGE, max(sums) / 2)]
    kept = [i for i, w in enumerate(weights) if w and any(all(sums[j : i + 1]) if j <= i else all(weights[i:j]) for j in surges)]
    return "\n".join(parser.lines[i][0] for i in kept)


def test_as_a_second_extractor():
    for page in _pages():
        assert extract(page) == _second(page) != ""


def test_the_names_of_tags_decide_nothing_alone(monkeypatch):
    pages = _pages()
    for page in pages:
        assert extract(re.sub(r"<(/?)article\b", r"<\1div", page)) == extract(page)
    monkeypatch.setattr(html, "text_lines", lambda weights: [False] * len(weights))
    assert not any(map(extract, pages))


def test_lines_by_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.choice([0, 0, 3, 30, 90, 200]) for _ in range(rng.randint(0, 30))]
        sums = [sum(weights[i : i + html.LINES]) for i in range(len(weights))]
        surges = [j for j, x in enumerate(sums) if weights[j] and x >= min(html.SURGE, max(sums) / 2)]
        assert html.text_lines(weights) == [bool(w) and any(all(sums[j : i + 1]) if j <= i else all(weights[i:j]) for j in surges) for i, w in enumerate(weights)]


def test_long_and_broken_pages_end():
    assert extract("<article>" + "<div>" * 3000 + "x" + "</p>" * 3000) == "x"
    assert extract("<article><p>" + "word " * 200_000).count("word") == 200_000
    for broken in ("<", "<a", "<p title='", "<!--", "</", "<script>", "&#xZZ;", "<" * 5000, "<a '" * 3000):
        extract(broken)


def test_query_rows(spark):
    rows = [(i, f"u{i}", p, 7) for i, (p, _) in enumerate(CASES)] + [(0, None, None, 7)]
    out = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")).collect()
    assert len(out) == len(rows)
    assert all(r.text == extract(r.html) and r.n_chars == len(r.text) for r in out)
    assert extract_pages(spark.createDataFrame([], "page_id bigint, html string")).collect() == []
