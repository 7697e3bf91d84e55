"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; the lengths of the text in LINES successive lines are summed, at every line. The
sums surge where text begins, having risen from nothing, and dive to nothing where it ends; lines that weigh something between
are kept. What is known of a line weighs into its length, as tags are dense in menus and absent in prose:

* text inside links counts nothing;
* lines inside elements that HTML itself reserves for other things (nav, footer, aside, form, button ...; also header outside of
  an article) or whose class, id or role names them (ads, comments, cookie notices, sidebars ...) weigh nothing;
* where a page marks its article (article, else main) and the mark holds a fair part of its text, lines in the mark weigh LIFT
  more, so short ones count among long ones, and lines outside DOUBT less, so only long prose does.

Sums surge at SURGE, on pages of little text at half of the largest sum. Nothing is decided by a tag alone.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a block.
LINES = 3
#: Characters of a block at which text surges; it dives when a block has none.
SURGE = 80
#: Characters that lines inside a marked article weigh more, and lines outside less.
LIFT, DOUBT = 27, 160
#: Least share of a page's text that a mark holds, if it counts.
SHARE = 1 / 3

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: Elements whose content is not parsed as markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math"}
_DROP = {"nav", "footer", "aside", "form", "button", "select", "option", "head", "dialog", "menu", "canvas", "object", "audio", "video", "label", "fieldset"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_OTHER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner\w*|sponsor\w*|promo\w*|comments?|commentlist|disqus\w*|repl(?:y|ies)|cookies?|consent\w*|gdpr|notices?|popup\w*|modal\w*|newsletter\w*|subscri\w*|side-?bar\w*|widget\w*|menus?|nav\w*|breadcrumbs?|footer\w*|masthead|site-?header|page-?header|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager|login|signup|search\w*|toolbar|skip\w*|hidden|toc)(?=$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "form", "menu", "menubar"}


@dataclass
class _Line:
    text: str  # empty where it is of other things
    weight: int  # characters outside links
    mark: int  # 2 in an article, 1 in main, else 0


def _other(attributes: str) -> bool:
    """Whether attributes say that an element is not part of the text."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id") and _OTHER.search(value) or name == "role" and value.lower() in _ROLES or name == "hidden":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def lines_of(page: str) -> list[_Line]:
    """The blocks of a page in order, without markup."""
    out: list[_Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # element, whether it drops its content, its mark
    drop = links = weight = 0
    inside, at, n = [0, 0, 0], 0, len(page)
    other_text = False

    def flush() -> None:
        nonlocal weight, other_text
        text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
        if text:
            out.append(_Line(text, weight, 2 if inside[2] else 1 if inside[1] else 0))
        if other_text:
            out.append(_Line("", 0, 0))
        parts.clear()
        weight, other_text = 0, False

    def pop() -> None:
        nonlocal drop
        _, d, mark = stack.pop()
        drop -= d
        inside[mark] -= 1

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            m_start, m_end = n, n
        else:
            m_start, m_end = m.span()
        if m_start > at and drop:
            other_text = other_text or not page[at:m_start].isspace()
        elif m_start > at:
            parts.append(page[at:m_start])
            if not links:
                weight += len(page[at:m_start].strip())
        at = m_end
        if m is None or not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "a":
            links = 0 if closing else 1
            continue
        if name in _INLINE and (closing or name == "img" or name == "wbr"):
            continue
        if name in _INLINE:
            if not m[3].rstrip().endswith("/") and _other(m[3]):
                # a hidden inline element: leave out up to its own end
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else at
            continue
        if name == "br":
            if not drop:
                parts.append(" ")
            continue
        flush()
        if name in _RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _VOID:
            continue
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                links = 0
                while len(stack) > depth:
                    pop()
            continue
        if name in _ENDS_P or name in ("li", "tr", "td", "th", "dt", "dd"):
            links = 0
        while stack and (stack[-1][0] == "p" and name in _ENDS_P or stack[-1][0] == name and name in ("li", "tr", "td", "th", "option") or {stack[-1][0], name} <= {"dt", "dd"}):
            pop()
        if m[3].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        mark = {"article": 2, "main": 1}.get(name, 0)
        other = name in _DROP or name == "header" and not inside[2] or name not in ("html", "body", "article", "main") and _other(m[3])
        if mark == 2 and _other(m[3]):
            mark, other = 0, True  # a reader's comment, say
        stack.append((name, other, mark))
        drop += other
        inside[mark] += 1
    flush()
    return out


def weights_of(lines: list[_Line]) -> list[int]:
    """What each line weighs in the distribution."""
    total = sum(x.weight for x in lines)
    for mark in (2, 1):
        held = [x.weight for x in lines if x.mark >= mark and x.text]
        if held and sum(held) >= SHARE * total:
            return [0 if not x.text else x.weight + LIFT if x.mark >= mark else max(0, x.weight - DOUBT) for x in lines]
    return [x.weight for x in lines]


def text_lines(weights: list[int]) -> list[bool]:
    """Which lines lie between a surge of the sums and the dive behind it, by the weights of the lines."""
    sums = [sum(weights[i : i + LINES]) for i in range(len(weights))]
    surge = min(SURGE, max(sums, default=0) / 2)
    keep, i = [False] * len(weights), 0
    while i < len(weights):
        if sums[i] >= surge and weights[i]:
            k = i - 1
            while k >= 0 and weights[k]:  # the sums rise from where they were nothing
                keep[k] = True
                k -= 1
            while i < len(weights) and sums[i]:  # up to the dive
                keep[i] = weights[i] > 0
                i += 1
        i += 1
    return keep


def extract(page: str | None) -> str:
    """Main text of a page: its blocks in order, one a line; empty for a null or empty page or one without text."""
    lines = lines_of(page or "")
    return "\n".join(x.text for x, k in zip(lines, text_lines(weights_of(lines)), strict=True) if k)


def _extract_all(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p.as_py()) for p in pages], pa.string())


def main_text(page: Column) -> Column:
    """Main text of a column of pages; narrow, every row by itself, null and empty pages give the empty text."""
    return F.arrow_udf(_extract_all, "string")(page)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text and its length in code points (n_chars) instead of the html; other columns and repeated rows stay."""
    out = pages.withColumn(text_col, main_text(F.col(html_col)))
    return out.withColumn("n_chars", F.length(text_col).cast("long"))
