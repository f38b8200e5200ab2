"""Main text of a web page by line-block distribution.

1. Markup is stripped into *lines*, one for each run of text between
   block-level tags.  Scripts, styles, comments of the markup and the head
   vanish.  A line remembers how much of it is link text and whether it lies
   in a container that never holds the article (menu, header, footer, sidebar,
   notice, advert, form, reader comments).
2. The *distribution*: each line's text length, 0 for a line of such a
   container, for one made of links, and - if the page marks its article with
   ``article``/``main`` - for one outside of it.  ``S[i]`` is the sum over the
   window of ``window`` lines that starts at ``i``.
3. A *surge point* is a line that carries text and whose window reaches
   ``surge`` characters (or, if no window of the page does, the largest there
   is); the *dive point* is the next place where a whole window is 0.  The
   text of the lines between is the page's text.  On a page that marks no
   article, stretches far smaller than the largest one (below ``share`` of
   it) are left out.

Defined results: null or empty html and pages without text give an empty
string.  Broken markup (unclosed tags, quotes, comments) is read to its end.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import functions as F

# Element and class names of the HTML standard and common usage.
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select
summary table tbody td tfoot th thead title tr ul""".split())
NEVER = frozenset("nav footer aside form menu dialog select option button textarea fieldset head title".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie
cookies consent gdpr notice notices banner comment comments disqus discussion reply replies respond footer menu nav
navbar navigation breadcrumb breadcrumbs share sharing social related recommended popup modal overlay newsletter
subscribe subscription widget login signin signup search disclaimer copyright toolbar pagination pager alert""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(["article", "main"])
TEASER = frozenset("ad advert comment comments promo related reply sponsored teaser".split())
UNCLOSED = frozenset("head header menu nav title".split())
CLOSED_BY_SELF = frozenset("dd dt li option p td th tr".split())

_RAW = "script|style|noscript|template|svg|iframe|object|math"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>"""
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([a-z]+)""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _is_noise(tag: str, attrs: str, inside: bool) -> bool:
    if tag in NEVER:
        return True
    if tag == "header":
        return not inside
    if not attrs or tag in ("html", "body"):
        return False
    if tag in ARTICLE:  # a comment or teaser may be marked as an article of its own
        return any(not TEASER.isdisjoint(_PARTS.split(m[1].lower())) for m in _NAMES.finditer(attrs))
    if (role := _ROLE.search(attrs)) and role[1].lower() in ROLES:
        return True
    for m in _NAMES.finditer(attrs):
        parts = _PARTS.split(m[1].lower())
        if not WORDS.isdisjoint(parts) or (not inside and ("header" in parts or "masthead" in parts)):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters of link text, in a noise container, in an article)."""
    out, text, link = [], [], 0
    stack: list[tuple[str, bool, bool, bool]] = []  # open blocks: (tag, noise by itself, noise, article)
    noise = article = False
    anchors = 0

    def flush():
        nonlocal link
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                out.append((line, link, noise, article))
            text.clear()
        link = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
            if anchors:
                link += m.start() - at
        at = m.end()
        close, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            anchors = 0 if close else 1
            continue
        if tag not in BLOCK and tag not in NEVER and not (tag == "span" and attrs and _is_noise(tag, attrs, article)):
            if not (close and stack and stack[-1][0] == tag):
                continue
        flush()
        anchors = 0
        if tag in VOID:
            continue
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            else:
                continue
            noise, article = stack[-1][2:] if stack else (False, False)
        elif not attrs.endswith("/"):
            if tag == "body":
                noise = False
            elif tag in ARTICLE:  # a menu or head that was not closed ends here
                noise = any(own and t not in UNCLOSED for t, own, _, _ in stack)
            if tag in CLOSED_BY_SELF and stack and stack[-1][0] == tag:
                stack.pop()
                noise, article = stack[-1][2:] if stack else (False, False)
            own = _is_noise(tag, attrs, article)
            noise = noise or own
            article = article or (tag in ARTICLE and not noise)
            stack.append((tag, own, noise, article))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def extract(page: str | None, window: int = 3, surge: int = 80, share: float = 0.3) -> str:
    """The page's main text; see the module's description."""
    if not page:
        return ""
    lines = lines_of(page)
    marked = any(a and not n for _, _, n, a in lines)
    size = [
        0 if noise or (marked and not article) or (not article and link > 0.6 * len(t)) else len(t)
        for t, link, noise, article in lines
    ]
    sums = [sum(size[i:i + window]) for i in range(len(size))]
    if not any(sums):
        return ""
    least = min(surge, max(sums))
    spans, i = [], 0
    while i < len(size):
        if size[i] and sums[i] >= (least if not marked else 1):
            j = i
            while j < len(size) and sums[j]:
                j += 1
            spans.append((i, j, sum(size[i:j])))
            i = j
        else:
            i += 1
    largest = max(n for _, _, n in spans)
    keep = [s for s in spans if marked or s[2] >= share * largest]
    return " ".join(lines[k][0] for a, b, _ in keep for k in range(a, b) if size[k])


def extract_main(column, window: int = 3, surge: int = 80, share: float = 0.3):
    """Column expression: main text of an html column."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, window, surge, share) for p in pages], dtype=object)

    return run(column)
