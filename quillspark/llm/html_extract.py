"""Main text of web pages by line-block distribution.

Markup is stripped first: comments, scripts, styles, forms and elements that are boilerplate by their tag or by
the words of their class, id or role are cut out, block tags become line ends, and inline tags vanish. Every
block is then a line. The distribution is the text length of a sliding window of lines, boilerplate lines taken out; it
surges where the article starts and dives where it ends, and the text between every surge and its dive is kept. After
the dive has begun a span ends where boilerplate was cut out. Where no window surges, all lines that hold more than
links are the text. Link text counts nothing; a line of links alone is kept
inside a span, but WINDOW of them end it. Where the page marks its article (article, main, or role=main), every line
inside is kept and none outside, because lengths alone cannot tell a short heading or last line of the article from a
caption outside it. Inside an article boilerplate is known by its tag or by a whole name (or a frame's part of one).

Defined results: null or empty html, or a page without text, gives an empty text; unclosed tags end with the
block that holds them; every row gives a row, repeated ones too. Columns other than those named are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._common import with_struct

WINDOW, SURGE = 3, 80

#: Elements whose content is text of another kind (raw: no markup inside).
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "plaintext"}
#: Elements that hold no article text.
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "datalist", "svg", "canvas", "audio", "video", "object", "map", "math", "head", "fieldset", "search"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "basefont", "frame", "keygen"}
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of class, id, role or aria-label that name boilerplate.
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners breadcrumb breadcrumbs byline captcha comment comments commentlist comment-list consent contentinfo cookie cookies copyright "
    "disqus dialog discussion feedback footer footnav gdpr header hidden legal login masthead menu menus modal nav navbar navbox navigation navi newsletter notice notices notification notifications "
    "overlay pager pagination paywall popup popups privacy promo promos promoted promotion recommend recommended recommendations register related replies reply respond responses reviews rss search searchbox "
    "share sharing shares sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola outbrain teaser teasers toc toolbar tooltip topbar trending widget widgets alert alerts complementary".split()
)
ARTICLE_WORDS = {"main", "article", "articlebody", "post-content", "entry-content", "article-body", "article-content", "post-body", "story-body"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def _attrs(tag: str, at: int) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")).lower() for m in _ATTR.finditer(tag, at)}


#: Words that also name what holds an article beside such a part (a page with a sidebar).
LAYOUT = {"sidebar", "sidebars", "header", "nav", "navbar", "menu", "toolbar", "topbar", "banner", "banners", "ad", "ads", "widget", "widgets", "toc"}


#: What parts of a page's frame are made of.
FRAME = {"area", "bar", "block", "blocks", "box", "button", "buttons", "card", "cards", "container", "content", "feed", "form", "inner", "item", "items", "label", "links", "list", "module", "panel", "row", "section", "slot", "text", "unit", "widget", "wrap", "wrapper", "zone"}


def _boiler(name: str, attrs: dict[str, str], depth: int) -> int:
    """0: no boilerplate; 1: boilerplate; 2: by a word of LAYOUT alone. depth: how many article elements the element lies in."""
    if name in BOILER or (name == "header" and not depth):
        return 1
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return 1
    if name in ("html", "body", "main"):
        return 0
    for key in ("class", "id", "role"):
        value = attrs.get(key)
        if value:
            for word in value.split():
                if word in ARTICLE_WORDS:
                    return 0
                parts = re.split(r"[-_:0-9]+", word)
                # Inside an article a word must be the whole name, or its first or last part beside a word of a page's frame: a share price is no share bar.
                hits = WORDS & ({word, *parts} if not depth else {word} | ({parts[0], parts[-1]} if FRAME & set(parts) else set()))
                if depth:
                    hits -= {"header"}  # an article's own head
                if hits:
                    return 2 if hits <= LAYOUT else 1
    return 0


def _article(name: str, attrs: dict[str, str]) -> bool:
    return name in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articlebody" or any(w in ARTICLE_WORDS for key in ("class", "id") for w in attrs.get(key, "").split())


def lines(page: str) -> list[tuple[str, bool, bool, int]]:
    """The page's blocks in order: text, whether it is boilerplate, whether it lies in a marked article, and how many of its characters are link text."""
    out: list[tuple[str, bool, bool, int]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool, int]] = []  # name, boilerplate, article, boilerplate by layout words
    boiler = article = soft = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t:
                out.append((t, bool(boiler), bool(article), min(linked, len(t))))
            text.clear()
        linked = 0

    opened: Counter[str] = Counter()  # how many of each name are on the stack

    def pop() -> None:
        nonlocal boiler, article, soft
        name, b, a, s = stack.pop()
        opened[name] -= 1
        if b or a or name in BLOCK or name in BOILER:
            flush()
        boiler, article, soft = boiler - b, article - a, soft - s

    def push(name: str, b: int, a: bool, s: int) -> None:
        nonlocal boiler, article, soft
        stack.append((name, b, a, s))
        opened[name] += 1
        boiler, article, soft = boiler + b, article + a, soft + s

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            if opened["a"]:
                linked += m.start() - at
        at = m.end()
        tag = m[0]
        got = _NAME.match(tag)
        if not got:
            continue
        name = got[1].lower()
        if tag[1] == "/":
            if name in BLOCK or name in RAW:
                flush()
            if opened[name]:
                if name in BLOCK or name in BOILER:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                else:  # an inline element; blocks inside it stay open
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in BLOCK and stack[i][0] != name:
                            break
                        if stack[i][0] == name:
                            while len(stack) > i:
                                pop()
                            break
            continue
        if name in BLOCK:
            flush()
        if name in RAW:
            flush()
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in ("br", "wbr", "hr"):
            text.append("" if name == "wbr" else "\n")
        if name in VOID or tag.endswith("/>"):
            continue
        if name == "p" or name == "li" or name in ("dt", "dd", "tr", "td", "th", "option"):
            for i in range(len(stack) - 1, -1, -1):  # an open one of its kind ends here
                if stack[i][0] == name:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in BLOCK and stack[i][0] not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                    break
        attrs = _attrs(tag, got.end())
        b, a = _boiler(name, attrs, article), _article(name, attrs)
        if a and b == 2 and name in ("article", "main"):
            b = 0
        s = int(b == 2)
        b = min(b, 1)
        if b:
            flush()
        elif a and boiler and boiler == soft:
            b = s = -boiler  # the article of a page whose frame is named for its sidebar
        if b or a or name in BLOCK or name in ("b", "i", "em", "strong", "span", "a", "font", "u", "small"):
            if b or a or name in BLOCK:
                flush()
                push(name, b, a, s)
            elif name == "span" or name == "a":
                push(name, 0, False, 0)
    flush()
    return out


def distribution(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Text length of the window of lines that begins at each line."""
    total, out = 0, [0] * len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i] - (lengths[i + window] if i + window < len(lengths) else 0)
        out[i] = total
    return out


def between(lengths: list[int], gaps: list[bool]) -> list[tuple[int, int]]:
    """All spans of lines (start, end) from a surge to the dive after it. gaps: whether something was cut out before the line."""
    dist = distribution(lengths)
    out, i = [], 0
    while i < len(dist):
        if dist[i] >= SURGE and lengths[i]:
            j = i
            while j < len(dist) and (dist[j] >= SURGE or (lengths[j] and not gaps[j])):
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    rows, gaps, gap = [], [], False
    for text, boiler, marked, linked in lines(page):
        if not boiler:
            rows.append((text, marked, len(text) - linked))
            gaps.append(gap)
        gap = boiler
    if any(marked for _, marked, _ in rows):
        return " ".join(text for text, marked, _ in rows if marked)
    spans = between([n for _, _, n in rows], gaps)
    return " ".join(text for i, j in spans for text, _, _ in rows[i:j]) if spans else " ".join(text for text, _, n in rows if n > 0)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    df = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    made = lambda col: pa.StructArray.from_arrays([pa.array([extract(x.as_py()) for x in col], pa.string())], ["text"])
    df = with_struct(df, "main", StructType([StructField("text", StringType())]), ["html"], made)
    return df.select("page_id", "url", F.col("main.text").alias("text"), F.length("main.text").cast("long").alias("n_chars"))
