"""HTML extraction by flat text blocks.

A page is cut at its block-level tags into a flat list of text blocks. Each block has its word count and link density, those
of the blocks before and after it, a hint of its surroundings, and the share of the page's words that lie in surroundings
of content. Surroundings are 2 in an article or main element, 1 in a container named as content, 0 where nothing is said, -1 in one that often wraps whole pages but
is no content by name (a form, a page header, a search box), -2 in one whose name may speak of side matter (related, social, notice), and -3 in what
cannot be content (menus, footers, sidebars, adverts, cookie notices and comments by element or by name, hidden elements). A decision tree
trained on the small labelled table below says which blocks are main text; these are joined by line breaks. So a name such as `related` takes a long text
away only where the page has its content elsewhere, and an unnamed notice or thread outside the article goes where there is an article.

Names are read from class, id and role, a whole class token at a time: of the parts of a token (`site-footer`) the last one
that is not of general meaning decides (`comments-list` is of comments, `comments-open` and `search-results-page` say
nothing), and a token with a part such as `no` or `with` says nothing (`with-sidebar`). An article or main element inside
surroundings of -1, and a main element inside those of -2, is main text again.

Malformed pages are read as far as they go: unclosed elements end with an enclosing one, a tag cut off at the end is
dropped, an unclosed script or style runs to the end.

Defined results: a null or empty page, or one without main text, gives an empty text; repeated rows are kept; other columns
are carried along; very long pages are read whole. The work is row by row, so no row leaves its task.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import chunks

_WORDS = lambda s: frozenset(s.split())
BREAKS = _WORDS("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul")
SPACES = _WORDS("br wbr img input embed")
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr")
#: Elements whose content is never text.
SILENT = "script|style|noscript|template|svg|math|iframe|object|textarea|select|button|title|audio|video|canvas"
#: Fixed lists: elements and names (of class, id and role) by what they hold.
AWAY = _WORDS("nav footer aside dialog menu")
HOME = _WORDS("article main")
AWAY_NAMES = _WORDS(
    "ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus foot footer gdpr "
    "masthead menu nav navbar navigation newsletter pagination pingback respond sidebar skip skyscraper sponsor sponsored tagcloud"
)
SIDE_NAMES = _WORDS(
    "alert alerts byline complementary disclaimer discussion feedback login modal notice notices notification pager popup popular promo promotion recommended related replies reply share sharing side signup social subscribe subscription trending"
)
WRAP_NAMES = _WORDS("banner dialog dropdown form header overlay search toolbar topbar")
HOME_NAMES = _WORDS("article content entry main maincontent post story articlebody")
#: Parts of names that say nothing by themselves, and parts that turn a token's meaning.
GENERAL = _WORDS("area articles bar block body bottom box button buttons col column container cta group holder icon icons inner item items label left link links list news outer panel posts primary right row secondary section slot small stories text title top unit wrap wrapper zone")
TURNS = _WORDS("has hasnt no non not under with without")

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({SILENT})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z", re.S | re.I)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_PART = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


def _token(token: str) -> int:
    """What a class token says: -3, -2, -1, 1 or nothing (0)."""
    parts = [x for x in _PART.split(_HUMP.sub(r"\1-\2", token.split("--")[0]).lower()) if x]
    if TURNS.intersection(parts):
        return 0
    while len(parts) > 1 and (parts[-1] in GENERAL or len(parts[-1]) == 1):
        parts.pop()
    last = parts[-1] if parts else ""
    return -3 if last in AWAY_NAMES else -2 if last in SIDE_NAMES else -1 if last in WRAP_NAMES else int(last in HOME_NAMES)


def _named(attributes: str) -> int:
    """What the names of an element say; away goes before content."""
    said = [_token(t) for m in _NAMED.findall(attributes) for t in "".join(m).split()]
    return min(said, default=0) if min(said, default=0) < 0 else max(said, default=0)


def _surroundings(tag: str, attributes: str, now: int) -> int:
    """Of what is in this element; `now` is what its own surroundings are."""
    if tag in ("html", "body") or now == -3:
        return now
    if tag in AWAY or (attributes and _HIDDEN.search(attributes)):
        return -3
    name = _named(attributes) if attributes else 0
    if now == -2:
        return -3 if name == -3 else 2 if tag == "main" and name > -2 else -2
    if tag in HOME:
        return name if name <= -2 else 2
    if tag == "header" and now >= 1:
        return now  # of the article
    if name < 0 or tag in ("header", "form"):
        return min(name, -1)
    return max(now, name) if now >= 0 else now


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """The text blocks in order: text, words, share of words in links, surroundings."""
    found: list[tuple[str, int, float, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    now = links = at = 0
    text: list[str] = []
    linked: list[str] = []

    def close():
        nonlocal text, linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                n = whole.count(" ") + 1
                m = len(html.unescape("".join(linked)).split())
                found.append((whole, n, min(1.0, m / n), now))
        text, linked = [], []

    def add(piece: str):
        if piece:
            text.append(piece)
            if links:
                linked.append(piece + " ")

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BREAKS:
            close()
        elif tag in SPACES:
            add(" ")
        if not m[2]:
            if tag not in VOID and not m[4].endswith("/"):
                stack.append((tag, now))
                opened[tag] += 1
                links += tag == "a"
                inner = _surroundings(tag, m[4], now)
                if inner != now:
                    close()
                    now = inner
        elif opened[tag]:
            while True:
                t, before = stack.pop()
                opened[t] -= 1
                links -= t == "a"
                if before != now:
                    close()
                    now = before
                if t == tag:
                    break
    add(page[at:])
    close()
    return found


#: Small labelled table: words, link density, words and link density before, words and link density after, surroundings, main text;
#: of pages with all their content in such surroundings (share 1), or without any (share 0), as the surroundings say.
#: Surroundings are a hint: some blocks of menus and adverts lie in articles, some text lies in what only wraps it.
_NAMED_ROWS = np.array(
    [
        # menus, footers, adverts, notices, comments: named as such
        (1, 1.0, 0, 0.0, 1, 1.0, -2, 0), (2, 1.0, 1, 1.0, 2, 1.0, -2, 0), (6, 1.0, 2, 1.0, 4, 1.0, -2, 0), (1, 1.0, 1, 1.0, 14, 0.0, -2, 0),
        (9, 0.0, 1, 1.0, 12, 0.0, -2, 0), (14, 0.0, 1, 1.0, 60, 0.0, -2, 0), (40, 0.0, 2, 1.0, 80, 0.0, -2, 0), (25, 0.1, 90, 0.0, 0, 0.0, -2, 0),
        (5, 0.0, 70, 0.0, 0, 0.0, -2, 0), (11, 0.3, 120, 0.0, 3, 1.0, -2, 0), (60, 0.0, 80, 0.0, 30, 0.0, -2, 0), (120, 0.0, 10, 0.0, 50, 0.0, -2, 0),
        (2, 0.0, 30, 0.0, 60, 0.0, -2, 0), (15, 0.0, 60, 0.0, 15, 0.0, -2, 0), (80, 0.0, 90, 0.0, 70, 0.0, -2, 0), (35, 0.2, 5, 0.0, 35, 0.2, -2, 0),
        (4, 0.0, 12, 0.0, 3, 0.0, -2, 0), (1, 0.0, 200, 0.0, 20, 0.0, -2, 0), (50, 0.1, 1, 1.0, 50, 0.1, -2, 0), (18, 0.0, 18, 0.0, 110, 0.0, -2, 0),
        (7, 0.5, 25, 0.0, 33, 0.0, -2, 0), (110, 0.0, 3, 0.0, 8, 0.0, -2, 0), (28, 0.0, 44, 0.1, 0, 0.0, -2, 0), (65, 0.3, 28, 0.0, 65, 0.0, -2, 0),
        # forms, page headers and the like: slogans and labels, but also the text of pages that they wrap
        (3, 0.0, 1, 1.0, 2, 1.0, -1, 0), (8, 0.0, 2, 1.0, 1, 1.0, -1, 0), (5, 0.2, 0, 0.0, 1, 1.0, -1, 0), (2, 1.0, 5, 0.2, 2, 1.0, -1, 0),
        (1, 0.0, 1, 0.0, 1, 0.0, -1, 0), (2, 0.0, 4, 0.0, 6, 0.0, -1, 0), (12, 0.0, 3, 0.0, 2, 1.0, -1, 0), (14, 0.1, 0, 0.0, 3, 0.9, -1, 0),
        (7, 0.0, 10, 0.0, 30, 0.0, -1, 0), (20, 0.0, 2, 0.0, 1, 1.0, -1, 0), (4, 0.0, 2, 0.0, 45, 0.0, -1, 0), (18, 0.0, 1, 1.0, 70, 0.0, -1, 0),
        (30, 0.0, 10, 0.0, 3, 0.0, -1, 0), (45, 0.0, 4, 0.0, 20, 0.0, -1, 0), (26, 0.1, 2, 0.0, 1, 0.0, -1, 0), (38, 0.0, 0, 0.0, 60, 0.0, -1, 0),
        (24, 0.0, 50, 0.0, 2, 0.0, -1, 0), (33, 0.1, 70, 0.0, 40, 0.0, -1, 0), (48, 0.0, 12, 0.0, 5, 0.0, -1, 0), (22, 0.0, 6, 0.0, 30, 0.0, -1, 0),
        (75, 0.0, 60, 0.0, 80, 0.0, -1, 1), (60, 0.1, 90, 0.0, 40, 0.1, -1, 1), (120, 0.0, 9, 0.0, 55, 0.0, -1, 1), (90, 0.05, 70, 0.1, 12, 0.2, -1, 1),
        # articles and main elements, and containers named as content
        (10, 0.0, 8, 0.0, 70, 0.0, 2, 1), (7, 0.0, 1, 1.0, 40, 0.0, 2, 1), (3, 0.0, 50, 0.0, 90, 0.0, 2, 1), (2, 0.0, 60, 0.0, 9, 0.0, 1, 1),
        (1, 0.0, 30, 0.0, 5, 0.0, 2, 1), (12, 0.0, 1, 0.0, 3, 0.0, 1, 1), (80, 0.02, 12, 0.0, 45, 0.0, 2, 1), (45, 0.1, 80, 0.0, 2, 0.0, 1, 1),
        (150, 0.0, 10, 0.0, 6, 0.0, 1, 1), (30, 0.2, 9, 0.0, 60, 0.1, 2, 1), (22, 0.4, 60, 0.0, 70, 0.0, 2, 1), (18, 0.5, 30, 0.0, 25, 0.0, 1, 1),
        (4, 0.0, 2, 0.0, 6, 0.0, 2, 1), (8, 0.0, 40, 0.0, 14, 0.3, 1, 1), (5, 0.2, 3, 0.0, 4, 0.0, 2, 1), (300, 0.0, 0, 0.0, 0, 0.0, 2, 1),
        (2, 0.0, 3, 1.0, 2, 1.0, 2, 1), (20, 0.0, 1, 1.0, 4, 1.0, 2, 1), (1, 0.0, 12, 0.0, 1, 1.0, 2, 1), (55, 0.0, 6, 1.0, 9, 0.9, 1, 1),
        (70, 0.3, 2, 0.8, 11, 0.6, 1, 1), (5, 0.3, 20, 0.5, 1, 0.9, 2, 1), (1, 0.0, 1, 0.0, 1, 0.0, 2, 1), (9, 0.5, 3, 0.7, 15, 0.8, 2, 1),
        (200, 0.0, 40, 0.4, 150, 0.2, 1, 1), (33, 0.0, 100, 0.0, 7, 0.5, 1, 1), (13, 0.1, 7, 0.3, 21, 1.0, 2, 1), (3, 0.0, 16, 0.0, 26, 0.7, 2, 1),
        # a block that is one link is text beside text, and a menu beside other links
        (3, 1.0, 40, 0.0, 55, 0.0, 2, 1), (4, 1.0, 25, 0.1, 30, 0.0, 2, 1), (2, 0.9, 60, 0.0, 12, 0.1, 1, 1), (6, 1.0, 18, 0.0, 80, 0.0, 2, 1),
        (9, 0.8, 33, 0.2, 41, 0.0, 1, 1), (5, 1.0, 70, 0.0, 20, 0.2, 1, 1), (1, 1.0, 15, 0.0, 35, 0.0, 2, 1), (12, 0.7, 22, 0.0, 16, 0.1, 2, 1),
        (2, 1.0, 40, 0.0, 2, 1.0, 2, 0), (3, 1.0, 2, 1.0, 4, 1.0, 2, 0), (6, 1.0, 3, 1.0, 0, 0.0, 1, 0), (10, 0.9, 60, 0.0, 8, 1.0, 2, 0),
        (4, 1.0, 5, 0.9, 50, 0.0, 2, 0), (2, 0.9, 3, 1.0, 30, 0.1, 1, 0), (7, 1.0, 30, 0.0, 6, 1.0, 1, 0), (5, 0.8, 4, 1.0, 3, 0.8, 2, 0),
        (2, 1.0, 25, 1.0, 30, 1.0, 2, 0), (4, 1.0, 18, 0.9, 50, 0.0, 1, 0), (6, 0.8, 40, 1.0, 22, 0.0, 2, 0), (3, 1.0, 16, 0.9, 12, 1.0, 1, 0),
        (3, 1.0, 6, 0.0, 9, 0.0, 2, 1), (2, 1.0, 8, 0.0, 5, 0.1, 1, 1), (5, 0.9, 11, 0.1, 7, 0.0, 2, 1), (4, 1.0, 3, 0.0, 14, 0.0, 2, 1),
        # no surroundings to go by: links, and short blocks among links
        (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0), (5, 0.8, 4, 1.0, 6, 0.9, 0, 0), (12, 0.7, 3, 1.0, 2, 1.0, 0, 0),
        (3, 0.0, 2, 1.0, 2, 1.0, 0, 0), (6, 0.0, 1, 1.0, 4, 0.8, 0, 0), (4, 0.0, 0, 0.0, 1, 1.0, 0, 0), (8, 0.0, 5, 0.0, 3, 1.0, 0, 0),
        (6, 0.1, 4, 0.9, 0, 0.0, 0, 0), (9, 0.5, 8, 0.0, 2, 1.0, 0, 0), (20, 0.8, 5, 1.0, 12, 0.9, 0, 0), (30, 0.6, 10, 1.0, 8, 1.0, 0, 0),
        (7, 0.0, 3, 1.0, 5, 1.0, 0, 0), (2, 0.0, 6, 1.0, 7, 0.9, 0, 0), (10, 0.6, 5, 0.9, 4, 1.0, 0, 0), (5, 0.0, 8, 0.9, 3, 0.9, 0, 0),
        (6, 0.0, 20, 1.0, 15, 0.9, 0, 0), (3, 0.0, 14, 0.9, 18, 1.0, 0, 0), (7, 0.1, 30, 1.0, 12, 1.0, 0, 0), (9, 0.3, 16, 1.0, 25, 0.9, 0, 0),
        (3, 0.75, 40, 0.0, 0, 0.0, 0, 0), (5, 0.67, 12, 0.0, 0, 0.0, 0, 0), (4, 0.75, 30, 0.0, 2, 1.0, 0, 0), (7, 0.7, 4, 0.0, 0, 0.0, 0, 0),
        (2, 1.0, 0, 0.0, 40, 0.0, 0, 0), (4, 1.0, 0, 0.0, 60, 0.1, 0, 0), (3, 0.9, 40, 0.0, 0, 0.0, 0, 0), (1, 1.0, 50, 0.0, 0, 0.0, 0, 0),
        (6, 1.0, 35, 0.0, 50, 0.0, 0, 0), (3, 1.0, 42, 0.0, 38, 0.0, 0, 0), (8, 0.9, 12, 0.1, 90, 0.0, 0, 0), (2, 0.8, 22, 0.0, 18, 0.0, 0, 0),
        # text, also short text among text, and paragraphs between menus
        (25, 0.0, 6, 0.0, 40, 0.0, 0, 1), (60, 0.05, 20, 0.0, 30, 0.0, 0, 1), (35, 0.1, 3, 1.0, 50, 0.0, 0, 1), (90, 0.0, 0, 0.0, 0, 0.0, 0, 1),
        (18, 0.0, 40, 0.0, 22, 0.0, 0, 1), (8, 0.0, 40, 0.0, 45, 0.0, 0, 1), (6, 0.0, 25, 0.0, 60, 0.0, 0, 1), (3, 0.0, 50, 0.0, 35, 0.0, 0, 1),
        (7, 0.0, 2, 1.0, 70, 0.0, 0, 1), (40, 0.2, 60, 0.0, 3, 1.0, 0, 1), (120, 0.3, 4, 1.0, 5, 1.0, 0, 1), (16, 0.1, 30, 0.0, 4, 0.0, 0, 1),
        (30, 0.0, 4, 1.0, 3, 1.0, 0, 1), (22, 0.1, 2, 1.0, 6, 0.9, 0, 1), (3, 0.0, 6, 0.0, 8, 0.0, 0, 1), (2, 0.0, 5, 0.0, 4, 0.0, 0, 1),
        (5, 0.0, 3, 0.0, 7, 0.1, 0, 1), (4, 0.0, 9, 0.0, 2, 0.0, 0, 1), (14, 0.4, 30, 0.0, 28, 0.0, 0, 1), (11, 0.5, 45, 0.1, 20, 0.0, 0, 1),
        (6, 0.6, 35, 0.0, 50, 0.0, 0, 1), (26, 0.0, 45, 0.0, 2, 1.0, 0, 1), (9, 0.2, 12, 0.0, 31, 0.1, 0, 1),
    ]
)
#: The same with the share of the page's words in surroundings of content, before the label.
_SHARED_ROWS = np.array(
    [
        # beside an article that has most of the page's words: what stands outside it is no text of it, whatever its length
        (40, 0.0, 60, 0.0, 0, 0.0, 0, 0.9, 0), (65, 0.0, 80, 0.0, 30, 0.0, 0, 0.8, 0), (12, 0.0, 3, 1.0, 50, 0.0, 0, 0.95, 0), (25, 0.1, 90, 0.0, 18, 0.0, 0, 0.7, 0),
        (90, 0.0, 60, 0.0, 70, 0.0, 0, 0.6, 0), (6, 0.0, 30, 0.0, 45, 0.0, 0, 0.9, 0), (18, 0.0, 12, 0.0, 22, 0.0, 0, 0.8, 0), (33, 0.2, 8, 0.0, 5, 1.0, 0, 0.75, 0),
        (120, 0.0, 40, 0.0, 35, 0.0, 0, 0.65, 0), (50, 0.0, 0, 0.0, 80, 0.0, 0, 0.85, 0), (8, 0.0, 100, 0.0, 9, 0.0, 0, 1.0, 0), (28, 0.0, 28, 0.0, 28, 0.0, 0, 0.7, 0),
        (80, 0.0, 70, 0.0, 10, 0.0, -1, 0.8, 0), (110, 0.0, 20, 0.0, 60, 0.0, -1, 0.7, 0), (70, 0.05, 90, 0.0, 40, 0.0, -1, 0.9, 0), (95, 0.0, 4, 1.0, 75, 0.0, -1, 0.65, 0),
        # beside a small one: a teaser or a quotation, the text is elsewhere
        (40, 0.0, 60, 0.0, 55, 0.0, 0, 0.2, 1), (65, 0.0, 80, 0.0, 30, 0.0, 0, 0.1, 1), (25, 0.1, 90, 0.0, 18, 0.0, 0, 0.3, 1), (90, 0.0, 60, 0.0, 70, 0.0, 0, 0.25, 1),
        (18, 0.0, 12, 0.0, 22, 0.0, 0, 0.15, 1), (33, 0.2, 28, 0.0, 45, 0.0, 0, 0.35, 1), (120, 0.0, 4, 1.0, 35, 0.0, 0, 0.3, 1), (8, 0.0, 40, 0.0, 45, 0.0, 0, 0.2, 1),
        (12, 0.0, 30, 0.0, 50, 0.0, 2, 0.2, 1), (30, 0.1, 9, 0.0, 60, 0.0, 1, 0.3, 1), (5, 0.0, 20, 0.0, 35, 0.0, 2, 0.15, 1), (60, 0.0, 3, 1.0, 12, 0.0, 1, 0.25, 1),
        # names of side matter: long text without links is the page's text if there is no other
        (66, 0.0, 0, 0.0, 0, 0.0, -2, 0.0, 1), (80, 0.0, 70, 0.0, 60, 0.0, -2, 0.0, 1), (120, 0.1, 3, 1.0, 90, 0.0, -2, 0.05, 1), (58, 0.0, 40, 0.0, 4, 1.0, -2, 0.0, 1),
        (200, 0.0, 8, 0.0, 0, 0.0, -2, 0.1, 1), (75, 0.05, 0, 0.0, 55, 0.0, -2, 0.0, 1), (95, 0.0, 60, 0.0, 2, 1.0, -2, 0.15, 1), (62, 0.0, 5, 1.0, 65, 0.0, -2, 0.0, 1),
        (66, 0.0, 0, 0.0, 60, 0.0, -2, 0.9, 0), (80, 0.0, 70, 0.0, 60, 0.0, -2, 1.0, 0), (120, 0.1, 60, 0.0, 90, 0.0, -2, 0.8, 0), (58, 0.0, 40, 0.0, 4, 1.0, -2, 0.7, 0),
        (200, 0.0, 80, 0.0, 0, 0.0, -2, 0.65, 0), (75, 0.05, 60, 0.0, 55, 0.0, -2, 0.9, 0), (95, 0.0, 60, 0.0, 2, 1.0, -2, 1.0, 0), (62, 0.0, 5, 1.0, 65, 0.0, -2, 0.75, 0),
        (12, 0.0, 0, 0.0, 9, 0.0, -2, 0.0, 0), (25, 0.1, 90, 0.0, 4, 0.0, -2, 0.0, 0), (40, 0.0, 20, 0.0, 60, 0.0, -2, 0.0, 0), (70, 0.6, 5, 1.0, 30, 0.8, -2, 0.0, 0),
    ]
)


def _table() -> np.ndarray:
    """All labelled rows with a share; names of the first table's lowest rows are certain."""
    place = _NAMED_ROWS[:, 6].copy()
    share = (place >= 1).astype(float)
    place[place == -2] = -3
    return np.vstack([np.column_stack([_NAMED_ROWS[:, :6], place, share, _NAMED_ROWS[:, 7]]), _SHARED_ROWS])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A decision tree by Gini impurity: a share of label 1, or (feature, threshold, below or equal, above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(v))
        cut = np.flatnonzero((v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least))
        if not len(cut):
            continue
        n, a = cut + 1.0, ones[cut]
        b, m = ones[-1] - a, len(v) - n
        impurity = a * (1 - a / n) + b * (1 - b / m)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0] - 1e-12:
            best = (impurity[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
    if best is None:
        return share
    _, f, t = best
    left = x[:, f] <= t
    return f, float(t), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def decide(tree, row) -> float:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


LABELLED = _table()
TREE = grow(LABELLED[:, :-1], LABELLED[:, -1], depth=12)


def main_text(page: str | None, tree=TREE) -> str:
    found = blocks(page) if page else []
    weighed = [(words * (1 - density), place) for _, words, density, place in found if place > -3]
    share = sum(w for w, place in weighed if place >= 1) / max(1e-9, sum(w for w, _ in weighed))
    out = []
    for k, (text, words, density, place) in enumerate(found):
        before = found[k - 1] if k else ("", 0, 0.0, 0)
        after = found[k + 1] if k + 1 < len(found) else ("", 0, 0.0, 0)
        if decide(tree, (words, density, before[1], before[2], after[1], after[2], place, share)) >= 0.5:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, source: str = "html", out: str = "text", keep_source: bool = True) -> DataFrame:
    """Add the main text of every row as `out`, and its code points as n_chars."""
    kept = [f for f in pages.schema.fields if (keep_source or f.name != source) and f.name not in (out, "n_chars")]
    schema = StructType([*kept, StructField(out, StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, source):
                texts = [main_text(x) for x in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*(f.name for f in kept), out, "n_chars"])

    return pages.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep_source=False).select("page_id", "url", "text", F.col("n_chars"))
