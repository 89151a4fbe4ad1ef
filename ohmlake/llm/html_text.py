"""Main text of HTML pages by line-block distribution (operator 9).

Markup is stripped in one pass that turns a page into lines, one for each block-level element.
What the markup itself calls something other than the article (nav, footer, form, script, elements
with a class, id or role such as "ad", "menu" or "comments", ...) gives no lines. Inside an article only whole
names such as "related-posts" do so, on containers; a container with a lesser hint, or with one in its id
anywhere, stays unless most of its text is links. Headings and paragraphs are never judged by ids. Over the others,
text lengths are summed in windows of WINDOW lines, less the text of links: text surges where that
sum first passes a threshold and dives where it next falls to nothing. These stretches choose what is kept,
on every page. What a page marks as its article (article, main) only moves their ends: a stretch that touches such an
element grows to the whole of it, since lengths alone would cut off short paragraphs there, and is cut at its ends
if most of its text is inside. Lines between two stretches stay if all stand directly in one div or section,
as a list of links in the middle of an article does. A marked element that no stretch touches, such as a teaser, goes where
another one is touched; where none is, marked lines are kept beside the stretches, and a page without
marks and without a surge gives all its lines.

A null, empty or text-less page has an empty text. Character references are decoded, white space
within a block becomes one space, blocks are joined by a newline; nothing else is dropped or capped.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .common import read, texts, with_columns

WINDOW = 3
#: A window of lines with this many characters outside links starts a stretch.
SURGE = 60

FIELDS = [("main_text", "string"), ("n_chars", "bigint")]

#: Elements whose content is never read.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video title select textarea".split())
#: Elements that are no part of an article.
APART = frozenset("nav footer aside form dialog menu button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that the rules about class, id and role hold for.
CONTAINERS = BLOCKS - frozenset("html body article main h1".split()) | {"span"}
#: Elements whose own lines stand together.
BOXES = frozenset("div section article main".split())
#: Containers that hold other elements, and those whose ids are made from headings or are their own.
HOLDERS = frozenset("div section aside ul ol span".split())
TEXTS = frozenset("h2 h3 h4 h5 h6 p pre blockquote li dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class or id that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation navi menu submenu breadcrumb breadcrumbs sidebar sidenav footer masthead topbar toolbar "
    "related recommended share sharing social pagination pager widget disqus respond reply replies discussion skip".split()
)
#: Those of them that mark other texts, which may be articles by their elements.
OTHERS = frozenset("related recommended disqus respond reply replies discussion".split())
#: Whole tokens of a class that leave no doubt, and those of them that no heading makes an id of.
WHOLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsored promo sidebar navbar breadcrumb breadcrumbs pagination pager comments commentlist respond newsletter".split()
)
WHOLE_IDS = frozenset(
    "adsbygoogle related-posts related-articles related-stories related-content recommended-posts recommended-articles share-buttons share-bar share-links sharing-buttons "
    "social-share social-buttons social-icons sharedaddy addtoany comment-list comments-area comments-section comment-section comment-respond comment-body disqus_thread "
    "newsletter-signup newsletter-form signup-form subscribe-form cookie-notice cookie-banner cookie-consent ad-slot ad-container ad-wrapper".split()
)
#: Words that headings have as well as layouts: in an id they only raise a doubt.
DOUBTFUL = OTHERS | frozenset("cookie cookies consent gdpr notice popup modal overlay sponsor sponsored promo promotion newsletter subscribe subscription signup login share sharing social pagination skip advertising advertisement ad ads menu navigation banner widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<silent>" + "|".join(sorted(SILENT)) + r")\b[^>]*>.*?(?:</(?P=silent)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"<]*"|'[^'<]*')*+|[^>]*)>""",
    re.S | re.I,
)
_CLOSING = re.compile(r"</([a-z][^\s/>]*)", re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_COMMENT = re.compile(r"(?:div-)?comments?(?:[-_](?:list|body|item|thread|content|area|section|wrapper|container|form|text|box|block|[0-9]+))?|commentlist")
_SPLIT = re.compile(r"[\s_\-:]+")


def set_apart(name: str, attrs: str, in_article: bool) -> int:
    """Whether an element is no part of the article: 2 for sure, 1 unless an article stands inside it, 3 if most of its text is links, else 0."""
    if name in APART or name == "header" and not in_article:
        return 2
    if name not in CONTAINERS and name != "article" or not attrs.strip():
        return 0
    said = 2 if name != "article" and _HIDDEN.search(attrs) else 0
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        whole, found = value.split(), _SPLIT.split(value)
        if key == "role":
            if name != "article" and not ROLES.isdisjoint(found):
                return 2
            continue
        if name == "article":  # its class may have the article's own topics, its id the article's title
            if any(_COMMENT.fullmatch(x) or key == "class" and (x in OTHERS or x in WHOLE_IDS) for x in whole):
                return 2
            continue
        if name in TEXTS and (in_article or key == "id") or in_article and name not in HOLDERS:
            continue
        if (in_article or name in TEXTS or key == "id") and (not WHOLE_IDS.isdisjoint(whole) or key == "class" and not WHOLE.isdisjoint(whole)):
            return 2
        if name in TEXTS:
            continue
        other = not OTHERS.isdisjoint(found) or "comment" in found or "comments" in found
        if key == "id" and "comments" in whole and (name == "div" or not in_article):
            return 2
        if in_article or key == "id" and (other or name == "section" or not DOUBTFUL.isdisjoint(found)):
            if name != "span" and (other or not MARKS.isdisjoint(found)):
                said = said or 3
        elif other:
            return 2
        elif not MARKS.isdisjoint(found) or "header" in found:
            said = 1 if said != 2 else 2  # a word in the class of a wrapper may be about its layout
    return said


def lines_of(page: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """Lines of a page, characters of each inside links, the number of the outermost marked article it is in (0: none), and its innermost div or section."""
    lines: list[str] = []
    linked: list[int] = []
    marked: list[int] = []
    boxes: list[int] = []
    open_: list[tuple[str, int]] = []  # open divs, sections and articles, numbered as they begin
    n_open = 0
    run: list[str] = []
    in_boxes = dict.fromkeys(BOXES, 0)  # how many of each are in open_
    closed = {m[1].lower(): m.start() for m in _CLOSING.finditer(page)}  # where each name is closed last
    links = at = 0
    article = n_articles = 0  # open article and main elements, and how many outermost ones began
    skip, depth = "", 0  # element that is skipped, and how many of its name are open
    opened = False  # whether the skipped element is never closed
    sure = 0  # what set_apart says of it
    in_link = False
    doubted: list[list] = []  # open elements in doubt: name, how many of it are open, its first line

    def decide(to: int) -> None:
        """Close the elements in doubt from ``to`` on; their lines go if most of the text is links."""
        while len(doubted) > to:
            first = doubted.pop()[2]
            if 2 * sum(linked[first:]) > sum(map(len, lines[first:])):
                del lines[first:], linked[first:], marked[first:], boxes[first:]

    def flush() -> None:
        nonlocal links
        if run:
            line = " ".join("".join(run).split())
            if line:
                lines.append(line)
                linked.append(links)
                marked.append(n_articles if article else 0)
                boxes.append(open_[-1][1] if open_ else 0)
            run.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = _html.unescape(text) if "&" in text else text
            run.append(text)
            if in_link:
                links += len(text)

    for m in _TOKEN.finditer(page):
        if not skip:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name, end = name.lower(), bool(m["end"])
        if skip:
            if not end and (opened and name in ("article", "main", "h1", "section", "p") or sure == 1 and name in ("article", "main")):
                skip = ""
            else:
                if name == skip:
                    depth += -1 if end else 1
                    if not depth:
                        skip = ""
                elif end and article and name in ("article", "main"):  # it was left open
                    skip = ""
                if skip or end and name not in ("article", "main"):
                    continue
        if end:
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                flush()
                if name in BOXES and in_boxes[name]:
                    while True:
                        box = open_.pop()[0]
                        in_boxes[box] -= 1
                        if box == name:
                            break
                if name in ("article", "main") and article:
                    article -= 1
                    doubted.clear()  # those that are open still have no end
                elif doubted and name == doubted[-1][0]:
                    doubted[-1][1] -= 1
                    if not doubted[-1][1]:
                        decide(len(doubted) - 1)
            elif name in ("td", "th"):
                run.append(" ")
            continue
        if (sure := set_apart(name, m["attrs"], article > 0)) in (1, 2):
            if name not in VOID and not m["attrs"].endswith("/"):
                if name in BLOCKS:
                    flush()
                skip, depth = name, 1
                opened = closed.get(name, -1) < at
            continue
        if name == "a":
            in_link = True
        elif name in BLOCKS:
            flush()
            if name in BOXES:
                n_open += 1
                open_.append((name, n_open))
                in_boxes[name] += 1
            if name in ("article", "main"):
                n_articles += not article
                article += 1
                doubted.clear()
            elif sure == 3:
                doubted.append([name, 1, len(lines)])
            elif doubted and name == doubted[-1][0]:
                doubted[-1][1] += 1
        elif name in ("br", "td", "th"):
            run.append(" ")
    if not skip:
        add(page[at:])
    flush()
    return lines, linked, marked, boxes


def stretches(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First line and line after the last of each stretch between surge and dive."""
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    sums = (total[np.minimum(np.arange(n) + window, n)] - total[:n]).tolist()
    out, a = [], None
    for i in range(n + 1):
        if a is None and i < n and sums[i] >= surge and lengths[i] > 0:
            a = i
        elif a is not None and (i == n or sums[i] == 0):
            out.append((a, i))
            a = None
    return out


def chosen(lengths: np.ndarray, marked: np.ndarray, boxes: list[int]) -> np.ndarray:
    """Which lines the stretches choose, with their ends moved to those of marked elements."""
    keep = np.zeros(len(lengths), bool)
    found, touched = stretches(lengths), set()
    for a, b in found:
        inside = marked[a:b] > 0
        touched.update(marked[a:b][inside].tolist())
        if 2 * lengths[a:b][inside].sum() < lengths[a:b].sum():
            keep[a:b] = True  # else the element's ends are its ends
    for (_, a), (b, _) in zip(found, found[1:]):
        if keep[a - 1] and keep[b] and len(set(boxes[a - 1 : b + 1])) == 1:  # all in one element, links between as well
            keep[a:b] = True
    keep |= np.isin(marked, list(touched)) if touched else marked > 0
    return keep if found or keep.any() else ~keep


def main_text(page: str) -> str:
    lines, linked, marked, boxes = lines_of(page)
    lengths = np.array([max(0, len(x) - k) for x, k in zip(lines, linked)], np.int64)
    return "\n".join(x for x, own in zip(lines, chosen(lengths, np.array(marked, np.int64), boxes)) if own)


def extract(df: DataFrame, html: str = "html", drop_html: bool = False) -> DataFrame:
    """df with the main text of its pages and its length in code points."""

    def make() -> Callable:
        def work(column):
            found = [main_text(t) for t in texts(column).to_pylist()]
            return [found, [len(t) for t in found]]

        return work

    return with_columns(df, html, FIELDS, make, drop_html)


def op9_html_text(spark, sf_dir) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, drop_html=True).withColumnRenamed("main_text", "text")
