"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block; a line weighs as many characters as it has
outside links, and nothing inside elements that are never part of an article.  Where the weight
of ``WINDOW`` neighbouring lines surges, text begins, and it ends where that sum dives to nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import map_batches
from workload.registry import query, table

# Lines summed, and the weight of a window at which text of a page without article element surges.
WINDOW, SURGE = 3, 60
# Further article elements are kept if they weigh at least this share of the heaviest.
ARTICLE_SHARE = 1 / 3

# Element names and the words of classes, ids and roles that tell what an element is for.
RAW = set("script style title textarea noscript template iframe noembed noframes xmp svg object audio video canvas select button datalist".split())
CONTAINERS = set("html body main article section div nav header footer aside form dialog menu ul ol li dl dd table thead tbody tfoot tr td th blockquote figure details fieldset center".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 dt pre hr address figcaption caption legend summary hgroup head".split())
NEVER_TEXT = set("nav footer aside form dialog menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NEVER_DROPPED = {"html", "body", "main"}
WORDS = set("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar masthead topbar
    comment comments commentlist disqus respond replies
    cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe paywall
    share sharing social related recommended""".split())
NAMES = set("header footer site-header site-footer page-header page-footer main-header main-footer global-header global-footer top-bar skip-link widget widgets".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
UNMEANT = set("has no with without js is not".split())  # classes such as "no-sidebar" tell about another element
AROUND = {"content", "layout"}  # beside "sidebar" the class is of what holds both

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
TAG_END = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}


class Line(NamedTuple):
    """A block: its text, its characters outside links, the element it is in and what it may be; a dropped one is empty."""

    text: str
    weight: int
    parent: int
    article: int
    main: bool
    paragraph: bool


class Element(NamedTuple):
    """An open element: ``kept`` tells which of its lines may be text, ``article`` the outermost article element or -1."""

    name: str
    number: int
    kept: str  # "all", "headings" or "none"
    article: int
    main: bool


def is_boilerplate(name: str, attributes: str) -> bool:
    """Whether an element is a menu, notice, advert, form, comment or hidden by its name, classes, id or role."""
    if name in NEVER_TEXT:
        return True
    if not attributes or name in NEVER_DROPPED:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value) or key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            for given in value.split():
                words = re.split("[-_]+", given)
                if given.replace("_", "-") in NAMES:
                    return True
                if not WORDS.isdisjoint(words) and UNMEANT.isdisjoint(words) and not ("sidebar" in words and not AROUND.isdisjoint(words)):
                    return True
    return False


def opened(name: str, attributes: str, parent: Element, number: int) -> Element:
    kept = parent.kept
    if name == "main":
        kept = "all"
    elif kept != "none" and is_boilerplate(name, attributes):
        kept = "none"
    elif kept == "all" and name == "header":  # an article's own header holds its title
        kept = "headings" if parent.article >= 0 else "none"
    article = number if name == "article" and kept == "all" and parent.article < 0 else parent.article
    return Element(name, number, kept, article, parent.main or name == "main")


def page_lines(page: str) -> list[Line]:
    """The lines of a page in order; elements that are never text leave an empty line each."""
    lines: list[Line] = []
    stack = [Element("", 0, "all", -1, False)]
    depth: dict[str, int] = {}
    text: list[str] = []
    weight = links = numbers = 0
    paragraph = heading = skipped = False
    quotes = True

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                inside = stack[-1]
                drop = skipped or inside.kept == "none" or inside.kept == "headings" and not heading
                lines.append(Line("" if drop else line, 0 if drop else weight, inside.number, inside.article, inside.main, paragraph))
            text.clear()

    def close(name: str) -> None:
        while True:
            gone = stack.pop().name
            depth[gone] -= 1
            if gone == name:
                return

    at, n = 0, len(page)
    while at < n:
        found = OPENING.search(page, at)
        piece = page[at:found.start()] if found else page[at:]
        if piece:
            text.append(piece)
            if not links:
                weight += len(piece) - piece.count(" ")
        if not found:
            break
        if not found[2]:  # comment or declaration
            ending = "-->" if found[0] == "<!--" else ">"
            end = page.find(ending, found.start() + 2)
            at = n if end < 0 else end + len(ending)
            continue
        name, closing = found[2].lower(), found[1] == "/"
        ended = TAG_END.match(page, found.end()) if quotes else None
        if ended:
            at = ended.end()
        else:  # a quote that is never closed: from here on quotes do not count
            quotes = False
            at = page.find(">", found.end()) + 1 or n
        attributes = page[found.end():at - 1]
        if name in RAW:
            text.append(" ")
            if not closing and not (name == "svg" and attributes.endswith("/")):
                found = RAW_END[name].search(page, at)
                at = n if not found else page.find(">", found.end()) + 1 or n
        elif name == "br":
            text.append(" ")
        elif name not in BLOCKS:
            if name == "a":
                links = 0 if closing else 1
        else:
            flush()
            weight = links = 0
            paragraph, heading = name == "p" and not closing, name in HEADINGS and not closing
            skipped = not closing and name not in CONTAINERS and is_boilerplate(name, attributes)
            if closing and depth.get(name):
                close(name)
            elif not closing and name in CONTAINERS:
                if name == "li" and stack[-1].name == "li":
                    close("li")
                numbers += 1
                stack.append(opened(name, attributes, stack[-1], numbers))
                depth[name] = depth.get(name, 0) + 1
                if stack[-1].kept == "none" and stack[-2].kept != "none":
                    lines.append(Line("", 0, numbers, stack[-1].article, stack[-1].main, False))
    flush()
    return lines


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, greatest window sum) between each surge from nothing and the dive back to it."""
    out = []
    start, peak, held = -1, 0, 0
    for k in range(len(weights) + WINDOW):
        held += weights[k] if k < len(weights) else 0
        held -= weights[k - WINDOW] if k >= WINDOW else 0
        if held and start < 0:
            start, peak = k, held
        elif held:
            peak = max(peak, held)
        elif start >= 0:
            out.append((start, k - WINDOW + 1, peak))
            start = -1
    return out


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by line breaks."""
    lines = page_lines(page)
    by_article: dict[int, int] = {}
    for line in lines:
        if line.article >= 0:
            by_article[line.article] = by_article.get(line.article, 0) + len(line.text)
    heaviest = max(by_article.values(), default=0)
    if heaviest:
        # the page says where its article is: any text there counts, none elsewhere
        kept = {a for a, n in by_article.items() if n >= ARTICLE_SHARE * heaviest}
        weights = [len(line.text) if line.article in kept else 0 for line in lines]
        chosen = stretches(weights)
        return "\n".join(lines[k].text for low, high, _ in chosen for k in range(low, high) if weights[k])
    if any(line.main and line.text for line in lines):
        lines = [line if line.main else line._replace(text="", weight=0) for line in lines]
    weights = [line.weight for line in lines]
    found = stretches(weights)
    surged = [s for s in found if s[2] >= SURGE] or [s for s in found if any(lines[k].paragraph for k in range(s[0], s[1]))]
    if not surged:
        return ""
    best = max(surged, key=lambda s: (sum(weights[s[0]:s[1]]), -s[0]))
    # an advert or picture may part an article: stretches of the element that holds most of it belong together
    shares: dict[int, int] = {}
    for k in range(best[0], best[1]):
        shares[lines[k].parent] = shares.get(lines[k].parent, 0) + weights[k]
    holder = max(shares, key=lambda p: (shares[p], -p))
    return "\n".join(lines[k].text for s in found for k in range(s[0], s[1]) if lines[k].text
                     and (s == best or any(lines[x].parent == holder and weights[x] for x in range(s[0], s[1]))))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; ``n_chars`` counts code points.

    A null or empty page, and one without text outside menus, has an empty text.  Unclosed
    elements, comments and quotes end with the page.  Repeated rows give repeated rows,
    null ids and urls stay null, an empty table gives no rows, other columns are not read.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return map_batches(rows, work, "page_id long, url string, text string, n_chars long")


@query("op12_html_text")
def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))
