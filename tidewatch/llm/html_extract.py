"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides the clear
blocks by length, link density and the density of stop words; the container that
a block stands in counts as one more measure. The second gives each undecided
block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

# The elements of the HTML standard by their role here.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
         "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search",
         "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button"}
CLOSES_P = BLOCK - {"option", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSE_THEMSELVES = {"dd", "dt", "li", "option", "td", "th", "tr"}
OUTSIDE = {"aside", "button", "dialog", "fieldset", "footer", "form", "head", "menu", "nav", "option", "search", "select"}
INSIDE = {"article", "main"}
OUTSIDE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar",
                 "navigation", "search", "toolbar"}
# Words of class and id names that mark what is not the article.
OUTSIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
                 "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer",
                 "gdpr", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
                 "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "recommended", "related",
                 "replies", "respond", "responses", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
                 "sponsored", "subscribe", "toolbar", "widget", "widgets"}
# Common short words of English, German, French and Spanish.
STOP_WORDS = set("""
    a and are as at be but by for from had has have he her his in is it its not of on or she that the their there they
    this to was were which who will with you
    aber als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach
    nicht noch oder sich sie sind und von war werden wie wird zu zum zur
    au aux avec ce cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui sa
    se ses son sont sur un une vous
    al como con del el ella esta este fue ha lo los las más muy no nos para pero por se sin sobre su sus también una y ya
""".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
                 r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in RAW}

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"
SHORT_CHARS, LONG_CHARS = 70, 140
LINKED = 0.5  # share of a block's characters inside links from which it is a link
MENU = 3  # linked blocks in a row
SPARSE, DENSE = 0.05, 0.12  # share of stop words


@dataclass
class Block:
    """A run of text without a block-level tag inside."""

    text: str
    link_chars: int
    article: bool
    outside: bool
    heading: bool


def marks(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds what is not the article."""
    if name in OUTSIDE or name == "header" and not inside:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    if re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", attributes):
        return True
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if given.get("role", "").lower() in OUTSIDE_ROLES or given.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", given.get("style", "")):
        return True
    if name in INSIDE or name in ("html", "body"):
        return False
    words = {w.lower() for key in ("class", "id") for w in NAME.split(given.get(key, "")) if w}
    return not words.isdisjoint(OUTSIDE_NAMES)


def blocks(page: str) -> list[Block]:
    """Cut a page at its block-level tags."""
    found: list[Block] = []
    open_elements: list[tuple[str, bool, bool, bool]] = []  # name, article, outside, heading
    counts: dict[str, int] = {}
    texts: list[str] = []
    link_chars = links = 0
    state = ("", False, False, False)

    def add(raw: str) -> None:
        nonlocal link_chars
        plain = html.unescape(raw)
        texts.append(plain)
        if links:
            link_chars += len("".join(plain.split()))

    def end_block() -> None:
        nonlocal link_chars
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                found.append(Block(text, link_chars, *state[1:]))
            texts.clear()
        link_chars = 0

    at, size = 0, len(page)
    while at < size:
        tag = TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                at = END_OF[name].search(page, at).end()
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            texts.append(" ")
        if name in BLOCK:
            end_block()
            links = 0
        elif name in VOID or name == "a":
            continue
        if closing:
            # Counted by name, so that a closing tag without a partner costs nothing.
            if counts.get(name):
                if name not in BLOCK:
                    end_block()
                while True:
                    counts[open_elements[-1][0]] -= 1
                    if open_elements.pop()[0] == name:
                        break
        else:
            top = len(open_elements) - 1
            while top >= 0 and open_elements[top][0] not in BLOCK:
                top -= 1
            if top >= 0 and (open_elements[top][0] == "p" and name in CLOSES_P
                             or open_elements[top][0] == name and name in CLOSE_THEMSELVES):
                for element in open_elements[top:]:
                    counts[element[0]] -= 1
                del open_elements[top:]
            state = open_elements[-1] if open_elements else ("", False, False, False)
            outside = state[2] or marks(name, attributes, state[1])
            if name in BLOCK and name not in VOID or outside != state[2]:
                if name not in BLOCK:
                    end_block()
                role_main = 'role="main"' in attributes
                counts[name] = counts.get(name, 0) + 1
                open_elements.append((name, state[1] or name in INSIDE or role_main, outside,
                                      name in ("h1", "h2", "h3", "h4", "h5", "h6")))
        state = open_elements[-1] if open_elements else ("", False, False, False)
    end_block()
    return found


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def linked_share(block: Block) -> float:
    return block.link_chars / max(1, len("".join(block.text.split())))


def first_pass(block: Block, has_article: bool) -> str:
    """The label of a clear block, else ``NEAR`` or ``SHORT``.

    Words that mark what is not the article, and links outside one, are clear. Other blocks
    are decided by length and the density of stop words; inside a marked article, a
    sparser text is clear, and outside of it, on a page that has one, none is.
    """
    size, inside = len(block.text), has_article and block.article
    linked = linked_share(block)
    if block.outside or not inside and linked > 0.2:
        return BAD
    if size < SHORT_CHARS or linked > LINKED:
        return SHORT if inside or not has_article else BAD
    density = stop_density(block.text)
    if inside:
        return GOOD if density >= SPARSE else NEAR
    if has_article:
        return NEAR if density >= DENSE and size >= LONG_CHARS else BAD
    if density >= DENSE and size >= LONG_CHARS:
        return GOOD
    return NEAR if density >= SPARSE or size >= LONG_CHARS else SHORT


def menus(labels: list[str], found: list[Block]) -> list[str]:
    """Linked blocks in a row are a menu, wherever they stand."""
    labels, start = list(labels), 0
    for at in range(len(found) + 1):
        if at == len(found) or linked_share(found[at]) <= LINKED:
            if at - start >= MENU:
                labels[start:at] = [BAD] * (at - start)
            start = at + 1
    return labels


def second_pass(labels: list[str], found: list[Block], has_article: bool) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbours. If the two
    differ, near-good blocks and headings before a good block stay, short ones go.

    Inside a marked article only its own blocks are neighbours, and what lies between a
    good and a bad one, or has no decided neighbour, stays. Outside of it a block needs two good
    neighbours. Where nothing on a page is good, its undecided blocks are its text.
    """
    everywhere = [i for i, label in enumerate(labels) if label in (GOOD, BAD)]
    own = [i for i in everywhere if found[i].article and not found[i].outside]
    any_good = any(labels[i] == GOOD for i in everywhere)
    kept = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            kept.append(label == GOOD)
            continue
        inside = has_article and found[i].article
        decided = own if inside else everywhere
        at = bisect_left(decided, i)
        before = labels[decided[at - 1]] if at else None
        after = labels[decided[at]] if at < len(decided) else None
        if inside:
            kept.append(GOOD in (before, after) or before == after == None)  # noqa: E711
        elif not any_good:
            kept.append(not has_article)
        elif has_article:
            kept.append(before == after == GOOD)
        else:
            kept.append(before == after == GOOD or GOOD in (before, after) and label == NEAR
                        or after == GOOD and found[i].heading)
    return kept


def main_text(page: str) -> str:
    """The article's blocks in page order, one to a line; empty if there are none."""
    found = blocks(page)
    has_article = any(b.article and not b.outside for b in found)
    labels = menus([first_pass(b, has_article) for b in found], found)
    return "\n".join(b.text for b, keep in zip(found, second_pass(labels, found, has_article)) if keep)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    A null or empty page has an empty text. Cut-off pages, unclosed elements
    and unfinished tags are read as far as they go, in time that grows with the
    page, however long it is. Repeated rows are extracted
    each; an empty table gives no rows; other columns are dropped.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = dict(rows.dtypes)

    def convert(batch):
        texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return by_batch(rows, convert, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
