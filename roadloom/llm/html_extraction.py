"""Main text of web pages by consensus of the pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import landed
from roadloom.llm.url_filter import split_url

#: a tag whose quoted values may hold ``>``; possessive, so that no input makes it slow
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>")
#: a tag up to the next ``>``, where quotes don't close
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# names of elements and of classes (fixed values)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+>", re.IGNORECASE) for tag in RAW}
#: longer paths are named by their hash
PATH_LENGTH = 1000
DROPPED = frozenset(
    "nav footer aside form noscript template iframe object svg math canvas button select dialog menu head"
    " audio video map datalist applet frameset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li dt dd pre blockquote figcaption caption th td tr ul ol dl summary address header".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr main menu nav ol p pre section table ul".split()
)
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar comment"
    " comments cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation toolbar"
    " pagination pager footer widget widgets respond reply replies discussion disqus".split()
)
NOISE_WHOLE = frozenset("header masthead topbar site-header page-header global-header".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: elements that end an open element of the same kind, and what that search stops at
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class Element:
    tag: str
    names: tuple[str, ...]
    parent: int
    drop: bool
    in_article: bool
    path: str = ""


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: (element, text, characters within links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _noisy(tag: str, attributes: dict[str, str]) -> bool:
    """Do class, id or role name a menu, advert, notice, comment or the like?"""
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in NOISE_ROLE:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        if name in NOISE or name in NOISE_WHOLE:
            return True
        parts = re.split(r"[-_]+", name)
        if tag != "article" and parts[0] not in ("has", "with", "no", "is") and (parts[0] in NOISE or parts[-1] in NOISE):
            return True
    return False


def _general(name: str) -> str:
    """Numbers in a class are those of a page, not of the host."""
    return re.sub(r"\d+", "#", name.lower())


def parse(html: str) -> Page:
    """Blocks of text outside dropped elements, in page order, and the elements they lie in."""
    page, stack = Page(), [0]
    page.elements.append(Element("html", (), -1, False, False, "html"))
    words: list[str] = []
    linked = links = 0
    standing: Counter = Counter()  # open elements by tag

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            if text:
                page.blocks.append((stack[-1], text, min(linked, len(text))))
            words.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not page.elements[stack[-1]].drop:
            text = entities.unescape(text) if "&" in text else text
            words.append(text)
            if links:
                linked += len(text.strip())

    def push(element: Element) -> None:
        page.elements.append(element)
        stack.append(len(page.elements) - 1)
        standing[element.tag] += 1

    def close(tags, stops=frozenset()) -> None:
        if not any(standing[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[depth]].tag
            if tag in tags:
                flush()
                standing.subtract(page.elements[k].tag for k in stack[depth:])
                del stack[depth:]
                return
            if tag in stops:
                return

    at, end, right = 0, len(html), -1
    while at < end:
        left = html.find("<", at)
        if left < 0:
            say(html[at:])
            break
        say(html[at:left])
        if html.startswith("<!--", left):
            stop = html.find("-->", left + 4)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith("<![CDATA[", left):
            stop = html.find("]]>", left)
            say(html[left + 9 : end if stop < 0 else stop])
            at = end if stop < 0 else stop + 3
            continue
        if right < left:
            right = html.find(">", left)
        if right < 0:  # no tag can close any more
            say(html[left:])
            break
        if html[left + 1] in "!?":
            at = right + 1
            continue
        m = TAG.match(html, left) or LOOSE_TAG.match(html, left)
        if m is None:
            say("<")
            at = left + 1
            continue
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br" or tag in ("img", "wbr", "input"):
            if tag == "br":
                say(" ")
            continue
        if tag == "hr":
            close({"p"}, {"div", "article", "section"})
            flush()
            continue
        if tag in VOID or tag == "html":
            continue
        if tag in RAW:
            if not closing:
                stop = RAW_END[tag].search(html, at)
                at = stop.end() if stop else end
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
            close({tag})
            continue
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        noisy = _noisy(tag, attributes)
        if tag in INLINE:
            if tag == "a":
                links += 1
            if noisy:  # its own element without a new block
                up = page.elements[stack[-1]]
                push(Element(tag, (), stack[-1], True, up.in_article, up.path))
            continue
        flush()
        links = 0
        if tag in CLOSES_P:
            close({"p"}, {"div", "article", "section", "main", "td", "th", "li", "body", "blockquote"})
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag == "body":
            close({"head"})
            if standing["body"]:
                continue
        up = page.elements[stack[-1]]
        drop = up.drop or tag in DROPPED or noisy or (tag == "header" and not up.in_article)
        if tag in ("article", "main") and up.drop and not noisy:
            # a form around the whole page is no form to drop
            causes = {page.elements[k].tag for k in stack if page.elements[k].drop}
            drop = not causes <= {"form", "div", "section", "center", "table", "tr", "td"} or "form" not in causes
        names = tuple(sorted({_general(n) for n in attributes.get("class", "").split()})) if tag not in ("body", "html") else ()
        element = Element(tag, names, stack[-1], drop, up.in_article or tag in ("article", "main"))
        element.path = f"{up.path}/{'.'.join((tag, *names))}"
        if len(element.path) > PATH_LENGTH:
            element.path = hashlib.md5(element.path.encode()).hexdigest()
        push(element)
    flush()
    _drop_bylines(page)
    return page


def _drop_bylines(page: Page) -> None:
    """In a header inside an article only headings count."""
    header, heading = [], []
    for e in page.elements:  # parents come first
        up = e.parent
        header.append(e.tag == "header" or (up >= 0 and header[up]))
        heading.append(e.tag in HEADINGS or (up >= 0 and heading[up]))
    page.blocks = [b for b in page.blocks if heading[b[0]] or not header[b[0]]]


def best_container(page: Page) -> int:
    """The element whose paragraphs hold most text outside links.

    A block counts whole for the nearest container and half for the next; an article or main
    element counts all it holds, and a fifth more. Ties go to the first.
    """
    n = len(page.elements)
    nearest, score, held = [0] * n, [0.0] * n, [0.0] * n
    for k, e in enumerate(page.elements):
        nearest[k] = k if e.tag not in TEXTUAL or e.parent < 0 else nearest[e.parent]
    for k, text, linked in page.blocks:
        worth = len(text) - linked
        held[k] += worth
        near = nearest[k]
        score[near] += worth
        if page.elements[near].parent >= 0:
            score[nearest[page.elements[near].parent]] += 0.5 * worth
    for k in range(n - 1, 0, -1):
        held[page.elements[k].parent] += held[k]
    for k, e in enumerate(page.elements):
        if e.tag in ("article", "main"):
            score[k] = 1.2 * held[k]
    return max(range(n), key=lambda k: (score[k], -k))


def text_below(page: Page, tops: set[int]) -> str:
    below: list[bool] = []
    for k, e in enumerate(page.elements):
        below.append(k in tops or (e.parent >= 0 and below[e.parent]))
    return "\n".join(text for k, text, _ in page.blocks if below[k])


def main_text(html: str | None, paths) -> str:
    """Text below the first winning path that the page has, else below its own best container."""
    if not html:
        return ""
    page = parse(html)
    for path in [] if paths is None else paths:
        tops = {k for k, e in enumerate(page.elements) if e.path == path and not e.drop}
        text = text_below(page, tops) if tops else ""
        if text:
            return text
    return text_below(page, {best_container(page)})


def host_paths(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """Winning paths per host: those with at least ``share`` of its pages' votes, most votes first.

    ``pages``: host, html. Every page votes for the tag-class path (numbers generalised) of its
    best container. Votes are summed in the task, then by host and path, so a hot host moves few rows.
    """

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            votes: Counter = Counter()
            for host, html in zip(batch["host"], batch["html"], strict=True):
                page = parse(html)
                if page.blocks:
                    votes[host, page.elements[best_container(page)].path] += 1
            yield pd.DataFrame([(*k, n) for k, n in votes.items()], columns=["host", "path", "votes"])

    votes = landed(
        pages.select("host", "html").filter("html is not null")
        .mapInPandas(vote, "host string, path string, votes long")
        .groupBy("host", "path").agg(F.sum("votes").alias("votes")),
        "host-votes",
    )
    totals = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    won = votes.join(totals, "host").filter(F.col("votes") >= share * F.col("all"))
    # at most 1 / share paths per host
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path")))
    return won.groupBy("host").agg(ranked.alias("_r")).select("host", F.col("_r.path").alias("paths"))


def extract(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    ``pages``: page_id, url, html; other columns are not read. Blocks are joined by a line
    feed; white space in a block is one space. Null, empty and textless html gives an empty
    text. Pages without a host (null urls) form one host. Repeated rows get a row each. The
    paths are a landed table: Spark broadcasts it if it is small, else both sides are dealt by host,
    where adaptive execution splits a hot one.
    """
    tidy = split_url(pages.select("page_id", "url", "html")).drop("path")
    winners = landed(host_paths(tidy, share), "host-paths")

    @F.pandas_udf("string")
    def text(html: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, p) for h, p in zip(html, paths, strict=True)], dtype="object")

    return (
        tidy.join(winners, "host", "left")
        .select("page_id", "url", text("html", "paths").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
