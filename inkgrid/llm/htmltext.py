"""Main text of HTML pages by two passes of block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import pieces_by_bytes

# Elements that end a block, elements whose contents are no text,
# void elements, elements and name parts that are not the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form menu dialog search fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_NAMES = frozenset(
    """ad ads adbox adsense adslot advert adverts advertisement advertising alert announcement banner breadcrumb breadcrumbs comment comments
    commentlist commentform consent contentinfo complementary cookie cookies copyright dialog disclaimer discussion disqus feedback footer form gdpr header
    legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted
    promotion rail recommended related replies reply respond responses search share sharing sidebar sidenav signup skip social sponsor sponsored
    subscribe subscription tags toolbar topbar warning widget widgets""".split()
)
GOOD_NAMES = frozenset("article body content entry main post story text".split())
MAIN = frozenset(("article", "main"))
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on or our she so
    than that the their them there they this to was we were what when which who will with would you
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur
    un une vous aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch
    nur oder sich sie sind über um und uns von vor war wenn wie wir zu zum zur
    al algo como con cuando del desde donde el ella ellos entre era esa ese eso esta este esto ha hay la las lo los más mi muy no nos o para pero por porque si sin
    sobre su sus también te tiene todo una uno y ya yo""".split()
)

# An attribute as HTML reads it: a quote means something only where a value begins.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE}?+))?+")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    tag: str
    linked: int  # characters in links
    aside: bool  # in an element that is not the article
    main: bool  # in an article or main element


def _aside(tag: str, rest: str, in_main: bool) -> bool:
    """Whether an element is apart from the article by its tag, role, names or style."""
    if tag in ASIDE and not (tag == "header" and in_main):
        return True
    if not rest or tag in ("html", "body"):
        return False
    values = {k.lower(): v[1:-1] if v[:1] in ("'", '"') else v for k, v in _ATTRIBUTE.findall(rest)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(values.get("style", "")):
        return True
    names = {x.lower() for k in ("class", "id", "role") for x in _NAMES.findall(values.get(k, ""))}
    bad = names & BAD_NAMES
    if in_main:
        bad -= {"header"}
    if not bad:
        return False
    apart = {"comment", "comments", "reply", "replies", "respond", "sidebar", "ad", "ads", "advert", "advertisement", "share", "related", "newsletter", "cookie", "promo"}
    if tag in MAIN:
        return bool(bad & {"comment", "comments", "reply", "replies"})
    return not names & GOOD_NAMES or bool(bad & apart) and not names & {"with", "has", "no"}


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page in order, each with white space made single.
    Block elements and two line breaks in a row end a block. Tags without an
    end are closed by their parents' ends; comments and raw elements give none."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, aside, main; with what is around
    parts: list[str] = []
    linked = link = breaks = at = 0
    tag, size, apart = "p", len(page), False  # apart: the block's own element is

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            around = open_[-1] if open_ else ("", False, False)
            out.append(Block(text, tag, linked, around[1] or apart, around[2]))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = unescape(raw)
            parts.append(text)
            if not text.isspace():
                breaks = 0
                linked += len(text.strip()) if link else 0

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            at = stop.end() if stop else size
            if name == "title" or name in BLOCKS:
                end()
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                end()
            else:
                parts.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name not in BLOCKS:
            if name in ("td", "img"):
                parts.append(" ")
            continue
        end()
        breaks = link = 0
        apart = not closing and (name == "p" or name in HEADINGS) and bool(m[3]) and _aside(name, m[3], bool(open_) and open_[-1][2])
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
            tag = "div" if name in HEADINGS or name in ("p", "li") else name
        else:
            tag = name
            if name not in VOID and name != "p" and name not in HEADINGS:
                if name == "body":
                    open_.clear()
                around = open_[-1] if open_ else ("", False, False)
                open_.append((name, around[1] or name == "head" or _aside(name, m[3], around[2]), around[2] or name in MAIN))
    end()
    return out


def stop_share(text: str) -> float:
    """The share of stop words among the words of a text."""
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(b: Block, short_chars: int, dense: float, sparse: float) -> bool | None:
    """True, False or None (undecided) by stop-word density, link density and length; the
    bounds are lower in an article or main element."""
    if b.aside:
        return False
    links, short = b.linked / len(b.text), len(b.text) < short_chars
    if b.main and links > 0.5:
        return False if b.tag in ("li", "ul", "ol", "td", "div", "nav") else None
    if not b.main and (links > 0.33 or short and links > 0):
        return False
    if short:
        return None
    if stop_share(b.text) >= (sparse if b.main else dense):
        return True
    # Few stop words: lists, code, tables.
    return None if b.main or links == 0 else False


def main_text(page: str | None, short_chars: int = 70, dense: float = 0.3, sparse: float = 0.15) -> str:
    """The article of a page, a line for each block.

    First pass: a block in an element apart (navigation, header, footer, sidebar,
    notice, advert, form, comments) is out; so is one of mostly links. A block that isn't
    short is in if its stop words are dense: at least `sparse` in an article or main
    element, `dense` elsewhere. Short blocks, and long ones with few stop words but no links, are
    undecided. Second pass: these take the label of the nearest decided blocks of the
    same kind of place (in or outside an article or main element). If they differ,
    they are in within an article or main element, and as headings with
    text to follow; without any, they are in if no block of the page was decided as in. In an
    article or main element blocks of few links are never out for their neighbours. Long
    blocks of few stop words elsewhere need decided blocks that are in on both sides."""
    blocks = blocks_of(page or "")
    first = [first_pass(b, short_chars, dense, sparse) for b in blocks]
    n = len(blocks)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, tuple[int, bool] | None] = {True: None, False: None}
        for i in order:
            near[i] = last[blocks[i].main]
            if first[i] is not None and not blocks[i].aside:
                last[blocks[i].main] = (i, first[i])
    some = any(f for f in first)
    kept = []
    for i, b in enumerate(blocks):
        label = first[i]
        if label is None:
            around = {x[1] for x in (before[i], after[i]) if x}
            if not b.main and len(b.text) >= short_chars and len(around) == 1 and not (before[i] and after[i]):
                label = False
            elif len(around) == 1:
                label = around.pop() or b.main and b.linked / len(b.text) <= 0.5
            elif around:
                label = b.main or b.tag in HEADINGS and after[i] is not None and after[i][1]
            else:
                label = b.main or not some
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row. Null, empty and textless pages: an
    empty text. Equal rows are each extracted. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces_by_bytes(b, 2):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
