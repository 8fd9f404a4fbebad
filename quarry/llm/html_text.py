"""Main text of HTML pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path (tags and classes down to the block it stands in). For each
path: text length and number of punctuation signs, over the number of its blocks. Both ratios are smoothed over the paths in page
order, scaled and fused by their geometric mean; paths that reach half of the mean of all paths, and are not mostly links
without punctuation, are content. They choose the containers: all that hold content paths' text, or only article and main elements
where these hold half of that text or more (of several, those with a quarter of the longest one's or more). In the
containers, every node stays but those of other paths that are mostly links.

What an element is called only counts before that: nav, footer, aside, forms and the like never give text, nor hidden ones;
elements whose role, or a whole word of whose class or id says so (menu, sidebar, ad, comment, cookie, ...) give none either, unless
they hold half of all content paths' text and are not beside an article. Of a header in an article, the headings stay.

White space in a block becomes one space, blocks stand in page order, joined by a newline; <br> is white space.

Defined cases: null or empty html gives an empty text; unclosed elements end where their container or the page does, at any depth; text
without any markup is one block; a very long page is read whole; pages that repeat give the same result each; an empty table gives
an empty result; other columns are not read, so their names cannot clash; page_id may be of any type.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import read

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?![^\s=/>])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = frozenset("script style textarea title noscript template svg math iframe object select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl body html article section div main td th".split())
NEVER = frozenset("nav footer aside menu button input dialog".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A word of a class or id, whole or with its own parts before or after.
LIKELY_NOT = re.compile(r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary)[_-])?(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|banner|footer|sidebar|aside|notices?|alert|popup|modal|related|recommended|widget|copyright|legal|search|pagination|pager|toolbar|skip)(?:[_-](?!has)\w+)*", re.I)
SURELY_NOT = re.compile(r"(?:\w+[_-])*(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|newsletter|subscribe|comments?|replies|respond|disqus|share|sharing|social|login)(?:[_-]\w+)*", re.I)
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre dl dt dd table tbody thead tfoot tr td th figure figcaption section header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？…]")


@dataclass
class Element:
    tag: str
    parent: "Element | None"
    number: int
    #: Number of its tag path, the same for the same tags and classes from the root.
    path: int
    block: "Element"
    link: bool
    #: 2: never gives text; 1: does not by its name, unless the paths say otherwise.
    refused: int


@dataclass
class Node:
    element: Element
    block: int
    text: str


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _attributes(said: str) -> dict[str, str]:
    # only what stands outside of other attributes' quotes
    outside = re.sub(r"""(?<![\w-])(?!(?:class|id|role|style|aria-hidden)\s*=)[\w:.-]+\s*=\s*("[^"]*"|'[^']*')""", " ", said, flags=re.I)
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in reversed(list(ATTRIBUTE.finditer(outside)))}


def _refused(tag: str, own: dict[str, str]) -> int:
    if tag in NEVER or "hidden" in own and own["hidden"].lower() != "until-found" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return 2
    if own.get("role", "").lower() in ROLES or own.get("aria-hidden", "").lower() == "true":
        return 2
    if tag in ("html", "body", "main"):
        return 0
    words = [w for name in ("class", "id") for w in own.get(name, "").split()]
    if any(map(SURELY_NOT.fullmatch, words)):
        return 2
    return 1 if tag == "form" or tag != "article" and any(map(LIKELY_NOT.fullmatch, words)) else 0


def read_page(source: str) -> Page:
    page, block, at = Page(), 0, 0
    top = Element("", None, 0, 0, None, False, 0)
    top.block = top
    page.elements.append(top)
    stack, paths = [top], {}

    def text(piece: str) -> None:
        if piece:
            page.nodes.append(Node(stack[-1], block, entities.unescape(piece)))

    while m := TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        elif tag in ("br", "img", "wbr"):
            if tag == "br":
                text(" ")
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE or stack[k].tag in ("body", "article", "main") and tag not in ("body", "html", "article", "main"):
                    break  # an end tag that matches nothing near
            continue
        if tag not in INLINE and tag not in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph and what is in it
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else len(source)
            continue
        parent, own = stack[-1], _attributes(m[3]) if m[3] else {}
        kind = (parent.path, tag, *sorted(own.get("class", "").split())) if tag not in INLINE else None
        path = paths.setdefault(kind, len(paths) + 1) if kind else parent.path
        made = Element(tag, parent, len(page.elements), path, parent.block, parent.link or tag == "a", _refused(tag, own))
        if tag not in INLINE:
            made.block = made
        page.elements.append(made)
        stack.append(made)
    text(source[at:])
    return page


def _smooth(values: list[float]) -> list[float]:
    """Each with a half of its neighbours' mean."""
    out = []
    for i, v in enumerate(values):
        near = values[max(0, i - 1) : i] + values[i + 1 : i + 2]
        out.append((v + 0.5 * sum(near) / len(near)) / 1.5 if near else v)
    return out


@dataclass
class Path:
    length: int = 0
    signs: int = 0
    links: int = 0
    blocks: set[int] = field(default_factory=set)

    def mostly_links(self) -> bool:
        return 2 * self.links >= self.length > 0


def tag_paths(nodes: list[Node]) -> dict[int, Path]:
    """What stands in each tag path, in page order."""
    out: dict[int, Path] = defaultdict(Path)
    for n in nodes:
        if said := n.text.strip():
            path = out[n.element.path]
            path.length += len(said)
            path.signs += len(PUNCTUATION.findall(said))
            path.links += len(said) * n.element.link
            path.blocks.add(n.block)
    return out


def content_paths(paths: dict[int, Path]) -> set[int]:
    """The paths that reach half of the mean score."""
    if not paths:
        return set()
    by_text = _smooth([p.length / len(p.blocks) for p in paths.values()])
    by_sign = _smooth([p.signs / len(p.blocks) for p in paths.values()])
    top_text, top_sign = max(by_text) or 1, max(by_sign) or 1
    fused = [((t / top_text) * ((s + 0.1) / (top_sign + 0.1))) ** 0.5 for t, s in zip(by_text, by_sign)]
    limit = 0.5 * sum(fused) / len(fused)
    return {k for (k, p), f in zip(paths.items(), fused) if f >= limit and not (p.mostly_links() and p.signs < len(p.blocks))}


def _named(e: Element) -> bool:
    return e.tag in ("article", "main")


def _inherited(page: Page, own) -> list[bool]:
    """For each element, whether own(e) holds for it or for one around it; parents come first in page.elements."""
    out: list[bool] = []
    for e in page.elements:
        out.append(bool(own(e)) or e.parent is not None and out[e.parent.number])
    return out


def _held(page: Page, lengths: dict[int, int]) -> list[int]:
    """For each element, the sum of lengths over it and all in it."""
    out = [lengths.get(e.number, 0) for e in page.elements]
    for e in reversed(page.elements):
        if e.parent is not None:
            out[e.parent.number] += out[e.number]
    return out


def _containers(page: Page) -> list[Element]:
    """For each element the article or main element that holds it; without any, the nearest that is no inline or text block."""
    out: list[Element] = []
    for e in page.elements:
        above = out[e.parent.number] if e.parent is not None else e
        plain = e.tag in INLINE or e.tag in TEXT_BLOCK
        out.append(e if _named(e) or e.parent is None or not plain and not _named(above) else above)
    return out


def main_text(source: str | None, choose=content_paths) -> str:
    """choose: which tag paths are content."""
    page = read_page(source or "")
    never = _inherited(page, lambda e: e.refused == 2)
    in_article = _inherited(page, _named)
    heading = _inherited(page, lambda e: e.tag in HEADINGS)
    header = _inherited(page, lambda e: e.tag == "header")
    nodes = [n for n in page.nodes if not never[n.element.number] and not (header[n.element.number] and not (in_article[n.element.number] and heading[n.element.number]))]

    def lengths(of: set[int]) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for n in nodes:
            if n.element.path in of:
                out[n.element.number] += len(n.text.strip())
        return out

    # names refuse only what the paths do not hold to be most of the page
    in_all = _held(page, lengths(choose(tag_paths(nodes))))
    named_in = _held(page, {e.number: 1 for e in page.elements if _named(e) and not never[e.number]})
    named_free = any(_named(e) and not never[e.number] and not r for e, r in zip(page.elements, _inherited(page, lambda e: e.refused == 1)))
    refused = _inherited(page, lambda e: e.refused == 1 and not (2 * in_all[e.number] >= in_all[0] > 0 and (named_in[e.number] or not named_free)))
    nodes = [n for n in nodes if not refused[n.element.number] or header[n.element.number] or in_article[n.element.number] and heading[n.element.number]]

    paths = tag_paths(nodes)
    wanted = choose(paths)
    container = _containers(page)
    held: dict[int, int] = defaultdict(int)
    for number, n in lengths(wanted).items():
        held[container[number].number] += n
    if not held:
        return ""
    named = {k: n for k, n in held.items() if _named(page.elements[k])}
    if 2 * sum(named.values()) >= sum(held.values()):
        keep = {k for k, n in named.items() if 4 * n >= max(named.values())}
    else:
        keep = set(held)
    inside = _inherited(page, lambda e: e.number in keep)
    # a named element in a kept one that is not kept itself, as a teaser, is out
    if all(_named(page.elements[k]) for k in keep):
        teaser = _inherited(page, lambda e: e.tag == "article" and e.number in named and e.number not in keep)
    else:
        teaser = [False] * len(page.elements)

    blocks: dict[int, list[str]] = defaultdict(list)
    for n in nodes:
        k = n.element.number
        if inside[k] and not teaser[k] and (n.element.path in wanted or not paths[n.element.path].mostly_links()):
            blocks[n.block].append(n.text)
    return "\n".join(s for b in blocks.values() if (s := " ".join("".join(b).split())))


SCHEMA = "page_id string, url string, text string, n_chars bigint"


def _extract(batches):
    for pdf in batches:
        texts = [main_text(x) for x in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    kind = pages.schema["page_id"].dataType
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")  # as text, which pandas keeps as it is
    return rows.mapInPandas(_extract, SCHEMA).withColumn("page_id", F.col("page_id").cast(kind))


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
