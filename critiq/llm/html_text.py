"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by what is around
them (a zone of content or of page furniture, told from tags, roles and class names), by link
density, length and stop-word density. A content zone lowers what a block needs: inside, a
block of some length is kept unless it lacks stop words by more than chance explains at the rate
of the page's zones, links adding to the doubt; outside, it needs length and stop words, whether the page has a content zone or not. Short or
middling blocks stay open; in the second pass they inherit the label of the nearest decided
blocks on both sides, headings that of the next one. Blocks inside and outside content zones are
no neighbours of each other. An open block whose neighbours are absent or differ stays inside a
content zone; elsewhere its stop words decide then, of which it needs more on a page with a zone.

Classes and ids name furniture as whole words or with words of place, as in ``site-footer``;
words of comments and adverts do whatever stands beside them, but where it denies them, as in
``has-comments``. Forms and such names are evidence only: on a page that has no other text, they count for
nothing where that brings up a block of some length that is rich in stop words. On a page of mostly other than Latin letters,
for which there are no stop words, sentence marks stand for them. At either end of the text a
block without any inherits nothing, as menus have none.

Defined results: null and empty html, and pages without main text, give the empty string.
Unclosed comments, scripts and tags run to the end of the page. Repeated rows are treated one
by one; other columns are ignored. Each page is handled on its own, whole, in its task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from critiq.llm.common import map_texts

SHORT = 70
LONG = 200
LOW_STOPS, HIGH_STOPS = 0.15, 0.30
DOUBT, LINK_WEIGHT = 4.5, 8.0
LINKED = 0.5
LINKED_LOOSE = 0.2

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do even for
    from had has have he her him his how if in into is it its just like made more most my no not
    now of on one only or other our out over she should so some such than that the their them
    then there these they this those to up was we were what when where which who will with would
    you your
    au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me ne nous
    par pas pour que qui sa se ses son sur un une vous
    aber als am auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer
    er es ist im ich ihr mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir
    zu zum zur für über
    al como con del el ella entre era esta este fue ha hay las lo los más muy o para pero por
    se sin sobre su sus también y ya
    """.split()
)

_BLOCKS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
    legend li main menu nav ol optgroup option p pre search section select summary table tbody td
    tfoot th thead title tr ul
    """.split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg object canvas".split())
_FURNITURE = frozenset("nav footer aside form button select dialog menu head search".split())
_CONTENT = frozenset("article main".split())
_ENDS_P = _BLOCKS - {"option", "optgroup", "legend", "caption"}

_FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu".split()
)
_FURNITURE_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored
    sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices alert
    alerts popup popups modal overlay sidebar sidebars side menu menus nav navbar navigation
    breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist replies
    reply respond disqus discussion social share sharing related recommended newsletter subscribe
    subscription signup login widget widgets pagination pager tag tags tagcloud search copyright
    disclaimer skip header
    """.split()
)
#: Parts that name furniture whatever stands beside them, and parts that deny it.
_STRONG_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors
    comment comments commentlist reply replies disqus discussion
    """.split()
)
_DENYING_NAMES = frozenset(
    """
    allowed closed count disabled enabled free has hide no non not off on open with without
    """.split()
)
#: Parts that say nothing of their own beside a word of furniture.
_PLACE_NAMES = frozenset(
    """
    area bar block bottom box buttons cloud column container form global group inner items left
    link links list main outer primary right secondary section site slot top unit wrap wrapper
    """.split()
)
_CONTENT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:articles?|content|main|post|entry|story|body|text)(?:$|[\s_-])"
)
_PAGE = frozenset({"html", "body"})

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(
    r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S
)
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Ends of sentences and clauses in many scripts.
_MARK = re.compile(r"[.!?,;:。！？、，；।॥؟،؛։።]")


@dataclass
class Block:
    zone: int  # -1 page furniture, 0 unknown, 1 content
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    breaks: int = 0
    text: str = ""
    label: int | None = None
    stops: float = 0.0  # share of stop words, or what stands for it


def _name_parts(value: str) -> Iterator[set[str]]:
    for token in value.split():
        yield {x for x in re.split("[_-]", token) if x and not x.isdigit()}


def _names_comments(value: str) -> bool:
    """Whether some class or id has a word of comments or adverts: ``user-comments``."""
    return any(
        parts & _STRONG_NAMES and not parts & _DENYING_NAMES for parts in _name_parts(value)
    )


def _names_furniture(value: str) -> bool:
    """Whether some class or id, as a whole, names furniture: ``site-footer``, not ``has-sidebar``."""
    for parts in _name_parts(value):
        if parts & _FURNITURE_NAMES and parts <= _FURNITURE_NAMES | _PLACE_NAMES:
            return True
    return False


def _zone(name: str, tag: str, outer: int, marked: bool = True) -> int:
    """Zone inside a tag: furniture holds all that is in it, content may hold furniture.

    Without ``marked``, forms and names of furniture count for nothing.
    """
    if outer < 0:
        return outer
    if name in _PAGE:
        return outer
    if (name in _FURNITURE and (marked or name != "form")) or (name == "header" and outer < 1):
        return -1
    zone = 1 if name in _CONTENT else outer
    if "=" not in tag and "hidden" not in tag:
        return zone
    for m in _ATTRIBUTE.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            value = _HUMP.sub("-", value).lower()
            if marked and _names_comments(value):
                return -1
            if marked and name not in _CONTENT and _names_furniture(value) and not (
                name == "header" and outer > 0
            ):
                return -1
            if _CONTENT_NAMES.search(value):
                zone = 1
        elif key == "role":
            value = value.lower()
            if value in _FURNITURE_ROLES:
                return -1
            if value in ("main", "article"):
                zone = 1
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return -1
        elif key == "style" and re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()
        ):
            return -1
    return zone


def blocks(html: str, marked: bool = True) -> list[Block]:
    """The text blocks of a page in order; ``marked`` as in ``_zone``."""
    found: list[Block] = []
    stack: list[tuple[str, int]] = []
    # How often a name is open, and places of open block tags: no tag is looked for in vain.
    opened: Counter[str] = Counter()
    open_blocks: list[int] = []
    zone, links, block = 0, 0, Block(0, False)

    def closed(heading: bool = False) -> Block:
        block.text = " ".join(unescape("".join(block.parts)).split())
        if block.text:
            found.append(block)
        return Block(zone, heading)

    def leave(place: int) -> int:
        """Close the tags from a place on; the zone around them."""
        outer = stack[place][1]
        opened.subtract(n for n, _ in stack[place:])
        while open_blocks and open_blocks[-1] >= place:
            open_blocks.pop()
        del stack[place:]
        return outer

    def say(text: str) -> None:
        if text:
            block.parts.append(text)
            block.linked += len("".join(text.split())) if links else 0
            if not text.isspace():
                block.breaks = 0

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at, tag = m.end(), m[0]
        named = _NAME.match(tag)
        if named is None:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name == "a":
                links = max(0, links - 1)
            if opened[name] > 0:
                zone = leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            if name in _BLOCKS or block.zone != zone:
                block = closed()
            continue
        if name in _RAW:
            if not tag.endswith("/>"):
                stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
            if name == "title":
                block = closed()
            continue
        if name == "br":
            block.parts.append(" ")
            block.breaks += 1
            if block.breaks == 2:
                block = closed(block.heading)
            continue
        if name in _ENDS_P and open_blocks:
            innermost = stack[open_blocks[-1]][0]
            if innermost == "p" or name == innermost == "li":
                zone = leave(open_blocks[-1])
        if name == "a":
            links += 1
        inner = _zone(name, tag, zone, marked)
        if name not in _VOID and not tag.endswith("/>"):
            if name in _BLOCKS:
                open_blocks.append(len(stack))
            stack.append((name, zone))
            opened[name] += 1
            zone = inner
        if name in _BLOCKS or block.zone != zone:
            links = links if name == "a" else 0
            block = closed(name[0] == "h" and name[1:].isdigit())
            block.zone = zone
            block.heading = name[0] == "h" and name[1:].isdigit()
    closed()
    return found


def _stop_count(text: str) -> tuple[int, int]:
    """Stop words and words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _told_by_marks(found: list[Block]) -> bool:
    """Whether most letters of the page's longer blocks are other than Latin ones."""
    latin = other = 0
    for b in found:
        if b.zone >= 0 and len(b.text) >= SHORT:
            letters = "".join(_WORD.findall(b.text))
            beyond = sum(c > "\u024f" for c in letters)
            latin, other = latin + len(letters) - beyond, other + beyond
    return other > latin


def decide(found: list[Block]) -> None:
    """First pass: labels 1 and 0, or None where a block stays open."""
    marks = _told_by_marks(found)
    long = SHORT if marks else LONG
    counts = [_stop_count(b.text) for b in found]
    longer = [c if len(b.text) >= SHORT else (0, 0) for b, c in zip(found, counts, strict=True)]
    within = [c for b, c in zip(found, longer, strict=True) if b.zone > 0]
    usual = sum(k for k, _ in within) / max(1, sum(n for _, n in within))
    for b, (k, n) in zip(found, counts, strict=True):
        b.stops = k / max(1, n)
        if marks:
            several = len(_MARK.findall(b.text))
            b.stops = HIGH_STOPS if several > 1 and several * 100 >= len(b.text) else 0.0
        x = b.stops if len(b.text) >= SHORT else 0.0
        solid = sum(map(len, b.text.split()))
        density = b.linked / solid if solid else 0.0
        if b.zone < 0 or density > LINKED:
            b.label = 0
        elif b.zone > 0:
            if len(b.text) < SHORT:
                b.label = None
            else:
                spread = 0.0 if marks else math.sqrt(n * usual * (1 - usual))
                lack = (n * usual - k) / spread if spread and x < LOW_STOPS else 0.0
                b.label = 0 if lack and lack + LINK_WEIGHT * density > DOUBT else 1
        elif density > LINKED_LOOSE:
            b.label = 0
        elif len(b.text) < SHORT:
            b.label = None
        elif x >= HIGH_STOPS and len(b.text) >= long:
            b.label = 1
        else:
            b.label = None if x >= LOW_STOPS else 0


def _nearest(found: list[Block], zones: tuple[int, ...]) -> tuple[list, list]:
    """Labels of the nearest decided blocks of some zones before and after each block."""
    sides = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        near, last = [None] * len(found), None
        for i in order:
            near[i] = last
            b = found[i]
            if b.label is not None and b.zone in zones:
                last = b.label
        sides.append(near)
    return sides[0], sides[1]


def inherit(found: list[Block]) -> None:
    """Second pass: open blocks take the label of the nearest decided neighbours."""
    zoned = any(b.zone > 0 for b in found)
    sides = {True: _nearest(found, (1,)), False: _nearest(found, (-1, 0))}
    least = HIGH_STOPS if zoned else LOW_STOPS
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        if b.label is not None:
            continue
        before, after = (side[i] for side in sides[b.zone > 0])
        if b.heading and after is not None:
            labels[i] = after
        elif before == after and before is not None:
            labels[i] = before
        elif b.zone > 0:
            labels[i] = 1
        elif zoned:
            labels[i] = int(len(b.text) >= SHORT and b.stops >= least)
        elif before is None or after is None:
            told = after if before is None else before
            if told is None:
                labels[i] = int(b.stops >= least)
            else:
                labels[i] = told if _MARK.search(b.text) else 0
        else:
            labels[i] = int(b.stops >= least)
    for b, label in zip(found, labels, strict=True):
        b.label = label


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    decide(found)
    if not any(b.label for b in found):
        opened = blocks(html or "", marked=False)
        decide(opened)
        if any(b.label and len(b.text) >= SHORT and b.stops >= HIGH_STOPS for b in opened):
            found = opened
    inherit(found)
    return "\n".join(b.text for b in found if b.label)


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep``, text and n_chars of every row of ``pages``."""
    names = [*keep, "text", "n_chars"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                     for f in (pages.schema[c] for c in keep))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=names,
            )

    schema = (kept + ", " if kept else "") + "text string, n_chars long"
    rows = pages.select(*[pages[f"`{c}`"] for c in keep], pages[f"`{html_col}`"])
    return map_texts(rows, extract, schema)
