"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements, and each block knows its place (article, menu, comments and so on, from
element names, roles and class names). The first pass decides blocks by the density of stop words, by length and by link
density; a place outside the article, where a page marks one, is decided too. Blocks that stay ambiguous, mostly short ones,
then take the label of the nearest decided neighbours of their region.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import extended, in_arrow, slices, without

ADDED = {"main_text": "string"}
#: Share of a block's characters in links from which it is no text; lengths of short and of long blocks, in characters; shares
#: of stop words that make a block text, or perhaps text.
LINKS, SHORT, LONG, STOP_HIGH, STOP_LOW = 0.5, 70, 200, 0.30, 0.18
# fixed values: frequent words of English, German, French and Spanish
STOP_WORDS = frozenset("""
a about all an and are as at be been but by can could did do for from had has have he her his how i if in into is it its
more my no not of on one or our out she so some than that the their them there they this to up was we were what when which
who will with would you your
aber als am an auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer er es für
hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mon ne nous on
ou où par pas pour qu que qui sa se ses son sur un une vous y
al como con de del desde el ella en entre es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por
que se sin sobre son su sus también te un una y ya
""".split())
# fixed values: elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
DROPPED = frozenset("script style textarea title noscript template iframe xmp head svg math canvas object select button option datalist label dialog audio video annotation annotation-xml".split())
OUTSIDE = frozenset("nav footer aside menu form".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose mmultiscripts semantics".split())
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# fixed values: words in class names, ids and roles of what is not the article
HINTS = frozenset("""
ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner
nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar masthead topbar skip
footer sidebar sidebars aside widget widgets complementary contentinfo search
comment comments commentlist disqus respond replies reply discussion
cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login
paywall share sharing social related recommended recommendations outbrain taboola tags
""".split())
#: Words that leave a name's meaning as it is: site-footer is a footer, with-sidebar is no sidebar.
NEUTRAL = frozenset("site main top bottom left right global primary secondary list box bar container wrapper wrap area block section inner outer content header the post posts item items form link links".split())
COMMENTS = frozenset("comment comments reply replies respond".split())
ONLY_OUTSIDE = frozenset("header heading title".split())
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: float
    place: str  # "in", "out" or "" if the page does not tell
    label: str = field(default="")


def _named(value: str | None) -> set[str]:
    """The hints among the names of a class, an id or a role: of names that are made of hints and neutral words alone."""
    found = set()
    for name in html.unescape(value or "").split():
        words = {w.lower() for w in _NAME_WORD.findall(name)}
        if {w for w in words if not w.isdigit()} <= HINTS | COMMENTS | ONLY_OUTSIDE | NEUTRAL:
            found |= words - NEUTRAL | words & ONLY_OUTSIDE
    return found


def _hint(tag: str, attributes: str, above: str = "") -> str:
    """"out" for what is not the article, "named" if only its names say so, "comments" if they name comments, "in" for the
    article, "top" for a page's header, else ""."""
    if tag in OUTSIDE:
        return "out"
    if attributes:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        role = (found.get("role") or "").lower()
        names = _named(found.get("class")) | _named(found.get("role"))
        own = _named(found.get("id"))
        names |= own & COMMENTS if above == "in" else own  # inside an article an id is mostly a heading's anchor
        if tag in ("html", "body", "main"):  # their classes name what a page has, not what they are
            names = set()
        elif tag == "article":
            names &= COMMENTS
        if found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style") or "") or re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
            return "out"
        if names & HINTS:
            return "comments" if names & COMMENTS else "named"
        if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
            return "in"
        if tag not in ("article", "main") and names & ONLY_OUTSIDE and tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "top"
    if tag in ("article", "main"):
        return "in"
    return "top" if tag == "header" else ""


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order; markup, scripts, styles and form controls are left out."""
    out: list[Block] = []
    stack: list[tuple[str, str, str]] = []  # (element, its place, the hint that put it out)
    open_: Counter[str] = Counter()  # how many of each element, and of each hint, are in the stack
    unclosed: set[str] = set()
    text: list[str] = []
    linked = at = 0
    place = ""

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            out.append(Block(joined, min(1.0, linked / len(joined)), place))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        shown = html.unescape(raw) if "&" in raw else raw
        text.append(shown)
        if open_["a"]:
            linked += len("".join(shown.split()))

    def settle() -> None:
        nonlocal place
        place = stack[-1][1] if stack else ""

    def pop() -> str:
        tag, _, why = stack.pop()
        open_[tag] -= 1
        open_["?" + why] -= 1
        return tag

    while (m := _MARKUP.search(page, at)) is not None:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end
            if tag not in INLINE:
                flush()
            if open_[tag]:
                while pop() != tag:
                    pass
                settle()
            elif tag == "p":
                flush()
            continue
        if tag in RAW or tag in DROPPED and not (tag == "math" and place == "in"):
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(page, at)
            if tag not in INLINE:
                flush() if tag not in ("label", "button", "select", "option") else text.append(" ")
            if end:
                at = end.end()
                continue
            unclosed.add(tag)
            if tag in RAW and tag != "title":
                at = len(page)
            continue
        if tag == "br" or tag in VOID:
            text.append(" ") if tag != "hr" else flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
            if tag in CLOSES:
                names = CLOSES[tag].split()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in names:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
            elif open_["p"]:  # a block ends an open paragraph, unless another block stands between
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] not in INLINE:
                        break
            settle()
        if attributes.rstrip().endswith("/") and tag in INLINE:
            continue
        above = stack[-1][1] if stack else ""
        hint = _hint(tag, attributes, above)
        if above == "out":
            # an article may stand in a form, and in what is out for its names alone; in comments only main may
            back = hint == "in" and not open_["?out"] and not open_["?top"] and (tag == "main" or not open_["?comments"])
            own = "in" if back else "out"
        elif hint == "top":
            own = above or "out"
        else:
            own = "out" if hint in ("named", "comments") else hint or above
        if tag in INLINE and own != above and own == "out":
            flush()
        why = "" if own != "out" else "form" if tag == "form" else hint if hint in ("named", "comments", "out") else "top" if above != "out" else ""
        stack.append((tag, own, why))
        open_[tag] += 1
        open_["?" + why] += 1
        settle()
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _judged(block: Block, inside: bool) -> str:
    """The first pass: text, no, or for the second pass, short or near; inside: the page marks an article with text."""
    if block.place == "out" or inside and block.place != "in":
        return "no"
    if block.links > LINKS:  # a list of links; in an article it may be its references
        return "short" if block.place == "in" else "no"
    if len(block.text) < SHORT:
        return "short"
    words = _WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if share >= STOP_HIGH:
        return "text" if len(block.text) >= LONG else "near"
    return "near" if share >= STOP_LOW or len(block.text) >= LONG or block.place == "in" else "no"


def judged(page: str | None) -> list[tuple[Block, bool, str]]:
    """Each block of a page, whether it is text, and what decided it: place, density (with length and links), neighbours,
    or default where no block of its region is decided."""
    found = blocks(page or "")
    inside = any(b.place == "in" and b.links <= LINKS for b in found)
    for b in found:
        b.label = _judged(b, inside)
    # neighbours count inside a region: the article, or the page where no article is marked
    region = [i for i, b in enumerate(found) if b.place != "out" and (b.place == "in" or not inside)]
    decided = [i for i in region if found[i].label in ("text", "no")]
    any_text = any(found[i].label == "text" for i in decided)
    order = {i: n for n, i in enumerate(region)}
    before, after, last = {}, {}, None
    for i in region:
        before[i] = last
        last = i if found[i].label in ("text", "no") else last
    last = None
    for i in reversed(region):
        after[i] = last
        last = i if found[i].label in ("text", "no") else last
    out = []
    for i, b in enumerate(found):
        if b.label in ("text", "no"):
            out.append((b, b.label == "text", "place" if i not in order else "density"))
            continue
        sides = [(abs(order[i] - order[j]), found[j].label == "text") for j in (before[i], after[i]) if j is not None]
        least = min((d for d, _ in sides), default=0)
        votes = [g for d, g in sides if d == least]
        good = (any(votes) if b.label == "near" else all(votes)) if votes else True
        out.append((b, good or b.label == "near" and not any_text, "neighbours" if votes else "default"))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two line feeds; empty if there are none.

    If the page marks an article or main element with text, blocks outside it are no text; in it none is decided against, so
    that its ambiguous blocks, links too, follow the dense ones. Else an ambiguous block takes the label of the nearest
    decided block; of two as near, a longer block takes the better and a short one the worse. If nothing in the region is
    decided, ambiguous blocks are text.
    """
    return "\n\n".join(b.text for b, good, _ in judged(page) if good)


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """pages with main_text. Null and empty pages have an empty text; whole pages are read, however long or deeply nested, in
    time in proportion. Rows that repeat are each extracted, an empty table gives an empty one. A column of that name, in any
    letter case, is replaced, other columns stay."""
    base = without(pages, list(ADDED))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, markup)):
            texts = pa.array([main_text(p) for p in batch.column(markup).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, *ADDED])

    return in_arrow(base, run, extended(base, **ADDED))


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
