"""HTML main-text extraction by two-pass block rules.

A tolerant scan cuts a page into blocks at block-level tags. Pass one classifies each block by itself from its
length, its link density and its stop-word density: ``good``, ``bad``, ``near`` (decent but not certain) or
``short`` (too short to tell). Pass two gives ``near`` and ``short`` blocks the label of their nearest decided
neighbours. Stop words only count against a block where they occur on the page at all (``fitting``): in a language
without a list, length, link density and sentence ends decide. What the markup itself declares is part of the rules: a block inside page
furniture (menus, headers, footers, asides, forms, notices, adverts, reader comments) goes at once. Where a page marks
its article, both passes run on either side of the mark by itself, and the mark is one vote more: an undecided block goes with the
majority of its nearest decided neighbours and the mark, a tie with the mark. Inside the article links count against items
of lists only, so a paragraph that is mostly a link stays, and the article's own header is no furniture.

Text inside a block: character references decoded, white space turned into one space, trimmed; blocks are
joined in page order by one newline. Nothing else is dropped or capped.

Defined results: null and empty html give an empty text; broken or unclosed markup is read as far as it goes;
a very long page is one slice; an empty table gives no rows; repeated pages are read one by one; further columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklane.llm.common import batches

#: The most frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    """
    the of and to in is that it was for on are with as be at by from this or an have not they which you were he she a
    der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    le la les de des du et en un une est que qui dans pour par sur pas plus au avec ce il sont se son sa aux
    el los las una y que del se con por para como más su al lo es no sus o este
    """.split()
)
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
OPAQUE = frozenset("script style noscript template textarea iframe object svg math canvas audio video select button title head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Page furniture by element, by role and by words in class or id.
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner promo promoted sponsor sponsored sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription share sharing social related recommended "
    "comment comments commentlist respond disqus reply replies login signup widget toolbar pagination pager".split()
)
#: Words that only say where or what kind of box a part is.
PLACE_WORDS = frozenset(
    "main site page global top bottom left right inner outer wrap wrapper container box bar area block section unit slot list item items link links button buttons "
    "post posts text content form primary secondary mobile desktop fixed sticky".split()
)
ARTICLES = frozenset("article main".split())
LISTS = frozenset("li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
BOXES = frozenset("div section aside ul ol dl table figure span".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)", re.S)
PLAIN = re.compile(r"[^>\"']*+")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[^\W_]+")
PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Rules:
    """Thresholds of the first pass."""

    short_chars = 70
    long_chars = 200
    link_density = 0.3
    stop_low = 0.12
    stop_high = 0.2
    #: Share of stop words on a page from which one of the lists fits its language.
    stop_page = 0.06


def tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """Where a tag's attributes end and where the page goes on. A quote opens a value behind ``=`` if it is closed at all (``last``: the
    place of each quote's last occurrence), so no part of a page is read twice."""
    while (at := PLAIN.match(page, at).end()) < len(page):
        mark = page[at]
        if mark == ">":
            return at, at + 1
        before = at - 1
        while page[before].isspace():
            before -= 1
        at = page.index(mark, at + 1) + 1 if page[before] == "=" and last[mark] > at else at + 1
    return len(page), len(page)


def furniture(tag: str, attributes: str) -> bool:
    return tag in FURNITURE or declared_furniture(tag, attributes)


def declared_furniture(tag: str, attributes: str) -> bool:
    """Whether role, class, id or visibility say so."""
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and tag not in HEADINGS and any(names_furniture(tag, token) for token in value.split()):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes, re.I))


def names_furniture(tag: str, token: str) -> bool:
    """A furniture word by itself; on a box also one among words of place only: ``site-header``, not ``page-header-study``."""
    if token.lower() in FURNITURE_WORDS:
        return True
    parts = {w.lower() for w in PIECES.findall(token)}
    return tag in BOXES and not parts.isdisjoint(FURNITURE_WORDS) and parts <= FURNITURE_WORDS | PLACE_WORDS


class Block:
    __slots__ = ("article", "furniture", "links", "listed", "parts")

    def __init__(self, is_furniture: bool, article: bool, listed: bool = False):
        self.parts: list[str] = []
        self.links = 0
        self.furniture, self.article, self.listed = is_furniture, article, listed


class Open(NamedTuple):
    """An open tag. ``near``: the place of the nearest open paragraph or block at or below it, -1 for none."""

    name: str
    bad: bool
    opaque: bool
    near: int


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, white space not yet cleaned. One pass: every tag is pushed and popped once."""
    found: list[Block] = []
    tags: list[Open] = []
    opened: Counter[str] = Counter()
    bad = opaque = 0
    block: Block | None = None
    last = {mark: page.rfind(mark) for mark in "\"'"}
    ends = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}

    def text(data: str) -> None:
        nonlocal block
        if opaque or not data:
            return
        if block is None:
            block = Block(bad > 0, any(opened[x] for x in ARTICLES), any(opened[x] for x in LISTS))
            found.append(block)
        data = entities.unescape(data)
        block.parts.append(data)
        if opened["a"]:
            block.links += len(data.strip())

    def close(at: int) -> None:
        """The tags from ``at`` on are no longer open."""
        nonlocal bad, opaque
        for tag in tags[at:]:
            bad, opaque = bad - tag.bad, opaque - tag.opaque
            opened[tag.name] -= 1
        del tags[at:]

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        stop, at = tag_end(page, at, last)
        closing, name, attributes = bool(m[1]), m[2].lower(), page[m.end() : stop]
        if name in BLOCKS:
            block = None
        if closing:
            if opened[name]:
                k = len(tags) - 1
                while tags[k].name != name:
                    k -= 1
                close(k)
            continue
        if name == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:  # its content is no markup
            raw_end = ends[name].search(page, at)
            at = raw_end.end() if raw_end else end
            continue
        if name == "p" and tags and (k := tags[-1].near) >= 0 and tags[k].name == "p":
            close(k)  # a paragraph that stays open ends where the next begins, with what it holds
        inside = any(opened[x] for x in ARTICLES)
        is_bad = declared_furniture(name, attributes) if inside and name == "header" else furniture(name, attributes)
        if name in ("html", "body") or name in ARTICLES and not is_bad_article(attributes):
            is_bad = False
        near = len(tags) if name in BLOCKS else tags[-1].near if tags else -1
        tags.append(Open(name, is_bad, name in OPAQUE, near))
        bad, opaque = bad + is_bad, opaque + (name in OPAQUE)
        opened[name] += 1
    return found


def is_bad_article(attributes: str) -> bool:
    """An ``article`` element that holds a reader's comment or an advert."""
    return bool(attributes.strip()) and furniture("article", attributes)


def stop_share(texts: list[str]) -> float:
    found = [w for t in texts for w in WORD.findall(t.lower())]
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


SENTENCE_END = re.compile(r"[.!?\u3002\uff01\uff1f\u0964\u061f]")


def classify(text: str, block: Block, rules=Rules, fitting: bool = True) -> str:
    """First pass: the class of a block by itself. ``fitting``: whether a list of stop words fits the page.

    A sentence without links and of ordinary length is too little evidence for a low share of stop words: ``near``.
    """
    density = block.links / max(1, len(text))
    if density > rules.link_density and (block.listed or not block.article):
        return "bad"
    if len(text) < rules.short_chars:
        return "short"
    sentence = bool(SENTENCE_END.search(text))
    if not fitting:
        return "good" if len(text) > rules.long_chars and sentence else "near"
    stops = stop_share([text])
    if stops >= rules.stop_high:
        return "good" if len(text) > rules.long_chars else "near"
    if stops >= rules.stop_low or block.article:
        return "near"
    return "near" if sentence and not block.links and len(text) <= rules.long_chars else "bad"


def nearest(classes: list[str], marks: list[bool]) -> list[tuple[tuple[str | None, int], tuple[str | None, int]]]:
    """Label and distance of the nearest decided block before and after each block, on its side of the mark."""
    n = len(classes)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        side, label, far, mark = [(None, n)] * n, None, n, None
        for k in order:
            if marks[k] != mark:
                label, far, mark = None, n, marks[k]
            far += 1
            if classes[k] in ("good", "bad"):
                label, far = classes[k], 0
            side[k] = (label, far)
        sides.append(side)
    return list(zip(*sides, strict=True))


def settle(classes: list[str], marks: list[bool]) -> list[bool]:
    """Second pass: whether each block is kept.

    Where the page marks its article (some of ``marks``: whether a block lies in it), an undecided block goes with the majority of the nearest
    decided blocks before and after it, on its side of the mark, and the mark itself; a tie goes with the mark. On a page without marks it
    takes its nearest decided neighbour's label; if two equally near ones differ, ``near`` is kept and ``short`` is not; without any decided block all
    undecided blocks are kept.
    """
    marked = any(marks)
    kept = []
    for own, mark, ((a, da), (b, db)) in zip(classes, marks, nearest(classes, marks), strict=True):
        if own in ("good", "bad"):
            label = own
        elif marked:
            votes = [x == "good" for x in (a, b) if x is not None] + [mark]
            label = "good" if 2 * sum(votes) > len(votes) or 2 * sum(votes) == len(votes) and mark else "bad"
        elif a is None and b is None:
            label = "good"
        elif a is None or b is None or da != db:
            label = a if b is None or a is not None and da < db else b
        else:
            label = a if a == b else "good" if own == "near" else "bad"
        kept.append(label == "good")
    return kept


def decided(page: str | None) -> list[tuple[str, str, bool]]:
    """The page's blocks outside furniture: text, class of the first pass, whether it is kept."""
    blocks = [(" ".join("".join(b.parts).split()), b) for b in blocks_of(page or "")]
    blocks = [(t, b) for t, b in blocks if t and not b.furniture]
    fitting = stop_share([t for t, _ in blocks]) >= Rules.stop_page
    classes = [classify(t, b, fitting=fitting) for t, b in blocks]
    kept = settle(classes, [b.article for _, b in blocks])
    return [(t, c, k) for (t, _), c, k in zip(blocks, classes, kept, strict=True)]


def main_text(page: str | None) -> str:
    return "\n".join(t for t, _, keep in decided(page) if keep)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its id, url, ``text`` and ``n_chars`` (code points of the text)."""
    fields = pages.select(id_col, url_col).withColumns({"text": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).schema

    def step(batch):
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return {id_col: batch.column(0), url_col: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return batches(pages.select(id_col, url_col, html_col), step, fields)
