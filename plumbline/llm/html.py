"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without an end tag, elements whose text is no page text, and elements that hold no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select annotation".split())
APART = frozenset("nav header footer aside form menu dialog button fieldset".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder "
    "munderover semantics".split()
)
# An open paragraph ends where one of these starts; items and cells end where the next one starts.
ENDS_ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie "
    "cookies consent discussion disclaimer disqus foot footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promotion related remark replies reply respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
# Marks that prose bears too, as in related-work: what such an element holds decides.
WEAK_MARKS = frozenset("related share sharing skip social".split())
KEEPS_MARK = frozenset("html body article main".split())
# Beside a mark in a compound name, as in with-sidebar, these say that the element is not it but has or lacks one.
MODIFIERS = frozenset("with without has have no enabled disabled".split())
# Compound names with these never wrap the article.
REPLIES = frozenset("comment comments discussion disqus replies reply respond".split())
# Beside the best container these stay whatever their score.
CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure section hgroup address details".split())

_BEFORE = r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
_QUOTED = r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_PLAIN = r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?][^>]*+(?:>|\Z)"
TOKEN = re.compile(_BEFORE + _QUOTED + _PLAIN, re.S | re.I)
# For pages with a quote that never ends: quotes do not hide the end of a tag.
UNQUOTED = re.compile(_BEFORE + _PLAIN, re.S | re.I)
ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-z]+")
COMMAS = re.compile("[,،、，]")

MIN_SIBLING = 10.0
SHARE_OF_BEST = 0.2
REACH = 32  # points pass to so many ancestors, which keeps deep nesting linear
PROSE = 40  # characters outside links that make a block prose; fewer do if they end as a sentence does
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？")


class Element:
    __slots__ = ("tag", "parent", "apart", "link", "doubt", "doubted", "holder", "mixed", "score")

    def __init__(self, tag: str, parent: Element | None, apart: bool, link: Element | None = None, doubt: int = 0):
        self.tag, self.parent, self.apart, self.score = tag, parent, apart, 0.0
        self.link = self if tag == "a" else link  # the link around it
        self.doubt = doubt  # marked by a part of a name (1) or by a weak mark (2)
        self.doubted = self if doubt else parent and parent.doubted  # the nearest element in doubt
        self.holder = parent.holder if tag in INLINE else self  # the nearest block
        self.mixed = False  # holds an element that is apart


class Block:
    """A run of text between two block boundaries, and the element that holds it."""

    __slots__ = ("holder", "pieces", "linked", "links", "link")

    def __init__(self, holder: Element):
        self.holder, self.pieces, self.linked, self.links, self.link = holder, [], 0, 0, None

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())

    @property
    def length(self) -> int:
        return sum(len(p.strip()) for p in self.pieces)


def _marks(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is marked as no article, and the doubt if only a part of a name or a weak mark says so."""
    if not attrs or tag in KEEPS_MARK:
        return False, 0
    doubt = 0
    for found in ATTR.finditer(attrs):
        attr, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if attr == "hidden" or (attr == "aria-hidden" and value.strip() == "true") or (attr == "style" and UNSEEN.search(value)):
            return True, 0
        if attr not in ("class", "id", "role"):
            continue
        for name in value.split():
            parts = NAME.findall(name)
            marks = MARKS.intersection(parts)
            if not marks or (len(parts) > 1 and not MODIFIERS.isdisjoint(parts)):
                continue
            if marks <= WEAK_MARKS and tag != "a":
                doubt = doubt or (0 if tag in INLINE else 2)
            elif len(parts) == 1 or tag in INLINE or not REPLIES.isdisjoint(parts):
                return True, 0
            else:
                doubt = 1
    return False, doubt


def _tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The text before each tag, comment or script, and that; last the text after all of them."""
    pattern, at, start, last = TOKEN, 0, page.find("<"), page.rfind(">")
    while 0 <= start < last:
        token = pattern.match(page, start)
        if token is None:
            start = page.find("<", start + 1)
            continue
        if pattern is TOKEN and token["tag2"]:
            pattern = UNQUOTED
        yield page[at:start], token
        at = token.end()
        start = page.find("<", at)
    rest = page[at:]
    # no tag ends beyond the last >; comments and declarations run to the end
    open_end = re.search("<[!?]", rest)
    yield rest[: open_end.start()] if open_end else rest, None


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks of text in page order, and the elements in doubt, outer ones first.

    The tree is mended the way browsers do for unclosed elements. Each element is opened and closed once and an
    end tag finds its element by name, so the time is linear in the page's length.
    """
    root = Element("", None, False)
    here, blocks, block = root, [], None
    doubts: list[Element] = []
    opened: dict[str, list[Element]] = {}

    def put(piece: str) -> None:
        nonlocal block
        holder = here.holder
        if block is None or block.holder is not holder or here.apart != block.holder.apart:
            block = Block(holder if here.apart == holder.apart else here)
            blocks.append(block)
        block.pieces.append(piece)
        if here.link is not None and (length := len(piece.strip())):
            block.linked += length
            if here.link is not block.link:
                block.link, block.links = here.link, block.links + 1

    def close(element: Element) -> None:
        nonlocal here
        while here is not element.parent:
            opened[here.tag].pop()
            here = here.parent

    for before, token in _tokens(page):
        if before:
            put(before)
        if token is None:
            break
        quoted = token.re is TOKEN and token["tag"]
        tag = (quoted or token["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            put(" ")
            continue
        if token["end"] if quoted else token["end2"]:
            named = opened.get(tag)
            # an end tag of inline text does not close the blocks around it
            if named and (tag not in INLINE or named[-1].holder is here.holder):
                close(named[-1])
            if tag not in INLINE:
                block = None
            continue
        if tag in VOID:
            continue
        attrs = token["attrs"] if quoted else token["attrs2"]
        if tag not in INLINE:
            block = None
            inner = here.holder
            if inner.tag == "p" or inner.tag in ENDS_ITEM.get(tag, ()):
                close(inner)
        marked, doubt = _marks(tag, attrs)
        if (marked or doubt or tag in APART) and tag not in RAW and tag not in INLINE:
            here.mixed = True
        here = Element(tag, here, here.apart or tag in APART or marked, here.link, doubt)
        opened.setdefault(tag, []).append(here)
        if doubt:
            doubts.append(here)
        if attrs.rstrip().endswith("/") and tag not in INLINE:
            close(here)
    return blocks, doubts


def _points(block: Block, text: str) -> float:
    outside = max(0.0, 1.0 - block.linked / max(1, block.length))
    return (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3.0)) * outside


def _settle_doubts(read: list[tuple[Block, str, float]], doubts: list[Element]) -> list[tuple[Block, str, float]]:
    """Leave out elements in doubt, unless they hold more than half of all points.

    Those with weak marks stay too if they hold prose and most of their text is outside links.
    """
    if not doubts:
        return read
    held = {e: [0.0, 0, 0, False] for e in doubts}  # points, characters, characters in links, prose
    for block, text, points in read:
        if block.holder.doubted is not None:
            mine, length = held[block.holder.doubted], block.length
            mine[0] += points
            mine[1] += length
            mine[2] += block.linked
            mine[3] |= 2 * block.linked < length and (length - block.linked >= PROSE or text.endswith(SENTENCE_ENDS))
    for e in reversed(doubts):
        outer = e.parent.doubted
        if outer is not None:
            held[outer] = [a + b for a, b in zip(held[outer], held[e])]
    half = sum(points for _, _, points in read) / 2
    stays = {None: True}
    for e in doubts:
        points, length, linked, prose = held[e]
        stays[e] = stays[e.parent.doubted] and (points > half or bool(e.doubt == 2 and prose and 2 * linked < length))
    return [r for r in read if stays[r[0].holder.doubted]]


def main_text(page: str | None) -> str:
    """Text of the article around the best scored container.

    Each block of text gives one point, one for each comma and up to three for its length, times the share of
    its text outside links: whole to the element around its paragraph, half to the next, a third and so on
    beyond, up to the 32nd. Menus, headers, footers, asides, notices, adverts, forms, comments and hidden elements take no part.

    If the best container is or lies in an article or main element, all other text of the outermost one stays, blocks
    of links too; else all of its parent, if that holds no element that is left out. Otherwise the parent's own text and headings,
    paragraphs, quotes, lists, tables and sections stay, and other siblings by their score.
    """
    if not page:
        return ""
    blocks, doubts = parse(page)
    read = _settle_doubts([(b, t, _points(b, t)) for b in blocks if not b.holder.apart and (t := b.text)], doubts)
    order: dict[Element, None] = {}
    for block, text, points in read:
        above, share = block.holder if block.holder.tag in ("div", "section", "article", "main", "body", "td", "") else block.holder.parent, 1
        while above is not None and share <= REACH:
            above.score += points / share
            order.setdefault(above)
            above, share = above.parent, share + 1
    if not order:
        return ""
    best = max(order, key=lambda e: e.score)
    if best.score <= 0:
        return ""
    whole, element = None, best
    while element is not None:
        if element.tag in ("article", "main"):
            whole = element
        element = element.parent
    if whole is None:
        whole = best.parent if best.parent is not None and not best.parent.mixed else best
    least = max(MIN_SIBLING, SHARE_OF_BEST * best.score)
    kept: dict[Element, bool] = {whole: True}

    def belongs(element: Element) -> bool:
        if whole is best and element is best.parent:
            return True
        chain = []
        while element is not None and element not in kept:
            if whole is best and element.parent is best.parent:
                kept[element] = element.tag in CONTENT or element.score >= least
                break
            chain.append(element)
            element = element.parent
        answer = element is not None and kept[element]
        for e in chain:
            kept[e] = answer
        return answer

    def menu(block: Block) -> bool:
        return whole.tag not in ("article", "main") and block.links >= 3 and 4 * block.linked > 3 * block.length

    return "\n".join(text for block, text, _ in read if belongs(block.holder) and not menu(block))


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [main_text(page) for page in frame["html"]]
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """The main text of each page, one row per row of ``pages``.

    Null and empty pages, and pages without text, give an empty text of zero code points. Pages are parsed whole
    in one pass that is linear in their length, whatever their size. Repeated rows are kept, null ids and URLs
    stay null, other columns are ignored, an empty table gives no rows. No shuffle.
    """
    kind = dict(pages.dtypes)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return rows.mapInPandas(_extract, f"page_id {kind[page_id]}, url string, text string, n_chars long")
