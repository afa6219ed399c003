"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by their
place (menus, footers, forms, comments and the like are boilerplate), link density, length
and share of stop words.  Blocks that these rules leave open, mostly short ones, take the
label of the nearest decided neighbour in the second pass: neighbours of the same region,
which is the article for blocks inside one and the rest of the page for others.

Inside an article a class name or id counts only if all its words speak of the page
(``promo-box``, not ``promo-code``).  Names of adverts, menus and notices decide; those that
a passage may have too, as ``legal`` or ``related``, give way to length, stop words and
neighbours.  A sentence that is mostly a link stays open there, a list of links does not.
Code and table cells are not decided by their lack of stop words but by their neighbours.

Stop words are those of English, German, French and Spanish.  A page on which no block has
enough of them is decided by place, link density and length alone.

Each page is parsed alone and in linear time; nothing is shuffled.

Defined cases: null and empty pages, and pages without any text, give the empty text.  A
page whose blocks all stay undecided keeps them.  Broken markup never raises: unclosed
elements end with the element around them, however many they are, or where HTML implies it, and what follows an unclosed script is code.
Very long texts are read whole.  An empty table gives an empty result.  Extra columns, of
any name, do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from .common import col

# Common function words of four languages.
STOP_WORDS = frozenset((
    "a about after all also an and any are as at be been but by can could do for from had has have he her his "
    "i if in into is it its more my no not of on one or our she so than that the their them there they this to "
    "was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer "
    "es für hat ich ihr im in ist man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor "
    "war was wenn wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par "
    "pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en era es esta está este fue ha hay la las le lo los más me mi muy no nos o para "
    "pero por que se ser si sin sobre su sus un una y ya").split())

# HTML element names by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CODE = frozenset("head script style noscript template svg math iframe object canvas audio video map".split())
_BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul").split())
_BOILERPLATE = frozenset(
    "nav footer aside form menu dialog button select textarea input fieldset option datalist".split())
_REGION = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu".split())

# Words in class names and ids that mark boilerplate; those of reader comments
# also mark an article inside, as each comment may be one.
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond feedback".split())
_HINTS = _COMMENTS | frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert newsletter subscribe subscription signup login register share sharing "
    "social related recommended recommendations sidebar side widget widgets menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar toolbar pager pagination popup modal overlay copyright disclaimer "
    "legal skip hidden").split())
_ABOUT_THE_PAGE = frozenset("has with without no".split())  # has-sidebar is not a sidebar
# Inside an article: words that decide nothing against its own passages, words that say nothing of
# themselves beside a hint, and one that is no hint there, as is the element of this name.
_SOFT_HINTS = frozenset("social related recommended recommendations legal footer copyright disclaimer side widget widgets".split())
_FILLERS = frozenset((
    "area bar block box button buttons container content count form group inner item items link links list panel post "
    "posts row section slot text thread title top bottom left right unit wrap wrapper").split())
_NO_HINT = frozenset(("header",))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTINGS = ("pre", "code", "td", "th")

# Boilerplate by a class name that density may overrule; by one that only an article inside undoes; by anything else.
_SOFT, _WEAK, _STRONG = 1, 2, 3

# End tags that HTML lets a page leave out.  A start tag ends the open elements
# named first, unless one of those named second was opened inside them.
_CELLS = frozenset("td th caption colgroup".split())
_ROWS = _CELLS | {"tr"}
_PARTS = frozenset("thead tbody tfoot".split())
_TABLE = frozenset(("table",))
_CLOSED_BY = {"td": (_CELLS, _TABLE | {"tr"}), "th": (_CELLS, _TABLE | {"tr"}), "tr": (_ROWS, _TABLE | _PARTS),
              **{t: (_ROWS | _PARTS, _TABLE) for t in _PARTS},
              "option": (frozenset(("option",)), frozenset("select optgroup datalist".split()))}
# These end the innermost open block if it is one of those named; an address, div or p does not count as a block.
_LISTED = {"li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt"))}
_PASSED = frozenset("address div p".split())


_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"  # a comment, to the end of the page if it is not closed
    r"|<(?P<raw>script|style|noscript|template|textarea|title)\b" + _ATTRIBUTES + r">.*?(?:</(?P=raw)[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>" + _ATTRIBUTES + r")>"
    r"|<[!?/a-z][^>]*+(?:>|\Z)",  # declarations, and tags with a quote that does not end
    re.S | re.I)
_NOTABLE = re.compile(
    r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|(?=[\s/]|\Z))""",
    re.I)


@dataclass
class Block:
    """``level``: how strongly its place marks it; ``listing``: code or a table cell; ``linked``: characters in
    links; ``loose``: places of the pieces outside links."""

    level: int
    region: int
    listing: bool = False
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    loose: list[int] = field(default_factory=list)

    @property
    def boilerplate(self) -> bool:
        return self.level > _SOFT


def _hint_inside(tag: str, name: str, value: str) -> int:
    """The same for a class or id inside an article: a name counts if all its words speak of the page."""
    level = 0
    if tag in _HEADINGS and name == "id":  # made from the heading's own words
        return level
    for part in value.split():
        words = set(re.split(r"[^a-z]+", part)) - {""} - _NO_HINT
        hints = words & _HINTS
        if not hints or not words <= _HINTS | _FILLERS:
            continue
        if not hints.isdisjoint(_COMMENTS):
            return _STRONG
        if hints - _SOFT_HINTS:
            level = _WEAK
        elif tag in _BLOCK:
            level = max(level, _SOFT)
    return level


def _hint(tag: str, attributes: str, region: int) -> int:
    """How strongly an element's attributes mark it as boilerplate: 0, or one of the levels."""
    if tag in ("html", "body"):
        return 0
    level = 0
    for name, value in _NOTABLE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and region and tag not in _REGION:
            level = max(level, _hint_inside(tag, name, value))
        elif name in ("class", "id"):
            for words in (set(re.split(r"[^a-z]+", part)) for part in value.split()):
                if not _COMMENTS.isdisjoint(words):
                    return _STRONG
                if tag != "main" and not _HINTS.isdisjoint(words) and _ABOUT_THE_PAGE.isdisjoint(words):
                    level = _WEAK
        elif (name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES)
              or (name == "style" and "display:none" in value.replace(" ", ""))):
            return _STRONG
    return level


class _Page:
    """Cuts a page into blocks.  Open elements are ``(tag, boilerplate level, code, link, region)``."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        self.places: dict[str, list[int]] = {}  # of each tag's open elements, inner ones last
        self.inner: list[int] = []  # places of open blocks
        self.walls: list[int] = []  # the same without address, div and p
        self.regions = 0
        self.block: Block | None = None
        at = 0
        for m in _MARKUP.finditer(html):
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            if m["end"]:
                self._end(tag.lower())
            else:
                self._start(tag.lower(), m["attributes"])
        self._text(html[at:])

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self.block = None
        if tag in _VOID:
            if tag == "br":
                self._text("\n")
            return
        if tag in _BLOCK and self.inner and self.open[self.inner[-1]][0] == "p":
            self._close(self.inner[-1])
        if tag in _LISTED and self.walls and self.open[self.walls[-1]][0] in _LISTED[tag]:
            self._close(self.walls[-1])
        if tag in _CLOSED_BY:
            ended, around = _CLOSED_BY[tag]
            wall = max(map(self._last, around))
            if inside := [at for at in map(self._last, ended) if at > wall]:
                self._close(min(inside))
        _, level, code, link, region = self.open[-1]
        if tag in _REGION and not region:
            self.regions += 1
            region = self.regions
            level = level if level == _STRONG else 0
        if tag in _BOILERPLATE or (tag == "header" and not region):
            level = _STRONG
        elif attributes:
            level = max(level, _hint(tag, attributes, region))
        at = len(self.open)
        self.places.setdefault(tag, []).append(at)
        if tag in _BLOCK:
            self.inner.append(at)
            if tag not in _PASSED:
                self.walls.append(at)
        self.open.append((tag, level, code or tag in _CODE, link or tag == "a", region))

    def _last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, or 0."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _close(self, at: int) -> None:
        """Ends the open element at this place and all inside it."""
        for tag, *_ in self.open[at:]:
            self.places[tag].pop()
        del self.open[at:]
        for places in (self.inner, self.walls):
            while places and places[-1] >= at:
                places.pop()

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.block = None
        if at := self._last(tag):
            self._close(at)

    def _text(self, data: str) -> None:
        _, level, code, link, region = self.open[-1]
        if code:
            return
        block, level = self.block, min(level, _WEAK)
        if block is None or block.level != level:
            if not data or data.isspace():
                return
            block = self.block = Block(level, region, any(map(self._last, _LISTINGS)))
            self.blocks.append(block)
        if "&" in data:
            data = unescape(data)
        if link:
            block.linked += len(data.strip())
        else:
            block.loose.append(len(block.pieces))
        block.pieces.append(data)


_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)]*\Z")


@dataclass(frozen=True)
class Rules:
    """``short``: characters below which a block is not decided by its words; ``long``: from
    which enough stop words make it good; ``stop_low``, ``stop_high``: shares of stop words."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.3
    link_density: float = 0.4


def _stops(text: str) -> float:
    """The share of stop words."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))


def _sentence_around_links(block: Block, text: str) -> bool:
    """Whether the text ends like a sentence and has a word outside its links."""
    if not _SENTENCE_END.search(text):
        return False
    return any(_WORD.search(block.pieces[i]) for i in block.loose)


def _first_labels(found: list[tuple[Block, str]], rules: Rules) -> list[bool | None]:
    """If no block of the page has enough stop words, as in a language that they do not cover, those left for
    their words are good."""
    labels: list[bool | None] = []
    worded: list[tuple[int, float]] = []
    for i, (block, text) in enumerate(found):
        if block.boilerplate:
            labels.append(False)
        elif block.linked > rules.link_density * len(text):
            sentence = block.region and not block.level and _sentence_around_links(block, text)
            labels.append(None if sentence else False)
        elif "©" in text and len(text) < rules.long and not block.region:
            labels.append(False)
        elif block.level:
            prose = len(text) >= rules.long and _stops(text) >= rules.stop_high
            labels.append(None if prose else False)
        else:
            labels.append(None)
            if len(text) >= rules.short:
                worded.append((i, _stops(text)))
    covered = any(stops >= rules.stop_low for _, stops in worded)
    for i, stops in worded:
        block, text = found[i]
        if not covered or stops >= rules.stop_high or (stops >= rules.stop_low and len(text) >= rules.long):
            labels[i] = True
        elif stops < rules.stop_low and not block.region and not block.listing:
            labels[i] = False
    return labels


def _second_labels(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided block of their region; the earlier one
    of two as near, and good if there is none.  Boilerplate by place or name decides nothing
    about an article around it."""
    out: list[bool] = [bool(x) for x in labels]
    by_region: dict[int, list[int]] = {}
    for i, block in enumerate(blocks):
        if not (block.region and block.level and labels[i] is False):
            by_region.setdefault(block.region, []).append(i)
    for members in by_region.values():
        near: dict[int, tuple[int, bool]] = {}
        for order in (members, members[::-1]):
            seen = None
            for place, i in enumerate(order):
                if labels[i] is not None:
                    seen = (place, labels[i])
                elif seen is not None and (i not in near or place - seen[0] < near[i][0]):
                    near[i] = (place - seen[0], seen[1])
        for i in members:
            if labels[i] is None:
                out[i] = near[i][1] if i in near else True
    return out


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    """The page's main text: good blocks in order, white space folded, joined by one space."""
    if not html:
        return ""
    found = [(b, " ".join("".join(b.pieces).split())) for b in _Page(html).blocks]
    found = [(b, t) for b, t in found if t]
    blocks = [b for b, _ in found]
    good = _second_labels(blocks, _first_labels(found, rules))
    return " ".join(t for (_, t), keep in zip(found, good) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rules: Rules = Rules(),
              keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, text`` of every page, then the columns named in ``keep``."""
    given = pages.select(col(id_col).alias("id"), col(html_col).alias("text"),
                         F.struct(*[col(c) for c in keep] or [F.lit(None).alias("none")]).alias("row"))
    schema = StructType().add(given.schema["id"]).add("text", StringType()).add(given.schema["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py(), rules) for h in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], names=schema.names)

    found = given.mapInArrow(run, schema)
    return found.select("id", "text", "row.*") if keep else found.drop("row")
