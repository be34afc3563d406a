"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; scripts, styles, comments and what is boilerplate by tag, role
or state (menus, footers, asides, dialogs, hidden elements) yield none.  A class or id word such as
``sidebar``, or a form, is evidence only, as page layouts carry such words on their outermost elements: a
doubtful container goes if there is prose outside.  It stays if it holds most of the page's prose
(at least as much as is outside where the word has a qualifier, ``has-sidebar``; :data:`HELD` times as
much where it stands plainly; everything where it says comments), and what it holds is then asked the same.

First pass, each block alone: a block made of link text or a copyright line is bad; a long one is
good by its share of stop words and bad without them; a short one, or one between, stays open.  Stop
words are those of the list that fits the page best; where none of the four fits (another language or
script), long blocks are good by their length.  Second pass: open blocks take the label of the nearest
decided neighbours; between a good and a bad one, a heading before a good block, or a block with some
stop words, is good.

A marked article (``article``, else ``main``) is a prior, not a verdict, and so is, on a page without one, the
innermost container of nearly all prose, if it has few links: inside one a long block without stop words stays open
instead of bad, and open blocks without decided neighbours are good.  If the article with the most good text
holds at least half of the page's, the rest of the page goes, other articles (teasers, nested ones) too
unless they are about as long; otherwise the rules alone decide.

Defined cases: null and empty html, and pages without text, give the empty text; unclosed, mis-nested or
truncated mark-up is read as far as it goes, in time that grows with the page's length; white space inside
a block (line breaks and no-break spaces too) becomes one space.  Rows that repeat get the same text; very
long pages are read whole; an empty table gives no rows.  Extra columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.llm import common

#: Characters from which a block is decided alone, and from which stop words make it good outright.
SHORT, LONG = 70, 200
#: Shares of stop words for an open and for a good block, and of link characters for a bad one.
STOP_LOW, STOP_HIGH, LINKS = 0.10, 0.20, 0.5
#: A plainly doubtful container stays if it holds so many times the prose outside.
HELD = 4
#: Share of a page's prose, at least, and of link characters, at most, of the container of its content.
NEARLY_ALL, CONTENT_LINKS = 0.85, 0.1

# Stop words, tags and container words.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do",
    "fr": "de la le et les des en un une du que est dans qui par pour au sur pas plus ne se ce il sont avec son aux mais comme ou si leur elle deux tout nous sa fait cette ont même ces ses où était aussi être très sans bien lui entre peut",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto",
}
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe object svg canvas select math audio video".split())
DROPPED_TAGS = frozenset("nav footer aside head button dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
DOUBTFUL_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead respond share sharing social related recommended recommendations cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay widget toolbar pagination pager copyright login signin signup searchform hidden".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies".split())
QUALIFIERS = frozenset("has no not with without is are show allow enable enabled disabled open closed on off overflow board layout".split())
CONTENT_WORDS = frozenset("article post entry hentry content story main page site wrap wrapper container".split())
CONTAINERS = frozenset("div section td center form fieldset details article main".split())

_STOPS = [frozenset(words.split()) for words in STOP_WORDS.values()]
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+[^>]*)>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADING = re.compile(r"h[1-6]\Z")


@dataclass(slots=True)
class Block:
    """One block: its text, how many of its characters are link text, its tag, the numbers of the
    ``article`` and of the ``main`` that it is in (0: none), the element around it, and whether that is in the
    innermost container of nearly all prose."""

    text: str
    linked: int
    tag: str
    article: int = 0
    main: int = 0
    node: int = 0
    inner: bool = False
    label: str = ""

    @property
    def inside(self) -> bool:
        return bool(self.article or self.main or self.inner)


#: How doubtful a container is.
_CLEAR, _QUALIFIED, _PLAIN, _COMMENTS = range(4)


def _dropped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by itself; inside: of a marked article, which may have its own header."""
    if tag in DROPPED_TAGS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _attributes(attributes):
        if name == "role" and value.lower() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _attributes(attributes: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)]


def _doubt(tag: str, attributes: str, inside: bool) -> int:
    """How doubtful the class and id words of an element make it, or that it is a form."""
    worst = _QUALIFIED if tag == "form" else _CLEAR
    if not attributes or tag in ("html", "body", "article", "main"):
        return worst
    for name, value in _attributes(attributes):
        if name not in ("class", "id") and not (name == "role" and value.lower() == "form"):
            continue
        words = [{w.lower() for w in _PARTS.findall(token)} for token in value.split()]
        content = any(w & CONTENT_WORDS and not w & (DOUBTFUL_WORDS | COMMENT_WORDS) for w in words)
        for w in words:
            if w & COMMENT_WORDS:
                worst = max(worst, _QUALIFIED if w & QUALIFIERS else _COMMENTS)
            elif w & DOUBTFUL_WORDS or "form" in w and tag != "form" or "header" in w and not inside:
                worst = max(worst, _QUALIFIED if content or w & QUALIFIERS else _PLAIN)
    return worst


#: Tags whose opening ends an open one of the group, up to the tags that hold them.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDERS = frozenset("ul ol menu dl table select".split())


class Elements:
    """The block-level elements of a page as a tree; 0 is the page.  Parents have smaller numbers."""

    def __init__(self) -> None:
        self.parents, self.doubts, self.containers = [0], [_CLEAR], [False]

    def add(self, parent: int, tag: str, doubt: int) -> int:
        self.parents.append(parent)
        self.doubts.append(doubt)
        self.containers.append(tag in CONTAINERS)
        return len(self.parents) - 1


class _Open:
    """The open elements, with the places of each name, so that a closing tag costs what it closes."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []  # name, dropped, number of the article or main (or 0)
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []  # places of block-level elements
        self.dropped = 0
        self.regions: dict[str, list[int]] = {"article": [], "main": []}
        self.made = 0
        self.nodes = Elements()
        self.node = [0]

    def push(self, name: str, drops: bool, doubt: int) -> None:
        at = len(self.stack)
        region = 0
        if name in self.regions and not drops and not self.dropped:
            self.made += 1
            region = self.made
            self.regions[name].append(region)
        self.stack.append((name, drops, region))
        self.places.setdefault(name, []).append(at)
        if name in BLOCK_TAGS:
            self.walls.append(at)
            self.node.append(self.nodes.add(self.node[-1], name, doubt))
        self.dropped += drops

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, drops, region = self.stack.pop()
            self.places[name].pop()
            if name in BLOCK_TAGS:
                self.walls.pop()
                self.node.pop()
            self.dropped -= drops
            if region:
                self.regions[name].pop()

    def close(self, name: str) -> None:
        """A closing tag: it ends the nearest element of its name and what is open in it; that of an
        inline element ends nothing beyond the block that it stands in."""
        places = self.places.get(name)
        if places and (name in BLOCK_TAGS or not self.walls or self.walls[-1] < places[-1]):
            self._pop_to(places[-1])

    def before(self, name: str) -> None:
        """What the opening of a block-level element ends: an open paragraph, and a sibling."""
        if self.walls and self.stack[self.walls[-1]][0] == "p":
            self._pop_to(self.walls[-1])
        holder = max((self.places[h][-1] for h in _HOLDERS if self.places.get(h)), default=-1)
        ends = [self.places[x][-1] for x in _SIBLINGS.get(name, ()) if self.places.get(x) and self.places[x][-1] > holder]
        if ends:
            self._pop_to(min(ends))

    def region(self, name: str) -> int:
        return self.regions[name][-1] if self.regions[name] else 0


def blocks(html: str) -> tuple[list[Block], Elements]:
    """The blocks of a page outside boilerplate elements, in page order, and the elements around them."""
    found: list[Block] = []
    text: list[str] = []
    linked = 0
    tag_now = ""
    open_ = _Open()

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                found.append(Block(joined, linked, tag_now, open_.region("article"), open_.region("main"), open_.node[-1]))
            text.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not open_.dropped:
            s = unescape(raw) if "&" in raw else raw
            text.append(s)
            if open_.places.get("a"):
                linked += len(s.strip())

    at = 0
    while m := _TAG.search(html, at):
        take(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                take(m[0][9:-3])
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if not closing and tag in RAW_TAGS:
            if not attributes.endswith("/"):
                end = _RAW_ENDS[tag].search(html, at)
                at = end.end() if end else len(html)
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a" and not closing and not open_.dropped:
            open_.close(tag)  # links are not nested
        block = tag in BLOCK_TAGS
        if block:
            flush()
            tag_now = "" if closing else tag
        if tag in VOID_TAGS:
            continue
        if closing:
            open_.close(tag)
        else:
            if block:
                open_.before(tag)
            if not attributes.endswith("/"):
                inside = bool(open_.region("article") or open_.region("main"))
                doubt = _doubt(tag, attributes, inside)
                open_.push(tag, _dropped(tag, attributes, inside) or not block and doubt > _QUALIFIED, doubt)
    take(html[at:])
    flush()
    return found, open_.nodes


_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW_TAGS}


def stop_words_of(found: list[Block]) -> frozenset[str] | None:
    """The list of stop words that fits the blocks best; None if fewer than :data:`STOP_LOW` of their
    words are in any."""
    words = [w for b in found if b.linked <= LINKS * len(b.text) for w in _WORD.findall(b.text.lower())]
    shares = [sum(w in stops for w in words) for stops in _STOPS]
    best = max(range(len(_STOPS)), key=shares.__getitem__)
    return _STOPS[best] if shares[best] >= STOP_LOW * len(words) else None


def _stop_share(b: Block, stops: frozenset[str]) -> float:
    words = _WORD.findall(b.text.lower())
    return sum(w in stops for w in words) / len(words) if words else 0.0


def prose(b: Block, stops: frozenset[str] | None) -> int:
    """Characters of a block that may be running text."""
    n = len(b.text)
    if b.linked > LINKS * n:
        return 0
    return n if b.article or b.main or n >= SHORT and (stops is None or _stop_share(b, stops) >= STOP_LOW) else 0


def undoubted(found: list[Block], nodes: Elements) -> list[Block]:
    """The blocks outside doubtful containers, and inside those that hold most of the page's prose."""
    count = len(nodes.parents)
    around = [0] * count  # innermost doubtful element, itself included
    for i in range(1, count):
        around[i] = i if nodes.doubts[i] else around[nodes.parents[i]]
    stops = stop_words_of(found)
    direct, unlinked = [0] * count, [0] * count
    for b in found:
        direct[around[b.node]] += prose(b, stops)
        unlinked[around[b.node]] += len(b.text) - b.linked
    total, held = direct[:], {}
    for i in range(count - 1, 0, -1):
        if nodes.doubts[i]:
            outer = around[nodes.parents[i]]
            held.setdefault(outer, []).append(i)
            total[outer] += total[i]
    # Ever more is outside, so a container that doesn't hold enough now never will.
    outside, words, cleared, waiting = direct[0], unlinked[0], {0}, []

    def ask(of: int) -> None:
        for i in held.get(of, ()):
            doubt = nodes.doubts[i]
            heapq.heappush(waiting, (doubt == _COMMENTS, -total[i] * (HELD if doubt == _QUALIFIED else 1), doubt, i))

    ask(0)
    while waiting:
        _, _, doubt, i = heapq.heappop(waiting)
        most = total[i] >= outside if doubt == _QUALIFIED else total[i] > HELD * outside if doubt == _PLAIN else not words
        if total[i] and most:
            cleared.add(i)
            outside += direct[i]
            words += unlinked[i]
            ask(i)
    return [b for b in found if around[b.node] in cleared]


def mark_container(found: list[Block], nodes: Elements) -> None:
    """On a page without a marked article: mark the blocks in the innermost container of nearly all prose."""
    if any(b.article or b.main for b in found):
        return
    stops = stop_words_of(found)
    total, linked, chars = ([0] * len(nodes.parents) for _ in range(3))
    for b in found:
        total[b.node] += prose(b, stops)
        linked[b.node] += b.linked
        chars[b.node] += len(b.text)
    for sums in (total, linked, chars):
        for i in range(len(sums) - 1, 0, -1):
            sums[nodes.parents[i]] += sums[i]
    best = max((i for i, n in enumerate(total) if n and nodes.containers[i] and n >= NEARLY_ALL * total[0]), default=0)
    if best and linked[best] <= CONTENT_LINKS * chars[best]:
        within = [False] * len(total)
        for i in range(best, len(total)):
            within[i] = i == best or within[nodes.parents[i]]
        for b in found:
            b.inner = within[b.node]


def first_pass(b: Block, stops: frozenset[str] | None) -> str:
    """The label of a block by itself: good, bad, near (long, with some stop words), open or short."""
    n = len(b.text)
    if b.linked > LINKS * n or not (b.article or b.main) and b.text.startswith(("©", "Copyright")):
        return "bad"
    if n < SHORT:
        return "short"
    if stops is None:
        return "good"
    share = _stop_share(b, stops)
    if share >= STOP_HIGH and (b.inside or n > LONG):
        return "good"
    return "near" if share >= STOP_LOW else "open" if b.inside else "bad"


def classify(found: list[Block]) -> list[Block]:
    """Label every block ``good`` or ``bad``, in two passes."""
    stops = stop_words_of(found)
    for b in found:
        b.label = first_pass(b, stops)
    before, last = [], ""
    for b in found:
        before.append(last)
        last = b.label if b.label in ("good", "bad") else last
    after, last = [], ""
    for b in reversed(found):
        after.append(last)
        last = b.label if b.label in ("good", "bad") else last
    for b, x, y in zip(found, before, reversed(after), strict=True):
        if b.label in ("good", "bad"):
            continue
        inside, around = b.inside, {x, y} - {""}
        if len(around) == 1:
            b.label = around.pop()
        elif around:
            b.label = "good" if b.label == "near" or y == "good" and _HEADING.match(b.tag) or inside else "bad"
        else:
            b.label = "good" if inside or b.label == "near" else "bad"
    return found


def main_blocks(found: list[Block]) -> list[Block]:
    """The good blocks of the main article, or of the page where no marked one holds half of them."""
    good = [b for b in classify(found) if b.label == "good"]
    total = sum(len(b.text) for b in good)
    for region in ("article", "main"):
        sizes: dict[int, int] = {}
        for b in good:
            if at := getattr(b, region):
                sizes[at] = sizes.get(at, 0) + len(b.text)
        most = max(sizes.values(), default=0)
        if most and 2 * most >= total:
            return [b for b in good if (at := getattr(b, region)) and 2 * sizes[at] >= most]
    return good


def main_text(html: str | None) -> str:
    """The text of the main blocks of a page, joined by empty lines."""
    found, nodes = blocks(html or "")
    found = undoubted(found, nodes)
    mark_container(found, nodes)
    return "\n\n".join(b.text for b in main_blocks(found))


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of ``pages`` with the main text of each page as ``text``; no shuffle."""
    kinds = [pages.schema[c].dataType.simpleString() for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(h) for h in batch.column(len(keep)).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*(f"k{i}" for i in range(len(keep))), "text"])

    rows = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_column).alias("text"))
    out = common.map_arrow(rows, run, ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "text string"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(common.spread(common.table(spark, sf_dir, "pages"))).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op2_html_extract": op2_html_extract}
