"""Main text of HTML pages by two passes of block rules.

The page is cut into blocks at block elements. Each block has its length, the share of its characters in links and the
share of its words that are stop words (of English, German, French or Spanish, whichever fits best), and its place: the
elements around it, which count by tag, role and the words of class and id.

Pass 1 adds these up to a score. Long blocks with many stop words gain, long ones with few and blocks of links lose;
elements for boilerplate (nav, footer, aside, ...) and boxes that their names call so (`comment-list`, `site-footer`) lose
more than words can make up for. A name in which such a word only qualifies another (`social-science`) counts less, one
that describes a layout (`with-sidebar`) nothing. A named box or a form that frames the article, the main element or the
page's heading together with running text is the page's frame, and its name counts nothing. Standing in an article raises
a block's score, and standing outside lowers it, if articles hold the page's running text. Scores far enough from zero
make a block good or bad; the others, which are short as a rule, are undecided.

Pass 2 gives each undecided block the label of its nearest decided neighbours: good if both sides are good, else that of
the nearer one; a block as long as a sentence is good unless both sides are bad. With no decided block on the page, blocks
outside of boilerplate are good.

Character references are decoded, white space in a block becomes one space, blocks are joined by two line feeds.
Null and empty pages have empty text. Rows are judged alone, so repeated rows and null or repeated ids change nothing; an
empty table stays empty. Only the named columns are read; a name that is to be kept and written twice is refused.
Unclosed and stray tags are tolerated: an end tag closes the nearest open element of its name, if there is one. Content
of buttons, svg, video and the like is left out only up to their own end tag; if that is missing, nothing is. The time is
in proportion to the page's length, whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text_batches

#: Common words of four languages, for stop-word density.
STOP = [
    frozenset("the of and a to in is it that for on was with as be at by this are or an from but not have has had his her they you we which one all would there their what so if about who get".split()),
    frozenset("der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis".split()),
    frozenset("le la les de des du un une et à en dans que qui pour pas sur est au ce il elle par plus avec se son sa ses ne mais on ou nous vous leur aux cette ces été sont".split()),
    frozenset("el la los las de del un una y a en que por con para es se no lo su al como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()),
]
#: Elements that break blocks.
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content; those whose content is no markup and runs to the end of the page if need be; those
#: whose content is not text of the page, as far as their own end tag; of the latter, those that end before another of their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
UNSEEN = frozenset("noscript template select svg iframe object canvas audio video button annotation annotation-xml".split())
ALONE = frozenset("button select".split())
#: Elements that end where another of their kind follows in the same parent.
ENDED = frozenset("p li a option".split())
#: Elements and roles for boilerplate, words of a class or id that name boilerplate, words that say nothing beside
#: them, words with which a name describes a layout, words that name the page's own text.
FURNITURE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies disclaimer discussion disqus feedback footer gdpr login masthead menu menus modal nav navbar navigation
    newsletter notice notices notification pager pagination paywall popup promo promotion recommended related replies reply
    respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar widget
    widgets""".split()
)
PLAIN = frozenset(
    """area article articles bar block body bottom box buttons button col column container content entry fixed form group icons
    inner item items left link links list main message outer overlay page panel post posts reader readers right row section
    site slot social stories story text thread to top unit user view wrap wrapper""".split()
)
LAYOUT = frozenset("with has no without is hide hides show shows".split())
OWN = frozenset("article body content entry main markdown post prose story text".split())
SHORT, LONG, LINKED, FEW, MANY = 60, 100, 0.35, 0.08, 0.2
#: Points of pass 1: from GOOD on a block is good, up to BAD it is bad.
GOOD, BAD = 1.5, -1.5
NAMED, HINTED, PLACED, OUTSIDE, HEARTY, LISTED, ALL_LINKS, SOME_LINKS = -8.0, -1.0, 3.0, -4.0, 2.0, -2.0, -4.0, -1.5

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOPS = re.compile(r"""=\s*["']|>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_UNSEEN = re.compile(rf"<(?:{'|'.join(UNSEEN)})(?=[\s/>])", re.I)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def named(value: str) -> float:
    """What the words of a class or id say against a box; above zero if they name the page's own text."""
    worst, own = 0.0, False
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        marks = [w in MARKS for w in words]
        if not any(marks):
            own = own or bool(words) and words[-1] in OWN
        elif words[0] not in LAYOUT:
            whole = marks[-1] or all(m or w in PLAIN for m, w in zip(marks, words, strict=True))
            worst = min(worst, NAMED if whole else HINTED)
    return worst or float(own)


class Tags:
    """Reads a page tag by tag; what doesn't end is found out once, so that no page takes more than linear time."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """The end of a tag whose attributes begin at `at`: the next > outside of quoted values, or any; -1 if there is none."""
        page, last, begin, seen = self.page, self.last, at, []
        while at <= last[">"] and at not in self.dead:
            seen.append(at)
            m = _STOPS.search(page, at)
            quote = page[m.end() - 1]
            if quote == ">":
                return m.end()
            if m.end() > last[quote]:
                break
            at = page.find(quote, m.end()) + 1
        self.dead.update(seen)
        return page.find(">", begin) + 1 if begin <= last[">"] else -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(begin, end, tag, whether it is an end tag, attributes) of tags, and texts as (begin, end, "", False, text).

        Comments and what RAW elements hold are left out.
        """
        page, at, foreign, n = self.page, 0, 0, len(self.page)
        while at < n:
            if page[at] != "<":
                end = page.find("<", at)
                end = n if end < 0 else end
                yield at, end, "", False, page[at:end]
                at = end
                continue
            m = _NAME.match(page, at + 1)
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if m is None and page[at + 1 : at + 2] in ("!", "?") and at <= self.last[">"]:
                at = page.find(">", at) + 1
                continue
            end = self.end(m.end()) if m else -1
            if end < 0:  # no tag
                yield at, at + 1, "", False, "<"
                at += 1
                continue
            tag, attrs = m[2].lower(), page[m.end() : end - 1]
            yield at, end, tag, bool(m[1]), attrs
            at, closed = end, attrs.endswith("/")
            if tag in ("svg", "math") and not closed:
                foreign = max(0, foreign + (-1 if m[1] else 1))
            elif tag in RAW and not m[1] and not (foreign and closed):  # only within svg and math a slash closes these
                found = _RAW_END[tag].search(page, at)
                end = page.find(">", found.end()) if found else -1
                at = n if end < 0 else end + 1


class Open:
    """The stack of open elements, with the places of each name, so that an end tag finds its element at once."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, value: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, value))

    def pop(self, tag: str) -> tuple[int, list[str]]:
        """Closes the nearest open element of that name and all within it: its value, -1 if there is none, and the names closed."""
        places = self.places.get(tag)
        if not places:
            return -1, []
        value, names = self.stack[places[-1]][1], []
        while len(self.stack) > (places[-1] if places else -1) >= 0:
            names.append(self.stack.pop()[0])
            self.places[names[-1]].pop()
            if names[-1] == tag:
                break
        return value, names

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""


def unseen(page: str) -> dict[int, int]:
    """Where UNSEEN elements begin and where their own end tags end; without one an element hides nothing."""
    out: dict[int, int] = {}
    if not _UNSEEN.search(page):
        return out
    stack = Open()
    for begin, end, tag, closing, attrs in Tags(page):
        if not tag or tag in RAW or tag in VOID:
            continue
        if closing:
            at, _ = stack.pop(tag)
            if at >= 0 and tag in UNSEEN:
                out[at] = end
        elif not attrs.endswith("/"):
            if tag in ENDED and stack.top() == tag or tag in ALONE:
                stack.pop(tag)
            stack.push(tag, begin)
    return out


class Element:
    """An element's parent, what its tag and its names say for or against it, and what it frames."""

    __slots__ = ("parent", "tag", "names", "article", "frames", "running", "points")

    def __init__(self, parent: Element | None, tag: str, attrs: str):
        self.parent, self.article = parent, tag in ("article", "main") or parent is not None and parent.article
        self.frames = self.running = False
        self.tag = NAMED if tag in FURNITURE or tag == "header" and not self.article else 0.0
        self.names = NAMED if tag == "form" else 0.0
        if attrs and tag not in ("html", "body", "main", "article"):
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                    self.tag = 4 * NAMED
                elif name == "role" and value.lower() in ROLES:
                    self.names += NAMED
                elif name in ("class", "id"):
                    self.names += named(value)

    def up(self, mark: str) -> None:
        """Marks this and all that encloses it; what is marked already ends the way."""
        at: Element | None = self
        while at is not None and not getattr(at, mark):
            setattr(at, mark, True)
            at = at.parent


class Block:
    __slots__ = ("parts", "linked", "place", "item", "text", "density")

    def __init__(self, place: Element, item: bool):
        self.parts: list[str] = []
        self.linked, self.place, self.item, self.text, self.density = 0, place, item, "", 0.0


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks of text in order, and its elements, outer ones first."""
    out: list[Block] = []
    elements = [Element(None, "", "")]
    stack, links, items, place = Open(), 0, 0, elements[0]
    now: Block | None = None
    hidden, until = unseen(page), 0
    for begin, _, tag, closing, rest in Tags(page):
        until = max(until, hidden.get(begin, 0))
        if begin < until:
            continue
        if not tag:
            if now is None:
                now = Block(place, items > 0)
                out.append(now)
            text = html.unescape(rest) if "&" in rest else rest
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())
            continue
        if tag in RAW:
            continue
        if tag == "br":
            if now:
                now.parts.append(" ")
            continue
        if tag in BREAKS:
            now = None
        if closing or tag in ENDED and stack.top() == tag:
            for name in stack.pop(tag)[1]:
                links -= name == "a"
                items -= name == "li"
            place = elements[stack.stack[-1][1]] if stack.stack else elements[0]
        if not closing and tag not in VOID and not rest.endswith("/"):
            place = Element(place, tag, rest)
            stack.push(tag, len(elements))
            elements.append(place)
            if tag in ("article", "main", "h1"):
                place.up("frames")
            links += tag == "a"
            items += tag == "li"
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        b.parts = []
        b.density = density(b.text.split())
        if running(b):
            b.place.up("running")
    return [b for b in out if b.text], elements


def density(words: list[str]) -> float:
    """The share of stop words, in the language that has most."""
    lower = [w.strip(".,;:!?\"'()").lower() for w in words]
    return max(sum(map(s.__contains__, lower)) for s in STOP) / len(words) if words else 0.0


def running(b: Block) -> bool:
    """Running text: a long block of many stop words that isn't made of links."""
    return len(b.text) >= LONG and b.density >= MANY and b.linked <= LINKED * len(b.text)


def score(b: Block, inside: float, outside: float) -> float:
    """Pass 1: the points of a block."""
    share = b.linked / len(b.text)
    points = b.place.points + (inside if b.place.article else outside)
    if len(b.text) >= LONG:
        points += HEARTY if b.density >= MANY else HEARTY / 2 if b.density >= FEW else -HEARTY * (share > 0)
    elif len(b.text) >= SHORT and b.density >= FEW:
        points += HEARTY / 2
    if share > 0.8:
        return points + ALL_LINKS + LISTED * b.item
    return points + SOME_LINKS * (share > LINKED)


def label(points: float) -> str:
    """good, bad, near (undecided, but rather good) or short (undecided)."""
    return "good" if points >= GOOD else "bad" if points <= BAD else "near" if points > 0 else "short"


def settled(labels: list[str], default: list[str]) -> list[str]:
    """Pass 2: undecided blocks take the label of their nearest decided neighbours."""
    firm = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    before: list[int] = [-1] * len(labels)
    last = -1
    for i, x in enumerate(labels):
        before[i] = last
        last = i if x in ("good", "bad") else last
    after: list[int] = [-1] * len(labels)
    last = -1
    for i in range(len(labels) - 1, -1, -1):
        after[i] = last
        last = i if labels[i] in ("good", "bad") else last
    if not firm:
        return default
    out = list(labels)
    for i, x in enumerate(labels):
        if x in ("good", "bad"):
            continue
        a, b = before[i], after[i]
        sides = {labels[j] for j in (a, b) if j >= 0}
        if x == "near":  # as long as a sentence: good unless both sides are bad
            out[i] = "bad" if sides == {"bad"} and a >= 0 and b >= 0 else "good"
        elif len(sides) == 1:
            out[i] = sides.pop()
        else:
            out[i] = labels[a] if i - a <= b - i else labels[b]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, elements = blocks(page)
    for e in elements:  # outer ones come first
        above = e.parent.points if e.parent else 0.0
        frame = e.frames and e.running  # its names are those of the page, not of a box
        e.points = above + e.tag + (max(e.names, 0.0) if frame else e.names)
        if e.parent:
            e.points = min(e.points, above + 1) if above < 0 else min(e.points, 1.0)
    total = sum(len(b.text) for b in found if running(b) and b.place.points > BAD)
    held = sum(len(b.text) for b in found if running(b) and b.place.points > BAD and b.place.article)
    some = any(b.place.article and b.place.points > BAD for b in found)
    inside = PLACED if some and 3 * held >= total else 0.0
    outside = OUTSIDE if some and 2 * held >= total else 0.0
    points = [score(b, inside, outside) for b in found]
    default = ["good" if b.place.points > BAD and (b.place.article or not outside) else "bad" for b in found]
    kept = settled([label(p) for p in points], default)
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k == "good")


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text") -> DataFrame:
    """The columns in keep and the main text of each whole page; no shuffle."""
    if text_col in keep or len(set(keep)) < len(keep):
        raise ValueError("a column can't be kept twice or be kept and written")
    whole_text_batches(df.sparkSession)
    page = "html"
    while page in keep:
        page += "_"
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias(page))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) for x in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())], names=[*keep, text_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{text_col}` string"])
    return rows.mapInArrow(run, schema)
