"""Main-text extraction from web pages: parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams events. Block-level tags end a line; a line knows its text, how many tags came
with it, the element it stands in, and whether it is a link for the most part. Elements that are page furniture by name,
role or class are flagged, and what stands in them goes. Over the other lines' text-to-tag ratios runs a Gaussian;
two-means clustering of the smoothed ratios sets the threshold over which lines are content. Content regions are the
innermost container that holds the selected lines, and all articles that hold some: they stay whole. Outside them stay
selected lines, and below the threshold what is written as a paragraph and is no link, so that leads and short closing
paragraphs aren't lost; headings, where what follows them stays; and bare text of containers right before the region
and beside it. Links and other bare text of wrappers go there. Without such a container all but links below the threshold stays.
A page without a level-one heading in what stays gets the one of its header back, if that is no link and the title begins with it.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import tidy
from tessera.llm.storage import arrow_batches

SIGMA, RADIUS = 1.0, 3
#: Share of the selected text that a container must hold to be the region, for article or main elements and for others.
ARTICLE_SHARE, CONTAINER_SHARE = 0.5, 0.8
# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template svg iframe object canvas annotation annotation-xml".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer aside form button select textarea option dialog menu label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main nav aside footer form td body blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words that name furniture, words that may stand beside them in one class or id, and what names parts of a text.
MARKS = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu\w*|nav(?:bar|igation|s)?|breadcrumbs?|footer|header|masthead|comments?|comment(?:list|form|box|area|thread)s?|replies|disqus|ccpa|adsense|adsbygoogle|cookies?|consent|gdpr|notice|alert|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|popup|modal|overlay|widgets?|toolbar|pagination|pager|skip|hidden",
    re.IGNORECASE,
)
BESIDE = frozenset("site global top bottom left right primary secondary main sub the wp js wrap wrapper container inner outer box bar block section area list item items link links button buttons icons posts articles stories form bottom content to text law info policy message warning accept settings slot unit zone space label placement holder placeholder google thread respond reply title user users fb facebook window col body author meta view views count new all latest recent more reader readers guest side".split())
#: Marks that decide alone, whatever stands beside them, and words that turn a mark into a statement about the layout.
STRONG = re.compile(r"comments|commentlist|sidebar|disqus|newsletter|advert(?:s|isements?|ising)?|adsbygoogle|breadcrumbs?|pagination|gdpr|ccpa", re.IGNORECASE)
LAYOUT = frozenset("has have no not non with without is hide show enabled disabled open closed".split())
#: The first word of names that consent windows bear, with the second.
CONSENT = frozenset("window banner bar revoke message dialog".split())
PARTS = frozenset("entry post article page story content".split())
#: Marks that beside one of PARTS, or within an article, belong to the text.
OF_TEXT = frozenset("header banner masthead notice alert hidden overlay".split())
#: Furniture by its element name that can also wrap a whole page.
SOFT = frozenset("form fieldset label".split())
#: White space of HTML and of Unicode alike becomes one space.
SPACE = re.compile(r"\s+")
#: A tag or comment that the page ends in.
UNENDED = re.compile(r"<[A-Za-z/!?]")
#: How the line of a page begins that names its owner.
RIGHTS = re.compile(r"(?:copyright\b|\(c\)|©|all rights reserved)", re.IGNORECASE)
#: Elements whose own text, outside the content regions, has to be selected by its ratio to stay.
BARE = frozenset("div section td span body".split()) | {""}


def marked(names: str, in_article: bool) -> bool:
    """Whether one of the classes or ids names furniture as a whole: has-sidebar, overflow-hidden or entry-header don't."""
    for name in names.split():
        words = [w for w in re.split(r"[-_]+", name.lower().replace("side-bar", "sidebar").replace("side_bar", "sidebar")) if w and not w.isdigit()]
        if len(words) > 1 and words[0] == "cc" and words[1] in CONSENT:
            return True
        marks = [w for w in words if MARKS.fullmatch(w)]
        if not LAYOUT & set(words) and any(STRONG.fullmatch(w) for w in marks):
            return True
        if not marks or any(w not in BESIDE and w not in PARTS and not MARKS.fullmatch(w) for w in words):
            continue
        if not (set(marks) <= OF_TEXT and (in_article and set(marks) <= {"header"} or PARTS & set(words))) and not (words != marks and marks == ["hidden"]):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of a page. Elements are numbered from 1 in page order, so a number is above those of what it stands in.

    Every step takes time in proportion to what it opens or closes, however deep elements stand.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: name, number, silent, link, within article or main
        self.open: list[tuple[str, int, bool, bool, bool]] = []
        self.places: dict[str, list[int]] = {}  # by name where it stands in open
        self.scopes: list[int] = []
        #: by number: name, nearest container, nearest furniture; the latter two can be the element itself, 0 for none
        self.name, self.box, self.dull = [""], [0], [0]
        self.above: dict[int, int] = {}  # by container or furniture: the nearest of its kind around it
        self.around: dict[int, int] = {}
        self.soft: dict[int, bool] = {}  # by element that is furniture: whether it can hold the text all the same
        self.holders: list[tuple[int, int]] = []  # articles and mains, and the furniture around
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, element, link
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.title: list[str] = []

    def _end_head(self) -> None:
        """A head whose end tag is left out ends where the body's content begins."""
        if self.places.get("head"):
            self._close(self.places["head"][-1])

    def _end_line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, max(1, self.tags), self.open[-1][1] if self.open else 0, 2 * self.linked > len(text)))
                self.tags = 0
            self.parts, self.linked = [], 0

    def _close(self, at: int) -> None:
        for k in range(len(self.open) - 1, at - 1, -1):
            self.places[self.open[k][0]].pop()
            if self.scopes and self.scopes[-1] == k:
                self.scopes.pop()
        del self.open[at:]

    def _last(self, names) -> int:
        """Where the innermost open element of such a name stands, -1 if none or if a scope closes it off."""
        at = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        return at if not self.scopes or at >= self.scopes[-1] else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in HEAD and tag != "head":
            self._end_head()
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            elif tag in ("br", "wbr", "img", "input"):
                self.parts.append("\n" if tag == "br" else "")
            return
        if tag in BLOCK:
            self._end_line()
            at = self._last(SIBLINGS.get(tag, set()) | ({"p"} if tag in ENDS_PARAGRAPH else set()))
            if at >= 0:
                self._close(at)
        _, parent, mute, link, in_article = self.open[-1] if self.open else ("", 0, False, False, False)
        hard = tag in FURNITURE and tag not in SOFT or tag == "header" and not in_article
        soft, a = tag in SOFT, dict(attrs)
        if attrs and tag not in ("html", "body"):
            hard = hard or "hidden" in a or a.get("aria-hidden") == "true" or (role := (a.get("role") or "").lower()) in ROLES and not (in_article and role == "alert") or "display:none" in (a.get("style") or "").replace(" ", "").lower()
            soft = soft or tag != "main" and marked(f"{a.get('class') or ''} {a.get('id') or ''}", in_article)
        if hard or soft:
            self._end_line()
        number = len(self.name)
        self.name.append(tag)
        self.box.append(number if tag in CONTAINER else self.box[parent])
        self.dull.append(number if hard or soft else self.dull[parent])
        if tag in CONTAINER:
            self.above[number] = self.box[parent]
        if hard or soft:
            self.soft[number], self.around[number] = not hard, self.dull[parent]
        if tag in ("article", "main"):
            self.holders.append((number, self.dull[parent]))
            in_article = True
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number, mute or tag in SILENT, link and tag not in BLOCK or tag == "a" and bool(a.get("href")), in_article))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.places[tag][-1] if self.places.get(tag) and tag in SCOPES else self._last((tag,))
        if at >= 0:
            if tag in BLOCK or self.open[at][1] in self.soft or any(e[0] in BLOCK for e in self.open[at:]):
                self._end_line()
            self._close(at)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "title" and not self.places.get("svg"):
            self.title.append(data)
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if not (self.open and self.open[-1][2]):
            self.parts.append(data)
            self.linked += len(data) if self.open and self.open[-1][3] else 0

    def _dead(self, gone: set[int]) -> list[bool]:
        """By number: whether the element or one around it is in gone."""
        dead = [False] * len(self.name)
        for e in range(1, len(dead)):
            d = self.dull[e]
            dead[e] = (d in gone or dead[self.around[d]]) if d == e else dead[d]
        return dead

    def furniture(self) -> list[bool]:
        """By number, whether its text goes. No element that holds a main goes, and no soft one that holds an article or most of the text."""
        gone, seen = set(self.soft), {False: set(), True: set()}
        for number, around in self.holders:
            main = self.name[number] == "main"
            while number not in self.soft and around and around not in seen[main]:
                seen[main].add(around)
                if main or self.soft[around]:
                    gone.discard(around)
                around = self.around[around]
        dead = self._dead(gone)
        holds = [False] * len(self.name)
        for e in range(1, len(holds)):
            b = self.box[e]
            holds[e] = b > 0 and (self.name[b] in ("article", "main") or (holds[self.above[b]] if b == e else holds[b]))
        if not any(holds[e] and not dead[e] for _, _, e, _ in self.lines):
            held = self.mass([(self.dull[e], len(text)) for text, _, e, _ in self.lines], self.around)
            total = sum(len(x[0]) for x in self.lines)
            gone -= {e for e in gone if self.soft[e] and 2 * held.get(e, 0) > total}
            dead = self._dead(gone)
        return dead

    def dull_beyond(self, d: int) -> bool:
        """Whether furniture stands within other furniture, or is of a kind that bears no title."""
        a = self.around.get(d, 0)
        return a > 0 and self.name[a] not in ("header", "div")

    @staticmethod
    def mass(own: list[tuple[int, int]], outer: dict[int, int]) -> dict[int, int]:
        """Sizes by element, those of the elements within included; 0 stands for the page."""
        out: dict[int, int] = {}
        for e, size in own:
            out[e] = out.get(e, 0) + size
        for e in sorted(outer, reverse=True):  # numbers grow inwards
            if e in out:
                out[outer[e]] = out.get(outer[e], 0) + out[e]
        return out


def smooth(ratio: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; weights beyond the ends are left out and the rest scaled up."""
    weight = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    full = np.convolve(ratio, weight)[radius : radius + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), weight)[radius : radius + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """Midpoint between the centres of two clusters of the values, by two-means from least and most."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        upper = values > (low + high) / 2
        if not upper.any() or upper.all():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def region(parser: _Lines, chosen: list[int]) -> int:
    """The number of the container that holds the selected lines, 0 for the whole page.

    An article or main with ARTICLE_SHARE of their text is one, the innermost; without it the innermost other container
    with CONTAINER_SHARE.
    """
    mass = parser.mass([(parser.box[parser.lines[k][2]], len(parser.lines[k][0])) for k in chosen], parser.above)
    total = sum(len(parser.lines[k][0]) for k in chosen)
    held = [e for e in sorted(mass) if e and parser.name[e] != "body"]
    articles = [e for e in held if parser.name[e] in ("article", "main") and mass[e] >= ARTICLE_SHARE * total]
    return (articles or [e for e in held if mass[e] >= CONTAINER_SHARE * total] or [0])[-1]


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by a line feed; empty where there is none."""
    if not page:
        return ""
    parser = _Lines()
    parser.feed(page)
    if UNENDED.match(parser.rawdata):
        parser.rawdata = ""  # as browsers do; the parser would look for its end from every later bracket again
    parser.close()
    parser._end_line()
    dead = parser.furniture()
    dull = [dead[e] for _, _, e, _ in parser.lines]
    if all(dull):
        return ""
    plain = np.array([0.0 if d else len(text) / tags for (text, tags, _, _), d in zip(parser.lines, dull, strict=True)])
    ratio = smooth(plain)
    cut = threshold(ratio)
    chosen = [k for k, d in enumerate(dull) if not d and ratio[k] >= cut] or [k for k, d in enumerate(dull) if not d]
    home = region(parser, chosen)
    # other articles that hold selected text are regions as well
    inside = [False] * len(parser.name)
    articles = {e for e, _ in parser.holders}
    filled = parser.mass([(parser.box[parser.lines[k][2]], 1) for k in chosen], parser.above)
    for e in range(1, len(inside)):
        b = parser.box[e]
        inside[e] = b > 0 and (b == home or inside[b] if b != e else b == home or b in articles and b in filled or inside[parser.above[b]])
    first, last = chosen[0], chosen[-1]
    kept, lead = [], []
    for k, (text, _, e, link) in enumerate(parser.lines):
        here = inside[e] or not home and first <= k <= last
        # outside the regions stay what the threshold selects, smoothed or not (bare text by its own ratio alone), and text that is written as a heading or paragraph
        bare = home and (parser.name[e] in BARE or not here and RIGHTS.match(text) is not None)
        kept.append(not dull[k] and (here or (plain[k] if bare else max(ratio[k], plain[k])) >= cut or not link and not bare))
        lead.append(bool(home) and not (kept[k] or dull[k] or link) and parser.box[e] == e and parser.above[e] == parser.above[home])
    follows = title = leads = False
    for k in reversed(range(len(kept))):  # outside them a heading needs what it stands over, and bare text of a wrapper the region right behind it
        e = parser.lines[k][2]
        if home and kept[k] and not inside[e] and parser.name[e] in HEADINGS and max(ratio[k], plain[k]) < cut:
            kept[k] = title if parser.name[e] == "h1" else follows
        kept[k] = kept[k] or lead[k] and leads
        leads = leads if dull[k] else inside[e] or lead[k] and leads
        follows = follows if dull[k] else kept[k]
        title = title if dull[k] or not (kept[k] or parser.lines[k][3]) else kept[k]  # a by-line that goes may stand between a title and its text
    if not any(x and parser.name[parser.lines[k][2]] == "h1" for k, x in enumerate(kept)):
        kept = [x or k == headline(parser, first) for k, x in enumerate(kept)]
    return "\n".join(text for (text, _, _, _), x in zip(parser.lines, kept, strict=True) if x)


def headline(parser: _Lines, before: int) -> int:
    """The line of the page's level-one heading in a header before the text, -1 for none: no link, and what the title begins with if there is a title."""
    title = SPACE.sub(" ", "".join(parser.title)).strip().casefold()
    for k, (text, _, e, link) in enumerate(parser.lines[:before]):
        d = parser.dull[e]
        if parser.name[e] == "h1" and not link and parser.name[d] in ("header", "div") and not parser.dull_beyond(d) and title.startswith(text.casefold() if title else ""):
            return k
    return -1


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null, empty and text-free pages give the empty text.

    Pages of any length are parsed whole. Repeated rows each get a row; other columns of pages are not read.
    """
    arrow_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("h")).mapInArrow(tidy(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
