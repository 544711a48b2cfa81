"""Fields of a place page from its HTML: a declared table of fields, each with its ways in order, run by one engine inside an Arrow function.

A page is flattened once into elements in document order, each knowing which elements and which pieces of visible text lie in it,
so every way is a scan over a list.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.ddl import schema
from placeweave.functions.text import AREA_FORMS

PAGE = schema(
    "name string, closed boolean, rating double, review_count int, address string, area string, phone string, website string, hours map<string,string>, "
    "categories array<string>, reviews array<struct<author:string,rating:int,text:string,date:string>>, images array<struct<url:string,alt:string>>"
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

# What the pages' own labels, attributes and classes look like.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
CLOSED = "Permanently closed"
STARS, NUMBER, BARE_RATING, SOURCE_RATING = r"(?i)\d+\.?\d*\s*stars?", r"(\d+\.?\d*)", r"^(\d\.\d)$", r'"averageRating":\s*(\d+\.?\d*)'
COUNTS = (r"\((\d[\d,]*)\s*(?:reviews?)?\)", r"(?i)(\d[\d,]*)\s+(?:Google\s+)?reviews?")
ADDRESS_LABEL, ADDRESS_TEXT = r"^(?:Address:\s*)?(.*)", r"\d+.+Islamabad|Lahore"
PHONE_ITEM, PHONE_LABEL, PHONE_TEXT = r"^phone:", r"^(?:Phone:\s*)?(.*)", r"(\+92[\s\-]?\d[\d\s\-]{8,}|\b0\d{2,3}[\s\-]?\d{6,8}\b)"
OUTSIDE_LINK, CATEGORY_ACTION = r"^https?://(?![^/]*(?:google|gstatic|ggpht)\.)", r"(?i)category|type"
CARD, CARD_CLASS, CARD_STARS = "data-review-id", r"(?:^|\s)jftiEf(?:\s|$)", r"(?i)(\d+)\s*stars?"
AUTHOR_CLASS, TEXT_CLASS, DATE_CLASS = r"(?i)d4r55|reviewer|author", r"(?i)wiI7pd|review-full-text|MyEned", r"(?i)rsqaWe|dehysf|review-snippet"
PHOTO = re.compile(r"""https://[\w.-]*googleusercontent\.com/(?!a-?/)[\w-]+/[^\s"')]+""")
BACKGROUND, PHOTO_SIZE = r"""url\(["']?([^"')]+)""", r"=(?:w|s)(\d+)"


class Element(NamedTuple):
    tag: str
    attributes: dict[str, str]
    at: int  # its place in the page's elements
    first_piece: int


class Page(HTMLParser):
    """The elements of a page and the pieces of its visible text; ``end`` and ``last`` say where an element's own end."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source, self.elements, self.pieces = source, [], []
        self.end: list[int] = []
        self.last: list[int] = []
        self._open: list[int] = []
        self.feed(source)
        self._leave(0)

    def _enter(self, tag: str, attributes: list[tuple[str, str | None]]) -> int:
        at = len(self.elements)
        self.elements.append(Element(tag, {k: v or "" for k, v in attributes}, at, len(self.pieces)))
        self.end.append(at + 1)
        self.last.append(len(self.pieces))
        return at

    def _leave(self, depth: int) -> None:
        for at in self._open[depth:]:
            self.end[at], self.last[at] = len(self.elements), len(self.pieces)
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        at = self._enter(tag, attrs)
        if tag not in VOID:
            self._open.append(at)

    def handle_startendtag(self, tag, attrs):
        self._enter(tag, attrs)

    def handle_endtag(self, tag):
        depth = next((d for d in range(len(self._open) - 1, -1, -1) if self.elements[self._open[d]].tag == tag), None)
        if depth is not None:
            self._leave(depth)

    def handle_data(self, data):
        if data.strip() and not (self._open and self.elements[self._open[-1]].tag in ("script", "style")):
            self.pieces.append(data.strip())

    def inside(self, e: Element | None) -> list[Element]:
        """The elements below one, or all."""
        return self.elements if e is None else self.elements[e.at + 1 : self.end[e.at]]

    def text(self, e: Element | None = None, between: str = "") -> str:
        return between.join(self.pieces if e is None else self.pieces[e.first_piece : self.last[e.at]])


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[\ue000-\uf8ff]", "", text)).strip()


class Way(NamedTuple):
    """Where a value may stand: in elements of some tags (parted by blanks; any if "") whose attribute holds a pattern; read from an attribute, else from the text.

    ``part`` is searched in what is read, its first group (or all of the match) is the value. A way that ``decides`` ends the search of its field once
    an element fits, whatever it holds; ``long`` bounds what may be read.
    """

    tags: str = ""
    attribute: str = ""
    holds: str = ""
    read: str = ""
    part: str = r"(?s)(.*)"
    decides: bool = False
    between: str = ""
    long: int = 1 << 30

    def elements(self, page: Page, within: Element | None) -> Iterator[Element]:
        tags = self.tags.split()
        for e in page.inside(within):
            if (not tags or e.tag in tags) and (not self.attribute or (self.attribute in e.attributes and re.search(self.holds, e.attributes[self.attribute]))):
                yield e

    def values(self, page: Page, within: Element | None) -> Iterator[str]:
        for e in self.elements(page, within):
            read = e.attributes.get(self.read, "") if self.read else page.text(e, self.between)
            m = re.search(self.part, read) if len(read) < self.long else None
            if m:
                yield m[1] if m.re.groups else m[0]


class Seen(NamedTuple):
    """A pattern in the whole visible text, or in the page's source."""

    part: str
    source: bool = False
    decides: bool = False

    def elements(self, page: Page, within: Element | None) -> Iterator[Element]:
        return iter(())

    def values(self, page: Page, within: Element | None) -> Iterator[str]:
        m = re.search(self.part, page.source if self.source else page.text(within, " "))
        if m:
            yield m[1]


class Field(NamedTuple):
    ways: tuple[Way | Seen, ...]
    clean: Callable[[str], Any] = str
    missing: Any = ""

    def value(self, page: Page, within: Element | None = None) -> Any:
        """The first value that isn't empty, by the ways in order; of a way only its first value counts."""
        for way in self.ways:
            found = next(way.values(page, within), None)
            value = self.missing if found is None else self.clean(found)
            if value or (way.decides and next(way.elements(page, within), None)):
                return value
        return self.missing


def _count(digits: str) -> int:
    return int(digits.replace(",", ""))


#: The plain fields of a page.
FIELDS = {
    "name": Field((Way("h1", decides=True),)),
    "rating": Field((Way(attribute="aria-label", holds=STARS, read="aria-label", part=NUMBER), Way("span", "aria-hidden", "^true$", part=BARE_RATING), Seen(SOURCE_RATING, source=True)), float, 0.0),
    "review_count": Field(tuple(Seen(c) for c in COUNTS), _count, 0),
    "address": Field((Way("button", "data-item-id", "^address$", "aria-label", ADDRESS_LABEL), Way("button", "data-item-id", "^address$", between=" ", decides=True), Way("div span", part=rf"(?s)^(?=.*(?:{ADDRESS_TEXT}))(.*)$", long=150)), squeeze),
    "phone": Field((Way("button", "data-item-id", PHONE_ITEM, "aria-label", PHONE_LABEL), Seen(PHONE_TEXT)), squeeze),
    "website": Field((Way("a", "data-item-id", "^authority$", "href", r"(.+)"), Way("a", "href", OUTSIDE_LINK, "href"))),
}
#: The fields of a review's card.
REVIEW = {
    "author": Field((Way(attribute="class", holds=AUTHOR_CLASS, decides=True),)),
    "rating": Field((Way(attribute="aria-label", holds=CARD_STARS, read="aria-label", part=CARD_STARS),), int, 0),
    "text": Field((Way(attribute="class", holds=TEXT_CLASS, decides=True),)),
    "date": Field((Way(attribute="class", holds=DATE_CLASS, decides=True),)),
}
CATEGORY = Way("button", "jsaction", CATEGORY_ACTION)
WEEK, ROW = Way(attribute="aria-label", holds="|".join(DAYS)), Way("tr")
CARDS = (Way("div", CARD, ""), Way("div", "class", CARD_CLASS))
PHOTOS = (Way("img", "src", "."), Way(attribute="style", holds="background-image"))


def opening_hours(page: Page) -> dict[str, str]:
    """Day to time: of the first label that lists at least three days, else of the tables' rows."""
    for e in WEEK.elements(page, None):
        label = e.attributes["aria-label"]
        items = [item.partition(",") for item in label.split(";")] if sum(label.count(d) > 0 for d in DAYS) >= 3 else []
        week = {day.strip(): squeeze(time.partition(". Hide")[0].replace(" to ", "–")) for day, _, time in items if day.strip() in DAYS}
        if week:
            return week
    rows = ([squeeze(page.text(c, " ")) for c in page.inside(e) if c.tag == "td"] for e in ROW.elements(page, None))
    return {cells[0]: cells[1] for cells in rows if len(cells) > 1 and cells[0] in DAYS}


def review_cards(page: Page, most: int) -> list[dict[str, Any]]:
    """The first cards' fields; of cards of one review that lie in each other the outermost counts, cards without author and text don't."""
    by_id, by_class = ([*way.elements(page, None)] for way in CARDS)
    outermost = {e.attributes[CARD]: e for e in reversed(by_id)}
    cards = sorted(outermost.values(), key=lambda e: e.at) or by_class
    read = [{name: field.value(page, card) for name, field in REVIEW.items()} for card in cards[:most]]
    return [r for r in read if r["author"] or r["text"]]


def photos(page: Page, most: int, least_px: int) -> list[dict[str, str]]:
    """Large photos of the place in page order, images before backgrounds, each once under its large size."""
    images, styles = (way.elements(page, None) for way in PHOTOS)
    shown = [(e.attributes["src"], e.attributes.get("alt", "")) for e in images] + [(u, "") for e in styles for u in re.findall(BACKGROUND, e.attributes["style"])]
    large: dict[str, str] = {}
    for url, alt in shown:
        px = re.search(PHOTO_SIZE, url)
        if px and int(px[1]) >= least_px and PHOTO.fullmatch(url):
            large.setdefault(re.sub(r"=(?:w\d+-h\d+.*|s\d+)$", "=w1200-h800", url), alt)
    return [{"url": u, "alt": a} for u, a in list(large.items())[:most]]


def read_page(html: str | None, most_reviews: int = 5, most_images: int = 4, least_px: int = 100) -> dict[str, Any]:
    """Fields of one page; what it lacks is empty. Null and broken pages give empty fields."""
    page = Page(html or "")
    out = {name: field.value(page) for name, field in FIELDS.items()}
    area = (re.search(form, out["address"], re.I) for form in AREA_FORMS)
    return out | {
        "closed": CLOSED in page.text(between=" "),
        "area": next((m[1] for m in area if m), ""),
        "hours": opening_hours(page),
        "categories": [c for c in CATEGORY.values(page, None) if c],
        "reviews": review_cards(page, most_reviews),
        "images": photos(page, most_images, least_px),
    }


@F.pandas_udf(PAGE)
def _pages(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(p) for p in pages], columns=PAGE.names)


def page_fields(html: Column | str) -> Column:
    """struct of all fields of a page, in one pass of the parser."""
    return _pages(F.col(html) if isinstance(html, str) else html)
