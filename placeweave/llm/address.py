"""Reading postal addresses: normal form of text and the components of an address.

Plain Python on one text at a time; the Spark operators call it in Arrow batches over distinct texts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable
from typing import NamedTuple

#: Short forms of words in names of areas and roads.
SHORT = {
    "col": "colony", "hts": "heights", "encl": "enclave", "twn": "town", "resid": "residency", "soc": "society", "sch": "scheme",
    "gdn": "garden", "anch": "anchorage", "terr": "terrace", "ph": "phase", "est": "estate", "ext": "extension", "rd": "road", "dr": "drive",
    "ln": "lane", "blvd": "boulevard", "ave": "avenue", "apt": "apartment", "pk": "park", "vlg": "village", "emp": "employees", "hsg": "housing",
}
#: Numbers as words' parts in names of phases.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
ROADS = "road|drive|lane|boulevard|avenue"
#: Things an address names only to be found by.
MARKS = "bakery|pharmacy|station|tailors?|tank|park|market|school|mosque|masjid|bank|hospital|clinic|mart|store|shop|office|plaza|pump|college|ground|chowk|gate|bridge"
SECTOR = re.compile(r"(?<![a-z0-9#/.-])(?:(?:sector|sec)\b\.?\s*)?([b-i])\s?-?\s?(\d{1,2})(?:\s?[/-]\s?(\d{1,2}))?(?![a-z0-9/])(?!\s?-\s?[a-z0-9])")
PLUS = re.compile(r"\b[23456789cfghjmpqrvwx]{4,8}\+[23456789cfghjmpqrvwx]{2,3}\b")
STREET = re.compile(r"\b(?:st|str|street|gali|gully|galli)\b\s*\.?\s*(?:no\b|number\b)?\s*[.#:]*\s*-?\s*(\d{1,3})(?![0-9])")
FLOOR = re.compile(r"\b(?:\d+(?:st|nd|rd|th)|ground|first|second|third|top|lower|upper)\s+floor\b|\bbasement\b")
BLOCK = re.compile(r"\b(?:block|blk)\b\.?\s*-?\s*([a-z])(?![a-z0-9])|(?<![a-z0-9])([a-z])\s*-?\s*(?:block|blk)\b")
LANDMARK = re.compile(rf"\b(?:near|nr|opposite|opp|behind|above|beside|below|adjacent to|next to|in front of)\b\.?(?:\s+[a-z']+){{0,3}}?\s+(?:{MARKS})\b")
_LETTER = r"(?:\s*-?\s*([a-z])(?![a-z0-9])(?!\s*-?\s*(?:block|blk)\b))?"
HOUSE = re.compile(r"\b(?:(?:house|hse|plot|flat|villa|bungalow)\b\s*\.?\s*(?:no\b|number\b|num\b)?|[hp]\s*\.?\s*no\b|[hp](?=\s*#))\s*[.#:]*\s*(\d{1,4})" + _LETTER)
BARE = re.compile(r"(?:^|,)\s*(?:no\b\s*\.?\s*[#:]?\s*|#\s*)?(\d{1,4})" + _LETTER + r"(?=\s|,|$)")
ROAD = re.compile(rf"([^,\d]*?)\b({ROADS}|rd|dr|ln|blvd|ave)\b\.?")


_DASH, _BREAK, _BLANKS = re.compile(r"[‐-―−]"), re.compile(r"\s*[\n\r;|]\s*"), re.compile(r"\s+")
_PARTS = re.compile(r"[^\W_]+")
_GLUED = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=[^\W\d_]{3})(?=\d)")
_CODES, _LOOSE_ROAD, _LOOSE_SECTOR = re.compile(r"\b\d{5}\b|\bpakistan\b|\bict\b"), re.compile(rf"\s*,\s*(?=(?:{ROADS})\s*(?:,|$))"), re.compile(r"\b(?:sector|sec)\b\.?")
#: Keywords that a number or a single letter follows, and those that end a road's name; misspelt ones go to the one they are an edit away from.
LEADING, ENDING = ("street", "house", "plot", "flat", "villa", "bungalow", "block", "sector"), tuple(ROADS.split("|"))
_LED = re.compile(r"\b([a-z]{4,9})\b(?=\s*\.?\s*(?:no\b|number\b|num\b)?\s*[.#:]*\s*-?\s*(?:\d|[a-z]\b))")
_LAST = re.compile(r"(?<=[a-z] )([a-z]{4,10})(?=\.?\s*(?:,|$))")


class Address(NamedTuple):
    number: str | None  # of house or plot, with its letter: "12", "12-a"
    street: str | None
    block: str | None
    sector: str | None  # "f-10"
    sub: str | None
    roads: list[str]  # names without "main" and type
    phrases: list[str]  # what is left, among it the area and the city


def plain(text: str | None) -> str:
    """Lower case without accents, dashes and quotes of one kind, white space squeezed, line breaks as commas."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c) or "؀" <= c <= "ۿ")
        text = _DASH.sub("-", text.replace("’", "'"))
    return _BLANKS.sub(" ", _BREAK.sub(", ", text.lower())).strip()


def unglue(text: str | None) -> str | None:
    """Words written together in capitals and small letters or digits, parted: "NorvelaPhase2" as "Norvela Phase 2"."""
    if not text:
        return text
    return _GLUED.sub(" ", text)


def words(phrase: str) -> list[str]:
    """Words and numbers of a phrase in plain form, short forms written out."""
    out: list[str] = []
    for w in _PARTS.findall(phrase):
        w = SHORT.get(w, w)
        if out and out[-1] == "phase":
            w = ROMAN.get(w, w)
        out.append(w)
    return out


def sectors(text: str) -> list[tuple[str, str | None]]:
    """Sectors a plain text names, in order: ("f-10", "2"). Numbers outside 5 to 18 are none."""
    return [(f"{m[1]}-{int(m[2])}", m[3]) for m in SECTOR.finditer(text) if 5 <= int(m[2]) <= 18]


def best_sector(found: list[tuple[str, str | None]]) -> tuple[str | None, str | None]:
    """The first mention with a sub-sector, else the last mention."""
    for sector, sub in found:
        if sub:
            return sector, str(int(sub))
    return found[-1] if found else (None, None)


@functools.lru_cache(maxsize=1 << 16)
def keyword(word: str, leading: bool) -> str:
    """The keyword that a word is or is an edit or swap away from, else the word. A road's type must be longer than four letters or have two swapped, as names are close to short ones."""
    known = LEADING if leading else ENDING
    if word in known or word in LEADING or word in ENDING or word in SHORT:
        return word
    for k in known:
        if distance(word, k, 1) == 1 and (leading or (len(word) == len(k) and sorted(word) == sorted(k)) or (len(k) > 5 and word[0] == k[0])):
            return k
    return word


def read(text: str | None) -> Address:
    """Components of an address; what it lacks is None or empty. Any text gives a result."""
    s = _CODES.sub(",", PLUS.sub(",", plain(unglue(text)) if text else ""))
    s = _LED.sub(lambda m: keyword(m[1], True), s)
    s = _LAST.sub(lambda m: keyword(m[1], False), s)
    s = LANDMARK.sub(",", FLOOR.sub(",", s))
    s = _LOOSE_ROAD.sub(" ", s)
    street = block = number = None
    m = STREET.search(s)
    if m:
        street = str(int(m[1]))
        s = STREET.sub(",", s)
    m = HOUSE.search(s)
    if m:
        number = str(int(m[1])) + (f"-{m[2]}" if m[2] else "")
        s = s[: m.start()] + "," + s[m.end() :]
    m = BLOCK.search(s)
    if m:
        block = m[1] or m[2]
        s = BLOCK.sub(",", s)
    sector, sub = best_sector(sectors(s))
    s = SECTOR.sub(lambda m: "," if 5 <= int(m[2]) <= 18 else m[0], s)
    s = _LOOSE_SECTOR.sub(",", s)
    if number is None:
        m = BARE.search(s)
        if m:
            number = str(int(m[1])) + (f"-{m[2]}" if m[2] else "")
            s = s[: m.start()] + "," + s[m.end() :]
    roads: list[str] = []
    phrases: list[str] = []
    for m in ROAD.finditer(s):
        name = " ".join(w for w in words(m[1]) if w != "main")
        if name:
            roads.append(name)
            phrases.append(f"{name} {SHORT.get(m[2], m[2])}")
    s = ROAD.sub(",", s)
    for part in s.split(","):
        phrase = " ".join(w for w in words(part) if w != "main")
        if phrase and not phrase.isdigit() and phrase not in phrases:
            phrases.append(phrase)
    return Address(number, street, block, sector, sub, roads, phrases)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit, or most + 1 if it is above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def shorter(token: str) -> Iterable[str]:
    """The token itself and all that one deletion leaves of it: two tokens one edit apart share one of these."""
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}
