"""Personal information in free text: found by form, by known words and by context, replaced by typed placeholders.

Numbers that pass the checks of their kind are permuted within their format by a keyed Feistel
network, dates within the calendar, so equal values stay equal in all documents, however they are
written; emails, names and addresses get a keyed tag of their normal form. The rest of a text stays as it is.

A name is a known or learned word anywhere in a text, with the words that belong to it, unless what
follows makes it the name of a thing; a word nobody knows is one where its context, its case and
what is usual in the corpus say so.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.session import durable, join_hot, spread

#: Words before a name that aren't part of it.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "engr", "prof", "sir", "madam", "mam", "aunty", "auntie", "uncle", "teacher", "ustad", "baji", "syed", "hafiz")
#: Words of authors that name roles or groups, never persons.
ROLES = frozenset(
    """a abroad academy admin anonymous bear caregiver center centre colony corner customer daycare desk driver family fan father from front guest happy
    house kids lane local manager mom mother mum nursery of office official otters owner papa parent parents park playgroup preschool
    principal reviewer road school sector society staff street sunny teacher team town two user visitor working والدین""".split()
)
#: Nouns that make a name before them the name of a place, a body or a thing.
THINGS = frozenset(
    """academy apartments avenue bakery bank block boulevard bridge building campus centre center chowk city clinic club college colony company cottage daycare district drive enclave
    estate foundation garden gardens gate ground heights homes hospital hostel hotel house institute kindergarten lane library line lines mall market mart masjid montessori mosque mills nursery office park
    period pharmacy phase plaza preschool restaurant road school schools scheme sector shop society station store street studio suites superstore tower towers town trust university view villas workshop""".split()
)
#: Function words, common verbs and adjectives of English and of Urdu in Latin letters; none is a name.
COMMON = frozenset(
    """a about above after again against all almost also although always am among an and another any anyone anything are around as ask asked at away back bad be because been before being below best better between both but by call called came can
    cannot care child children come contact could cried daughter day did do does done down during each either else enough even ever every everyone everything excellent expensive few fine first follow food for former found friendly from gave get give given go god allah going good got great had
    happy has have he hello help helped her here hers him his how however husband i if in into is it its just kept kind know known last late later least left less like little long lost lot love loved loves made make management many may maybe me met might mine
    more most much must my near nearly need never new next nice no nobody none nor not nothing now of off often old on once one only open or other our ours out over own parents people perhaps period please poor quick quit quite rather really retired rude said same saw say see sent
    session several she should since sister so some someone something son soon sorry spoke staff still such sure take team than thank thanks that the their theirs them then there these they thing this those though through time to today together told
    too took toward try twins under until up upon us use very wait was we well went were what when where whether which while who whom whose why wife will with within without wonderful write yes yesterday yet you your yours
    acha achi achay aur bachay bekar bilkul bohat bohot hai hain hum humari ka kar khayal khush ki ke ko laga likhein mashallah mein mera meri nahi ne par rakha se superb tha thi wale""".split()
)
_LETTERS = r"[^\W\d_]"
_TOKEN = re.compile(rf"{_LETTERS}+(?:['’]{_LETTERS}+)?")
_RUN = re.compile(rf"{_LETTERS}+")
_KIN = "son|daughter|child|baby|nephew|niece|husband|wife|brother|sister|mother|father|cousin|aunt|uncle|boy|girl|friend|neighbou?r|toddler|twins"
_JOB = "owner|principal|director|manager|driver|cook|coordinator|supervisor|receptionist|guard|nurse|caregiver|head|founder|teacher|assistant|helper"
#: What stands before a person, whoever it is: a word behind it may be a name that no list holds.
BEFORE = re.compile(
    rf"""\b(?:ask(?:ed)?\ for|shout-?\ ?out\ (?:to|for)|kudos\ to|hats\ off\ to|credit\ (?:goes\ )?to|grateful\ to|thankful\ to|thank(?:s|\ you)?(?:\ (?:to|so\ much))?|told\ by|greeted\ by|welcomed\ by|run\ by|helped\ by
    |(?:spoke|speak|spoken|talk|talked|met|meet|dealt|deal)\ (?:to|with)|met|named|called|name\ is|i\ am|i['’]m|signed|regards|sincerely|praise|recommend|trust|mashallah|inshallah
    |(?:my|our|his|her|their)\ (?:\w+\ )?(?:{_KIN})|the\ (?:{_JOB})|twins)[,:]?\s+""",
    re.I | re.X,
)
#: What stands behind a person: a capital word before it that isn't usual in the corpus is a name.
BEHIND = re.compile(
    r"""\s+(?:(?:is|was|has\ been)\ (?:the\ best|so|very|such|always|really|extremely|amazing|wonderful|patient|kind|great|rude|our|my)\b|retired\b|left\ and\b|ne\b|sahib\b|sahiba\b|bhai\b|apa\b|never\ answers?\b
    |(?:and|with)\ (?:his|her|their)\b|helped\b|explained\b|welcomed\b|told\ (?:us|me)\b|took\ (?:care|good)\b|takes\ (?:care|good)\b|said\b|says\b|loves\b|cried\b|who\b)""",
    re.I | re.X,
)
#: For each kind of context words of which a text must hold one; looking for them costs far less than the patterns.
_BEFORE_CUES = frozenset(
    """ask asked shout shoutout kudos hats credit grateful thankful thank thanks told greeted welcomed run helped spoke speak spoken talk talked met meet dealt deal named called name am m signed regards sincerely
    praise recommend trust mashallah inshallah neighbour neighbor""".split()
) | frozenset(f"{_KIN}|{_JOB}".split("|"))
_BEHIND_CUES = frozenset("retired left ne sahib sahiba bhai apa never helped explained welcomed told took takes said says loves cried who".split())
_QUALITIES = frozenset("best so very such always really extremely amazing wonderful patient kind great rude our my".split())
#: Words beside a small-letter name that show a person is meant.
_LEFT_WORDS = frozenset("to by with from for and or ask met thank thanks of about than like see saw tell told trust love loves praise recommend named called is are am our my his her their".split()) | frozenset(TITLES)
_DETERMINERS = frozenset("a an the no some any this that much more little such".split())
_RIGHT_WORDS = frozenset("is was has had who and ne ko ki ka se never always also helped said says told took takes loves cried left retired will would can did does made makes sahib sahiba bhai apa".split())
_TITLE_WORD = re.compile(rf"(?<!{_LETTERS})(?:{'|'.join(TITLES)})\b\.?\s+", re.I)
_TITLE_SET = frozenset(TITLES)
_DIGIT = re.compile(r"\d")
_SOME_DIGIT_WORDS = re.compile(r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[ -](?:zero|oh|one|two|three|four|five|six|seven|eight|nine)")

_DOT = r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*|\s+dot\s+)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.%+-]*(?:\s?@\s?{_LABEL}(?:{_DOT}{_LABEL})+|\s*[\[(]\s*at\s*[\])]\s*{_LABEL}(?:{_DOT}{_LABEL})+|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})+)", re.I)
_GAP = r"[ .()–-]{0,3}"
_D = "[0-9Oo]"
PHONE = re.compile(rf"(?<![\w+])(?<![\w][-–.])(?:(?:\+|00)?[(]?92[)]?(?:{_GAP}{_D}){{10}}|[0Oo](?:{_GAP}{_D}){{10}})(?![\w]|[-–.]\d)")
_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
SPOKEN = re.compile(rf"(?<!\w){_WORD}(?:[ -]{_WORD}){{9,13}}(?!\w)", re.I)
NATIONAL_ID = re.compile(r"(?<![\w+])(?<![\w][-–])\d{5}[ –-]?\d{7}[ –-]?\d(?![\w]|[-–]\d)")
PASSPORT = re.compile(r"(?<![\w-])(?:[A-Z]{2}[ -]?|[a-z]{2}-?)\d{7}(?![\w])")
BUSINESS = re.compile(r"\b(?:order|receipt|invoice|challan|voucher|bill)\b[^\w]*(?:no\b\.?|number|#)?\W*$", re.I)
_ROAD = r"(?:Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Avenue|Ave)\b\.?"
_UNIT = r"\d{1,4}(?:\s?-?\s?[A-Za-z](?![A-Za-z]))?"
HOUSE = re.compile(
    rf"(?<![\w])(?:(?:house|hse|plot|flat|apartment|villa)\b\s*\.?\s*(?:no\b\.?|number\b|#)?\s*[#:.]*\s*|[hp]\s*\.?\s*(?:no\b\.?\s*#?|#)\s*){_UNIT}"
    rf"(?:,?\s+{_UNIT}(?=\s+[A-Z]))?(?:,?\s*(?:street|st|str|gali)\b\s*\.?\s*(?:no\b\.?|#)?\s*#?\s*\d{{1,3}})?(?:,?\s+(?:[A-Z][\w'-]+\s+){{1,3}}{_ROAD})?(?:,?\s*[B-I]\s?-?\s?\d{{1,2}}(?:[/-]\d)?(?!\d))?",
    re.I,
)
DOOR = re.compile(rf"(?<![\w#/.-]){_UNIT}\s+(?:Main\s+)?(?:[A-Z][a-z'-]+\s+){{1,3}}{_ROAD}(?:,?\s*[B-I]-?\d{{1,2}}(?:[/-]\d)?)?")
_OTHER_DIGITS = re.compile("[٠-٩۰-۹]")
DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


class Case(NamedTuple):
    start: int  # of the first letter or digit, from 0
    stop: int
    kind: str


def _trim(text: str, start: int, stop: int) -> tuple[int, int]:
    while start < stop and not text[start].isalnum():
        start += 1
    while stop > start and not (text[stop - 1].isalnum() or text[stop - 1] in ".)"):
        stop -= 1
    return start, stop


class Words:
    """What is known of words: names, and words that aren't names though they open texts with a capital letter; gate: words of which a text with a name must hold one."""

    def __init__(self, names: frozenset[str], usual: frozenset[str] = frozenset()):
        self.names, self.usual = names, usual
        self.gate = names | _TITLE_SET | _BEFORE_CUES | _BEHIND_CUES | _QUALITIES | {"his", "her", "their"}


class _Tokens:
    """The words of a text: where they start and stop, and their small form; at most ``'s`` is cut off."""

    def __init__(self, plain: str, low: str, names: frozenset[str]):
        self.plain, self.start, self.stop, self.low = plain, [], [], []
        for m in _TOKEN.finditer(low):
            a, b, w = m.start(), m.end(), m[0]
            if w[-2:] in ("'s", "’s") and w not in names:
                b, w = b - 2, w[:-2]
            self.start.append(a)
            self.stop.append(b)
            self.low.append(w)

    def form(self, i: int) -> str:
        """A: capitals, a: small letters, Aa: a capital first, ".": an initial, x: letters without case."""
        w = self.plain[self.start[i] : self.stop[i]]
        if len(w) == 1 and w.isupper() and self.plain[self.stop[i] : self.stop[i] + 1] == ".":
            return "."
        if w.islower():
            return "a"
        if len(w) > 1 and w.isupper():
            return "A"
        return "Aa" if w[0].isupper() else "x"

    def next_to(self, i: int, j: int) -> bool:
        """Whether only blanks (or an initial's full stop) part two neighbouring words; False where one doesn't exist."""
        if i < 0 or j >= len(self.low):
            return False
        between = self.plain[self.stop[i] : self.start[j]]
        if between in (" ", "  "):
            return True
        return between[:1] == "." and between[1:] in ("", " ", "  ") and self.form(i) == "."


def names_in(plain: str, low: str, words: Words) -> list[tuple[int, int]]:
    """Spans of names in a text, not overlapping, in order of how sure they are."""
    runs = _RUN.findall(low)
    quoted = "'" in low or "’" in low
    if not quoted and words.gate.isdisjoint(runs):
        return []
    runs = set(runs)
    known = quoted or not words.names.isdisjoint(runs)
    titled = [m.end() for m in _TITLE_WORD.finditer(low)] if not _TITLE_SET.isdisjoint(runs) else []
    led = [m.end() for m in BEFORE.finditer(low)] if not _BEFORE_CUES.isdisjoint(runs) else []
    behind = not _BEHIND_CUES.isdisjoint(runs) or (not runs.isdisjoint(("is", "was", "been")) and not _QUALITIES.isdisjoint(runs)) or (not runs.isdisjoint(("and", "with")) and not runs.isdisjoint(("his", "her", "their")))
    followed = [m.start() for m in BEHIND.finditer(low)] if behind else []
    if not (known or titled or led or followed):
        return []
    t = _Tokens(plain, low, words.names)
    n, lows, form, next_to = len(t.low), t.low, t.form, t.next_to
    used = [False] * n
    out: list[tuple[int, int]] = []

    def plainly(i: int) -> bool:
        """Whether a word that isn't known may be a name at all."""
        w = lows[i]
        return len(w) > 1 and w not in COMMON and w not in ROLES and w not in THINGS and w not in _TITLE_SET and w not in words.usual

    def thing(i: int) -> bool:
        """Whether the word behind token i makes the name that ends there a thing's."""
        return next_to(i, i + 1) and lows[i + 1] in THINGS

    def fits(i: int, beside: int) -> bool:
        """Whether an unknown word goes with the name beside it by its letters."""
        one, two = form(i), form(beside)
        return plainly(i) and (one == two or (two == "." and one != "a"))

    def quiet(i: int) -> bool:
        """Whether token i is no part of a name for sure: out of the text, or a word in common use."""
        return not 0 <= i < n or lows[i] in COMMON or lows[i] in words.usual or lows[i] in _TITLE_SET

    def right(first: int, last: int) -> int:
        """Last token of the name that holds tokens first to last: known words, an initial, or one unknown word of the same form."""
        while last - first < 2 and next_to(last, last + 1) and not used[last + 1]:
            j = last + 1
            initial = form(j) == "."
            if not (lows[j] in words.names or (last == first and (initial or (fits(j, last) and (form(j) != "a" or not next_to(j, j + 1) or quiet(j + 1)))))):
                break
            last = j
            if initial:
                break
        return last

    def left(first: int, last: int) -> int:
        """First token of the name: an initial or a known word before it; before a single word also an unknown one of the same form."""
        i = first - 1
        if not next_to(i, first) or used[i]:
            return first
        if form(i) == "." or lows[i] in words.names:
            return i
        return i if first == last and fits(i, first) and (form(i) != "a" or not next_to(i - 1, i) or quiet(i - 1)) else first

    def take(first: int, last: int) -> None:
        used[first : last + 1] = [True] * (last + 1 - first)
        stop = t.stop[last]
        out.append((t.start[first], stop + (form(last) == "." and plain[stop : stop + 1] == ".")))

    if known:
        for i in range(n):
            if used[i] or lows[i] not in words.names:
                continue
            last = right(i, i)
            first = left(i, last)
            # a single known word in small letters is a name if something beside it says so
            beside = (i > 0 and lows[i - 1] in _LEFT_WORDS) or (i + 1 < n and lows[i + 1] in _RIGHT_WORDS)
            meant = first < last or form(i) != "a" or (beside and not (i > 0 and lows[i - 1] in _DETERMINERS))
            if meant and not thing(last):
                take(first, last)
    at = {start: i for i, start in enumerate(t.start)} if titled or led else {}
    for position in (*titled, *led):
        # behind a context: a name that no list holds, not in small letters
        while (m := _TITLE_WORD.match(low, position)) is not None:
            position = m.end()
        i = at.get(position)
        if i is None or used[i] or form(i) == "a":
            continue
        if form(i) == ".":
            if next_to(i, i + 1) and not used[i + 1] and plainly(i + 1) and form(i + 1) != "a":
                take(i, i + 1)
        elif plainly(i):
            last = right(i, i)
            if not thing(last):
                take(i, last)
    for position in followed:
        i = bisect.bisect_right(t.stop, position) - 1
        if i < 0 or used[i] or plain[t.stop[i] : position] not in ("", "."):
            continue
        kind = form(i)
        if kind != "a" and (kind == "." or plainly(i)):
            first = i - 1 if next_to(i - 1, i) and not used[i - 1] and (form(i - 1) == "." or fits(i - 1, i)) else i
            if not (kind == "." and first == i):
                take(first, i)
    return out


BIRTH = re.compile(r"\b(?:born(?: on)?|dob|d\.o\.b\.?|date of birth|birthday|birth date)\b\W*(?:is\b|was\b|on\b|:)?\W*$", re.I)
DATE = re.compile(r"(?<![\d/.-])(?:(\d{1,2})([/.-])(\d{1,2})\2(\d{4})|(\d{4})-(\d{2})-(\d{2}))(?![\d/-])")
CARD = re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])")
#: Kinds that a caller may ask for beside those always found.
EXTRA = ("birth_date", "card")


def checks(digits: str) -> bool:
    """Whether the last digit of a payment card's number is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def as_date(m: re.Match) -> dt.date | None:
    """The day that a match of DATE names, day first, or month first where only that is a day; None if neither is."""
    y, a, b = (int(m[4]), int(m[3]), int(m[1])) if m[4] else (int(m[5]), int(m[6]), int(m[7]))
    for month, day in ((a, b), (b, a)) if m[4] else ((a, b),):
        try:
            return dt.date(y, month, day)
        except ValueError:
            continue
    return None


def find(text: str | None, words: Words | frozenset[str], extra: tuple[str, ...] = ()) -> list[Case]:
    """Cases of a text in order, none overlapping. Null, empty and blank texts have none.

    extra: of EXTRA, dates of birth (real days behind a word that says so) and card numbers whose check digit is right.
    """
    if not text or not text.strip():
        return []
    words = words if isinstance(words, Words) else Words(words)
    plain = text if text.isascii() or not _OTHER_DIGITS.search(text) else text.translate(DIGITS)
    cases: list[Case] = []
    taken = bytearray(len(text))

    def add(start: int, stop: int, kind: str) -> None:
        start, stop = _trim(text, start, stop)
        if start < stop and not any(taken[start:stop]):
            cases.append(Case(start, stop, kind))
            taken[start:stop] = b"\1" * (stop - start)

    low = plain.lower()
    # each pattern runs only on texts that hold what it can't do without
    if "@" in low or ("at" in low and ("dot" in low or "(" in low or "[" in low)):
        for m in EMAIL.finditer(plain):
            add(*m.span(), "email")
    digits = len(_DIGIT.findall(plain))
    if extra and digits >= 6:
        for m in CARD.finditer(plain) if "card" in extra else ():
            if checks(re.sub(r"\D", "", m[0])):
                add(*m.span(), "card")
        for m in DATE.finditer(plain) if "birth_date" in extra else ():
            if as_date(m) and BIRTH.search(plain[max(0, m.start() - 30) : m.start()]):
                add(*m.span(), "birth_date")
    if digits >= 5:
        for m in NATIONAL_ID.finditer(plain) if digits >= 13 else ():
            if not (m[0].startswith("0092") or BUSINESS.search(plain[max(0, m.start() - 24) : m.start()])):
                add(*m.span(), "id_number")
        for m in PHONE.finditer(plain):
            if sum(c.isdigit() for c in m[0]) >= 5 and not BUSINESS.search(plain[max(0, m.start() - 24) : m.start()]):
                add(*m.span(), "phone")
        for m in PASSPORT.finditer(plain) if digits >= 7 else ():
            if not BUSINESS.search(plain[max(0, m.start() - 24) : m.start()]):
                add(*m.span(), "id_number")
    for m in SPOKEN.finditer(plain) if _SOME_DIGIT_WORDS.search(low) else ():
        add(*m.span(), "phone")
    for pattern in (HOUSE, DOOR) if digits else ():
        for m in pattern.finditer(plain):
            add(*m.span(), "address")
    if len(low) == len(plain):
        for span in names_in(plain, low, words):
            add(*span, "name")
    else:
        # letters whose small form is longer: positions are kept by looking at each of them alone
        for span in names_in(plain, "".join(c.lower()[0] for c in plain), words):
            add(*span, "name")
    return sorted(cases)


def find_author(author: str | None, words: Words | frozenset[str]) -> list[Case]:
    """Cases of an author: an email, a phone, the name before it. Nicknames, handles and roles are none."""
    if not author or not author.strip():
        return []
    lexicon = words.names if isinstance(words, Words) else words
    plain = author.translate(DIGITS)
    out = [Case(*_trim(author, *m.span()), "email") for m in EMAIL.finditer(plain)]
    if out:
        return out
    out = [Case(*_trim(author, *m.span()), "phone") for m in PHONE.finditer(plain)]
    stop = out[0].start if out else len(author)
    rest = plain[:stop].rstrip(" (+")
    if re.search(r"[\d_@]|\w-\w", rest):
        return out
    parts = [(m.start(), m.end(), m[0]) for m in re.finditer(rf"{_LETTERS}+(?:['’]{_LETTERS}+)?", rest)]
    while parts and parts[0][2].lower() in TITLES:
        parts.pop(0)
    low = [w.lower() for _, _, w in parts]
    long = [w for w in low if len(w) > 1]
    if not long or len(parts) > 3 or any(w in ROLES and len(w) > 1 for w in low):
        return out
    foreign = all(w > "ɏ" for w in long)
    if any(w in lexicon for w in long) or len(parts) > 1 or foreign:
        out.insert(0, Case(*_trim(author, parts[0][0], parts[-1][1] + (rest[parts[-1][1] : parts[-1][1] + 1] == ".")), "name"))
    return out


def _author_words(reviews: DataFrame) -> DataFrame:
    """(w, count): the lists of words of authors without title, in small letters; authors that name a role are left out."""
    found = F.regexp_extract_all(F.lower(F.regexp_replace("author", r"(?i)^\s*(mrs?|ms|miss|dr|engr|prof)\b\.?", "")), F.lit(r"(\p{L}{2,})"), 1)
    return reviews.select(found.alias("w")).where((F.size("w") > 0) & ~F.exists("w", lambda x: x.isin(list(ROLES)))).groupBy("w").count()


def learned_names(authors: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """(name) of the known names, and of words that stand beside a known one in at least ``least`` authors (rows of _author_words); distinct."""
    names = known.select(F.lower(F.trim("name")).alias("name")).where(F.col("name") != "").distinct()
    pairs = authors.where(F.size("w") == 2)
    sides = pairs.select(F.inline(F.array(F.struct(F.col("w")[0].alias("name"), F.col("w")[1].alias("other"), "count"), F.struct(F.col("w")[1].alias("name"), F.col("w")[0].alias("other"), "count"))))
    found = sides.join(names, "name", "left_semi").groupBy(F.col("other").alias("name")).agg(F.sum("count").alias("n")).where(F.col("n") >= least).select("name")
    return names.unionByName(found).distinct()


#: A word is usual if at least this share of all texts begin with it, so there are at most 1 / USUAL_SHARE of them.
USUAL_SHARE = 1 / 50_000


def usual_words(reviews: DataFrame, authors: DataFrame) -> frozenset[str]:
    """Words that open texts, so have capitals without being names; words of authors are none. A share of all texts, whatever their number."""
    opening = reviews.select(F.lower(F.regexp_extract("text", r"^[^\p{L}]*(\p{L}+)", 1)).alias("name")).where(F.col("name") != "").groupBy("name").agg(F.count("*").alias("n"))
    total = opening.agg(F.sum("n")).first()[0] or 0
    often = opening.where(F.col("n") >= total * USUAL_SHARE).select("name")
    named = authors.select(F.explode("w").alias("name")).distinct()
    return frozenset(r["name"] for r in often.join(named, "name", "left_anti").collect())  # at most 1 / USUAL_SHARE


def asked_words(text: str | None) -> set[str]:
    """Every word of a text that may be looked up among the names: runs of letters, and two of them around an apostrophe, in small letters."""
    plain = (text or "").translate(DIGITS)
    runs = list(_RUN.finditer(plain))
    joined = {plain[a.start() : b.end()] for a, b in zip(runs, runs[1:]) if plain[a.end() : b.start()] in ("'", "’")}
    return {w.lower() for w in joined.union(m[0] for m in runs)}


#: As many names are shared with all workers; of more each row gets those of its own words by a join.
MOST_SHARED = 100_000
#: Values whose cases a worker keeps; texts longer than MEMORY_CHARS aren't kept.
MEMORY, MEMORY_CHARS = 1 << 16, 400


def with_names(reviews: DataFrame, known: DataFrame) -> tuple[DataFrame, frozenset[str] | None, frozenset[str]]:
    """The rows with what is known of words: (review_id, author, text), all names and the usual words; or the rows with the names among their own words in ``names``, None and the usual words."""
    slim = reviews.select("review_id", "author", "text")
    authors = durable(_author_words(reviews))
    lexicon, usual = learned_names(authors, known), usual_words(reviews, authors)
    short = [r["name"] for r in lexicon.limit(MOST_SHARED + 1).collect()]
    if len(short) <= MOST_SHARED:
        return spread(slim, "review_id"), frozenset(short), usual

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, w) for i, author, text in zip(batch["review_id"], batch["author"], batch["text"]) for w in asked_words(author) | asked_words(text)]
            yield pd.DataFrame(rows, columns=["id", "name"])

    asked = durable(spread(slim, "review_id").mapInPandas(ask, "id long, name string"))
    own = join_hot(asked, lexicon, ["name"], spread_by=["id"]).groupBy("id").agg(F.collect_set("name").alias("names"))
    return slim.join(own, F.col("review_id").eqNullSafe(F.col("id")), "left").select("review_id", "author", "text", F.coalesce("names", F.array().cast("array<string>")).alias("names")), None, usual


def finder(shared: frozenset[str] | None, usual: frozenset[str], extra: tuple[str, ...] = ()) -> Callable[..., tuple[list[Case], list[Case]]]:
    """(author, text, names) -> cases of both. With shared names, values that come again are looked up; a bounded number is kept."""
    everyone = None if shared is None else Words(shared, usual)
    known: dict[tuple[bool, str], list[Case]] = {}

    def one(value: str | None, author: bool, words: Words) -> list[Case]:
        if everyone is None or value is None or len(value) > MEMORY_CHARS:
            return find_author(value, words) if author else find(value, words, extra)
        cases = known.get((author, value))
        if cases is None:
            if len(known) >= MEMORY:
                known.clear()
            cases = known[author, value] = find_author(value, words) if author else find(value, words, extra)
        return cases

    def both(author: str | None, text: str | None, names: list[str] | None = None) -> tuple[list[Case], list[Case]]:
        words = everyone or Words(frozenset(names or ()), usual)
        return one(author, True, words), one(text, False, words)

    return both


FOUND = "review_id long, field string, kind string, start_pos int"


def find_cases(reviews: DataFrame, known: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(review_id, field, kind, start_pos) of every case in author and text; start_pos counts code points from 1."""
    named, shared, usual = with_names(reviews, known)
    words = reviews.sparkSession.sparkContext.broadcast((shared, usual))  # at most MOST_SHARED and 1 / USUAL_SHARE words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = finder(*words.value, extra)
        for batch in batches:
            ids, fields, kinds, starts = [], [], [], []
            for i, *row in zip(*(c.to_pylist() for c in batch.columns)):
                for field, cases in zip(("author", "text"), both(*row)):
                    for c in cases:
                        ids.append(i)
                        fields.append(field)
                        kinds.append(c.kind)
                        starts.append(c.start + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32())], ["review_id", "field", "kind", "start_pos"])

    return named.mapInArrow(run, FOUND)


def permute(digits: str, key: bytes, rounds: int = 10) -> str:
    """A keyed permutation of the digit strings of one length (Feistel network on two halves); shorter than two digits stays."""
    half = len(digits) // 2
    if not half:
        return digits
    a, b = digits[:half], digits[half:]
    for i in range(rounds):
        mix = int.from_bytes(hmac.new(key, f"{len(digits)}/{i}/{b}".encode(), hashlib.sha256).digest(), "big")
        a, b = b, str((int(a) + mix) % 10 ** len(a)).zfill(len(a))
    return a + b


def restore(digits: str, key: bytes, rounds: int = 10) -> str:
    """The inverse of permute."""
    half = len(digits) // 2
    if not half:
        return digits
    # after an even number of rounds the halves have their lengths again
    a, b = digits[:half], digits[half:]
    for i in reversed(range(rounds)):
        mix = int.from_bytes(hmac.new(key, f"{len(digits)}/{i}/{a}".encode(), hashlib.sha256).digest(), "big")
        a, b = str((int(b) - mix) % 10 ** len(b)).zfill(len(b)), a
    return a + b


FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # to the end of 2099


def other_day(day: dt.date, key: bytes) -> dt.date:
    """A keyed permutation of the days of 1900 to 2099: numbers are permuted until one is a day again. Other days stay."""
    n = day.toordinal() - FIRST_DAY
    if not 0 <= n < DAYS:
        return day
    while True:
        n = int(permute(f"{n:06d}", key))
        if n < DAYS:
            return dt.date.fromordinal(FIRST_DAY + n)


def dated(value: str, key: bytes) -> str:
    """A date with another day in its own format."""
    m = DATE.fullmatch(value)
    day = m and as_date(m)
    if not day:
        return value
    new = other_day(day, key)
    if m[5]:
        return new.isoformat()
    first, second = (new.day, new.month) if int(m[3]) == day.month else (new.month, new.day)
    width = 2 if len(m[1]) == 2 and len(m[3]) == 2 else 0
    return f"{first:0{width}d}{m[2]}{second:0{width}d}{m[2]}{new.year}"


_SPOKEN_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def placeholder(value: str, kind: str, key: bytes) -> str:
    """``<KIND x>``: for numbers x is the permuted number in its own format, else a tag of the normal form."""
    plain = value.translate(DIGITS)
    if kind == "phone":
        spoken = SPOKEN.fullmatch(plain)
        digits = "".join(_SPOKEN_DIGITS[w] for w in re.split(r"[ -]", plain.lower())) if spoken else re.sub(r"\D", "", re.sub("[Oo]", "0", plain))
        national = digits[-10:]
        new = permute(national, key)
        if spoken:
            return f"<PHONE 0{new}>"
        out, rest = [], list(new)
        for c in reversed(re.sub("[Oo]", "0", plain)):
            out.append(rest.pop() if c.isdigit() and rest else c)
        return f"<PHONE {''.join(reversed(out))}>"
    if kind == "id_number":
        digits = re.sub(r"\D", "", plain)
        rest = list(permute(digits, key))
        out = [rest.pop() if c.isdigit() else c for c in reversed(plain)]
        return f"<ID {''.join(reversed(out))}>"
    if kind == "birth_date":
        return f"<DATE {dated(plain, key)}>"
    if kind == "card":
        digits = re.sub(r"\D", "", plain)
        body = permute(digits[:-1], key)
        rest = list(body + next(c for c in "0123456789" if checks(body + c)))
        return f"<CARD {''.join(rest.pop() if c.isdigit() else c for c in reversed(plain))[::-1]}>"
    normal = re.sub(r"[\W_]+", " ", re.sub(r"\b(?:at|dot)\b", " ", plain.lower())).strip()
    return f"<{kind.upper()} {hmac.new(key, normal.encode(), hashlib.sha256).hexdigest()[:32]}>"


def redact(reviews: DataFrame, known: DataFrame, key: bytes, extra: tuple[str, ...] = ()) -> DataFrame:
    """reviews (review_id, author, text) with every case replaced; null stays null and text without cases stays as it is."""
    named, shared, usual = with_names(reviews, known)
    words = reviews.sparkSession.sparkContext.broadcast((shared, usual))  # at most MOST_SHARED and 1 / USUAL_SHARE words

    def clean(value: str | None, cases: list[Case]) -> str | None:
        for c in reversed(cases):
            value = value[: c.start] + placeholder(value[c.start : c.stop], c.kind, key) + value[c.stop :]
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = finder(*words.value, extra)
        for batch in batches:
            authors, texts = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                one, two = both(*row)
                authors.append(clean(row[0], one))
                texts.append(clean(row[1], two))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(authors, pa.string()), pa.array(texts, pa.string())], ["review_id", "author", "text"])

    return named.mapInArrow(run, "review_id long, author string, text string")
