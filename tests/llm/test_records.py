"""Areas, survivors, premises."""

import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from placeweave.llm import address, canonical, premises, survivor
from placeweave.schema import LISTING

CITY = [(1, "Zarwanabad"), (2, "Kelmirpur")]
AREA = [(1, 1, "C-11"), (2, 1, "Norvela Phase 2"), (3, 1, "Norvela Phase 5"), (4, 1, "Sandoor Town"), (5, 2, "Sandoor Town"), (6, 1, "Civil Aviators Colony O-4"), (7, 1, "Aviators Colony"), (8, 2, "Gulshan-e-Torab"), (9, 1, "Lotaari Road"), (10, 1, "Old Tarvandi"), (11, 1, "New Tarvandi")]
ALIAS = [("Purani Mandi No 36", 2), ("GET Kel", 8), ("گلشن میرکند", 10)]


def tables(spark):
    city = spark.createDataFrame([(i, n, n.lower(), "") for i, n in CITY], "id long, name string, slug string, meta_description string")
    area = spark.createDataFrame([(i, c, n, n.lower(), "") for i, c, n in AREA], "id long, city_id long, name string, slug string, meta_description string")
    return city, area, spark.createDataFrame(ALIAS, "alias string, area_id long")


Z = "Zarwanabad"
AREAS = [
    (Z, "C - 11", None, 1), (Z, "c11", None, 1), (Z, "Sec. C11 Zarwanabad", None, 1), (Z, "F-12", "C-11/2", 0), ("Kelmirpur", "C-11", None, 0),
    (Z, "NorvelaPhase2", None, 2), (Z, "noreela ph-2", None, 2), (Z, "Norvela Phase V", None, 3), (Z, "Norvela Phase", None, 0), (Z, "Topazi City", None, 0),
    (Z, "near SANDOOR TWN (main branch)", None, 4), ("Kelmir Pur", "Town Sandoor", None, 5), (None, "Sandoor Town", "x, Kelmirpur", 5), (Z, "Cîvîl Avîátörs Cölöny O-4", None, 6), (Z, "aviators-colony", None, 7),
    ("Kelmirpr", "Gulhsan-e-Torab, Kelmirpur", None, 8), ("Kelmirpur", "get kel", None, 8), (Z, "Purani Mandi No 36", None, 2), (Z, "Purani Mandi No 63", None, 0), (Z, "Block A, گلشن میرکند", None, 10),
    (Z, "unknown", "C-11", 0), (Z, "Old Tarvandi", None, 10), (Z, "Tarvandi", None, 0), (Z, "Norvela Enclave", None, 0),
    (Z, " ", "H. No. 12-A, St# 4, C 11/2 C-11, Zarwanabad, Pakistan", 1), (Z, "", "House 3, F-12/1", 0), (Z, None, "Plot 2, Mundwani Lane, Zarwanabad", None), (Z, None, "12 Gali 2 block C sandor town, Zarwanabad", 4),
    (Z, None, "House 3, Street 2, Block A, Lotaari , Road", 9), (Z, None, None, None), (None, None, "", None), (None, None, "House 1, Gulshan e Torab", 8), (Z, None, "x " * 5000, None),
]


def test_areas(spark):
    rows = [(i, c, a, w, "clash") for i, (c, a, w, _) in enumerate(AREAS)]
    raw = spark.createDataFrame(rows, "raw_id long, city string, area string, address string, phrase string")
    got = {r["raw_id"]: r["area_id"] for r in canonical.match_areas(raw, *tables(spark)).collect()}
    wrong = [(AREAS[i][:3], got.get(i), AREAS[i][3]) for i in range(len(AREAS)) if got.get(i) != AREAS[i][3]]
    assert not wrong
    assert canonical.match_areas(raw.limit(0), *tables(spark)).count() == 0


@pytest.mark.parametrize("a,b,most,d", [("abcd", "abdc", 2, 1), ("abc", "abc", 1, 0), ("abc", "xyz", 1, 2), ("", "ab", 2, 2), ("gulshan", "gulsan", 1, 1)])
def test_distance(a, b, most, d):
    assert address.distance(a, b, most) == d


def test_repair(spark):
    tokens = spark.createDataFrame([("gulhsan",), ("gulshan",), ("town",), ("twon",), ("abc1234",), ("zz",)], "token string")
    words = spark.createDataFrame([("gulshan",), ("town",), ("abc1235",), ("zy",)], "ref string")
    got = {(r["token"], r["ref"]) for r in canonical.repair(tokens, words).collect()}
    assert got == {("gulhsan", "gulshan"), ("gulshan", "gulshan"), ("town", "town"), ("twon", "town")}


ADDRESSES = {
    "H. No. 277A, Steet 62, Blk B, zarbakht colony": ("277-a", "62", "b", None, None),
    "H#141-A, Steet 98, F-18-4": ("141-a", "98", None, "f-18", "4"),
    "2nd floor House 75-C St. 55 C 11/4, ZARWANABAD, 40107": ("75-c", "55", None, "c-11", "4"),
    "267 Gali 20 block C Sanijohi Kalan": ("267", "20", "c", None, None),
    "behind the fire station, No. 24B, Str. No. 9": ("24-b", "9", None, None, None),
    "C8FM+3GR, Plot # 130-A, St 115": ("130-a", "115", None, None, None),
    "Main Market, C-11": (None, None, None, "c-11", None),
    "": (None, None, None, None, None),
}


@pytest.mark.parametrize("text", list(ADDRESSES))
def test_read(text):
    a = address.read(text)
    assert (a.number, a.street, a.block, a.sector, a.sub) == ADDRESSES[text]


LEFT = [
    "House 12-A, Street 4, Block C, Sandoor Town, Zarwanabad", "H#12 A St 4 C-Block sandor town, Zarwanabad", "House 12-K, Street 4, Block C, Sandoor Town, Zarwanabad", "Plot 12-A, Gali 4, Blk C, Sandoor Town, Kelmirpur",
    "P#5, St# 7, C-11-2", "House 5, Street 7, C11/3, Zarwanabad", "Plot 9, Main Mundwani Lane, Zarwanabad", "Sandoor Town, Zarwanabad", None, "", "House 12-A, Street 4, Block C, Pyxara Downs, Zarwanabad", "x" * 5000,
]
RIGHT = ["Plot 12A, St. 4, Block C, Sandoor Twn, Zarwanabad, 40142", "No. 5, Street 7, Sector C-11/2", "9 Mundwnai Ln", "C-11, Zarwanabad", None, "Hse 12-A, Str. No. 4, C Block, pyxara  downs, zarwanabad"]


def test_premises(spark):
    left = spark.createDataFrame([(i, None, a) for i, a in enumerate(LEFT)], "id long, city string, address string")
    right = spark.createDataFrame([(i, None, a) for i, a in enumerate(RIGHT)], "id long, city string, address string")
    pairs = premises.same_premises(left, right, *tables(spark)).collect()
    assert sorted(map(tuple, pairs)) == [(0, 0), (1, 0), (4, 1), (6, 2), (10, 5)]
    assert premises.same_premises(left.limit(0), right, *tables(spark)).count() == 0


def test_premises_hot(spark, monkeypatch):
    monkeypatch.setattr(premises, "ROWS_PER_TASK", 7)
    left = spark.range(60).select("id", F.lit(None).cast("string").alias("city"), F.lit(LEFT[4]).alias("address"))
    right = spark.range(3).select("id", F.lit(None).cast("string").alias("city"), F.lit(RIGHT[1]).alias("address"))
    assert premises.same_premises(left, right, *tables(spark)).count() == 180


def test_linked_premises(spark, monkeypatch):
    """The number of links of each address is that of its pairs; copies share a class."""
    monkeypatch.setattr(premises, "ROWS_PER_TASK", 7)
    lefts = LEFT + LEFT[:2] * 20 + [LEFT[6]] * 15
    left = spark.createDataFrame([(i, None, a) for i, a in enumerate(lefts)], "id long, city string, address string")
    right = spark.createDataFrame([(i, None, a) for i, a in enumerate(RIGHT * 3)], "id long, city string, address string")
    pairs = [tuple(r) for r in premises.same_premises(left, right, *tables(spark)).collect()]
    assert len(pairs) == len(set(pairs)) and len(pairs) > 150
    rows = premises.linked_premises(left, right, *tables(spark)).collect()
    want = defaultdict(int)
    for a, b in pairs:
        want["l", a] += 1
        want["r", b] += 1
    assert {(r["side"], r["id"]): r["links"] for r in rows if r["links"]} == want
    kind = {(r["side"], r["id"]): r["class_id"] for r in rows}
    assert kind["l", 0] == kind["l", 12] and len(kind) == len(rows)
    assert premises.linked_premises(left.limit(0), right.limit(0), *tables(spark)).count() == 0


@pytest.mark.parametrize("text,street", [("House 3, Srteet 5, F-7/2", "5"), ("House 3, Steet 5, F-7/2", "5"), ("Huose 3, Streeet 5, F-7/2", "5"), ("Hause 3, Tsreet 5, F-7/2", "5")])
def test_misspelt_keywords(text, street):
    a = address.read(text)
    assert (a.number, a.street, a.sector) == ("3", street, "f-7")


def test_other_words_are_no_keywords():
    assert address.read("9 Wonder Land, Norvela Phase 2").roads == [] and address.read("9 Mundwani Avenu").roads == ["mundwani"]
    assert "norvela phase 2" in address.read("House 9, Norvela Phase 2").phrases


def brute(rows):
    fields = survivor.MERGE_FIELDS
    groups, out = defaultdict(list), set()
    for r in rows:
        key = (r["place_id"] or "").strip().lower().replace("%3a", ":")
        if re.fullmatch(survivor.PLACE_ID, key):
            groups[r["city_id"], key].append(r)
    for g in groups.values():
        if len(g) < 2:
            continue
        g.sort(key=lambda r: (bool(re.search(r"-\d+$", r["slug"] or "")), r["id"]))
        locked = {x for r in g for x in r["locked_fields"] or []}
        for f in fields:
            name = f.removesuffix("_id")
            full = [r for r in sorted(g, key=lambda r: r["updated_at"] or dt.datetime.min) if not (r[f] is None or r[f] in (0, [], {}) or (isinstance(r[f], str) and not r[f].strip()))]
            source = next((r["id"] for r in full if r is g[0]), None) if name in locked else full[-1]["id"] if full else None
            if source is not None:
                out.add((g[0]["id"], name, source))
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    t = [None, dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1), dt.datetime(2025, 2, 2)]
    rows = []
    for i in range(n):
        r = {f.name: None for f in LISTING.fields} | {"id": i, "slug": rng.choice(["a", "b-1", "c", None]), "city_id": rng.choice([1, None]), "place_id": rng.choice(["0x1:0xa", " 0X1%3A0xA\n", "0x2:0xb", "Some+Name", None]), "updated_at": rng.choice(t)}
        for f in survivor.MERGE_FIELDS:
            kind = LISTING[f].dataType.typeName()
            r[f] = rng.choice({"string": ["v", "", "  ", None], "long": [3, None], "double": [1.5, 0.0, None], "integer": [2, 0, None], "array": [["x"], [], None], "map": [{"d": "t"}, {}, None]}[kind])
        r["locked_fields"] = rng.choice([None, [], [], [], ["phone", "reviews"], ["area"]])
        rows.append(r)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_survivors(spark, seed):
    rows = random_rows(60, seed)
    frame = spark.createDataFrame([tuple(r[c] for c in LISTING.names) for r in rows], LISTING).withColumn("mask", F.lit("clash"))
    got = [tuple(r) for r in survivor.listing_survivors(frame).select("keeper_id", "field", "source_id").collect()]
    assert set(got) == brute(rows) and len(set(got)) == len(got)
    assert survivor.listing_survivors(frame.limit(0)).count() == 0


def brute_policy(rows, completeness, prefer):
    """Layer by layer: whoever nobody left beats; then each field from the first layer that fills it."""
    full = lambda r: [f for f in "abc" if r[f]]
    out = set()
    for g in {r["g"] for r in rows}:
        own = [r for r in rows if r["g"] == g]
        if len(own) < 2:
            continue
        beats = lambda a, b: a is not b and (a["at"], a["id"]) > (b["at"], b["id"]) and a["t"] >= b["t"] and (set(full(a)) >= set(full(b)) if completeness == "set" else len(full(a)) >= len(full(b)))
        part = {}  # of rows alike in what they fill and in trust the most recent takes part
        for r in sorted(own, key=lambda r: (r["at"], r["id"])):
            part[tuple(full(r)), r["t"]] = r
        left, layers = list(part.values()), []
        while left:
            layers.append([r for r in left if not any(beats(o, r) for o in left)])
            left = [r for r in left if r not in layers[-1]]
        key = {"trust": lambda r: r["t"], "completeness": lambda r: len(full(r)), "recency": lambda r: (r["at"], r["id"])}
        for f in "abc":
            layer = next(([r for r in x if r[f]] for x in layers if any(r[f] for r in x)), [])
            if layer:
                out.add((g, f, max(layer, key=lambda r: tuple(key[p](r) for p in (*prefer, "recency")))["id"]))
    return out


@pytest.mark.parametrize("completeness,prefer", [("set", ("recency",)), ("count", ("recency",)), ("count", ("trust", "completeness")), ("set", ("completeness", "trust")), ("count", ("completeness",))])
def test_survivor_policies(spark, completeness, prefer):
    """Policies under which layers decide, against brute force; they differ from the latest value."""
    rng = random.Random(11)
    rows = [{"g": rng.randrange(12), "id": i, "at": dt.datetime(2025, 1, 1 + rng.randrange(6)), "t": rng.randrange(3), **{f: rng.choice(["x", ""]) for f in "abc"}} for i in range(150)]
    frame = spark.createDataFrame([(r["g"], r["id"], r["at"], r["t"], r["a"], r["b"], r["c"], []) for r in rows], "g long, id long, at timestamp, t int, a string, b string, c string, locks array<string>")
    got = survivor.survivors(frame, ["g"], "id", ["a", "b", "c"], "at", F.lit(False), "locks", trust=F.col("t"), completeness=completeness, prefer=prefer)
    found = {(r["g"], r["field"], r["source_id"]) for r in got.collect()}
    assert found == brute_policy(rows, completeness, prefer)
    latest = brute_policy(rows, "set", ("recency",))
    assert (found == latest) == ((completeness, prefer) == ("set", ("recency",)))


def test_place_key(spark):
    frame = spark.createDataFrame([("", "https://m.example/?q=X&ftid=0xA:0xB"), (None, "a!1s0x1%3A0x2!8m2"), ("0x5:0x6 ", "a!1s0x1:0x2!"), ("Name", "https://m.example/")], "p string, u string")
    assert [r[0] for r in frame.select(survivor.place_key(F.col("p"), F.col("u"))).collect()] == ["0xa:0xb", "0x1:0x2", "0x5:0x6", None]
