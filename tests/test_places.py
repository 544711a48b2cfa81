"""Golden tables of classification, areas, grids and plans."""

import pytest
from pyspark.sql import functions as F

from placeweave.functions import geo
from placeweave.operators.area import Matcher, assign, nearest
from placeweave.operators.classify import Scope, verdict
from placeweave.plans import tasks
from placeweave.plans.config import Plan, parse, read_boundary

SQUARE = [[[(69.3, 30.8), (69.6, 30.8), (69.6, 31.0), (69.3, 31.0)]]]
HERE = "Plot 8, Street 21, C-11/1, Zarwanabad"
CASES = [
    ("Quiet Corner Child Care", "Day care center", {}, "daycare", ""),
    ("Blue Door ChildCare & Learning", "Preschool", {}, "daycare", ""),
    ("Pebble Pre School", "Kindergarten", {}, "preschool", ""),
    ("Willow Montessori", "Educational institution", {}, "preschool", ""),
    ("Willow Academy of Toddlers, Day Care", "Education center", {}, "daycare", ""),
    ("CRÈCHE Pebble", "School", {}, "daycare", ""),
    ("pebble day care", "School", {}, "daycare", ""),
    ("Pebble House", "Educational institution", {}, "", "category: Educational institution"),
    ("Willow School System", "Montessori school", {}, "", "part of a school (name)"),
    ("Willow Grammar", "Preschool", {}, "", "part of a school (name)"),
    ("Pram World", "Toy store", {}, "", "category: Toy store"),
    ("Unsorted Daycare", None, {}, "", "category: none"),
    ("Pebbles", "Day care center", {"address": "Sandoor Town, Kelmirpur"}, "", "outside Zarwanabad (Kelmirpur)"),
    ("Pebbles", "Day care center", {"address": "Plot 9, Zarwanabad Bypass, Kelmirpur, Pakistan"}, "", "outside Zarwanabad (Kelmirpur)"),
    ("Pebbles", "Day care center", {"address": ""}, "", "no address or location"),
    ("Pebbles", "Day care center", {"address": None}, "", "no address or location"),
    ("Pebbles", "Day care center", {"closed": True}, "", "permanently closed"),
    ("Pebbles", "Day care center", {"address": "x, Kelmirpur", "lat": 30.91, "lng": 69.42, "boundary": True}, "daycare", ""),
    ("Pebbles", "Day care center", {"lat": 30.79, "lng": 69.42, "boundary": True}, "", "outside Zarwanabad boundary"),
    ("Pebbles", "Day care center", {"address": "Norvela Phase 21, Zarwanabad", "exclude": ("Norvela Phase 2",)}, "", "excluded area (Norvela Phase 2)"),
    ("Pebbles", "Day care center", {"address": "Sandoor Enclave, Zarwanabad", "exclude": ("Sandoor Town",)}, "daycare", ""),
    (None, "Preschool", {}, "preschool", ""),
]


@pytest.mark.parametrize("name,category,extra,kind,reason", CASES)
def test_classify(spark, name, category, extra, kind, reason):
    row = (name, [category] if category else None, extra.get("address", HERE), extra.get("closed"), extra.get("lat", 0.0), extra.get("lng", 0.0))
    frame = spark.createDataFrame([row], "n string, c array<string>, a string, x boolean, y double, z double")
    scope = Scope("Zarwanabad", SQUARE if extra.get("boundary") else None, extra.get("exclude", ()))
    got = frame.select(verdict(*(F.col(c) for c in "ncaxyz"), scope).alias("v")).first()["v"]
    assert (got["listing_type"], got["reason"]) == (kind, reason)


PLAN = """
[areas]
C-11
D-9
E-15
G-7 (Old Mandi)
H-6 (Torab Hill)
Kharmeez
Water Board Society O-8
Board Society
Norvela Phase 2
Plaza Hub-3
Sandoor
Lotaari
Jewel Court
Tamarookh
[aliases]
# spellings
Khar Meez = Kharmeez
Norvela Phase II = Norvela Phase 2
I-5 = Jewel Court
گلشن میرکند = Lotaari
[area_match]
max_km = 1.5
[keywords]
daycare
montessori
"""
CENTRES = [(0, "E-15", 30.8500, 69.3600), (1, "Tamarookh", 30.8370, 69.6193), (2, "Twin", 30.8500, 69.3600)]
AREAS = [
    ("Plot 3-B, Long Rd, C-11/4 C 11/4 C-11, Zarwanabad, 40100, Pakistan", 0, 0, "", ("C-11", "C-11/4", "sector", "")),
    ("17 Canal Rd, E-15/2 Zarwanabad, 40100, Pakistan", 0, 0, "", ("E-15", "E-15/2", "sector", "")),
    ("Old Mandi, G-7, Zarwanabad", 0, 0, "", ("G-7", "", "sector", "")),
    ("Upper Khar-Meez Lane, Zarwanabad", 0, 0, "", ("Kharmeez", "", "name", "")),
    ("Plot 3, Street 8, Water Board Society O-8, Zarwanabad", 0, 0, "", ("Water Board Society O-8", "", "name", "")),
    ("Street 4, Board Society, Zarwanabad", 0, 0, "", ("Board Society", "", "name", "")),
    ("Plot 12, NORVELA phase ii, Zarwanabad", 0, 0, "", ("Norvela Phase 2", "", "name", "")),
    ("Block B, Torab Hill, Zarwanabad", 0, 0, "", ("H-6", "", "name", "")),
    ("Plaza Hub 3, Block B, Zarwanabad", 0, 0, "", ("Plaza Hub-3", "", "name", "")),
    ("Block A گلشن میرکند", 0, 0, "", ("Lotaari", "", "name", "")),
    ("Sandoors, Xkharmeez", 0, 0, "", ("", "", "", "")),
    ("Lane No 9, A Road, Pakistan", 0, 0, "", ("", "", "", "")),
    ("Canal Road, Pakistan", 30.8515, 69.3620, "", ("E-15", "", "map pin", "")),
    ("Mile 5, Pakistan", 30.96, 69.43, "", ("", "", "", "")),
    ("A-8, 2 Stage, Somewhere, Zarwanabad, Pakistan", 30.8370, 69.6193, "", ("Tamarookh", "", "map pin", "")),
    ("MWC6+4M4, Some Khan Rd", 0, 0, "Pebbles of Sandoor Zarwanabad", ("Sandoor", "", "listing name (name)", "")),
    ("Fifth Complex, I-5/1 I-5, Zarwanabad, 40100", 0, 0, "", ("Jewel Court", "I-5/1", "sector", "")),
    ("Judges Court, F-5/2, Zarwanabad", 30.8500, 69.3600, "", ("", "F-5/2", "", "F-5")),
    ("Plot 4", 30.8500, 69.3600, "Kids H-15", ("E-15", "", "map pin", "")),
    (None, None, None, None, ("", "", "", "")),
    ("", float("nan"), 69.36, "", ("", "", "", "")),
]


def test_areas(spark):
    plan = parse(PLAN, "Zarwanabad")
    assert plan.aliases["Old Mandi"] == "G-7" and plan.max_km == 1.5
    rows = [(i, n, a, None if y is None else float(y), None if x is None else float(x)) for i, (a, y, x, n, _) in enumerate(AREAS)]
    places = spark.createDataFrame(rows, "raw_id int, name string, address string, latitude double, longitude double")
    centres = spark.createDataFrame(CENTRES, "ord int, area string, lat double, lng double")
    got = {r["raw_id"]: (r["area"], r["sub_area"], r["method"], r["unlisted_sector"]) for r in assign(places, Matcher(plan), centres).collect()}
    assert got == {i: case[4] for i, case in enumerate(AREAS)}
    assert nearest(places, centres.limit(0), "raw_id", "latitude", "longitude", 1.5).count() == 0


def test_plan_errors():
    with pytest.raises(ValueError):
        parse("lost line", "X")
    with pytest.raises(ValueError):
        parse("[aliases]\na = Nowhere\n", "X")
    with pytest.raises(ValueError):
        read_boundary('{"type": "Point", "coordinates": [1, 2]}')
    multi = read_boundary('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}}')
    assert len(multi) == 2


def test_tasks(spark):
    plan = Plan("Zarwanabad", ["daycare", "montessori"], ["F-7", "E-18"], grid={"bbox": "33.60,73.00,33.65,73.06", "step_km": "2.5", "zoom": "14", "keywords": "daycare"})
    rows = tasks.build(spark, plan).orderBy("ord").collect()
    assert [r["query"] for r in rows[:4]] == ["daycare in F-7 Zarwanabad", "montessori in F-7 Zarwanabad", "daycare in E-18 Zarwanabad", "montessori in E-18 Zarwanabad"]
    assert all(r["key"].startswith("grid:daycare@") and r["zoom"] == 14 for r in rows[4:]) and len({r["key"] for r in rows}) == len(rows) > 4
    assert tasks.build(spark, plan, only=["e-18"]).count() == 2
    with pytest.raises(ValueError):
        tasks.build(spark, plan, only=["F-77"])
    done = spark.createDataFrame([("area:F-7|daycare",)], "key string")
    assert tasks.remaining(tasks.build(spark, plan), done).count() == len(rows) - 1
    assert tuple(tasks.counts(tasks.build(spark, plan)).first()) == (4, len(rows) - 4)


def test_grid_and_polygons(spark):
    assert geo.grid_cells(spark, (30.5, 69.0, 30.8, 69.5), 2.5).count() == 13 * 19
    hole = [[[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]], [[(20, 20), (21, 20), (21, 21), (20, 21)]]]
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (20.5, 20.5), (15.0, 15.0), (None, 1.0)], "y double, x double")
    assert [r[0] for r in points.select(geo.in_polygons(F.col("y"), F.col("x"), hole)).collect()] == [True, False, True, False, False]
