"""Queries over the whole of their tables; SQL here reads what the queries' own SQL leaves out."""

import json
import time

from pyspark.sql import functions as F

from placeweave.operators import directory
from placeweave.operators import queries as core
from placeweave.schema import LISTING


def tables(folder, **frames):
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_review_that_stands_alone(spark, tmp_path):
    one = {"author": "Ann", "text": "good", "rating": 5}
    dump = [{"name": "A", "reviews": one}, {"name": "B", "reviews": [one, {"text": "bad"}]}, {"name": "C", "reviews": json.dumps(one)}, {"name": "D", "reviews": {}}]
    folder = tables(tmp_path, raw_dump=spark.createDataFrame([(1, json.dumps(dump))], "dump_id long, payload string"))
    rows = {(r["dewey"], r["parent_dewey"], r["author"], r["text"], r["date"], r["rating"]) for r in core.p1_review_table(spark, folder).collect()}
    assert rows == {("0.1", "0", "Ann", "good", None, "5"), ("1.1.0", "1.1", "Ann", "good", None, "5"), ("1.1.1", "1.1", None, "bad", None, None), ("2.1", "2", "Ann", "good", None, "5")}


def raw_places(spark, *rows):
    base = dict(raw_id=0, name="A", address="", city="", area="", phone="", website="", rating=0.0, review_count=0, latitude=0.0, longitude=0.0, place_id="", categories=["Preschool"], hours={}, description="", google_maps_url="", listing_type="", found_by=None, closed=False)
    kinds = "raw_id long, name string, address string, city string, area string, phone string, website string, rating double, review_count int, latitude double, longitude double, place_id string, categories array<string>, hours map<string,string>, description string, google_maps_url string, listing_type string, found_by array<string>, closed boolean"
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], kinds)


def test_crawl_fold_takes_all_keys(spark, tmp_path):
    here = "x, Zarwanabad"
    rows = [
        {"raw_id": 1, "place_id": "0x1:0x1", "address": here, "found_by": ["a", "b"]},
        {"raw_id": 2, "place_id": "0x2:0x2", "address": "x, Elsewhere", "found_by": ["b", None, "c", "b"]},
        {"raw_id": 3, "place_id": "0x1:0x1", "address": here, "found_by": ["c"]},
        {"raw_id": 4, "place_id": "0x4:0x4", "address": here, "found_by": []},
        {"raw_id": 5, "place_id": "0x4:0x4", "address": here, "found_by": None},
    ]
    folder = tables(tmp_path, raw_place=raw_places(spark, *rows))
    got = {tuple(r) for r in directory.QUERIES["crawl_fold"](spark, folder).collect()}
    assert got == {("a", 1, 1, 1, 0), ("b", 2, 1, 0, 1), ("c", 2, 0, 0, 0), ("none", 2, 1, 1, 0)}


CITY, AREA = "id long, name string, slug string", "id long, city_id long, slug string"


def cities(spark):
    return spark.createDataFrame([(1, "Zarwanabad", "zarwanabad"), (2, "Kelmirpur", "kelmirpur")], CITY)


def test_missing_areas_of_all_cities(spark, tmp_path):
    typed = [
        ("F-7", "Zarwanabad", ""), ("Palm Town 2", " ZARWANABAD", ""), ("G-9", "Kelmirpur", ""), ("F-7", "Kelmirpur", ""), ("Lake View", "Kelmirpr", "x, Kelmirpur, Pakistan"),
        ("Old Fort", "Elsewhere", "x"), ("Mill End", None, "x, Zarwanabad"), ("Nowhere", "", ""), (" ", "Kelmirpur", ""), (None, "Kelmirpur", ""),
    ]
    rows = [{"raw_id": i, "area": a, "city": c, "address": d} for i, (a, c, d) in enumerate(typed)]
    folder = tables(tmp_path, raw_place=raw_places(spark, *rows), city=cities(spark), area=spark.createDataFrame([(1, 1, "f-7")], AREA))
    got = {tuple(r) for r in directory.QUERIES["missing_areas"](spark, folder).collect()}
    # "Kelmirpr" would be city 4 by its slug, but the address knows better; "Elsewhere" is 3, none at all 0
    assert got == {(1, "palm-town-2", "Palm Town 2"), (2, "g-9", "G-9"), (2, "f-7", "F-7"), (2, "lake-view", "Lake View"), (3, "old-fort", "Old Fort"), (1, "mill-end", "Mill End"), (0, "nowhere", "Nowhere")}


def test_first_form_takes_all_forms(spark, tmp_path):
    want = {"Street 11, I-12/3": "I-12/3", "G-9, near F-7": "F-7", "é, g-10": "g-10", "éF-7": "", "Main Bani Gala": "Bani Gala", "DHA Phase 2": "DHA Phase 2", "": ""}
    rows = [{"raw_id": i, "address": a} for i, a in enumerate([*want, None])]
    folder = tables(tmp_path, raw_place=raw_places(spark, *rows))
    got = {r["raw_id"]: r["f_area"] for r in directory.QUERIES["first_form"](spark, folder).collect()}
    assert got == dict(enumerate([*want.values(), ""]))


def test_result_urls_of_a_large_city(spark, tmp_path):
    links = F.when(F.col("id") % 3 == 2, F.concat(F.lit("x!1s0x"), F.lower(F.hex(F.floor(F.col("id") / 6))), F.lit(":0x1"))).when(F.col("id") % 3 == 1, F.lit("x"))
    folder = tables(tmp_path, listing=spark.range(100_000).select("id", F.lit(1).cast("long").alias("city_id"), links.alias("maps_url")))
    start = time.monotonic()
    got = {(r["pos"], r["place_id"]) for r in directory.QUERIES["result_urls"](spark, folder).collect()}
    # a third of the links is null, and each place has two
    assert got == {(4 * k + 1, f"0x{k:x}:0x1") for k in range(20)}
    assert time.monotonic() - start < 60


def listings(spark, *rows):
    base = dict.fromkeys(LISTING.names) | {"locked_fields": []}
    return spark.createDataFrame([tuple((base | dict(zip(("id", "name", "slug", "city_id", "place_id"), r))).values()) for r in rows], LISTING)


def test_import_counts_takes_the_whole_batch(spark, tmp_path):
    typed = [
        ("Old", "0x1:0x1", "Zarwanabad", ""), ("Old", "0x1:0x1", "zarwanabad", ""), ("New", "0x2:0x2", "Zarwanabad", ""), ("New", "0x2:0x2", "Zarwanabad ", ""), ("New", "0x2:0x2", "Kelmirpur", ""),
        ("Lost", "0x3:0x3", "", ""), ("Far", "0x4:0x4", "Elsewhere", ""), (" ", "0x5:0x5", "Zarwanabad", ""), ("Out", "0x6:0x6", "Zarwanabad", "x, Kharmeez"), ("Hint", "0x7:0x7", None, "x, Kelmirpur"),
    ]
    rows = [{"raw_id": i, "name": n, "place_id": p, "city": c, "address": a} for i, (n, p, c, a) in enumerate(typed)]
    old = [(1, "Old", "old", 1, "0x1:0x1"), (2, "Hint", "hint", 2, "0x7:0x7"), (3, "Far", "new", 2, "0x8:0x8")]
    known = listings(spark, *old)
    folder = tables(tmp_path, raw_place=raw_places(spark, *rows), city=cities(spark), listing=known)
    got = {r["outcome"]: r["n"] for r in directory.QUERIES["import_counts"](spark, folder).collect()}
    assert got == {"updated (matched by place ID)": 2, "created": 4, "skipped (no name)": 1, "skipped (excluded area: Kharmeez)": 1}
    slugs = {r["raw_id"]: r["slug"] for r in directory.QUERIES["slugs"](spark, folder).collect()}
    assert [slugs[i] for i in range(7)] == ["old-1", "old-2", "new", "new-1", "new-1", "lost", "far"] and slugs[9] == "hint-1"
