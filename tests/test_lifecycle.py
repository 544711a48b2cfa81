"""Crawl, import, dedupe, pages, stream."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from placeweave.operators import crawl, dedupe, merge, report, serve
from placeweave.operators.classify import Scope
from placeweave.schema import LISTING, RAW_PLACE
from placeweave.sources import read, write
from placeweave.streaming import crawl_stream

T0 = dt.datetime(2025, 1, 1)


def listing(spark, *rows):
    base = dict(name="A", slug="a", listing_type="daycare", city_id=1, area_id=None, sub_area="", address="", phone="", website="", description="", rating=0.0, review_count=0,
                latitude=0.0, longitude=0.0, place_id="", maps_url="", categories=[], hours={}, is_verified=False, is_featured=False, is_active=True, locked_fields=[], last_seen_at=None, created_at=T0, updated_at=T0)
    return spark.createDataFrame([tuple((base | r)[c] for c in LISTING.names) for r in rows], LISTING)


def test_crawl_fold(spark):
    inside, outside = "x, C-11, Zarwanabad", "x, Kelmirpur"
    place = {1: ("One", inside, "Day care center"), 2: ("Two", inside, "Preschool"), 3: ("Three", inside, "School"), 4: ("Four", outside, "Preschool")}
    searches = [("area:F-7|daycare", [1, 3]), ("area:F-7|montessori", [1, 2]), ("area:G-9|daycare", [4, 2])]
    hits = [(i * 10 + j, k, *place[p][:2], [place[p][2]], False, 0.0, 0.0, f"0x{p}:0x{p}") for i, (k, ps) in enumerate(searches) for j, p in enumerate(ps)]
    frame = spark.createDataFrame(hits, "ord int, task_key string, name string, address string, categories array<string>, closed boolean, latitude double, longitude double, place_id string")
    kept, rejected, stats = crawl.fold(frame, Scope("Zarwanabad"))
    assert {r["name"]: (r["listing_type"], r["found_by"]) for r in kept.collect()} == {
        "One": ("daycare", ["area:F-7|daycare", "area:F-7|montessori"]), "Two": ("preschool", ["area:F-7|montessori", "area:G-9|daycare"])}
    assert {r["name"]: r["reason"] for r in rejected.collect()} == {"Three": "category: School", "Four": "outside Zarwanabad (Kelmirpur)"}
    assert {r["task_key"]: tuple(r)[1:] for r in stats.collect()}["area:F-7|montessori"] == (2, 1, 1, 0)
    results = kept.select("place_id", "name", "found_by")
    tasks = spark.createDataFrame([(k, len(p)) for k, p in searches] + [("area:G-9|montessori", 0)], "key string, found int")
    rows = {(r["method"], r["keyword"]): tuple(r)[2:] for r in report.keyword_yield(tasks, results).collect()}
    assert rows == {("area", "daycare"): (2, 4, 2, 0), ("area", "montessori"): (2, 2, 2, 0)}
    assert {r["area"]: r["n"] for r in report.area_yield(tasks, results).collect()} == {"F-7": 2, "G-9": 1}


def test_result_urls(spark):
    ids = ["a!1s0x1:0x1!", "b!1s0x2:0x2!", "c!1s0x1:0x1!", "no id"]
    frame = spark.createDataFrame([("k", ids), ("e", [])], "task_key string, hrefs array<string>")
    assert [(r["pos"], r["url"]) for r in crawl.result_urls(frame).orderBy("pos").collect()] == [(0, ids[0]), (1, ids[1])]
    assert crawl.result_urls(frame, most=1).count() == 1


def test_listed_urls_as_result_urls(spark):
    rng = random.Random(2)
    tasks = {k: [rng.choice([f"x!1s0x{rng.randrange(n):x}:0x1!{i}", f"x{i}"]) for i in range(200)] for k, n in (("few", 3), ("many", 60), ("all", 10**9))} | {"none": ["x", "y"], "late": ["x", "y", "z!1s0x1:0x1"]}
    rows = [(k, 7 * i - 50, u) for k, l in tasks.items() for i, u in enumerate(l)] + [(None, 0, "x!1s0x1:0x1")]
    rng.shuffle(rows)
    want = set()
    for k, l in tasks.items():
        seen = {}
        for i, u in enumerate(l):
            seen.setdefault(u[u.find("!1s") + 3 :].split("!")[0] if "!1s" in u else "", (k, i, u))
        want |= {v for _, v in [x for x in seen.items() if x[0]][:20]}
    links = spark.createDataFrame(rows, "task_key string, ord long, url string").repartition(5)
    assert {(r["task_key"], r["pos"], r["url"]) for r in crawl.listed_urls(links, 20).collect()} == want
    lists = spark.createDataFrame(list(tasks.items()), "task_key string, hrefs array<string>")
    assert {(r["task_key"], r["pos"], r["url"]) for r in crawl.result_urls(lists, 20).collect()} == want
    assert crawl.result_urls(lists.unionByName(lists), 20).count() == 2 * len(want)


def test_match_tiers(spark):
    rows = listing(spark, dict(id=1, name="Old", maps_url="x!1s0x1:0x23!y"), dict(id=2, name="Near", latitude=33.7, longitude=73.0), dict(id=3, name="Solo"), dict(id=4, place_id="Legacy+Name", name="Q"), dict(id=5, place_id="0x9:0x9"), dict(id=6, place_id="0x9:0x9"))
    items = [(1, 1, "0x1:0x2", "0x1:0x2", "z", 0.0, 0.0), (2, 1, "", "", "near", 33.701, 73.0), (3, 1, "", "", "NEAR", 34.7, 73.0), (4, 1, "", "", "solo", 33.0, 73.0), (5, 1, "", "Legacy+Name", "zz", None, None), (6, 1, "0x9:0x9", "", "zz", 0.0, 0.0), (7, 2, "0x9:0x9", "", "zz", 0.0, 0.0)]
    frame = spark.createDataFrame(items, "ord int, city_id long, fid string, place_id string, name string, latitude double, longitude double")
    got = {r["ord"]: (r["id"], r["method"], r["hits"]) for r in merge.match(frame, rows).collect()}
    assert got == {1: (1, "place ID", 1), 2: (2, "name + location", 1), 4: (3, "name only", 1), 5: (4, "old-style ID", 1), 6: (5, "place ID", 2)}


def test_protected(spark):
    rows = listing(spark, dict(id=1, phone="1", description="d", rating=4.0, locked_fields=["description"], place_id="old"), dict(id=2, phone="keep"))
    change = spark.createDataFrame([(1, 1, "0x1:0x1", "", "new", 4.5), (2, 1, "", "2", "newer", 0.0)], "ord int, id long, fid string, phone string, description string, rating double")
    out = {r["id"]: r for r in merge.protected(rows, change, ("phone", "description", "rating")).collect()}
    assert (out[1]["phone"], out[1]["description"], out[1]["rating"], out[1]["place_id"]) == ("2", "d", 4.5, "0x1:0x1") and out[1]["last_seen_at"] and not out[2]["last_seen_at"]
    again = merge.protected(merge.protected(rows, change, ("phone",)), change, ("phone",))
    assert again.count() == 2 and again.where("id = 1").first()["phone"] == "2"
    assert merge.unseen(rows, change, 1).first()["n"] == 1


def test_collapse(spark):
    items = spark.createDataFrame([(1, "0x1:0x1", "", "1", 0.0), (2, "0x1:0x1", "", "", 4.0), (3, "", "", "a", 1.0), (4, "", "", "b", 1.0)], "ord int, place_id string, maps_url string, phone string, rating double")
    assert sorted((r["ord"], r["phone"], r["rating"]) for r in merge.collapse(items).collect()) == [(1, "1", 4.0), (3, "a", 1.0), (4, "b", 1.0)]


def test_unique_slugs(spark):
    new = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "x"), (4, 1, "y"), (5, 2, "x")], "ord int, city_id int, base string")
    existing = spark.createDataFrame([(1, "x"), (1, "x-2"), (1, "y-1")], "city_id int, slug string")
    assert {r["ord"]: r["slug"] for r in merge.unique_slugs(new, existing).collect()} == {1: "x-1", 2: "x-3", 3: "x-4", 4: "y", 5: "x"}


def slugs_one_by_one(rows, existing):
    taken, out = set(existing), {}
    for o, city, base in sorted(rows):
        slug, n = base, 1
        while (city, slug) in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add((city, slug))
        out[o] = slug
    return out


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 7), (3, 3)])
def test_slugs_are_those_of_one_by_one(spark, seed, hot):
    """Bases that look like numbered ones of others, taken slugs, hot bases and a null city."""
    rng = random.Random(seed)
    bases = ["x"] * 12 + ["x-1", "x-2", "x-1-1", "x-3", "x-01", "x-0", "y", "y-2", "daycare", "x-10", "-1", "z-1"]
    rows = [(i, rng.choice([1, 2, None]), rng.choice(bases)) for i in range(150)]
    existing = [(rng.choice([1, 2, None]), rng.choice(bases) + rng.choice(["", "-1", "-3", "-4", "-5"])) for _ in range(25)]
    new = spark.createDataFrame(rows, "ord long, city_id long, base string")
    got = merge.unique_slugs(new, spark.createDataFrame(existing, "city_id long, slug string"), hot_rows=hot).collect()
    assert {r["ord"]: r["slug"] for r in got} == slugs_one_by_one([(o, c, b) for o, c, b in rows], existing) and len(got) == 150
    assert len({(r["city_id"], r["slug"]) for r in got}) == 150


def test_slugs_that_look_numbered(spark):
    new = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 1, "x-1")], "ord int, city_id int, base string")
    none = spark.createDataFrame([], "city_id int, slug string")
    assert {r["ord"]: r["slug"] for r in merge.unique_slugs(new, none).collect()} == {1: "x", 2: "x-1", 3: "x-1-1"}
    assert merge.unique_slugs(new.limit(0), none).count() == 0


def test_collapse_by_city(spark):
    items = spark.createDataFrame([(1, "0x1:0x2", "", "A", 1), (2, "0x1:0x2", "", "B", 2), (3, "0x1:0x2", "", "C", 2)], "ord int, place_id string, maps_url string, name string, city_id long")
    assert sorted((r["ord"], r["city_id"], r["name"]) for r in merge.collapse(items).collect()) == [(1, 1, "A"), (2, 2, "C")]


def test_children_and_locks(spark):
    old = spark.createDataFrame([(1, 1, "a", ""), (2, 2, "b", "")], "review_id int, listing_id long, author string, text string")
    new = spark.createDataFrame([(3, 1, "c", ""), (4, 2, "d", ""), (5, 1, "", None)], old.schema)
    parents = listing(spark, dict(id=1), dict(id=2, locked_fields=["reviews"]))
    assert sorted(r[0] for r in merge.replaced_children(old, new, parents, "listing_id", "reviews").collect()) == [2, 3]
    edited = spark.createDataFrame([(1, ["phone", "address"])], "id long, fields array<string>")
    assert merge.lock_edited(parents, edited).where("id = 1").first()["locked_fields"] == ["address", "phone"]


def dupes(spark):
    k = dict(place_id="0xa:0xb")
    return listing(spark, dict(id=3, slug="s-1", phone="3", updated_at=T0, **k), dict(id=7, slug="s", phone="", rating=2.0, locked_fields=["rating"], updated_at=T0, **k),
                   dict(id=5, slug="s-2", phone="5", rating=5.0, updated_at=T0, is_verified=True, **k), dict(id=9, slug="t"), dict(id=10, slug="u", city_id=None, **k))


def test_dedupe(spark):
    rows = dupes(spark)
    assert [tuple(r) for r in dedupe.clusters(rows).collect()] == [(1, "0xa:0xb", 7, 3)]
    (m,) = dedupe.merged(rows).collect()
    assert (m["id"], m["phone"], m["rating"], m["is_verified"], m["locked_fields"], m["slug"]) == (7, "5", 2.0, True, ["rating"], "s")
    children = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 9)], "review_id int, listing_id long")
    moved = dedupe.moved_children(dedupe.members(rows), children, "listing_id")
    assert sorted(map(tuple, moved.collect())) == [(1, 7), (2, 7), (4, 9)]
    survivors = rows.where("id not in (3, 5)")
    assert dedupe.clusters(survivors).count() == 0


def test_redirect_chain(spark):
    kinds = "old_path string, new_path string"
    existing = spark.createDataFrame([("/a/", "/b/"), ("/z/", "/y/"), ("/c/", "/old/")], kinds)
    moves = spark.createDataFrame([("/b/", "/c2/"), ("/c/", "/c2/"), ("/same/", "/same/")], kinds)
    assert dict(map(tuple, dedupe.redirects(existing, moves).collect())) == {"/a/": "/c2/", "/z/": "/y/", "/b/": "/c2/", "/c/": "/c2/"}


def test_pages(spark):
    city = spark.createDataFrame([(1, "C", "c", ""), (2, "D", "d", "")], "id long, name string, slug string, meta_description string")
    area = spark.createDataFrame([(1, 1, "F-7", "f-7", "")], "id long, city_id long, name string, slug string, meta_description string")
    rows = listing(spark, dict(id=1, area_id=1, rating=2.5, description="100% fun"), dict(id=2, slug="b", rating=3.5), dict(id=3, slug="x", is_active=False), dict(id=4, slug="e", city_id=None))
    assert [r["id"] for r in serve.city_page(rows, city, area, "c").collect()] == [2, 1]
    assert [r["id"] for r in serve.city_page(rows, city, area, "c", q="0%").collect()] == [1]
    with pytest.raises(serve.NotFound):
        serve.area_page(rows, city, area, "d", "f-7")
    with pytest.raises(serve.NotFound):
        serve.detail(rows, city, "c", "x")
    stars = {r["id"]: (r["rating_stars"], r["stars"], r["location_label"]) for r in serve.labels(serve.with_place(rows, city, area)).collect()}
    assert stars[1] == (2, "★★", "F-7") and stars[2][0] == 4 and stars[4][2] == ""
    assert {tuple(r) for r in serve.similar(rows).collect()} == {(2, 1, 4), (4, 1, 2)}
    assert serve.live_search(rows, city, area, "f").count() == 0 and serve.live_search(rows, city, area, "f-7").count() == 1
    paths = [r["path"] for r in serve.sitemap(rows, city, area).collect()]
    assert "/c/a/detail/" in paths and len(paths) == 8
    assert '"geo"' not in serve.structured_data(serve.with_place(rows, city, area)).first()["json"]
    assert "Disallow: /search/" in serve.robots("https://x.example")


def test_fill_missing_and_needs(spark):
    raw = spark.createDataFrame([("n", *[None] * 21)], RAW_PLACE)
    assert raw.where(crawl.needs_update(raw)).count() == 1
    old = spark.createDataFrame([("k", "", 0.0, 5.0)], "key string, phone string, latitude double, longitude double")
    new = spark.createDataFrame([("k", "1", 2.0, 3.0)], old.schema)
    assert tuple(crawl.fill_missing(old, new, "key", ["phone", "latitude", "longitude"]).first()) == ("k", "1", 2.0, 3.0)


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"name": "Ä", "unknown": 1, "reviews": [{"author": "x"}]}, {"city": "c", "images": [{"url": "u", "file": ""}], "categories": ["p", "q"]}]', encoding="utf-8")
    rows = read.raw_places(spark, str(path))
    assert [r["name"] for r in rows.collect()] == ["Ä", None]
    out = write.flat(rows).collect()
    assert out[1]["categories"] == "p, q" and out[1]["images"] == "u" and out[0]["hours"] == "{}"
    write.write_json(rows, str(tmp_path / "out"))
    assert read.json_lines(spark, str(tmp_path / "out")).count() == 2
    write.write_csv(rows, str(tmp_path / "csv"))
    assert write.backup(str(tmp_path / "out"), spark).endswith(".bak") and write.backup(str(tmp_path / "none"), spark) is None
    assert read.sidecar(spark, str(tmp_path / "none.json"), "key string").count() == 0
    csv = tmp_path / "c.csv"
    csv.write_text("area,lat,lng,osm_match\nF-7,33.7,73.0,x\nG-9,,,none\n", encoding="utf-8")
    assert [r["area"] for r in read.centres(spark, str(csv)).collect()] == ["F-7"]
    photos = spark.createDataFrame([("image/jpeg; q=1", 6000), ("image/png", 10), ("text/html", 9999)], "content_type string, n_bytes long")
    assert [r["ext"] for r in write.usable_photos(photos).collect()] == ["jpg"]
    assert write.upsert(photos, photos.limit(1).withColumn("n_bytes", F.lit(1).cast("long")), ["content_type"]).count() == 3


def test_stalled(spark):
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate([1, 5, 5, 5, 5, 9])], "task_key string, ord int, n int")
    assert report.stalled(rows).first()["stop"] == 4


def test_stream_equals_batch(spark, tmp_path):
    hits = [(f"p{i % 7}", f"t{i % 5}", i) for i in range(60)]
    schema = "place_key string, task_key string, ord long"
    for n in range(3):
        spark.createDataFrame(hits[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    crawl_stream.run(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    crawl_stream.run(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    state = {r["place_key"]: (sorted(r["found_by"]), r["first_ord"]) for r in crawl_stream.latest(spark, str(tmp_path / "state")).collect()}
    batch = crawl.provenance(spark.createDataFrame(hits, schema), "place_key").collect()
    assert {k: v[0] for k, v in state.items()} == {r["place_key"]: sorted(r["found_by"]) for r in batch} and state["p3"][1] == 3


def item(**fields):
    base = dict(ord=0, city_id=1, name="A", listing_type="", area_id=None, sub_area="", address="", phone="", website="", description="", rating=0.0, review_count=0, latitude=0.0, longitude=0.0, place_id="", maps_url="", categories=[], hours={})
    return base | fields


def batch(spark, *rows):
    kinds = "ord long, city_id long, name string, listing_type string, area_id long, sub_area string, address string, phone string, website string, description string, rating double, review_count int, latitude double, longitude double, place_id string, maps_url string, categories array<string>, hours map<string,string>"
    names = [k.split(" ")[0] for k in kinds.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kinds)


def test_import(spark):
    old = listing(spark, dict(id=1, name="Legacy", slug="legacy", maps_url="x!1s0x1:0x2!", place_id="Legacy+Name", is_featured=True))
    items = batch(spark, item(ord=1, name="Legacy", place_id="0x1:0x2", phone="1"), item(ord=2, name="New", place_id="0x5:0x5"), item(ord=3, name="New", place_id="0x5:0x5", phone="9"), item(ord=4, name="Legacy", latitude=33.0, longitude=73.0), item(ord=5, name=" "), item(ord=6, name="X", address="Bahria Town, Y"))
    one = merge.import_batch(items, old, ("Bahria Town",))
    kept = one["updated"].first()
    assert (kept["place_id"], kept["slug"], kept["is_featured"], kept["phone"]) == ("0x1:0x2", "legacy", True, "1")
    assert {(r["slug"], r["phone"], r["listing_type"]) for r in one["created"].collect()} == {("new", "9", "daycare")}
    assert {r["ord"]: r["outcome"] for r in one["outcomes"].collect()} == {1: "updated (matched by place ID)", 2: "created", 4: "updated (matched by name only)"}
    assert {r["ord"]: r["outcome"] for r in one["skipped"].collect()} == {5: "skipped (no name)", 6: "skipped (excluded area: Bahria Town)"}
    # the same batch once more finds what it made
    made = one["created"].withColumn("id", F.lit(2).cast("long")).select("id", "slug", *[c for c in items.columns if c not in ("ord",)])
    both = one["updated"].unionByName(made, allowMissingColumns=True)
    again = merge.import_batch(items, both, ("Bahria Town",))
    assert again["created"].count() == 0 and again["updated"].count() == 2


def test_cities(spark):
    city = spark.createDataFrame([("lahore",)], "slug string")
    names = spark.createDataFrame([("Lahore",), ("New City",), ("",)], "name string")
    assert [tuple(r) for r in merge.missing_cities(names, city).collect()] == [("new-city", "New City")]


def test_cards(spark):
    images = spark.createDataFrame([(1, 2, "b", ""), (1, 1, "a", "x"), (1, 0, "", "")], "listing_id int, order int, image string, alt string")
    assert serve.shown_images(images).first()["og_image"] == "a"
    reviews = spark.createDataFrame([(1, "", 3, "t"), (2, None, None, None)], "review_id int, author string, rating int, text string")
    assert [tuple(r)[1:3] for r in serve.review_cards(reviews).collect()] == [("Anonymous", "★★★"), ("Anonymous", "")]


def test_cli(spark, tmp_path):
    from placeweave.cli import main

    listing(spark, dict(id=1, name="Legacy", place_id="0x1:0x2"), dict(id=2, slug="b", place_id="0x1:0x2")).write.parquet(str(tmp_path / "listing.parquet"))
    spark.createDataFrame([(1, "Here", "here", "")], "id long, name string, slug string, meta_description string").write.parquet(str(tmp_path / "city.parquet"))
    spark.createDataFrame([(1, 1, "Ann", "old"), (2, 2, "Bob", "old"), (3, 2, "Cy", "old")], "review_id long, listing_id long, author string, text string").write.parquet(str(tmp_path / "review.parquet"))
    (tmp_path / "raw.json").write_text('[{"name": "Legacy", "place_id": "0x1:0x2", "reviews": [{"author": "Di", "text": "new"}]}, {"name": "New", "reviews": [{"author": "Ed"}, {"text": " "}, {"rating": 3}]}, {"phone": "1"}]')
    (tmp_path / "plan.txt").write_text("[keywords]\ndaycare\n[areas]\nF-7\nF-8\n")
    data, out, kept = ["--data", str(tmp_path)], str(tmp_path / "o"), str(tmp_path / "d")
    for _ in range(2):  # the same import again leaves the same
        got = main(["import", "--file", str(tmp_path / "raw.json"), "--city", "Here", "--out", out, *data], spark)
    assert {r["outcome"]: r["n"] for r in got.collect()} == {"updated (matched by place ID)": 1, "created": 1, "skipped (no name)": 1}
    assert {(r["id"], r["slug"], r["is_active"]) for r in read.table(spark, out, "listing").collect()} == {(1, "a", True), (2, "b", True), (3, "new", True)}
    assert {(r["listing_id"], r["author"], r["text"]) for r in read.table(spark, out, "review").collect()} == {(1, "Di", "new"), (2, "Bob", "old"), (2, "Cy", "old"), (3, "Ed", None), (3, None, " ")}
    assert main(["dedupe", "--out", kept, *data], spark).first()["surplus"] == 1
    assert [r["id"] for r in read.table(spark, kept, "listing").collect()] == [1]
    assert {(r["listing_id"], r["author"]) for r in read.table(spark, kept, "review").collect()} == {(1, "Bob"), (1, "Cy")}
    assert [tuple(r) for r in read.table(spark, kept, "redirect").collect()] == [("/here/b/detail/", "/here/a/detail/")]
    assert main(["plan", "--file", str(tmp_path / "plan.txt"), "--out", str(tmp_path / "t")], spark).first()["area_tasks"] == 2


def test_stream_stops(spark, tmp_path):
    """A missing version is an error; a stop file and a deadline end the stream."""
    schema = "place_key string, task_key string, ord long"
    for n in range(2):
        spark.createDataFrame([("p", f"t{n}", n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder, check = str(tmp_path / "state"), str(tmp_path / "check")
    crawl_stream.run(stream, folder, check, max_hours=6 / 3600, every=0.2)
    assert crawl_stream.latest(spark, folder).first()["found_by"] == ["t0", "t1"]
    (tmp_path / "STOP").write_text("")
    crawl_stream.run(stream, folder, check, stop_file=str(tmp_path / "STOP"), every=0.2)
    shutil.rmtree(folder)
    spark.createDataFrame([("p", "t9", 9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="is missing"):
        crawl_stream.run(stream, folder, check)


def test_sinks_replace(spark, tmp_path):
    path = str(tmp_path / "x")
    write.write_json(spark.range(3), path)
    write.write_json(spark.range(2), path)
    assert spark.read.json(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["x"]
    rows = spark.createDataFrame([(1, ["a"], {"d": "t"}, [("u", "", "f")])], "id int, categories array<string>, hours map<string,string>, images array<struct<url:string,alt:string,file:string>>").withColumn("reviews", F.array(F.struct(F.lit("x").alias("author"))))
    write.write_csv(rows, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_bytes().decode("utf-8")
    assert text.startswith("\ufeffid,") and text.count("\n") == 2


def test_boundary(spark, tmp_path):
    path = tmp_path / "b.geojson"
    path.write_text('{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}}')
    polygons = read.boundary(spark, str(path))
    row = spark.createDataFrame([([(5.0, 5.0), (1.0, 1.0)],)], "c array<struct<lat:double,lng:double>>")
    from placeweave.functions import geo

    assert tuple(row.select(geo.first_inside(F.col("c"), polygons).alias("f")).first()["f"]) == (1.0, 1.0)
    assert read.tolerant(spark.createDataFrame([("a", 1)], "name string, other int")).columns == RAW_PLACE.names
