"""Queries of the directory's own operators over the test tables, each with its SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeweave.functions import geo, text
from placeweave.operators import area as areas
from placeweave.operators import classify, crawl, dedupe, merge, report, serve
from placeweave.plans import tasks
from placeweave.plans.config import Plan
from placeweave.session import durable, short_list

CITY, AREA, Q = "zarwanabad", "tamarookh", "little"
KEYWORDS = ["daycare", "montessori", "nursery"]
BOX, STEP_KM = (30.80, 69.30, 31.05, 69.60), 2.5
#: An outline with a hole, in the first city.
OUTLINE = [[[(69.30, 30.78), (69.60, 30.80), (69.58, 31.04), (69.45, 31.08), (69.31, 30.99)], [(69.40, 30.88), (69.46, 30.88), (69.46, 30.93), (69.40, 30.93)]]]
SCOPE = classify.Scope("Zarwanabad", None, ("Norvela Phase 2", "Kharmeez"))

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of (spark, load) -> DataFrame under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def places(load):
    return load("listing"), load("city"), load("area")


#: Fields that a raw place brings, with the column they stand in; how a value is missing and how it is compared.
BROUGHT = {f: {"maps_url": "google_maps_url"}.get(f, f) for f in ("name", "listing_type", "address", "phone", "website", "description", "rating", "review_count", "latitude", "longitude", "categories", "hours", "maps_url")}
NUMBERS, LISTS = ("rating", "review_count", "latitude", "longitude"), ("categories", "hours")


def full_sql(f: str, x: str) -> str:
    if f in NUMBERS:
        return f"({x} IS NOT NULL AND {x} <> 0)"
    return f"coalesce({'len' if f == 'categories' else 'cardinality'}({x}), 0) > 0" if f in LISTS else f"coalesce({x}, '') <> ''"


def shown_sql(f: str, x: str) -> str:
    return f"array_to_string({x}, '|')" if f == "categories" else f"array_to_string(list_sort(list_transform(map_entries({x}), lambda e: e.key || '=' || coalesce(e.value, ''))), '|')" if f == "hours" else x


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Lists and maps as text, in one order."""
    hours = F.array_join(F.array_sort(F.transform(F.map_entries("hours"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "|")
    return rows.select(*[F.array_join(c, "|").alias(c) if c in ("categories", "locked_fields") else hours.alias(c) if c == "hours" else F.col(c) for c in columns])


ACTIVE = "listing l LEFT JOIN city c ON c.id = l.city_id LEFT JOIN area a ON a.id = l.area_id WHERE l.is_active"


@query(f"""SELECT l.id, l.name, a.name AS area_name, l.rating FROM {ACTIVE} AND c.slug = '{CITY}' AND
    (contains(lower(coalesce(l.name, '')), '{Q}') OR contains(lower(coalesce(l.description, '')), '{Q}') OR contains(lower(coalesce(l.address, '')), '{Q}'))""")
def city_page_search(spark, load):
    return serve.city_page(*places(load), CITY, q=f" {Q.title()} ", sort="rating").select("id", "name", "area_name", "rating")


@query(f"SELECT l.id, l.name, l.review_count FROM {ACTIVE} AND c.slug = '{CITY}' AND a.slug = '{AREA}'")
def city_page_area(spark, load):
    return serve.city_page(*places(load), CITY, area_slug=AREA, sort="reviews").select("id", "name", "review_count")


@query(f"SELECT l.id, l.slug, l.rating FROM {ACTIVE} AND a.slug = '{AREA}' AND a.city_id = (SELECT id FROM city WHERE slug = '{CITY}')")
def area_page(spark, load):
    return serve.area_page(*places(load), CITY, AREA).select("id", "slug", "rating")


@query(f"SELECT l.id, l.slug, l.phone, l.rating FROM {ACTIVE} AND c.slug = '{CITY}' AND l.slug = (SELECT min(slug) FROM listing WHERE is_active AND city_id = 1)")
def listing_detail(spark, load):
    listing = load("listing")
    slug = listing.where("is_active AND city_id = 1").agg(F.min("slug")).first()[0]
    return serve.detail(listing, load("city"), CITY, slug).select("id", "slug", "phone", "rating")


@query("""WITH x AS (SELECT id, area_id, rating FROM listing WHERE is_active),
    t AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY rating DESC NULLS LAST, id) AS r FROM x),
    p AS (SELECT x.id, t.id AS similar_id, t.r FROM x JOIN (SELECT * FROM t WHERE r <= 5) t ON x.area_id IS NOT DISTINCT FROM t.area_id AND x.id <> t.id),
    q AS (SELECT id, similar_id, CAST(row_number() OVER (PARTITION BY id ORDER BY r) AS INTEGER) AS rank FROM p)
    SELECT id, rank, similar_id FROM q WHERE rank <= 4""")
def similar_top4(spark, load):
    return serve.similar(load("listing"))


@query(f"""SELECT l.id, l.name, c.name AS city_name, a.name AS area_name FROM {ACTIVE} AND
    (contains(lower(coalesce(l.name, '')), 'garden') OR contains(lower(coalesce(l.address, '')), 'garden') OR contains(lower(coalesce(a.name, '')), 'garden'))
    ORDER BY l.is_featured DESC NULLS LAST, l.rating DESC NULLS LAST, l.review_count DESC NULLS LAST, l.id LIMIT 10""")
def live_search_top10(spark, load):
    return serve.live_search(*places(load), "Garden").select("id", "name", "city_name", "area_name")


@query(f"SELECT l.id, l.name, c.name AS city_name FROM {ACTIVE} AND l.is_featured ORDER BY l.rating DESC NULLS LAST, l.review_count DESC NULLS LAST, l.id LIMIT 6")
def featured_top6(spark, load):
    return serve.featured(*places(load)).select("id", "name", "city_name")


@query("SELECT a.id, a.name, CAST(count(l.id) AS BIGINT) AS n FROM area a LEFT JOIN listing l ON l.area_id = a.id GROUP BY 1, 2")
def area_counts(spark, load):
    return serve.counts_by(load("listing"), load("area"), "area_id")


@query("SELECT a.id, a.name, CAST(count(l.id) AS BIGINT) AS n FROM city a LEFT JOIN listing l ON l.city_id = a.id GROUP BY 1, 2")
def city_counts(spark, load):
    return serve.counts_by(load("listing"), load("city"), "city_id")


@query("SELECT * FROM (SELECT city_id, CAST(row_number() OVER (PARTITION BY city_id ORDER BY name, id) AS INTEGER) AS rank, name FROM area) WHERE rank <= 5")
def first_areas(spark, load):
    return serve.first_areas(load("area"))


@query("SELECT id, name FROM area WHERE city_id = (SELECT city_id FROM area WHERE id = 83) AND id <> 83")
def other_areas(spark, load):
    return serve.other_areas(load("area"), 83).select("id", "name")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY rating DESC NULLS LAST, review_id) AS r FROM review WHERE listing_id IS NOT NULL)
    SELECT l.id, coalesce(string_agg(CAST(t.review_id AS VARCHAR), ',' ORDER BY t.r), '') AS review_ids FROM listing l LEFT JOIN t ON t.listing_id = l.id AND t.r <= 5 GROUP BY 1""")
def listing_reviews_top5(spark, load):
    rows = serve.with_reviews(load("listing"), load("review"))
    return rows.select("id", F.array_join(F.transform("reviews", lambda r: r["review_id"].cast("string")), ",").alias("review_ids"))


@query("""SELECT '/' || p || '/' AS path, 'yearly' AS changefreq, 0.3::DOUBLE AS priority FROM (VALUES ('about'), ('privacy'), ('contact')) v(p)
    UNION ALL SELECT '/' || slug || '/', 'weekly', 0.9::DOUBLE FROM city
    UNION ALL SELECT '/' || c.slug || '/' || a.slug || '/', 'weekly', 0.8::DOUBLE FROM area a JOIN city c ON c.id = a.city_id
    UNION ALL SELECT '/' || c.slug || '/' || l.slug || '/detail/', 'monthly', 0.7::DOUBLE FROM listing l JOIN city c ON c.id = l.city_id WHERE l.is_active""")
def sitemap_union(spark, load):
    return serve.sitemap(*places(load))


@query("""SELECT l.id, split_part(coalesce(l.address, ''), ',', 1) AS short_address,
    CASE WHEN a.name IS NOT NULL AND l.sub_area <> '' THEN l.sub_area || ', ' || a.name ELSE coalesce(a.name, c.name, '') END AS location_label,
    CAST(round_even(coalesce(l.rating, 0), 0) AS INTEGER) AS rating_stars, repeat('★', CAST(round_even(coalesce(l.rating, 0), 0) AS INTEGER)) AS stars,
    coalesce(left(nullif(l.description, ''), 155), coalesce(l.name, '') || ' is a daycare in ' || coalesce(l.address, '') || '. Rating: ' || CAST(l.rating AS VARCHAR) || '/5 from ' || l.review_count || ' reviews.') AS meta_desc
    FROM listing l LEFT JOIN city c ON c.id = l.city_id LEFT JOIN area a ON a.id = l.area_id""")
def labels_projection(spark, load):
    return serve.labels(serve.with_place(*places(load))).select("id", "short_address", "location_label", "rating_stars", "stars", "meta_desc")


def all_images(load):
    """Images of the raw places, each of the listing with the place's number."""
    return load("raw_place").select(F.col("raw_id").alias("listing_id"), F.posexplode("images").alias("pos", "i")).select("listing_id", "pos", "i.url", "i.alt", "i.file")


@query("""WITH o AS (SELECT raw_id AS id, list_filter(images, lambda i: coalesce(i.file, '') <> '')[1].file AS image FROM raw_place)
    SELECT l.id, 'ChildCare' AS kind, l.name, CASE WHEN length(l.description) > 200 THEN left(l.description, 199) || '…' ELSE l.description END AS description, l.address AS street, c.name AS locality,
      nullif(l.phone, '') AS telephone, nullif(l.website, '') AS url, CASE WHEN l.rating <> 0 THEN CAST(l.rating AS VARCHAR) END AS rating, CASE WHEN l.rating <> 0 THEN CAST(l.review_count AS VARCHAR) END AS reviews,
      CASE WHEN l.latitude <> 0 THEN l.latitude END AS latitude, o.image, c.name || ', Pakistan' AS served
    FROM listing l LEFT JOIN city c ON c.id = l.city_id LEFT JOIN o ON o.id = l.id""")
def structured_data(spark, load):
    images = serve.shown_images(all_images(load).select("listing_id", F.col("pos").alias("order"), F.col("file").alias("image"), "alt"))
    rows = serve.structured_data(serve.with_place(*places(load)), images)
    paths = {"kind": "@type", "name": "name", "description": "description", "street": "address.streetAddress", "locality": "address.addressLocality", "telephone": "telephone", "url": "url", "rating": "aggregateRating.ratingValue",
             "reviews": "aggregateRating.reviewCount", "latitude": "geo.latitude", "image": "image", "served": "areaServed"}
    members = {n: F.get_json_object("json", f"$['{p}']" if p[0] == "@" else f"$.{p}") for n, p in paths.items()}
    return rows.select("id", *[(c.cast("double") if n == "latitude" else c).alias(n) for n, c in members.items()])


@query(f"SELECT count(*) AS n FROM {ACTIVE} AND c.slug = '{CITY}' AND a.slug = '{AREA}'")
def page_count(spark, load):
    return serve.city_page(*places(load), CITY, area_slug=AREA).agg(F.count("*").alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with their place in the order they come in; for pages, which are short."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("ord", F.row_number().over(Window.orderBy("_at"))).drop("_at")


PAGE_ORDERS = {"rating": "l.rating DESC NULLS LAST", "reviews": "l.review_count DESC NULLS LAST", "name": "l.name NULLS FIRST", "other": "l.is_featured DESC NULLS LAST"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS sort, CAST(row_number() OVER (ORDER BY {o}, l.rating DESC NULLS LAST, l.id) AS INTEGER) AS ord, l.id FROM {ACTIVE} AND c.slug = '{CITY}'" for k, o in PAGE_ORDERS.items()))
def page_orders(spark, load):
    parts = [in_order(serve.city_page(*places(load), CITY, sort=k).select("id")).select(F.lit(k).alias("sort"), "ord", "id") for k in PAGE_ORDERS]
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"""SELECT 'area page' AS page, CAST(row_number() OVER (ORDER BY l.is_featured DESC NULLS LAST, l.rating DESC NULLS LAST, l.id) AS INTEGER) AS ord, l.id FROM {ACTIVE} AND a.slug = '{AREA}' AND a.city_id = (SELECT id FROM city WHERE slug = '{CITY}')
    UNION ALL SELECT 'other areas', CAST(row_number() OVER (ORDER BY name, id) AS INTEGER), id FROM area WHERE city_id = (SELECT city_id FROM area WHERE id = 83) AND id <> 83""")
def area_orders(spark, load):
    page, others = serve.area_page(*places(load), CITY, AREA), serve.other_areas(load("area"), 83)
    return in_order(page.select("id")).select(F.lit("area page").alias("page"), "ord", "id").unionByName(in_order(others.select("id")).select(F.lit("other areas").alias("page"), "ord", "id"))


@query("SELECT review_id, coalesce(nullif(author, ''), 'Anonymous') AS author, repeat('★', CAST(coalesce(rating, 0) AS INTEGER)) AS stars, text FROM review")
def review_cards(spark, load):
    return serve.review_cards(load("review"))


@query("""WITH r AS (SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY rating DESC NULLS LAST, review_id) AS r, review_id FROM review WHERE listing_id IS NOT NULL)
    SELECT l.id, coalesce(string_agg(CAST(r.review_id AS VARCHAR), ',' ORDER BY r.r), '') AS review_ids FROM listing l LEFT JOIN r ON r.listing_id = l.id GROUP BY 1""")
def listing_reviews(spark, load):
    rows = serve.with_reviews(load("listing"), load("review"), None)
    return rows.select("id", F.array_join(F.transform("reviews", lambda r: r["review_id"].cast("string")), ",").alias("review_ids"))


@query("""WITH i AS (SELECT raw_id, unnest(images) AS i, generate_subscripts(images, 1) AS pos FROM raw_place), k AS (SELECT DISTINCT i.file AS file FROM i JOIN raw_place p USING (raw_id) WHERE NOT coalesce(p.closed, false)),
    f AS (SELECT raw_id AS listing_id, CAST(row_number() OVER (PARTITION BY raw_id ORDER BY pos) - 1 AS INTEGER) AS ord, i.url AS url, i.file AS file FROM i WHERE i.file <> '' AND i.file IN (SELECT file FROM k WHERE file IS NOT NULL))
    SELECT listing_id, ord, (ord + 1) || regexp_extract(file, '([.][^./]+)$', 1) AS name, url FROM f""")
def photo_numbers(spark, load):
    return merge.numbered_photos(all_images(load), photo_files(load)).select("listing_id", "ord", "name", "url")


def photo_files(load):
    """The files there are: those of places that aren't closed."""
    return load("raw_place").where("NOT coalesce(closed, false)").select(F.explode("images.file").alias("file"))


@query("""WITH i AS (SELECT raw_id, unnest(images) AS i FROM raw_place), k AS (SELECT DISTINCT i.file AS file FROM i JOIN raw_place p USING (raw_id) WHERE NOT coalesce(p.closed, false) AND i.file IS NOT NULL)
    SELECT count(*) FILTER (WHERE i.file <> '' AND i.file IN (SELECT file FROM k)) AS imported, count(*) FILTER (WHERE NOT coalesce(i.file <> '' AND i.file IN (SELECT file FROM k), false)) AS skipped FROM i""")
def photo_counts(spark, load):
    images = all_images(load)
    return merge.skipped_photos(images, merge.numbered_photos(images, photo_files(load)))


@query("""SELECT id, name FROM listing WHERE listing_type = 'preschool' AND
    (contains(lower(coalesce(name, '')), 'kids') OR contains(lower(coalesce(address, '')), 'kids') OR contains(lower(coalesce(phone, '')), 'kids') OR contains(lower(coalesce(name, '')), 'house') OR contains(lower(coalesce(address, '')), 'house') OR contains(lower(coalesce(phone, '')), 'house'))
    AND (contains(lower(coalesce(name, '')), '039') OR contains(lower(coalesce(address, '')), '039') OR contains(lower(coalesce(phone, '')), '039'))
    AND (contains(lower(coalesce(name, '')), 'house') OR contains(lower(coalesce(address, '')), 'house') OR contains(lower(coalesce(phone, '')), 'house'))""")
def admin_search(spark, load):
    return serve.admin_search(load("listing"), "House  039", ["name", "address", "phone"], {"listing_type": "preschool"}).select("id", "name")


@query("""SELECT 'listing_type' AS facet, listing_type AS value, count(*) AS n FROM listing GROUP BY 2
    UNION ALL SELECT 'city_id', CAST(city_id AS VARCHAR), count(*) FROM listing GROUP BY 2 UNION ALL SELECT 'is_active', CAST(is_active AS VARCHAR), count(*) FROM listing GROUP BY 2""")
def facet_counts(spark, load):
    return serve.facet_counts(load("listing"), ["listing_type", "city_id", "is_active"])


@query("""SELECT id, CASE WHEN regexp_full_match(coalesce(place_id, ''), '0x[0-9a-f]+:0x[0-9a-f]+') THEN place_id ELSE regexp_extract(coalesce(maps_url, ''), '!1s(0x[0-9a-f]+:0x[0-9a-f]+)', 1) END AS fid,
    coalesce(TRY_CAST(regexp_extract(coalesce(maps_url, ''), '!3d(-?[0-9]+\\.[0-9]+)!4d(-?[0-9]+\\.[0-9]+)', 1) AS DOUBLE), TRY_CAST(regexp_extract(coalesce(maps_url, ''), '@(-?[0-9]+\\.[0-9]+),(-?[0-9]+\\.[0-9]+)', 1) AS DOUBLE), 0) AS lat,
    coalesce(TRY_CAST(regexp_extract(coalesce(maps_url, ''), '!3d(-?[0-9]+\\.[0-9]+)!4d(-?[0-9]+\\.[0-9]+)', 2) AS DOUBLE), TRY_CAST(regexp_extract(coalesce(maps_url, ''), '@(-?[0-9]+\\.[0-9]+),(-?[0-9]+\\.[0-9]+)', 2) AS DOUBLE), 0) AS lng FROM listing""")
def url_fields(spark, load):
    pin = text.pin("maps_url")
    return load("listing").select("id", text.place_id("place_id", "maps_url").alias("fid"), pin["lat"].alias("lat"), pin["lng"].alias("lng"))


@query("""SELECT raw_id, CASE WHEN coalesce(place_id, '') <> '' THEN place_id ELSE coalesce(name, '') || '|' || coalesce(address, '') END AS entity_key,
    CASE WHEN coalesce(place_id, '') <> '' THEN replace(place_id, ':', '_') ELSE 'noid_' || left(sha1(coalesce(name, '') || '|' || coalesce(address, '')), 16) END AS folder FROM raw_place""")
def entity_keys(spark, load):
    rows = load("raw_place").select("raw_id", "place_id", text.entity_key("place_id", "name", "address").alias("entity_key"))
    return rows.select("raw_id", "entity_key", text.folder("place_id", "entity_key").alias("folder"))


@query("""WITH p AS (SELECT raw_id, list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM raw_place),
    b AS (SELECT raw_id, regexp_replace(array_to_string(parts, ','), '(?i)((^|,)(pakistan|[0-9]{4,6}))+$', '') AS body FROM p)
    SELECT raw_id, trim(regexp_replace(regexp_replace(list_extract(string_split(body, ','), -1), '\\s*[0-9]{4,6}$', ''), ' Capital Territory$', ''), ' ') AS city FROM b""")
def address_city(spark, load):
    return load("raw_place").select("raw_id", text.address_city("address").alias("city"))


def sector_sql(source: str) -> str:
    """CTE s of texts (raw_id, f, t): sector and sub, by all mentions with their whole digits, which are judged afterwards."""
    return f"""t AS (SELECT raw_id, f, regexp_extract_all(regexp_replace(t, '\\b[2-9CFGHJMPQRVWX]{{4,8}}\\+[2-9CFGHJMPQRVWX]{{0,3}}\\b', ' ', 'g'), '(?:^|[^A-Za-z0-9])([B-I]\\s?-?\\s?[0-9]+(?:\\s?[/-]\\s?[0-9]+)?)', 1) AS l FROM ({source})),
      x AS (SELECT raw_id, f, list_filter(list_transform(l, lambda x: {{'s': x[1], 'n': regexp_extract(x, '([0-9]+)', 1), 'u': regexp_extract(x, '^[B-I]\\s?-?\\s?[0-9]+\\s?[/-]\\s?([0-9]+)$', 1)}}), lambda m: len(m.n) <= 2 AND TRY_CAST(m.n AS INTEGER) BETWEEN 5 AND 18) AS l FROM t),
      y AS (SELECT raw_id, f, coalesce(list_filter(l, lambda m: m.u IN ('1', '2', '3', '4'))[1], l[-1]) AS b FROM x),
      s AS (SELECT raw_id, f, coalesce(b.s || '-' || CAST(CAST(b.n AS INTEGER) AS VARCHAR), '') AS sector, CASE WHEN b.u IN ('1', '2', '3', '4') THEN b.s || '-' || CAST(CAST(b.n AS INTEGER) AS VARCHAR) || '/' || b.u ELSE '' END AS sub FROM y)"""


@query(f"WITH {sector_sql("SELECT raw_id, 'a' AS f, coalesce(address, '') AS t FROM raw_place")} SELECT raw_id, sector, sub FROM s")
def sector_extract(spark, load):
    return load("raw_place").select("raw_id", text.sector("address").alias("s")).select("raw_id", "s.*")


def form_sql(form: str) -> str:
    """A form of AREA_FORMS where word boundaries know all letters: a letter or digit outside the form's own ends is none."""
    own = form.removeprefix("\\b").removesuffix("\\b")
    return f"nullif(regexp_extract(coalesce(address, ''), '(?i)(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{own})(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1), '')"


@query(f"SELECT raw_id, coalesce({', '.join(map(form_sql, text.AREA_FORMS))}, '') AS f_area FROM raw_place")
def first_form(spark, load):
    return load("raw_place").select("raw_id", text.first_form("address").alias("f_area"))


@query("""SELECT raw_id, trim(regexp_replace(regexp_replace(name, '[\\x{E000}-\\x{F8FF}]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS cleaned,
    contains(lower(coalesce(address, '')), 'kharmeez') OR contains(lower(coalesce(address, '')), 'norvela phase 2') AS out FROM raw_place""")
def clean_and_exclude(spark, load):
    return load("raw_place").select("raw_id", text.clean("name").alias("cleaned"), classify.excluded(F.col("address"), SCOPE.exclude).isNotNull().alias("out"))


def slug_sql(x: str, most: int, fallback: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9_\\s-]', '', 'g'), ' '), '[-\\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')"
    return f"coalesce(nullif(left({bare}, {most}), ''), '{fallback}')"


SAID = """trim(regexp_replace(regexp_replace(list_extract(string_split(regexp_replace(array_to_string(list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> ''), ','),
    '(?i)((^|,)(pakistan|[0-9]{4,6}))+$', ''), ','), -1), '\\s*[0-9]{4,6}$', ''), ' Capital Territory$', ''), ' ')"""
#: Raw places with the city_id of their row, as homed() gives it.
HOMED = f"""named AS (SELECT *, {slug_sql("city", 100, "")} AS own, {slug_sql(SAID, 100, "")} AS said FROM raw_place),
    fresh AS (SELECT own, (SELECT max(id) FROM city) + row_number() OVER (ORDER BY own) AS new_id FROM (SELECT DISTINCT {slug_sql("trim(city, ' ')", 100, "")} AS own FROM raw_place) WHERE own <> '' AND own NOT IN (SELECT slug FROM city)),
    h AS (SELECT n.* EXCLUDE (own, said), coalesce(a.id, b.id, f.new_id, 0) AS city_id FROM named n LEFT JOIN city a ON a.slug = n.own LEFT JOIN city b ON b.slug = n.said LEFT JOIN fresh f ON f.own = n.own)"""


@query(f"""WITH RECURSIVE {HOMED}, s AS (SELECT raw_id, city_id, {slug_sql("name", 290, "daycare")} AS base FROM h),
    k AS (SELECT *, regexp_replace(base, '(-[1-9][0-9]*)+$', '') AS family FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY city_id, family ORDER BY raw_id) AS i FROM k),
    old AS (SELECT city_id, regexp_replace(slug, '(-[1-9][0-9]*)+$', '') AS family, list(DISTINCT slug) AS taken FROM listing GROUP BY 1, 2),
    r AS (SELECT f.city_id, f.family, 0 AS i, coalesce(old.taken, []) AS taken, 0::BIGINT AS raw_id, '' AS slug FROM (SELECT DISTINCT city_id, family FROM o) f LEFT JOIN old ON old.city_id = f.city_id AND old.family = f.family
      UNION ALL SELECT city_id, family, i, list_append(taken, slug), raw_id, slug FROM (SELECT o.city_id, o.family, o.i, r.taken, o.raw_id,
        list_filter(list_transform(range(0, len(r.taken) + 1), lambda n: CASE WHEN n = 0 THEN o.base ELSE o.base || '-' || n END), lambda x: NOT list_contains(r.taken, x))[1] AS slug
        FROM r JOIN o ON o.city_id = r.city_id AND o.family = r.family AND o.i = r.i + 1))
    SELECT raw_id, slug FROM r WHERE i > 0""")
def slugs(spark, load):
    rows = durable(homed(load).select("raw_id", "city_id", text.slugify("name").alias("base")))
    return merge.unique_slugs(rows, load("listing").select("city_id", "slug"), order="raw_id").select("raw_id", "slug")


@query("""SELECT 'area:' || a.name || '|' || k.k AS key, k.k || ' in ' || a.name || ' Zarwanabad' AS query FROM area a, (VALUES ('daycare'), ('montessori'), ('nursery')) k(k) WHERE a.city_id = 1""")
def task_cross_product(spark, load):
    names = load("area").where("city_id = 1").select(F.col("id").alias("ord"), F.col("name").alias("area"))
    return tasks.area_tasks(KEYWORDS, names, "Zarwanabad").select("key", "query")


GRID = f"""WITH d AS (SELECT {STEP_KM} / 111.0::DOUBLE AS dy, {STEP_KM} / (111.32::DOUBLE * cos(radians(({BOX[0]} + {BOX[2]}) / 2))) AS dx),
    g AS (SELECT {BOX[0]}::DOUBLE + (y + 0.5) * dy AS lat, {BOX[1]}::DOUBLE + (x + 0.5) * dx AS lng FROM d, range(0, 60) a(y), range(0, 60) b(x))
    SELECT 'grid:' || k || '@' || format('{{:.4f}},{{:.4f}}', round(lat, 5), round(lng, 5)) AS key FROM g, (VALUES ('daycare'), ('nursery')) w(k) WHERE lat < {BOX[2]} AND lng < {BOX[3]}"""


@query(GRID)
def grid_tasks(spark, load):
    return tasks.grid_tasks(geo.grid_cells(spark, BOX, STEP_KM), ["daycare", "nursery"], 14).select("key")


@query("""WITH t AS (SELECT 'area:' || a.name || '|' || k.k AS key FROM area a, (VALUES ('daycare'), ('montessori'), ('nursery')) k(k) WHERE a.city_id = 1)
    SELECT key FROM t WHERE key NOT IN (SELECT unnest(found_by) FROM raw_place WHERE found_by IS NOT NULL)""")
def resume_tasks(spark, load):
    done = load("raw_place").select(F.explode("found_by").alias("key")).distinct()
    return tasks.remaining(task_cross_product(spark, load), done).select("key")


def edges(ring):
    return ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(ring, [ring[-1], *ring[:-1]]))


CROSS = "SELECT p.raw_id, count(*) % 2 = 1 AS hit FROM p JOIN (VALUES {}) e(x, y, u, v) ON (e.y > p.lat) <> (e.v > p.lat) AND p.lng < (e.u - e.x) * (p.lat - e.y) / (e.v - e.y) + e.x GROUP BY 1"


@query(f"""WITH p AS (SELECT raw_id, latitude AS lat, longitude AS lng FROM raw_place WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)),
    o AS ({CROSS.format(edges(OUTLINE[0][0]))}), h AS ({CROSS.format(edges(OUTLINE[0][1]))})
    SELECT p.raw_id, coalesce(o.hit, false) AND NOT coalesce(h.hit, false) AS inside FROM p LEFT JOIN o USING (raw_id) LEFT JOIN h USING (raw_id)""")
def point_in_polygon(spark, load):
    rows = load("raw_place").where("latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)")
    return rows.select("raw_id", geo.in_polygons(F.col("latitude"), F.col("longitude"), OUTLINE).alias("inside"))


VERDICT = """v AS (SELECT raw_id, coalesce(name, '') AS n, coalesce(address, '') AS ad, coalesce(trim(categories[1], ' '), '') AS cat, coalesce(closed, false) AS closed,
    list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM raw_place),
    b AS (SELECT *, lower(cat) AS lc, regexp_matches(n, '(?i)day\\s?care|child\\s?care|cr[eè]che') AS dn,
      trim(regexp_replace(regexp_replace(list_extract(string_split(regexp_replace(array_to_string(parts, ','), '(?i)((^|,)(pakistan|[0-9]{4,6}))+$', ''), ','), -1), '\\s*[0-9]{4,6}$', ''), ' Capital Territory$', ''), ' ') AS named,
      len(list_filter(string_split(ad, ','), lambda x: regexp_matches(trim(x, ' '), '(?i)(^|\\s)Zarwanabad(\\s+Capital Territory)?(\\s+[0-9]{4,6})?$'))) > 0 AS here FROM v),
    r AS (SELECT raw_id, lc, dn, CASE WHEN closed THEN 'permanently closed'
      WHEN contains(lower(ad), 'norvela phase 2') THEN 'excluded area (Norvela Phase 2)' WHEN contains(lower(ad), 'kharmeez') THEN 'excluded area (Kharmeez)'
      WHEN ad = '' THEN 'no address or location' WHEN NOT here THEN 'outside Zarwanabad (' || coalesce(nullif(named, ''), 'unknown city') || ')'
      WHEN NOT (lc IN ('day care center', 'child care agency', 'childcare', 'creche', 'preschool', 'montessori preschool', 'montessori school', 'kindergarten', 'nursery school', 'playgroup')
        OR (lc IN ('school', 'educational institution', 'general education school', 'education center', 'school house', 'learning center', 'private educational institution')
          AND regexp_matches(n, '(?i)day\\s?care|child\\s?care|cr[eè]che|montessori|pre[\\s-]?school|nursery|kindergarten|play\\s?group|toddler|early\\s+(years|learning)')))
        THEN 'category: ' || coalesce(nullif(cat, ''), 'none')
      WHEN regexp_matches(n, '(?i)\\b(school\\s+systems?|systems?|campus|academy|college|grammar|high\\s+school|secondary|primary\\s+school|junior\\s+school|public\\s+school|international\\s+school|cadet|university)\\b') AND NOT dn THEN 'part of a school (name)'
      ELSE '' END AS reason FROM b)"""


INSIDE = f"""o AS ({CROSS.format(edges(OUTLINE[0][0]))}), hole AS ({CROSS.format(edges(OUTLINE[0][1]))}),
    inside AS (SELECT p.raw_id, coalesce(o.hit, false) AND NOT coalesce(hole.hit, false) AS hit FROM p LEFT JOIN o USING (raw_id) LEFT JOIN hole USING (raw_id))"""


@query(f"""WITH d AS (SELECT {STEP_KM} / 111.0::DOUBLE AS dy, {STEP_KM} / (111.32::DOUBLE * cos(radians(({BOX[0]} + {BOX[2]}) / 2))) AS dx),
    g AS (SELECT y * 1000 + x AS cell, dy, dx, {BOX[0]}::DOUBLE + (y + 0.5) * dy AS lat, {BOX[1]}::DOUBLE + (x + 0.5) * dx AS lng FROM d, range(0, 60) a(y), range(0, 60) b(x)),
    c AS (SELECT * FROM g WHERE lat < {BOX[2]} AND lng < {BOX[3]}), p AS (SELECT cell * 9 + (i + 1) * 3 + j + 1 AS raw_id, lat + i * dy / 2 AS lat, lng + j * dx / 2 AS lng FROM c, range(-1, 2) s(i), range(-1, 2) t(j)), {INSIDE}
    SELECT round(lat, 5) AS lat, round(lng, 5) AS lng FROM c WHERE cell IN (SELECT raw_id // 9 FROM inside WHERE hit)""")
def grid_clipped(spark, load):
    return geo.grid_cells(spark, BOX, STEP_KM, OUTLINE).select("lat", "lng")


def sweep_plan(load) -> Plan:
    plan = city_plan(load)
    plan.grid = {"bbox": ",".join(map(str, BOX)), "step_km": str(STEP_KM), "zoom": "14", "keywords": "daycare, nursery"}
    return plan


AREA_KEYS = "SELECT 'area:' || a.name || '|' || k.k AS key FROM area a, (VALUES ('daycare'), ('montessori'), ('nursery')) k(k) WHERE a.city_id = 1"


@query(f"{AREA_KEYS} UNION ALL ({GRID})")
def plan_tasks(spark, load):
    return tasks.build(spark, sweep_plan(load)).select("key")


@query(f"SELECT (SELECT count(*) FROM ({AREA_KEYS})) AS area_tasks, (SELECT count(*) FROM ({GRID})) AS grid_tasks")
def task_counts(spark, load):
    return tasks.counts(tasks.build(spark, sweep_plan(load)))


@query(f"SELECT key FROM ({AREA_KEYS} UNION ALL ({GRID})) WHERE key IN (SELECT unnest(found_by) FROM raw_place)")
def done_tasks(spark, load):
    done = load("raw_place").select(F.explode("found_by").alias("key")).distinct()
    return tasks.progress(tasks.build(spark, sweep_plan(load)), done).select("key")


def pinned_verdict() -> str:
    """VERDICT where the pin decides the place; a pin inside goes on to the categories, so the order of the cases is told apart."""
    by_place = "CASE WHEN pinned THEN CASE WHEN hit THEN '' ELSE 'outside Zarwanabad boundary' END WHEN ad = '' THEN 'no address or location' WHEN NOT here THEN 'outside Zarwanabad (' || coalesce(nullif(named, ''), 'unknown city') || ')' ELSE '' END"
    return (
        VERDICT.replace("FROM raw_place),\n    b AS", "FROM raw_place LEFT JOIN pins USING (raw_id)),\n    b AS").replace("SELECT raw_id, coalesce(name, '') AS n,", "SELECT raw_id, pins.raw_id IS NOT NULL AS pinned, coalesce(hit, false) AS hit, coalesce(name, '') AS n,")
        .replace("WHEN ad = '' THEN 'no address or location' WHEN NOT here THEN 'outside Zarwanabad (' || coalesce(nullif(named, ''), 'unknown city') || ')'", f"WHEN {by_place} <> '' THEN {by_place}")
    )


@query(f"""WITH p AS (SELECT raw_id, latitude AS lat, longitude AS lng FROM raw_place WHERE latitude <> 0 AND longitude <> 0), {INSIDE}, pins AS (SELECT raw_id, hit FROM inside), {pinned_verdict()}
    SELECT raw_id, CASE WHEN reason <> '' THEN '' WHEN dn OR lc IN ('day care center', 'child care agency', 'childcare', 'creche') THEN 'daycare' ELSE 'preschool' END AS listing_type, reason FROM r""")
def classify_pinned(spark, load):
    c = F.col
    rows = load("raw_place").select("raw_id", classify.verdict(c("name"), c("categories"), c("address"), c("closed"), c("latitude"), c("longitude"), classify.Scope(SCOPE.city, OUTLINE, SCOPE.exclude)).alias("v"))
    return rows.select("raw_id", "v.*")


@query(f"WITH {VERDICT} SELECT raw_id, CASE WHEN reason <> '' THEN '' WHEN dn OR lc IN ('day care center', 'child care agency', 'childcare', 'creche') THEN 'daycare' ELSE 'preschool' END AS listing_type, reason FROM r")
def classify_cascade(spark, load):
    c = F.col
    rows = load("raw_place").select("raw_id", classify.verdict(c("name"), c("categories"), c("address"), c("closed"), c("latitude"), c("longitude"), SCOPE).alias("v"))
    return rows.select("raw_id", "v.*")


@query(f"WITH {VERDICT} SELECT split_part(reason, ' (', 1) AS reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY 1")
def reject_reasons(spark, load):
    return report.reject_reasons(classify_cascade(spark, load).where("reason <> ''"))


def centre_rows(load):
    return load("area_centre").select(F.col("area_id").alias("ord"), "area", "lat", "lng")


KM = "6371 * sqrt(pow(radians(c.lng - p.longitude) * cos(radians((p.latitude + c.lat) / 2)), 2) + pow(radians(c.lat - p.latitude), 2))"


@query(f"""WITH d AS (SELECT p.raw_id, c.area, c.area_id, {KM} AS km FROM raw_place p, area_centre c WHERE c.lat IS NOT NULL AND c.lng IS NOT NULL AND p.latitude <> 0 AND p.longitude <> 0 AND NOT isnan(p.latitude) AND NOT isnan(p.longitude))
    SELECT raw_id, arg_min(area, (km, area_id)) AS area, round(min(km), 4) AS km FROM d WHERE km <= 1.5 GROUP BY 1""")
def nearest_area(spark, load):
    found = areas.nearest(load("raw_place"), centre_rows(load), "raw_id", "latitude", "longitude", 1.5)
    return found.select("raw_id", "area", F.round("km", 4).alias("km"))


def city_plan(load) -> Plan:
    """A plan of the first city's areas and aliases; both lists are short and fixed."""
    names = {r["id"]: r["name"] for r in short_list(load("area").where("city_id = 1").orderBy("id"), 1000)}
    plan = Plan("Zarwanabad", KEYWORDS, list(names.values()), area_match={"max_km": "1.5"})
    plan.aliases = {r["alias"]: names[r["area_id"]] for r in short_list(load("area_alias").orderBy("alias"), 1000) if r["area_id"] in names}
    return plan


NEAREST = f"""d AS (SELECT p.raw_id, c.area, c.area_id, {KM} AS km FROM raw_place p, area_centre c WHERE c.lat IS NOT NULL AND c.lng IS NOT NULL AND p.latitude <> 0 AND p.longitude <> 0 AND NOT isnan(p.latitude) AND NOT isnan(p.longitude)),
    pin AS (SELECT raw_id, arg_min(area, (km, area_id)) AS area FROM d WHERE km <= 1.5 GROUP BY 1)"""
#: Areas by the first of sector, name in the address, in the place's name, and the nearest centre; names are joined by their patterns.
ASSIGNED = f"""u AS (SELECT raw_id, 'a' AS f, coalesce(address, '') AS t FROM raw_place UNION ALL SELECT raw_id, 'n', coalesce(name, '') FROM raw_place), {sector_sql("SELECT * FROM u")},
    spelt AS (SELECT name AS n, name AS area, 0 AS k, id AS o FROM area WHERE city_id = 1 AND NOT regexp_full_match(name, '[B-I]-[0-9]{{1,2}}') UNION ALL SELECT alias, a.name, 1, row_number() OVER (ORDER BY alias) FROM area_alias JOIN area a ON a.id = area_id AND a.city_id = 1),
    forms AS (SELECT area, k, o, regexp_extract_all(lower(n), '[\\p{{L}}\\p{{N}}]+') AS w FROM spelt),
    names AS (SELECT area, '(^|[^a-z0-9])' || array_to_string(w, '[\\s\\-]*,?[\\s\\-]*') || '([^a-z0-9]|$)' AS form, row_number() OVER (ORDER BY len(array_to_string(w, '')) + 16 * (len(w) - 1) DESC, k, o) AS rank FROM forms WHERE len(w) > 0),
    m AS (SELECT raw_id, f, arg_min(area, rank) AS area FROM u JOIN names ON regexp_matches(lower(t), form) GROUP BY 1, 2),
    listed AS (SELECT name AS sector, name AS area FROM area WHERE city_id = 1 AND regexp_full_match(name, '[B-I]-[0-9]{{1,2}}') UNION SELECT alias, a.name FROM area_alias JOIN area a ON a.id = area_id AND a.city_id = 1 WHERE regexp_full_match(alias, '[B-I]-[0-9]{{1,2}}')),
    e AS (SELECT s.raw_id, s.f, CASE WHEN s.sector <> '' THEN coalesce(l.area, '') ELSE m.area END AS area, CASE WHEN s.sector <> '' THEN s.sub ELSE '' END AS sub_area,
      CASE WHEN l.area IS NOT NULL THEN 'sector' WHEN s.sector <> '' THEN '' WHEN m.area IS NOT NULL THEN 'name' END AS method, CASE WHEN s.sector <> '' AND l.area IS NULL THEN s.sector ELSE '' END AS unlisted
      FROM s LEFT JOIN listed l ON l.sector = s.sector LEFT JOIN m ON m.raw_id = s.raw_id AND m.f = s.f), {NEAREST},
    assigned AS (SELECT a.raw_id, CASE WHEN a.method IS NOT NULL THEN a.area WHEN coalesce(n.area, '') <> '' THEN n.area ELSE coalesce(pin.area, '') END AS area,
      CASE WHEN a.method IS NOT NULL THEN a.sub_area WHEN coalesce(n.area, '') <> '' THEN n.sub_area ELSE '' END AS sub_area,
      CASE WHEN a.method IS NOT NULL THEN a.method WHEN coalesce(n.area, '') <> '' THEN 'listing name (' || n.method || ')' WHEN pin.area IS NOT NULL THEN 'map pin' ELSE '' END AS method,
      CASE WHEN a.method IS NOT NULL THEN a.unlisted ELSE '' END AS unlisted_sector
      FROM (SELECT * FROM e WHERE f = 'a') a JOIN (SELECT * FROM e WHERE f = 'n') n USING (raw_id) LEFT JOIN pin USING (raw_id))"""


@query(f"WITH {ASSIGNED} SELECT * FROM assigned")
def area_assignment(spark, load):
    return areas.assign(load("raw_place"), areas.Matcher(city_plan(load)), centre_rows(load))


@query(f"WITH {ASSIGNED}, a AS (SELECT area, count(*) AS n FROM assigned WHERE area <> '' GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS ord, area.name AS area, coalesce(a.n, 0) AS n FROM area LEFT JOIN a ON a.area = area.name WHERE city_id = 1")
def area_report(spark, load):
    listed = spark.createDataFrame(list(enumerate(city_plan(load).areas)), "ord int, area string")
    return report.per_area(area_assignment(spark, load), listed)


@query(f"WITH {ASSIGNED} SELECT unlisted_sector AS sector, count(*) AS n FROM assigned WHERE unlisted_sector <> '' GROUP BY 1")
def unlisted_sectors(spark, load):
    return report.unlisted(area_assignment(spark, load))


@query(f"WITH {ASSIGNED} SELECT raw_id, coalesce(p.name, '') AS name, coalesce(p.address, '') AS address FROM assigned JOIN raw_place p USING (raw_id) WHERE assigned.area = ''")
def without_area(spark, load):
    return report.without_area(area_assignment(spark, load), load("raw_place"), "raw_id")


def run_stats(load):
    return load("raw_place").select(F.explode("found_by").alias("key")).groupBy("key").agg(F.count("*").alias("found"))


def found(load):
    return load("raw_place").select("raw_id", "name", "place_id", F.coalesce("found_by", F.array().cast("array<string>")).alias("found_by"))


PARTS = """k AS (SELECT raw_id, coalesce(nullif(place_id, ''), name) AS place, unnest(found_by) AS key FROM raw_place),
    p AS (SELECT *, split_part(key, ':', 1) AS method, CASE WHEN contains(key, ':') THEN substr(key, instr(key, ':') + 1) ELSE '' END AS rest FROM k),
    q AS (SELECT raw_id, place, key, method, CASE WHEN method = 'area' THEN CASE WHEN contains(rest, '|') THEN substr(rest, instr(rest, '|') + 1) ELSE '' END WHEN method = 'grid' THEN split_part(rest, '@', 1) ELSE rest END AS keyword,
      CASE WHEN method = 'area' THEN split_part(rest, '|', 1) ELSE '' END AS area FROM p)"""


@query(f"""WITH {PARTS}, s AS (SELECT method, keyword, count(DISTINCT key) AS searches, count(*) AS listed FROM q GROUP BY 1, 2),
    d AS (SELECT DISTINCT raw_id, method, keyword FROM q), a AS (SELECT raw_id, count(*) AS kinds FROM d GROUP BY 1),
    f AS (SELECT method, keyword, count(*) AS kept, count(*) FILTER (WHERE kinds = 1) AS "only" FROM d JOIN a USING (raw_id) GROUP BY 1, 2)
    SELECT method, keyword, searches, listed, coalesce(kept, 0) AS kept, coalesce("only", 0) AS "only" FROM s LEFT JOIN f USING (method, keyword)""")
def keyword_yield(spark, load):
    return report.keyword_yield(run_stats(load), found(load))


@query("SELECT count(*) AS n FROM raw_place WHERE len(found_by) > 0 AND len(list_filter(found_by, lambda x: x IS NULL OR NOT starts_with(x, 'grid:'))) = 0")
def only_grid(spark, load):
    return report.only_grid(found(load))


@query(f"WITH {PARTS} SELECT area, count(DISTINCT place) AS n FROM q WHERE method = 'area' AND starts_with(key, 'area:') GROUP BY 1")
def area_yield(spark, load):
    return report.area_yield(run_stats(load), found(load))


@query("SELECT coalesce(nullif(listing_type, ''), '?') AS listing_type, count(*) AS n FROM raw_place GROUP BY 1")
def kept_by_type(spark, load):
    return report.by_type(load("raw_place"))


@query("""WITH h AS (SELECT place_id, unnest(found_by) AS k, raw_id FROM raw_place WHERE place_id <> ''), o AS (SELECT place_id, k, min(raw_id) AS ord FROM h WHERE k IS NOT NULL GROUP BY 1, 2)
    SELECT place_id, string_agg(k, ' ' ORDER BY ord, k) AS found_by FROM o GROUP BY 1""")
def provenance(spark, load):
    hits = load("raw_place").where("place_id <> ''").select("place_id", F.explode("found_by").alias("task_key"), F.col("raw_id").alias("ord")).where("task_key IS NOT NULL")
    return crawl.provenance(hits, "place_id").select("place_id", F.array_join("found_by", " ").alias("found_by"))


@query(f"""WITH {VERDICT}, x AS (SELECT *, list_filter(coalesce(found_by, []), lambda k: k IS NOT NULL) AS keys FROM raw_place),
    h AS (SELECT raw_id, pos, CASE WHEN pos = 0 THEN 'none' ELSE keys[pos] END AS task_key, CASE WHEN coalesce(place_id, '') <> '' THEN place_id ELSE coalesce(name, '') || '|' || coalesce(address, '') END AS place
      FROM (SELECT *, unnest(CASE WHEN len(keys) = 0 THEN [0] ELSE list_filter(range(1, len(keys) + 1), lambda i: list_position(keys, keys[i]) = i) END) AS pos FROM x)),
    o AS (SELECT arg_min(task_key, (raw_id, pos)) AS task_key, min(raw_id) AS raw_id FROM h GROUP BY place), j AS (SELECT o.task_key, r.reason FROM o JOIN r USING (raw_id)),
    n AS (SELECT task_key, count(*) AS new, count(*) FILTER (WHERE reason = '') AS kept, count(*) FILTER (WHERE reason <> '') AS rejected FROM j GROUP BY 1), f AS (SELECT task_key, count(*) AS found FROM h GROUP BY 1)
    SELECT task_key, found, coalesce(new, 0) AS new, coalesce(kept, 0) AS kept, coalesce(rejected, 0) AS rejected FROM f LEFT JOIN n USING (task_key)""")
def crawl_fold(spark, load):
    return crawl.fold(all_hits(load), SCOPE)[2]


def all_hits(load):
    """A hit for each place and key of a raw row; rows without a key are found by none."""
    seen = ("name", "address", "categories", "closed", "latitude", "longitude", "place_id")
    keys = F.array_distinct(F.array_compact("found_by"))
    hits = load("raw_place").select("raw_id", *seen, F.posexplode_outer(keys).alias("pos", "key"))
    return hits.select(F.struct("raw_id", "pos").alias("ord"), F.coalesce("key", F.lit("none")).alias("task_key"), *seen)


def folded_sql(shown_: str, how: str) -> str:
    return f"""WITH {VERDICT}, x AS (SELECT *, list_distinct(list_filter(coalesce(found_by, []), lambda k: k IS NOT NULL)) AS keys, CASE WHEN coalesce(place_id, '') <> '' THEN place_id ELSE coalesce(name, '') || '|' || coalesce(address, '') END AS place FROM raw_place),
    k AS (SELECT place, count(DISTINCT key) AS tasks FROM (SELECT place, unnest(CASE WHEN len(keys) = 0 THEN ['none'] ELSE keys END) AS key FROM x) GROUP BY 1), o AS (SELECT place, min(raw_id) AS raw_id FROM x GROUP BY 1)
    SELECT o.place AS place_key, tasks, {shown_} FROM o JOIN k USING (place) JOIN r USING (raw_id) WHERE reason {how} ''"""


@query(folded_sql("CASE WHEN dn OR lc IN ('day care center', 'child care agency', 'childcare', 'creche') THEN 'daycare' ELSE 'preschool' END AS listing_type", "="))
def crawl_kept(spark, load):
    return crawl.fold(all_hits(load), SCOPE)[0].select("place_key", F.size("found_by").cast("long").alias("tasks"), "listing_type")


@query(folded_sql("reason", "<>"))
def crawl_rejected(spark, load):
    return crawl.fold(all_hits(load), SCOPE)[1].select("place_key", F.size("found_by").cast("long").alias("tasks"), "reason")


@query("""SELECT raw_id FROM raw_place WHERE coalesce(rating, 0) = 0 OR coalesce(len(reviews), 0) = 0 OR coalesce(len(list_filter(images, lambda i: coalesce(i.file, '') <> '')), 0) = 0
    OR coalesce(cardinality(hours), 0) = 0 OR coalesce(latitude, 0) = 0 OR NOT starts_with(coalesce(place_id, ''), '0x')""")
def needs_update(spark, load):
    raw = load("raw_place")
    return raw.where(crawl.needs_update(raw)).select("raw_id")


KEY = "CASE WHEN regexp_full_match(coalesce(place_id, ''), '0x[0-9a-f]+:0x[0-9a-f]+') THEN place_id ELSE nullif(regexp_extract(coalesce(maps_url, ''), '!1s(0x[0-9a-f]+:0x[0-9a-f]+)', 1), '') END"
GROUPS = f"""k AS (SELECT *, {KEY} AS place, coalesce(regexp_matches(slug, '-[0-9]+$'), false) AS low FROM listing), m AS (SELECT * FROM k WHERE place IS NOT NULL),
    g AS (SELECT city_id, place, arg_min(id, (low, id)) AS keeper_id, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) > 1)"""


@query(f"WITH {GROUPS} SELECT city_id, place, keeper_id, n FROM g")
def dedupe_clusters(spark, load):
    return dedupe.clusters(load("listing"))


def merged_sql() -> str:
    out = []
    for f in dedupe.MERGED:
        name, full = f.removesuffix("_id"), f"coalesce({f}, 0) <> 0" if f == "area_id" else full_sql(f, f)
        kept = f"arg_min(({f}, 1), (low, id))[1]"
        out.append(f"CASE WHEN bool_or(list_contains(coalesce(locked_fields, []), '{name}')) OR count(*) FILTER (WHERE {full}) = 0 THEN {kept} ELSE arg_max({f}, (coalesce(updated_at, TIMESTAMP '0001-01-01'), low, id)) FILTER (WHERE {full}) END AS {f}")
    flags = ", ".join(f"bool_or(coalesce({f}, false)) AS {f}" for f in ("is_verified", "is_featured", "is_active"))
    shown_ = ", ".join(f"{shown_sql(f, f)} AS {f}" for f in dedupe.MERGED)
    url = "nullif(regexp_extract(coalesce(v.maps_url, ''), '!1s(0x[0-9a-f]+:0x[0-9a-f]+)', 1), '')"
    return f"""WITH {GROUPS}, v AS (SELECT g.keeper_id AS id, {', '.join(out)}, {flags}, array_to_string(list_sort(list_distinct(flatten(list(coalesce(locked_fields, []))))), '|') AS locked_fields, max(last_seen_at) AS last_seen_at
      FROM m JOIN g ON g.city_id IS NOT DISTINCT FROM m.city_id AND g.place = m.place GROUP BY 1)
      SELECT v.id, {shown_.replace(' AS ', ' AS ')}, v.is_verified, v.is_featured, v.is_active, v.locked_fields, v.last_seen_at, CASE WHEN regexp_full_match(coalesce(k.own, ''), '0x[0-9a-f]+:0x[0-9a-f]+') THEN k.own ELSE {url} END AS place_id
      FROM v JOIN (SELECT id AS kid, place_id AS own FROM listing) k ON k.kid = v.id"""


@query(merged_sql())
def dedupe_survivorship(spark, load):
    return shown(dedupe.merged(load("listing")), "id", *dedupe.MERGED, "is_verified", "is_featured", "is_active", "locked_fields", "last_seen_at", "place_id")


@query(f"""WITH {GROUPS}, b AS (SELECT m.id, g.keeper_id FROM m JOIN g ON g.city_id IS NOT DISTINCT FROM m.city_id AND g.place = m.place),
    c AS (SELECT b.keeper_id, b.id, count(*) AS n FROM b JOIN review r ON r.listing_id = b.id GROUP BY 1, 2), s AS (SELECT keeper_id, arg_max(id, (n, id = keeper_id, -id)) AS source_id FROM c GROUP BY 1)
    SELECT r.review_id, coalesce(b.keeper_id, r.listing_id) AS listing_id FROM review r LEFT JOIN b ON b.id = r.listing_id LEFT JOIN s ON s.source_id = r.listing_id WHERE b.id IS NULL OR s.source_id IS NOT NULL""")
def dedupe_children(spark, load):
    return dedupe.moved_children(dedupe.members(load("listing")), load("review"), "listing_id").select("review_id", "listing_id")


@query(f"""WITH {GROUPS}, b AS (SELECT m.id, m.slug, c.slug AS city, g.keeper_id FROM m JOIN g ON g.city_id = m.city_id AND g.place = m.place JOIN city c ON c.id = m.city_id),
    v AS (SELECT '/' || b.city || '/' || b.slug || '/detail/' AS old_path, '/' || b.city || '/' || k.slug || '/detail/' AS new_path FROM b JOIN listing k ON k.id = b.keeper_id WHERE b.id <> b.keeper_id),
    e AS (SELECT '/old' || old_path AS old_path, old_path AS new_path FROM v UNION ALL SELECT '/stay/', '/about/')
    SELECT e.old_path, coalesce(v.new_path, e.new_path) AS new_path FROM e LEFT JOIN v ON v.old_path = e.new_path UNION ALL SELECT old_path, new_path FROM v""")
def dedupe_redirects(spark, load):
    listing, city = load("listing"), load("city")
    home = city.select(F.col("id").alias("city_id"), F.col("slug").alias("home"))
    path = serve.with_place(listing, city, load("area")).join(home, "city_id").select("id", serve.detail_path(F.col("home"), F.col("slug")).alias("path"))
    pairs = dedupe.members(listing).where("id <> keeper_id")
    moves = pairs.join(path.withColumnRenamed("path", "old_path"), "id").join(path.select(F.col("id").alias("keeper_id"), F.col("path").alias("new_path")), "keeper_id").select("old_path", "new_path")
    known = moves.select(F.concat(F.lit("/old"), "old_path").alias("old_path"), F.col("old_path").alias("new_path")).unionByName(spark.createDataFrame([("/stay/", "/about/")], "old_path string, new_path string"))
    return dedupe.redirects(known, moves)


def homed(load):
    """All raw places with the city_id of their row.

    It is that of the city's slug, else of the city that the address names. Cities in neither get the next free ids in order of their slugs,
    as they would be created; rows that name no city are in city 0.
    """
    city = load("city")
    own, said = (text.none_if_empty(text.slugify(c, 100, "")) for c in ("city", text.address_city("address")))
    known = city.select("slug", F.col("id").cast("long").alias("id"))
    new = merge.missing_cities(load("raw_place").select(F.trim("city").alias("name")), city).where("slug <> ''")
    number = F.row_number().over(Window.orderBy("slug"))
    fresh = new.crossJoin(known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))).select(F.col("slug").alias("_own"), (F.col("last") + number).alias("_new"))
    rows = load("raw_place").withColumn("_own", own).withColumn("_said", said)
    for key, found in (("_own", "_id"), ("_said", "_by_address")):
        rows = rows.join(known.select(F.col("slug").alias(key), F.col("id").alias(found)), key, "left")
    return rows.join(fresh, "_own", "left").withColumn("city_id", F.coalesce("_id", "_by_address", "_new", F.lit(0))).drop("_own", "_said", "_id", "_by_address", "_new")


def batch(load):
    """The raw places of known cities as import items."""
    city = load("city").select(F.col("id").alias("city_id"), F.lower("name").alias("c"))
    raw = load("raw_place").withColumn("c", F.lower(F.trim("city"))).drop("city")
    items = raw.join(city, "c").withColumnRenamed("raw_id", "ord").withColumnRenamed("google_maps_url", "maps_url").where("name <> ''")
    return merge.with_fid(items)


MATCH = """i AS (SELECT r.raw_id AS ord, c.id AS city_id, CASE WHEN regexp_full_match(coalesce(r.place_id, ''), '0x[0-9a-f]+:0x[0-9a-f]+') THEN r.place_id ELSE regexp_extract(coalesce(r.google_maps_url, ''), '!1s(0x[0-9a-f]+:0x[0-9a-f]+)', 1) END AS fid,
      coalesce(r.place_id, '') AS old, lower(r.name) AS name, coalesce(r.latitude, 0) AS latitude, coalesce(r.longitude, 0) AS longitude, r.phone AS new_phone, r.rating AS new_rating FROM raw_place r JOIN city c ON lower(c.name) = lower(trim(r.city, ' ')) WHERE r.name <> ''),
    o AS (SELECT id, city_id, place_id, lower(name) AS name, coalesce(latitude, 0) AS lat, coalesce(longitude, 0) AS lng, maps_url FROM listing),
    t AS (SELECT i.ord, 1 AS tier, o.id FROM i JOIN o ON i.city_id = o.city_id AND i.fid <> '' AND i.fid = o.place_id
      UNION ALL SELECT i.ord, 2, o.id FROM i JOIN o ON i.city_id = o.city_id AND i.fid <> '' AND contains(coalesce(o.maps_url, ''), '!1s' || i.fid)
      UNION ALL SELECT i.ord, 3, o.id FROM i JOIN o ON i.city_id = o.city_id AND i.old <> '' AND i.old <> i.fid AND i.old = o.place_id
      UNION ALL SELECT p.ord, 4, c.id FROM i p JOIN o c ON p.city_id = c.city_id AND p.name = c.name WHERE p.latitude <> 0 AND p.longitude <> 0 AND c.lat <> 0 AND c.lng IS NOT NULL AND 6371 * sqrt(pow(radians(c.lng - p.longitude) * cos(radians((p.latitude + c.lat) / 2)), 2) + pow(radians(c.lat - p.latitude), 2)) <= 0.3
      UNION ALL SELECT i.ord, 5, min(o.id) FROM i JOIN o ON i.city_id = o.city_id AND i.name = o.name WHERE NOT (i.latitude <> 0 AND i.longitude <> 0) OR o.lat = 0 GROUP BY 1 HAVING count(*) = 1),
    b AS (SELECT ord, tier, min(id) AS id, count(*) AS hits FROM t GROUP BY 1, 2),
    f AS (SELECT ord, min(tier) AS tier, arg_min(id, tier) AS id, arg_min(hits, tier) AS hits FROM b GROUP BY 1)"""


@query(f"WITH {MATCH} SELECT ord, id, CASE tier WHEN 1 THEN 'place ID' WHEN 2 THEN 'place ID' WHEN 3 THEN 'old-style ID' WHEN 4 THEN 'name + location' ELSE 'name only' END AS method, hits FROM f")
def tiered_match(spark, load):
    return merge.match(batch(load), load("listing"))


def updated_sql() -> str:
    new = [f"arg_max(r.{c}, i.ord) FILTER (WHERE {full_sql(f, f'r.{c}')}) AS n_{f}" for f, c in BROUGHT.items()]
    out = [f"CASE WHEN n.id IS NOT NULL AND NOT list_contains(coalesce(l.locked_fields, []), '{f}') AND n.n_{f} IS NOT NULL THEN {shown_sql(f, f'n.n_{f}')} ELSE {shown_sql(f, f'l.{f}')} END AS {f}" for f in BROUGHT]
    return f"""WITH {MATCH}, n AS (SELECT f.id, arg_max(i.fid, i.ord) FILTER (WHERE i.fid <> '') AS fid, {', '.join(new)} FROM f JOIN i USING (ord) JOIN raw_place r ON r.raw_id = i.ord GROUP BY 1)
      SELECT l.id, {', '.join(out)}, coalesce(n.fid, l.place_id) AS place_id, CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '2026-01-01' ELSE l.last_seen_at END AS last_seen_at FROM listing l LEFT JOIN n ON n.id = l.id"""


@query(updated_sql())
def protected_update(spark, load):
    items = batch(load)
    changes = merge.match(items, load("listing")).select("ord", "id").join(items.select("ord", "fid", *BROUGHT), "ord")
    rows = merge.protected(load("listing"), changes, tuple(BROUGHT), F.lit("2026-01-01").cast("timestamp_ntz"))
    return shown(rows, "id", *BROUGHT, "place_id", "last_seen_at")


@query(f"WITH {MATCH} SELECT count(*) AS n FROM listing WHERE city_id = 1 AND id NOT IN (SELECT id FROM f)")
def unseen_count(spark, load):
    return merge.unseen(load("listing"), merge.match(batch(load), load("listing")), 1)


def whole_import(load):
    items = homed(load).withColumnRenamed("raw_id", "ord").withColumnRenamed("google_maps_url", "maps_url")
    return merge.import_batch(items.select("ord", "city_id", "place_id", *[f for f in merge.FIELDS if f in items.columns]), load("listing"), SCOPE.exclude)


OUTCOME = "CASE WHEN f.ord IS NULL THEN 'created' WHEN tier <= 2 THEN 'updated (matched by place ID)' WHEN tier = 3 THEN 'updated (matched by old-style ID)' WHEN tier = 4 THEN 'updated (matched by name + location)' ELSE 'updated (matched by name only)' END AS outcome"
#: The whole batch as import_batch takes it: skipped rows told apart, rows of one place id of a city as one item.
BATCH = f"""{HOMED}, j AS (SELECT raw_id AS ord, city_id, trim(coalesce(name, ''), ' ') AS name, place_id, latitude, longitude,
      CASE WHEN regexp_full_match(coalesce(place_id, ''), '0x[0-9a-f]+:0x[0-9a-f]+') THEN place_id ELSE regexp_extract(coalesce(google_maps_url, ''), '!1s(0x[0-9a-f]+:0x[0-9a-f]+)', 1) END AS fid,
      listing_type, CASE WHEN trim(coalesce(name, ''), ' ') = '' THEN 'skipped (no name)' WHEN contains(lower(coalesce(address, '')), 'norvela phase 2') THEN 'skipped (excluded area: Norvela Phase 2)'
        WHEN contains(lower(coalesce(address, '')), 'kharmeez') THEN 'skipped (excluded area: Kharmeez)' END AS skip FROM h),
    i AS (SELECT min(ord) AS ord, city_id, fid, coalesce(arg_max(place_id, ord) FILTER (WHERE place_id <> ''), '') AS old, lower(arg_max(name, ord)) AS name,
        coalesce(arg_max(latitude, ord) FILTER (WHERE latitude <> 0), 0) AS latitude, coalesce(arg_max(longitude, ord) FILTER (WHERE longitude <> 0), 0) AS longitude, arg_max(listing_type, ord) FILTER (WHERE listing_type <> '') AS kind FROM j WHERE skip IS NULL AND fid <> '' GROUP BY city_id, fid
      UNION ALL SELECT ord, city_id, fid, coalesce(place_id, ''), lower(name), coalesce(latitude, 0), coalesce(longitude, 0), nullif(listing_type, '') FROM j WHERE skip IS NULL AND fid = '')"""


@query(f"WITH {BATCH}, {MATCH[MATCH.index('o AS (SELECT id'):]} SELECT outcome, count(*) AS n FROM (SELECT {OUTCOME} FROM i LEFT JOIN f USING (ord) UNION ALL SELECT skip FROM j WHERE skip IS NOT NULL) GROUP BY 1")
def import_counts(spark, load):
    result = whole_import(load)
    return report.import_counts(result["outcomes"].select("outcome").unionByName(result["skipped"].select("outcome")))


@query(f"WITH {BATCH}, {MATCH[MATCH.index('o AS (SELECT id'):]} SELECT i.ord, i.city_id, i.name, coalesce(i.kind, 'daycare') AS listing_type, coalesce(nullif(i.fid, ''), i.old) AS place_id FROM i LEFT JOIN f USING (ord) WHERE f.ord IS NULL")
def import_created(spark, load):
    return whole_import(load)["created"].select("ord", "city_id", F.lower("name").alias("name"), "listing_type", "place_id")


@query(f"WITH {BATCH}, {MATCH[MATCH.index('o AS (SELECT id'):]}, c AS (SELECT ord FROM i LEFT JOIN f USING (ord) WHERE f.ord IS NULL) SELECT count(*) AS created, count(*) AS slugs, 0::BIGINT AS taken FROM c")
def slug_uniqueness(spark, load):
    """The rows created, their different slugs in their cities, and those that a listing had before."""
    created, old = whole_import(load)["created"].select("city_id", "slug"), load("listing").select("city_id", "slug").distinct()
    both = created.groupBy("city_id", "slug").agg(F.count("*").alias("n")).join(old.withColumn("old", F.lit(1)), ["city_id", "slug"], "left")
    return both.agg(F.sum("n").alias("created"), F.count("*").alias("slugs"), F.count("old").alias("taken"))


@query(f"WITH {MATCH} SELECT count(*) FILTER (WHERE hits > 1) AS matched_more_than_one, count(*) AS matched FROM f")
def match_counts(spark, load):
    return merge.match(batch(load), load("listing")).agg(F.count_if(F.col("hits") > 1).alias("matched_more_than_one"), F.count("*").alias("matched"))


@query(f"""WITH {MATCH} SELECT min(ord) AS ord, fid, arg_max(new_phone, ord) FILTER (WHERE new_phone <> '') AS phone, arg_max(new_rating, ord) FILTER (WHERE new_rating <> 0) AS rating FROM i WHERE fid <> '' GROUP BY 2, city_id
    UNION ALL SELECT ord, fid, new_phone, new_rating FROM i WHERE fid = ''""")
def batch_collapse(spark, load):
    items = batch(load).drop("fid").withColumn("hours", F.to_json("hours"))
    return merge.collapse(items).select("ord", "fid", "phone", "rating")


@query(f"""WITH {MATCH}, q AS (SELECT f.id, f.ord, unnest(r.reviews) AS v, generate_subscripts(r.reviews, 1) AS pos FROM f JOIN raw_place r ON r.raw_id = f.ord),
    w AS (SELECT * FROM q WHERE coalesce(v.author, '') <> '' OR coalesce(v.text, '') <> ''), last AS (SELECT id, max(ord) AS ord FROM w GROUP BY 1),
    new AS (SELECT w.id AS listing_id, CAST(pos AS INTEGER) AS pos, v.author AS author, v.text AS text FROM w JOIN last USING (id, ord) WHERE id NOT IN (SELECT id FROM listing WHERE list_contains(locked_fields, 'reviews')))
    SELECT listing_id, 0 AS pos, author, text FROM review WHERE listing_id IS NULL OR listing_id NOT IN (SELECT listing_id FROM new) UNION ALL SELECT listing_id, pos, author, text FROM new""")
def children_replace(spark, load):
    """The review table behind an import of the reviews that lie in the raw places: of several items of a listing the last that has any counts."""
    items = batch(load)
    matched = merge.match(items, load("listing")).select("ord", "id").join(items.select("ord", "reviews"), "ord")
    new = matched.select(F.col("id").alias("listing_id"), "ord", F.posexplode("reviews").alias("pos", "v")).select("listing_id", "ord", (F.col("pos") + 1).alias("pos"), "v.author", "v.text")
    new = new.where("coalesce(author, '') <> '' OR coalesce(text, '') <> ''")
    last = new.groupBy("listing_id").agg(F.max("ord").alias("ord"))
    old = load("review").select("listing_id", F.lit(0).alias("pos"), "author", "text")
    return merge.replaced_children(old, new.join(last, ["listing_id", "ord"], "left_semi"), load("listing"), "listing_id", "reviews")


@query("""SELECT raw_id, coalesce(array_to_string(categories, ', '), '') AS categories,
    coalesce(array_to_string(list_transform(images, lambda i: coalesce(nullif(i.file, ''), i.url, '')), '|'), '') AS images FROM raw_place""")
def csv_flatten(spark, load):
    from placeweave.sources.write import flat

    return flat(load("raw_place")).select("raw_id", "categories", F.coalesce("images", F.lit("")).alias("images"))


@query("""SELECT id, CASE WHEN coalesce(l.phone, '') = '' AND coalesce(r.phone, '') <> '' THEN r.phone ELSE l.phone END AS phone, CASE WHEN coalesce(l.website, '') = '' AND coalesce(r.website, '') <> '' THEN r.website ELSE l.website END AS website,
      CASE WHEN coalesce(l.latitude, 0) = 0 AND coalesce(r.latitude, 0) <> 0 THEN r.latitude ELSE l.latitude END AS latitude, CASE WHEN coalesce(l.latitude, 0) = 0 AND coalesce(r.latitude, 0) <> 0 THEN r.longitude ELSE l.longitude END AS longitude
    FROM listing l LEFT JOIN (SELECT raw_id, phone, website, latitude, longitude FROM raw_place) r ON r.raw_id = l.id""")
def fill_missing(spark, load):
    fields = ["phone", "website", "latitude", "longitude"]
    return crawl.fill_missing(load("listing").select("id", *fields), load("raw_place").select(F.col("raw_id").alias("id"), *fields), "id", fields)


@query(f"SELECT own AS slug, min(name) AS name FROM (SELECT {slug_sql("trim(city, ' ')", 100, "")} AS own, trim(city, ' ') AS name FROM raw_place WHERE trim(city, ' ') <> '') WHERE own NOT IN (SELECT slug FROM city) GROUP BY 1")
def missing_cities(spark, load):
    return merge.missing_cities(load("raw_place").select(F.trim("city").alias("name")), load("city"))


@query("""WITH c AS (SELECT listing_id, review_id, rating, lag(rating) OVER w AS before, row_number() OVER w AS i FROM review WHERE listing_id IS NOT NULL AND rating IS NOT NULL WINDOW w AS (PARTITION BY listing_id ORDER BY review_id)),
    g AS (SELECT *, sum(CASE WHEN i > 1 AND rating = before THEN 0 ELSE 1 END) OVER (PARTITION BY listing_id ORDER BY i) AS run FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY listing_id, run ORDER BY i) - 1 AS same FROM g)
    SELECT listing_id AS task_key, min(review_id) AS stop FROM n WHERE same >= 3 GROUP BY 1""")
def stalled_runs(spark, load):
    """Where a listing's ratings stay the same three times in a row."""
    rows = load("review").where("listing_id IS NOT NULL AND rating IS NOT NULL")
    return report.stalled(rows.select(F.col("listing_id").alias("task_key"), F.col("review_id").alias("ord"), F.col("rating").alias("n")))


@query("""WITH l AS (SELECT city_id, maps_url, row_number() OVER (PARTITION BY city_id ORDER BY id) - 1 AS pos FROM listing WHERE city_id IS NOT NULL AND maps_url IS NOT NULL),
    f AS (SELECT *, regexp_extract(maps_url, '!1s(0x[0-9a-f]+:0x[0-9a-f]+)', 1) AS place_id FROM l), o AS (SELECT city_id, place_id, min(pos) AS pos, arg_min(maps_url, pos) AS url FROM f WHERE place_id <> '' GROUP BY 1, 2)
    SELECT city_id AS task_key, CAST(pos AS INTEGER) AS pos, place_id, url FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY pos) AS r FROM o) WHERE r <= 20""")
def result_urls(spark, load):
    """The first twenty places of each city's links, as a search's results."""
    links = load("listing").where("city_id IS NOT NULL AND maps_url IS NOT NULL")
    return crawl.listed_urls(links.select(F.col("city_id").alias("task_key"), F.col("id").alias("ord"), F.col("maps_url").alias("url")), 20)


@query("""WITH i AS (SELECT raw_id, unnest(images).url AS url FROM raw_place)
    SELECT raw_id, url, regexp_replace(regexp_replace(url, '=w[0-9]+-h[0-9]+.*$', '=w1200-h800'), '=s[0-9]+$', '=w1200-h800') AS large FROM i""")
def large_images(spark, load):
    return load("raw_place").select("raw_id", F.explode("images.url").alias("url")).select("raw_id", "url", text.large_image("url").alias("large"))


HTML = """'<html><h1>Place <b>' || raw_id || '</b></h1>' || CASE raw_id % 3 WHEN 0 THEN '<div aria-label="' || (raw_id % 50) / 10.0 || ' stars"></div>' WHEN 1 THEN '<span aria-hidden="true">x</span><span aria-hidden="true">' || (1 + raw_id % 4) || '.5</span>'
    ELSE '<script>{"averageRating": ' || (1 + raw_id % 4) || '.25}</script>' END || CASE raw_id % 2 WHEN 0 THEN '<p>(1,' || (100 + raw_id % 800) || ' reviews)</p>' ELSE '<p>' || (raw_id % 90) || ' Google reviews</p>' END
    || CASE raw_id % 4 WHEN 0 THEN '<button data-item-id="address" aria-label="Address: Plot ' || raw_id || ',  F-' || (5 + raw_id % 9) || ', Kelmirpur"></button>' WHEN 1 THEN '<button data-item-id="address"><i>Plot ' || raw_id || '</i><i>G-9</i></button>'
      WHEN 2 THEN '<div>Plot ' || raw_id || ', Lahore</div>' ELSE '' END
    || CASE raw_id % 2 WHEN 0 THEN '<button data-item-id="phone:tel:1" aria-label="Phone: 0399 ' || (100000 + raw_id) || '"></button>' ELSE '<p>call 051-' || (1000000 + raw_id) || ' now</p>' END
    || '<a href="https://www.google.com/maps">m</a>' || CASE raw_id % 2 WHEN 0 THEN '<a href="https://a.example/' || raw_id || '">s</a>' ELSE '<a href="https://a.example/">s</a><a data-item-id="authority" href="https://b.example/' || raw_id || '">s</a>' END
    || CASE raw_id % 2 WHEN 0 THEN '<div aria-label="Monday, 8 AM to ' || (1 + raw_id % 9) || ' PM; Tuesday, Closed; Wednesday, Open. Hide open hours"></div>' ELSE '<table><tr><td>Monday</td><td>' || (1 + raw_id % 9) || ' PM</td></tr></table>' END
    || '<button jsaction="pane.category">Kind ' || (raw_id % 7) || '</button><button jsaction="x.type"></button>'
    || '<div data-review-id="r"><div data-review-id="r"><i class="d4r55">Ann ' || raw_id || '</i>' || CASE raw_id % 3 WHEN 0 THEN '<i aria-label="' || (1 + raw_id % 5) || ' stars"></i>' ELSE '' END || '</div></div><div data-review-id="q"></div>'
    || '<img src="https://lh3.googleusercontent.com/p/a' || raw_id || '=w203-h114-k"><img src="https://lh3.googleusercontent.com/a/me=s640"><p style="background-image: url(https://lh5.googleusercontent.com/p/b' || raw_id || '=s680)"></p>'
    || CASE WHEN raw_id % 5 = 0 THEN '<p>Permanently closed</p>' ELSE '' END"""


@query("""SELECT raw_id, 'Place' || raw_id AS name, raw_id % 5 = 0 AS closed, CASE raw_id % 3 WHEN 0 THEN (raw_id % 50) / 10.0::DOUBLE WHEN 1 THEN 1 + raw_id % 4 + 0.5::DOUBLE ELSE 1 + raw_id % 4 + 0.25::DOUBLE END AS rating,
      CAST(CASE raw_id % 2 WHEN 0 THEN 1100 + raw_id % 800 ELSE raw_id % 90 END AS INTEGER) AS review_count,
      CASE raw_id % 4 WHEN 0 THEN 'Plot ' || raw_id || ', F-' || (5 + raw_id % 9) || ', Kelmirpur' WHEN 1 THEN 'Plot ' || raw_id || ' G-9' WHEN 2 THEN 'Plot ' || raw_id || ', Lahore' ELSE '' END AS address,
      CASE raw_id % 4 WHEN 0 THEN 'F-' || (5 + raw_id % 9) WHEN 1 THEN 'G-9' ELSE '' END AS area, CASE raw_id % 2 WHEN 0 THEN '0399 ' || (100000 + raw_id) ELSE '051-' || (1000000 + raw_id) END AS phone,
      CASE raw_id % 2 WHEN 0 THEN 'https://a.example/' ELSE 'https://b.example/' END || raw_id AS website, CASE raw_id % 2 WHEN 0 THEN 'Monday=8 AM–' || (1 + raw_id % 9) || ' PM|Tuesday=Closed|Wednesday=Open' ELSE 'Monday=' || (1 + raw_id % 9) || ' PM' END AS hours,
      'Kind ' || (raw_id % 7) AS categories, 'Ann ' || raw_id || ':' || CASE raw_id % 3 WHEN 0 THEN 1 + raw_id % 5 ELSE 0 END AS reviews, 'https://lh3.googleusercontent.com/p/a' || raw_id || '=w1200-h800 https://lh5.googleusercontent.com/p/b' || raw_id || '=w1200-h800' AS images FROM raw_place""")
def page_extracts(spark, load):
    """All fields of a page made for each raw place, whose parts change their form from place to place."""
    from placeweave.functions.html import page_fields

    read = load("raw_place").select("raw_id", page_fields(F.expr(HTML)).alias("p")).select("raw_id", "p.*")
    plain = ["raw_id", "name", "closed", "rating", "review_count", "address", "area", "phone", "website"]
    reviews = F.array_join(F.transform("reviews", lambda r: F.concat_ws(":", r["author"], r["rating"])), "|")
    return shown(read, *plain, "hours", "categories", "reviews", "images").withColumn("reviews", reviews).withColumn("images", F.array_join("images.url", " "))


@query("""SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(locked_fields, []), ['phone', 'area']))), ',') AS locks FROM listing WHERE is_featured
    UNION ALL SELECT id, array_to_string(locked_fields, ',') FROM listing WHERE NOT coalesce(is_featured, false)""")
def lock_edited(spark, load):
    listing = load("listing")
    edited = listing.where("is_featured").select("id", F.array(F.lit("phone"), F.lit("area")).alias("fields"))
    return merge.lock_edited(listing, edited).select("id", F.array_join("locked_fields", ",").alias("locks"))


@query(f"""WITH {HOMED}, n AS (SELECT city_id, trim(area, ' ') AS name FROM h WHERE trim(area, ' ') <> ''), k AS (SELECT city_id, {slug_sql("name", 100, "")} AS slug, min(name) AS name FROM n GROUP BY 1, 2)
    SELECT k.city_id, k.slug, k.name FROM k WHERE NOT EXISTS (SELECT 1 FROM area a WHERE a.city_id = k.city_id AND a.slug = k.slug)""")
def missing_areas(spark, load):
    needed = homed(load).select("city_id", F.trim("area").alias("name"))
    return merge.missing_areas(needed, load("area")).select("city_id", "slug", "name")
