"""Queries of the directory's pages over listing, city, area, review tables.

Orders end with the id, so that results are defined where the pages' own orders tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import text
from placeweave.session import join_hot

#: Sort keys of a city page; anything else sorts as featured.
SORTS = {"rating": "rating", "reviews": "review_count", "name": "name", "featured": "is_featured"}


class NotFound(LookupError):
    """A page whose city, area or listing doesn't exist."""


def default_order(prefix: str = "") -> list[Column]:
    return [F.desc(f"{prefix}{c}") for c in ("is_featured", "rating", "review_count")] + [F.col(f"{prefix}id")]


def with_place(listing: DataFrame, city: DataFrame, area: DataFrame) -> DataFrame:
    """Listings with city_name, city_slug, area_name, area_slug; rows without a city or an area stay."""
    c = city.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"), F.col("slug").alias("city_slug"))
    a = area.select(F.col("id").alias("area_id"), F.col("name").alias("area_name"), F.col("slug").alias("area_slug"))
    return listing.join(c, "city_id", "left").join(a, "area_id", "left")


def city_page(listing: DataFrame, city: DataFrame, area: DataFrame, city_slug: str, area_slug: str | None = None, q: str = "", sort: str = "featured") -> DataFrame:
    """Active listings of a city, optionally of one area, with q in name, description or address, sorted by key and rating."""
    rows = with_place(listing.where("is_active"), city, area).where(F.col("city_slug") == city_slug)
    if area_slug:
        rows = rows.where(F.col("area_slug") == area_slug)
    q = q.strip()
    if q:
        rows = rows.where(text.icontains("name", q) | text.icontains("description", q) | text.icontains("address", q))
    key = SORTS.get(sort, "is_featured")
    return rows.orderBy(F.asc(key) if key == "name" else F.desc(key), F.desc("rating"), "id")


def area_page(listing: DataFrame, city: DataFrame, area: DataFrame, city_slug: str, area_slug: str) -> DataFrame:
    """Active listings of one area of a city. An area of another city is not found."""
    found = area.join(city.where(F.col("slug") == city_slug).select(F.col("id").alias("city_id")), "city_id").where(F.col("slug") == area_slug).select(F.col("id").alias("area_id"))
    if found.isEmpty():
        raise NotFound(f"{city_slug}/{area_slug}")
    return listing.where("is_active").join(found, "area_id", "left_semi").orderBy(F.desc("is_featured"), F.desc("rating"), "id")


def detail(listing: DataFrame, city: DataFrame, city_slug: str, slug: str) -> DataFrame:
    """The one active listing of a page, or NotFound."""
    row = listing.where(F.col("is_active") & (F.col("slug") == slug)).join(city.where(F.col("slug") == city_slug).select(F.col("id").alias("city_id")), "city_id", "left_semi").limit(1)
    if row.isEmpty():
        raise NotFound(f"{city_slug}/{slug}")
    return row


def similar(listing: DataFrame, k: int = 4) -> DataFrame:
    """(id, rank, similar_id): for each active listing the k best rated other ones of its area; those without an area are alike in any city.

    Only the k + 1 best of each area meet the listings, so a hot area costs no more than others.
    """
    active = listing.where("is_active").select("id", F.coalesce(F.col("area_id").cast("string"), F.lit("none")).alias("of"), "rating")
    best = Window.partitionBy("of").orderBy(F.desc("rating"), "id")
    top = active.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    top = top.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("top"))
    met = join_hot(active, top, ["of"])
    others = F.slice(F.filter("top", lambda t: t["id"] != F.col("id")), 1, k)
    return met.select("id", F.posexplode(F.transform(others, lambda t: t["id"]))).select("id", (F.col("pos") + 1).alias("rank"), F.col("col").alias("similar_id"))


def live_search(listing: DataFrame, city: DataFrame, area: DataFrame, q: str, k: int = 10) -> DataFrame:
    """The first k active listings with q in name, address or area name; none if q has fewer than two characters."""
    q = q.strip()
    rows = with_place(listing.where("is_active"), city, area)
    hit = text.icontains("name", q) | text.icontains("address", q) | text.icontains("area_name", q)
    return (rows.where(hit) if len(q) >= 2 else rows.limit(0)).orderBy(*default_order()).limit(k)


def featured(listing: DataFrame, city: DataFrame, area: DataFrame, k: int = 6) -> DataFrame:
    return with_place(listing.where("is_featured AND is_active"), city, area).orderBy(*default_order()).limit(k)


def counts_by(listing: DataFrame, owner: DataFrame, key: str) -> DataFrame:
    """(id, name, n) of every city or area with its number of listings, active or not, 0 included."""
    n = listing.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return owner.select("id", "name").join(n, F.col("id") == F.col(key), "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_areas(area: DataFrame, k: int = 5) -> DataFrame:
    """(city_id, rank, name): the first k areas of each city by name."""
    by_name = Window.partitionBy("city_id").orderBy("name", "id")
    return area.withColumn("rank", F.row_number().over(by_name)).where(F.col("rank") <= k).select("city_id", "rank", "name")


def other_areas(area: DataFrame, area_id: int) -> DataFrame:
    """The other areas of an area's city, by name."""
    own = area.where(F.col("id") == area_id).select("city_id")
    return area.join(own, "city_id", "left_semi").where(F.col("id") != area_id).orderBy("name", "id")


def with_reviews(listing: DataFrame, review: DataFrame, k: int | None = 5) -> DataFrame:
    """Listings with reviews, an array of their k best rated ones, or of all if k is None; further ones don't travel. Lists of none are empty."""
    best = Window.partitionBy("listing_id").orderBy(F.desc_nulls_last("rating"), "review_id")
    top = review.where("listing_id IS NOT NULL").withColumn("r", F.row_number().over(best))
    top = top if k is None else top.where(F.col("r") <= k)
    one = F.struct("r", "review_id", "author", "rating", "text", "date")
    nested = top.groupBy(F.col("listing_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("reviews"))
    return listing.join(nested, "id", "left").withColumn("reviews", F.coalesce("reviews", F.array().cast(nested.schema["reviews"].dataType)))


def sitemap(listing: DataFrame, city: DataFrame, area: DataFrame) -> DataFrame:
    """(path, changefreq, priority) of the fixed pages, cities, areas and active listings that have a city."""
    spark = listing.sparkSession
    pages = spark.createDataFrame([(f"/{p}/", "yearly", 0.3) for p in ("about", "privacy", "contact")], "path string, changefreq string, priority double")

    def urls(rows: DataFrame, path: Column, freq: str, priority: float) -> DataFrame:
        return rows.select(path.alias("path"), F.lit(freq).alias("changefreq"), F.lit(priority).alias("priority"))

    home = city.select(F.col("id").alias("city_id"), F.col("slug").alias("home"))
    cities = urls(city, F.concat(F.lit("/"), "slug", F.lit("/")), "weekly", 0.9)
    areas = urls(area.join(home, "city_id"), F.concat(F.lit("/"), "home", F.lit("/"), "slug", F.lit("/")), "weekly", 0.8)
    places = urls(listing.where("is_active").join(home, "city_id"), detail_path(F.col("home"), F.col("slug")), "monthly", 0.7)
    return pages.unionByName(cities).unionByName(areas).unionByName(places)


def detail_path(city_slug: Column, slug: Column) -> Column:
    """Path of a listing's page, null without a city."""
    return F.concat(F.lit("/"), city_slug, F.lit("/"), slug, F.lit("/detail/"))


def robots(base: str) -> str:
    """Fixed value but for the site's address."""
    return "\n".join(["User-agent: *", "Disallow: /admin/", "Disallow: /search/", f"Sitemap: {base}/sitemap.xml"]) + "\n"


def labels(placed: DataFrame) -> DataFrame:
    """(id, short_address, location_label, rating_stars, stars, meta_desc) of listings from with_place. Stars round half to even."""
    empty = F.lit("")
    sub = text.none_if_empty("sub_area")
    place = F.when(F.col("area_name").isNotNull() & sub.isNotNull(), F.concat(sub, F.lit(", "), "area_name")).otherwise(F.coalesce("area_name", "city_name", empty))
    stars = F.bround(F.coalesce("rating", F.lit(0.0)), 0).cast("int")
    described = text.none_if_empty("description")
    sentence = F.concat(F.coalesce("name", empty), F.lit(" is a daycare in "), F.coalesce("address", empty), F.lit(". Rating: "), F.col("rating").cast("string"), F.lit("/5 from "), F.col("review_count").cast("string"), F.lit(" reviews."))
    return placed.select(
        "id", F.substring_index(F.coalesce("address", empty), ",", 1).alias("short_address"), place.alias("location_label"), stars.alias("rating_stars"),
        F.repeat(F.lit("★"), stars).alias("stars"), F.coalesce(F.substring(described, 1, 155), sentence).alias("meta_desc"),
    )


def cut(value: Column | str, most: int) -> Column:
    """A text of at most ``most`` characters, the last an ellipsis if some are left out."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def structured_data(placed: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(id, json): the record for search engines, members that are missing left out. images: (listing_id, og_image), as shown_images gives."""
    site, phone = text.none_if_empty("website"), text.none_if_empty("phone")
    rows = placed.withColumn("og_image", F.lit(None).cast("string")) if images is None else placed.join(images.select(F.col("listing_id").alias("id"), "og_image"), "id", "left")
    typed = lambda kind, *members: F.struct(F.lit(kind).alias("@type"), *members)
    record = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("ChildCare").alias("@type"), F.col("name").alias("name"), cut("description", 200).alias("description"),
        typed("PostalAddress", F.col("address").alias("streetAddress"), F.col("city_name").alias("addressLocality"), F.lit("PK").alias("addressCountry")).alias("address"),
        phone.alias("telephone"), site.alias("url"),
        F.when(F.col("rating") != 0, typed("AggregateRating", F.col("rating").cast("string").alias("ratingValue"), F.col("review_count").cast("string").alias("reviewCount"))).alias("aggregateRating"),
        F.when(F.col("latitude") != 0, typed("GeoCoordinates", "latitude", "longitude")).alias("geo"), text.none_if_empty("og_image").alias("image"),
        F.concat(F.col("city_name"), F.lit(", Pakistan")).alias("areaServed"),
    )
    return rows.select("id", F.to_json(record).alias("json"))


def shown_images(images: DataFrame) -> DataFrame:
    """(listing_id, images, og_image): each listing's images that have a file, in order, and the first of them."""
    real = images.where(F.coalesce("image", F.lit("")) != "")
    lists = real.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("order", "image", "alt"))).alias("images"))
    return lists.select("listing_id", "images", F.col("images")[0]["image"].alias("og_image"))


def review_cards(review: DataFrame) -> DataFrame:
    """(review_id, author, stars, text): what a page shows of a review; without a name it is anonymous."""
    author = F.coalesce(text.none_if_empty("author"), F.lit("Anonymous"))
    return review.select("review_id", author.alias("author"), F.repeat(F.lit("★"), F.coalesce(F.col("rating").cast("int"), F.lit(0))).alias("stars"), "text")


def admin_search(rows: DataFrame, q: str, fields: list[str], facets: dict | None = None) -> DataFrame:
    """Rows where each word of q stands in one of the fields, ignoring case, and each facet (column -> value) is equal."""
    for word in q.split():
        hit = F.lit(False)
        for f in fields:
            hit = hit | text.icontains(f, word)
        rows = rows.where(hit)
    for column, value in (facets or {}).items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n) for each value of the facets, in one pass over the rows."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]))
    return rows.select(each.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
