"""Importing a batch of places into the listings: tiered matching, protected update, insert, children, slugs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import geo, text
from placeweave.schema import is_empty
from placeweave.session import HOT_ROWS, durable, join_hot, ranked

#: Fixed value: rows of one name so near are one place.
SAME_PLACE_KM = 0.3
FIELDS = ("name", "listing_type", "area_id", "sub_area", "address", "phone", "website", "description", "rating", "review_count", "latitude", "longitude", "categories", "hours", "maps_url")


def with_fid(items: DataFrame) -> DataFrame:
    """Items with fid, the current place id of place_id or the URL, "" if none."""
    return items.withColumn("fid", text.place_id("place_id", "maps_url"))


def collapse(items: DataFrame, order: str = "ord", by: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each place id of a city (or what ``by`` names) of the batch, with its fid: every field from the last row that fills it, the first row's position. Rows without an id stay.

    This is what importing them one after the other would leave, as each would match the row before.
    """
    by = by or (("city_id", "fid") if "city_id" in items.columns else ("fid",))
    keyed = with_fid(items)
    named, alone = keyed.where("fid <> ''"), keyed.where("fid = ''")
    aggs = [F.min(order).alias(order)]
    for c in items.columns:
        if c != order and c not in by:
            filled = ~is_empty(c, items.schema[c].dataType)
            aggs.append(F.max_by(F.when(filled, F.col(c)), F.when(filled, F.col(order))).alias(c))
    return named.groupBy(*by).agg(*aggs).select(*keyed.columns).unionByName(alone)


def _prefixes(pid: Column) -> Column:
    """An id and all its beginnings that are ids: a URL holds "!1s" + id also where its own id goes on."""
    low = F.instr(pid, ":") + 3
    return F.transform(F.sequence(low, F.length(pid)), lambda n: F.substring(pid, F.lit(1), n))


def match(items: DataFrame, listing: DataFrame) -> DataFrame:
    """(ord, id, method, hits) of items (ord, fid, place_id, name, latitude, longitude, city_id) that match a listing of their city.

    Tiers in order: the id in place_id; the id inside a URL; an old-style id; the same name within 0.3 km; the same name alone, if it is
    the only one (of those without a position, if the item has one). Of several the lowest listing id is taken and hits counts them.
    """
    own = listing.select(F.col("id"), F.col("city_id").alias("c"), F.col("place_id").alias("p"), F.lower("name").alias("n"), F.coalesce("latitude", F.lit(0.0)).alias("la"), F.coalesce("longitude", F.lit(0.0)).alias("lo"), "maps_url")
    i = items.select("ord", "city_id", "fid", F.coalesce("place_id", F.lit("")).alias("old"), F.lower("name").alias("name"), F.coalesce("latitude", F.lit(0.0)).alias("lat"), F.coalesce("longitude", F.lit(0.0)).alias("lng"))

    def tier(rank: int, method: str, pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("ord").agg(F.min("id").alias("id"), F.count("*").alias("hits")).select("ord", F.lit(rank).alias("tier"), F.lit(method).alias("method"), "id", "hits")

    city = F.col("city_id") == F.col("c")
    by_id = i.where("fid <> ''").join(own, city & (F.col("fid") == F.col("p")))
    in_url = own.withColumn("u", F.explode(_prefixes(F.nullif(F.regexp_extract("maps_url", f"!1s({text.PLACE_ID})", 1), F.lit("")))))
    by_url = i.where("fid <> ''").join(in_url, city & (F.col("fid") == F.col("u")))
    by_old = i.where("old <> '' AND old <> fid").join(own, city & (F.col("old") == F.col("p")))
    named = i.join(own, city & (F.col("name") == F.col("n")))
    placed = (F.col("lat") != 0) & (F.col("lng") != 0)
    near = named.where(placed & (F.col("la") != 0) & (geo.distance_km(F.col("lat"), F.col("lng"), F.col("la"), F.col("lo")) <= SAME_PLACE_KM))
    only = tier(5, "name only", named.where(~placed | (F.col("la") == 0))).where("hits = 1")
    tiers = tier(1, "place ID", by_id).unionByName(tier(2, "place ID", by_url)).unionByName(tier(3, "old-style ID", by_old)).unionByName(tier(4, "name + location", near)).unionByName(only)
    best = tiers.groupBy("ord").agg(F.min_by(F.struct("id", "method", "hits"), "tier").alias("b"))
    return best.select("ord", "b.id", "b.method", "b.hits")


def protected(listing: DataFrame, changes: DataFrame, fields: tuple[str, ...] = FIELDS, now: Column | None = None) -> DataFrame:
    """listing with the changes (ord, id, fid, fields) applied: a field is set if it isn't locked and the new value isn't empty.

    The place id follows fid; the last sight is set; slug and flags never change. Several changes of a row act in order (ord): of each
    field the last value that isn't empty stays.
    """
    aggs = []
    for c in ("fid", *fields):
        filled = ~is_empty(c, changes.schema[c].dataType)
        aggs.append(F.max_by(F.when(filled, F.col(c)), F.when(filled, F.col("ord"))).alias(f"new_{c}"))
    one = changes.groupBy(F.col("id").alias("_id")).agg(*aggs)
    joined = listing.join(one, listing["id"] == F.col("_id"), "left")
    locked = F.coalesce("locked_fields", F.array().cast("array<string>"))
    out = []
    for c in listing.columns:
        if c in fields:
            new = F.col(f"new_{c}").cast(listing.schema[c].dataType)
            free = ~F.array_contains(locked, c.removesuffix("_id") if c == "area_id" else c)
            out.append(F.when(F.col("_id").isNotNull() & free & ~is_empty(new, listing.schema[c].dataType), new).otherwise(F.col(c)).alias(c))
        elif c == "place_id":
            out.append(F.when(F.coalesce("new_fid", F.lit("")) != "", F.col("new_fid")).otherwise(F.col(c)).alias(c))
        elif c == "last_seen_at":
            out.append(F.when(F.col("_id").isNotNull(), now if now is not None else F.current_timestamp()).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def unseen(listing: DataFrame, seen: DataFrame, city_id: int) -> DataFrame:
    """One row n: the city's listings that the batch didn't match."""
    return listing.where(F.col("city_id") == city_id).join(seen.select("id"), "id", "left_anti").agg(F.count("*").alias("n"))


#: A slug that ends in a number as unique_slugs writes them.
NUMBERED = r"^(.*)-([1-9][0-9]{0,8})$"
_RULED = "s string, b string, steps array<struct<rank:long,add:long>>"


def _family(rows: pd.DataFrame) -> pd.DataFrame:
    """For each base of one family (names that differ in numbers at their ends) how its ranks become numbers: from rank on, add is added.

    rows: s, b, used (numbers taken before), children (number k, c: rows of b before the first row of base b-k).
    """
    known = {r["b"]: r for r in rows.to_dict("records")}
    lost: set[str] = set()  # bases whose plain form a row of a shorter base took first
    out = []
    for b in sorted(known, key=lambda b: (b.count("-"), b)):
        used = {int(k) for k in (known[b]["used"] if known[b]["used"] is not None else ())}
        if b in lost:
            used.add(0)
        events = sorted([(k, -1) for k in used] + [(int(c["k"]), int(c["c"])) for c in (known[b]["children"] if known[b]["children"] is not None else ()) if int(c["k"]) not in used])
        steps: list[tuple[int, int]] = []
        blocked = 0
        for k, before in events:
            rank = k - blocked  # of the row that would get number k
            if before > rank:
                lost.add(f"{b}-{k}")
                continue
            blocked += 1
            if steps and steps[-1][0] == rank:
                steps.pop()
            steps.append((rank, blocked))
        out.append((known[b]["s"], b, [{"rank": r, "add": n} for r, n in steps]))
    return pd.DataFrame(out, columns=["s", "b", "steps"])


def _rows_before(rows: DataFrame, child: DataFrame, base: str, order: str, hot_rows: int) -> DataFrame:
    """(_s, b, children): for each base the rows of it before the first row of each base that looks like a numbered one of it."""
    items = rows.select("_s", F.col(base).alias("b"), F.col(order).alias("o"), F.lit(None).cast("int").alias("k"))
    asked = items.join(child.select("_s", "b").distinct(), ["_s", "b"], "left_semi").unionByName(child.select("_s", "b", "o", "k"))
    among = ranked(asked, ["_s", "b"], ["o"], "r", hot_rows).where("k IS NOT NULL")
    return ranked(among, ["_s", "b"], ["o"], "own", hot_rows).groupBy("_s", "b").agg(F.collect_list(F.struct("k", (F.col("r") - F.col("own")).alias("c"))).alias("children"))


def unique_slugs(new: DataFrame, existing: DataFrame, base: str = "base", order: str = "ord", scope: str = "city_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """new with slug: the base, or the first of base-1, base-2, ... that is free when its turn comes by order, within a city and against existing (city_id, slug).

    This is what adding row by row gives, also where one base looks like a numbered one of another. Order must be unique. Rows are ranked within
    their base (hot bases by ranges), and ranks become numbers by the steps that taken numbers make; names of a family that differ in
    numbers alone are weighed against each other in one task, with one entry for each different name, not for each row. A null city is one.
    """
    s, by = F.coalesce(F.col(scope).cast("string"), F.lit("")), ["_s", base]
    rows = new.withColumn("_s", s)
    need = durable(rows.groupBy("_s", F.col(base).alias("b")).agg(F.count("*").alias("n"), F.min(order).alias("t")))
    taken = existing.select(s.alias("_s"), "slug").where("slug IS NOT NULL").distinct()
    stem, number = F.regexp_extract("slug", NUMBERED, 1), F.regexp_extract("slug", NUMBERED, 2)
    used = taken.select("_s", F.col("slug").alias("b"), F.lit(0).alias("k")).unionByName(taken.where(number != "").select("_s", stem.alias("b"), number.try_cast("int").alias("k")))
    used = used.join(need.select("_s", "b"), ["_s", "b"], "left_semi").groupBy("_s", "b").agg(F.collect_set("k").alias("used"))
    child = need.select("_s", F.regexp_extract("b", NUMBERED, 1).alias("b"), F.regexp_extract("b", NUMBERED, 2).try_cast("int").alias("k"), F.col("t").alias("o")).where("k IS NOT NULL")
    child = durable(child.join(need.select("_s", "b"), ["_s", "b"], "left_semi"))
    if child.isEmpty():
        before = used.limit(0).select("_s", "b", F.lit(None).cast("array<struct<k:int,c:bigint>>").alias("children"))
    else:
        before = _rows_before(rows, child, base, order, hot_rows)
    # a base whose plain form may be lost is ruled as well
    full = child.select("_s", F.concat_ws("-", "b", "k").alias("b"))
    events = used.select("_s", "b").unionByName(before.select("_s", "b")).unionByName(full).distinct().join(used, ["_s", "b"], "left").join(before, ["_s", "b"], "left")
    family = F.regexp_replace("b", r"(?:-[1-9][0-9]{0,8})+$", "")
    ruled = events.withColumn("f", family).groupBy("_s", "f").applyInPandas(lambda x: _family(x.rename(columns={"_s": "s"})), _RULED)
    steps = ruled.where(F.size("steps") > 0).select(F.col("s").alias("_s"), F.col("b").alias(base), "steps")
    met = join_hot(ranked(rows, by, [order], "_rank", hot_rows), steps, by, "left", hot_rows, [order])
    add = F.array_max(F.transform(F.filter("steps", lambda x: x["rank"] <= F.col("_rank")), lambda x: x["add"]))
    k = F.col("_rank") + F.coalesce(add, F.lit(0))
    return met.withColumn("slug", F.when(k == 0, F.col(base)).otherwise(F.concat_ws("-", base, k))).select(*new.columns, "slug")


def replaced_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """Children after the import: a parent's set is replaced by its new one, unless that is empty or the parent (id, locked_fields) locks ``name``.

    New reviews without author and text don't count.
    """
    real = new.where((F.coalesce("author", F.lit("")) != "") | (F.coalesce("text", F.lit("")) != "")) if "author" in new.columns else new
    locked = parents.where(F.array_contains("locked_fields", name)).select(F.col("id").alias(key))
    usable = real.join(locked, key, "left_anti")
    return old.join(usable.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(usable.select(*old.columns))


def numbered_photos(images: DataFrame, files: DataFrame) -> DataFrame:
    """(listing_id, ord, name, url, alt) of the images (listing_id, pos, url, alt, file) whose file is among files (file): ord counts them from 0 by pos, name is the number from 1 with the file's suffix.

    Images without a file that is there don't count: bare URLs expire. Lists of one place are short, so they are numbered in the row.
    """
    real = images.where(F.coalesce("file", F.lit("")) != "").join(files.select("file").distinct(), "file", "left_semi")
    lists = real.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "alt", "file"))).alias("l"))
    each = lists.select("listing_id", F.posexplode("l").alias("ord", "x"))
    name = F.concat((F.col("ord") + 1).cast("string"), F.regexp_extract("x.file", r"(\.[^./]+)$", 1))
    return each.select("listing_id", "ord", name.alias("name"), "x.url", "x.alt")


def skipped_photos(images: DataFrame, photos: DataFrame) -> DataFrame:
    """One row (imported, skipped): the photos that have a file, and the images that have none."""
    both = images.select(F.lit(0).alias("photo")).unionByName(photos.select(F.lit(1).alias("photo")))
    return both.agg(F.sum("photo").alias("imported"), (F.count("*") - 2 * F.sum("photo")).alias("skipped"))


def missing_areas(needed: DataFrame, area: DataFrame) -> DataFrame:
    """Areas (city_id, slug, name) that the batch needs and the table lacks; of several spellings of a slug the first in order."""
    distinct = needed.where("name <> ''").withColumn("slug", text.slugify("name", 100, "")).groupBy("city_id", "slug").agg(F.min("name").alias("name"))
    return distinct.join(area.select("city_id", "slug"), ["city_id", "slug"], "left_anti")


def lock_edited(listing: DataFrame, edited: DataFrame) -> DataFrame:
    """listing with the fields (array) of edited (id, fields) added to their sorted locks."""
    joined = listing.join(edited.select(F.col("id").alias("_id"), F.col("fields").alias("_f")), listing["id"] == F.col("_id"), "left")
    both = F.array_sort(F.array_union(F.coalesce("locked_fields", F.array().cast("array<string>")), F.col("_f")))
    return joined.withColumn("locked_fields", F.when(F.col("_id").isNotNull(), both).otherwise(F.col("locked_fields"))).select(*listing.columns)


def missing_cities(names: DataFrame, city: DataFrame) -> DataFrame:
    """Cities (slug, name) that the batch (name) needs and the table lacks."""
    needed = names.where("name <> ''").select(text.slugify("name", 100, "").alias("slug"), "name").groupBy("slug").agg(F.min("name").alias("name"))
    return needed.join(city.select("slug"), "slug", "left_anti")


def with_created(result: dict[str, DataFrame], listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listings, ids): all listings after import_batch with the new ones under the next free ids by ord, and (ord, id) of every item."""
    last = listing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    made = durable(ranked(result["created"], [], ["ord"], "_n").withColumn("id", F.col("_n") + last + 1).drop("_n"))
    new = made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(True) if f.name == "is_active" else F.lit(None)).cast(f.dataType).alias(f.name) for f in listing.schema.fields])
    ids = result["outcomes"].where("id IS NOT NULL").select("ord", "id").unionByName(made.select("ord", "id"))
    return result["updated"].unionByName(new), ids


def imported_reviews(raw: DataFrame, ids: DataFrame, review: DataFrame, listing: DataFrame) -> DataFrame:
    """review after an import: raw (ord, reviews) of the items (ord, id) replace those of their listings; of several items of one the last that has any counts."""
    new = raw.join(ids, "ord").select(F.col("id").alias("listing_id"), "ord", F.posexplode("reviews").alias("pos", "v")).select("listing_id", "ord", "pos", "v.*")
    new = new.where("coalesce(author, '') <> '' OR coalesce(text, '') <> ''")
    new = new.join(new.groupBy("listing_id").agg(F.max("ord").alias("ord")), ["listing_id", "ord"], "left_semi")
    last = review.agg(F.coalesce(F.max("review_id"), F.lit(0)).alias("m")).first()["m"]
    numbered = ranked(new, [], ["ord", "listing_id", "pos"], "_n").withColumn("review_id", F.col("_n") + last + 1)
    full = numbered.select(*[(F.col(f.name) if f.name in numbered.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in review.schema.fields])
    return replaced_children(review, full, listing, "listing_id", "reviews")


def import_batch(items: DataFrame, listing: DataFrame, exclude: tuple[str, ...] = (), now: Column | None = None) -> dict[str, DataFrame]:
    """A batch (ord, city_id, place_id, maps_url and the listing's fields) against the listings: nothing is written, so a dry run is the same call.

    Gives updated (all listings), created (new rows with slug, no id yet), outcomes (ord, outcome, id) and skipped (ord, outcome). Rows of the
    batch with one place id in one city are one item. An item without an id doesn't match another one of the same batch.
    """
    name = F.trim(F.coalesce("name", F.lit("")))
    out = F.coalesce(*[F.when(text.icontains("address", a), F.lit(a)) for a in exclude], F.lit(None).cast("string"))
    judged = items.withColumn("name", name).withColumn("_skip", F.when(name == "", "skipped (no name)").when(out.isNotNull(), F.concat(F.lit("skipped (excluded area: "), out, F.lit(")"))))
    real = collapse(judged.where("_skip IS NULL").drop("_skip"))
    found = match(real, listing)
    matched = real.join(found.select("ord", "id", "method"), "ord", "left")
    changes = matched.where("id IS NOT NULL")
    fresh = matched.where("id IS NULL").drop("id", "method").withColumn("base", text.slugify("name"))
    created = unique_slugs(fresh, listing.select("city_id", "slug"))
    created = created.withColumn("listing_type", F.coalesce(text.none_if_empty("listing_type"), F.lit("daycare"))).withColumn("place_id", F.coalesce(text.none_if_empty("fid"), "place_id", F.lit("")))
    outcome = F.when(F.col("id").isNull(), "created").otherwise(F.concat(F.lit("updated (matched by "), "method", F.lit(")")))
    return {
        "updated": protected(listing, changes, tuple(f for f in FIELDS if f in items.columns), now),
        "created": created.drop("base", "fid"),
        "outcomes": matched.select("ord", outcome.alias("outcome"), "id"),
        "skipped": judged.where("_skip IS NOT NULL").select("ord", F.col("_skip").alias("outcome")),
    }
