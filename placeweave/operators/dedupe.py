"""Duplicate listings of one place: clusters, the row kept, merged values, children and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions.text import PLACE_ID
from placeweave.schema import MERGED, is_empty
from placeweave.session import join_hot


def place_key(place_id: str = "place_id", url: str = "maps_url") -> Column:
    """The place id as it stands in the column, else in the URL's !1s part, else null."""
    own = F.coalesce(F.col(place_id), F.lit(""))
    return F.when(own.rlike(f"^{PLACE_ID}$"), own).otherwise(F.nullif(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), f"!1s({PLACE_ID})", 1), F.lit("")))


def _rank() -> Column:
    return F.struct(F.coalesce(F.col("slug").rlike(r"-\d+$"), F.lit(False)).alias("numbered"), F.col("id").alias("id"))


def clusters(listing: DataFrame) -> DataFrame:
    """(city_id, place, keeper_id, n) of places with more than one row; keeper: slugs without a number at the end first, then the lowest id."""
    keyed = listing.withColumn("place", place_key()).where("place IS NOT NULL")
    return keyed.groupBy("city_id", "place").agg(F.min(_rank())["id"].alias("keeper_id"), F.count("*").alias("n")).where("n > 1")


def members(listing: DataFrame) -> DataFrame:
    """(id, keeper_id) of every row of a cluster."""
    home = F.coalesce(F.col("city_id").cast("string"), F.lit("none")).alias("home")
    keyed = listing.withColumn("place", place_key()).where("place IS NOT NULL").select("id", home, "place")
    return join_hot(keyed, clusters(listing).select(home, "place", "keeper_id"), ["home", "place"]).select("id", "keeper_id")


def merged(listing: DataFrame) -> DataFrame:
    """One row per cluster: the keeper's id with the values that survive.

    A field locked in any row stays the keeper's; else the latest row that isn't empty wins, of equally late ones the last in keeper order. Flags
    are or-ed, locks united, the last sight is the latest, the place id is that of the merged values. Every part is a partial aggregate.
    """
    keyed = listing.withColumn("place", place_key()).where("place IS NOT NULL")
    order = F.struct(F.col("updated_at").alias("at"), _rank().alias("rank"))
    locks = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("locked_fields", F.array().cast("array<string>"))))))
    aggs = []
    for f in MERGED:
        kept = F.struct(F.col(f).alias("v"))
        aggs.append(F.min_by(kept, _rank()).alias(f"k_{f}"))
        aggs.append(F.max_by(F.when(~is_empty(f, listing.schema[f].dataType), kept), F.when(~is_empty(f, listing.schema[f].dataType), order)).alias(f"m_{f}"))
    flags = [F.bool_or(F.coalesce(f, F.lit(False))).alias(f) for f in ("is_verified", "is_featured", "is_active")]
    rows = keyed.groupBy("city_id", "place").agg(
        F.min(_rank())["id"].alias("id"), F.count("*").alias("n"), locks.alias("locked_fields"), F.max("last_seen_at").alias("last_seen_at"),
        F.min_by("slug", _rank()).alias("slug"), *flags, *aggs,
    ).where("n > 1")
    values = []
    for f in MERGED:
        name = f.removesuffix("_id")
        values.append(F.when(F.array_contains("locked_fields", name) | F.col(f"m_{f}").isNull(), F.col(f"k_{f}.v")).otherwise(F.col(f"m_{f}.v")).alias(f))
    # a keeper's own id stands in place_id or its URL; the merged URL may name another one
    out = rows.select("id", "city_id", "slug", "n", "place", *values, "is_verified", "is_featured", "is_active", "locked_fields", "last_seen_at")
    own = listing.select(F.col("id").alias("kid"), F.col("place_id"))
    return out.join(own, out["id"] == own["kid"]).withColumn("place_id", place_key()).drop("kid")


def deduped(listing: DataFrame) -> DataFrame:
    """listing after the merge: each cluster's keeper with the values that survive, its other rows gone; slugs and times of creation stay."""
    gone = members(listing).where("id <> keeper_id").select("id")
    new = merged(listing)
    changed = [c for c in new.columns if c in listing.columns and c not in ("id", "city_id", "slug")]
    both = listing.join(gone, "id", "left_anti").join(new.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in changed]), F.col("id") == F.col("_id"), "left")
    return both.select(*[F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in listing.columns])


def child_source(members_: DataFrame, children: DataFrame, child_key: str) -> DataFrame:
    """(keeper_id, source_id): the member with the most children, of equal ones the keeper, then the lowest id; clusters without children give none."""
    n = children.groupBy(F.col(child_key).alias("id")).agg(F.count("*").alias("n"))
    counted = members_.join(n, "id")
    best = F.max_by("id", F.struct("n", (F.col("id") == F.col("keeper_id")).alias("own"), -F.col("id")))
    return counted.groupBy("keeper_id").agg(best.alias("source_id"))


def moved_children(members_: DataFrame, children: DataFrame, child_key: str) -> DataFrame:
    """children of all listings after the merge: the largest set of each cluster under its keeper, the others' gone."""
    source = child_source(members_, children, child_key)
    of = members_.select(F.col("id").alias("_id"), "keeper_id")
    joined = children.join(of, children[child_key] == F.col("_id"), "left").join(source.select(F.col("source_id"), F.lit(True).alias("wins")), children[child_key] == F.col("source_id"), "left")
    kept = joined.where(F.col("keeper_id").isNull() | F.col("wins"))
    return kept.withColumn(child_key, F.coalesce("keeper_id", child_key)).select(*children.columns)


def redirects(existing: DataFrame, moves: DataFrame) -> DataFrame:
    """Redirects (old_path, new_path) after pages moved (old_path, new_path): moves added or overwritten, older ones that led to a moved page led on.

    Moves lead to pages that stay, so one step is enough. Moves to the same path are dropped.
    """
    real = moves.where("old_path <> new_path")
    on = real.select(F.col("old_path").alias("gone"), F.col("new_path").alias("to"))
    old = existing.join(real.select("old_path"), "old_path", "left_anti").join(on, F.col("new_path") == F.col("gone"), "left")
    return old.select("old_path", F.coalesce("to", "new_path").alias("new_path")).unionByName(real.select("old_path", "new_path"))
