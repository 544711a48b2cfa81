"""The crawl as a batch: hits of searches to kept and rejected places with their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import text
from placeweave.operators.classify import Scope, verdict
from placeweave.schema import is_empty


def first_links(links: DataFrame, keys: list[str], most: int = 120) -> DataFrame:
    """(keys, ord, place_id, url) of the first link of each place of a task (links: keys, ord, url), at most ``most`` of a task, the first by ord.

    Ord must be unique within a task. Places are reduced to their first link map-side, and each partition hands on at most ``most`` of a task, so a
    task may have any number of links.
    """
    named = links.withColumn("place_id", text.place_id(F.lit(""), "url")).where("place_id <> ''")
    first = named.groupBy(*keys, "place_id").agg(F.min_by(F.struct("ord", "url"), "ord").alias("v")).select(*keys, "v.ord", "place_id", "v.url")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("_r") <= most).drop("_r")


def result_urls(hrefs: DataFrame, most: int = 120) -> DataFrame:
    """(task_key, pos, place_id, url) of the first link of each place of a task (task_key, hrefs: array), at most ``most`` of a task. Each row is a task of its own."""
    links = hrefs.withColumn("_task", F.monotonically_increasing_id()).select("_task", "task_key", F.posexplode("hrefs").alias("ord", "url"))
    return first_links(links, ["_task", "task_key"], most).select("task_key", F.col("ord").alias("pos"), "place_id", "url")


def listed_urls(links: DataFrame, most: int = 120) -> DataFrame:
    """What result_urls gives, of links that are rows (task_key, ord, url): pos is the number of links of the task before, those without a place too.

    A task's links never become one list: each adds one to the first link behind it, a sum made map-side as long as the first links' places in the order can be
    broadcast. Links without a task don't count.
    """
    first = first_links(links.where("task_key IS NOT NULL"), ["task_key"], most)
    lists = first.groupBy("task_key").agg(F.array_sort(F.collect_list(F.struct("ord", "place_id", "url"))).alias("l"))
    met = links.join(lists.select("task_key", F.col("l.ord").alias("ords")), "task_key").withColumn("i", F.size(F.filter("ords", lambda o: o <= F.col("ord"))))
    counts = met.where(F.col("i") < F.size("ords")).groupBy("task_key", "i").agg(F.count("*").alias("n"))
    each = lists.select("task_key", F.posexplode("l").alias("i", "v")).join(counts, ["task_key", "i"], "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("task_key").orderBy("i"))
    return each.select("task_key", before.cast("int").alias("pos"), "v.place_id", "v.url")


def provenance(hits: DataFrame, key: str) -> DataFrame:
    """(key, found_by): the distinct task keys that found a place, in order of their first hit (ord). A task is counted once before lists are built."""
    once = hits.groupBy(key, "task_key").agg(F.min("ord").alias("ord"))
    lists = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "task_key"))).alias("l"))
    return lists.select(key, F.transform("l", lambda x: x["task_key"]).alias("found_by"))


def fold(hits: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, rejected, stats) of hits (ord, task_key, name, address, categories, closed, latitude, longitude, place_id, ...).

    A place is visited at its first hit; its verdict comes from there. stats: found, new, kept, rejected of each task.
    """
    keyed = hits.withColumn("place_key", text.entity_key("place_id", "name", "address"))
    columns = [c for c in hits.columns if c not in ("ord", "task_key")]
    first = keyed.groupBy("place_key").agg(F.min_by(F.struct("ord", "task_key", *columns), "ord").alias("v")).select("place_key", "v.*")
    c = F.col
    judged = first.withColumn("verdict", verdict(c("name"), c("categories"), c("address"), c("closed"), c("latitude"), c("longitude"), scope))
    judged = judged.drop("listing_type").select("*", "verdict.listing_type", "verdict.reason").drop("verdict")
    full = judged.join(provenance(keyed, "place_key"), "place_key")
    kept = full.where("reason = ''").drop("reason")
    rejected = full.where("reason <> ''").drop("listing_type")
    found = hits.groupBy("task_key").agg(F.count("*").alias("found"))
    new = judged.groupBy("task_key").agg(F.count("*").alias("new"), F.count_if(c("reason") == "").alias("kept"), F.count_if(c("reason") != "").alias("rejected"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("new", "kept", "rejected")]
    return kept, rejected, found.join(new, "task_key", "left").select("task_key", "found", *zero)


def needs_update(df: DataFrame) -> Column:
    """Whether a place lacks rating, reviews, a photo's file, hours, position or a current id."""
    photo = F.exists(F.coalesce("images", F.array().cast(df.schema["images"].dataType)), lambda i: F.coalesce(i["file"], F.lit("")) != "")
    return (
        (F.coalesce("rating", F.lit(0.0)) == 0) | (F.coalesce(F.size("reviews"), F.lit(0)) <= 0) | ~photo | (F.coalesce(F.size("hours"), F.lit(0)) <= 0)
        | (F.coalesce("latitude", F.lit(0.0)) == 0) | ~F.coalesce(F.col("place_id"), F.lit("")).startswith("0x")
    )


def fill_missing(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old with those of its fields that are missing taken from new; latitude and longitude go together. Keys must be unique in new."""
    fresh = new.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = old.join(fresh, old[key] == F.col("_k"), "left")
    out = []
    for c in old.columns:
        if c not in fields:
            out.append(F.col(c))
            continue
        source = "latitude" if c == "longitude" and "latitude" in fields else c
        missing = is_empty(source, old.schema[source].dataType)
        usable = ~is_empty(f"_{source}", old.schema[source].dataType)
        out.append(F.when(missing & usable, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)
