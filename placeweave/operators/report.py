"""Yield and import reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.functions import text


def by_type(kept: DataFrame) -> DataFrame:
    return kept.groupBy(F.coalesce(text.none_if_empty("listing_type"), F.lit("?")).alias("listing_type")).agg(F.count("*").alias("n"))


def keyword_yield(stats: DataFrame, kept: DataFrame) -> DataFrame:
    """(method, keyword, searches, listed, kept, only): of each kind of search the tasks run, results listed, places kept and those no other kind found.

    stats: (key, found); kept: (place, found_by array). Arrays are made distinct in the row, so a place costs no shuffle of its own.
    """
    runs = stats.select(text.task_parts("key").alias("t"), "found").groupBy("t.method", "t.keyword").agg(F.count("*").alias("searches"), F.coalesce(F.sum("found"), F.lit(0)).alias("listed"))
    kinds = F.array_distinct(F.transform("found_by", lambda k: F.struct(text.task_parts(k)["method"].alias("method"), text.task_parts(k)["keyword"].alias("keyword"))))
    found = kept.select(kinds.alias("kinds")).select(F.explode("kinds").alias("k"), (F.size("kinds") == 1).alias("alone"))
    places = found.groupBy("k.method", "k.keyword").agg(F.count("*").alias("kept"), F.count_if("alone").alias("only"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("searches", "listed", "kept", "only")]
    return runs.join(places, ["method", "keyword"], "full").select("method", "keyword", *zero)


def only_grid(kept: DataFrame) -> DataFrame:
    """One row n: places that grid searches alone found."""
    return kept.agg(F.count_if((F.size("found_by") > 0) & F.forall("found_by", lambda k: k.startswith("grid:"))).alias("n"))


def area_yield(stats: DataFrame, kept: DataFrame) -> DataFrame:
    """(area, n): distinct places of each searched area, 0 included. kept: (place_id, name, found_by)."""
    asked = stats.where(F.col("key").startswith("area:")).select(text.task_parts("key")["area"].alias("area")).distinct()
    areas = F.array_distinct(F.filter(F.transform("found_by", lambda k: F.when(k.startswith("area:"), text.task_parts(k)["area"])), lambda a: a.isNotNull()))
    place = F.coalesce(text.none_if_empty("place_id"), F.col("name"))
    found = kept.select(place.alias("place"), F.explode(areas).alias("area")).groupBy("area").agg(F.countDistinct("place").alias("n"))
    return asked.join(found, "area", "full").select("area", F.coalesce("n", F.lit(0)).alias("n"))


def reject_reasons(rejected: DataFrame) -> DataFrame:
    """(reason, n): reasons without what stands in brackets."""
    return rejected.groupBy(F.substring_index("reason", " (", 1).alias("reason")).agg(F.count("*").alias("n"))


def import_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def per_area(assigned: DataFrame, areas: DataFrame) -> DataFrame:
    """(ord, area, n) of the plan's areas in order, 0 included."""
    n = assigned.where("area <> ''").groupBy("area").agg(F.count("*").alias("n"))
    return areas.join(n, "area", "left").select("ord", "area", F.coalesce("n", F.lit(0)).alias("n"))


def unlisted(assigned: DataFrame) -> DataFrame:
    """(sector, n) of sectors that addresses name and the plan lacks."""
    return assigned.where("unlisted_sector <> ''").groupBy(F.col("unlisted_sector").alias("sector")).agg(F.count("*").alias("n"))


def without_area(assigned: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, name, address) of places that no area could be found for."""
    empty = F.lit("")
    return places.join(assigned.where("area = ''").select(key), key, "left_semi").select(key, F.coalesce("name", empty).alias("name"), F.coalesce("address", empty).alias("address"))


def stalled(scrolls: DataFrame, times: int = 3) -> DataFrame:
    """(task_key, stop): the first scroll of a search with so many equal counts in a row before it, itself included in no run of its own.

    scrolls: (task_key, ord, n). Runs of equal counts are islands of a running sum; searches are short.
    """
    w = Window.partitionBy("task_key").orderBy("ord")
    change = F.coalesce((F.col("n") != F.lag("n").over(w)).cast("int"), F.lit(1))
    runs = scrolls.withColumn("c", change).withColumn("run", F.sum("c").over(w))
    nth = F.row_number().over(Window.partitionBy("task_key", "run").orderBy("ord")) - 1
    return runs.withColumn("same", nth).where(F.col("same") >= times).groupBy("task_key").agg(F.min("ord").alias("stop"))
