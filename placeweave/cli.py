"""Command line: python -m placeweave.cli COMMAND --data FOLDER [...]; tables are FOLDER/<name>.parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text
from placeweave.operators import dedupe, merge, report, serve
from placeweave.plans import config, tasks
from placeweave.session import durable, ship
from placeweave.sources import read, write


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="placeweave")
    sub = p.add_subparsers(dest="command", required=True)
    plan = sub.add_parser("plan", help="write the search tasks of a plan file")
    plan.add_argument("--file", required=True)
    plan.add_argument("--areas", nargs="*")
    plan.add_argument("--out", required=True)
    load = sub.add_parser("import", help="import raw JSON records into the listings")
    load.add_argument("--file", required=True)
    load.add_argument("--city", required=True)
    load.add_argument("--plan")
    merge_ = sub.add_parser("dedupe", help="merge listings of one place")
    rep = sub.add_parser("report", help="count kept places by type and searches")
    for s in (load, merge_, rep):
        s.add_argument("--data", required=True)
    for s in (load, merge_):
        s.add_argument("--out", help="folder for the new tables; without it nothing is written")
    return p


def items(raw: DataFrame, city_id: int) -> DataFrame:
    """Raw records as import items, numbered in file order."""
    kept = (raw if "ord" in raw.columns else raw.withColumn("ord", F.monotonically_increasing_id())).withColumn("city_id", F.lit(city_id).cast("long")).withColumnRenamed("google_maps_url", "maps_url")
    return kept.select("ord", "city_id", "place_id", *[f for f in merge.FIELDS if f in kept.columns])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Run one command and give what it shows."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("placeweave").getOrCreate()
    ship(spark)
    if args.command == "plan":
        out = tasks.build(spark, config.load(args.file), args.areas)
        out.write.mode("overwrite").parquet(args.out)
        shown = tasks.counts(out)
    elif args.command == "import":
        listing, city = read.table(spark, args.data, "listing"), read.table(spark, args.data, "city")
        row = city.where(F.col("slug") == text.slugify(F.lit(args.city), 100, "")).select("id").first()
        if row is None:
            raise SystemExit(f"unknown city: {args.city}")
        exclude = tuple(config.load(args.plan, args.city).exclude) if args.plan else ()
        raw = durable(read.raw_places(spark, args.file).withColumn("ord", F.monotonically_increasing_id()))
        result = merge.import_batch(items(raw, row["id"]), listing, exclude)
        if args.out:
            listings, ids = merge.with_created(result, listing)
            write.write_table(listings, f"{args.out}/listing.parquet")
            if read.exists(spark, f"{args.data}/review.parquet"):
                reviews = merge.imported_reviews(raw.select("ord", "reviews"), ids, read.table(spark, args.data, "review"), listing)
                write.write_table(reviews, f"{args.out}/review.parquet")
        shown = report.import_counts(result["outcomes"].select("outcome").unionByName(result["skipped"].select("outcome")))
    elif args.command == "dedupe":
        listing = read.table(spark, args.data, "listing")
        if args.out:
            of = dedupe.members(listing)
            write.write_table(dedupe.deduped(listing), f"{args.out}/listing.parquet")
            if read.exists(spark, f"{args.data}/review.parquet"):
                write.write_table(dedupe.moved_children(of, read.table(spark, args.data, "review"), "listing_id"), f"{args.out}/review.parquet")
            if read.exists(spark, f"{args.data}/city.parquet"):
                home = read.table(spark, args.data, "city").select(F.col("id").alias("city_id"), F.col("slug").alias("home"))
                path = listing.join(home, "city_id").select("id", serve.detail_path(F.col("home"), F.col("slug")).alias("path"))
                moves = of.where("id <> keeper_id").join(path.withColumnRenamed("path", "old_path"), "id").join(path.select(F.col("id").alias("keeper_id"), F.col("path").alias("new_path")), "keeper_id")
                known = read.table(spark, args.data, "redirect") if read.exists(spark, f"{args.data}/redirect.parquet") else spark.createDataFrame([], "old_path string, new_path string")
                write.write_table(dedupe.redirects(known, moves.select("old_path", "new_path")), f"{args.out}/redirect.parquet")
        shown = dedupe.clusters(listing).agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    else:
        shown = report.by_type(read.table(spark, args.data, "raw_place"))
    shown.show(100, truncate=False)
    return shown


if __name__ == "__main__":
    main()
