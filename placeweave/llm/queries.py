"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.llm import canonical, packing, personal, premises, subjects, survivor, tokens
from placeweave.session import spread


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.match_areas(*(load(spark, folder, t) for t in ("raw_place", "city", "area", "area_alias")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.listing_survivors(load(spark, folder, "listing")).select("keeper_id", "field", "source_id")


def p3_merged(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.merged_listings(load(spark, folder, "listing"))


#: The key of the pseudonyms in p5_redacted; a real run gives its own secret.
DEMO_KEY = b"placeweave demonstration key"


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_cases(load(spark, folder, "review"), load(spark, folder, "person_name"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal.redact(load(spark, folder, "review"), load(spark, folder, "person_name"), DEMO_KEY)


def premises_inputs(spark: SparkSession, folder: str) -> list[DataFrame]:
    city, area, alias, raw, listing = (load(spark, folder, t) for t in ("city", "area", "area_alias", "raw_place", "listing"))
    typed = spread(raw.select(F.col("raw_id").alias("id"), "city", "address"), "id")
    named = spread(listing.select("id", "city_id", "address"), "id").join(city.select(F.col("id").alias("city_id"), F.col("name").alias("city")), "city_id", "left").select("id", "city", "address")
    return [typed, named, city, area, alias]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return premises.same_premises(*premises_inputs(spark, folder)).select(F.col("left_id").alias("raw_id"), F.col("right_id").alias("listing_id"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each address with its class and its number of links to the other table."""
    rows = premises.linked_premises(*premises_inputs(spark, folder))
    return rows.select(F.when(F.col("side") == "l", "raw_place").otherwise("listing").alias("source"), "id", "class_id", "links")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.corpus_ids(load(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(load(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(*(load(spark, folder, t) for t in ("documents", "doc_label", "subject")))


def p9_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    rows = subjects.document_subjects(*(load(spark, folder, t) for t in ("documents", "doc_label", "subject")), mixtures=True)
    return rows.withColumn("share", F.round("share", 4))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_merged": p3_merged, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_classes": p6_classes, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_mixtures": p9_mixtures}
KEY = """CASE WHEN regexp_full_match(p, '0x[0-9a-f]+:0x[0-9a-f]+') THEN p ELSE nullif(regexp_extract(u, '(!1s|[?&]ftid=|[?&]q=)(0x[0-9a-f]+:0x[0-9a-f]+)', 2), '') END"""


def survivor_sql() -> str:
    """p3_found by plain grouping: the latest filled value of each field, or the keeper's where a row locks it."""
    parts = []
    for f in survivor.MERGE_FIELDS:
        name = f.removesuffix("_id")
        missing = {"categories": "coalesce(len({}), 0) = 0", "hours": "coalesce(cardinality({}), 0) = 0"}.get(f)
        if missing is None:
            missing = "coalesce({}, 0) = 0" if f in ("area_id", "rating", "review_count", "latitude", "longitude") else "trim(coalesce({}, ''), ' ' || chr(9) || chr(10) || chr(13)) = ''"
        full = f"NOT ({missing.format(f)})"
        parts.append(f"""SELECT keeper_id, '{name}' AS field, CASE WHEN bool_or(list_contains(coalesce(locked_fields, []), '{name}')) THEN max(id) FILTER (WHERE id = keeper_id AND {full})
            ELSE arg_max(id, (coalesce(updated_at, TIMESTAMP '0001-01-01'), low, id)) FILTER (WHERE {full}) END AS source_id FROM r GROUP BY 1""")
    return f"""WITH t AS (SELECT *, trim(lower(replace(replace(coalesce(place_id, ''), '%3A', ':'), '%3a', ':')), ' ' || chr(9) || chr(10) || chr(13)) AS p, lower(replace(replace(coalesce(maps_url, ''), '%3A', ':'), '%3a', ':')) AS u,
          coalesce(regexp_matches(slug, '-[0-9]+$'), false) AS low FROM listing), k AS (SELECT *, {KEY} AS place FROM t),
        g AS (SELECT city_id AS c, place AS q, arg_min(id, (low, id)) AS keeper_id FROM k WHERE place IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
        r AS (SELECT k.*, g.keeper_id FROM k JOIN g ON g.c IS NOT DISTINCT FROM k.city_id AND g.q = k.place)
        SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE source_id IS NOT NULL"""


SQL: dict[str, str] = {"p3_found": survivor_sql()}
