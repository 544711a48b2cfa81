"""Queries of the core operators: name -> (spark, folder) -> DataFrame, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators import near, nested


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PLACE = "$[]"
MAPS = [f"{PLACE}.hours"]
INLINE = [f"{PLACE}.{f}" for f in ("reviews", "hours", "categories", "found_by")]


def dump_nodes(dumps: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return nested.shred(dumps, "dump_id", "payload", keep, MAPS, INLINE)


def place_children(dumps: DataFrame) -> DataFrame:
    """Children of the places of raw dumps: (dump_id, place_pos, child, child_key), distinct.

    A child stands in a list, alone in the member itself, in a map or in JSON text; categories also in text parted by commas.
    """
    r, h, c, f = (f"{PLACE}.{x}" for x in ("reviews", "hours", "categories", "found_by"))
    keep = [f"{r}[].author", f"{r}[].text", f"{r}.author", f"{r}.text", f"{h}{{}}", f"{h}[].day", c, f"{c}[]", f, f"{f}[]"]
    nodes = dump_nodes(dumps, keep)
    path, value, squeezed = F.col("schema_path"), F.col("value"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    filled = value.isNotNull() & (squeezed != "")
    review = path.startswith(r)
    # the label of a review's member without its last part is the review's; of a single review, the member's own is position 0
    position = F.when(path.startswith(f"{r}[]"), nested.step(nested.parent(F.col("dewey")), 2).cast("string")).otherwise("0")
    day = F.when(path == f"{h}{{}}", F.regexp_replace("name", r"(?U)^\s+|\s+$", "")).otherwise(squeezed)
    listed = F.when(path == c, F.split("value", ",")).otherwise(F.array("value"))
    keys = (
        F.when(review & filled, F.array(position))
        .when(path.startswith(h) & ((path == f"{h}{{}}") | filled), F.array(day))
        .when((path.startswith(c) | path.startswith(f)) & filled, F.when(path.startswith(c), F.transform(listed, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))).otherwise(F.array("value")))
    )
    child = F.when(review, "review").when(path.startswith(h), "hours").when(path.startswith(c), "category").otherwise("found_by")
    rows = nodes.select("dump_id", nested.step(F.col("dewey"), 0).alias("place_pos"), child.alias("child"), F.explode(keys).alias("child_key"))
    return rows.where(F.col("child_key") != "").distinct()


def centres_near_pins(raw: DataFrame, centres: DataFrame, km: float = 1.5) -> DataFrame:
    return near.radius_join(raw, centres, ("raw_id", "latitude", "longitude"), ("area_id", "lat", "lng"), km, metric="flat")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return place_children(load(spark, folder, "raw_dump"))


def p1_review_table(spark: SparkSession, folder: str) -> DataFrame:
    """The flat review table of all dumps, each row still naming its dump, its own label and its parent's.

    A review that stands alone in the member itself has the member's label, and the place's as its parent.
    """
    alone = f"{PLACE}.reviews"
    r = f"{alone}[]"
    fields = {x: x for x in ("author", "text", "date", "rating")}
    nodes = dump_nodes(load(spark, folder, "raw_dump"), [r, *(f"{p}.{x}" for p in (r, alone) for x in fields)])
    nodes = nodes.withColumn("schema_path", F.replace("schema_path", F.lit(f"{alone}."), F.lit(f"{r}.")))
    return nested.table(nodes, r, fields, "dump_id").where(F.coalesce("author", "text", "date", "rating").isNotNull())


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return centres_near_pins(load(spark, folder, "raw_place"), load(spark, folder, "area_centre")).select("raw_id", "area_id")


def p1_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The dumps whose payload is broken off."""
    return nested.rejected(load(spark, folder, "raw_dump"), "dump_id", "payload").select("dump_id")


def p4_great_circle(spark: SparkSession, folder: str) -> DataFrame:
    """All area centres within 3 km of each place's pin on the sphere, with the distance."""
    found = near.radius_join(load(spark, folder, "raw_place"), load(spark, folder, "area_centre"), ("raw_id", "latitude", "longitude"), ("area_id", "lat", "lng"), 3.0)
    return found.select("raw_id", "area_id", F.round("km", 3).alias("km"))


QUERIES = {"p1_found": p1_found, "p1_review_table": p1_review_table, "p1_rejected": p1_rejected, "p4_found": p4_found, "p4_great_circle": p4_great_circle}

SQL = {
    "p1_found": """
        WITH d AS (SELECT dump_id, CAST(payload AS JSON) AS j FROM raw_dump WHERE json_valid(payload)),
          p AS (SELECT d.dump_id, CAST(e.key AS INTEGER) AS place_pos, e.value AS v FROM d, json_each(d.j) e WHERE json_type(d.j) = 'ARRAY'),
          m AS (SELECT dump_id, place_pos, k, CASE WHEN json_type(v, '$.' || k) = 'VARCHAR' AND json_valid(v ->> ('$.' || k)) AND left(trim(v ->> ('$.' || k)), 1) IN ('[', '{') THEN CAST(v ->> ('$.' || k) AS JSON) ELSE json_extract(v, '$.' || k) END AS x
            FROM p, (VALUES ('reviews'), ('hours'), ('categories'), ('found_by')) n(k)),
          e AS (SELECT m.dump_id, m.place_pos, m.k, json_type(m.x) AS kind, c.key, c.value FROM m, json_each(m.x) c WHERE json_type(m.x) IN ('ARRAY', 'OBJECT')),
          s AS (SELECT dump_id, place_pos, k, x ->> '$' AS t FROM m WHERE json_type(x) = 'VARCHAR'),
          r AS (SELECT dump_id, place_pos, 'review' AS child, key AS child_key FROM e WHERE k = 'reviews' AND kind = 'ARRAY' AND trim(coalesce(value ->> 'author', '') || coalesce(value ->> 'text', '')) <> ''
            UNION ALL SELECT dump_id, place_pos, 'review', '0' FROM m WHERE k = 'reviews' AND json_type(x) = 'OBJECT' AND trim(coalesce(x ->> 'author', '') || coalesce(x ->> 'text', '')) <> ''
            UNION ALL SELECT dump_id, place_pos, 'hours', CASE WHEN kind = 'OBJECT' THEN key ELSE value ->> 'day' END FROM e WHERE k = 'hours'
            UNION ALL SELECT dump_id, place_pos, 'category', trim(value ->> '$') FROM e WHERE k = 'categories'
            UNION ALL SELECT dump_id, place_pos, 'category', trim(unnest(string_split(t, ','))) FROM s WHERE k = 'categories'
            UNION ALL SELECT dump_id, place_pos, 'found_by', value ->> '$' FROM e WHERE k = 'found_by'
            UNION ALL SELECT dump_id, place_pos, 'found_by', t FROM s WHERE k = 'found_by')
        SELECT DISTINCT dump_id, place_pos, child, child_key FROM r WHERE trim(child_key) <> ''
    """,
    "p1_review_table": """
        WITH d AS (SELECT dump_id, CAST(payload AS JSON) AS j FROM raw_dump WHERE json_valid(payload)),
          p AS (SELECT d.dump_id, e.key AS place_pos, e.value AS v FROM d, json_each(d.j) e WHERE json_type(d.j) = 'ARRAY'),
          m AS (SELECT dump_id, place_pos, place_pos || '.' || (list_position(json_keys(v), 'reviews') - 1) AS own_dewey,
              CASE WHEN json_type(v, '$.reviews') = 'VARCHAR' AND json_valid(v ->> 'reviews') AND left(trim(v ->> 'reviews'), 1) IN ('[', '{') THEN CAST(v ->> 'reviews' AS JSON) ELSE json_extract(v, '$.reviews') END AS x FROM p),
          e AS (SELECT m.dump_id, own_dewey || '.' || c.key AS dewey, own_dewey AS parent_dewey, c.value FROM m, json_each(m.x) c WHERE json_type(m.x) = 'ARRAY'
            UNION ALL SELECT dump_id, own_dewey, CAST(place_pos AS VARCHAR), x FROM m WHERE json_type(x) = 'OBJECT')
        SELECT dump_id, dewey, value ->> 'author' AS author, value ->> 'text' AS text, value ->> 'date' AS date, value ->> 'rating' AS rating, parent_dewey
        FROM e WHERE coalesce(value ->> 'author', value ->> 'text', value ->> 'date', value ->> 'rating') IS NOT NULL
    """,
    "p1_rejected": "SELECT dump_id FROM raw_dump WHERE trim(payload) <> '' AND NOT json_valid(payload)",
    "p4_great_circle": """
        WITH ok AS (SELECT * FROM (SELECT raw_id, latitude AS a, longitude AS b FROM raw_place) WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND a <> 0 AND b <> 0 AND abs(a) <= 90 AND abs(b) <= 180),
        okc AS (SELECT * FROM (SELECT area_id, lat AS a, lng AS b FROM area_centre) WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND a <> 0 AND b <> 0 AND abs(a) <= 90 AND abs(b) <= 180),
        d AS (SELECT raw_id, area_id, 2 * 6371 * asin(sqrt(least(1, pow(sin(radians(okc.a - ok.a) / 2), 2) + cos(radians(ok.a)) * cos(radians(okc.a)) * pow(sin(radians(okc.b - ok.b) / 2), 2)))) AS km FROM ok, okc)
        SELECT raw_id, area_id, round(km, 3) AS km FROM d WHERE km <= 3
    """,
    "p4_found": """
        WITH p AS (SELECT raw_id, latitude AS a, longitude AS b FROM raw_place),
        c AS (SELECT area_id, lat AS a, lng AS b FROM area_centre),
        ok AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND a <> 0 AND b <> 0 AND abs(a) <= 90 AND abs(b) <= 180),
        okc AS (SELECT * FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b) AND a <> 0 AND b <> 0 AND abs(a) <= 90 AND abs(b) <= 180)
        SELECT raw_id, area_id FROM ok, okc
        WHERE 6371 * sqrt(pow(radians(okc.b - ok.b) * cos(radians((ok.a + okc.a) / 2)), 2) + pow(radians(okc.a - ok.a), 2)) <= 1.5
    """,
}
