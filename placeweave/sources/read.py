"""Sources: raw JSON dumps, state files, centres, tables and page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.plans.config import read_boundary
from placeweave.schema import CENTRE, RAW_PLACE, schema_order
from placeweave.session import short_list


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def raw_places(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files that hold one array each; unknown keys are dropped, missing ones null."""
    return spark.read.schema(RAW_PLACE).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same records one per line, the form that splits and so suits large inputs."""
    return spark.read.schema(RAW_PLACE).json(path)


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file beside the records, or no rows if it doesn't exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def centres(spark: SparkSession, path: str, areas: DataFrame | None = None) -> DataFrame:
    """Area centres with both coordinates, in file order (ord), of the given areas (area) only."""
    rows = spark.read.schema(CENTRE).option("header", True).csv(path).withColumn("ord", F.monotonically_increasing_id())
    rows = rows.where("lat IS NOT NULL AND lng IS NOT NULL")
    return rows if areas is None else rows.join(areas, "area", "left_semi")


def boundary(spark: SparkSession, path: str) -> list:
    """Polygons of a GeoJSON file."""
    return read_boundary("\n".join(r["value"] for r in short_list(spark.read.text(path, wholetext=True), 1)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32, **options: str) -> DataFrame:
    """A database table read in parallel by ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def tolerant(df: DataFrame) -> DataFrame:
    """Any frame brought to the schema of raw places."""
    return df.select(*schema_order(df.columns, RAW_PLACE))
