"""Helpers around the session: durable lineage cuts and task spreading."""

from __future__ import annotations

import math
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the workers of a session this package, once, as a zip that Spark itself distributes."""
    sc = spark.sparkContext
    if getattr(sc, "_placeweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="placeweave-package-")
    with zipfile.ZipFile(f"{folder}/placeweave.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(f"{folder}/placeweave.zip")
    sc._placeweave_shipped = True


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only in local mode, where neither that setting nor a checkpoint folder exists (tests), a temporary folder is used; on a cluster
    that is an error, as other machines don't see it. The cluster's own setting spark.cleaner.referenceTracking.cleanCheckpoints removes
    what nothing refers to any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="placeweave-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: Column | str, per_core: int = 2) -> DataFrame:
    """Hash-repartition rows for CPU-bound Python stages if the scan has too few splits.

    Large inputs already have more splits than cores and pass through unshuffled.
    The keys should be unique so that no hot key lands in one task. For plain scans only: of a plan
    with a shuffle the number of partitions would be found by running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core, *keys)


def short_list(df: DataFrame, most: int = 10_000) -> list[Row]:
    """All rows of a list that is short by its nature; more than ``most`` are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most:,} rows where a short list was expected")
    return rows


#: Rows of one key that one task gets, and how many keys with more are looked up by a broadcast.
HOT_ROWS, MOST_HOT = 50_000, 100_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, spread_by: list[str] | None = None, most_hot: int = MOST_HOT) -> DataFrame:
    """left joined with right on keys (inner or left), hot keys of left split over tasks.

    A key with more than hot_rows rows is cut into pieces of about that many, whatever the size of left, right's rows of it being copied to each.
    The piece of a row is a hash of ``spread_by`` (by default of all its columns but maps), so a task that runs again draws the same. The
    number of pieces comes to the rows by a broadcast for the keys that make up more than a most_hot-th of left (there can't be more than most_hot
    of these), for other hot ones by a join that is itself spread. Null keys join nothing. left is read three times, so it should be durable or cheap.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    counts = left.where(known).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    every = counts.agg(F.count("*").alias("keys"), F.max("_n").alias("top")).first()
    if not every["keys"]:
        return left.join(right, keys, how)
    pieces = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_pieces")
    mark = F.xxhash64(*(spread_by or [c for c, t in left.dtypes if "map<" not in t]))
    one = F.lit(1)
    if every["keys"] <= most_hot:
        hot = F.broadcast(counts.select(*keys, pieces))
        a, b = left.join(hot, keys, "left"), right.join(hot, keys, "left")
        a, b = a.withColumn("_pieces", F.coalesce("_pieces", one)), b.withColumn("_pieces", F.coalesce("_pieces", one))
    else:
        share = left.count() / most_hot
        very, warm = F.broadcast(counts.where(F.col("_n") > share).select(*keys, pieces)), counts.where(F.col("_n") <= share).select(*keys, pieces.alias("_warm"))
        ways = max(1, math.ceil(min(share, every["top"]) / hot_rows))
        copied = warm.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
        a = left.join(very, keys, "left").withColumn("_way", F.pmod(mark, F.lit(ways)).cast("int")).join(copied, [*keys, "_way"], "left").drop("_way")
        b = right.join(very, keys, "left").join(warm, keys, "left")
        a, b = (x.withColumn("_pieces", F.coalesce("_pieces", "_warm", one)).drop("_warm") for x in (a, b))
    a = a.withColumn("_piece", F.pmod(mark, F.col("_pieces")).cast("int")).drop("_pieces")
    b = b.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    return a.join(b, [*keys, "_piece"], how).drop("_piece")


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with ``out``, the number of each row among those of its keys by order, from 0; equal order must not occur within a key.

    Where a key has more than hot_rows rows, rows are sorted by range of keys and order together, so that a hot key lies in many tasks, and are
    counted from the start of their range; ranges are made durable first, as another run might cut them elsewhere. Nulls in keys are a key.
    """
    if not keys:
        return ranked(df.withColumn("_all", F.lit(0)), ["_all"], order, out, hot_rows).drop("_all")
    biggest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    own = Window.partitionBy(*keys).orderBy(*order)
    if biggest <= hot_rows:
        return df.withColumn(out, (F.row_number().over(own) - 1).cast("long"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = durable(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = cut.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1)
    return numbered.join(offsets, same).withColumn(out, (F.col("_i") + F.col("_before")).cast("long")).select(*df.columns, out)


def salts_for(count: Column, rows_per_task: int) -> Column:
    """Number of pieces a group of ``count`` rows is split into."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(rows_per_task))).cast("int")
