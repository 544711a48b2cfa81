"""Sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.sources.read import exists


def _move(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"can't move {old} to {new}")


def replace(path: str, spark, write: Callable[[str], None]) -> None:
    """Let ``write`` write beside path, then put it in path's place: readers see the old output until the new one is complete."""
    jvm = spark._jvm.org.apache.hadoop.fs
    here, new, old = (jvm.Path(path + end) for end in ("", f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    write(new.toString())
    if fs.exists(here):
        _move(fs, here, old)
    _move(fs, new, here)
    fs.delete(old, True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; readers see the old files until the new ones are complete."""
    replace(path, df.sparkSession, lambda to: df.write.json(to))


def write_table(df: DataFrame, path: str) -> None:
    replace(path, df.sparkSession, lambda to: df.write.parquet(to))


def flat(df: DataFrame) -> DataFrame:
    """Rows for CSV: plain columns, categories joined by ", ", hours and reviews as JSON, images' files or URLs joined by "|"; other nested columns are dropped."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    empty = F.lit("")
    shown = F.transform(F.coalesce("images", F.array().cast(df.schema["images"].dataType)), lambda i: F.coalesce(F.nullif(i["file"], empty), i["url"], empty))
    return df.select(
        *plain, F.coalesce(F.array_join("categories", ", "), empty).alias("categories"), F.coalesce(F.to_json("hours"), F.lit("{}")).alias("hours"),
        F.coalesce(F.to_json("reviews"), F.lit("[]")).alias("reviews"), F.array_join(shown, "|").alias("images"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; each file begins with a byte order mark, by which spreadsheets know the encoding."""
    rows = flat(df)
    marked = rows.withColumnRenamed(rows.columns[0], f"\ufeff{rows.columns[0]}")
    replace(path, df.sparkSession, lambda to: marked.write.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(to))


def backup(df_path: str, spark) -> str | None:
    """Move an earlier output aside to <path>.bak, replacing an older one; None if there is nothing."""
    if not exists(spark, df_path):
        return None
    jvm, kept = spark._jvm, f"{df_path}.bak"
    old, new = jvm.org.apache.hadoop.fs.Path(df_path), jvm.org.apache.hadoop.fs.Path(kept)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(new, True)
    _move(fs, old, new)
    return kept


def usable_photos(photos: DataFrame, least_bytes: int = 5000) -> DataFrame:
    """Photos (content_type, n_bytes) of a known type and real size, with ext, the suffix of their file; merge.numbered_photos numbers them."""
    kind = F.trim(F.substring_index("content_type", ";", 1))
    ext = F.when(kind == "image/jpeg", "jpg").when(kind == "image/png", "png").when(kind == "image/webp", "webp")
    return photos.withColumn("ext", ext).where(F.col("ext").isNotNull() & (F.col("n_bytes") >= least_bytes))


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Simple unprotected upsert: rows of the batch replace those with the same keys; keys in the batch must be unique."""
    return target.join(batch.select(*keys), keys, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))
