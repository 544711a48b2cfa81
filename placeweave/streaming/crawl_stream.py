"""The crawl fed by a stream of hits: each micro-batch is folded into the places seen so far."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.operators.crawl import provenance
from placeweave.sources.read import exists

STATE = "place_key string, found_by array<string>, first_ord long"


def fold_batch(state: DataFrame, hits: DataFrame) -> DataFrame:
    """State (place_key, found_by, first_ord) after hits (place_key, task_key, ord): new places added, provenance appended once, in order."""
    new = provenance(hits, "place_key").join(hits.groupBy("place_key").agg(F.min("ord").alias("new_ord")), "place_key").withColumnRenamed("found_by", "new_by")
    both = state.join(new, "place_key", "full")
    empty = F.array().cast("array<string>")
    return both.select(
        "place_key", F.array_union(F.coalesce("found_by", empty), F.coalesce("new_by", empty)).alias("found_by"),
        F.least(F.coalesce("first_ord", "new_ord"), F.coalesce("new_ord", "first_ord")).alias("first_ord"),
    )


def run(hits: DataFrame, folder: str, checkpoint: str, stop_file: str | None = None, max_hours: float | None = None, every: float = 1.0) -> None:
    """Consume the hits that are there and stop; with a stop file or a deadline go on with new ones until the file is there or the time is over.

    State versions are written as folder/v<batch>, so a batch that was broken off is done again and gives the same version. The
    version before must be there, else its provenance would be lost: that is an error. Versions before the last two are removed.
    """
    spark = hits.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = f"{folder}/v{number - 1}"
        if number and not exists(spark, before):
            raise FileNotFoundError(f"state {before} is missing")
        state = spark.read.parquet(before) if number else spark.createDataFrame([], STATE)
        fold_batch(state, batch).write.mode("overwrite").parquet(f"{folder}/v{number}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    writer = hits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if stop_file is None and max_hours is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    end = time.monotonic() + 3600 * (max_hours if max_hours is not None else float("inf"))
    query = writer.trigger(processingTime=f"{every} seconds").start()
    while not query.awaitTermination(every):
        if time.monotonic() >= end or (stop_file is not None and exists(spark, stop_file)):
            query.stop()
            return


def latest(spark, folder: str) -> DataFrame:
    """The newest state."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    newest = max(int(n[1:]) for n in names if n.startswith("v"))
    return spark.read.parquet(f"{folder}/v{newest}")
