"""Filling containers of fixed capacity by bulk-synchronous best fit.

Items of one size are alike, and so are containers with one gap, so both are tables of runs:
(size, number) and (gap, first container, number). There are fewer sizes than the capacity has
units, whatever the corpus holds. A step takes the largest size left, finds the successor gap of all its items at
once, resolves who gets which container by rank, and writes the smaller gaps back for the next
step; the steps yield a table of rank ranges, by which the items find their containers, distributed.

The same can be done by supersteps of Spark over the tables of runs (``plan_runs``): a step sorts items and gaps by
range, finds with one sweep the successor of every gap, resolves conflicts by rank (the i-th gap takes
the i-th item at or behind its successor: a running maximum), and updates the gaps. Sweeps run
within ranges in many tasks and are carried from range to range by one row of each.
"""

from __future__ import annotations

import contextlib
import functools
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from placeweave.llm.tokens import TOKENIZER_DIR, count_column
from placeweave.session import durable, ranked, spread

#: Runs in one range of a sweep, and how many ranges of sizes and gaps a sweep is divided into at most.
RUNS, RANGES = 20_000, 256
#: The largest capacity: the tables of runs, and one row of the plan for each size in the items' join, are bounded by it.
MOST_CAPACITY = 1_000_000


def sweep(counts: dict[int, int], capacity: int, first: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Best fit, largest first, run by run: rows (size, first rank, number of ranks, first container, items of the size in each container).

    Rank r of a row goes to container ``first container + (r - first rank) // items in each``. counts: size -> number of items.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted, of those in runs
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first container, number)
    new = first

    def put(gap: int, container: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((container, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                container, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, container, n = capacity, new, -(-left // (capacity // size))
                new += n
            each = gap // size
            full = min(n, left // each)
            if full:
                plan.append((size, rank, full * each, container, each))
                put(gap - each * size, container, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                plan.append((size, rank, left, container + full, left))
                put(gap - left * size, container + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, container + full, n - full)
    return plan


def _carried(rows: DataFrame, ranges: int, aggs: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with what the ranges (b) before or behind give: carry is computed over one row of aggs for each range. A sweep of one range carries nothing."""
    if ranges == 1:
        return rows.select("*", *[F.lit(None).cast("long").alias(n) for n in carry])
    per = rows.groupBy("b").agg(*[c.alias(n) for n, c in aggs.items()])
    return rows.join(F.broadcast(per.select("b", *[c.alias(n) for n, c in carry.items()])), "b")  # at most RANGES rows


def _before() -> WindowSpec:
    """Over the one row of each range, of which there are at most RANGES: those before it."""
    return Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)


def _behind() -> WindowSpec:
    return Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)


def step(sizes: DataFrame, gaps: DataFrame, capacity: int, total: int, ranges: int = 1) -> DataFrame:
    """One superstep: which items go to which containers, as fragments.

    sizes: (size, n, used); gaps: (gap, first, n). A fragment: items x to y of all by size descending, of one size, to containers of one
    run, ``each`` to a container, the first being the ``offset``-th of its container. ``at`` is the first item of the size, ``start`` of the run.
    """
    both = gaps.select(F.col("gap").alias("v"), F.lit(0).alias("kind"), "first", "n").unionByName(sizes.select(F.col("size").alias("v"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("first"), "n"))
    # ranges by value descending; a gap stands before the items of its own size, which fit it
    both = both.withColumn("b", ((F.lit(capacity) - F.col("v")) * ranges / (capacity + 1)).cast("int"))
    item = F.when(F.col("kind") == 1, F.col("n")).otherwise(0)
    own = Window.partitionBy("b").orderBy(F.desc("v"), "kind", "first")
    before, ahead = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    both = _carried(both, ranges, {"_n": F.sum(item), "_top": F.max(F.when(F.col("kind") == 1, F.col("v")))}, {"n_before": F.sum("_n").over(_before()), "next_top": F.first("_top", ignorenulls=True).over(_behind())})
    both = both.select("b", "v", "kind", "first", "n", (F.coalesce("n_before", zero) + F.coalesce(F.sum(item).over(before), zero)).alias("p"), F.coalesce(F.first(F.when(F.col("kind") == 1, F.col("v")), ignorenulls=True).over(ahead), F.col("next_top")).alias("fit"))
    wants = both.where("kind = 0 AND fit IS NOT NULL").withColumn("each", F.floor(F.col("v") / F.col("fit")).cast("long")).withColumn("d", F.col("n") * F.col("each"))
    order = Window.partitionBy("b").orderBy(F.desc("v"), "first")
    wants = _carried(wants, ranges, {"_d": F.sum("d")}, {"d_before": F.sum("_d").over(_before())})
    wants = wants.withColumn("asked", F.coalesce("d_before", zero) + F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero)).drop("d_before")
    lag = F.col("p") - F.col("asked")
    wants = _carried(wants, ranges, {"_lag": F.max(lag)}, {"lag_before": F.max("_lag").over(_before())})
    # rank by rank: each run starts behind the one before it and not before its successor
    wants = wants.withColumn("start", F.col("asked") + F.greatest(F.max(lag).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.coalesce("lag_before", lag)))
    runs = wants.select(F.col("v").alias("gap"), "first", "n", "each", "start", F.least(F.col("start") + F.col("d"), F.lit(total)).alias("stop")).where("start < stop")
    items = both.where("kind = 1").select(F.col("v").alias("size"), F.col("p").alias("at"), (F.col("p") + F.col("n")).alias("end"))
    # intervals of both kinds meet in ranges of items
    width = max(1, -(-total // (16 * ranges)))
    cut = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))).alias("r")
    met = runs.select("*", cut("start", "stop")).join(items.select("*", cut("at", "end")), "r")
    x = F.greatest("start", "at", F.col("r") * width)
    y = F.least("stop", "end", (F.col("r") + 1) * width)
    return met.withColumn("x", x).withColumn("y", y).where("x < y").select("gap", "first", "n", "each", "start", "size", "at", "x", "y")


def left_over(gaps: DataFrame, fragments: DataFrame) -> DataFrame:
    """gaps (gap, first, n) after a step. Containers all of whose new items lie in one fragment stay runs; those at the ends of fragments are added up one by one."""
    at = lambda c: F.floor((c - F.col("start")) / F.col("each"))
    # whole containers of a fragment: from the first that starts in it to the last that ends in it
    low, high = F.ceil((F.col("x") - F.col("start")) / F.col("each")), at(F.col("y"))
    f = fragments.withColumn("low", low).withColumn("high", F.greatest(low, high))
    whole = f.where("high > low").select((F.col("gap") - F.col("each") * F.col("size")).cast("int").alias("gap"), (F.col("first") + F.col("low")).alias("first"), (F.col("high") - F.col("low")).alias("n"))
    # what of it lies before and behind these, each in one container
    head = F.least(F.col("y"), F.col("start") + F.col("low") * F.col("each")) - F.col("x")
    tail = F.greatest(F.lit(0), F.col("y") - F.col("start") - F.col("high") * F.col("each"))
    ends = f.select("gap", "size", F.explode(F.array(F.struct((F.col("first") + at(F.col("x"))).alias("c"), head.alias("m")), F.struct((F.col("first") + at(F.col("y") - 1)).alias("c"), tail.alias("m")))).alias("e")).where("e.m > 0")
    parts = ends.groupBy(F.col("e.c").alias("first")).agg((F.max("gap") - F.sum(F.col("e.m") * F.col("size"))).cast("int").alias("gap"), F.lit(1).cast("long").alias("n")).select("gap", "first", "n")
    # of a run the containers behind the last that got something are as they were
    served = fragments.groupBy("first").agg(F.max(at(F.col("y") - 1) + 1).alias("served"))
    rest = gaps.join(served, "first", "left").withColumn("served", F.coalesce("served", F.lit(0))).select("gap", (F.col("first") + F.col("served")).alias("first"), (F.col("n") - F.col("served")).alias("n"))
    return whole.unionByName(parts).unionByName(rest).where("n > 0 AND gap > 0")


PLAN = "size int, low long, many long, container long, each long, offset long"


#: Items up to this part of the capacity are kept for the gaps that all others leave.
SMALL = 32


@contextlib.contextmanager
def _interpreted(spark: SparkSession) -> Iterator[None]:
    """Without generated code: a step's tables are short, its constants are new each time, and compiling would take most of it."""
    new = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_runs(sizes: DataFrame, capacity: int, first: int = 0) -> DataFrame:
    """The plan of items given as (size, n), durable: rows (size, low, many, container, each, offset).

    The item of rank r (from 0 among its size) with low <= r < low + many goes to container + (offset + r - low) // each. Each step's tables are
    durable; the driver sees one row of sums at a time.
    """
    counted = durable(sizes.select(F.col("size").cast("int").alias("size"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("used")).coalesce(1))  # fewer rows than the capacity
    with _interpreted(sizes.sparkSession):
        return durable(_steps(counted, capacity, first))


def _steps(sizes: DataFrame, capacity: int, first: int) -> DataFrame:
    spark = sizes.sparkSession
    gaps, plan, opened, floor = spark.createDataFrame([], "gap int, first long, n long"), [], first, capacity // SMALL
    none = F.lit(0).cast("long")
    while True:
        band = sizes.where((F.col("n") > 0) & (F.col("size") > floor))
        state = band.select("size", "n", F.lit(None).cast("int").alias("gap")).unionByName(gaps.select(F.lit(None).cast("int").alias("size"), none.alias("n"), "gap"))
        sums = state.agg(F.coalesce(F.sum("n"), none).alias("items"), F.sum(F.col("n") * F.col("size")).alias("units"), F.min("size").alias("least"), F.max("gap").alias("widest"), F.count("*").alias("runs")).first()
        if not sums["items"]:
            if not floor:
                break
            floor = 0
            continue
        usable = gaps.where(F.col("gap") >= sums["least"])
        if (sums["widest"] or 0) < sums["least"]:
            more = -(-sums["units"] // capacity)
            usable = spark.createDataFrame([(capacity, opened, more)], "gap int, first long, n long")
            opened += more
        ranges = min(RANGES, sums["runs"] // RUNS + 1)
        fragments = durable(step(band, usable, capacity, sums["items"], ranges).coalesce(ranges))
        plan.append(
            fragments.join(F.broadcast(sizes.select("size", "used")), "size").select(
                "size", (F.col("used") + F.col("x") - F.col("at")).alias("low"), (F.col("y") - F.col("x")).alias("many"), (F.col("first") + F.floor((F.col("x") - F.col("start")) / F.col("each"))).alias("container"),
                "each", ((F.col("x") - F.col("start")) % F.col("each")).alias("offset"),
            )
        )
        t = F.coalesce("t", none)
        taken = fragments.groupBy("size").agg(F.sum(F.col("y") - F.col("x")).alias("t"))
        after = sizes.join(F.broadcast(taken), "size", "left").select("size", (F.col("n") - t).alias("n"), (F.col("used") + t).alias("used"), F.lit(None).cast("int").alias("gap"), F.lit(None).cast("long").alias("first"))  # fewer rows than the capacity
        open_ = left_over(usable, fragments).unionByName(gaps.where(F.col("gap") < sums["least"]))
        both = durable(after.unionByName(open_.select(F.lit(None).cast("int").alias("size"), "n", none.alias("used"), "gap", "first")).coalesce(ranges))
        sizes, gaps = both.where("size IS NOT NULL").select("size", "n", "used"), both.where("gap IS NOT NULL").select("gap", "first", "n")
    return functools.reduce(DataFrame.unionByName, plan).coalesce(1) if plan else spark.createDataFrame([], PLAN)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, hot_rows: int = 200_000, distributed: bool = False) -> DataFrame:
    """Assign items to containers: (id, piece, start, size, container).

    Ids must be unique. An item of size 0 or null takes one piece of size 0 in container 0. An item longer than the capacity is
    divided into full containers and a rest that is packed like others; piece counts from 0, start is the piece's first unit.
    No other item is divided. Sizes with more than hot_rows items are ranked by ranges.
    The plan comes from the sweep over the table of sizes, which has fewer rows than the capacity (at most MOST_CAPACITY) whatever the corpus, or,
    with ``distributed``, from supersteps of Spark over the tables of runs. Ranks and the match of items to containers are distributed either way.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"the capacity must lie between 1 and {MOST_CAPACITY:,}")
    sized = items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    pieces = durable(sized.select("id", "n", F.floor(F.col("n") / capacity).alias("fulls"), F.expr(f"cast(n % {capacity} as int)").alias("rest")))
    fulls = int(pieces.agg(F.sum("fulls")).first()[0] or 0)
    counts = pieces.where("rest > 0").groupBy(F.col("rest").alias("size")).agg(F.count("*").alias("n"))
    if distributed:
        plan = plan_runs(counts, capacity, fulls + 1)
    else:
        runs = sweep({r["size"]: r["n"] for r in counts.collect()}, capacity, fulls + 1)  # fewer rows than the capacity
        plan = items.sparkSession.createDataFrame([(*r, 0) for r in runs], PLAN)
    numbered = ranked(pieces.where("rest > 0"), ["rest"], ["id"], "rank", hot_rows)
    # the plan has a few rows for each size; as an array by size it is met by an equi-join and a search in the row
    by_size = plan.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("low", "many", "container", "each", "offset"))).alias("runs"))
    met = numbered.join(F.broadcast(by_size), numbered["rest"] == by_size["size"])  # fewer rows than the capacity
    run = F.filter("runs", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["low"] + x["many"]))[0]
    rests = met.withColumn("run", run).select(
        "id", F.col("fulls").cast("int").alias("piece"), (F.col("fulls") * capacity).cast("long").alias("start"), F.col("rest").alias("size"),
        (F.col("run.container") + F.floor((F.col("run.offset") + F.col("rank") - F.col("run.low")) / F.col("run.each"))).cast("long").alias("container"),
    )
    # full containers are numbered by the items' ranks among those of as many of them
    long = pieces.where("fulls > 0")
    kinds = long.groupBy("fulls").agg((F.count("*") * F.col("fulls")).alias("c"))
    offsets = kinds.select(F.col("fulls").alias("f"), F.coalesce(F.sum("c").over(Window.orderBy("fulls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"))  # one row for each length in containers
    whole = ranked(long, ["fulls"], ["id"], "rank", hot_rows).join(offsets, F.col("fulls") == F.col("f")).select(
        "id", F.explode(F.sequence(F.lit(0), F.col("fulls").cast("int") - 1)).alias("piece"), (F.col("from") + F.col("rank") * F.col("fulls") + 1).alias("first")
    ).select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).alias("size"), (F.col("first") + F.col("piece")).cast("long").alias("container"))
    none = pieces.where("n = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("container"))
    return rests.unionByName(whole).unionByName(none).withColumnRenamed("id", id_col)


def pack_documents(documents: DataFrame, capacity: int = 2048, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container_id) for every row of documents; texts without tokens are in container 0, which holds nothing else."""
    sized = count_column(spread(documents.select("doc_id", "text"), "doc_id"), "text", name=name, folder=folder)
    packed = pack(sized, "doc_id", "n_tokens", capacity)
    return packed.select("doc_id", "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))
