"""Best representative of each duplicate group, by skyline selection.

Each record of a group is a vector of completeness (the set of its filled fields), recency
and trust (by default whether it is the record kept). Records beaten in all three are layered behind
those that beat them; a lexicographic policy (layer, then what the caller prefers, by default recency) picks the source of each
field, later layers filling what earlier ones leave empty. Of the records with one and the
same set of filled fields only the most recent can matter, so a group shrinks to at most one
candidate for each set during map-side aggregation, however many copies it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE_ID = r"0x[0-9a-f]+:0x[0-9a-f]+"
MERGE_FIELDS = ("name", "area_id", "address", "phone", "website", "description", "rating", "review_count", "latitude", "longitude", "categories", "hours", "maps_url")


def blank(df: DataFrame, field: str) -> Column:
    """Whether a value counts as missing: null, blank text, 0, NaN, empty list or map."""
    kind, c = df.schema[field].dataType, F.col(field)
    if isinstance(kind, T.StringType):
        missing = ~c.rlike(r"(?U)[^\s]")
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        missing = F.size(c) <= 0
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        missing = (c == 0) | F.isnan(c)
    elif isinstance(kind, T.NumericType):
        missing = c == 0
    else:
        missing = F.lit(False)
    return c.isNull() | missing


def place_key(place_id: Column, maps_url: Column) -> Column:
    """The place id that stands in place_id or else in the URL (path or ftid), in lower case with a plain colon; null if none."""

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "%3a", ":")

    own, url = plain(place_id), F.regexp_extract(plain(maps_url), rf"(?:!1s|[?&]ftid=|[?&]q=)({PLACE_ID})(?![0-9a-f])", 1)
    return F.when(own.rlike(f"^{PLACE_ID}$"), own).otherwise(F.nullif(url, F.lit("")))


def survivors(
    df: DataFrame,
    group: Sequence[str],
    id_col: str,
    fields: Sequence[str],
    recency: str,
    demote: Column,
    locks: str,
    lock_name: dict[str, str] | None = None,
    trust: Column | None = None,
    completeness: str = "set",
    prefer: Sequence[str] = ("recency",),
) -> DataFrame:
    """Rows (group columns, keeper_id, field, source_id) of each group of two rows or more; no row where the survivor's value is empty.

    The keeper is the row with ``demote`` false and the lowest id. A field that any member locks stays the keeper's. Else
    the source is the most recent row that fills the field, of equally recent ones the one that ranks last as keeper; a null
    time is older than any other. Ids must be unique; groups with a null in a group column are groups as well, a null lock list
    locks nothing, and names of locks that aren't fields are ignored. ``lock_name`` gives a field's name in the lock lists if it differs.

    That is the policy by default. trust: whole numbers, few of them (by default the keeper is above all others; null is the lowest). completeness:
    ``set`` (a row is as complete as another if it fills all its fields) or ``count`` (if it fills as many). A row as complete, recent
    and trusted as another beats it; layers are by who beats whom, of rows with equal filled fields and trust the most recent alone taking part. prefer: by what the source is chosen among the rows of the first layer
    that fill a field, in order, of ``trust``, ``completeness`` and ``recency``; recency settles the rest.
    """
    if completeness not in ("set", "count") or not set(prefer) <= {"trust", "completeness", "recency"}:
        raise ValueError(f"unknown policy: {completeness}, {prefer}")
    if len(fields) > 62:
        raise ValueError("at most 62 fields fit the set of filled fields")
    lock_name = lock_name or {}
    bits = [F.when(~blank(df, f), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(fields)]
    held = [F.when(F.array_contains(locks, lock_name.get(f, f)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(fields)]
    keys = [F.col(g).alias(f"g{i}") for i, g in enumerate(group)]
    names = [f"g{i}" for i in range(len(group))]
    rows = df.select(
        *keys,
        sum(bits[1:], bits[0]).alias("mask"),
        sum(held[1:], held[0]).alias("held"),
        F.struct(F.col(recency).alias("at"), demote.alias("low"), F.col(id_col).alias("id")).alias("recent"),
        F.struct(demote.alias("low"), F.col(id_col).alias("id")).alias("rank"),
        (F.lit(0) if trust is None else F.coalesce(trust, F.lit(-(1 << 31)))).cast("int").alias("trust"),
    )
    # first by the set of filled fields and the trust: a group of any size leaves at most one candidate for each
    sets = rows.groupBy(*names, "mask", "trust").agg(
        F.max("recent").alias("recent"), F.min(F.struct("rank.low", "rank.id", "mask", "recent", "trust")).alias("kept"), F.bit_or("held").alias("held"), F.count("*").alias("n")
    )
    groups = sets.groupBy(*names).agg(
        F.collect_list(F.struct("recent", "mask", "trust")).alias("others"),
        F.min("kept").alias("kept"),
        F.bit_or("held").alias("held"),
        F.sum("n").alias("n"),
    ).where(F.col("n") > 1)
    keeper = F.struct(F.col("kept.recent").alias("recent"), F.col("kept.mask").alias("mask"), (F.lit(1) if trust is None else F.col("kept.trust")).alias("trust"))
    # most recent first, so that whoever beats a candidate stands before it
    ordered = F.reverse(F.array_sort(F.array_append(F.filter("others", lambda c: c["recent"]["id"] != F.col("kept.id")), keeper)))
    layer_type = "array<struct<recent:struct<at:timestamp,low:boolean,id:bigint>,mask:bigint,trust:int,layer:int>>"
    at_type = df.schema[recency].dataType.simpleString()
    id_type = df.schema[id_col].dataType.simpleString()
    layer_type = layer_type.replace("timestamp", at_type).replace("id:bigint", f"id:{id_type}")

    def push(done: Column, c: Column) -> Column:
        full = (lambda d: d["mask"].bitwiseAND(c["mask"]) == c["mask"]) if completeness == "set" else (lambda d: F.bit_count(d["mask"]) >= F.bit_count(c["mask"]))
        beaten_by = F.filter(done, lambda d: full(d) & (d["trust"] >= c["trust"]))
        layer = F.coalesce(F.array_max(F.transform(beaten_by, lambda d: d["layer"])), F.lit(0)) + F.lit(1)
        return F.array_append(done, F.struct(c["recent"].alias("recent"), c["mask"].alias("mask"), c["trust"].alias("trust"), layer.cast("int").alias("layer")))

    layered = groups.select(*names, "kept", "held", F.aggregate(ordered, F.expr(f"cast(array() as {layer_type})"), push).alias("done"))

    def source(i: int) -> Column:
        bit = F.lit(1 << i).cast("long")
        filled = F.filter("done", lambda d: d["mask"].bitwiseAND(bit) != 0)
        first_layer = F.array_min(F.transform(filled, lambda d: d["layer"]))
        order = {"trust": lambda d: d["trust"], "completeness": lambda d: F.bit_count(d["mask"]), "recency": lambda d: d["recent"]}
        keys = lambda d: F.struct(*[order[by](d).alias(f"k{i}") for i, by in enumerate(prefer)], d["recent"].alias("recent"))
        free = F.array_max(F.transform(F.filter(filled, lambda d: d["layer"] == first_layer), keys))["recent"]["id"]
        own = F.when(F.col("kept.mask").bitwiseAND(bit) != 0, F.col("kept.id"))
        return F.when(F.col("held").bitwiseAND(bit) != 0, own).otherwise(free)

    picks = F.array(*[F.struct(F.lit(f).alias("field"), source(i).alias("source_id")) for i, f in enumerate(fields)])
    long = layered.select(*names, F.col("kept.id").alias("keeper_id"), F.inline(picks))
    return long.where(F.col("source_id").isNotNull()).select(*[F.col(n).alias(g) for n, g in zip(names, group)], "keeper_id", "field", "source_id")


def listing_survivors(listing: DataFrame) -> DataFrame:
    """Survivors of listing rows of one city and place: (city_id, place, keeper_id, field, source_id).

    A row whose place_id and maps_url name no place belongs to no group. A null slug counts as one without a number.
    """
    rows = listing.withColumn("_place", place_key(F.col("place_id"), F.col("maps_url"))).where(F.col("_place").isNotNull())
    slim = rows.select("id", "city_id", F.col("_place").alias("place"), "slug", "updated_at", "locked_fields", *MERGE_FIELDS)
    numbered = F.coalesce(F.col("slug").rlike(r"-\d+$"), F.lit(False))
    out = survivors(slim, ["city_id", "place"], "id", MERGE_FIELDS, "updated_at", numbered, "locked_fields", {"area_id": "area"})
    return out.withColumn("field", F.when(F.col("field") == "area_id", F.lit("area")).otherwise(F.col("field")))


def merged_listings(listing: DataFrame) -> DataFrame:
    """One row per group: keeper_id and each merge field's surviving value (null where empty everywhere)."""
    long = listing_survivors(listing).select("keeper_id", "field", "source_id")
    values = listing.select(F.col("id").alias("source_id"), *[F.col(f).alias(f"v_{f}") for f in MERGE_FIELDS])
    shown = {"area_id": "area"}
    joined = long.join(values, "source_id")
    picks = [F.any_value(F.when(F.col("field") == shown.get(f, f), F.col(f"v_{f}")), True).alias(f) for f in MERGE_FIELDS]
    return joined.groupBy("keeper_id").agg(*picks)
