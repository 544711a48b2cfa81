"""Addresses of the same premises in different writing.

Each address is expanded into all plausible forms (areas its name may mean, roads it names);
of each form the components that make up premises are hashed together; addresses meet by an
equi-join on any shared hash. Misspelt names first go to the entry of the area list they mean
or, if it has none, to the far more frequent spelling of the corpus. The house number with its
letter is part of every hash and is compared again on the pairs, as are cities if both are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm import address
from placeweave.llm.canonical import match_phrases, name_phrase, neighbours, references, repair
from placeweave.session import durable, join_hot

#: A spelling gives way to one an edit away that is at least so many times as frequent.
DOMINANT = 4
#: Rows of one hash on the left side that one task gets.
ROWS_PER_TASK = 20_000


def usual_spelling(counts: DataFrame) -> DataFrame:
    """(name, usual) of names (name, n) with a spelling one edit away that is DOMINANT times as frequent; of several, the most frequent, then first in order."""
    names = counts.where((F.length("name") >= 5) & ~F.col("name").rlike(r"\d"))
    pairs = repair(names.select(F.col("name").alias("token")), names.where(F.col("n") >= DOMINANT).select(F.col("name").alias("ref"))).where("token <> ref")
    own = names.select(F.col("name").alias("token"), F.col("n").alias("few"))
    other = names.select(F.col("name").alias("ref"), F.col("n").alias("many"))
    far = pairs.join(own, "token").join(other, "ref").where(F.col("many") >= F.col("few") * DOMINANT)
    return far.groupBy(F.col("token").alias("name")).agg(F.min_by("ref", F.struct(-F.col("many"), "ref")).alias("usual"))


def _components(rows: DataFrame) -> DataFrame:
    """One row per phrase of each address that has a number: id, side, components, role (city, told, road) and phrase."""
    schema = "side string, id long, number string, street string, block string, sector string, sub string, role string, phrase string, whole boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for side, i, city, where in zip(batch["side"], batch["id"], batch["city"], batch["address"]):
                a = address.read(where)
                if a.number is None:
                    continue
                own = (side, i, a.number, a.street, a.block, a.sector, a.sub)
                roads = [p for p in a.phrases if p.rsplit(" ", 1)[-1] in address.ROADS.split("|")]
                rest = [p for p in a.phrases if p not in roads]
                said = [("told", p) for p in [*neighbours(rest), *roads]] + [("road", p) for p in a.roads] + [("city", p) for p in [name_phrase(city)] if p]
                out += [(*own, role, phrase, phrase in rest) for role, phrase in said or [("none", "")]]
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def premises_forms(rows: DataFrame, city: DataFrame, area: DataFrame, alias: DataFrame) -> DataFrame:
    """(side, id, class_id, number, city_id, place, whole, roads) of rows (side, id, city, address): one row for each address with its plausible forms.

    whole: forms that must be equal; roads: names of roads, which may differ by an edit. Addresses with the same number, city, place and forms are of one class, whatever their writing. Forms: number, street, sector and sub-sector; number, street, block and area; number and named road. Addresses without a number of
    house or plot, or with none of these forms complete, have no key.
    """
    refs = durable(references(city, area, alias))
    said = durable(_components(rows))
    phrases = said.where("role <> 'road'").select("phrase").distinct()
    found = match_phrases(phrases, refs.where("kind <> 'sector'").select("entry", "name"), refs.where("kind = 'city'")).join(refs, "entry").select("phrase", "kind", "area_id", "city_id", "score")
    found = durable(found)
    # names outside the list: roads and what else stands between commas, by spelling without blanks
    joined = F.regexp_replace("phrase", " ", "")
    unlisted = said.where((F.col("role") == "road") | ((F.col("role") == "told") & F.col("whole"))).join(found.select("phrase").distinct(), "phrase", "left_anti")
    counts = unlisted.groupBy(joined.alias("name")).agg(F.count("*").alias("n"))
    usual = usual_spelling(counts)
    known = found.select("phrase", F.struct("kind", "area_id", "city_id", "score").alias("hit")).groupBy("phrase").agg(F.collect_list("hit").alias("hits"))
    both = said.select("phrase").distinct().withColumn("name", joined).join(usual, "name", "left").join(known, "phrase", "left")
    met = join_hot(said, both.select("phrase", F.coalesce("usual", "name").alias("name"), "hits"), ["phrase"], "left")
    own = ["side", "id", "number", "street", "block", "sector", "sub"]

    def hits(role: str, kind: str) -> Column:
        return F.flatten(F.collect_list(F.when(F.col("role") == role, F.filter(F.coalesce("hits", F.array().cast("array<struct<kind:string,area_id:bigint,city_id:bigint,score:double>>")), lambda h: h["kind"] == kind))))

    by_row = met.groupBy(*own).agg(
        hits("told", "city").alias("told"), hits("city", "city").alias("typed"), hits("told", "area").alias("areas"),
        F.collect_set(F.when(F.col("role") == "road", F.col("name"))).alias("roads"),
        F.collect_set(F.when((F.col("role") == "told") & F.col("hits").isNull(), F.col("name"))).alias("others"),
    )

    def top(c: str) -> Column:
        return F.array_max(F.transform(c, lambda h: F.struct(h["score"], h["city_id"])))["city_id"]

    at = F.coalesce(top("told"), top("typed"))
    with_city = by_row.withColumn("city_id", at)
    here = F.filter("areas", lambda h: F.col("city_id").isNull() | (h["city_id"] == F.col("city_id")))
    best = F.array_max(F.transform(here, lambda h: h["score"]))
    listed = F.array_distinct(F.transform(F.filter(here, lambda h: h["score"] == best), lambda h: F.concat(F.lit("a"), h["area_id"].cast("string"))))
    other = F.transform("others", lambda o: F.concat(F.lit("u"), o))
    where = F.when(F.size(listed) > 0, listed).otherwise(other)
    street = F.col("street").isNotNull()
    by_sector = F.when(street & F.col("sub").isNotNull(), F.array(F.concat_ws("/", F.lit("s"), "sector", "sub", "street", "number")))
    by_block = F.when(street & F.col("sector").isNull() & F.col("block").isNotNull(), F.transform(F.array_sort(where), lambda w: F.concat_ws("/", F.lit("b"), w, "block", "street", "number")))
    none = F.array().cast("array<string>")
    whole = F.coalesce(by_sector, by_block, none)
    roads = F.when((F.size(whole) == 0) & ~street, F.array_sort("roads")).otherwise(none)
    place = F.when(F.col("sector").isNotNull(), F.col("sector")).when(F.size(listed) == 1, listed[0])
    out = with_city.select("side", "id", "number", "city_id", place.alias("place"), whole.alias("whole"), roads.alias("roads")).where("size(whole) + size(roads) > 0")
    own = F.concat_ws("|", "number", F.coalesce(F.col("city_id").cast("string"), F.lit("?")), F.coalesce("place", F.lit("?")), F.array_join("whole", ","), F.array_join("roads", ","))
    return out.select("side", "id", F.xxhash64(own).alias("class_id"), "number", "city_id", "place", "whole", "roads")


def _forms() -> Column:
    """array of struct(key, road) from whole and roads. A road's name also by what one deletion leaves of it: names an edit apart share one of these and are compared on the pairs."""
    cuts = lambda r: F.array_union(F.array(r), F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.concat(F.substring(r, F.lit(1), i - 1), F.substring(r, i + 1, F.length(r)))))
    named = F.flatten(F.transform("roads", lambda r: F.transform(cuts(r), lambda c: F.struct(F.xxhash64(F.concat_ws("/", F.lit("r"), c, "number")).alias("key"), r.alias("road")))))
    exact = F.transform("whole", lambda f: F.struct(F.xxhash64(f).alias("key"), F.lit(None).cast("string").alias("road")))
    return F.concat(exact, named)


def class_pairs(rows: DataFrame) -> DataFrame:
    """(l_class, r_class) of the classes of rows of premises_forms (durable) that denote the same premises, distinct: copies of an address meet once."""
    classes = rows.dropDuplicates(["side", "class_id"])
    keys = durable(classes.select("side", "class_id", "number", "city_id", "place", F.explode(_forms()).alias("form")).select("side", "class_id", "number", "city_id", "place", "form.key", "form.road"))
    a, b = (keys.where(F.col("side") == side).select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("class_id", "number", "city_id", "place", "road")]) for side in "lr")
    pairs = join_hot(a, b, ["key"], hot_rows=ROWS_PER_TASK, spread_by=["l_class_id"]).where(F.col("l_number") == F.col("r_number"))
    for c in ("city_id", "place"):
        pairs = pairs.where(F.col(f"l_{c}").isNull() | F.col(f"r_{c}").isNull() | (F.col(f"l_{c}") == F.col(f"r_{c}")))
    one, two = F.col("l_road"), F.col("r_road")
    edits = F.levenshtein(one, two)
    swap = (edits == 2) & (F.length(one) == F.length(two)) & (F.array_sort(F.split(one, "")) == F.array_sort(F.split(two, "")))
    near = (one.isNull() & two.isNull()) | (edits <= 1) | swap
    return pairs.where(near).select(F.col("l_class_id").alias("l_class"), F.col("r_class_id").alias("r_class")).distinct()


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(F.lit("l").alias("side"), "id", "city", "address").unionByName(right.select(F.lit("r").alias("side"), "id", "city", "address"))


def linked_premises(left: DataFrame, right: DataFrame, city: DataFrame, area: DataFrame, alias: DataFrame) -> DataFrame:
    """(side, id, class_id, links): each address (side l or r) that has a form, its class, and the number of the other side's addresses of the same premises.

    Pairs are made of classes only, so premises with a million copies on each side cost a million rows, not a million million.
    """
    rows = durable(premises_forms(both_sides(left, right), city, area, alias))
    pairs = durable(class_pairs(rows))
    n = rows.groupBy("side", "class_id").agg(F.count("*").alias("n"))
    links = []
    for own, other in ("lr", "rl"):
        met = pairs.join(n.where(F.col("side") == other).select(F.col("class_id").alias(f"{other}_class"), "n"), f"{other}_class")
        links.append(met.groupBy(F.col(f"{own}_class").alias("class_id")).agg(F.sum("n").alias("links")).select(F.lit(own).alias("side"), "class_id", "links"))
    joined = join_hot(rows.select("side", "id", "class_id"), links[0].unionByName(links[1]), ["side", "class_id"], "left", spread_by=["id"])
    return joined.select("side", "id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def same_premises(left: DataFrame, right: DataFrame, city: DataFrame, area: DataFrame, alias: DataFrame) -> DataFrame:
    """(left_id, right_id) of all pairs of rows (id, city, address) whose addresses denote the same premises, distinct.

    House or plot makes no difference; the letter does. Null, blank and numberless addresses are in no pair. Exact copies pair like others: their
    classes meet once and pairs are made from the classes' members. Ids must be unique on each side. Hashes and classes with many rows are split.
    """
    rows = durable(premises_forms(both_sides(left, right), city, area, alias))
    pairs = class_pairs(rows)
    ones, twos = (rows.where(F.col("side") == side).select(F.col("id").alias(f"{name}_id"), F.col("class_id").alias(f"{side}_class")) for side, name in (("l", "left"), ("r", "right")))
    met = join_hot(ones, pairs, ["l_class"], hot_rows=ROWS_PER_TASK, spread_by=["left_id"])
    return join_hot(met, twos, ["r_class"], hot_rows=ROWS_PER_TASK, spread_by=["left_id", "l_class"]).select("left_id", "right_id")
