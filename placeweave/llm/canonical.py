"""Free-entered values to the entries of a reference list, by token-level repair and soft TF-IDF.

Distinct phrases are taken apart into distinct tokens; each token is joined to the reference's
vocabulary by edit distance (an equi-join on what one deletion leaves); entries that share a
repaired token with a phrase are ranked by soft TF-IDF over all their tokens. Rows only meet
the result for their phrases, so a value typed a billion times is matched once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.llm import address
from placeweave.session import durable, join_hot, spread

#: Lowest soft TF-IDF at which a phrase means an entry.
THRESHOLD = 0.8


def _tokens(phrase: Column) -> Column:
    """Words of a phrase, its neighbouring words joined, and all of them joined."""
    w = F.split(phrase, " ")
    joined = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, joined, F.array(F.array_join(w, ""))))


def _deletions(token: Column) -> Column:
    """What a token can lose to meet another one; short tokens and those with digits only meet themselves."""
    cut = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.when((F.length(token) < 4) | token.rlike(r"(?U)\d"), F.array(token)).otherwise(F.array_distinct(F.concat(F.array(token), cut)))


def repair(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, ref, sim): pairs of distinct tokens and vocabulary words at most one edit or one swap apart."""
    a = tokens.select("token", F.explode(_deletions(F.col("token"))).alias("cut"))
    b = vocabulary.select("ref", F.explode(_deletions(F.col("ref"))).alias("cut"))
    pairs = a.join(b, "cut").select("token", "ref").distinct()
    edits = F.levenshtein("token", "ref")

    def letters(c: str) -> F.Column:
        return F.array_sort(F.split(c, ""))

    swap = (edits == 2) & (F.length("token") == F.length("ref")) & (letters("token") == letters("ref"))
    near = pairs.withColumn("edits", F.when(edits <= 1, edits).when(swap, 1)).where(F.col("edits").isNotNull())
    return near.select("token", "ref", (1 - F.col("edits") / F.length("ref")).alias("sim"))


def soft_tfidf(value: list[str], entry: list[str], weights: list[float], unknown: float, free: frozenset[str]) -> float:
    """Soft TF-IDF of two lists of words, 0 if their numbers differ. Words of ``free`` in the value may stand unmatched."""
    numbers = {w for w in value if any(c.isdigit() for c in w)}
    if numbers != {w for w in entry if any(c.isdigit() for c in w)}:
        return 0.0
    left, whole = list(value), "".join(entry)
    matched = known = total = 0.0
    for v in [v for v in value if 2 <= len(v) <= 4 and v not in entry]:
        # initials of words that stand together in the entry and not in the value
        starts = "".join(w[0] if w not in value else " " for w in entry)
        at = starts.find(v)
        if at >= 0 and v.isalpha():
            share = sum(weights[at : at + len(v)])
            left.remove(v)
            matched, known = matched + share * 0.9, known + share
            entry, weights = entry[:at] + entry[at + len(v) :], weights[:at] + weights[at + len(v) :]
            total += share
            break
    total += sum(weights)
    for word, weight in sorted(zip(entry, weights), key=lambda x: -x[1]):
        best, at = 0.0, -1
        for i, v in enumerate(left):
            if v == word:
                best, at = 1.0, i
                break
            if len(v) >= 4 and len(word) >= 4 and address.distance(v, word, 1) <= 1 and best == 0:
                best, at = 1 - 1 / len(word), i
        if at >= 0:
            left.pop(at)
            matched += weight * best
            known += weight
    rest = sum(unknown for v in left if v not in free)
    score = math.sqrt((matched / total) * (matched / (known + rest))) if known else 0.0
    a, b = "".join(v for v in value if v not in free), whole
    if len(b) >= 5 and (d := address.distance(a, b, 1)) <= 1:
        score = max(score, 1 - d / len(b))
    return score


def match_phrases(phrases: DataFrame, entries: DataFrame, free: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(phrase, entry, score) of all distinct phrases and entries (entry, name) at or above the threshold.

    free: names (name) whose words, and which joined, may stand unmatched in a phrase. Phrases and names are words parted by one blank; empty ones match nothing. An entry is only looked up by its rarest words: those
    left out weigh too little together to reach the threshold.
    """
    named = entries.where("name <> ''").select("entry", "name", F.array_distinct(F.split("name", " ")).alias("words"), F.regexp_replace("name", " ", "").alias("joined"))
    total = named.count()
    posted = named.select("entry", F.explode("words").alias("ref"))
    weight = posted.groupBy("ref").agg(F.log(1 + F.lit(total) / F.count("*")).alias("w"))
    weighed = posted.join(weight, "ref")
    by_entry = Window.partitionBy("entry")
    rarest = by_entry.orderBy(F.desc("w"), "ref").rowsBetween(Window.unboundedPreceding, -1)
    # words are posted until the rest is below the least share of weight that a score at the threshold needs
    post = weighed.withColumn("before", F.coalesce(F.sum("w").over(rarest), F.lit(0.0))).withColumn("all", F.sum("w").over(by_entry))
    posts = post.where(F.col("all") - F.col("before") >= threshold * threshold * F.col("all") - 1e-9).select("entry", "ref")
    posts = durable(posts.unionByName(named.select("entry", F.col("joined").alias("ref"))).distinct())
    profile = weighed.groupBy("entry").agg(F.collect_list(F.struct("ref", "w")).alias("profile")).join(named.select("entry", "words"), "entry")
    tokens = durable(phrases.where("phrase <> ''").select("phrase", F.explode(_tokens(F.col("phrase"))).alias("token")))
    repaired = repair(tokens.select("token").distinct(), posts.select("ref").distinct())
    # each distinct token meets its entries once, then the phrases that hold it
    reached = repaired.join(posts, "ref").select("token", "entry").distinct()
    candidates = join_hot(tokens, reached, ["token"], spread_by=["phrase"]).select("phrase", "entry").distinct().join(profile, "entry")
    unknown = math.log(1 + total)
    if free is None:
        candidates = candidates.withColumn("free", F.array().cast("array<string>"))
    else:
        loose = free.where("name <> ''").select(F.explode(F.array_append(F.split("name", " "), F.regexp_replace("name", " ", ""))).alias("token")).distinct()
        own = join_hot(tokens, loose, ["token"], spread_by=["phrase"]).groupBy("phrase").agg(F.collect_set("token").alias("free"))
        candidates = candidates.join(own, "phrase", "left")

    @F.pandas_udf("double")
    def score(phrase: pd.Series, words: pd.Series, prof: pd.Series, loose: pd.Series) -> pd.Series:
        out = []
        for p, ws, pr, fr in zip(phrase, words, prof, loose):
            by = {x["ref"]: x["w"] for x in pr}
            out.append(soft_tfidf(p.split(" "), list(ws), [by[w] for w in ws], unknown, frozenset(fr if fr is not None else ())))
        return pd.Series(out, dtype=float)

    return candidates.withColumn("score", score("phrase", "words", "profile", "free")).where(F.col("score") >= threshold).select("phrase", "entry", "score")


@functools.lru_cache(maxsize=1 << 15)
def name_phrase(text: str | None) -> str:
    """A name in the form that phrases have."""
    return " ".join(address.words(address.plain(address.unglue(text))))


@F.pandas_udf(T.StringType())
def _name_phrase(names: pd.Series) -> pd.Series:
    return names.map(name_phrase)


def references(city: DataFrame, area: DataFrame, alias: DataFrame) -> DataFrame:
    """(entry, name, kind, area_id, city_id): cities, sectors, other areas and the aliases of areas."""
    is_sector = F.lower(F.trim("name")).rlike(r"^[b-i]-\d{1,2}$")
    cities = city.select(_name_phrase("name").alias("name"), F.lit("city").alias("kind"), F.lit(None).cast("long").alias("area_id"), F.col("id").alias("city_id"))
    areas = area.select(
        F.when(is_sector, F.lower(F.trim("name"))).otherwise(_name_phrase("name")).alias("name"),
        F.when(is_sector, "sector").otherwise("area").alias("kind"), F.col("id").alias("area_id"), "city_id",
    )
    aliases = alias.join(area.select(F.col("id").alias("area_id"), "city_id"), "area_id").select(_name_phrase("alias").alias("name"), F.lit("area").alias("kind"), "area_id", "city_id")
    both = cities.unionByName(areas).unionByName(aliases).distinct()
    return both.withColumn("entry", F.xxhash64("kind", "name", F.coalesce("area_id", F.lit(-1)), "city_id"))


def neighbours(phrases: list[str]) -> list[str]:
    """Phrases, and each two that stand next to each other as one."""
    return list(dict.fromkeys([*phrases, *(f"{a} {b}" for a, b in zip(phrases, phrases[1:]))]))


@functools.lru_cache(maxsize=1 << 15)
def _typed(area: str) -> tuple[str | None, tuple[str, ...]]:
    """The sector that a typed area names, or None, and its phrases."""
    s = address.plain(address.unglue(area))
    s = address.re.sub(r"\([^)]*\)?", ",", s)
    sector, _ = address.best_sector(address.sectors(s))
    s = address.SECTOR.sub(",", address.BLOCK.sub(",", s))
    s = address.re.sub(r"\b(?:near|opposite|behind|sector|sec|markaz)\b\.?", ",", s)
    parts = [p for p in (" ".join(address.words(x)) for x in s.split(",")) if p]
    return sector, tuple(p for p in dict.fromkeys([" ".join(parts), *neighbours(parts)]) if p)


def _mention(city: str | None, area: str | None, where: str | None) -> tuple[list[tuple[str, str]], bool]:
    """(role, phrase) of a row, and whether its area is given. Roles: city, area, sector, told (of the address, for its city only)."""
    out = [("city", p) for p in [name_phrase(city)] if p]
    given = bool(area and area.strip())
    if given:
        sector, said = _typed(area)
        out += [("area", p) for p in said]
        out += [("told", p) for p in address.read(where).phrases]
    else:
        read = address.read(where)
        sector = read.sector
        roads = {p for p in read.phrases if p.rsplit(" ", 1)[-1] in address.ROADS.split("|")}
        rest = [p for p in read.phrases if p not in roads]
        out += [("area", p) for p in [*neighbours(rest), *roads]]
    if sector:
        out.append(("sector", sector))
    return out, given


def match_areas(raw: DataFrame, city: DataFrame, area: DataFrame, alias: DataFrame) -> DataFrame:
    """(raw_id, area_id) of rows that mean an area, 0 if it isn't listed, within the row's city.

    Where area is given (not null or blank), it alone counts; without a listed match the row gets 0. Else the address counts: its listed area,
    or 0 if it names a sector that isn't listed; a row whose address names neither gives none. A row without a known city takes that
    of its address, and without one there the best match in any city, of equal ones the lowest id.
    raw_id must be unique. Clashing or extra columns of the tables don't matter.
    """
    refs = durable(references(city, area, alias))
    schema = "raw_id long, given boolean, role string, phrase string"

    def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, c, a, w in zip(batch["raw_id"], batch["city"], batch["area"], batch["address"]):
                said, given = _mention(c, a, w)
                rows += [(i, given, role, phrase) for role, phrase in said] or [(i, given, "none", "")]
            yield pd.DataFrame(rows, columns=["raw_id", "given", "role", "phrase"])

    said = durable(spread(raw.select("raw_id", "city", "area", "address"), "raw_id").mapInPandas(mentions, schema))
    phrases = said.select("phrase").distinct()
    found = match_phrases(phrases, refs.select("entry", "name"), refs.where("kind = 'city'")).join(refs, "entry").select("phrase", "kind", "area_id", "city_id", "score")
    met = join_hot(said, found, ["phrase"], "left", spread_by=["raw_id", "role"])
    size = F.size(F.split("phrase", " "))
    rank = F.struct("score", size.alias("size"), (-F.col("area_id")).alias("low"), "area_id", "city_id")
    by_row = met.groupBy("raw_id").agg(
        F.any_value("given").alias("given"),
        F.expr("max_by(city_id, score) FILTER (WHERE role = 'city' AND kind = 'city')").alias("typed"),
        F.expr("max_by(city_id, score) FILTER (WHERE role IN ('area', 'told') AND kind = 'city')").alias("told"),
        F.collect_list(F.when((F.col("role") == "area") & (F.col("kind") == "area"), rank)).alias("areas"),
        F.collect_list(F.when((F.col("role") == "sector") & (F.col("kind") == "sector"), rank)).alias("sectors"),
        F.bool_or(F.col("role") == "sector").alias("sector"),
    )
    home = F.coalesce("typed", "told")

    def best(column: str) -> F.Column:
        return F.array_max(F.filter(column, lambda x: home.isNull() | (x["city_id"] == home)))["area_id"]

    area_id = F.when(F.col("sector"), F.coalesce(best("sectors"), F.lit(0))).otherwise(F.coalesce(best("areas"), F.when(F.col("given"), F.lit(0))))
    return by_row.select("raw_id", area_id.cast("long").alias("area_id")).where(F.col("area_id").isNotNull())
