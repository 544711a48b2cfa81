"""A cascade of ordered rules that keeps a place with its type or rejects it with a reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave.functions import geo, text

# Categories and words that decide.
DAYCARE = ["day care center", "child care agency", "childcare", "creche"]
PRESCHOOL = ["preschool", "montessori preschool", "montessori school", "kindergarten", "nursery school", "playgroup"]
GENERIC = ["school", "educational institution", "general education school", "education center", "school house", "learning center", "private educational institution"]
EARLY_YEARS = r"(?iuU)day\s?care|child\s?care|cr[eè]che|montessori|pre[\s-]?school|nursery|kindergarten|play\s?group|toddler|early\s+(?:years|learning)"
DAYCARE_NAME = r"(?iuU)day\s?care|child\s?care|cr[eè]che"
SCHOOL_PART = r"(?iuU)\b(?:school\s+systems?|systems?|campus|academy|college|grammar|high\s+school|secondary|primary\s+school|junior\s+school|public\s+school|international\s+school|cadet|university)\b"


@dataclass(frozen=True)
class Scope:
    """Where places must lie: the city's name, its outline and areas to leave out."""

    city: str
    boundary: Sequence | None = None
    exclude: tuple[str, ...] = ()


def excluded(address: Column, areas: Sequence[str]) -> Column:
    """First of the areas whose name stands in the address, ignoring case, also inside a longer name; null if none."""
    return F.coalesce(*[F.when(text.icontains(address, a), F.lit(a)) for a in areas], F.lit(None).cast("string"))


def location_problem(address: Column, lat: Column, lng: Column, scope: Scope) -> Column:
    """Null if the place is in the city, else the reason. The pin decides if there is an outline and both coordinates."""
    city = scope.city
    named = F.coalesce(text.none_if_empty(text.address_city(address)), F.lit("unknown city"))
    by_text = (
        F.when(F.coalesce(address, F.lit("")) == "", F.lit("no address or location"))
        .when(~text.city_ends_part(address, city), F.concat(F.lit(f"outside {city} ("), named, F.lit(")")))
    )
    if scope.boundary is None:
        return by_text
    pinned = (F.coalesce(lat, F.lit(0.0)) != 0) & (F.coalesce(lng, F.lit(0.0)) != 0)
    return F.when(pinned, F.when(~geo.in_polygons(lat, lng, scope.boundary), F.lit(f"outside {city} boundary"))).otherwise(by_text)


def verdict(name: Column, categories: Column, address: Column, closed: Column, lat: Column, lng: Column, scope: Scope) -> Column:
    """struct(listing_type, reason); exactly one of the two isn't "". Nulls count as empty."""
    name = F.coalesce(name, F.lit(""))
    first = F.trim(F.coalesce(F.try_element_at(categories, F.lit(1)), F.lit("")))
    category = F.lower(first)
    out = excluded(address, scope.exclude) if scope.exclude else F.lit(None).cast("string")
    problem = location_problem(address, lat, lng, scope)
    by_name = name.rlike(DAYCARE_NAME)
    fits = category.isin(DAYCARE + PRESCHOOL) | (category.isin(GENERIC) & name.rlike(EARLY_YEARS))
    reason = (
        F.when(F.coalesce(closed, F.lit(False)), "permanently closed")
        .when(out.isNotNull(), F.concat(F.lit("excluded area ("), out, F.lit(")")))
        .when(problem.isNotNull(), problem)
        .when(~fits, F.concat(F.lit("category: "), F.coalesce(text.none_if_empty(first), F.lit("none"))))
        .when(name.rlike(SCHOOL_PART) & ~by_name, "part of a school (name)")
        .otherwise("")
    )
    kind = F.when(reason != "", "").when(category.isin(DAYCARE) | by_name, "daycare").otherwise("preschool")
    return F.struct(kind.alias("listing_type"), reason.alias("reason"))
