"""The search plan: a short file of keywords, areas and rules, read on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("keywords", "areas", "aliases", "area_match", "grid", "boundary", "exclude")


@dataclass
class Plan:
    city: str
    keywords: list[str] = field(default_factory=list)
    areas: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    area_match: dict[str, str] = field(default_factory=dict)
    grid: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    boundary: list | None = None

    @property
    def max_km(self) -> float:
        return float(self.area_match.get("max_km", 2.0))


def read_boundary(text: str) -> list:
    """Polygons (lists of rings of (lng, lat)) of a GeoJSON geometry, feature or collection, of all its features; any other geometry is an error."""
    shape = json.loads(text)
    polygons: list = []
    for feature in shape["features"] if shape.get("type") == "FeatureCollection" else [shape]:
        geometry = feature.get("geometry", feature)
        if geometry["type"] not in ("Polygon", "MultiPolygon"):
            raise ValueError(f"a boundary must be a polygon, not {geometry['type']}")
        polygons += [geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]
    return [[[(p[0], p[1]) for p in ring] for ring in rings] for rings in polygons]


def parse(text: str, city: str, folder: Path | None = None) -> Plan:
    """The plan of a file's text. Blank lines and # comments don't count; notes in brackets behind an area are aliases of it.

    A line outside the known sections or an alias of an area that isn't listed is an error.
    """
    plan, section, aliases = Plan(city), "", []
    for line in (x.strip() for x in text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if m := re.fullmatch(r"\[(\w+)\]", line):
            section = m[1].lower()
            continue
        if section not in SECTIONS:
            raise ValueError(f"line outside a section: {line!r}")
        key, _, value = (x.strip() for x in line.partition("="))
        if section in ("keywords", "exclude"):
            getattr(plan, section).append(line)
        elif section == "areas":
            name = re.sub(r"\s*\(.*?\)", "", line).strip()
            plan.areas.append(name)
            plan.aliases |= {note.strip(): name for note in re.findall(r"\((.*?)\)", line)}
        elif section == "aliases":
            aliases.append((key, value))
        elif section == "boundary":
            if key.lower() == "file":
                plan.boundary = read_boundary(((folder or Path()) / value).read_text(encoding="utf-8"))
        else:
            getattr(plan, section)[key.lower()] = value
    for spelling, name in aliases:
        if name not in plan.areas:
            raise ValueError(f"alias of an unknown area: {spelling!r}")
        plan.aliases[spelling] = name
    return plan


def load(path: str | Path, city: str | None = None) -> Plan:
    path = Path(path)
    return parse(path.read_text(encoding="utf-8"), city or path.stem.replace("_", " ").title(), path.parent)


def frames(spark: SparkSession, plan: Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan's keywords (ord, keyword), areas (ord, area) and aliases (alias, area) as tables."""
    return (
        spark.createDataFrame(list(enumerate(plan.keywords)), "ord int, keyword string"),
        spark.createDataFrame(list(enumerate(plan.areas)), "ord int, area string"),
        spark.createDataFrame(list(plan.aliases.items()), "alias string, area string"),
    )
