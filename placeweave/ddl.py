"""Schemas from short text without a session, so that modules can hold them as constants and workers can import them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

PLAIN = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "short": T.ShortType()}


def _parts(text: str) -> list[str]:
    """Pieces between the commas that stand outside all brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out if p.strip()]


def kind(text: str) -> T.DataType:
    """The type that e.g. ``array<struct<a:int,b:string>>`` names."""
    m = re.fullmatch(r"(array|map|struct)<(.*)>", text.strip())
    if not m:
        return PLAIN[text.strip()]
    inner = _parts(m[2])
    if m[1] == "array":
        return T.ArrayType(kind(inner[0]))
    if m[1] == "map":
        return T.MapType(kind(inner[0]), kind(inner[1]))
    return T.StructType([T.StructField(n.strip(), kind(k)) for n, k in (p.split(":", 1) for p in inner)])


def schema(text: str) -> T.StructType:
    """The schema of ``name type, name type, ...``."""
    return T.StructType([T.StructField(n, kind(k)) for n, k in (p.split(" ", 1) for p in _parts(text))])
