"""Deeply nested records to flat tables, by Dewey labels.

Every node of a record gets the path of ordinals that leads to it ("2.5.0": third
element, sixth member, first element). The label alone links tables: cutting its last
part gives the parent, and the nodes that share a schema path form one table. A record is
labelled in one pass where it lies; nothing is shuffled until a caller asks for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.session import spread

NODE_FIELDS = [
    T.StructField("dewey", T.StringType()),
    T.StructField("schema_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
]


_HALVES = re.compile("[\ud800-\udfff]")


class Number(str):
    """A number as it is written, whatever its length."""

    __slots__ = ()


_BLANK, _PLAIN = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|-?Infinity|NaN|true|false|null", re.A)
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> object:
    """The same as json.loads, for texts nested deeper than its recursion goes: the open arrays and objects are a list."""
    root: list = []
    open_: list[list | dict] = [root]
    names: list[str | None] = [None]
    at, state = _BLANK.match(text, 0).end(), "value"  # value, first (a value or the end), after

    def put(value: object) -> None:
        top = open_[-1]
        if isinstance(top, dict):
            top[names[-1]] = value
        else:
            top.append(value)

    def name(start: int) -> int:
        if text[start : start + 1] != '"':
            raise ValueError(f"a name is missing at {start}")
        names[-1], end = json.decoder.scanstring(text, start + 1, True)
        end = _BLANK.match(text, end).end()
        if text[end : end + 1] != ":":
            raise ValueError(f"a colon is missing at {end}")
        return _BLANK.match(text, end + 1).end()

    while True:
        c = text[at : at + 1]
        top = open_[-1]
        if state == "after" and len(open_) == 1:
            if at < len(text):
                raise ValueError(f"more text at {at}")
            return root[0]
        if state != "value" and c == ("}" if isinstance(top, dict) else "]"):
            open_.pop()
            names.pop()
            at, state = _BLANK.match(text, at + 1).end(), "after"
            continue
        if state == "after":
            if c != ",":
                raise ValueError(f"a comma is missing at {at}")
            at = _BLANK.match(text, at + 1).end()
        if isinstance(top, dict) and state in ("after", "first"):
            at = name(at)
        c = text[at : at + 1]
        if c in ("[", "{") and c:
            value: list | dict = [] if c == "[" else {}
            put(value)
            open_.append(value)
            names.append(None)
            at, state = _BLANK.match(text, at + 1).end(), "first"
            continue
        if c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        else:
            m = _PLAIN.match(text, at)
            if not m:
                raise ValueError(f"a value is missing at {at}")
            value, at = _WORDS[m[0]] if m[0] in _WORDS else Number(m[0]), m.end()
        put(value)
        at, state = _BLANK.match(text, at).end(), "after"


def parse(text: str) -> object:
    """A complete JSON text of any depth, its numbers as they are written; half characters of broken escapes are replaced."""
    text = _HALVES.sub("\ufffd", text)
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=Number)
    except RecursionError:
        return _parse_deep(text)


def _safe(text: str | None) -> str | None:
    return text if text is None or text.isascii() else _HALVES.sub("\ufffd", text)


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (Number, int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def label(document: object, maps: frozenset[str] = frozenset(), inline: frozenset[str] = frozenset(), keep: frozenset[str] | None = None) -> Iterator[tuple]:
    """Yield (dewey, schema_path, name, ordinal, kind, value) of all nodes below the root, in document order; with keep only those of its schema paths.

    Branches that lead to no path of keep aren't walked; the others' ordinals stay what they are.
    """
    ways = None if keep is None else {p[:i] for p in keep for i in (*(m.start() for m in re.finditer(r"[.\[{]", p)), len(p))}
    stack: list[tuple[str, str, str | None, int, object]] = [("", "$", None, 0, document)]
    while stack:
        dewey, path, name, ordinal, value = stack.pop()
        if path in inline and isinstance(value, str):
            try:
                inner = parse(value)
            except ValueError:
                inner = value
            if isinstance(inner, (list, dict)):
                value = inner
        kind = _kind(value)
        if dewey and (keep is None or path in keep):
            plain = None if kind in ("null", "array", "object") else json.dumps(value) if kind == "boolean" else str(value)
            yield dewey, _safe(path), _safe(name), ordinal, kind, _safe(plain)
        if kind == "array":
            below = [(None, v, f"{path}[]") for v in value]
        elif kind == "object":
            below = [(k, v, f"{path}{{}}" if path in maps else f"{path}.{k}") for k, v in value.items()]
        else:
            continue
        prefix = f"{dewey}." if dewey else ""
        stack.extend((f"{prefix}{i}", p, k, i, v) for i, (k, v, p) in reversed(list(enumerate(below))) if ways is None or p in ways)


def shred(
    df: DataFrame,
    key: str,
    payload: str,
    keep: Iterable[str] | None = None,
    maps: Iterable[str] = (),
    inline: Iterable[str] = (),
) -> DataFrame:
    """Nodes of the JSON text in ``payload``: key, dewey, schema_path, name, ordinal, kind, value.

    keep: schema paths to give out (all if None); branches that hold none of them are not walked.
    maps: schema paths of objects whose member names are data; their members share the path ``path{}``.
    inline: schema paths whose text may itself be a JSON array or object, then expanded in place.
    Null, blank and incomplete payloads give no nodes; rejected() tells which. Any depth is read. Of a member
    named twice in one object the last counts. Other columns of ``df`` don't matter, whatever their names.
    """
    wanted = None if keep is None else frozenset(keep)
    as_map, as_inline = frozenset(maps), frozenset(inline)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *NODE_FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.name for f in schema.fields]
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k, text in zip(batch["k"], batch["t"]):
                try:
                    document = parse(text)
                except (ValueError, TypeError):
                    continue
                for node in label(document, as_map, as_inline, wanted):
                    rows.append((k, *node))
                    size += len(node[0]) + len(node[1]) + len(node[5] or "")
                    # the labels of deep nodes are long, so a batch ends by its text as well
                    if len(rows) >= 50_000 or size >= 1 << 25:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    slim = df.select(F.col(key).alias("k"), F.col(payload).alias("t")).where(F.length(F.trim("t")) > 0)
    return spread(slim, "k").mapInPandas(run, schema)


def rejected(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, reason) of the payloads that aren't complete JSON: where the parser stopped and why. Null and blank ones are none."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("reason", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["t"]):
                try:
                    parse(text)
                except ValueError as e:
                    rows.append((k, str(e)))
            yield pd.DataFrame(rows, columns=schema.names)

    slim = df.select(F.col(key).alias("k"), F.col(payload).alias("t")).where(F.length(F.trim("t")) > 0)
    return spread(slim, "k").mapInPandas(run, schema)


def parent(dewey: Column) -> Column:
    """Label of the node above; null for nodes of the first level."""
    return F.when(F.instr(dewey, ".") > 0, F.regexp_replace(dewey, r"\.[0-9]+$", ""))


def step(dewey: Column, level: int) -> Column:
    """Ordinal at ``level`` (from 0) of the label, or null."""
    return F.try_element_at(F.split(dewey, r"\."), F.lit(level + 1)).cast("int")


def table(nodes: DataFrame, path: str, fields: dict[str, str], key: str) -> DataFrame:
    """The table of one schema path: key, dewey, parent_dewey and one text column for each of ``fields`` (name -> member).

    A node without one of the members has null there.
    """
    own = nodes.where(F.col("schema_path") == path).select(key, "dewey", F.lit(None).cast("string").alias("_m"), F.lit(None).cast("string").alias("_v"))
    paths = {f"{path}.{member}": name for name, member in fields.items()}
    members = nodes.where(F.col("schema_path").isin(list(paths))).select(key, parent(F.col("dewey")).alias("dewey"), F.col("schema_path").alias("_m"), F.col("value").alias("_v"))
    picks = [F.max(F.when(F.col("_m") == p, F.col("_v"))).alias(name) for p, name in paths.items()]
    both = own.unionByName(members).groupBy(key, "dewey").agg(*picks) if picks else own.select(key, "dewey")
    return both.withColumn("parent_dewey", parent(F.col("dewey")))
