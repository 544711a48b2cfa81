"""Complete radius joins of points on the sphere.

Both sides are cut into Voronoi cells around pivots that are drawn from the points, so that they
follow their density; a cell that still holds too many is cut again around pivots of its own. A left
point goes to its nearest pivot only; a right point is also copied to each cell where the triangle
inequality can't rule out a partner, at every level. In each cell a vantage-point tree over the right
points answers the left ones with the exact great-circle distance. What is so dense that no cell can
part it (a hot place, whose points are all partners) is split by measured counts.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeweave.session import salts_for

EARTH_KM = 6371.0


def is_point(lat: Column, lng: Column) -> Column:
    """Whether both coordinates are given, finite, not zero and inside ±90/±180."""
    return (
        lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
        & (lat != 0) & (lng != 0) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180)
    )


def great_circle(lat1, lng1, lat2, lng2):
    """Kilometres by the haversine formula, on arrays."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lng2, lng1)) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))


def flat_distance(lat1, lng1, lat2, lng2):
    """Kilometres by the equirectangular approximation, on arrays."""
    x = np.radians(np.subtract(lng2, lng1)) * np.cos(np.radians(np.add(lat1, lat2) / 2))
    return EARTH_KM * np.hypot(x, np.radians(np.subtract(lat2, lat1)))


class VantageTree:
    """Vantage-point tree over points, answering radius queries for many points at once."""

    LEAF = 32

    def __init__(self, lat: np.ndarray, lng: np.ndarray):
        self.lat, self.lng = lat, lng
        self.nodes: list[tuple] = []
        #: (node to fill, members); built without recursion as equal points make deep trees
        self.nodes.append(())
        todo = [(0, np.arange(len(lat)))]
        while todo:
            at, members = todo.pop()
            if len(members) <= self.LEAF:
                self.nodes[at] = (members,)
                continue
            vantage, rest = members[0], members[1:]
            d = great_circle(lat[vantage], lng[vantage], lat[rest], lng[rest])
            order = np.argsort(d, kind="stable")
            half = len(rest) // 2
            near, far = order[:half], order[half:]
            self.nodes[at] = (vantage, d[near].min(), d[near].max(), d[far].min(), d[far].max(), len(self.nodes), len(self.nodes) + 1)
            todo += [(len(self.nodes), rest[near]), (len(self.nodes) + 1, rest[far])]
            self.nodes += [(), ()]

    def within(self, lat: np.ndarray, lng: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, point index) at most km apart."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(lat)))] if len(self.lat) and len(lat) else []
        while todo:
            at, queries = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                members = node[0]
                if len(members):
                    d = great_circle(lat[queries][:, None], lng[queries][:, None], self.lat[members][None], self.lng[members][None])
                    q, m = np.nonzero(d <= km)
                    found.append((queries[q], members[m]))
                continue
            vantage, near_min, near_max, far_min, far_max, near, far = node
            d = great_circle(lat[queries], lng[queries], self.lat[vantage], self.lng[vantage])
            hit = queries[d <= km]
            found.append((hit, np.full(len(hit), vantage)))
            for low, high, below in ((near_min, near_max, near), (far_min, far_max, far)):
                reach = (d >= low - km) & (d <= high + km)
                if reach.any():
                    todo.append((below, queries[reach]))
        if not found:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class Cells:
    """A tree of pivots: node 0 is the whole, each node below it a pivot's cell; a node without others below it is a leaf."""

    def __init__(self):
        self.below: dict[int, np.ndarray] = {}
        self.lat, self.lng = np.zeros(1), np.zeros(1)
        #: the farthest left point of each cell from its pivot
        self.far = np.array([math.inf])

    def cut(self, node: int, lat: np.ndarray, lng: np.ndarray) -> None:
        """Cut a leaf around some pivots."""
        first = len(self.lat)
        self.below[node] = np.arange(first, first + len(lat))
        self.lat, self.lng = np.concatenate([self.lat, lat]), np.concatenate([self.lng, lng])
        self.far = np.concatenate([self.far, np.full(len(lat), math.inf)])

    def _distances(self, node: int, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        under = self.below[node]
        return great_circle(lat[:, None], lng[:, None], self.lat[under][None], self.lng[under][None])

    def home(self, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each point, by the nearest pivot at each level, and its distance from the leaf's pivot."""
        node, d = np.zeros(len(lat), np.int32), np.zeros(len(lat))
        todo = [0] if self.below else []
        while todo:
            at = todo.pop()
            mine = np.flatnonzero(node == at)
            if not len(mine):
                continue
            found = self._distances(at, lat[mine], lng[mine])
            near = found.argmin(1)
            node[mine], d[mine] = self.below[at][near], found[np.arange(len(mine)), near]
            todo += [int(n) for n in np.unique(node[mine]) if n in self.below]
        return node, d

    def reached(self, lat: np.ndarray, lng: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf): all leaves where a point may have a partner within reach.

        A partner p in the cell of pivot i has d(p,i) <= d(p,n) for the pivot n next to the point c, so d(c,i) <= d(c,n) + 2 reach;
        and d(c,i) <= far(i) + reach. Among the pivots of one cell the same holds again.
        """
        points, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = [(0, np.arange(len(lat)))] if self.below else []
        while todo:
            at, mine = todo.pop()
            d = self._distances(at, lat[mine], lng[mine])
            under = self.below[at]
            ok = (d <= d.min(1, keepdims=True) + 2 * reach) & (d <= self.far[under][None] + reach)
            for j in np.flatnonzero(ok.any(0)):
                some = mine[ok[:, j]]
                if int(under[j]) in self.below:
                    todo.append((int(under[j]), some))
                else:
                    points.append(some)
                    leaves.append(np.full(len(some), under[j]))
        return np.concatenate(points), np.concatenate(leaves)


def _drawn(points: DataFrame, by: list[str], each: int) -> DataFrame:
    """(by, lat, lng): at most ``each`` different points of each group, drawn by hashes: one of each hash value's. A partial aggregate, so copies of a point cost nothing."""
    draw = F.min_by(F.struct("lat", "lng"), F.xxhash64(F.lit(5), "lat", "lng")).alias("p")
    return points.groupBy(*by, F.pmod(F.xxhash64("lat", "lng"), F.lit(each)).alias("_slot")).agg(draw).select(*by, "p.lat", "p.lng")


def _home(tree: Cells):
    @F.pandas_udf("cell int, d double")
    def home(y: pd.Series, x: pd.Series) -> pd.DataFrame:
        cell, d = tree.home(y.to_numpy(), x.to_numpy())
        return pd.DataFrame({"cell": cell, "d": d})

    return home


def radius_join(
    left: DataFrame,
    right: DataFrame,
    left_on: tuple[str, str, str],
    right_on: tuple[str, str, str],
    km: float,
    metric: str = "great_circle",
    pivots: int = 64,
    rows_per_task: int = 100_000,
    most_pivots: int = 20_000,
) -> DataFrame:
    """Rows (left id, right id, km) of all pairs of points at most ``km`` apart; the two ids must be named apart.

    left_on, right_on: names of id, latitude, longitude. Rows without a real point (null, NaN, zero or out of range)
    have no partners. metric: ``great_circle`` or ``flat`` (equirectangular) decides pairs; pruning is by great circle
    with a margin of half a percent, more than the two differ below 100 km and away from the poles and the date line.
    Repeated points, also repeated ids, each give their own pairs.
    The driver holds the tree of pivots: ``pivots`` of them at first, then up to 256 in each cell of more than rows_per_task left points, level by
    level, at most most_pivots in all, which serves some 10^9 points; beyond that cells are split by counts. All else is distributed.
    """
    spark = left.sparkSession
    (lid, llat, llng), (rid, rlat, rlng) = left_on, right_on
    a = left.select(F.col(lid).alias("lid"), F.col(llat).cast("double").alias("lat"), F.col(llng).cast("double").alias("lng")).where(is_point(F.col("lat"), F.col("lng")))
    b = right.select(F.col(rid).alias("rid"), F.col(rlat).cast("double").alias("lat"), F.col(rlng).cast("double").alias("lng")).where(is_point(F.col("lat"), F.col("lng")))
    out = T.StructType([T.StructField(lid, left.schema[lid].dataType), T.StructField(rid, right.schema[rid].dataType), T.StructField("km", T.DoubleType())])
    reach = km * 1.005 + 1e-6
    tree = Cells()
    drawn = [(r["lat"], r["lng"]) for r in _drawn(a, [], pivots).collect()]  # at most ``pivots``
    if not drawn:
        return spark.createDataFrame([], out)
    tree.cut(0, *np.array(drawn, float).T)
    while True:
        placed = a.withColumn("at", _home(tree)("lat", "lng")).select("lid", "lat", "lng", F.col("at.cell").alias("cell"), F.col("at.d").alias("d"))
        #: at most one row for each pivot
        cells = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect()}
        for leaf in set(range(len(tree.far))) - set(tree.below):
            tree.far[leaf] = cells[leaf][1] if leaf in cells else -math.inf
        # a cell no wider than the reach can't be parted: all its points are near each other
        large = {c: min(256, 2 * n // rows_per_task + 1) for c, (n, far) in cells.items() if n > rows_per_task and far > reach}
        room = most_pivots - len(tree.far)
        for c in sorted(large, key=lambda c: -cells[c][0]):
            room -= large[c]
            if room < 0:
                large.pop(c)
        if not large:
            break
        each = max(large.values())
        found: dict[int, list[tuple[float, float]]] = {}
        for r in _drawn(placed.where(F.col("cell").isin(list(large))), ["cell"], each).collect():  # at most most_pivots
            found.setdefault(r["cell"], []).append((r["lat"], r["lng"]))
        parted = False
        grown = copy.deepcopy(tree)  # the one before is still in plans that run later
        for c, points in found.items():
            if len(points) > 1:
                grown.cut(c, *np.array(points[: large[c]], float).T)
                parted = True
        if not parted:
            break
        tree = grown

    @F.pandas_udf("array<int>")
    def reached(y: pd.Series, x: pd.Series) -> pd.Series:
        at, leaf = tree.reached(y.to_numpy(), x.to_numpy(), reach)
        order = np.argsort(at, kind="stable")
        return pd.Series(np.split(leaf[order].astype("int32"), np.searchsorted(at[order], np.arange(1, len(y)))) if len(y) else [], dtype=object)

    copied = b.withColumn("cell", F.explode(reached("lat", "lng")))
    right_cells = {r["cell"]: r["count"] for r in copied.groupBy("cell").count().collect()}  # at most one row for each pivot
    if not cells or not right_cells:
        return spark.createDataFrame([], out)
    sizes = spark.createDataFrame(
        [(i, n, right_cells[i]) for i, (n, _) in cells.items() if i in right_cells] or [(-1, 0, 0)], "cell int, ln long, rn long"
    ).select("cell", salts_for(F.col("ln"), rows_per_task).alias("ls"), salts_for(F.col("rn"), rows_per_task).alias("rs"))
    sizes = F.broadcast(sizes)  # at most most_pivots rows
    # a piece of the left side meets every piece of the right side of its cell
    one = placed.join(sizes, "cell").select(
        "lid", "lat", "lng", "cell", F.pmod(F.xxhash64("lid", "lat", "lng"), F.col("ls")).alias("lp"), F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("rp")
    )
    two = copied.join(sizes, "cell").select(
        "rid", "lat", "lng", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ls").cast("long") - 1)).alias("lp"), F.pmod(F.xxhash64("rid", "lat", "lng"), F.col("rs")).cast("int").alias("rp")
    )
    exact: Callable = great_circle if metric == "great_circle" else flat_distance
    names = [f.name for f in out.fields]

    def local(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        tree = VantageTree(y["lat"].to_numpy(), y["lng"].to_numpy())
        parts = []
        for i in range(0, len(x), 8192):
            part = x.iloc[i : i + 8192]
            q, m = tree.within(part["lat"].to_numpy(), part["lng"].to_numpy(), reach)
            p, c = part.iloc[q], y.iloc[m]
            d = exact(p["lat"].to_numpy(), p["lng"].to_numpy(), c["lat"].to_numpy(), c["lng"].to_numpy())
            ok = d <= km
            parts.append(pd.DataFrame({names[0]: p["lid"].to_numpy()[ok], names[1]: c["rid"].to_numpy()[ok], names[2]: d[ok]}))
        return pd.concat(parts) if parts else pd.DataFrame({n: [] for n in names})

    keys = ["cell", "lp", "rp"]
    return one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(local, out)
