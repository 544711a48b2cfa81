"""Nested records and radius joins."""

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from placeweave.operators import near, nested
from placeweave.operators.queries import place_children
from placeweave.session import join_hot

PLACES = [
    {"name": "A", "reviews": [{"author": "x", "text": ""}, None, {"author": " ", "text": None}, {"text": "t"}], "hours": {"Monday": "9"}, "categories": ["a ", None, " ", "b", "b"], "found_by": ["k", "k"]},
    {"reviews": {"author": "one"}, "hours": [{"day": "Friday", "time": "x"}], "categories": "p, q", "found_by": "solo"},
    {"reviews": json.dumps([{"author": "in text"}]), "hours": json.dumps({"Sunday": "Closed"}), "categories": None, "found_by": []},
    None,
]
WANT = {
    (1, 0, "review", "0"), (1, 0, "review", "3"), (1, 0, "hours", "Monday"), (1, 0, "category", "a"), (1, 0, "category", "b"), (1, 0, "found_by", "k"),
    (1, 1, "review", "0"), (1, 1, "hours", "Friday"), (1, 1, "category", "p"), (1, 1, "category", "q"), (1, 1, "found_by", "solo"),
    (1, 2, "review", "0"), (1, 2, "hours", "Sunday"),
}


def test_children(spark):
    text = json.dumps(PLACES)
    rows = [(1, text, 5), (2, text[:-5], 5), (3, None, 5), (4, "", 5), (5, "  ", 5), (6, "null", 5), (7, "[" * 5000, 5), (8, '{"a": 1}', None), (9, '[{"name": "\\ud83d", "rating": 1%s}]' % ("0" * 5000), 1)]
    frame = spark.createDataFrame(rows, "dump_id long, payload string, value int")
    got = [tuple(r) for r in place_children(frame).collect()]
    assert set(got) == WANT and len(got) == len(WANT)
    assert place_children(frame.limit(0)).count() == 0


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("xy", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


def test_numbers_stay_as_written(spark):
    text = '[{"a": 1.50, "b": 1e400, "c": %s, "d": -0, "e": 3.14159265358979323846264338327950288, "f": true, "g": "1"}]' % ("7" * 6000)
    frame = spark.createDataFrame([(1, text)], "id long, payload string")
    rows = {r["name"]: (r["kind"], r["value"]) for r in nested.shred(frame, "id", "payload").where("name IS NOT NULL").collect()}
    assert rows == {"a": ("number", "1.50"), "b": ("number", "1e400"), "c": ("number", "7" * 6000), "d": ("number", "-0"), "e": ("number", "3.14159265358979323846264338327950288"), "f": ("boolean", "true"), "g": ("string", "1")}


def test_any_depth(spark):
    """Both sides of the parser's own depth, and what is broken beyond it."""
    rows = [(n, "[" * n + '{"x": 1}' + "]" * n) for n in (3, 500, 60_000)] + [(1, "[" * 60_000 + "1" + "]" * 59_999), (2, '[{"a": 1}, {"b": '), (4, None), (5, " "), (6, "[]")]
    frame = spark.createDataFrame(rows, "id long, payload string")
    leaf = nested.shred(frame.where("id NOT IN (60000)"), "id", "payload").where("name = 'x'")
    assert {r["id"]: (r["value"], r["dewey"].count(".")) for r in leaf.collect()} == {3: ("1", 3), 500: ("1", 500)}
    path = "$" + "[]" * 60_000 + ".x"
    deep = nested.shred(frame.where("id = 60000"), "id", "payload", keep=[path]).collect()
    assert len(deep) == 1 and deep[0]["value"] == "1" and deep[0]["dewey"].count(".") == 60_000
    assert {r["id"] for r in nested.rejected(frame, "id", "payload").collect()} == {1, 2}


@settings(max_examples=150, deadline=None)
@given(json_values, st.text(' {}[],:"01ae', max_size=3), st.integers(0, 60))
def test_deep_parser_is_the_parser(value, noise, at):
    text = json.dumps(value, indent=1)
    assert nested._parse_deep(text) == nested.parse(text)
    broken = text[:at] + noise + text[at:]
    try:
        want = nested.parse(broken)
    except ValueError:
        want = ValueError
    try:
        got = nested._parse_deep(broken)
    except ValueError:
        got = ValueError
    assert got == want


def test_tables(spark):
    frame = spark.createDataFrame([(1, json.dumps([{"r": [{"a": 1}, {"b": [True, None]}]}]))], "id long, payload string")
    nodes = nested.shred(frame, "id", "payload")
    rows = {r["dewey"]: (r["schema_path"], r["kind"], r["value"]) for r in nodes.collect()}
    assert rows["0.0.1.0.0"] == ("$[].r[].b[]", "boolean", "true") and rows["0.0.1.0.1"] == ("$[].r[].b[]", "null", None)
    table = {r["dewey"]: (r["parent_dewey"], r["a"]) for r in nested.table(nodes, "$[].r[]", {"a": "a"}, "id").collect()}
    assert table == {"0.0.0": ("0.0", "1"), "0.0.1": ("0.0", None)}


@settings(max_examples=80, deadline=None)
@given(json_values)
def test_labels_hold_the_record(value):
    nodes = {d: (name, kind, v) for d, _, name, _, kind, v in nested.label(value)}

    def build(prefix, kind):
        if kind not in ("array", "object"):
            return None
        below = sorted((int(d.rsplit(".", 1)[-1]), d) for d in nodes if d.rpartition(".")[0] == prefix)
        items = [(nodes[d][0], leaf(d)) for _, d in below]
        return [v for _, v in items] if kind == "array" else dict(items)

    def leaf(d):
        _, kind, v = nodes[d]
        if kind in ("array", "object"):
            return build(d, kind)
        return None if kind == "null" else v if kind == "string" else json.loads(v)

    kind = "array" if isinstance(value, list) else "object" if isinstance(value, dict) else ""
    if kind:
        assert build("", kind) == value
    assert all(d.rpartition(".")[0] in nodes or "." not in d for d in nodes)


def test_radius_join(spark):
    rng = np.random.default_rng(3)
    a = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.normal(33.6, 0.05, 400), rng.normal(73.1, 0.05, 400)))]
    a += [(1000 + i, 33.6, 73.1) for i in range(300)]  # one hot place
    a += [(1, None, 73.0), (2, 0.0, 73.0), (3, float("nan"), 73.0), (4, 91.0, 1.0), (5, 33.6, 181.0)]
    b = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.normal(33.6, 0.08, 150), rng.normal(73.1, 0.08, 150)))] + [(7, 33.6, 73.1), (7, 33.6, 73.1), (900, None, None)]
    left = spark.createDataFrame(a, "id long, lat double, lng double").selectExpr("*", "1 AS km", "2 AS cell")
    right = spark.createDataFrame(b, "aid long, lat double, lng double")
    for metric, f in (("great_circle", near.great_circle), ("flat", near.flat_distance)):
        out = near.radius_join(left, right, ("id", "lat", "lng"), ("aid", "lat", "lng"), 1.5, metric, pivots=5, rows_per_task=50)
        got = sorted((r["id"], r["aid"]) for r in out.collect())
        real = [p for p in a if p[1] and p[1] == p[1] and abs(p[1]) <= 90 and abs(p[2]) <= 180]
        want = sorted((p[0], q[0]) for p in real for q in b if q[1] and f(p[1], p[2], q[1], q[2]) <= 1.5)
        assert got == want and len(got) > 300
    assert near.radius_join(left, right.limit(0), ("id", "lat", "lng"), ("aid", "lat", "lng"), 1.5).count() == 0
    assert near.radius_join(left.limit(0), right, ("id", "lat", "lng"), ("aid", "lat", "lng"), 1.5).count() == 0


def cells_of(lat, lng, pivots, rows, km):
    """The tree that many points give, cut like the join does."""
    rng = np.random.default_rng(1)
    tree = near.Cells()
    some = rng.choice(len(lat), pivots, replace=False)
    tree.cut(0, lat[some], lng[some])
    while True:
        leaf, d = tree.home(lat, lng)
        for c in set(range(len(tree.far))) - set(tree.below):
            tree.far[c] = d[leaf == c].max(initial=-np.inf)
        large = [c for c in np.unique(leaf) if (leaf == c).sum() > rows and tree.far[c] > km]
        if not large:
            return tree, leaf
        for c in large:
            mine = np.flatnonzero(leaf == c)
            some = rng.choice(mine, min(256, 2 * len(mine) // rows + 1), replace=False)
            tree.cut(int(c), lat[some], lng[some])


def test_cells_follow_density():
    """Ten times the points in a dense town: cells stay small, and a point is copied to hardly more of them."""
    rng = np.random.default_rng(7)
    copies = []
    for n in (4_000, 40_000):
        lat = np.concatenate([rng.normal(33.6, 0.05, n), rng.uniform(24, 36, n // 4)])
        lng = np.concatenate([rng.normal(73.1, 0.05, n), rng.uniform(62, 76, n // 4)])
        tree, leaf = cells_of(lat, lng, 16, 1_000, 0.05)
        assert np.bincount(leaf).max() <= 1_000
        at, cell = tree.reached(lat, lng, 0.05)
        assert set(zip(range(len(lat)), leaf)) <= set(zip(at, cell))  # a point is its own partner
        copies.append(len(at) / len(lat))
    assert copies[1] < 1.5 and copies[1] < copies[0] + 0.4


def test_radius_join_over_the_date_line(spark):
    left = spark.createDataFrame([(1, 10.0, 179.999), (2, 89.9999, 10.0)], "id long, lat double, lng double")
    right = spark.createDataFrame([(1, 10.0, -179.999), (2, 89.9999, -170.0)], "aid long, lat double, lng double")
    out = near.radius_join(left, right, ("id", "lat", "lng"), ("aid", "lat", "lng"), 1.0)
    assert sorted((r["id"], r["aid"]) for r in out.collect()) == [(1, 1), (2, 2)]


def test_join_hot(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}" if i % 2 else None) for i in range(300)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, v long")
    for how in ("inner", "left"):
        got = sorted((r["i"], r["v"] or 0) for r in join_hot(left, right, ["k"], how, hot_rows=20).collect())
        assert got == sorted((r["i"], r["v"] or 0) for r in left.join(right, "k", how).collect())
    assert join_hot(left.limit(0), right, ["k"]).count() == 0
