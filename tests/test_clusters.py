"""Clusters by cells against a plain density clustering, at the antimeridian and the poles, dense cells, arguments."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wakeline.operators import clusters as c
from wakeline.operators.graph import components

SHAPE = "mmsi long, event_id long, received_at timestamp_ntz, lat double, lon double"
AT = dt.datetime(2024, 1, 1, 0, 5)


def km(a, b):
    y, x = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin(y) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x) ** 2)))


def plain(where, most, least):
    """mmsi -> least core vessel of its cluster."""
    near = {a: [b for b in where if km(where[a], where[b]) <= most] for a in where}
    core = {a for a in where if len(near[a]) >= least}
    label = {}
    for start in sorted(core):
        todo = [start] if start not in label else []
        while todo:
            a = todo.pop()
            if a not in label:
                label[a] = start
                todo += [b for b in near[a] if b in core]
    return label | {a: min(label[b] for b in near[a] if b in core) for a in where if a not in core and any(b in core for b in near[a])}


def _frame(spark, places):
    return spark.createDataFrame([(m, m, AT, *p) for m, p in places.items()], SHAPE)


def _places(kind, seed, n=120):
    rng = random.Random(seed)
    if kind == "antimeridian":
        return {i: (rng.uniform(-1.5, 1.5), (rng.uniform(178.5, 181.5) + 180) % 360 - 180) for i in range(n)}
    if kind == "pole":
        return {i: (rng.uniform(88.7, 90), rng.uniform(-180, 180)) for i in range(n)}
    if kind == "port":  # a hot cell beside a thin sea
        return {i: (52 + rng.gauss(0, 0.01), 4 + rng.gauss(0, 0.01)) if i % 2 else (52 + rng.uniform(-1.5, 1.5), 4 + rng.uniform(-2, 2)) for i in range(n)}
    if kind == "lines":  # cells that only just meet
        return {i: (60 + i % 40 * 0.134, 10 + i // 40 * 0.53) for i in range(n)}
    return {i: (rng.uniform(-85, -80), rng.uniform(-30, 30)) for i in range(n)}


@pytest.mark.parametrize("kind", ["antimeridian", "pole", "port", "lines", "south"])
@pytest.mark.parametrize(("most", "least"), [(15, 3), (31, 5)])
def test_members_equal_plain(spark, kind, most, least):
    where = _places(kind, len(kind) + most)
    got = {r.mmsi: r.cluster for r in c.members(_frame(spark, where), most, least).collect()}
    assert got == plain(where, most, least)


def test_radius_spread_and_order(spark):
    where = {1: (10.0, 20.0), 2: (10.1, 20.0), 3: (10.0, 20.1), 4: (30.0, 40.0), 5: (30.0, 40.1), 6: (30.1, 40.0), 7: (30.1, 40.1), 9: (-50.0, 0.0)}
    rows = c.clusters(_frame(spark, where)).collect()
    assert [(r.cluster, r.vessels) for r in rows] == [(4, 4), (1, 3)]
    centre = tuple(sum(where[i][k] for i in (1, 2, 3)) / 3 for k in (0, 1))
    assert (rows[1].centre_lat, rows[1].centre_lon) == pytest.approx(centre)
    assert rows[1].radius_km == pytest.approx(max(km(where[i], centre) for i in (1, 2, 3)))


def test_newest_report_counts_once_in_a_bucket(spark):
    rows = [(1, i, AT + dt.timedelta(minutes=i), 5.0, 5.0) for i in range(10)] + [(2, 20, AT, 5.0, 5.0), (3, 21, AT, 5.0, 5.0), (3, 22, AT + dt.timedelta(minutes=3), 45.0, 5.0)]
    assert c.clusters(spark.createDataFrame(rows, SHAPE)).count() == 0
    later = [(m, m, AT + dt.timedelta(hours=m), 5.0, 5.0) for m in range(5)]
    assert c.clusters(spark.createDataFrame(later, SHAPE)).count() == 0
    assert c.clusters(spark.createDataFrame(later, SHAPE), minutes=None).first().vessels == 5


def test_cluster_containing(spark):
    where = {1: (10.0, 20.0), 2: (10.1, 20.0), 3: (10.0, 20.1), 8: (12.0, 20.0)}
    assert c.cluster_containing(_frame(spark, where), 2).first().vessels == 3
    assert c.cluster_containing(_frame(spark, where), 8).count() == 0
    assert c.cluster_containing(_frame(spark, where), 77).count() == 0


def test_unfit_rows_and_arguments(spark):
    rows = [(1, 1, AT, 5.0, 5.0), (2, 2, AT, 5.0, 5.0), (3, 3, AT, math.nan, 5.0), (4, 4, AT, 91.0, 5.0), (None, 5, AT, 5.0, 5.0), (6, 6, None, 5.0, 5.0), (7, 7, AT, None, 5.0)]
    assert c.clusters(spark.createDataFrame(rows, SHAPE)).count() == 0
    assert c.clusters(spark.createDataFrame([], SHAPE)).count() == 0
    for bad in ({"least": 0}, {"km": 0}, {"km": -1}):
        with pytest.raises(ValueError):
            c.clusters(spark.createDataFrame(rows, SHAPE), **bad)


def test_cells_are_small_and_their_neighbourhood_is_whole(spark):
    rng = random.Random(3)
    for most in (3, 25, 100):
        grid = c.Grid(most)
        points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
        near = []
        for y, x in points:
            for _ in range(8):
                step = math.degrees(most / 6371.0088) * rng.uniform(0.2, 1)
                v = max(-90, min(90, y + rng.uniform(-1, 1) * step))
                near.append((y, x, v, (x + rng.uniform(-1, 1) * step / max(0.02, math.cos(math.radians(y))) + 180) % 360 - 180))
        df = spark.createDataFrame([p for p in near if km(p[:2], p[2:]) <= most], "y double, x double, v double, u double")
        row, other = grid.row(F.col("y")), grid.row(F.col("v"))
        cells = df.withColumns({"r": row, "c": grid.column(row, F.col("x")), "s": other, "d": grid.column(other, F.col("u"))})
        seen = cells.select(F.array_contains(grid.near(F.col("r"), F.col("c")), F.struct(F.col("s").alias("_y"), F.col("d").alias("_x"))).alias("ok"), "r", "c", "y", "x", "v", "u", "s", "d").collect()
        assert seen and all(r.ok for r in seen)
        assert all(km((r.y, r.x), (r.v, r.u)) <= most for r in seen if (r.r, r.c) == (r.s, r.d))


def test_components_of_long_chains(spark):
    edges = [(g, i, i + 1) for g in (1, 2) for i in range(0, 300) if i % 100 != 99 or g == 2] + [(1, 500, 500)]
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "g long, a long, b long"), "g").collect():
        got[r.g, r.component].add(r.node)
    assert {k: (min(v), len(v)) for k, v in got.items()} == {(1, 0): (0, 100), (1, 100): (100, 100), (1, 200): (200, 100), (2, 0): (0, 301), (1, 500): (500, 1)}
