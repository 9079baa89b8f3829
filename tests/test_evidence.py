"""Zones by covers, neighbours by newest report and hot cells, as-of rows, numbers by days, predictors, investigations."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import cover, evidence, investigate
from wakeline.operators.asof import as_of
from wakeline.operators.clusters import members_of
from wakeline.operators.console import nearby_incidents, scopes
from wakeline.operators.predictors import FEATURES, PREDICTORS, step_errors
from wakeline.operators.windows import fixed_windows, numbered, steps, with_error

T0 = dt.datetime(2024, 1, 1)
POS = "mmsi long, event_id long, received_at timestamp_ntz, lat double, lon double, sog double"
INC = "incident_id long, mmsi long, flagged_at timestamp_ntz, lat double, lon double"


def km(a, b):
    y, x = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin(y) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x) ** 2)))


def holds(polygons, lat, lon):
    for rings in polygons:
        n = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                n += (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        if n % 2:
            return True
    return False


def _ring(rng, y, x, size, n=9):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    r = [[x + size * rng.uniform(0.4, 1) * math.cos(a), y + size * rng.uniform(0.4, 1) * math.sin(a)] for a in at]
    return [*r, r[0]]


def _zones(rng):
    star = [[[_ring(rng, 10, 20, 3)]], [[_ring(rng, 11, 21, 0.4)], [_ring(rng, 5, 5, 0.05)]], [[_ring(rng, -40, -100, 12)]]]
    hole = [[[[0, 0], [40, 0], [40, 30], [0, 30], [0, 0]], [[10, 10], [30, 10], [30, 20], [10, 20], [10, 10]]]]
    return [(i + 1, p, None, None) for i, p in enumerate([*star, hole])]


def test_polygons_equal_plain(spark):
    rng = random.Random(7)
    zones = _zones(rng)
    near = [(10, 20, 4), (11, 21, 0.6), (5, 5, 0.08), (-40, -100, 14), (15, 20, 20)]
    points = [(i, i, T0, y + rng.uniform(-r, r), x + rng.uniform(-r, r)) for i, (y, x, r) in enumerate(near * 60)]
    shape = "zone_id long, polygons array<array<array<array<double>>>>, first_seen timestamp_ntz, last_seen timestamp_ntz"
    floats = [(i, [[[list(map(float, p)) for p in r] for r in g] for g in z], a, b) for i, z, a, b in zones]
    got = {r.incident_id: r.zone_id for r in evidence.in_polygons(spark.createDataFrame(points, INC), spark.createDataFrame(floats, shape)).collect()}
    assert got == {i: min((z for z, p, *_ in floats if holds(p, y, x)), default=None) for i, _, _, y, x in points}
    assert len(set(got.values())) >= 4


def test_zone_times_and_strange_zones(spark):
    square = [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]]
    day = lambda n: T0 + dt.timedelta(days=n)
    zones = [(1, square, day(5), None), (2, square, None, day(1)), (3, None, None, None), (4, [[]], None, None), (5, [[[[1.0, 1.0]]]], None, None), (6, square, day(2), day(3))]
    shape = "zone_id long, polygons array<array<array<array<double>>>>, first_seen timestamp_ntz, last_seen timestamp_ntz"
    points = [(n, 1, day(n), 1.0, 1.0) for n in range(8)] + [(20, 1, day(0), None, 1.0), (21, 1, day(0), 9.0, 9.0)]
    got = {r.incident_id: r.zone_id for r in evidence.in_polygons(spark.createDataFrame(points, INC), spark.createDataFrame(zones, shape)).collect()}
    assert got == {0: 2, 1: 2, 2: 6, 3: 6, 4: None, 5: 1, 6: 1, 7: 1, 20: None, 21: None}


def test_a_large_zone_has_a_bounded_number_of_cells(spark):
    rng = random.Random(1)
    for size in (0.01, 0.5, 10, 60):
        edges = [cover.ring_edges([_ring(rng, 10, 10, size, 40)])]
        cells = cover.zone_cells(edges)
        assert 0 < len(cells) <= cover.MOST_CELLS
    wide = cover.zone_cells([cover.ring_edges([[[0, 0], [20, 0], [20, 20], [0, 20], [0, 0]]])])
    assert len(wide) <= cover.MOST_CELLS and any(inner for *_, inner in wide)
    area = sum(cover.SIZES[level] ** 2 for level, _, _, inner in wide if inner)
    assert 0.7 * 400 < area <= 400
    zones = spark.createDataFrame([(1, -90.0, 90.0, -180.0, 180.0), (2, 1.0, 1.001, 2.0, 2.001), (3, 0.0, 20.0, 0.0, 20.0), (4, 5.0, 1.0, 0.0, 1.0)], "zone_id long, lat_min double, lat_max double, lon_min double, lon_max double")
    n = {r.zone_id: r["count"] for r in cover.rectangle_cover(zones).groupBy("zone_id").count().collect()}
    assert n[1] <= 13 * 24 and n[2] <= 4 and n[3] <= 25 and 4 not in n


@pytest.mark.parametrize("load", [2, 5000])
def test_neighbours_are_the_newest_in_reach_also_in_divided_cells(spark, load, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(evidence.near_in_time, "__defaults__", (load,))
    held = [(rng.randrange(30), i, T0 + dt.timedelta(minutes=rng.uniform(0, 240)), 60 + rng.gauss(0, 0.05), 5 + rng.gauss(0, 0.1), 1.0) for i in range(600)]
    asked = [(i, rng.randrange(30), T0 + dt.timedelta(minutes=rng.uniform(0, 240)), 60 + rng.gauss(0, 0.05), 5 + rng.gauss(0, 0.1)) for i in range(25)]
    got = {(r.incident_id, r.other): (r.event_id, round(r.km, 6)) for r in evidence.neighbours(spark.createDataFrame(asked, INC), spark.createDataFrame(held, POS), 6, 60, 12).collect()}
    want = {}
    for i, m, t, *p in asked:
        near = {}
        for o, e, u, *q in held:
            if o != m and abs((u - t).total_seconds()) <= 3600 and km(p, q[:2]) <= 6 and (o not in near or u > near[o][0]):
                near[o] = (u, e, round(km(p, q[:2]), 6))
        want |= {(i, o): near[o][1:] for o in sorted(near)[:12]}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-5) for k in want)


def test_scopes_from_clusters_and_neighbours(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    # Three flags beside each other within the hour; one alone among four others that report; one with nobody near.
    inc = [(1, 1, at(0), 10.0, 10.0), (2, 2, at(10), 10.05, 10.0), (3, 3, at(20), 10.0, 10.05), (4, 4, at(0), 30.0, 30.0), (5, 5, at(0), -60.0, 0.0), (6, 6, at(90), 10.0, 10.0)]
    pos = [(m, m, at(1), 30.0 + m / 1000, 30.0, 1.0) for m in range(11, 15)]
    got = {r.incident_id: (r.neighbours, r.nearest, r.incidents, r.cluster_vessels, r.scope) for r in scopes(spark.createDataFrame(inc, INC), spark.createDataFrame(pos, POS)).collect()}
    assert got[4] == (4, "1.2,1.3,1.4,1.6", 0, 1, "isolated")
    assert got[5] == (0, None, 0, 1, "insufficient")
    assert got[1] == (0, None, 3, 3, "area")
    assert got[6][2:] == (3, 1, "insufficient")  # the others are more than an hour off


def test_rows_as_of(spark):
    rng = random.Random(9)
    hour = lambda: T0 + dt.timedelta(hours=rng.randrange(0, 24 * 40))
    states = [(rng.randrange(4), i, hour(), f"s{i}") for i in range(40)] + [(0, 100, None, "never")]
    rows = [(rng.randrange(6), i, hour()) for i in range(200)] + [(0, 500, None)]
    for keys in ((), ("k",)):
        got = {r.i: r.state.name if r.state else None for r in as_of(spark.createDataFrame(rows, "k long, i long, at timestamp_ntz"), spark.createDataFrame(states, "k long, id long, since timestamp_ntz, name string"), "at", "since", "id", keys).collect()}
        best = lambda k, t: max(((s, i, n) for h, i, s, n in states if s is not None and t is not None and s <= t and (not keys or h == k)), default=(None, None, None))[2]  # noqa: E731, B023
        assert got == {i: best(k, t) for k, i, t in rows}
    assert as_of(spark.createDataFrame(rows, "k long, i long, at timestamp_ntz"), spark.createDataFrame([], "k long, id long, since timestamp_ntz"), "at", "since", "id").where("state is null").count() == 201


def test_numbers_by_days_equal_the_order_of_a_vessel(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(3), i, T0 + dt.timedelta(hours=rng.randrange(0, 200)), 1.0, 1.0, 1.0) for i in range(300)] + [(1, 900 + i, None, 1.0, 1.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, POS)
    got = {r.event_id: (r._n, r._all) for r in numbered(df, "mmsi").collect()}
    for m in range(3):
        own = sorted((r for r in rows if r[0] == m), key=lambda r: (r[2] is not None, r[2] or T0, r[1]))
        assert [got[r[1]] for r in own] == [(n, len(own)) for n in range(len(own))]
    plan = fixed_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(mmsi" in plan and not any("row_number()" in line and "windowspecdefinition(mmsi#" in line and "_day" not in line for line in plan.splitlines())


def _windows(spark):
    rng = random.Random(3)
    rows = [(m, m * 100 + i, T0 + dt.timedelta(minutes=3 * i + rng.randrange(2)), 10 + i * 0.01 + rng.gauss(0, 0.001), 20 + rng.gauss(0, 0.01), None if i == 4 else 10.0) for m in range(3) for i in range(20)]
    df = steps(fixed_windows(spark.createDataFrame(rows, POS)))
    return df.withColumns({"cog": F.lit(0.0), "heading": F.lit(None).cast("double"), "rate_of_turn": F.lit(None).cast("double"), "vessel_class": F.lit(70), "heading_missing": F.lit(1), "rot_missing": F.lit(1)})


def test_the_default_predictor_is_the_error_of_steps(spark):
    df = _windows(spark)
    want = {r.event_id: r.error for r in with_error(df).collect()}
    got = {r.event_id: r.error for r in step_errors(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_other_predictors(spark):
    df, seen = _windows(spark), {}

    def north(features, positions, times):
        assert features.shape[1:] == (20, len(FEATURES)) and positions.shape[1:] == (20, 2) and times.shape[1:] == (20,)
        assert (features[:, 4, 0] == -1).all() and (features[..., 2] == -1).all() and (np.diff(times, axis=1) > 0).all()
        return np.broadcast_to(np.array([0.01, 0.0]), (len(positions), 19, 2))

    got = {r.event_id: (r.place, r.error) for r in step_errors(df, north).collect()}
    for r in df.collect():
        seen[r.event_id] = 0.0 if r.place == 0 else math.hypot(r.dlat - 0.01, r.dlon)
    assert {k: e for k, (_, e) in got.items()} == pytest.approx(seen)
    for name in PREDICTORS:
        out = step_errors(df, name).collect()
        assert len(out) == 60 and all(r.error == 0 for r in out if r.place == 0) and all(math.isfinite(r.error) for r in out)
    assert step_errors(df.where("place < 10")).count() == 0
    with pytest.raises(KeyError):
        step_errors(df, "none")


def test_investigations_see_the_track(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    still = [(1, 100 + i, at(i * 10), 10.0, 10.0, 5.0) for i in range(12)]  # tells 5 knots and stands
    slow = [(2, 200 + i, at(i * 10), 20.0, 20.0, 0.1) for i in range(12)]
    sails = [(3, 300 + i, at(i * 10), 30.0 + i * 0.01, 30.0, 4.0) for i in range(12)]
    flags = [(1, 1, at(115), 10.0, 10.0, 3.0, "freeze_replay+prediction_error"), (2, 2, at(115), 20.0, 20.0, 1.5, "prediction_error"), (3, 3, at(115), 30.0, 30.0, 9.0, "prediction_error"), (4, 3, at(118), 30.0, 30.0, 9.0, "freeze_replay+prediction_error"), (5, 9, at(0), 50.5, 50.5, 9.0, "prediction_error"), (6, 8, at(0), -10.0, 0.0, 9.0, "freeze_replay+prediction_error")]
    f = spark.createDataFrame(flags, f"{INC}, score double, votes string")
    zones = spark.createDataFrame([(7, 50.0, 51.0, 50.0, 51.0, None, None)], "zone_id long, lat_min double, lat_max double, lon_min double, lon_max double, first_seen timestamp_ntz, last_seen timestamp_ntz")
    found = investigate.investigate(f, spark.createDataFrame(still + slow + sails, POS), zones, 1.0)
    got = {r.incident_id: (r.n_track, r.n_freeze, r.stationary, r.hypothesis, r.confidence, r.status) for r in found.collect()}
    assert got == {
        1: (12, 11, False, "freeze_replay", 0.8, "reported"), 2: (12, 0, True, "benign", 0.75, "reported"), 3: (12, 0, False, "targeted_spoof", 0.5, "escalated"),
        4: (12, 0, False, "equipment_fault", 0.55, "escalated"), 5: (0, 0, False, "jamming", 0.85, "reported"), 6: (0, 0, False, "targeted_spoof", 0.72, "reported"),
    }
    priors = spark.createDataFrame([(2, "false_positive", at(0)), (1, "false_positive", at(200)), (3, "confirmed_spoof", at(0))], "mmsi long, verdict string, judged_at timestamp_ntz")
    near = spark.createDataFrame([(1, "area"), (2, "isolated")], "incident_id long, scope string")
    after = {r.incident_id: (r.strength, r.scope, r.benign, r.priority) for r in investigate.follow_up(found, near, priors, 1.0, 2.0).collect()}
    assert after[2][:3] == (0.5, "isolated", 0.9)
    assert after[1][:3] == (1.0, "area", 0.0) and after[1][3] == pytest.approx(0.35 * 0.8 + 0.25 + 0.15 + 0.25)


def _crowd(spark, n=4000):
    """Vessels in one place that all report in one hour, and as many incidents."""
    rng = random.Random(11)
    held = [(i, i, T0 + dt.timedelta(seconds=rng.randrange(3600)), 51 + rng.uniform(0, 0.02), 4 + rng.uniform(0, 0.02), 1.0) for i in range(n)]
    return spark.createDataFrame([(i, *r[:1], *r[2:5]) for i, r in enumerate(held)], INC), spark.createDataFrame(held, POS)


def _rows_shuffled(df):
    """Rows that all exchanges of a query's last plan wrote."""
    df.collect()
    n, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if name == "Exchange":
            n += p.metrics().apply("shuffleRecordsWritten").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return n


def test_a_crowd_is_not_paired_before_the_first_are_taken(spark):
    inc, pos = _crowd(spark)
    near = evidence.neighbours(inc, pos, 5)
    assert _rows_shuffled(near) < 12 * 4000 and near.count() == 4000 * 60
    around = nearby_incidents(inc, 5)
    assert _rows_shuffled(around) < 12 * 4000 and around.count() == 4000 * 20
    told = scopes(inc, pos, 5, 2)
    assert _rows_shuffled(told) < 40 * 4000
    assert {(r.neighbours, r.incidents) for r in told.collect()} == {(60, 20)}


def test_nearby_incidents_equal_plain_at_the_antimeridian_and_in_divided_tiles(spark, monkeypatch):
    rng = random.Random(8)
    wrap = lambda x: (x + 180) % 360 - 180
    inc = [(i, rng.randrange(9), T0 + dt.timedelta(minutes=rng.randrange(0, 900, 5)), y + rng.gauss(0, 0.05), wrap(x + rng.gauss(0, 0.1))) for i, (y, x) in enumerate([(10, 180), (89.95, 0), (0, 0)] * 60)]
    inc.append((999, 1, T0, None, 3.0))
    want = set()
    for i, m, t, *p in inc[:-1]:
        near = sorted(((u, j) for j, o, u, *q in inc[:-1] if o != m and abs((u - t).total_seconds()) <= 21600 and km(p, q) <= 9), reverse=True)
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(near[:7])}
    for load in (3, 100_000):
        monkeypatch.setattr(evidence.near_in_time, "__defaults__", (load,))
        assert {(r.incident_id, r.other_id, r.place) for r in nearby_incidents(spark.createDataFrame(inc, INC), 9, 360, 7).collect()} == want


def test_own_clusters_equal_the_general_ones(spark):
    rng = random.Random(4)
    row = lambda i: (i, rng.randrange(8), T0 + dt.timedelta(minutes=rng.randrange(0, 200, 10)), 10 + rng.gauss(0, 0.03), 20 + rng.gauss(0, 0.03))
    inc = [row(i) for i in range(150)]
    got = {r.incident_id: r.cluster_vessels for r in scopes(spark.createDataFrame(inc, INC), spark.createDataFrame([], POS), 9, 2).collect()}
    reports = []
    for i, m, t, *p in inc:
        near = sorted(((u, j, o, q) for j, o, u, *q in inc if o != m and abs((u - t).total_seconds()) <= 21600 and km(p, q) <= 9), reverse=True)[:20]
        reports += [(i, m, t, i, *p)] + [(i, o, u, j, *q) for u, j, o, q in near if abs((u - t).total_seconds()) <= 3600]
    found = members_of(spark.createDataFrame(reports, "bucket long, mmsi long, received_at timestamp_ntz, event_id long, lat double, lon double"), 2, 3).collect()
    size, held = {}, {}
    for r in found:
        size[r.bucket, r.cluster] = size.get((r.bucket, r.cluster), 0) + 1
        held[r.bucket, r.mmsi] = r.cluster
    assert got == {i: size.get((i, held.get((i, m))), 1) for i, m, *_ in inc} and len(set(got.values())) > 2
