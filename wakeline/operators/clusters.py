"""Density clusters of the latest reports in time buckets, over cells in which all are near each other.

Cells are so small that any two vessels of one are within the distance: a cell with enough vessels is core without
a pair being compared, all core vessels of a cell are in one cluster, and only cells near each other are looked
at. Rows of cells are bands of latitude; each has as many cells as fit around the globe there, so that the
antimeridian is a border of cells like any other, and a row at a pole has few.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.geo import haversine_km
from wakeline.operators.evidence import latest
from wakeline.operators.graph import components
from wakeline.operators.near import kilometres
from wakeline.operators.windows import seconds
from wakeline.settings import EARTH_KM
from wakeline.sources.tables import written

CELL = ["bucket", "_y", "_x"]
#: Pairs that a test of two cells compares at once.
BLOCK = 1 << 20
#: Rows whose own clusters are found at once.
FEW = 1000


class Grid:
    """Cells whose diagonal is at most ``km``."""

    def __init__(self, km: float) -> None:
        self.km, self.angle = km, km / EARTH_KM
        self.side = math.sqrt(2) * math.sin(min(self.angle, math.pi) / 2) * (1 - 1e-9)

    def _cos(self, y: Column, farthest: bool) -> Column:
        """Cosine of the row's latitude farthest from the equator (or nearest to it)."""
        low, high = F.abs(y * self.side), F.abs((y + 1) * self.side)
        if farthest:
            return F.greatest(F.cos(F.least(F.greatest(low, high), F.lit(math.pi / 2))), F.lit(0.0))
        return F.when((y == 0) | (y == -1), 1.0).otherwise(F.cos(F.least(low, high)))

    def row(self, lat: Column) -> Column:
        return F.floor(F.radians(lat) / self.side)

    def around(self, y: Column) -> Column:
        """Cells of a row."""
        return F.greatest(F.ceil(self._cos(y, False) * 2 * math.pi / self.side), F.lit(1)).cast("long")

    def column(self, y: Column, lon: Column) -> Column:
        return F.pmod(F.floor(F.pmod(F.radians(lon) + math.pi, F.lit(2 * math.pi)) / (2 * math.pi) * self.around(y)), self.around(y)).cast("long")

    def near(self, y: Column, x: Column) -> Column:
        """Cells (_y, _x) that can hold a point within the distance of some point of this one, itself included."""
        rows = math.ceil(self.angle / self.side)
        wide = 2 * math.pi / self.around(y)

        def cells(other: Column) -> Column:
            reach = math.sin(min(self.angle, math.pi) / 2) / F.sqrt(self._cos(y, True) * self._cos(other, True))
            off = 2 * F.asin(F.least(reach, F.lit(1.0))) * (1 + 1e-9)
            n = self.around(other)
            first, last = F.floor((x * wide - off) / (2 * math.pi) * n), F.floor(((x + 1) * wide + off) / (2 * math.pi) * n)
            whole = F.isnan(off) | (last - first + 1 >= n)
            xs = F.when(whole, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda i: F.pmod(i, n)))
            return F.transform(xs, lambda i: F.struct(other.cast("long").alias("_y"), i.cast("long").alias("_x")))

        return F.array_distinct(F.flatten(F.transform(F.sequence(y - rows, y + rows), cells)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kilometres between points (n, 2) and (m, 2) in degrees."""
    (y, x), (v, u) = np.radians(a).T, np.radians(b).T
    h = np.sin((y[:, None] - v) / 2) ** 2 + np.cos(y)[:, None] * np.cos(v) * np.sin((x[:, None] - u) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _touch(a: np.ndarray, b: np.ndarray, km: float) -> bool:
    """Whether a point of ``a`` is within ``km`` of one of ``b``; the likeliest first, in blocks of bounded size."""
    a, b = (p[np.argsort(_distance(p, other.mean(0)[None])[:, 0], kind="stable")] for p, other in ((a, b), (b, a)))
    step = max(1, BLOCK // len(b))
    head = min(len(b), 64)
    if (_distance(a[:64], b[:head]) <= km).any():
        return True
    return any((_distance(a[s : s + step], b) <= km).any() for s in range(0, len(a), step))


def _links(core: DataFrame, grid: Grid, km: float) -> DataFrame:
    """bucket, a, b: nodes (least core vessels) of cells that have core vessels within the distance of each other.

    Boxes of the cells' core vessels decide most pairs of cells; only where they can't, vessels near the other's box are compared.
    """
    cells = core.groupBy(*CELL).agg(F.min("mmsi").alias("node"), F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"))
    cells = written(cells, "cells")
    right = cells.select(*CELL, *(F.col(c).alias(f"{c}2") for c in ("node", "_s", "_n", "_w", "_e")))
    pairs = cells.withColumnsRenamed({"_y": "_y1", "_x": "_x1"}).withColumn("_c", F.explode(grid.near(F.col("_y1"), F.col("_x1")))).withColumns({"_y": F.col("_c._y"), "_x": F.col("_c._x")}).drop("_c").join(right, CELL).where("node < node2")
    # Bounds of the distance of any two points of the boxes, from their latitudes and longitudes apart.
    between = lambda lo, hi, lo2, hi2: F.greatest(F.lit(0.0), F.col(lo2) - F.col(hi), F.col(lo) - F.col(hi2))
    most = lambda lo, hi, lo2, hi2: F.greatest(F.col(hi2) - F.col(lo), F.col(hi) - F.col(lo2))
    wrap = lambda d: F.least(d, 360 - d)
    lat, lon = ("_s", "_n", "_s2", "_n2"), ("_w", "_e", "_w2", "_e2")
    lat_far, lat_near = most(*lat), between(*lat)
    lon_far = F.least(F.when(most(*lon) > 180, wrap(between(*lon)) + (F.col("_e") - F.col("_w")) + (F.col("_e2") - F.col("_w2"))).otherwise(most(*lon)), F.lit(180.0))
    lon_near = F.greatest(F.least(between(*lon), 360 - most(*lon)), F.lit(0.0))
    top = F.when((F.least("_s", "_s2") <= 0) & (F.greatest("_n", "_n2") >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(F.least("_s", "_s2")), F.abs(F.greatest("_n", "_n2"))))))
    bottom = F.cos(F.radians(F.greatest(F.abs(F.least("_s", "_s2")), F.abs(F.greatest("_n", "_n2")))))
    reach = lambda d, o, c: 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin(F.radians(d) / 2), 2) + F.pow(c * F.sin(F.radians(o) / 2), 2))))
    judged = written(pairs.withColumns({"_far": reach(lat_far, lon_far, top) * (1 + 1e-9), "_close": reach(lat_near, lon_near, bottom) * (1 - 1e-9)}).where(F.col("_close") <= km), "pairs")
    sure = judged.where(F.col("_far") <= km).select("bucket", F.col("node").alias("a"), F.col("node2").alias("b"))
    open_ = judged.where(F.col("_far") > km)
    sides = [open_.select("bucket", F.col(y).alias("_y"), F.col(x).alias("_x"), "node", "node2", F.lit(i).alias("side")) for i, (y, x) in enumerate((("_y1", "_x1"), ("_y", "_x")))]
    points = sides[0].unionByName(sides[1]).join(core.select(*CELL, "lat", "lon"), CELL).select("bucket", "node", "node2", "side", "lat", "lon")

    def test(group: pa.Table) -> pa.Table:
        side, at = group.column("side").to_numpy(), np.stack([group.column(c).to_numpy() for c in ("lat", "lon")], 1)
        a, b = at[side == 0], at[side == 1]
        hit = _touch(*((a, b) if len(a) >= len(b) else (b, a)), km)
        return group.slice(0, int(hit)).select(["bucket", "node", "node2"])

    met = points.groupBy("bucket", "node", "node2").applyInArrow(test, "bucket long, node long, node2 long")
    return sure.union(met.select("bucket", F.col("node").alias("a"), F.col("node2").alias("b")))


def members(positions: DataFrame, km: float = 25, least: int = 3, minutes: float | None = 30) -> DataFrame:
    """bucket, cluster (its least core vessel), mmsi, lat, lon of every vessel in a cluster.

    Each vessel's newest report in a bucket counts (without ``minutes`` all are one bucket). A vessel is core with
    ``least`` or more near it, itself included; a border vessel joins the cluster of least number among its core neighbours'.
    """
    if least < 1 or not km > 0:
        raise ValueError("a cluster needs a vessel or more and a distance above 0")
    bucket = F.lit(0).cast("long") if minutes is None else F.floor(seconds("received_at") / (minutes * 60))
    return members_of(positions.where("received_at is not null").withColumn("bucket", bucket), km, least)


def members_of(reports: DataFrame, km: float, least: int) -> DataFrame:
    """members() of reports that tell their `bucket`."""
    grid = Grid(km)
    row = grid.row(F.col("lat"))
    placed = reports.where("mmsi is not null and lat between -90 and 90 and lon between -180 and 180")
    own = latest(placed, "bucket", "mmsi").select("bucket", "mmsi", "lat", "lon", row.alias("_y"), grid.column(row, F.col("lon")).alias("_x"))
    own = written(own, "reports")
    full = own.groupBy(*CELL).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*CELL)
    dense, sparse = own.join(full, CELL, "left_semi"), own.join(full, CELL, "left_anti")
    near = _within(sparse, own, grid, km)
    counted = near.groupBy("bucket", "mmsi").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("bucket", "mmsi")
    core = written(dense.unionByName(sparse.join(counted, ["bucket", "mmsi"], "left_semi")), "core")
    nodes = core.groupBy(*CELL).agg(F.min("mmsi").alias("node"))
    links = _links(core, grid, km).unionByName(nodes.select("bucket", F.col("node").alias("a"), F.col("node").alias("b")))
    labels = written(nodes.join(components(links, "bucket"), ["bucket", "node"]).select(*CELL, F.col("component").alias("cluster")), "labels")
    inside = core.join(labels, CELL).select("bucket", "cluster", "mmsi", "lat", "lon")
    lone = sparse.join(core.select("bucket", "mmsi"), ["bucket", "mmsi"], "left_anti")
    border = _within(lone, core, grid, km).join(labels.withColumnsRenamed({"_y": "_oy", "_x": "_ox"}), ["bucket", "_oy", "_ox"]).groupBy("bucket", "mmsi").agg(F.min("cluster").alias("cluster"), F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    return inside.unionByName(border.select(*inside.columns))


def _within(asked: DataFrame, held: DataFrame, grid: Grid, km: float) -> DataFrame:
    """bucket, mmsi, lat, lon of ``asked`` and the cell (_oy, _ox) of each row of ``held`` within the distance.

    Asked vessels lie in cells of less than ``least``, so that each held row meets a bounded number.
    """
    a = asked.select("bucket", "mmsi", "lat", "lon", F.explode(grid.near(F.col("_y"), F.col("_x"))).alias("_c")).select("bucket", "mmsi", "lat", "lon", F.col("_c._y").alias("_y"), F.col("_c._x").alias("_x"))
    b = held.select(*CELL, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return a.join(b, CELL).where(haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= km).select("bucket", "mmsi", "lat", "lon", F.col("_y").alias("_oy"), F.col("_x").alias("_ox"))


def summarised(found: DataFrame) -> DataFrame:
    """bucket, cluster, vessels, centre_lat, centre_lon (plain means) and radius_km (the farthest member) of every cluster."""
    middle = found.groupBy("bucket", "cluster").agg(F.count("*").alias("vessels"), F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"))
    far = F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("centre_lat"), F.col("centre_lon"))).alias("radius_km")
    return found.join(middle, ["bucket", "cluster"]).groupBy(*middle.columns).agg(far)


def clusters(positions: DataFrame, km: float = 25, least: int = 3, minutes: float | None = 30) -> DataFrame:
    """Every cluster, by bucket, then the largest first."""
    return summarised(written(members(positions, km, least, minutes), "members")).orderBy("bucket", F.desc("vessels"), "cluster")


def cluster_containing(positions: DataFrame, mmsi: int, km: float = 25, least: int = 3) -> DataFrame:
    """The cluster that holds a vessel, all reports taken as simultaneous; no row if none does."""
    found = written(members(positions, km, least, None), "members")
    own = found.where(F.col("mmsi") == mmsi).select("bucket", "cluster")
    return summarised(found.join(F.broadcast(own), ["bucket", "cluster"], "left_semi"))


def _own_sizes(own: dict[str, np.ndarray], near: dict[str, np.ndarray], n: np.ndarray, km: float, least: int, band: float) -> np.ndarray:
    """For each point the vessels of the cluster that holds it among itself and its ``n`` rows of ``near`` in the band; 1 where none does."""
    rows = len(n)
    in_band = np.abs(near["at"] - np.repeat(own["at"], n)) <= band
    row = np.concatenate((np.arange(rows), np.repeat(np.arange(rows), n)[in_band]))
    vessel, at, i, lat, lon = (np.concatenate((own[c], near[c][in_band])) for c in ("vessel", "at", "id", "lat", "lon"))
    is_own = np.arange(len(row)) < rows
    # A vessel's newest row (of equals, the least id) is its place; places are numbered by vessel.
    order = np.lexsort((i, -at, vessel, row))
    order = order[(np.abs(lat[order]) <= 90) & (np.abs(lon[order]) <= 180)]
    new = np.ones(len(order), bool)
    new[1:] = (row[order[1:]] != row[order[:-1]]) | (vessel[order[1:]] != vessel[order[:-1]])
    order = order[new]
    row, is_own = row[order], is_own[order]
    slot = np.arange(len(row)) - np.searchsorted(row, row)
    wide = int(slot.max(initial=-1)) + 1
    y, x, there = np.zeros((rows, wide)), np.zeros((rows, wide)), np.zeros((rows, wide), bool)
    y[row, slot], x[row, slot], there[row, slot] = lat[order], lon[order], True
    near_by = (kilometres(y[:, :, None], x[:, :, None], y[:, None], x[:, None]) <= km) & there[:, :, None] & there[:, None]
    core = there & (near_by.sum(2) >= least)
    to_core = near_by & core[:, None]
    label = np.where(core, np.arange(wide), wide)
    while True:
        least_near = np.where(to_core, label[:, None], wide).min(2, initial=wide)
        after = np.where(core, np.minimum(label, least_near), wide)
        if (after == label).all():
            break
        label = after
    label = np.where(there & ~core, least_near, label)
    mine = np.full(rows, wide)
    mine[row[is_own]] = label[row[is_own], slot[is_own]]
    return np.where(mine < wide, (label == mine[:, None]).sum(1), 1)


def own_cluster_sizes(km: float, least: int, band: float):
    """For mapInArrow over near_in_time(): incident_id, the length of `near`, and the size of the members_of() cluster that holds the incident."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, FEW):
                b = whole.slice(s, FEW)
                n = pc.list_value_length(b.column("near")).to_numpy(zero_copy_only=False).astype(np.int64)
                entries = b.column("near").flatten()
                near = {c: entries.field(f).to_numpy() for c, f in (("vessel", "other"), ("id", "id"), ("at", "at"), ("lat", "lat"), ("lon", "lon"))}
                own = {c: b.column(f).to_numpy() for c, f in (("vessel", "mmsi"), ("id", "incident_id"), ("at", "at"), ("lat", "lat"), ("lon", "lon"))}
                yield pa.RecordBatch.from_arrays([b.column("incident_id"), pa.array(n), pa.array(_own_sizes(own, near, n, km, least, band).astype(np.int64))], ["incident_id", "_i", "_c"])

    return run
