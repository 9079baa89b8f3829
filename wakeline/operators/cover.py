"""Covers of zones by cells of several sizes: large ones inside, small ones along the border, a bounded number for each zone.

A point asks for its cell at each size in use. A cell that no edge of its zone touches lies inside as a whole, so
that its points need no test; only points in a border cell are held against the zone's edges.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of the cells in degrees, each a quarter of the one before.
SIZES = [16.0 / 4**i for i in range(6)]
#: A zone's border cells are divided while it can't have more than this.
MOST_CELLS = 2048
CELL = ["_level", "_y", "_x"]


def size_of(level: Column) -> Column:
    return F.get(F.array(*map(F.lit, SIZES)), level)


def placed(points: DataFrame, cover: DataFrame) -> DataFrame:
    """Each point once for every size that the cover uses (at most six)."""
    levels = sorted(r[0] for r in cover.select("_level").distinct().collect())
    at = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    return at.withColumns({"_y": F.floor(F.col("lat") / size_of(F.col("_level"))), "_x": F.floor(F.col("lon") / size_of(F.col("_level")))})


def rectangle_cover(zones: DataFrame) -> DataFrame:
    """zones (lat_min, lat_max, lon_min, lon_max) once for each of its cells: of the least size that needs no more than five by five, where one does."""
    widest = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min"))
    level = F.lit(0)
    for i in range(1, len(SIZES)):
        level = F.when(widest <= 4 * SIZES[i], i).otherwise(level)
    at = zones.withColumn("_level", level.cast("int"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size_of(F.col("_level"))), F.floor(F.col(hi) / size_of(F.col("_level"))))
    sound = at.where("lat_min <= lat_max and lon_min <= lon_max")
    return sound.withColumn("_y", F.explode(span("lat_min", "lat_max"))).withColumn("_x", F.explode(span("lon_min", "lon_max")))


def _touched(edges: np.ndarray, y: np.ndarray, x: np.ndarray, size: float) -> np.ndarray:
    """Which cells (south-west corners) an edge (x1, y1, x2, y2) touches, borders included."""
    out = np.zeros(len(y), bool)
    step = max(1, (1 << 20) // max(1, len(edges)))
    x1, y1, x2, y2 = edges.T
    for s in range(0, len(y), step):
        lo_y, lo_x = y[s : s + step, None], x[s : s + step, None]
        hi_y, hi_x = lo_y + size, lo_x + size
        boxes = (np.minimum(x1, x2) <= hi_x) & (np.maximum(x1, x2) >= lo_x) & (np.minimum(y1, y2) <= hi_y) & (np.maximum(y1, y2) >= lo_y)
        # The corners lie on both sides of the edge's line, or on it.
        corners = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cy in (lo_y, hi_y) for cx in (lo_x, hi_x)]
        least, most = np.minimum.reduce(corners), np.maximum.reduce(corners)
        out[s : s + step] = (boxes & (least <= 1e-12) & (most >= -1e-12)).any(1)
    return out


def _inside(polygons: list[np.ndarray], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which points lie in some polygon: crossings eastward of all its rings are odd."""
    out = np.zeros(len(y), bool)
    for edges in polygons:
        x1, y1, x2, y2 = edges.T
        for i in range(len(y)):
            up = (y1 > y[i]) != (y2 > y[i])
            out[i] |= bool((x[i] < (x2[up] - x1[up]) * (y[i] - y1[up]) / (y2[up] - y1[up]) + x1[up]).sum() % 2)
    return out


def zone_cells(polygons: list[np.ndarray], most: int = MOST_CELLS) -> list[tuple[int, int, int, bool]]:
    """(level, y, x, whether it lies inside) of a zone's cells; ``polygons`` are their rings' edges."""
    edges = np.concatenate(polygons)
    found: list[tuple[int, int, int, bool]] = []
    size = SIZES[0]
    lo = np.floor(np.minimum(edges[:, :2].min(0), edges[:, 2:].min(0)) / size).astype(int)
    hi = np.floor(np.maximum(edges[:, :2].max(0), edges[:, 2:].max(0)) / size).astype(int)
    cells = np.array([(y, x) for y in range(lo[1], hi[1] + 1) for x in range(lo[0], hi[0] + 1)])
    for level, size in enumerate(SIZES):
        border = _touched(edges, cells[:, 0] * size, cells[:, 1] * size, size)
        clear = cells[~border]
        inner = clear[_inside(polygons, (clear[:, 0] + 0.5) * size, (clear[:, 1] + 0.5) * size)]
        found += [(level, int(y), int(x), True) for y, x in inner]
        cells = cells[border]
        if not len(cells) or level + 1 == len(SIZES) or len(found) + len(cells) * 16 > most:
            return found + [(level, int(y), int(x), False) for y, x in cells]
        cells = np.concatenate([cells * 4 + (dy, dx) for dy in range(4) for dx in range(4)])
    return found


def ring_edges(polygon: list[list[list[float]]]) -> np.ndarray:
    """(x1, y1, x2, y2) of all rings of a polygon."""
    return np.concatenate([np.concatenate([np.array(r[:-1], float)[:, :2], np.array(r[1:], float)[:, :2]], 1) for r in polygon])


def polygon_cover(zones: DataFrame, most: int = MOST_CELLS) -> DataFrame:
    """zone_id, _level, _y, _x, inner of zones (zone_id, polygons); a zone without an edge has no cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for zone, polygons in zip(batch.column("zone_id").to_pylist(), batch.column("polygons").to_pylist(), strict=True):
                sound = [[r for r in p if r and len(r) > 1] for p in polygons or [] if p]
                rows = [(zone, *c) for c in zone_cells([ring_edges(p) for p in sound if p], most)] if any(sound) else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["zone_id", *CELL, "inner"])

    return zones.select(F.col("zone_id").cast("long").alias("zone_id"), "polygons").mapInArrow(run, "zone_id long, _level int, _y long, _x long, inner boolean")
