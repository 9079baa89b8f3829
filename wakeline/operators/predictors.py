"""Predictors of a window's steps, called with whole windows as arrays, and how far the steps were from them.

A predictor takes features (n, size, 8), positions (n, size, 2) in degrees and times (n, size) in seconds, and gives
the steps (n, size - 1, 2) that it expects from each report to the next; NaN where it expects none. Features are
those of `FEATURES`, -1 where a report doesn't tell.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.windows import seconds
from wakeline.settings import KNOTS_PER_KM_H, WINDOW

FEATURES = ["sog", "cog", "heading", "rate_of_turn", "vessel_class", "implied", "heading_missing", "rot_missing"]
KM_PER_DEGREE = 111.195
Predictor = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
PREDICTORS: dict[str, Predictor] = {}


def predictor(f: Predictor) -> Predictor:
    """Makes a predictor known by its name."""
    PREDICTORS[f.__name__] = f
    return f


@predictor
def same_step(features: np.ndarray, positions: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The step before, again; none for the first."""
    steps = np.diff(positions, axis=1)
    return np.concatenate((np.full_like(steps[:, :1], np.nan), steps[:, :-1]), axis=1)


@predictor
def same_velocity(features: np.ndarray, positions: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The velocity of the step before over the time of this one; none after a step without time."""
    steps, gaps = np.diff(positions, axis=1), np.diff(times, axis=1)
    speed = np.where(gaps[..., None] > 0, steps / np.where(gaps > 0, gaps, 1)[..., None], np.nan)
    return np.concatenate((np.full_like(steps[:, :1], np.nan), speed[:, :-1] * gaps[:, 1:, None]), axis=1)


@predictor
def told_course(features: np.ndarray, positions: np.ndarray, times: np.ndarray) -> np.ndarray:
    """What the report's speed and course lead to by the next; none where either isn't told."""
    sog, cog, gaps = features[:, :-1, 0], np.radians(features[:, :-1, 1]), np.diff(times, axis=1)
    degrees = np.where((sog >= 0) & (features[:, :-1, 1] >= 0), sog / KNOTS_PER_KM_H * gaps / 3600 / KM_PER_DEGREE, np.nan)
    lat = np.radians(positions[:, :-1, 0])
    return np.stack((degrees * np.cos(cog), degrees * np.sin(cog) / np.maximum(np.cos(lat), 1e-6)), axis=-1)


def step_errors(windows: DataFrame, name: str | Predictor = "same_step", size: int = WINDOW) -> DataFrame:
    """mmsi, window_index, event_id, place, error: how far (degrees) each report's step was from the one expected.

    ``windows`` are whole windows of ``size`` reports with the features. The first report's error is 0, and so is that of a
    step for which nothing was expected.
    """
    expect = PREDICTORS[name] if isinstance(name, str) else name
    told = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in FEATURES]
    row = F.struct("place", "event_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), seconds("received_at").alias("t"), F.array(*told).alias("f"))
    packed = windows.groupBy("mmsi", "window_index").agg(F.array_sort(F.collect_list(row)).alias("w")).where(F.size("w") == size)
    packed = packed.select("mmsi", "window_index", F.col("w.event_id").alias("ids"), F.flatten("w.f").alias("f"), F.col("w.lat").alias("lat"), F.col("w.lon").alias("lon"), F.col("w.t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = lambda c: batch.column(c).flatten().to_numpy()  # noqa: E731, B023
            positions = np.stack((flat("lat"), flat("lon")), -1).reshape(n, size, 2)
            expected = expect(flat("f").reshape(n, size, len(FEATURES)), positions, flat("t").reshape(n, size))
            off = np.sqrt(((expected - np.diff(positions, axis=1)) ** 2).sum(-1))
            error = np.concatenate((np.zeros((n, 1)), np.where(np.isnan(off), 0.0, off)), axis=1)
            again = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(), size))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([again("mmsi"), again("window_index"), pa.array(flat("ids")), pa.array(np.tile(np.arange(size), n)), pa.array(error.ravel())], names=["mmsi", "window_index", "event_id", "place", "error"])

    return packed.mapInArrow(run, "mmsi long, window_index long, event_id long, place long, error double")
