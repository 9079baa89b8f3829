"""Streams: reports without duplicates, and flags with a pause for each vessel."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FLAG = "mmsi long, flagged_at timestamp, score double"


def report_stream(spark: SparkSession, folder: str, schema: str, late: str = "30 seconds") -> DataFrame:
    """Reports of a growing folder, each vessel, time and place once within the watermark."""
    raw = spark.readStream.schema(schema).parquet(folder)
    return raw.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["mmsi", "received_at", "lat", "lon"])


def paused_flags(flags: DataFrame, hours: float = 6) -> DataFrame:
    """Of a stream of flags (mmsi, flagged_at, score), those that come ``hours`` or more after the vessel's last kept one."""
    pause = int(hours * 3600 * 1e6)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["flagged_at", "score"], ascending=[True, False], ignore_index=True)
        t = rows["flagged_at"].astype("datetime64[us]").astype("int64").to_numpy()
        kept, at = [], 0 if last is None else int(np.searchsorted(t, last + pause))
        while at < len(t):  # one step for each flag that is kept
            kept.append(at)
            last = int(t[at])
            at = int(np.searchsorted(t, last + pause))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + pause) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[kept, ["mmsi", "flagged_at", "score"]]

    return flags.withWatermark("flagged_at", "1 hour").groupBy("mmsi").applyInPandasWithState(keep, FLAG, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def recent_context(reports: DataFrame, most: int = 20, hours: float = 6, late: str = "1 hour") -> DataFrame:
    """Of a stream of reports (mmsi, received_at, sog), each one newer than all scored before, with its context.

    The context is the vessel's last ``most`` reports within ``hours`` up to it: their count, first time and mean speed.
    Late reports join the context but are not given out. A vessel's state goes when its newest report is that old.
    """
    width = int(hours * 3600 * 1e6)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        times, speeds, last = state.get if state.exists else ([], [], None)
        new = pd.DataFrame({"t": rows["received_at"].astype("datetime64[us]").astype("int64"), "sog": rows["sog"].astype("float64")})
        held = pd.concat([pd.DataFrame({"t": pd.Series(times, dtype="int64"), "sog": pd.Series(speeds, dtype="float64")}), new]).sort_values("t", kind="stable", ignore_index=True)
        first = np.maximum(np.searchsorted(held["t"], held["t"] - width), np.arange(len(held)) - most + 1)
        known = held["sog"].notna()
        total, count = (np.concatenate(([0.0], np.cumsum(v))) for v in (held["sog"].where(known, 0.0), known))
        i = np.arange(len(held))
        out = pd.DataFrame({"mmsi": key[0], "received_at": pd.to_datetime(held["t"], unit="us"), "n_context": i - first + 1, "context_from": pd.to_datetime(held["t"].to_numpy()[first], unit="us"), "mean_sog": (total[i + 1] - total[first]) / np.where(count[i + 1] > count[first], count[i + 1] - count[first], np.nan)})
        yield out if last is None else out[held["t"] > last]
        kept = held.iloc[first[-1] :]
        state.update(([int(t) for t in kept["t"]], [float(v) for v in kept["sog"]], int(held["t"].iloc[-1])))
        state.setTimeoutTimestamp(max((int(held["t"].iloc[-1]) + width) // 1000, state.getCurrentWatermarkMs() + 1))

    shape = "mmsi long, received_at timestamp, n_context long, context_from timestamp, mean_sog double"
    return reports.select("mmsi", "received_at", "sog").withWatermark("received_at", late).groupBy("mmsi").applyInPandasWithState(follow, shape, "times array<long>, speeds array<double>, last long", "append", GroupStateTimeout.EventTimeTimeout)
