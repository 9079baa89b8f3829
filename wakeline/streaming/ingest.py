"""From envelopes to stored positions and vessels, batch by batch; and a stream that runs once or again and again."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wakeline.operators.updates import last_of_key
from wakeline.sources.envelopes import from_envelopes
from wakeline.sources.files import append_new
from wakeline.sources.tables import exists

POSITION_KEY = ["mmsi", "received_at", "lat", "lon"]
POSITION = [*POSITION_KEY, "sog", "cog", "heading", "rate_of_turn", "message_type"]
STATIC = ["mmsi", "received_at", "ship_name", "ship_type", "call_sign", "destination"]


class DropCounts:
    """Messages dropped, by reason; a batch that is run again replaces its own counts."""

    def __init__(self) -> None:
        self._batches: dict[int, Counter] = {}

    def set(self, number: int, counts: dict[str, int]) -> None:
        self._batches[number] = Counter(counts)

    def drain(self) -> dict[str, int]:
        """The counts since the last call, which starts them anew."""
        out: Counter = sum(self._batches.values(), Counter())
        self._batches.clear()
        return dict(out)


class Ingest:
    """A foreachBatch function over envelopes: appends new positions and vessels' rows, and counts what is dropped.

    Vessels are a log of which static() gives the newest row of each, so that no stored row is written over; both
    tables leave out rows that are there already, so that a batch can be run again.
    """

    def __init__(self, folder: str, column: str = "envelope") -> None:
        self.positions_at, self.static_at, self.column, self.drops = f"{folder}/positions", f"{folder}/static", column, DropCounts()

    def __call__(self, batch: DataFrame, number: int) -> None:
        records = from_envelopes(batch, self.column).persist()
        try:
            counts = {r.reason: r["count"] for r in records.where("kind = 'dropped'").groupBy("reason").count().collect()}  # a handful of reasons
            append_new(records.where("kind = 'position'").select(*POSITION), self.positions_at, POSITION_KEY)
            append_new(records.where("kind = 'static'").select(*STATIC), self.static_at, STATIC)
            self.drops.set(number, counts)
        finally:
            records.unpersist()

    def static(self, spark: SparkSession) -> DataFrame:
        """The newest row of each vessel."""
        if not exists(spark, self.static_at):
            return spark.createDataFrame([], "mmsi long, received_at timestamp, ship_name string, ship_type long, call_sign string, destination string")
        return last_of_key(spark.read.parquet(self.static_at).drop("event_date"), ["mmsi"], F.struct("received_at", F.xxhash64(*STATIC)))


def start(writer: DataStreamWriter, checkpoints: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Starts a stream that looks every so often, or takes what is there and ends."""
    w = writer.option("checkpointLocation", checkpoints)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
