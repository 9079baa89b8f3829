"""Append-only tables of thresholds, audit rows and report texts; a table's state is read from its rows.

Each row has an id that follows from its content, and a row that is there already is left out, so that a write can
be done again.
"""

import datetime as dt
import logging
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.rules import check_pair
from wakeline.sources.files import append_new, with_row_id
from wakeline.sources.tables import exists

log = logging.getLogger(__name__)
THRESHOLD = "id long, a double, b double, model_version string, set_by string, set_at timestamp"
AUDIT = "agent string, incident_id string, source string, steps string, decision string, at timestamp"
REPORT = "incident_id string, event string, report_text string, expires_at timestamp, at timestamp"
#: How long a report text is kept, and the pause between two looks at what is over.
KEPT_HOURS, PAUSE_S = 24, 900


def _read(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    if not exists(spark, folder):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(folder)


class ThresholdStore:
    """Threshold rows in the order in which they were set."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        return _read(self.spark, self.folder, THRESHOLD)

    def set(self, a: float, b: float, model_version: str | None, set_by: str, at: dt.datetime) -> int:
        """Appends a sound pair and returns its id; one writer at a time."""
        check_pair(a, b)
        number = (self.rows().agg(F.max("id")).first()[0] or 0) + 1
        append_new(self.spark.createDataFrame([(number, a, b, model_version, set_by, at)], THRESHOLD), self.folder, ["id"], "set_at")
        return number

    def active(self) -> DataFrame:
        """The newest row; none where nothing was set."""
        return self.history(1)

    def history(self, most: int = 20) -> DataFrame:
        if most < 1:
            raise ValueError("a history has a row or more")
        return self.rows().orderBy(F.desc("id")).limit(most)


def record_audit(spark: SparkSession, folder: str, agent: str, incident_id: str, source: str, steps: str, decision: str, at: dt.datetime) -> bool:
    """Appends what an agent did; a failure is logged and told by False, never raised."""
    try:
        row = with_row_id(spark.createDataFrame([(agent, incident_id, source, steps, decision, at)], AUDIT), "agent", "incident_id", "at")
        append_new(row, folder, ["id"], "at")
    except Exception:
        log.exception("the audit row of %s for %s was not written", agent, incident_id)
        return False
    return True


class ReportStore:
    """Report texts with an end of time: a log of what was stored, deleted and expired."""

    def __init__(self, spark: SparkSession, folder: str, hours: float = KEPT_HOURS) -> None:
        self.spark, self.folder, self.hours = spark, folder, hours

    def log(self) -> DataFrame:
        return _read(self.spark, self.folder, f"id string, {REPORT}").drop("id")

    def _append(self, rows: DataFrame) -> None:
        append_new(with_row_id(rows, "incident_id", "event", "at"), self.folder, ["id"], "at")

    def store(self, texts: DataFrame, at: dt.datetime) -> None:
        """Takes texts (incident_id, report_text); a text that is stored again replaces the one before and starts its time anew."""
        end = at + dt.timedelta(hours=self.hours)
        self._append(texts.select(F.col("incident_id").cast("string").alias("incident_id"), F.lit("stored").alias("event"), "report_text", F.lit(end).cast("timestamp").alias("expires_at"), F.lit(at).cast("timestamp").alias("at")))

    def state(self) -> DataFrame:
        """incident_id, report_text (null once deleted or expired), expires_at, delete_reason of each incident that ever had a text."""
        last = self.log().groupBy("incident_id").agg(F.max_by(F.struct("event", "report_text", "expires_at"), F.struct(F.col("at"), F.col("event") != "stored")).alias("_l"))
        stored = F.col("_l.event") == "stored"
        return last.select("incident_id", F.when(stored, F.col("_l.report_text")).alias("report_text"), "_l.expires_at", F.when(~stored, F.col("_l.event")).alias("delete_reason"))

    def _end(self, due: DataFrame, event: str, at: dt.datetime) -> int:
        rows = due.select("incident_id", F.lit(event).alias("event"), F.lit(None).cast("string").alias("report_text"), "expires_at", F.lit(at).cast("timestamp").alias("at"))
        n = rows.count()
        if n:
            self._append(rows)
        return n

    def delete(self, incidents: Column, at: dt.datetime, reason: str = "deleted") -> int:
        """Ends the texts of the incidents for which the condition holds; how many there were."""
        return self._end(self.state().where(F.col("report_text").isNotNull() & incidents), reason, at)

    def expire(self, at: dt.datetime) -> int:
        """Ends the texts whose time is over; how many there were."""
        return self._end(self.state().where(F.col("report_text").isNotNull() & (F.col("expires_at") < F.lit(at).cast("timestamp"))), "expired", at)


class Retention(threading.Thread):
    """Ends texts whose time is over, again and again; a turn that fails is logged and the next one comes."""

    def __init__(self, store: ReportStore, pause_s: float = PAUSE_S, clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)) -> None:
        super().__init__(daemon=True)
        self.store, self.pause_s, self.clock, self.over = store, pause_s, clock, threading.Event()

    def run(self) -> None:
        while not self.over.is_set():
            try:
                self.store.expire(self.clock())
            except Exception:
                log.exception("a turn of the retention failed")
            self.over.wait(self.pause_s)

    def stop(self) -> None:
        self.over.set()
        self.join(30)
