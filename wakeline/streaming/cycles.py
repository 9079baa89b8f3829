"""Cycles over a stream of scored reports: flags, a pause for each vessel, a cap, and what is carried over.

Each cycle's decisions are one written table, `decided/cycle=n`, and depend only on the cycle's reports, on its
clock (written first, with the thresholds in force) and on the tables of earlier cycles. A cycle that is run again
after a failure thus decides the same and writes the same folders over.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.reports import histogram_array
from wakeline.sources.tables import exists

log = logging.getLogger(__name__)
FLAG = "mmsi long, flagged_at timestamp, error double, n_votes int, tier string"
CLOCK = "cycle_at timestamp, a double, b double, observing boolean, retuned boolean"


@dataclass(frozen=True)
class Thresholds:
    """Flags lie above ``a``; those at or above ``b`` are of tier B. ``model_version`` is the model they were set for."""

    a: float
    b: float | None = None
    model_version: str | None = None


def report_flags(scored: DataFrame, a: float, b: float | None = None, min_votes: int = 1) -> DataFrame:
    """Each vessel's strongest report with enough votes among those whose step can be judged.

    ``scored`` has mmsi, received_at, error, freeze and reason (null where the step can be judged).
    """
    high = F.coalesce(~F.isnan("error") & (F.col("error") > a), F.lit(False))
    frozen = F.coalesce(~F.isnan("freeze") & (F.col("freeze") > 0.5), F.lit(False))
    voted = scored.where(F.col("reason").isNull()).withColumn("n_votes", high.cast("int") + frozen.cast("int")).where(F.col("n_votes") >= min_votes)
    tier = F.when(high & F.lit(b is not None) & (F.col("error") >= (b if b is not None else 0.0)), "B").otherwise("A")
    return strongest(voted.select("mmsi", F.col("received_at").alias("flagged_at"), "error", "n_votes", tier.alias("tier")))


def strongest(flags: DataFrame) -> DataFrame:
    """One flag for each vessel: the most votes, then the highest error (null last), then the newest."""
    rest = [c for c in flags.columns if c != "mmsi"]
    rank = F.struct(F.col("n_votes"), F.coalesce("error", F.lit(float("-inf"))), F.col("flagged_at"))
    return flags.groupBy("mmsi").agg(F.max_by(F.struct(*rest), rank).alias("_f")).select("mmsi", *(f"_f.{c}" for c in rest))


def decide(flags: DataFrame, deferred: DataFrame, paused: DataFrame, most: int = 25) -> DataFrame:
    """The cycle's flags, carried ones among them, with `outcome`: debounced, chosen (at most ``most``, strongest first) or deferred.

    ``paused`` names the vessels (mmsi) that have an open incident or were chosen a short time ago.
    """
    merged = strongest(flags.unionByName(deferred)).join(paused.select("mmsi").distinct().withColumn("_p", F.lit(True)), "mmsi", "left")
    free = merged.where("_p is null").drop("_p")
    order = [F.desc("n_votes"), F.desc_nulls_last("error"), F.desc("flagged_at"), F.col("mmsi")]
    chosen = free.orderBy(*order).limit(most).select("mmsi", F.lit("chosen").alias("_c"))
    outcome = F.when(F.col("_p"), "debounced").otherwise(F.coalesce("_c", F.lit("deferred")))
    return merged.join(F.broadcast(chosen), "mmsi", "left").select(*flags.columns, outcome.alias("outcome"))


def open_vessels(incidents: DataFrame, now: Column, hours: float) -> DataFrame:
    """Vessels with an incident of the last ``hours`` that isn't resolved."""
    recent = F.col("created_at") > now - F.make_interval(secs=F.lit(hours * 3600))
    return incidents.where(~F.col("status").eqNullSafe("resolved") & recent).select("mmsi")


class Cycles:
    """A foreachBatch function over scored reports (mmsi, received_at, error, freeze, reason).

    ``investigate`` takes the chosen flags and returns incidents (mmsi and what else it finds); a chosen vessel
    without one, and all of them where it raises, count as failed and rest like the others. ``follow_up`` sees the
    stored incidents; if it raises, the cycle stands. Without thresholds a cycle scores and records, and flags nothing.
    ``retune`` may set thresholds anew: at the start, every ``retune_s``, and when the model changed, then not
    within ``least_s`` of the last time.
    """

    def __init__(
        self,
        folder: str,
        investigate: Callable[[DataFrame], DataFrame],
        thresholds: Callable[[], Thresholds | None],
        incidents: Callable[[], DataFrame] | None = None,
        follow_up: Callable[[DataFrame], None] | None = None,
        retune: Callable[[], None] | None = None,
        model_version: str | None = None,
        most: int = 25,
        pause_hours: float = 6,
        min_votes: int = 1,
        retune_s: float = 3600,
        least_s: float = 300,
        clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC),
    ) -> None:
        self.folder, self.investigate, self.thresholds, self.incidents = folder, investigate, thresholds, incidents
        self.follow_up, self.retune, self.model_version, self.clock = follow_up, retune, model_version, clock
        self.most, self.pause_hours, self.min_votes, self.retune_s, self.least_s = most, pause_hours, min_votes, retune_s, least_s

    def _earlier(self, spark: SparkSession, table: str, number: int, schema: str) -> DataFrame:
        """The rows of a table that cycles before this one wrote."""
        path = f"{self.folder}/{table}"
        if not exists(spark, path):
            return spark.createDataFrame([], f"{schema}, cycle long")
        return spark.read.schema(f"{schema}, cycle long").parquet(path).where(F.col("cycle") < number)

    def _retuned(self, spark: SparkSession, number: int, now: dt.datetime, active: Thresholds | None) -> bool:
        if self.retune is None:
            return False
        last = self._earlier(spark, "clock", number, CLOCK).where("retuned").agg(F.unix_micros(F.max("cycle_at"))).first()[0]
        age = None if last is None else now.timestamp() - last / 1e6
        changed = active is None or active.model_version != self.model_version
        if not (age is None or age >= self.retune_s or (changed and age >= self.least_s)):
            return False
        try:
            self.retune()
        except Exception:
            log.exception("retune failed; the thresholds in force stay")
        return True

    def _clock(self, spark: SparkSession, number: int) -> tuple[dt.datetime, Thresholds | None]:
        """The cycle's time and thresholds: those of its first run."""
        path = f"{self.folder}/clock/cycle={number}"
        if not exists(spark, f"{path}/_SUCCESS"):
            now = self.clock()
            retuned = self._retuned(spark, number, now, self.thresholds())
            own = self.thresholds()
            row = (now, own.a if own else None, own.b if own else None, own is None, retuned)
            spark.createDataFrame([row], CLOCK).coalesce(1).write.mode("overwrite").parquet(path)
        r = spark.read.schema(CLOCK).parquet(path).select(F.unix_micros("cycle_at").alias("t"), "a", "b", "observing").first()
        return dt.datetime.fromtimestamp(r.t / 1e6, dt.UTC), None if r.observing else Thresholds(r.a, r.b)

    def __call__(self, scored: DataFrame, number: int) -> None:
        scored = scored.select("mmsi", "received_at", "error", "freeze", "reason").persist()  # flags, counts and the histogram read it
        try:
            self._run(scored, number)
        finally:
            scored.unpersist()

    def _run(self, scored: DataFrame, number: int) -> None:
        spark = scored.sparkSession
        now, active = self._clock(spark, number)
        at = F.timestamp_micros(F.lit(int(now.timestamp() * 1e6)))
        before = self._earlier(spark, "decided", number, f"{FLAG}, outcome string, cycle_at timestamp")
        deferred = before.where((F.col("cycle") == number - 1) & (F.col("outcome") == "deferred")).select("mmsi", "flagged_at", "error", "n_votes", "tier")
        flags = spark.createDataFrame([], FLAG) if active is None else report_flags(scored, active.a, active.b, self.min_votes)
        paused = before.where((F.col("outcome") == "chosen") & (F.col("cycle_at") > at - F.make_interval(secs=F.lit(self.pause_hours * 3600)))).select("mmsi")
        if self.incidents is not None:
            paused = paused.unionByName(open_vessels(self.incidents(), at, self.pause_hours))
        path = f"{self.folder}/decided/cycle={number}"
        decide(flags, deferred, paused, self.most).withColumn("cycle_at", at).write.mode("overwrite").parquet(path)
        decided = spark.read.schema(f"{FLAG}, outcome string, cycle_at timestamp").parquet(path)
        found = self._investigated(decided.where("outcome = 'chosen'").drop("outcome", "cycle_at"), number)
        try:
            self._record(scored, decided, found, active is None, at, number)
        except PySparkException:
            log.exception("the statistics of cycle %s could not be written", number)

    def _investigated(self, chosen: DataFrame, number: int) -> DataFrame | None:
        """The stored incidents of the chosen flags; None where the investigation failed as a whole."""
        path = f"{self.folder}/incidents/cycle={number}"
        if chosen.isEmpty():
            return None
        try:
            self.investigate(chosen).write.mode("overwrite").parquet(path)
        except Exception:
            log.exception("the investigations of cycle %s failed", number)
            return None
        stored = chosen.sparkSession.read.parquet(path)
        if self.follow_up is not None:
            try:
                self.follow_up(stored)
            except Exception:
                log.exception("the follow-up of cycle %s failed", number)
        return stored

    def _record(self, scored: DataFrame, decided: DataFrame, found: DataFrame | None, observing: bool, at: Column, number: int) -> None:
        """One row: what the cycle saw, flagged, put off and looked into, and the histogram of its errors."""
        good = F.col("reason").isNull()
        seen = scored.agg(F.count_distinct("mmsi").alias("vessels_seen"), F.count_if(good).alias("reports_scored"), F.count_if(~good).alias("skipped_unscorable"))
        kept = decided if found is None else decided.join(found.select("mmsi", F.lit(True).alias("_found")).distinct(), "mmsi", "left")
        looked = F.lit(False) if found is None else F.coalesce("_found", F.lit(False))
        is_ = lambda o: F.col("outcome") == o
        counts = kept.agg(
            F.count("*").alias("flagged"), F.count_if(F.col("tier") == "A").alias("flagged_a"), F.count_if(F.col("tier") == "B").alias("flagged_b"), F.count_if(is_("debounced")).alias("debounced"),
            F.count_if(is_("deferred")).alias("deferred"), F.count_if(is_("chosen") & looked).alias("investigated"), F.count_if(is_("chosen") & ~looked).alias("failed"),
        )
        row = seen.join(counts).join(histogram_array(scored.where(good), F.col("error"))).withColumns({"observing_only": F.lit(observing), "model_version": F.lit(self.model_version), "cycle_at": at})
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats/cycle={number}")
