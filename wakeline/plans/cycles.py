"""Queries of cycles: stored histograms, expected flags, thresholds in force, cycles replayed."""

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import console, reports
from wakeline.operators.detectors import flagged, votes
from wakeline.operators.windows import freeze_score, skip_reason, with_error
from wakeline.plans.queries import BIN, EDGES_SQL, ERRORS, GATE, LIVE, MAX_GAP, ORDERS, A, B, _6, _live, _orders, _steps
from wakeline.plans.registry import query
from wakeline.sources.tables import shared_folder, written
from wakeline.streaming.cycles import Cycles, Thresholds

AS_OF = "2024-01-20"
STATS = f"ed AS (SELECT {EDGES_SQL} AS edges), per AS (SELECT ts::DATE AS day, nullif(event_type, 'view') AS version, {BIN.format(x='value / 100')} AS bin, count(*) AS n FROM events, ed GROUP BY ALL)"
KEPT = f"day > DATE '{AS_OF}' - 3 AND day <= DATE '{AS_OF}'"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events as one cycle of each version (a null one too), as the cycles store them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").cast("timestamp").alias("cycle_at"), F.nullif("event_type", F.lit("view")).alias("model_version"), "value")
    return reports.histogram_array(e, F.col("value") / 100, "cycle_at", "model_version")


def _as_of() -> object:
    return F.lit(AS_OF).cast("timestamp")


@query(f"WITH {STATS}, s AS (SELECT version, bin, sum(n)::BIGINT AS n FROM per GROUP BY ALL) SELECT v.version, array_to_string(list(coalesce(n, 0) ORDER BY i), ',') AS histogram FROM (SELECT DISTINCT version FROM s) v CROSS JOIN range(120) r(i) LEFT JOIN s ON s.version IS NOT DISTINCT FROM v.version AND s.bin = i GROUP BY v.version")
def merged_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored arrays of all days added up for each version."""
    out = reports.merged_arrays(_stats(spark, sf_dir), "model_version")
    return out.select(F.col("model_version").alias("version"), F.array_join(F.transform("histogram", lambda n: n.cast("string")), ",").alias("histogram"))


@query(f"WITH {STATS} SELECT bin, sum(n)::BIGINT AS n FROM per WHERE version IS NULL AND {KEPT} GROUP BY bin")
def stored_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cycles of the null version stored in the 72 hours up to a time."""
    return reports.stored_histogram(_stats(spark, sf_dir), None, _as_of())


@query(
    f"WITH {STATS}, h AS (SELECT bin, sum(n) AS n FROM per WHERE version = 'click' AND {KEPT} GROUP BY bin), e AS (SELECT n, edges[bin + 1] AS low, edges[bin + 2] AS high FROM h, ed) "
    "SELECT round(coalesce(sum(CASE WHEN low >= 0.7 THEN n WHEN high <= 0.7 THEN 0 ELSE n * (ln(high) - ln(0.7)) / (ln(high) - ln(low)) END) / sum(n), 0), 6) AS flag_share, coalesce(sum(n), 0)::BIGINT AS reports_scored, round(coalesce(sum(CASE WHEN low >= 0.7 THEN n WHEN high <= 0.7 THEN 0 ELSE n * (ln(high) - ln(0.7)) / (ln(high) - ln(low)) END), 0), 4) AS expected_flags FROM e"
)
def expected_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that a candidate threshold would flag, and how many of a version's reports of 72 hours that is."""
    hist = reports.stored_histogram(_stats(spark, sf_dir), "click", _as_of())
    return reports.expected_flags(hist, 0.7).select(_6("flag_share"), "reports_scored", F.round("expected_flags", 4).alias("expected_flags"))


@query(f"WITH {LIVE} SELECT DISTINCT mmsi FROM live WHERE received_at > TIMESTAMP '2024-01-29'")
def active_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels that reported since a time."""
    return console.active_vessels(_live(spark, sf_dir), F.lit("2024-01-29").cast("timestamp_ntz"))


@query(f"WITH {ORDERS} SELECT kind AS tier, count(*) AS n FROM o WHERE flagged_at > TIMESTAMP '1997-03-01' - INTERVAL 720 HOUR AND flagged_at <= TIMESTAMP '1997-03-01' GROUP BY kind")
def incident_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of each tier in the hours up to a time."""
    return console.incident_volume(_orders(spark, sf_dir).withColumnRenamed("kind", "tier"), F.lit("1997-03-01").cast("timestamp_ntz"), hours=720)


JUMP = f"{ERRORS}, j AS (SELECT *, coalesce(abs(sog_change), 0) AS jump FROM er), vj AS (SELECT *, CAST(fr > 0.5 AS INT) + CAST(error > {A} AS INT) + CAST(jump > 2 AS INT) AS n_votes, concat_ws('+', CASE WHEN fr > 0.5 THEN 'freeze_replay' END, CASE WHEN error > {A} THEN 'prediction_error' END, CASE WHEN jump > 2 THEN 'speed_jump' END) AS votes FROM j)"


@query(f"WITH {JUMP} SELECT mmsi, window_index, event_id, votes, n_votes, CASE WHEN error > {A} AND error >= {B} THEN 'B' ELSE 'A' END AS tier FROM vj WHERE n_votes >= 2 AND {GATE} AND received_at > TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY mmsi, window_index ORDER BY n_votes DESC, error DESC, place DESC) = 1")
def flagged_after_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of reports after a time by at least two of three detectors."""
    voted = votes(with_error(_steps(spark, sf_dir)), A, jump=2.0)
    found = flagged(voted, B, min_votes=2, max_gap_s=MAX_GAP, cutoff=F.lit("2024-01-10").cast("timestamp_ntz"))
    return found.select("mmsi", F.col("window_index").cast("long").alias("window_index"), "event_id", "votes", "n_votes", "tier")


@query(f"WITH {STATS}, h AS (SELECT bin, sum(n) AS n FROM per GROUP BY bin), c AS (SELECT bin, n, ln(edges[bin + 1]) AS low, ln(edges[bin + 2]) AS high, sum(n) OVER (ORDER BY bin DESC) AS c, sum(n) OVER () AS total FROM h, ed) SELECT s AS share, round(exp(high - (s * total - (c - n)) / n * (high - low)), 6) AS threshold FROM c, (SELECT unnest([1e-2, 1e-3, 1e-4, 1e-5, 1e-6])::DOUBLE AS s) WHERE c > s * total QUALIFY row_number() OVER (PARTITION BY s ORDER BY bin DESC) = 1")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores that the usual shares of all stored reports pass."""
    whole = reports.merged_arrays(_stats(spark, sf_dir)).select(F.posexplode("histogram").alias("bin", "n")).where("n > 0")
    return reports.score_at_shares(whole, [1e-2, 1e-3, 1e-4, 1e-5, 1e-6]).select("share", _6("threshold"))


@query()
def cycles_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live steps of the sixth to tenth of the month as five cycles with a cap of 3, and what became of every flag."""
    steps = with_error(_steps(spark, sf_dir)).withColumns({"freeze": freeze_score(), "reason": F.when(F.col("place") == 0, "first").otherwise(skip_reason(MAX_GAP))})
    scored = written(steps.select("mmsi", F.col("received_at").cast("timestamp").alias("received_at"), "error", "freeze", "reason"), "scored")
    clock = iter(dt.datetime(2024, 1, d, tzinfo=dt.UTC) for d in range(7, 12))
    folder = f"{shared_folder(spark)}/cycles-{uuid.uuid4().hex}"
    run = Cycles(folder, lambda chosen: chosen.select("mmsi", "flagged_at"), lambda: Thresholds(A, B), most=3, clock=lambda: next(clock))
    for i, day in enumerate(range(6, 11)):
        run(scored.where(F.to_date("received_at") == F.lit(dt.date(2024, 1, day))), i)
    return spark.read.parquet(f"{folder}/decided").select(F.col("cycle").cast("long").alias("cycle"), "mmsi", "flagged_at", F.round("error", 6).alias("error"), "n_votes", "tier", "outcome")
