"""Queries of the classifier's report, of thresholds in force and of a vessel's state as of a time."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import classifier
from wakeline.operators.asof import as_of
from wakeline.plans.queries import INCIDENTS, LIVE, _6, _incidents, _live
from wakeline.plans.registry import query

LABELS = ["normal_track", "teleport_jump", "gradual_drift"]
NAMES = f"{LABELS}"
S = "(event_id % 7 + user_id % 5 + event_id * 3 % 11 + 3)"
RAW = "[event_id % 7 + 1, user_id % 5 + 1, event_id * 3 % 11 + 1]"
#: Every event as a judged window: probabilities from its ids, the right class certain to nine tenths.
ROWS = f"""e AS (SELECT event_id, user_id, {NAMES}[event_id % 3 + 1] AS gold, [x::DOUBLE / {S} FOR x IN {RAW}] AS p, [CASE WHEN i = event_id % 3 THEN 0.9::DOUBLE ELSE 0.05 END FOR i IN [0, 1, 2]] AS q FROM events),
c AS (SELECT *, {NAMES}[list_position(p, list_max(p))] AS choice, list_max(p) AS sure FROM e), r AS (SELECT *, (gold = choice)::INT AS hit FROM c)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    names = F.array(*map(F.lit, LABELS))
    raw = F.array(*(c.cast("double") for c in (i % 7 + 1, u % 5 + 1, i * 3 % 11 + 1)))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.get(names, (i % 3).cast("int")).alias("gold"), F.transform(raw, lambda x: x / (i % 7 + u % 5 + i * 3 % 11 + 3)).alias("p"), F.transform(F.array(*map(F.lit, range(3))), lambda k: F.when(k == i % 3, 0.9).otherwise(0.05)).alias("q"))
    return e.withColumn("choice", F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int")))


PAIRS = "list_zip(p, q)"


@query(
    f"WITH {ROWS} SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(list_sum([z[1] * z[2] FOR z IN {PAIRS}])), 6) AS soft_accuracy, round(avg(list_sum([pow(z[1] - z[2], 2) FOR z IN {PAIRS}])), 6) AS brier, round(avg(list_sum([z[2] * ln(z[2] / z[1]) FOR z IN {PAIRS}])), 6) AS kl, round(avg(list_sum([abs(z[1] - z[2]) FOR z IN {PAIRS}]) / 2), 6) AS tv FROM r"
)
def classifier_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classifier.overall(classifier.scored(_rows(spark, sf_dir)))
    return out.select("n", *(_6(c) for c in ("accuracy", "soft_accuracy", "brier", "kl", "tv")))


@query(f"WITH {ROWS} SELECT gold, {', '.join(f'''count(*) FILTER (WHERE choice = '{k}') AS {k}''' for k in LABELS)} FROM r GROUP BY gold")
def classifier_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.confusion_matrix(_rows(spark, sf_dir), LABELS)


@query(f"WITH {ROWS} SELECT gold, count(*) AS n, round(avg(hit), 6) AS accuracy FROM r GROUP BY gold")
def classifier_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.class_accuracy(_rows(spark, sf_dir), LABELS).select("gold", "n", _6("accuracy"))


@query(f"WITH {ROWS} SELECT round(avg((choice <> 'normal_track')::INT) FILTER (WHERE gold = 'normal_track'), 6) AS false_positive_rate, round(avg((choice = 'normal_track')::INT) FILTER (WHERE gold <> 'normal_track'), 6) AS miss_rate FROM r")
def classifier_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.error_rates(_rows(spark, sf_dir), "normal_track").select(_6("false_positive_rate"), _6("miss_rate"))


@query(f"WITH {ROWS} SELECT t AS min_confidence, round(avg((sure >= t)::INT), 6) AS coverage, round(avg(hit) FILTER (WHERE sure >= t), 6) AS accuracy FROM r, (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.99])::DOUBLE AS t) GROUP BY t")
def classifier_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classifier.by_confidence(classifier.scored(_rows(spark, sf_dir)), [0.4, 0.5, 0.6, 0.7, 0.99])
    return out.select("min_confidence", _6("coverage"), _6("accuracy"))


BINNED = "b AS (SELECT least(greatest(ceil(sure * 10) - 1, 0), 9)::INT AS bin, count(*) AS n, avg(sure) AS sure, avg(hit) AS accuracy FROM (SELECT * REPLACE (list_max([x / list_sum(p) FOR x IN p]) AS sure) FROM r) GROUP BY 1)"


@query(f"WITH {ROWS}, {BINNED} SELECT bin, n, round(sure, 6) AS sure, round(accuracy, 6) AS accuracy FROM b")
def classifier_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.calibration(classifier.scored(_rows(spark, sf_dir))).select("bin", "n", _6("sure"), _6("accuracy"))


@query(f"WITH {ROWS}, {BINNED} SELECT round(sum(n * abs(sure - accuracy)) / sum(n), 6) AS ece FROM b")
def classifier_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.calibration_error(classifier.scored(_rows(spark, sf_dir))).select(_6("ece"))


@query(f"WITH {ROWS} SELECT gold, CASE WHEN user_id % 3 * 0.6 < 1 AND event_id % 5 * 0.03 < 0.1 THEN 'stationary' ELSE 'moving' END AS motion, count(*) AS n, round(avg(hit), 6) AS accuracy FROM r GROUP BY ALL")
def classifier_by_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumns({"fastest": F.col("user_id") % 3 * 0.6, "longest": F.col("event_id") % 5 * 0.03})
    return classifier.by_motion(rows).select("gold", "motion", "n", _6("accuracy"))


SET = "th AS (SELECT event_id AS id, ts AS set_at, value / 100 AS a FROM events WHERE event_type = 'signup')"


@query(f"WITH {INCIDENTS}, {SET} SELECT incident_id, id AS threshold_id, round(a, 6) AS a, inc.score > a AS above FROM inc LEFT JOIN th ON set_at <= flagged_at QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY set_at DESC, id DESC) = 1")
def thresholds_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flag with the thresholds that were in force at its time; a historical report stands for setting them."""
    sets = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("set_at"), (F.col("value") / 100).alias("a"))
    met = as_of(_incidents(spark, sf_dir), sets, "flagged_at", "set_at", "id")
    return met.select("incident_id", F.col("state.id").alias("threshold_id"), F.round("state.a", 6).alias("a"), (F.col("score") > F.col("state.a")).alias("above"))


@query(f"WITH {LIVE}, s AS (SELECT * FROM live WHERE message_type = 'purchase') SELECT l.event_id, s.event_id AS last_purchase FROM (SELECT * FROM live WHERE message_type <> 'purchase') l LEFT JOIN s ON s.mmsi = l.mmsi AND s.received_at <= l.received_at QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY s.received_at DESC, s.event_id DESC) = 1")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report with its vessel's last one of another kind before it."""
    live = _live(spark, sf_dir)
    kind = F.col("message_type") == "purchase"
    states = live.where(kind).select("mmsi", F.col("event_id").alias("state_id"), F.col("received_at").alias("since"))
    return as_of(live.where(~kind).select("mmsi", "event_id", "received_at"), states, "received_at", "since", "state_id", ("mmsi",)).select("event_id", F.col("state.state_id").alias("last_purchase"))
