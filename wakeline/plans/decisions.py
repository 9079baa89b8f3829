"""Queries of decision rules, report checks, tracks of incidents and training rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import console, reports, rules
from wakeline.operators.predictors import step_errors
from wakeline.operators.windows import revisited
from wakeline.plans.queries import BIN, EDGES_SQL, ERRORS, INCIDENTS, LIVE, NEWEST, ORDERS, WINDOWS, _incidents, _live, _orders, _steps
from wakeline.plans.queries import KM as INC_KM
from wakeline.plans.registry import query
from wakeline.settings import A_RANGE, B_OVER_A, OPERATING_THRESHOLD

PROPOSED = "p AS (SELECT incident_id, score / 5e4 AS a, score / 5e4 * (1 + incident_id % 5 * 0.4) AS b, incident_id % 9 * 10000 AS reports, 1.0::DOUBLE AS now_a, 2.0::DOUBLE AS now_b, incident_id % 4 = 0 AS new_model, CASE WHEN incident_id % 6 = 0 THEN score / 5e4 * 1.005 ELSE 50.0 END AS seen FROM o)"


@query(
    f"WITH {ORDERS}, {PROPOSED} SELECT incident_id, CASE WHEN NOT (a BETWEEN {A_RANGE[0]} AND {A_RANGE[1]} AND b BETWEEN a * {B_OVER_A} AND 100) THEN 'out_of_range' WHEN reports < 50000 AND NOT abs(a - seen) / seen < 0.01 THEN 'too_few_reports' "
    "WHEN NOT new_model AND NOT a BETWEEN now_a / 3 AND now_a * 3 THEN 'step_too_wide' WHEN NOT new_model AND abs(a - now_a) / now_a < 0.25 AND abs(b - now_b) / now_b < 0.25 THEN 'keep' ELSE 'update' END AS decision FROM p"
)
def threshold_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, a = F.col("incident_id"), F.col("score") / 5e4
    p = _orders(spark, sf_dir).select(i, a.alias("a"), (a * (1 + i % 5 * 0.4)).alias("b"), (i % 9 * 10000).alias("reports"), F.lit(1.0).alias("now_a"), F.lit(2.0).alias("now_b"), (i % 4 == 0).alias("new_model"), F.array(F.when(i % 6 == 0, a * 1.005).otherwise(50.0)).alias("offline"))
    return rules.threshold_decision(p).select("incident_id", "decision")


@query(f"SELECT event_type AS version, {BIN.format(x='value / 100')} AS bin, count(*) AS n FROM events, (SELECT {EDGES_SQL} AS edges) GROUP BY ALL")
def histogram_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram for each version of a model; versions compare with nulls as equal in a grouping."""
    return reports.log_histogram_by(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value") / 100, F.col("event_type").alias("version"))


@query("SELECT round(quantile_cont(value, 0.99), 6) AS threshold FROM events")
def threshold_for_flag_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score that one in a hundred passes."""
    return reports.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", [1 - 0.01]).select(F.round("value", 6).alias("threshold"))


TEXT = "'MMSI ' || CASE WHEN incident_id % 7 = 0 THEN 'none' ELSE mmsi::VARCHAR END || ' shows ' || CASE WHEN incident_id % 5 = 0 THEN 'nothing' ELSE 'freeze replay' END || CASE WHEN incident_id % 3 = 0 THEN ' (OPEN)' ELSE '' END || ' at ' || (incident_id % 4 + 79) || ' %' || CASE WHEN incident_id % 11 = 0 THEN ', confirmed gps spoofing' ELSE '' END"


@query(
    f"WITH {ORDERS}, t AS (SELECT *, {TEXT} AS txt FROM o) SELECT incident_id, concat_ws(',', CASE WHEN NOT contains(txt, mmsi::VARCHAR) THEN 'mmsi' END, CASE WHEN incident_id % 5 = 0 THEN 'hypothesis' END, CASE WHEN incident_id % 3 = 0 THEN 'status_open' END, CASE WHEN incident_id % 4 = 3 THEN 'confidence' END, CASE WHEN incident_id % 11 = 0 AND status <> 'F' THEN 'confirmed' END) AS issues FROM t"
)
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).withColumn("txt", F.expr(TEXT.replace("::VARCHAR", "::string")))
    found = rules.report_issues(F.col("txt"), F.col("mmsi"), F.lit("freeze_replay"), F.lit(0.8), F.when(F.col("status") == "F", "confirmed_spoof"))
    return o.select("incident_id", F.array_join(found, ",").alias("issues"))


@query(f"WITH {ORDERS} SELECT incident_id, CASE WHEN incident_id % 10 < 7 THEN NULL WHEN incident_id % 3 = 0 THEN 'contradicts' WHEN incident_id % 3 = 1 AND incident_id % 2 = 0 THEN 'agrees' WHEN incident_id % 3 = 2 AND incident_id % 2 = 1 THEN 'agrees' END AS vote FROM o")
def classifier_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("incident_id")
    label = F.when(i % 3 == 0, "normal_track").when(i % 3 == 1, "freeze_replay").otherwise("gradual_drift")
    claim = F.when(i % 2 == 0, "freeze_replay").otherwise("targeted_spoof")
    return _orders(spark, sf_dir).select("incident_id", rules.pattern_vote(label, i % 10 / 10, claim).alias("vote"))


AB = INC_KM.format(a="a.", b="b.")
#: Each incident's nearby incidents (newest 20 of six hours) with itself, those of an hour, and the cluster of 2 km and three vessels that holds it.
SCOPE = f"""{NEWEST.format(km=INC_KM.format(a='inc.', b='live.'))},
around AS (SELECT a.incident_id AS bucket, b.mmsi, b.t, b.t - a.t AS off, b.lat, b.lon, b.incident_id AS oid FROM inc a JOIN inc b ON a.mmsi <> b.mmsi AND abs(a.t - b.t) <= 21600 AND {AB} <= 5 QUALIFY row_number() OVER (PARTITION BY a.incident_id ORDER BY b.flagged_at DESC, b.incident_id DESC) <= 20),
pts AS (SELECT bucket, mmsi, t, lat, lon, oid FROM around WHERE abs(off) <= 3600 UNION ALL SELECT incident_id, mmsi, t, lat, lon, incident_id FROM inc),
p AS (SELECT bucket, mmsi, arg_max(lat, (t, -oid)) AS lat, arg_max(lon, (t, -oid)) AS lon FROM pts GROUP BY ALL),
close AS (SELECT a.bucket, a.mmsi AS a, b.mmsi AS b FROM p a JOIN p b ON a.bucket = b.bucket AND {AB} <= 2),
core AS (SELECT bucket, a FROM close GROUP BY ALL HAVING count(*) >= 3), link AS (SELECT close.* FROM close JOIN core USING (bucket, a)),
r AS (SELECT bucket, a, a AS l FROM core UNION SELECT r.bucket, link.b, r.l FROM r JOIN link ON link.bucket = r.bucket AND link.a = r.a JOIN core ON core.bucket = r.bucket AND core.a = link.b),
own AS (SELECT bucket, a, min(l) AS cluster FROM r GROUP BY ALL),
m AS (SELECT link.bucket, b AS mmsi, coalesce(min(cluster) FILTER (WHERE link.a = b), min(cluster)) AS cluster FROM link JOIN own USING (bucket, a) GROUP BY ALL),
size AS (SELECT bucket, cluster, count(*) AS n FROM m GROUP BY ALL), cl AS (SELECT inc.incident_id, n FROM inc JOIN m ON m.bucket = incident_id AND m.mmsi = inc.mmsi JOIN size USING (bucket, cluster))"""


@query(
    f"WITH RECURSIVE {INCIDENTS}, {SCOPE}, k AS (SELECT incident_id, count(*) AS neighbours, array_to_string(list_slice(list(printf('%.1f', round(km, 1)) ORDER BY km), 1, 5), ',') AS nearest FROM newest GROUP BY 1), i AS (SELECT bucket AS incident_id, count(*) AS incidents FROM around GROUP BY 1) "
    "SELECT incident_id, coalesce(neighbours, 0) AS neighbours, nearest, coalesce(incidents, 0) AS incidents, coalesce(n, 1) AS cluster_vessels, CASE WHEN coalesce(n, 1) >= 3 THEN 'area' WHEN coalesce(neighbours, 0) >= 3 THEN 'isolated' ELSE 'insufficient' END AS scope FROM inc LEFT JOIN k USING (incident_id) LEFT JOIN i USING (incident_id) LEFT JOIN cl USING (incident_id)"
)
def incident_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours and their five nearest km, nearby incidents, and the cluster that holds the flag among those of an hour."""
    return console.scopes(_incidents(spark, sf_dir), _live(spark, sf_dir), km=5, cluster_km=2)


@query(
    f"WITH {WINDOWS}, r AS (SELECT *, round(lat, 5) AS y, round(lon, 5) AS x FROM st), f AS (SELECT *, min(place) OVER (PARTITION BY mmsi, window_index, y, x) AS first_at, lag(y) OVER w IS NOT DISTINCT FROM y AND lag(x) OVER w IS NOT DISTINCT FROM x AS stays FROM r WINDOW w AS (PARTITION BY mmsi, window_index ORDER BY received_at, event_id)) "
    "SELECT mmsi, window_index, count(*) FILTER (WHERE first_at < place - 1 AND NOT stays) AS n FROM f GROUP BY ALL"
)
def revisited_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisited(_steps(spark, sf_dir), "mmsi", "window_index").groupBy("mmsi", F.col("window_index").cast("long").alias("window_index")).agg(F.count_if("revisited").alias("n"))


@query(
    f"WITH {WINDOWS} SELECT event_id, round(coalesce(sog, -1), 6) AS sog, coalesce(cog, -1) AS cog, coalesce(heading, -1)::DOUBLE AS heading, -1.0::DOUBLE AS rate_of_turn, coalesce(c_nationkey, -1)::DOUBLE AS vessel_class, round(implied, 6) AS implied, (heading IS NULL)::INT AS heading_missing, 1 AS rot_missing FROM st LEFT JOIN customer ON c_custkey = mmsi"
)
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight features of each report of a window; the events tell no rate of turn."""
    kinds = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("mmsi"), F.col("c_nationkey").alias("ship_type"))
    or_none = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
    return _steps(spark, sf_dir).join(kinds, "mmsi", "left").select("event_id", F.round(or_none("sog"), 6).alias("sog"), or_none("cog").alias("cog"), or_none("heading").alias("heading"), F.lit(-1.0).alias("rate_of_turn"), or_none("ship_type").alias("vessel_class"), F.round("implied", 6).alias("implied"), F.isnull("heading").cast("int").alias("heading_missing"), F.lit(1).alias("rot_missing"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("mmsi"), F.col("c_nationkey").alias("vessel_class"))
    return _steps(spark, sf_dir).join(kinds, "mmsi", "left").withColumns({"rate_of_turn": F.lit(None).cast("double"), "heading_missing": F.isnull("heading").cast("int"), "rot_missing": F.lit(1)})


@query(f"WITH {ERRORS} SELECT event_id, window_index, place, round(error, 6) AS error, error > {OPERATING_THRESHOLD} AS flagged FROM er")
def predicted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report's distance from the step that the predictor expected: the one before, again."""
    found = step_errors(_features(spark, sf_dir))
    return found.select("event_id", "window_index", "place", F.round("error", 6).alias("error"), (F.col("error") > OPERATING_THRESHOLD).alias("flagged"))


TOLD = "(sog / 0.539956803::DOUBLE * gap / 3600 / 111.195::DOUBLE)"


@query(
    f"WITH {WINDOWS}, n AS (SELECT *, lead(event_id) OVER w AS next_id, lead(t) OVER w - t AS gap, lead(lat) OVER w - lat AS up, lead(lon) OVER w - lon AS off FROM st WINDOW w AS (PARTITION BY mmsi, window_index ORDER BY received_at, event_id)) "
    f"SELECT next_id AS event_id, round(coalesce(sqrt(pow({TOLD} * cos(radians(cog)) - up, 2) + pow({TOLD} * sin(radians(cog)) / cos(radians(lat)) - off, 2)), 0), 5) AS error FROM n WHERE next_id IS NOT NULL"
)
def steps_from_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with another predictor: where speed and course lead."""
    return step_errors(_features(spark, sf_dir), "told_course").where("place > 0").select("event_id", F.round("error", 5).alias("error"))


@query(f"WITH {LIVE}, c AS (SELECT min(received_at) AS first_at, max(received_at) AS last_at FROM live) SELECT hours, last_at >= first_at + INTERVAL 14 DAY AND hours >= 360 AS initial_ready, first_at + INTERVAL 14 DAY AS initial_end, first_at <= last_at - INTERVAL 14 DAY AS rolling_ready, last_at - INTERVAL 14 DAY AS rolling_start FROM c, (SELECT unnest([359, 360]) AS hours)")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First complete two weeks and the last ones, as of two times: on the second the fifteenth day is over."""
    c = _live(spark, sf_dir).agg(F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))
    early, late = (rules.training_windows(c, F.col("first_at") + F.expr(f"interval {h} hours")).withColumn("hours", F.lit(h)) for h in (359, 360))
    return early.unionByName(late)


@query("SELECT event_id, user_id || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END AS window_id FROM events")
def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format("ts", ".SSSSSS")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), whole, F.when(micro == ".000000", "").otherwise(micro)).alias("window_id"))


@query(f"WITH {ORDERS} SELECT mmsi, count(DISTINCT incident_id % 2) > 1 AS in_both FROM o GROUP BY mmsi")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels whose rows stand in more than one split."""
    return _orders(spark, sf_dir).groupBy("mmsi").agg((F.count_distinct(F.col("incident_id") % 2) > 1).alias("in_both"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 25)")
def first_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of the first 25 vessels: the sampling cap of a training run."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return e.join(e.select("user_id").distinct().orderBy("user_id").limit(25), "user_id", "left_semi")


P = "p AS (SELECT event_id, event_id % 3 AS gold, [(event_id % 7 + 1) / s, (user_id % 5 + 1) / s, (event_id * 3 % 11 + 1) / s] AS p FROM (SELECT *, (event_id % 7 + user_id % 5 + event_id * 3 % 11 + 3)::DOUBLE AS s FROM events))"


@query(f"WITH {P}, q AS (SELECT *, list_max(p) AS top, list_position(p, list_max(p)) - 1 = gold AS hit, list_sum(list_transform([0, 1, 2], lambda k: pow(p[k + 1] - (k = gold)::INT, 2))) AS brier FROM p) SELECT gold::BIGINT AS gold, count(*) AS n, round(avg(hit::INT), 6) AS accuracy, round(avg(brier), 6) AS brier, round(avg(p[gold + 1]), 6) AS soft_accuracy, round(avg((top >= 0.6)::INT), 6) AS coverage, round(avg(hit::INT) FILTER (WHERE top >= 0.6), 6) AS sure_accuracy FROM q GROUP BY gold")
def classifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each class: accuracy (first of equals), Brier score, mass on the right class, and accuracy where the classifier is sure."""
    i, u = F.col("event_id"), F.col("user_id")
    raw = F.array(*(c.cast("double") for c in (i % 7 + 1, u % 5 + 1, i * 3 % 11 + 1)))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((i % 3).alias("gold"), F.transform(raw, lambda x: x / (i % 7 + u % 5 + i * 3 % 11 + 3)).alias("p"))
    return reports.classifier_report(e, 0.6)
