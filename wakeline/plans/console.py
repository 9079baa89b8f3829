"""Queries of the console, of cycles and of rows to learn from."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.cleaning import not_told
from wakeline.functions.geo import ewkt
from wakeline.operators import console, evidence, investigate, reports, rules, texts
from wakeline.operators.detectors import flagged, votes
from wakeline.operators.windows import first_of, recent_reports, with_error
from wakeline.plans.queries import GATE, IN_ZONE, INCIDENTS, KM, LIVE, MAX_GAP, ORDERS, POS, STEPS, VOTED, WINDOWS, ZONES, A, B, _incidents, _live, _orders, _steps, _zones
from wakeline.plans.registry import query
from wakeline.settings import A_RANGE, B_OVER_A
from wakeline.sources.files import with_row_id
from wakeline.sources.tracks import positions


@query(f"WITH {ORDERS} SELECT incident_id, mmsi, flagged_at FROM o WHERE status = 'O' AND kind = '2-HIGH' AND flagged_at < TIMESTAMP '1997-01-01' ORDER BY flagged_at DESC, incident_id DESC LIMIT 100")
def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.incident_list(_orders(spark, sf_dir), 100, status="O", kind="2-HIGH", before="1997-01-01").select("incident_id", "mmsi", "flagged_at")


@query(f"WITH {ORDERS} SELECT o.*, c_name AS name, c_nationkey AS ship_type FROM o LEFT JOIN customer ON c_custkey = mmsi WHERE incident_id = 3")
def incident_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("mmsi"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("ship_type"))
    return console.incident_by_id(_orders(spark, sf_dir), 3).join(kinds, "mmsi", "left")


@query(f"WITH {POS} SELECT event_id, received_at, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pos WHERE mmsi = 5 AND message_type <> 'signup' AND received_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25' ORDER BY received_at, event_id LIMIT 5000")
def vessel_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.vessel_track(positions(spark, sf_dir), 5, "2024-01-25", "2024-01-02").select("event_id", "received_at", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"WITH {INCIDENTS}, s AS (SELECT *, CASE WHEN incident_id % 3 = 0 THEN t - 172800 ELSE t - 7200 END AS s FROM inc) SELECT incident_id, event_id, row_number() OVER w AS place FROM s JOIN live ON live.mmsi = s.mmsi AND live.t BETWEEN s.s AND s.t WINDOW w AS (PARTITION BY incident_id ORDER BY received_at, event_id) QUALIFY row_number() OVER w <= 2000")
def incident_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = _incidents(spark, sf_dir).withColumn("window_start", F.when(F.col("incident_id") % 3 == 0, F.col("flagged_at") - F.expr("interval 48 hours")))
    return console.incident_points(inc, positions(spark, sf_dir)).select("incident_id", "event_id", "place")


@query(f"WITH {INCIDENTS} SELECT incident_id, count(event_id) AS n_positions, arg_min(event_id, (received_at, event_id)) AS first_event, arg_max(event_id, (received_at, event_id)) AS last_event FROM inc LEFT JOIN pos ON pos.mmsi = inc.mmsi AND pos.t BETWEEN inc.t - 86400 AND inc.t GROUP BY incident_id")
def incident_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.cards(_incidents(spark, sf_dir), positions(spark, sf_dir)).select("incident_id", "n_positions", "first_event", "last_event")


NEAR_KM = KM.format(a="a.", b="b.")


@query(f"WITH {INCIDENTS} SELECT a.incident_id, b.incident_id AS other_id, round({NEAR_KM}, 6) AS km, row_number() OVER w AS place FROM inc a JOIN inc b ON a.mmsi <> b.mmsi AND abs(a.t - b.t) <= 21600 AND {NEAR_KM} <= 5 WINDOW w AS (PARTITION BY a.incident_id ORDER BY b.flagged_at DESC, b.incident_id DESC) QUALIFY row_number() OVER w <= 20")
def nearby_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.nearby_incidents(_incidents(spark, sf_dir), 5).withColumn("km", F.round("km", 6))


@query(f"WITH {VOTED} SELECT received_at::DATE AS cycle, count(*) AS reports, count(*) FILTER (WHERE {GATE}) AS scored, count(*) FILTER (WHERE place > 0 AND NOT ({GATE})) AS skipped, count(*) FILTER (WHERE {GATE} AND error > {A}) AS above_a, count(*) FILTER (WHERE {GATE} AND error >= {B}) AS above_b, count(DISTINCT mmsi) AS vessels FROM vo GROUP BY 1")
def cycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.cycle_counts(votes(with_error(_steps(spark, sf_dir)), A), F.to_date("received_at"), A, B, MAX_GAP)


@query(
    f"WITH {INCIDENTS}, {ZONES}, z AS (SELECT incident_id, min(zone_id) AS zone_id FROM inc LEFT JOIN zone ON {IN_ZONE} GROUP BY incident_id), "
    "p AS (SELECT inc.*, zone_id, row_number() OVER (PARTITION BY mmsi ORDER BY flagged_at, inc.incident_id) - 1 AS n_prior, CASE WHEN incident_id % 10 >= 7 THEN CASE incident_id % 4 WHEN 0 THEN 'normal_track' WHEN 1 THEN 'freeze_replay' WHEN 2 THEN 'gradual_drift' END END AS said FROM inc JOIN z USING (incident_id)), "
    "h AS (SELECT *, CASE WHEN zone_id IS NOT NULL THEN 'jamming' WHEN score < 2 AND incident_id % 2 = 1 THEN 'benign' WHEN incident_id % 5 >= 3 THEN 'freeze_replay' WHEN incident_id % 2 = 1 AND score <= 4 AND incident_id % 3 = 0 AND coalesce(said, 'normal_track') = 'normal_track' THEN 'benign' WHEN n_prior = 0 THEN 'targeted_spoof' ELSE 'equipment_fault' END AS hypothesis FROM p), "
    "v AS (SELECT *, said = 'normal_track' AND hypothesis <> 'freeze_replay' AS against, (hypothesis = 'freeze_replay' AND said = 'freeze_replay') OR (hypothesis = 'targeted_spoof' AND said = 'gradual_drift') AS agrees FROM h) "
    "SELECT incident_id, hypothesis, (CASE hypothesis WHEN 'jamming' THEN 0.85 WHEN 'benign' THEN 0.75 ELSE CASE WHEN coalesce(against, false) OR (incident_id % 2 = 1 AND NOT coalesce(agrees, false)) THEN 0.5 WHEN hypothesis = 'freeze_replay' THEN 0.8 WHEN hypothesis = 'targeted_spoof' THEN 0.72 ELSE 0.55 END END)::DOUBLE AS confidence FROM v"
)
def hypothesis_with_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("incident_id")
    known = evidence.prior_incidents(evidence.in_rectangles(_incidents(spark, sf_dir), _zones(spark)))
    known = known.withColumns({"votes": F.when(i % 2 == 1, "prediction_error").otherwise("freeze_replay+prediction_error"), "n_freeze": i % 5, "stationary": i % 3 == 0})
    label = F.when(i % 4 == 0, "normal_track").when(i % 4 == 1, "freeze_replay").when(i % 4 == 2, "gradual_drift")
    return rules.hypothesis(known, 2.0, label, i % 10 / 10).select("incident_id", "hypothesis", "confidence")


SCORES = "q AS (SELECT incident_id, CASE WHEN incident_id % 7 > 0 THEN score / 5e4 END AS score_a, score / 5e4 * (1 + incident_id % 5 * 0.4) AS score_b, incident_id % 9 * 10000 AS reports, CASE WHEN incident_id % 8 > 0 THEN 1.0::DOUBLE END AS now_a, incident_id % 4 = 0 AS new_model FROM o)"


@query(
    f"WITH {ORDERS}, {SCORES}, b AS (SELECT *, greatest({A_RANGE[0]}, least({A_RANGE[1]}, score_a)) AS x FROM q), c AS (SELECT *, CASE WHEN now_a IS NULL OR new_model THEN x ELSE greatest(now_a / 3, least(now_a * 3, x)) END AS y, reports >= 50000 AND score_a IS NOT NULL AS moves FROM b) "
    f"SELECT incident_id, CASE WHEN moves THEN 'update' ELSE 'keep' END AS action, CASE WHEN moves THEN round(y, 6) END AS a, CASE WHEN moves THEN round(greatest(score_b, x * {B_OVER_A}, y * {B_OVER_A}), 6) END AS b FROM c"
)
def budget_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("incident_id"), F.col("score") / 5e4
    q = _orders(spark, sf_dir).select(i, F.when(i % 7 > 0, s).alias("score_a"), (s * (1 + i % 5 * 0.4)).alias("score_b"), (i % 9 * 10000).alias("reports"), F.when(i % 8 > 0, 1.0).alias("now_a"), (i % 4 == 0).alias("new_model"))
    return rules.budget_proposal(q).select("incident_id", "action", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("SELECT event_id AS id, CASE WHEN user_id % 5 = 0 THEN 'holdout' ELSE 'train' END AS split, user_id AS mmsi, nullif(event_type, 'view') AS pattern, '{\"pattern\":{\"label\":\"' || event_type || '\",\"probabilities\":{' || array_to_string(['\"' || k || '\":' || CASE WHEN k = event_type THEN '1.0' ELSE '0.0' END for k in ['click', 'error', 'view']], ',') || '}}}' AS gold FROM events WHERE event_type IN ('click', 'error', 'view')")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 == 0, "holdout").otherwise("train").alias("split"), F.col("user_id").alias("mmsi"), F.col("event_type").alias("label"))
    return console.training_rows(e, ["click", "error", "view"], "view", "pattern")


@query(f"WITH {ORDERS} SELECT incident_id, sha256(mmsi || '|' || strftime(flagged_at, '%Y-%m-%d')) AS id, map_extract_value(MAP {{'scope': status}}, 'scope') AS scope FROM o")
def incident_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that follow from vessel and time, and evidence with an entry replaced."""
    o = with_row_id(_orders(spark, sf_dir).withColumn("day", F.date_format("flagged_at", "yyyy-MM-dd")), "mmsi", "day").withColumn("evidence", F.create_map(F.lit("scope"), F.lit("unknown")))
    return console.with_evidence(o, "scope", F.col("status")).select("incident_id", "id", F.col("evidence")["scope"].alias("scope"))


BACK = STEPS.replace("l0", "l1").replace("st0", "sx0").replace(" st AS", " sx AS")
#: Flagged windows as incidents, and each one's last 20 reports of a week with their steps.
FLAGS = (
    f"{VOTED}, fl AS (SELECT mmsi, event_id AS incident_id, received_at AS flagged_at, t, lat, lon, error AS score, votes FROM vo WHERE n_votes >= 1 AND {GATE} QUALIFY row_number() OVER (PARTITION BY mmsi, window_index ORDER BY n_votes DESC, error DESC, place DESC) = 1), "
    "tr AS (SELECT fl.incident_id, live.* FROM fl JOIN live ON live.mmsi = fl.mmsi AND live.t BETWEEN fl.t - 7 * 86400 AND fl.t QUALIFY row_number() OVER (PARTITION BY fl.incident_id ORDER BY live.received_at DESC, live.event_id DESC) <= 20), "
    f"{BACK.format(src='tr', key='incident_id')}, fz AS (SELECT incident_id, count(*) AS n_track, count(*) FILTER (WHERE gap_s > 0 AND implied BETWEEN 0 AND 0.5 AND sog > 0.5) AS n_freeze, coalesce(count(sog) >= 10 AND median(sog) <= 0.5, false) AS stationary FROM sx GROUP BY 1)"
)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flagged(votes(with_error(_steps(spark, sf_dir)), A), B, max_gap_s=MAX_GAP)
    return found.select(F.col("event_id").alias("incident_id"), "mmsi", F.col("received_at").alias("flagged_at"), "lat", "lon", F.col("error").alias("score"), "votes")


@query(f"WITH {FLAGS} SELECT incident_id, n_track, n_freeze, stationary FROM fl JOIN fz USING (incident_id)")
def track_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last 20 reports before each flagged window's report show."""
    return investigate.track_evidence(_flags(spark, sf_dir), _live(spark, sf_dir), hours=7 * 24)


@query(
    f"WITH {FLAGS}, {ZONES}, z AS (SELECT incident_id, min(zone_id) AS zone_id FROM fl LEFT JOIN zone ON {IN_ZONE} GROUP BY incident_id), "
    "k AS (SELECT fl.*, zone_id, n_freeze, stationary, row_number() OVER (PARTITION BY mmsi ORDER BY flagged_at, fl.incident_id) - 1 AS n_prior FROM fl JOIN z USING (incident_id) JOIN fz USING (incident_id)), "
    f"h AS (SELECT *, CASE WHEN zone_id IS NOT NULL THEN 'jamming' WHEN score < {A} AND votes IN ('', 'prediction_error') THEN 'benign' WHEN n_freeze >= 3 THEN 'freeze_replay' WHEN votes = 'prediction_error' AND score <= 2 * {A} AND stationary THEN 'benign' WHEN n_prior = 0 THEN 'targeted_spoof' ELSE 'equipment_fault' END AS hypothesis FROM k), "
    "c AS (SELECT *, (CASE WHEN hypothesis = 'jamming' THEN 0.85 WHEN hypothesis = 'benign' THEN 0.75 WHEN NOT contains(votes, '+') THEN 0.5 WHEN hypothesis = 'freeze_replay' THEN 0.8 WHEN hypothesis = 'targeted_spoof' THEN 0.72 ELSE 0.55 END)::DOUBLE AS confidence FROM h) "
    "SELECT incident_id, zone_id, n_prior, n_freeze, stationary, hypothesis, confidence, CASE WHEN confidence >= 0.7 THEN 'reported' ELSE 'escalated' END AS status FROM c"
)
def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged windows investigated on their own evidence: zone, earlier flags, and the track before the flag."""
    found = investigate.investigate(_flags(spark, sf_dir), _live(spark, sf_dir), _zones(spark), A, hours=7 * 24)
    return found.select("incident_id", "zone_id", "n_prior", "n_freeze", "stationary", "hypothesis", "confidence", "status")


@query(f"WITH {INCIDENTS} SELECT epoch(TIMESTAMP '2024-02-01') - (SELECT max(t) FROM live) AS report_age_s, epoch(TIMESTAMP '2024-02-01') - (SELECT max(t) FROM inc) AS incident_age_s")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of the newest report and the newest incident, as of a time."""
    return console.health(_live(spark, sf_dir), _incidents(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))


@query(f"WITH {ORDERS} SELECT incident_id, mmsi, flagged_at, CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM o WHERE kind = '2-HIGH' AND flagged_at < TIMESTAMP '1996-01-01' LIMIT 51)) > 50 THEN min(flagged_at) OVER () END AS next_before FROM (SELECT * FROM o WHERE kind = '2-HIGH' AND flagged_at < TIMESTAMP '1996-01-01' ORDER BY flagged_at DESC, incident_id DESC LIMIT 50)")
def incident_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 and the time at which the next one starts; null on the last."""
    return console.incident_page(_orders(spark, sf_dir), 50, kind="2-HIGH", before="1996-01-01").select("incident_id", "mmsi", "flagged_at", "next_before")


@query(f"WITH {ORDERS}, n AS (SELECT kind, status, count(*) AS n FROM o WHERE status <> 'O' GROUP BY ALL) SELECT kind AS tier, coalesce(sum(n) FILTER (WHERE status = 'F'), 0)::BIGINT AS confirmed, coalesce(sum(n) FILTER (WHERE status = 'P'), 0)::BIGINT AS unclear, (SELECT sum(n) FROM n)::BIGINT AS reviewed_total, CASE WHEN (SELECT sum(n) FROM n) < 30 THEN 'too few' ELSE 'enough' END AS trust FROM n GROUP BY kind")
def analyst_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of each tier, how many there are in all, and whether that is enough to go by."""
    o = _orders(spark, sf_dir).where("status <> 'O'").select(F.col("kind").alias("tier"), F.when(F.col("status") == "F", "confirmed").otherwise("unclear").alias("verdict"))
    return console.verdicts(o, ["confirmed", "unclear"])


@query(f"WITH {LIVE} SELECT event_id, 'SRID=4326;POINT(' || printf('%.6f', lon) || ' ' || printf('%.6f', lat) || ')' AS ewkt, nullif(coalesce(sog, -1), -1) AS sog, sha256(props) AS digest FROM live")
def rendered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as text of a geometry, missing values as null, and the digest of what came with them."""
    return _live(spark, sf_dir).select("event_id", ewkt(F.col("lat"), F.col("lon"), 6).alias("ewkt"), not_told(F.coalesce("sog", F.lit(-1.0))).alias("sog"), F.sha2("props", 256).alias("digest"))


NUMBERS = (
    f"{WINDOWS}, nu AS (SELECT *, implied <> -1 AS ok, implied <> -1 AND sog IS NOT NULL AS told, coalesce(implied <> -1 AND implied <= 0.5 AND sog > 0.5, false) AS claim, lag(cog) OVER w AS pcog, round(lat, 5) AS y, round(lon, 5) AS x FROM st WINDOW w AS (PARTITION BY mmsi, window_index ORDER BY received_at, event_id)), "
    "nv AS (SELECT *, min(place) OVER (PARTITION BY mmsi, window_index, y, x) < place - 1 AND NOT (lag(y) OVER w IS NOT DISTINCT FROM y AND lag(x) OVER w IS NOT DISTINCT FROM x) AS again, sum((NOT claim)::INT) OVER w AS island, sum(told::INT) OVER w - 1 AS i, sum(told::INT) OVER (PARTITION BY mmsi, window_index) AS m FROM nu WINDOW w AS (PARTITION BY mmsi, window_index ORDER BY received_at, event_id)), "
    "nw AS (SELECT *, count(*) FILTER (WHERE claim) OVER (PARTITION BY mmsi, window_index, island) AS run, implied - sog AS d FROM nv), "
    "nn AS (SELECT mmsi, window_index, count(*) AS n, (max(t) - min(t)) / 60 AS span, coalesce(avg(sog), 0) AS mean_sog, coalesce(max(sog), 0) AS max_sog, coalesce(avg(implied) FILTER (WHERE ok), 0) AS mean_implied, coalesce(max(implied) FILTER (WHERE ok), 0) AS max_implied, coalesce(max(step_km) FILTER (WHERE ok), 0) AS max_step, count(*) FILTER (WHERE claim) AS claims, max(run) AS longest, count(*) FILTER (WHERE again) AS again, "
    "coalesce(max(least(abs(cog - pcog) % 360, 360 - abs(cog - pcog) % 360)) FILTER (WHERE ok), 0) AS turn, coalesce(max(least(abs(cog - step_bearing) % 360, 360 - abs(cog - step_bearing) % 360)) FILTER (WHERE implied > 1), 0) AS off, coalesce(avg(d) FILTER (WHERE told AND i >= m - greatest(1, m // 3)) - avg(d) FILTER (WHERE told AND i < greatest(1, m // 3)), 0) AS trend FROM nw GROUP BY mmsi, window_index)"
)


@query(
    f"WITH {NUMBERS} SELECT mmsi, window_index, printf('reports: %d, span_minutes: %.1f', n, span) || chr(10) || printf('reported_speed_knots: mean %.1f, max %.1f', mean_sog, max_sog) || chr(10) || printf('implied_speed_knots: mean %.1f, max %.1f', mean_implied, max_implied) || chr(10) || printf('max_implied_over_max_reported: %.1f', max_implied / greatest(max_sog, 1)) || chr(10) || printf('max_step_km: %.2f', max_step) || chr(10) "
    "|| printf('steps_claiming_speed_but_not_moving: %d, longest_run: %d', claims, longest) || chr(10) || printf('reports_repeating_earlier_positions: %d', again) || chr(10) || printf('max_course_change_between_reports_deg: %.0f', turn) || chr(10) || printf('max_course_vs_travel_direction_deg: %.0f', off) || chr(10) || printf('implied_minus_reported_speed_trend_knots: %+.1f', trend) AS summary FROM nn"
)
def track_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's summary, as the classifier reads it."""
    return texts.track_summaries(_steps(spark, sf_dir)).select("mmsi", F.col("window_index").cast("long").alias("window_index"), "summary")


SAID = "CASE v WHEN 'prediction_error' THEN 'Prediction error' WHEN 'freeze_replay' THEN 'Freeze or replay' END"


@query(
    f"WITH {FLAGS}, {ZONES}, z AS (SELECT incident_id, min(zone_id) AS zone_id FROM fl LEFT JOIN zone ON {IN_ZONE} GROUP BY incident_id), k AS (SELECT fl.*, zone_id, n_track, n_freeze, row_number() OVER (PARTITION BY mmsi ORDER BY flagged_at, fl.incident_id) - 1 AS n_prior FROM fl JOIN z USING (incident_id) JOIN fz USING (incident_id)) "
    f"SELECT incident_id, array_to_string(list_filter([CASE WHEN votes <> '' THEN 'Detectors that fired: ' || array_to_string([{SAID} FOR v IN string_split(votes, '+')], ', ') || '.' END, CASE WHEN n_freeze >= 3 THEN n_freeze || ' of ' || (n_track - 1) || ' report pairs repeat a position while reported speed stays above the minimum.' END, "
    "CASE WHEN zone_id IS NOT NULL THEN 'The position is inside a known jamming area: ' || zone_id || '.' ELSE 'No known jamming area contains the position.' END, CASE n_prior WHEN 0 THEN 'No earlier incident on this vessel.' WHEN 1 THEN '1 earlier incident on this vessel.' ELSE n_prior || ' earlier incidents on this vessel.' END], lambda x: x IS NOT NULL), chr(10)) AS lines FROM k"
)
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = investigate.investigate(_flags(spark, sf_dir), _live(spark, sf_dir), _zones(spark), A, hours=7 * 24)
    return texts.evidence_lines(found).select("incident_id", F.array_join("lines", "\n").alias("lines"))


@query("SELECT o_orderstatus || '+' || o_orderpriority AS votes, count(*) AS reviewed, count(*) FILTER (WHERE o_orderstatus = 'P') AS unclear, count(*) FILTER (WHERE o_orderstatus = 'F') AS correct, round(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0), 6) AS precision FROM orders GROUP BY 1")
def review_precision_by_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by the detectors that voted."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return reports.review_precision(o.select(F.concat_ws("+", "o_orderstatus", "o_orderpriority").alias("votes"), F.when(F.col("o_orderstatus") == "P", "unclear").when(F.col("o_orderstatus") == "F", "correct").otherwise("wrong").alias("verdict")), "votes").withColumn("precision", F.round("precision", 6))


@query(f"WITH {POS}, h AS (SELECT *, received_at > TIMESTAMP '2024-01-29' AS recent FROM live) SELECT mmsi, count(*) AS n, count(*) < 3 AS short_history FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY received_at DESC, event_id DESC) AS r FROM (SELECT * FROM pos WHERE message_type <> 'signup' AND received_at > TIMESTAMP '2024-01-29')) WHERE r <= 20) GROUP BY mmsi".replace(", h AS (SELECT *, received_at > TIMESTAMP '2024-01-29' AS recent FROM live)", ""))
def recent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vessel's newest 20 reports of a time, and whether they are too few."""
    found = recent_reports(_live(spark, sf_dir), F.lit("2024-01-29").cast("timestamp_ntz"), least=3)
    return found.groupBy("mmsi").agg(F.count("*").alias("n"), F.any_value("short_history").alias("short_history"))


@query(f"WITH {INCIDENTS} SELECT incident_id, event_id, pos.t > inc.t AS after FROM inc JOIN pos ON pos.mmsi = inc.mmsi AND pos.t BETWEEN inc.t - 86400 AND inc.t + 43200")
def incident_track_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vessel's reports from a day before the flag to half a day after it."""
    return evidence.track_around(_incidents(spark, sf_dir), positions(spark, sf_dir), 24, 12).select("incident_id", "event_id", "after")


@query(f"WITH {WINDOWS}, v AS (SELECT mmsi, row_number() OVER (ORDER BY mmsi) AS v FROM (SELECT DISTINCT mmsi FROM st)), w AS (SELECT mmsi, window_index, row_number() OVER (ORDER BY mmsi, window_index) AS w FROM (SELECT DISTINCT mmsi, window_index FROM st) JOIN v USING (mmsi) WHERE v <= 40) SELECT mmsi, window_index FROM w WHERE w <= 60")
def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling cap of a training run: windows of the first 40 vessels, at most 60."""
    return first_of(_steps(spark, sf_dir).select("mmsi", F.col("window_index").cast("long").alias("window_index")).distinct(), vessels=40, most=60)
