"""The registered queries of the library's own operators and the same in SQL, over the driver's tables.

Events stand for position reports, those of type `error` for incidents; places and courses follow from ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.functions.cleaning import drop_reason, known_course, known_speed
from wakeline.functions.geo import angle_between, haversine_km
from wakeline.operators import evidence, reports, rules
from wakeline.operators.clusters import cluster_containing, clusters
from wakeline.operators.detectors import flagged, votes
from wakeline.operators.windows import chunk, course_off, fixed_windows, freeze_pair, freeze_score, last_reports, runs, scoreable, seconds, skip_reason, steps, track, valid_step, with_error
from wakeline.plans.registry import query
from wakeline.settings import UNDERWAY_KNOTS
from wakeline.sources.tracks import live, positions

MAX_GAP, A, B = 6 * 3600, 0.02, 0.08

POS = """pos AS (SELECT user_id AS mmsi, event_id, ts AS received_at, epoch_us(ts) / 1e6 AS t, value / 20 AS sog, event_type AS message_type,
 51 + (user_id % 10) * 1e-2 + (event_id % 97) * 1e-3 AS lat, 4 + (event_id % 89) * 1e-3 AS lon, (event_id * 37 % 360)::DOUBLE AS cog,
 CASE WHEN event_id % 7 <> 0 THEN event_id * 11 % 360 END AS heading, props FROM events)"""
KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
LIVE = f"{POS}, live AS (SELECT * FROM pos WHERE message_type <> 'signup')"
NUMBERED = """n0 AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY received_at, event_id) - 1 AS n, count(*) OVER (PARTITION BY mmsi) AS total FROM {src}),
 win AS (SELECT *, n // 20 AS window_index, n % 20 AS place FROM n0 WHERE n // 20 < total // 20)"""
STEPS = (
    "l0 AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(sog) OVER w AS psog, lag(t) OVER w AS pt FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY received_at, event_id)), "
    "st0 AS (SELECT *, t - pt AS gap_s, " + KM.format(a="p", b="") + " AS step_km, lat - plat AS dlat, lon - plon AS dlon, sog - psog AS sog_change FROM l0), "
    "st AS (SELECT *, CASE WHEN gap_s > 0 THEN step_km * 3600 / gap_s * 0.539956803::DOUBLE ELSE -1.0::DOUBLE END AS implied, "
    "(degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360) % 360 AS step_bearing FROM st0)"
)
WINDOWS = f"{LIVE}, {NUMBERED.format(src='live')}, {STEPS.format(src='win', key='mmsi, window_index')}"
ERRORS = f"{WINDOWS}, er AS (SELECT *, coalesce(sqrt(pow(dlat - lag(dlat) OVER w, 2) + pow(dlon - lag(dlon) OVER w, 2)), 0) AS error, CASE WHEN sog IS NOT NULL AND implied BETWEEN 0 AND 0.5 THEN greatest(0, sog - implied) ELSE 0 END AS fr FROM st WINDOW w AS (PARTITION BY mmsi, window_index ORDER BY received_at, event_id))"
VOTED = f"{ERRORS}, vo AS (SELECT *, CAST(fr > 0.5 AS INT) + CAST(error > {A} AS INT) AS n_votes, concat_ws('+', CASE WHEN fr > 0.5 THEN 'freeze_replay' END, CASE WHEN error > {A} THEN 'prediction_error' END) AS votes FROM er)"
GATE = f"place > 0 AND gap_s > 0 AND gap_s <= {MAX_GAP} AND abs(dlon) <= 180"
INCIDENTS = f"{LIVE}, inc AS (SELECT event_id AS incident_id, mmsi, received_at AS flagged_at, t, lat, lon, sog AS score FROM live WHERE message_type = 'error')"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(positions(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(fixed_windows(_live(spark, sf_dir)))


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).where("message_type = 'error'").select(F.col("event_id").alias("incident_id"), "mmsi", F.col("received_at").alias("flagged_at"), "lat", "lon", F.col("sog").alias("score"))


def _6(c: str) -> object:
    return F.round(c, 6).alias(c)


@query(
    f"WITH {WINDOWS} SELECT mmsi, count(*) AS reports, count(*) FILTER (WHERE CASE WHEN implied BETWEEN 0 AND 0.5 THEN greatest(0, sog - implied) ELSE 0 END > 0.5) AS freeze_votes, count(*) FILTER (WHERE gap_s > {MAX_GAP}) AS long_gaps, round(max(implied), 6) AS max_implied FROM st GROUP BY mmsi"
)
def freeze_by_vessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).groupBy("mmsi").agg(F.count("*").alias("reports"), F.count_if(freeze_score() > 0.5).alias("freeze_votes"), F.count_if(F.col("gap_s") > MAX_GAP).alias("long_gaps"), F.round(F.max("implied"), 6).alias("max_implied"))


@query(f"WITH {LIVE} SELECT count(*) AS reports, min(received_at) AS first_at, max(received_at) AS last_at, count(DISTINCT mmsi) AS vessels FROM live")
def live_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).agg(F.count("*").alias("reports"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), F.count_distinct("mmsi").alias("vessels"))


@query(f"WITH {LIVE} SELECT mmsi, event_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM live QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY received_at DESC, event_id) = 1")
def latest_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest(_live(spark, sf_dir), "mmsi").select("mmsi", "event_id", _6("lat"), _6("lon"))


@query(f"WITH {LIVE} SELECT mmsi, count(*) AS n FROM live GROUP BY mmsi HAVING count(*) >= 20")
def vessels_with_a_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).groupBy("mmsi").agg(F.count("*").alias("n")).where("n >= 20")


@query(
    f"WITH {WINDOWS} SELECT event_id, mmsi, window_index, place, round(coalesce(sog, -1), 6) AS sog, coalesce(heading, -1)::BIGINT AS heading, (heading IS NULL)::INT AS heading_missing, round(implied, 6) AS implied, round(sog_change, 6) AS sog_change, round(dlat, 6) AS dlat, round(dlon, 6) AS dlon FROM st"
)
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("event_id", "mmsi", F.col("window_index").cast("long"), F.col("place").cast("long"), F.round(F.coalesce("sog", F.lit(-1.0)), 6).alias("sog"), F.coalesce("heading", F.lit(-1)).cast("long").alias("heading"), F.isnull("heading").cast("int").alias("heading_missing"), _6("implied"), _6("sog_change"), _6("dlat"), _6("dlon"))


@query(f"WITH {WINDOWS} SELECT CASE WHEN gap_s IS NULL THEN 'kept' WHEN gap_s <= 0 THEN 'non_positive_dt' WHEN gap_s > {MAX_GAP} THEN 'long_gap' WHEN abs(dlon) > 180 THEN 'antimeridian' ELSE 'kept' END AS reason, count(*) AS n FROM st GROUP BY 1")
def step_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).groupBy(F.coalesce(skip_reason(MAX_GAP), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {VOTED} SELECT mmsi, window_index, event_id, votes, n_votes, round(error, 6) AS error, CASE WHEN error > {A} AND error >= {B} THEN 'B' ELSE 'A' END AS tier FROM vo WHERE n_votes >= 1 AND {GATE} QUALIFY row_number() OVER (PARTITION BY mmsi, window_index ORDER BY n_votes DESC, error DESC, place DESC) = 1")
def flagged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(votes(with_error(_steps(spark, sf_dir)), A), B, max_gap_s=MAX_GAP).select("mmsi", F.col("window_index").cast("long"), "event_id", "votes", "n_votes", _6("error"), "tier")


@query(f"WITH {VOTED}, k AS (SELECT *, max(implied) OVER (PARTITION BY mmsi, window_index) > 1 AS underway FROM vo) SELECT round(avg(CAST(error > {A} AS INT)), 6) AS flag_rate, round(avg(CAST(n_votes >= 1 AS INT)), 6) AS any_vote, round(avg(CAST(n_votes >= 2 AS INT)), 6) AS two_votes, round(avg(CAST(error > {A} AS INT)) FILTER (WHERE underway), 6) AS underway_rate, round(avg(CAST(error > {A} AS INT)) FILTER (WHERE NOT underway), 6) AS stationary_rate FROM k WHERE {GATE}")
def vote_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over reports whose step can be judged; a window is underway by its fastest step, judged or not."""
    moving = F.max("implied").over(Window.partitionBy("mmsi", "window_index")) > UNDERWAY_KNOTS
    v = votes(with_error(_steps(spark, sf_dir)), A).withColumn("underway", moving).where(scoreable(MAX_GAP))
    over = (F.col("error") > A).cast("int")
    rates = {"flag_rate": over, "any_vote": (F.col("n_votes") >= 1).cast("int"), "two_votes": (F.col("n_votes") >= 2).cast("int"), "underway_rate": F.when(F.col("underway"), over), "stationary_rate": F.when(~F.col("underway"), over)}
    return v.agg(*(F.round(F.avg(c), 6).alias(k) for k, c in rates.items()))


@query(f"WITH {ERRORS} SELECT p, round(v, 6) AS error FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99, 0.999])::DOUBLE AS p, unnest(quantile_cont(error, [0.5, 0.9, 0.95, 0.99, 0.999])) AS v FROM er WHERE {GATE})")
def error_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.percentiles(with_error(_steps(spark, sf_dir)).where(scoreable(MAX_GAP)), "error", [0.5, 0.9, 0.95, 0.99, 0.999])
    return found.select("p", F.round("value", 6).alias("error"))


EDGES_SQL = f"[{', '.join(map(repr, reports.EDGES))}]::DOUBLE[]"
BIN = "(least(greatest(len(list_filter(edges, lambda e: e <= {x})) - 1, 0), 119))::INT"
HIST = f"hist AS (SELECT {BIN.format(x='x')} AS bin, count(*) AS n FROM (SELECT value / 100 AS x FROM events), (SELECT {EDGES_SQL} AS edges) GROUP BY 1), ed AS (SELECT {EDGES_SQL} AS edges)"


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value") / 100)


@query(f"WITH {HIST} SELECT bin, n FROM hist")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


@query(f"WITH {HIST} SELECT bin, round(edges[bin + 1], 6) AS lower_edge, round(sum(n) OVER (ORDER BY bin DESC) / sum(n) OVER (), 6) AS share FROM hist, ed")
def histogram_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shares_above(_histogram(spark, sf_dir)).select("bin", _6("lower_edge"), _6("share"))


CROSSED = "(SELECT bin, n, ln(edges[bin + 1]) AS low, ln(edges[bin + 2]) AS high, sum(n) OVER (ORDER BY bin DESC) AS c, sum(n) OVER () AS total FROM hist, ed)"
THRESHOLD = "round(exp(high - (s * total - (c - n)) / n * (high - low)), 6) AS threshold"


@query(f"WITH {HIST} SELECT {THRESHOLD} FROM {CROSSED}, (SELECT 0.1::DOUBLE AS s) WHERE c > s * total QUALIFY row_number() OVER (ORDER BY bin DESC) = 1")
def histogram_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_for_share(_histogram(spark, sf_dir), 0.1).select(_6("threshold"))


@query(f"WITH {HIST} SELECT s AS share, {THRESHOLD} FROM {CROSSED}, (SELECT unnest([1e-1, 1e-2, 1e-3])::DOUBLE AS s) WHERE c > s * total QUALIFY row_number() OVER (PARTITION BY s ORDER BY bin DESC) = 1")
def score_at_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_at_shares(_histogram(spark, sf_dir), [1e-1, 1e-2, 1e-3]).select("share", _6("threshold"))


@query(f"WITH {HIST}, e AS (SELECT n, edges[bin + 1] AS low, edges[bin + 2] AS high FROM hist, ed) SELECT round(sum(CASE WHEN low >= 0.7 THEN n WHEN high <= 0.7 THEN 0 ELSE n * (ln(high) - ln(0.7)) / (ln(high) - ln(low)) END) / sum(n), 6) AS share FROM e")
def histogram_share_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.share_above(_histogram(spark, sf_dir), 0.7).select(_6("share"))


@query(f"WITH {LIVE} SELECT event_id, mmsi, c_name AS name, c_nationkey AS ship_type FROM live LEFT JOIN customer ON c_custkey = mmsi")
def position_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("mmsi"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("ship_type"))
    return _live(spark, sf_dir).select("event_id", "mmsi").join(static, "mmsi", "left").select("event_id", "mmsi", "name", "ship_type")


@query(f"WITH {INCIDENTS} SELECT incident_id, event_id FROM inc JOIN pos ON pos.mmsi = inc.mmsi AND pos.t BETWEEN inc.t - 86400 AND inc.t")
def incident_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.track_history(_incidents(spark, sf_dir), positions(spark, sf_dir)).select("incident_id", "event_id")


NEWEST = "newest AS (SELECT incident_id, live.mmsi AS other, arg_max(event_id, (live.t, -event_id)) AS event_id, arg_max({km}, (live.t, -event_id)) AS km FROM inc JOIN live ON live.mmsi <> inc.mmsi AND abs(live.t - inc.t) <= 3600 AND {km} <= 5 GROUP BY incident_id, live.mmsi QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY live.mmsi) <= 60)"


@query(f"WITH {INCIDENTS}, {NEWEST.format(km=KM.format(a='inc.', b='live.'))} SELECT incident_id, other, event_id, round(km, 6) AS km FROM newest")
def incident_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each other vessel near in space and time the newest report; the first 60 vessels."""
    return evidence.neighbours(_incidents(spark, sf_dir), _live(spark, sf_dir), 5).select("incident_id", "other", "event_id", _6("km"))


ZONES = "zone AS (SELECT * FROM (VALUES (1, 51.0::DOUBLE, 51.05::DOUBLE, 4.0::DOUBLE, 4.04::DOUBLE, NULL::TIMESTAMP, NULL::TIMESTAMP), (2, 51.02, 51.12, 4.02, 4.07, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20')) AS z(zone_id, lat_min, lat_max, lon_min, lon_max, first_seen, last_seen))"
IN_ZONE = "lat > lat_min AND lat < lat_max AND lon > lon_min AND lon < lon_max AND (first_seen IS NULL OR flagged_at >= first_seen) AND (last_seen IS NULL OR flagged_at <= last_seen)"


def _zones(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1, 51.0D, 51.05D, 4.0D, 4.04D, CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS TIMESTAMP_NTZ)), (2, 51.02D, 51.12D, 4.02D, 4.07D, TIMESTAMP_NTZ '2024-01-05 00:00:00', TIMESTAMP_NTZ '2024-01-20 00:00:00') AS z(zone_id, lat_min, lat_max, lon_min, lon_max, first_seen, last_seen)")


@query(f"WITH {INCIDENTS}, {ZONES} SELECT incident_id, min(zone_id) AS zone_id FROM inc LEFT JOIN zone ON {IN_ZONE} GROUP BY incident_id")
def incident_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.in_rectangles(_incidents(spark, sf_dir), _zones(spark)).select("incident_id", "zone_id")


@query(f"WITH {INCIDENTS} SELECT incident_id, count(*) OVER (PARTITION BY mmsi ORDER BY flagged_at, incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM inc")
def prior_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.prior_incidents(_incidents(spark, sf_dir)).select("incident_id", "n_prior")


@query(f"WITH {POS}, twice AS (SELECT * FROM pos UNION ALL SELECT * REPLACE (event_id + 1000000 AS event_id) FROM pos WHERE event_id % 3 = 0) SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT min(event_id) AS event_id FROM twice GROUP BY mmsi, received_at, lat, lon)")
def positions_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = positions(spark, sf_dir)
    twice = own.unionByName(own.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 1000000))
    return evidence.without_duplicates(twice).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


LAST = f"{LIVE}, last20 AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY received_at DESC, event_id DESC) <= 20), {STEPS.format(src='last20', key='mmsi')}"


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(last_reports(_live(spark, sf_dir)), track())


@query(f"WITH {LAST} SELECT mmsi, count(*) FILTER (WHERE gap_s > 0 AND implied BETWEEN 0 AND 0.5 AND sog > 0.5) AS n_freeze, count(*) FILTER (WHERE gap_s > 0 AND implied BETWEEN 0 AND 0.5 AND sog > 0.5) >= 3 AS matched, count(sog) >= 10 AND median(sog) <= 0.5 AS stationary FROM st GROUP BY mmsi")
def freeze_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(freeze_pair())
    return _last(spark, sf_dir).groupBy("mmsi").agg(n.alias("n_freeze"), (n >= 3).alias("matched"), ((F.count("sog") >= 10) & (F.median("sog") <= 0.5)).alias("stationary"))


@query(f"WITH {LAST}, c AS (SELECT *, coalesce(gap_s > 0 AND implied <= 0.5 AND sog > 0.5, false) AS said FROM st), i AS (SELECT *, sum((NOT said)::INT) OVER (PARTITION BY mmsi ORDER BY received_at, event_id) AS island FROM c), r AS (SELECT mmsi, island, count(*) FILTER (WHERE said) AS n FROM i GROUP BY ALL) SELECT mmsi, max(n) AS longest_run FROM r GROUP BY mmsi")
def longest_slow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of steps that stand while speed is told, among each vessel's last reports."""
    return runs(_last(spark, sf_dir), freeze_pair())


@query(
    f"WITH {WINDOWS}, a AS (SELECT *, implied <> -1 AS ok, lag(cog) OVER (PARTITION BY mmsi, window_index ORDER BY place) AS pcog FROM st), b AS (SELECT *, implied - sog AS d, sum((ok AND sog IS NOT NULL)::INT) OVER (PARTITION BY mmsi, window_index ORDER BY place) - 1 AS i, sum((ok AND sog IS NOT NULL)::INT) OVER (PARTITION BY mmsi, window_index) AS m FROM a) "
    "SELECT mmsi, window_index, round(max(step_km) FILTER (WHERE ok), 6) AS max_step_km, round(coalesce(avg(d) FILTER (WHERE ok AND sog IS NOT NULL AND i >= m - greatest(1, m // 3)) - avg(d) FILTER (WHERE ok AND sog IS NOT NULL AND i < greatest(1, m // 3)), 0), 5) AS trend, "
    "round(max(least(abs(cog - pcog) % 360, 360 - abs(cog - pcog) % 360)) FILTER (WHERE ok), 4) AS max_course_change, round(max(least(abs(cog - step_bearing) % 360, 360 - abs(cog - step_bearing) % 360)) FILTER (WHERE implied > 1), 4) AS max_course_off, round(median(sog), 6) AS median_sog, max(implied) > 1 AS underway FROM b GROUP BY mmsi, window_index"
)
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend: what steps imply beyond what is told, last third of the valid steps against the first."""
    whole = Window.partitionBy("mmsi", "window_index")
    told = (valid_step() & F.col("sog").isNotNull()).cast("int")
    s = _steps(spark, sf_dir).withColumns({"_i": F.sum(told).over(chunk()) - 1, "_m": F.sum(told).over(whole), "_turn": angle_between(F.lag("cog").over(chunk()), F.col("cog"))})
    third = F.greatest(F.lit(1), F.floor(F.col("_m") / 3))
    mean = lambda test: F.avg(F.when((told == 1) & test, F.col("implied") - F.col("sog")))
    trend = F.coalesce(mean(F.col("_i") >= F.col("_m") - third) - mean(F.col("_i") < third), F.lit(0.0))
    most = lambda test, c, places: F.round(F.max(F.when(test, c)), places)
    return s.groupBy("mmsi", F.col("window_index").cast("long").alias("window_index")).agg(
        most(valid_step(), F.col("step_km"), 6).alias("max_step_km"), F.round(trend, 5).alias("trend"), most(valid_step(), F.col("_turn"), 4).alias("max_course_change"),
        most(F.col("implied") > UNDERWAY_KNOTS, course_off(), 4).alias("max_course_off"), F.round(F.median("sog"), 6).alias("median_sog"), (F.max("implied") > UNDERWAY_KNOTS).alias("underway"),
    )


@query(f"WITH {LIVE}, k AS (SELECT *, floor(t / 1800)::BIGINT AS bucket FROM live) SELECT bucket, mmsi, arg_max(event_id, (received_at, -event_id)) AS event_id FROM k GROUP BY bucket, mmsi")
def latest_in_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest(_live(spark, sf_dir).withColumn("bucket", F.floor(seconds("received_at") / 1800)), "bucket", "mmsi").select("bucket", "mmsi", "event_id")


#: Latest reports of a day, pairs within 3 km, what core vessels reach, and whom the others join.
CLUSTERED = f"""{LIVE}, p AS (SELECT floor(t / 86400)::BIGINT AS bucket, mmsi, arg_max(lat, (received_at, -event_id)) AS lat, arg_max(lon, (received_at, -event_id)) AS lon FROM live GROUP BY ALL),
near AS (SELECT a.bucket, a.mmsi AS a, b.mmsi AS b FROM p a JOIN p b ON a.bucket = b.bucket AND {KM.format(a='a.', b='b.')} <= 3),
core AS (SELECT bucket, a FROM near GROUP BY ALL HAVING count(*) >= 3), link AS (SELECT near.* FROM near JOIN core USING (bucket, a)), inner_ AS (SELECT link.* FROM link JOIN core ON core.bucket = link.bucket AND core.a = b),
r AS (SELECT bucket, a, a AS l FROM core UNION SELECT r.bucket, inner_.b, r.l FROM r JOIN inner_ ON inner_.bucket = r.bucket AND inner_.a = r.a AND r.l < inner_.b),
own AS (SELECT bucket, a, min(l) AS cluster FROM r GROUP BY ALL),
m AS (SELECT link.bucket, b AS mmsi, coalesce(min(cluster) FILTER (WHERE link.a = b), min(cluster)) AS cluster FROM link JOIN own USING (bucket, a) GROUP BY ALL),
c AS (SELECT bucket, cluster, count(*) AS vessels, avg(lat) AS centre_lat, avg(lon) AS centre_lon FROM m JOIN p USING (bucket, mmsi) GROUP BY ALL),
s AS (SELECT bucket, cluster, vessels, round(centre_lat, 6) AS centre_lat, round(centre_lon, 6) AS centre_lon, round(max({KM.format(a='c.centre_', b='p.')}), 6) AS radius_km FROM c JOIN m USING (bucket, cluster) JOIN p USING (bucket, mmsi) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {CLUSTERED} SELECT * FROM s")
def area_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(_live(spark, sf_dir), km=3, least=3, minutes=24 * 60)
    return found.select("bucket", "cluster", "vessels", _6("centre_lat"), _6("centre_lon"), _6("radius_km"))


ONE = CLUSTERED.replace("floor(t / 86400)::BIGINT AS bucket", "0 AS bucket").replace("<= 3)", "<= 1)")


@query(f"WITH RECURSIVE {ONE} SELECT s.cluster, vessels, radius_km FROM s JOIN (SELECT cluster FROM m WHERE mmsi = 11) USING (cluster)")
def cluster_of_vessel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of all newest positions that holds a vessel."""
    return cluster_containing(_live(spark, sf_dir), 11, km=1).select("cluster", "vessels", _6("radius_km"))


@query("SELECT c_custkey AS mmsi, CASE WHEN ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::UBIGINT % 1000 >= 800 THEN 'validation' ELSE 'train' END AS split FROM customer")
def vessel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.conv(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 8), 16, 10).cast("long") % 1000
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("mmsi"), F.when(share >= 800, "validation").otherwise("train").alias("split"))


@query("SELECT o_orderpriority AS hypothesis, count(*) AS reviewed, count(*) FILTER (WHERE o_orderstatus = 'P') AS unclear, count(*) FILTER (WHERE o_orderstatus = 'F') AS correct, round(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0), 6) AS precision FROM orders GROUP BY 1")
def review_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("hypothesis")).agg(F.count("*").alias("reviewed"), F.count_if(s == "P").alias("unclear"), F.count_if(s == "F").alias("correct"))
    return n.withColumn("precision", F.round(F.col("correct") / F.nullif(F.col("reviewed") - F.col("unclear"), F.lit(0)), 6))


@query("WITH c AS (SELECT count(*) FILTER (WHERE n_chars > 800 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars > 800 AND quality <> 1) AS fp, count(*) FILTER (WHERE NOT n_chars > 800 AND quality = 1) AS fn, count(*) FILTER (WHERE NOT n_chars > 800 AND quality <> 1) AS tn FROM labels JOIN documents USING (doc_id)) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy FROM c")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    n = reports.confusion(both, F.col("n_chars") > 800, F.col("quality") == 1)
    return n.select("tp", "fp", "fn", "tn", *(_6(c) for c in ("precision", "recall", "f1", "accuracy")))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderpriority DESC, o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 51")
def console_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 and one more, which tells whether another follows."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'O' and o_orderdate < timestamp_ntz'1998-01-01 00:00:00'")
    return rows.orderBy(F.desc("o_orderpriority"), F.desc_nulls_last("o_totalprice"), F.desc("o_orderdate"), "o_orderkey").limit(51).select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")


@query(f"WITH {VOTED} SELECT event_id, n_votes, round(error, 6) AS error FROM vo WHERE {GATE} ORDER BY n_votes DESC, vo.error DESC, received_at DESC, event_id LIMIT 25")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle's cap: the 25 strongest reports."""
    v = votes(with_error(_steps(spark, sf_dir)), A).where(scoreable(MAX_GAP))
    return v.orderBy(F.desc("n_votes"), F.desc("error"), F.desc("received_at"), "event_id").limit(25).select("event_id", "n_votes", _6("error"))


@query(
    f"WITH {INCIDENTS}, {ZONES}, z AS (SELECT incident_id, min(zone_id) AS zone_id FROM inc LEFT JOIN zone ON {IN_ZONE} GROUP BY incident_id), "
    "p AS (SELECT inc.*, zone_id, row_number() OVER (PARTITION BY mmsi ORDER BY flagged_at, inc.incident_id) - 1 AS n_prior FROM inc JOIN z USING (incident_id)), "
    "h AS (SELECT *, CASE WHEN zone_id IS NOT NULL THEN 'jamming' WHEN score < 2 AND incident_id % 2 = 1 THEN 'benign' WHEN incident_id % 5 >= 3 THEN 'freeze_replay' WHEN incident_id % 2 = 1 AND score <= 4 AND incident_id % 3 = 0 THEN 'benign' WHEN n_prior = 0 THEN 'targeted_spoof' ELSE 'equipment_fault' END AS hypothesis FROM p), "
    "c AS (SELECT *, CASE hypothesis WHEN 'jamming' THEN 0.85 WHEN 'benign' THEN 0.75 ELSE CASE WHEN incident_id % 2 = 1 THEN 0.5 WHEN hypothesis = 'freeze_replay' THEN 0.8 WHEN hypothesis = 'targeted_spoof' THEN 0.72 ELSE 0.55 END END::DOUBLE AS confidence FROM h) "
    "SELECT incident_id, hypothesis, confidence, CASE WHEN confidence >= 0.7 THEN 'reported' ELSE 'escalated' END AS status FROM c"
)
def incident_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("incident_id")
    known = evidence.prior_incidents(evidence.in_rectangles(_incidents(spark, sf_dir), _zones(spark)))
    known = known.withColumns({"votes": F.when(i % 2 == 1, "prediction_error").otherwise("freeze_replay+prediction_error"), "n_freeze": i % 5, "stationary": i % 3 == 0})
    return rules.hypothesis(known, 2.0).select("incident_id", "hypothesis", "confidence", "status")


@query(f"WITH {INCIDENTS} SELECT incident_id, round(least(1, greatest(0, (score - 2) / 18)), 6) AS strength FROM inc")
def incident_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incidents(spark, sf_dir).select("incident_id", F.round(rules.strength(F.col("score"), 2.0, 20.0), 6).alias("strength"))


@query("SELECT (props->>'$.k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy((F.expr("try_cast(get_json_object(props, '$.k') as bigint)") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN user_id % 13 = 0 THEN 'bad_mmsi' WHEN event_id % 11 = 0 THEN 'invalid_flag' WHEN value > 300 THEN 'invalid_coordinate' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1")
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = e.select(F.when(F.col("user_id") % 13 != 0, F.col("user_id")).alias("mmsi"), F.col("ts").alias("received_at"), (F.col("event_id") % 11 != 0).alias("valid"), (F.col("value") * 0.3).alias("lat"), F.col("value").alias("lon"))
    raw = raw.withColumns({"lat": F.when(F.col("lon") > 300, F.lit(91.0)).otherwise(F.lit(1.0)), "lon": F.lit(0.0)})
    return drop_reason(raw).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value < 102.3 THEN value END AS sog, CASE WHEN event_id % 400 < 360 THEN (event_id % 400)::DOUBLE END AS cog FROM events")
def unavailable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", known_speed(F.col("value")).alias("sog"), known_course((F.col("event_id") % 400).cast("double")).alias("cog"))


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS joined, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE d.doc_id IS NULL) AS orphans FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id")
def label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select("doc_id").distinct().withColumn(t, F.lit(True)) for t in ("labels", "documents"))
    both = labels.join(docs, "doc_id", "full")
    return both.agg(F.count_if(F.col("labels") & F.col("documents")).alias("joined"), F.count_if(F.isnull("labels")).alias("unlabelled"), F.count_if(F.isnull("documents")).alias("orphans"))


@query("SELECT o_orderpriority AS tier, o_orderstatus AS verdict, count(*) AS n, round(sum(o_totalprice), 2) AS price, max(o_orderdate) AS newest FROM orders GROUP BY ALL")
def tier_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("verdict")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.max("o_orderdate").alias("newest"))


@query(f"WITH {LIVE}, b AS (SELECT *, lag(lat) OVER w AS y, lag(lon) OVER w AS x FROM live WINDOW w AS (PARTITION BY mmsi ORDER BY received_at, event_id)) SELECT mmsi, round(sum({KM.format(a='p', b='')}), 6) AS km FROM (SELECT mmsi, lat, lon, y AS plat, x AS plon FROM b) GROUP BY mmsi")
def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = track()
    before = _live(spark, sf_dir).withColumns({"_y": F.lag("lat").over(w), "_x": F.lag("lon").over(w)})
    return before.groupBy("mmsi").agg(F.round(F.sum(haversine_km(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon"))), 6).alias("km"))


ORDERS = "o AS (SELECT o_orderkey AS incident_id, o_custkey AS mmsi, o_orderdate AS flagged_at, o_orderpriority AS kind, o_orderstatus AS status, o_totalprice AS score FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as incidents."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("incident_id"), F.col("o_custkey").alias("mmsi"), F.col("o_orderdate").alias("flagged_at"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"))


@query(f"WITH {ORDERS} SELECT a.incident_id, b.incident_id AS other_id, row_number() OVER w AS place FROM o a JOIN o b ON a.kind = b.kind AND a.mmsi <> b.mmsi WHERE a.status = 'P' WINDOW w AS (PARTITION BY a.incident_id ORDER BY b.flagged_at DESC, b.incident_id DESC) QUALIFY row_number() OVER w <= 10")
def same_pattern_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    asked = o.where("status = 'P'").select("incident_id")
    return evidence.same_kind_elsewhere(o, "kind").join(asked, "incident_id", "left_semi")


@query(f"WITH {ORDERS} SELECT incident_id, string_agg(incident_id::VARCHAR, ',') OVER (PARTITION BY mmsi ORDER BY flagged_at, incident_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS earlier FROM o")
def own_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incident's ten last before it on the same vessel."""
    own = Window.partitionBy("mmsi").orderBy("flagged_at", "incident_id").rowsBetween(-10, -1)
    return _orders(spark, sf_dir).select("incident_id", F.nullif(F.array_join(F.collect_list(F.col("incident_id").cast("string")).over(own), ","), F.lit("")).alias("earlier"))


@query(f"WITH {INCIDENTS}, m AS (SELECT incident_id, event_id, row_number() OVER (PARTITION BY incident_id ORDER BY received_at DESC, event_id DESC) AS place FROM inc JOIN pos ON pos.mmsi = inc.mmsi AND pos.t BETWEEN inc.t - 7 * 86400 AND inc.t) SELECT * FROM m WHERE place <= 20")
def reports_before_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.last_before(_incidents(spark, sf_dir), positions(spark, sf_dir), 20, 7 * 24).select("incident_id", "event_id", "place")


@query(f"WITH {ORDERS} SELECT count(*) FILTER (WHERE status = 'O' AND kind = '1-URGENT' AND flagged_at > TIMESTAMP '1998-01-01') AS waiting, count(*) FILTER (WHERE status <> 'O') AS judged, max(flagged_at) AS newest, epoch_us(TIMESTAMP '1999-01-01')::BIGINT // 1000000 - epoch_us(max(flagged_at))::BIGINT // 1000000 AS age_s FROM o")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting of the first tier since a time, judged, and the age of the newest, as of a given time."""
    waits = F.expr("status = 'O' and kind = '1-URGENT' and flagged_at > timestamp_ntz'1998-01-01 00:00:00'")
    age = F.unix_timestamp(F.lit("1999-01-01 00:00:00")) - F.unix_seconds(F.max(F.col("flagged_at").cast("timestamp")))
    return _orders(spark, sf_dir).agg(F.count_if(waits).alias("waiting"), F.count_if(F.col("status") != "O").alias("judged"), F.max("flagged_at").alias("newest"), age.alias("age_s"))


@query(f"WITH {ORDERS} SELECT kind, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS confirmed, count(DISTINCT status) AS verdicts, string_agg(DISTINCT status, '+' ORDER BY status) AS named FROM o GROUP BY kind")
def verdicts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("confirmed"), F.count_distinct("status").alias("verdicts"), F.array_join(F.array_sort(F.collect_set("status")), "+").alias("named"))


@query(f"WITH {POS} SELECT count(*) AS n, count(DISTINCT mmsi) AS vessels FROM pos WHERE lat BETWEEN 51.02 AND 51.08 AND lon BETWEEN 4.01 AND 4.05 AND received_at >= TIMESTAMP '2024-01-10' AND received_at < TIMESTAMP '2024-01-20'")
def inside_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a half-open time range inside a closed box."""
    box = F.col("lat").between(51.02, 51.08) & F.col("lon").between(4.01, 4.05)
    return positions(spark, sf_dir).where(box & F.expr("received_at >= timestamp_ntz'2024-01-10 00:00:00' and received_at < timestamp_ntz'2024-01-20 00:00:00'")).agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels"))


@query("SELECT event_id FROM events WHERE ('0x' || substr(sha256('7|keep|' || user_id || '|' || event_id), 1, 16))::UBIGINT % 1000 < 100")
def kept_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of seed, vessel and report keeps one in ten."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    said = F.concat_ws("|", F.lit("7"), F.lit("keep"), F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return e.where(F.conv(F.substring(F.sha2(said, 256), 1, 16), 16, 10).cast("decimal(20,0)") % 1000 < 100).select("event_id")


@query(f"WITH {INCIDENTS} SELECT a.incident_id FROM inc a WHERE NOT EXISTS (SELECT 1 FROM inc b WHERE b.mmsi = a.mmsi AND b.t < a.t AND b.t >= a.t - 172800)")
def not_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents whose vessel had no other in the two days before."""
    before = F.lag(seconds("flagged_at")).over(Window.partitionBy("mmsi").orderBy("flagged_at", "incident_id"))
    return _incidents(spark, sf_dir).withColumn("_before", before).where(F.col("_before").isNull() | (seconds("flagged_at") - F.col("_before") > 172800)).select("incident_id")


@query("SELECT s.split, l.label, count(d.doc_id) AS n FROM (VALUES ('train'), ('holdout')) s(split) CROSS JOIN (VALUES (0), (1), (2)) l(label) LEFT JOIN (SELECT doc_id, quality, CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'train' END AS split FROM labels) d ON d.split = s.split AND d.quality = l.label GROUP BY ALL")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every label in every split, empty ones included."""
    grid = spark.sql("SELECT split, label FROM VALUES ('train', 0), ('train', 1), ('train', 2), ('holdout', 0), ('holdout', 1), ('holdout', 2) AS g(split, label)")
    n = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.when(F.col("doc_id") % 5 == 0, "holdout").otherwise("train").alias("split"), F.col("quality").alias("label")).agg(F.count("*").alias("n"))
    return grid.join(n, ["split", "label"], "left").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"))
