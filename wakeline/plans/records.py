"""Queries of envelopes, zones and changes to stored tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import evidence, updates
from wakeline.plans.queries import INCIDENTS, ORDERS, _incidents, _orders
from wakeline.plans.registry import query
from wakeline.sources.envelopes import from_envelopes
from wakeline.sources.zones import parse_zones, sound_zones

# Fixed values of the feed: types of messages, for the events that stand for them.
KINDS = {"click": "PositionReport", "view": "StandardClassBPositionReport", "purchase": "ExtendedClassBPositionReport", "error": "ShipStaticData", "signup": "SubscriptionConfirmation"}


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as envelopes, with every fault at some of the ids."""
    i, u = F.col("event_id"), F.col("user_id")
    of = lambda n: i % n == 0
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in KINDS.items()))
    mmsi = F.when(~of(17), F.when(of(13), F.concat(F.lit("x"), u.cast("string"))).otherwise(u.cast("string")))
    time = F.when(of(19), "yesterday").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("789 +0000 UTC")))
    meta = F.struct(F.when(i % 2 == 1, mmsi).alias("MMSI"), F.when(of(2), mmsi).alias("mmsi"), time.alias("time_utc"), F.concat(F.lit(" V"), u.cast("string"), F.lit(" ")).alias("ShipName"))
    body = F.struct(F.when(of(23), 91.0).otherwise(F.col("value") / 10).alias("Latitude"), F.lit(4.5).alias("Longitude"), (~of(29)).alias("Valid"), F.col("value").alias("Sog"), (i % 520).alias("TrueHeading"), (u % 100).alias("Type"))
    text = F.concat(F.lit('{"MessageType":"'), kind, F.lit('","MetaData":'), F.to_json(meta), F.lit(',"Message":{"'), kind, F.lit('":'), F.to_json(body), F.lit("}}"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("envelope"))


@query(
    "WITH k AS (SELECT *, CASE WHEN event_type = 'signup' OR event_id % 17 = 0 THEN 'ignored' WHEN event_id % 13 = 0 OR event_id % 19 = 0 THEN 'dropped' WHEN event_type = 'error' THEN 'static' WHEN event_id % 29 = 0 OR event_id % 23 = 0 OR value / 10 > 90 THEN 'dropped' ELSE 'position' END AS kind FROM events) "
    "SELECT event_id, kind, CASE WHEN kind = 'dropped' THEN CASE WHEN event_id % 13 = 0 THEN 'bad_mmsi' WHEN event_id % 19 = 0 THEN 'bad_timestamp' WHEN event_id % 29 = 0 THEN 'invalid_flag' ELSE 'invalid_coordinate' END END AS reason, "
    "CASE WHEN kind IN ('position', 'static') THEN user_id END AS mmsi, CASE WHEN kind IN ('position', 'static') THEN epoch_us(ts) END AS us, CASE WHEN kind = 'position' AND value < 102.3 THEN value END AS sog, CASE WHEN kind = 'position' AND event_id % 520 < 360 THEN event_id % 520 END AS heading, CASE WHEN kind = 'static' THEN user_id % 100 END AS ship_type, CASE WHEN kind IN ('position', 'static') THEN 'V' || user_id END AS ship_name FROM k"
)
def envelope_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = from_envelopes(_envelopes(spark, sf_dir))
    kept, own = F.col("kind").isin("position", "static"), F.col("kind") == "position"
    return r.select("event_id", "kind", "reason", F.when(kept, F.col("mmsi")).alias("mmsi"), F.when(kept, F.unix_micros("received_at")).alias("us"), F.when(own, F.col("sog")).alias("sog"), F.when(own, F.col("heading")).alias("heading"), F.when(F.col("kind") == "static", F.col("ship_type")).alias("ship_type"), F.when(kept, F.col("ship_name")).alias("ship_name"))


ZONE_FILE = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"name": "north", "source_name": "s", "source_url": "https://x.org/1", "source_date": "2024-01-01", "confidence": 0.8},
  "geometry": {"type": "Polygon", "coordinates": [[[4.0, 51.02], [4.08, 51.05], [4.02, 51.12], [4.0, 51.02]], [[4.02, 51.05], [4.04, 51.05], [4.03, 51.07], [4.02, 51.05]]]}},
 {"type": "Feature", "properties": {"name": "south", "source_name": "s", "source_url": "https://x.org/2", "source_date": "2024-01-01", "confidence": 0.5, "first_seen": "2024-01-05", "last_seen": "2024-01-20"},
  "geometry": {"type": "MultiPolygon", "coordinates": [[[[4.03, 51.0], [4.09, 51.0], [4.06, 51.04], [4.03, 51.0]]]]}}]}"""
EDGES = """edge AS (SELECT * FROM (VALUES (1, 4.0::DOUBLE, 51.02::DOUBLE, 4.08::DOUBLE, 51.05::DOUBLE), (1, 4.08, 51.05, 4.02, 51.12), (1, 4.02, 51.12, 4.0, 51.02), (1, 4.02, 51.05, 4.04, 51.05), (1, 4.04, 51.05, 4.03, 51.07), (1, 4.03, 51.07, 4.02, 51.05),
 (2, 4.03, 51.0, 4.09, 51.0), (2, 4.09, 51.0, 4.06, 51.04), (2, 4.06, 51.04, 4.03, 51.0)) AS e(zone_id, ax, ay, bx, y2))"""


@query(
    f"WITH {INCIDENTS}, {EDGES}, c AS (SELECT incident_id, zone_id FROM inc JOIN edge ON (ay > lat) <> (y2 > lat) AND lon < (bx - ax) * (lat - ay) / (y2 - ay) + ax WHERE zone_id = 1 OR flagged_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL HAVING count(*) % 2 = 1) "
    "SELECT incident_id, min(zone_id)::BIGINT AS zone_id FROM inc LEFT JOIN c USING (incident_id) GROUP BY incident_id"
)
def incident_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents in the zones of a GeoJSON file, holes and validity minded."""
    zones = sound_zones(parse_zones(spark.createDataFrame([(ZONE_FILE,)], "document string")))
    named = zones.withColumn("zone_id", F.when(F.col("name") == "north", 1).otherwise(2).cast("long"))
    return evidence.in_polygons(_incidents(spark, sf_dir), named).select("incident_id", "zone_id")


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 0 AND o.user_id = e.user_id AND o.value = e.value)")
def inserted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events against the even ones as stored rows, by vessel and value; each new key once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    new = updates.insert_new(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "value"])
    return new.select("user_id", "value").join(e.where("event_id % 2 = 1"), ["user_id", "value"]).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING' OR c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN c_custkey % 3 = 0 THEN 'inserted' WHEN c_custkey % 2 = 1 THEN 'kept' WHEN c_mktsegment <> 'BUILDING' THEN 'updated' ELSE 'skipped' END AS action FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0"
)
def upserted_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows change only where they may; the action of each row."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    stored = c.where("c_custkey % 3 <> 0").withColumn("state", F.lit("old"))
    given = c.where("c_custkey % 2 = 0").withColumn("state", F.lit("new"))
    return updates.upsert(stored, given, ["c_custkey"], F.col("c_mktsegment") != "BUILDING").select("c_custkey", "state", "action")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upserted_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each vessel's static rows wins over what is stored."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    last = updates.last_of_key(e, ["user_id"], F.struct("ts", "event_id"))
    return updates.upsert(e.where("false"), last, ["user_id"]).select("user_id", "event_id")


GIVEN = "g AS (SELECT incident_id + CASE WHEN incident_id % 7 = 0 THEN 10000000 ELSE 0 END AS incident_id FROM o WHERE incident_id % 3 = 0)"


@query(f"WITH {ORDERS}, {GIVEN} SELECT g.incident_id, CASE WHEN o.incident_id IS NULL THEN NULL WHEN status = 'P' THEN 'benign' ELSE status END AS verdict, CASE WHEN o.incident_id IS NULL THEN 'not_found' WHEN status = 'P' THEN 'recorded' ELSE 'already_reviewed' END AS outcome FROM g LEFT JOIN o USING (incident_id)")
def recorded_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    given = o.where("incident_id % 3 = 0").select(F.expr("incident_id + if(incident_id % 7 = 0, 10000000, 0)").alias("incident_id"), F.lit("benign").alias("verdict"))
    return updates.record_verdicts(o.select("incident_id", F.when(F.col("status") != "P", F.col("status")).alias("verdict")), given)


@query(f"WITH {ORDERS} SELECT incident_id, CASE WHEN status <> 'O' AND flagged_at >= TIMESTAMP '1997-01-01' THEN kind END AS report_text, CASE WHEN status <> 'O' AND flagged_at < TIMESTAMP '1997-01-01' THEN 'expired' END AS delete_reason FROM o")
def expired_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _orders(spark, sf_dir).select("incident_id", F.when(F.col("status") != "O", F.col("kind")).alias("report_text"), F.col("flagged_at").alias("expires_at"), F.lit(None).cast("string").alias("delete_reason"))
    return updates.expire_reports(held, F.expr("timestamp_ntz'1997-01-01 00:00:00'")).select("incident_id", "report_text", "delete_reason")


@query("WITH c AS (SELECT c_name AS name, c_mktsegment AS url, c_custkey AS k, c_nationkey AS n FROM customer) SELECT count(*) FILTER (WHERE k % 3 = 0) AS inserted, count(*) FILTER (WHERE k % 3 <> 0 AND n % 2 = 0) AS updated, count(*) FILTER (WHERE k % 3 <> 0 AND n % 2 = 1) AS skipped FROM c WHERE k % 2 = 0")
def upserted_zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's zones against stored ones, by name and source; what happened to them."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("source_url"), "c_custkey", "c_nationkey")
    stored = c.where("c_custkey % 3 <> 0").select("name", "source_url", F.lit(0.5).alias("confidence"), F.when(F.col("c_nationkey") % 2 == 0, "manual").otherwise("official").alias("origin"))
    return updates.upsert_zones(stored, c.where("c_custkey % 2 = 0").select("name", "source_url", F.lit(0.9).alias("confidence")))[1]


@query("WITH e AS (SELECT user_id, event_id, ts, event_id % 4 = 0 AS stored FROM events), s AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM e WHERE stored GROUP BY 1), g AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM e WHERE NOT stored AND user_id % 3 > 0 GROUP BY 1) SELECT coalesce(g.user_id, s.user_id) AS user_id, coalesce(g.event_id, s.event_id) AS event_id, CASE WHEN g.user_id IS NULL THEN 'kept' WHEN s.user_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM s FULL JOIN g ON g.user_id = s.user_id")
def updated_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessels' new rows against stored ones: inserted, updated and kept."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    last = lambda d: updates.last_of_key(d, ["user_id"], F.struct("ts", "event_id"))
    return updates.upsert(last(e.where("event_id % 4 = 0")), last(e.where("event_id % 4 <> 0 and user_id % 3 > 0")), ["user_id"]).select("user_id", "event_id", "action")


@query(f"WITH {INCIDENTS} SELECT incident_id, c_nationkey AS ship_type, c_custkey IS NOT NULL AS known FROM inc LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) ON c_custkey = mmsi")
def incident_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incident's vessel, and whether it is known at all."""
    static = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("mmsi"), F.col("c_nationkey").alias("ship_type"), F.lit(True).alias("known"))
    return _incidents(spark, sf_dir).join(static, "mmsi", "left").select("incident_id", "ship_type", F.coalesce("known", F.lit(False)).alias("known"))
