"""Investigation of flags on their evidence: zones, own history, and what the track before the flag shows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators import evidence, rules
from wakeline.operators.windows import freeze_pair, steps
from wakeline.settings import WINDOW

#: Reports that tell a speed, and their median, for a track to count as that of a vessel that stands.
LEAST_SPEEDS, STANDING_KNOTS = 10, 0.5


def track_evidence(flags: DataFrame, positions: DataFrame, size: int = WINDOW, hours: int = 24) -> DataFrame:
    """incident_id, n_track, n_freeze and stationary of the vessel's last ``size`` reports up to each flag; zeros without a track."""
    last = evidence.last_before(flags, positions, size, hours)
    along = Window.partitionBy("incident_id").orderBy("received_at", "event_id")
    stands = (F.count("sog") >= LEAST_SPEEDS) & (F.median("sog") <= STANDING_KNOTS)
    seen = steps(last, along).groupBy("incident_id").agg(F.count("*").alias("n_track"), F.count_if(freeze_pair()).alias("n_freeze"), F.coalesce(stands, F.lit(False)).alias("stationary"))
    return flags.select("incident_id").join(seen, "incident_id", "left").fillna({"n_track": 0, "n_freeze": 0, "stationary": False})


def investigate(flags: DataFrame, positions: DataFrame, zones: DataFrame, a: float | None, hours: int = 24) -> DataFrame:
    """Flags (incident_id, mmsi, flagged_at, lat, lon, score, votes) with their evidence, hypothesis, confidence and status.

    ``zones`` have rectangles (lat_min) or polygons. A classifier's label and sure are read where the flags carry them.
    """
    in_zone = evidence.in_rectangles if "lat_min" in zones.columns else evidence.in_polygons
    known = evidence.prior_incidents(in_zone(flags, zones)).join(track_evidence(flags, positions, hours=hours), "incident_id")
    label, sure = (F.col(c) if c in flags.columns else None for c in ("label", "sure"))
    return rules.hypothesis(known, a, label, sure)


def follow_up(found: DataFrame, scopes: DataFrame, priors: DataFrame, a: float, b: float) -> DataFrame:
    """incident_id, strength, scope, benign and priority of investigated flags, with scopes() and the vessels' earlier verdicts (mmsi, verdict, judged_at)."""
    benign = F.col("verdict").isin("false_positive", "benign")
    told = found.select("incident_id", "mmsi", "flagged_at").join(priors.where(benign).select("mmsi", "judged_at"), "mmsi").where("judged_at < flagged_at").select("incident_id").distinct().withColumn("_b", F.lit(True))
    both = found.join(scopes.select("incident_id", "scope"), "incident_id", "left").join(told, "incident_id", "left")
    corroborated = F.size(F.split("votes", r"\+")) > 1
    weight = rules.benign_weight(F.col("stationary"), F.col("score") / a, corroborated, F.coalesce("_b", F.lit(False)))
    strength = rules.strength(F.col("score"), a, b)
    scope = F.coalesce("scope", F.lit("insufficient"))
    return both.select("incident_id", F.round(strength, 6).alias("strength"), scope.alias("scope"), weight.alias("benign"), rules.priority(F.col("confidence"), strength, scope, weight).alias("priority"))
