"""Texts for readers: a track's summary, an incident's evidence, votes, lists. Numbers come from columns; text is the last step."""

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wakeline.functions.geo import angle_between
from wakeline.operators.windows import chunk, course_off, revisited, seconds, valid_step
from wakeline.settings import FREEZE_IMPLIED, UNDERWAY_KNOTS

#: What a summary tells of a track, in order, in the forms that the classifier has learned.
SUMMARY = (
    "reports: {n:d}, span_minutes: {span:.1f}",
    "reported_speed_knots: mean {mean_sog:.1f}, max {max_sog:.1f}",
    "implied_speed_knots: mean {mean_implied:.1f}, max {max_implied:.1f}",
    "max_implied_over_max_reported: {ratio:.1f}",
    "max_step_km: {max_step:.2f}",
    "steps_claiming_speed_but_not_moving: {claims:d}, longest_run: {longest:d}",
    "reports_repeating_earlier_positions: {again:d}",
    "max_course_change_between_reports_deg: {turn:.0f}",
    "max_course_vs_travel_direction_deg: {off:.0f}",
    "implied_minus_reported_speed_trend_knots: {trend:+.1f}",
)
TOO_SHORT = "reports: {n:d}\nnot enough reports to describe motion"
#: Names of the detectors for readers.
DETECTORS = {"prediction_error": "Prediction error", "freeze_replay": "Freeze or replay", "speed_jump": "Speed jump"}
#: Sentences of an incident's evidence.
FIRED, REPEATED = "Detectors that fired: ", " report pairs repeat a position while reported speed stays above the minimum."
IN_AREA, IN_NO_AREA = "The position is inside a known jamming area: ", "No known jamming area contains the position."
NONE_EARLIER, ON_VESSEL, ELSEWHERE = "No earlier incident on this vessel.", " on this vessel.", " with the same pattern on other vessels."
READS = "The pattern classifier reads this window as "
#: The classifier's question: its answers and what each stands for.
QUESTION = {
    "normal_track": "The vessel moves as its reports say.",
    "teleport_jump": "The position jumps farther than the vessel could go.",
    "gradual_drift": "The position drifts away from what speed and course lead to.",
    "freeze_replay": "Positions stand still or repeat while speed is told.",
    "impossible_kinematics": "Speed, course and positions contradict each other.",
}


@F.pandas_udf(DoubleType())
def exact_mean(values: pd.Series) -> pd.Series:
    """Mean of an array without nulls, from the exact sum: it does not depend on the order, so that no digit of a text does. Null for an empty array."""
    return pd.Series([None if not len(v) else math.fsum(v) / len(v) if np.isfinite(v).all() else np.mean(v) for v in values], dtype=float)


def track_numbers(windows: DataFrame) -> DataFrame:
    """mmsi, window_index and the numbers of a summary, of windows with their steps."""
    keys = ["mmsi", "window_index"]
    whole = Window.partitionBy(*keys)
    stands = valid_step() & (F.col("implied") <= FREEZE_IMPLIED) & (F.col("sog") > FREEZE_IMPLIED)
    told = valid_step() & F.col("sog").isNotNull()
    d = revisited(windows, *keys).withColumns({"_claim": F.coalesce(stands, F.lit(False)), "_told": told.cast("int"), "_turn": angle_between(F.lag("cog").over(chunk()), F.col("cog"))})
    d = d.withColumns({"_island": F.sum((~F.col("_claim")).cast("int")).over(chunk()), "_i": F.sum("_told").over(chunk()) - 1, "_m": F.sum("_told").over(whole)})
    d = d.withColumn("_run", F.count_if("_claim").over(Window.partitionBy(*keys, "_island")))
    third = F.greatest(F.lit(1), F.floor(F.col("_m") / 3))
    mean = lambda test: F.avg(F.when((F.col("_told") == 1) & test, F.col("implied") - F.col("sog")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    most = lambda test, c: zero(F.max(F.when(test, c)))
    valid = valid_step()
    n = d.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.max(seconds("received_at")) - F.min(seconds("received_at"))) / 60).alias("span"), F.collect_list("sog").alias("_sogs"), zero(F.max("sog")).alias("max_sog"), zero(F.avg(F.when(valid, F.col("implied")))).alias("mean_implied"), most(valid, F.col("implied")).alias("max_implied"),
        most(valid, F.col("step_km")).alias("max_step"), F.count_if("_claim").alias("claims"), F.max("_run").alias("longest"), F.count_if("revisited").alias("again"), most(valid, F.col("_turn")).alias("turn"), most(F.col("implied") > UNDERWAY_KNOTS, course_off()).alias("off"), zero(mean(F.col("_i") >= F.col("_m") - third) - mean(F.col("_i") < third)).alias("trend"),
    )
    n = n.withColumn("mean_sog", F.when(F.exists("_sogs", F.isnan), float("nan")).otherwise(zero(exact_mean("_sogs")))).drop("_sogs")
    return n.withColumn("ratio", F.col("max_implied") / F.greatest("max_sog", F.lit(1.0)))


def _formatted(form: Callable[[dict], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def text(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([form(r) for r in rows.to_dict("records")], dtype=object)

    return text


def track_summaries(windows: DataFrame) -> DataFrame:
    """mmsi, window_index, summary: what a track of reports looks like, line by line."""
    numbers = track_numbers(windows)
    text = _formatted(lambda r: "\n".join(SUMMARY).format(**r) if r["n"] > 1 else TOO_SHORT.format(**r))
    return numbers.select("mmsi", "window_index", text(F.struct(*(c for c in numbers.columns if c not in ("mmsi", "window_index")))).alias("summary"))


def _some(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def evidence_lines(found: DataFrame) -> DataFrame:
    """incident_id, lines: sentences on investigated flags (votes, n_freeze, n_track, zone_id, n_prior; elsewhere, label, sure and note where there)."""
    there = lambda c, kind: F.col(c) if c in found.columns else F.lit(None).cast(kind)
    named = F.transform(F.filter(F.split("votes", r"\+"), lambda v: v != ""), lambda v: F.coalesce(*(F.when(v == k, text) for k, text in DETECTORS.items()), v))
    prior, elsewhere, label, sure, note = F.coalesce("n_prior", F.lit(0)), F.coalesce(there("elsewhere", "long"), F.lit(0)), there("label", "string"), there("sure", "double"), there("note", "string")
    lines = [
        F.when(F.size(named) > 0, F.concat(F.lit(FIRED), F.array_join(named, ", "), F.lit("."))),
        F.when(F.col("n_freeze") >= 3, F.concat(F.col("n_freeze").cast("string"), F.lit(" of "), F.greatest(F.col("n_track") - 1, F.lit(0)).cast("string"), F.lit(REPEATED))),
        F.when(F.col("zone_id").isNotNull(), F.concat(F.lit(IN_AREA), F.col("zone_id").cast("string"), F.lit("."))).otherwise(IN_NO_AREA),
        F.when(prior == 0, NONE_EARLIER).otherwise(F.concat(_some(prior, "earlier incident"), F.lit(ON_VESSEL))),
        F.when(elsewhere > 0, F.concat(_some(elsewhere, "incident"), F.lit(ELSEWHERE))),
        F.when(label.isNotNull(), F.concat(F.lit(READS), F.replace(label, F.lit("_"), F.lit(" ")), F.when(sure.isNotNull(), F.concat(F.lit(" ("), F.round(sure * 100).cast("int").cast("string"), F.lit("%)."))).otherwise("."))),
        F.when(F.trim(note) != "", note),
    ]
    return found.select("incident_id", F.filter(F.array(*lines), lambda x: x.isNotNull()).alias("lines"))


def vote_rows(found: DataFrame) -> DataFrame:
    """incident_id, detector, fired, value, threshold: one row a detector; a speed jump only where it fired."""
    votes = F.split("votes", r"\+")
    fired = lambda k: F.array_contains(votes, k)
    row = lambda name, yes, value, threshold: F.struct(F.lit(DETECTORS[name]).alias("detector"), yes.alias("fired"), value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"))
    nothing = F.lit(None)
    rows = [row("prediction_error", fired("prediction_error"), F.col("score"), None), row("freeze_replay", fired("freeze_replay") | (F.col("n_freeze") >= 3), F.col("n_freeze"), 3), F.when(fired("speed_jump"), row("speed_jump", F.lit(True), nothing, None))]
    return found.select("incident_id", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def list_lines(incidents: DataFrame) -> DataFrame:
    """incident_id, line: a row of the console's list (tier, hypothesis, confidence, mmsi, flagged_at)."""
    form = _formatted(lambda r: f"{r['id']:>8}  {r['tier'] or '-'}  {r['hypothesis'] or 'untracked':<18}  {'  -  ' if r['confidence'] != r['confidence'] or r['confidence'] is None else format(r['confidence'], '.2f').rjust(5)}  {r['mmsi']}  {r['at']}")
    at = F.date_format("flagged_at", "yyyy-MM-dd HH:mm")
    return incidents.select("incident_id", form(F.struct(F.col("incident_id").cast("string").alias("id"), "tier", "hypothesis", "confidence", F.col("mmsi").cast("string").alias("mmsi"), at.alias("at"))).alias("line"))


def review_lines(stats: DataFrame) -> DataFrame:
    """hypothesis, line: a row of the table of reviews (hypothesis, reviewed, unclear, correct, precision)."""
    form = _formatted(lambda r: f"{r['hypothesis']:<20} {r['reviewed']:>6} {r['unclear']:>6} {r['correct']:>6} {'n/a' if r['precision'] is None or r['precision'] != r['precision'] else format(r['precision'], '.2f'):>6}")
    return stats.select("hypothesis", form(F.struct("hypothesis", "reviewed", "unclear", "correct", "precision")).alias("line"))


def question() -> Column:
    """The classifier's question as a constant JSON document."""
    criteria = F.map_from_arrays(F.array(*map(F.lit, QUESTION)), F.array(*map(F.lit, QUESTION.values())))
    return F.to_json(F.struct(F.struct(F.lit("choice").alias("type"), criteria.alias("criteria")).alias("pattern")))


def model_version(name: str, epoch: int | None, changed_at: float) -> str:
    """The version under which a model's scores are counted, from its file's name, epoch and time of change in seconds."""
    return "@".join((name if epoch is None else f"{name}#{epoch}", str(int(changed_at))))
