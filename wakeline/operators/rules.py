"""Decision rules as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.settings import A_RANGE, B_OVER_A


def hypothesis(df: DataFrame, a: float | None, label: Column | None = None, sure: Column | None = None) -> DataFrame:
    """Adds hypothesis, confidence and status from zone_id, score, votes, n_freeze, stationary and n_prior.

    A classifier's ``label`` with its confidence ``sure`` can speak against a weak flag, lift the cap of a
    single vote by agreeing, or set it by contradicting (a freeze read off the track is not contradicted).
    """
    label, sure = (F.lit(None).cast("string"), F.lit(None).cast("double")) if label is None or sure is None else (label, sure)
    only_error = F.col("votes") == "prediction_error"
    one = F.size(F.filter(F.split("votes", r"\+"), lambda v: v != "")) == 1
    other = (F.col("votes") != "") & ~only_error
    spoof = F.coalesce((sure >= 0.7) & (label != "normal_track"), F.lit(False))
    weak = only_error & (F.col("score") <= 2 * (a or 0.0)) & F.col("stationary") & ~spoof
    cases: list[tuple[Column, str, float, bool]] = [
        (F.col("zone_id").isNotNull(), "jamming", 0.85, False),
        (F.lit(a is None), "unresolved", 0.0, False),
        ((F.col("score") < (a or 0.0)) & ~other, "benign", 0.75, False),
        (F.col("n_freeze") >= 3, "freeze_replay", 0.8, True),
        (weak, "benign", 0.75, False),
        (F.col("n_prior") == 0, "targeted_spoof", 0.72, True),
        (F.lit(True), "equipment_fault", 0.55, True),
    ]
    name, told = F.lit(None).cast("string"), F.lit(None).cast("double")
    for test, what, how, capped in reversed(cases):
        test = F.coalesce(test, F.lit(False))
        name = F.when(test, what).otherwise(name)
        vote = pattern_vote(label, sure, F.lit(what))
        held = one & ~vote.eqNullSafe("agrees")
        if what != "freeze_replay":
            held = held | vote.eqNullSafe("contradicts")
        told = F.when(test, F.when(held, F.lit(min(how, 0.5))).otherwise(how) if capped else F.lit(how)).otherwise(told)
    return df.withColumns({"hypothesis": name, "confidence": told}).withColumn("status", F.when(F.col("confidence") >= 0.7, "reported").otherwise("escalated"))


def benign_weight(stationary: Column, ratio: Column, corroborated: Column, prior_benign: Column) -> Column:
    parts = ((stationary, 0.35), (ratio < 2, 0.25), (~corroborated, 0.15), (prior_benign, 0.25))
    return F.round(F.least(F.lit(0.9), sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.0))), 3)


def priority(confidence: Column, strength: Column, scope: Column, benign: Column) -> Column:
    """Weighted sum, held at three quarters of what it is without doubt, and at 1."""
    spread = F.when(scope == "area", 1.0).when(scope == "isolated", 0.7).otherwise(0.5)
    plain = 0.35 * confidence + 0.25 * strength + 0.15 * spread + 0.25
    return F.round(F.least(F.lit(1.0), F.greatest(plain - 0.25 * benign, 0.75 * plain)), 3)


def strength(score: Column, a: float | None, b: float | None) -> Column:
    """Where a score lies between the thresholds, 0 to 1; half without thresholds."""
    if a is None or b is None:
        return F.lit(0.5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - a) / (b - a)))


# Fixed values of threshold decisions.
LEAST_REPORTS, MOST_STEP, LEAST_MOVE = 50_000, 3.0, 0.25


def check_pair(a: float, b: float) -> None:
    if not A_RANGE[0] <= a <= A_RANGE[1] or b < B_OVER_A * a:
        raise ValueError(f"A must lie in {A_RANGE} and B be at least {B_OVER_A} x A")


def threshold_decision(df: DataFrame) -> DataFrame:
    """Adds `decision` (update, keep, or the rule a proposal breaks) from a, b, reports, offline (array), now_a, now_b and new_model."""
    a, b, now_a, now_b = map(F.col, ("a", "b", "now_a", "now_b"))
    bound = a.between(*A_RANGE) & b.between(a * B_OVER_A, F.lit(A_RANGE[1] * 10))
    offline = F.exists("offline", lambda v: (v != 0) & (F.abs(a - v) / v < 0.01))
    same = now_a.isNotNull() & ~F.col("new_model")
    step = a.between(now_a / MOST_STEP, now_a * MOST_STEP)
    small = (F.abs(a - now_a) / now_a < LEAST_MOVE) & (F.abs(b - now_b) / now_b < LEAST_MOVE)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return df.withColumn("decision", F.when(no(bound), "out_of_range").when((F.col("reports") < LEAST_REPORTS) & no(offline), "too_few_reports").when(same & no(step), "step_too_wide").when(same & small, "keep").otherwise("update"))


def budget_proposal(df: DataFrame) -> DataFrame:
    """Adds action, a and b: the scores at the budgeted shares, held in range and near the thresholds in use.

    Reads score_a, score_b (null where a budget has no score), reports, now_a and new_model; what is kept has null a and b.
    """
    now = F.when(~F.col("new_model"), F.col("now_a"))
    ratio = lambda b, a: F.greatest(b, a * B_OVER_A)
    bound = F.least(F.greatest("score_a", F.lit(A_RANGE[0])), F.lit(A_RANGE[1]))
    a = F.least(F.greatest(bound, now / MOST_STEP), now * MOST_STEP)
    b = ratio(ratio(F.col("score_b"), bound), a)
    update = F.coalesce((F.col("reports") >= LEAST_REPORTS) & F.col("score_a").isNotNull() & F.col("score_b").isNotNull(), F.lit(False))
    return df.select("*", F.when(update, "update").otherwise("keep").alias("action"), F.when(update, a).alias("a"), F.when(update, b).alias("b"))


def training_windows(coverage: DataFrame, now: Column) -> DataFrame:
    """initial_ready, initial_end, rolling_ready and rolling_start of a coverage (first_at, last_at), as of ``now``.

    The first window takes two weeks of reports, and the fifteenth day over; the rolling one is the last two weeks.
    """
    first, last, weeks = F.col("first_at"), F.col("last_at"), F.expr("interval 14 days")
    ready = (last >= first + weeks) & (now >= first + F.expr("interval 15 days"))
    return coverage.select(ready.alias("initial_ready"), (first + weeks).alias("initial_end"), (first <= last - weeks).alias("rolling_ready"), (last - weeks).alias("rolling_start"))


def scope(neighbours: Column, cluster: Column) -> Column:
    return F.when(cluster >= 3, "area").when(neighbours >= 3, "isolated").otherwise("insufficient")


#: Which labels of the classifier speak for a hypothesis (fixed values).
SUPPORTS = {"freeze_replay": ["freeze_replay"], "targeted_spoof": ["teleport_jump", "gradual_drift", "impossible_kinematics"]}


def pattern_vote(label: Column, sure: Column, hypothesis: Column) -> Column:
    """agrees, contradicts or null, from a classifier that is sure enough."""
    speaks = [F.when((hypothesis == h) & label.isin(names), "agrees") for h, names in SUPPORTS.items()]
    return F.when(sure >= 0.7, F.when(label == "normal_track", "contradicts").otherwise(F.coalesce(*speaks)))


# What counts as a share in percent, and as a claim that spoofing is confirmed (test_stores.py lists both).
PERCENT = r"([0-9]{1,3}([.][0-9]+)?)[ \t\r\n\f]*%"
CONFIRMED = r"(?i)confirmed[ \t\r\n\f]+((gps|ais|gnss)[ \t\r\n\f]+)?spoof"


def report_issues(text: Column, mmsi: Column, hypothesis: Column, confidence: Column, verdict: Column) -> Column:
    """What a drafted text says against its incident, as an array of names; empty where it is clean."""
    percent = F.regexp_extract(text, PERCENT, 1)
    named = F.contains(text, hypothesis) | F.contains(text, F.replace(hypothesis, F.lit("_"), F.lit(" ")))
    tests = {
        "mmsi": ~F.contains(text, mmsi.cast("string")),
        "hypothesis": ~named,
        "status_open": text.rlike(r"\bOPEN\b"),
        "status_closed": text.rlike(r"\bCLOSED\b"),
        "confidence": (percent != "") & (F.abs(percent.try_cast("double") - confidence * 100) > 1),
        "confirmed": text.rlike(CONFIRMED) & ~verdict.eqNullSafe("confirmed_spoof"),
    }
    found = F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull())
    return F.when(F.coalesce(F.trim(text) == "", F.lit(True)), F.array(F.lit("empty"))).otherwise(found)
