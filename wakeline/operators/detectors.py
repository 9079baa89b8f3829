"""Votes of the detectors, and the report of a window that is flagged."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.windows import freeze_score, scoreable
from wakeline.settings import FREEZE_VOTE, MAX_GAP_S


def votes(df: DataFrame, a: float, jump: float | None = None) -> DataFrame:
    """Adds freeze, jump and `votes` (a '+' joined, sorted list) and n_votes; thresholds are strict and NaN never votes."""
    over = lambda c, t: F.coalesce(~F.isnan(c) & (F.col(c) > t), F.lit(False))
    scored = df.withColumns({"freeze": freeze_score(), "jump": F.abs(F.coalesce("sog_change", F.lit(0.0)))})
    named = [("freeze_replay", over("freeze", FREEZE_VOTE)), ("prediction_error", over("error", a))] + ([("speed_jump", over("jump", jump))] if jump is not None else [])
    which = F.filter(F.array(*(F.when(x, F.lit(k)) for k, x in named)), lambda x: x.isNotNull())
    return scored.withColumn("_v", which).withColumn("votes", F.array_join("_v", "+")).withColumn("n_votes", F.size("_v")).drop("_v")


def flagged(df: DataFrame, b: float, min_votes: int = 1, max_gap_s: float = MAX_GAP_S, cutoff: Column | None = None) -> DataFrame:
    """The strongest report (votes, error, place) of each window with enough votes, and its tier.

    Only reports after the cutoff whose step can be judged are looked at.
    """
    df = df.where(scoreable(max_gap_s)) if cutoff is None else df.where(scoreable(max_gap_s) & (F.col("received_at") > cutoff))
    best = Window.partitionBy("mmsi", "window_index").orderBy(F.desc("n_votes"), F.desc("error"), F.desc("place"))
    top = df.where(F.col("n_votes") >= min_votes).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return top.withColumn("tier", F.when(F.contains("votes", F.lit("prediction_error")) & (F.col("error") >= b), "B").otherwise("A"))
