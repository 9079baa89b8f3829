"""A classifier's report: confusion, rates, calibration and divergences, from arrays of probabilities.

Rows have gold and choice (labels), p and q (what the classifier gives each label, and what is right; in the order of
the labels). Both are scaled to 1; a probability that is missing counts as `LEAST`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1e-6
#: A ratio of probabilities is held within these.
RATIO = (1e-12, 1e4)


def _scaled(c: str) -> Column:
    held = F.transform(c, lambda v: F.coalesce(v, F.lit(LEAST)))
    return F.transform(held, lambda v: v / F.aggregate(held, F.lit(0.0), lambda s, x: s + x))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def scored(df: DataFrame) -> DataFrame:
    """Adds hit, sure (the highest probability), soft, brier, tv and kl of each row."""
    d = df.withColumns({"p": _scaled("p"), "q": _scaled("q")})
    each = lambda f: _sum(F.zip_with("p", "q", f))
    held = lambda r: F.least(F.greatest(r, F.lit(RATIO[0])), F.lit(RATIO[1]))
    return d.withColumns(
        {
            "hit": F.col("gold").eqNullSafe(F.col("choice")).cast("int"),
            "sure": F.array_max("p"),
            "soft": each(lambda a, b: a * b),
            "brier": each(lambda a, b: (a - b) * (a - b)),
            "tv": each(lambda a, b: F.abs(a - b)) / 2,
            "kl": each(lambda a, b: b * F.log(held(F.coalesce(F.try_divide(b, a), F.lit(RATIO[1]))))),
        }
    )


def overall(rows: DataFrame) -> DataFrame:
    """n, accuracy, soft_accuracy, brier, kl and tv over scored() rows; null without rows."""
    return rows.agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("soft").alias("soft_accuracy"), *(F.avg(c).alias(c) for c in ("brier", "kl", "tv")))


def confusion_matrix(df: DataFrame, labels: list[str]) -> DataFrame:
    """gold and one column of counts for each label that was chosen: every label has a row; other labels are left out."""
    grid = df.sparkSession.createDataFrame([(k,) for k in labels], "gold string")
    counts = df.where(F.col("gold").isin(labels)).groupBy("gold").pivot("choice", labels).count()
    return grid.join(counts, "gold", "left").fillna(0).select("gold", *labels)


def class_accuracy(df: DataFrame, labels: list[str]) -> DataFrame:
    """gold, n and accuracy of every label; 0 for one that never was right or never occurred."""
    grid = df.sparkSession.createDataFrame([(k,) for k in labels], "gold string")
    own = df.groupBy("gold").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("choice")).alias("_hit"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(own, "gold", "left").select("gold", n.alias("n"), (F.coalesce("_hit", F.lit(0)) / F.greatest(n, F.lit(1))).alias("accuracy"))


def error_rates(df: DataFrame, normal: str) -> DataFrame:
    """false_positive_rate (normal rows called something else) and miss_rate (other rows called normal); null without such rows."""
    own, said = F.col("gold") == normal, F.col("choice") == normal
    rate = lambda wrong, of: F.try_divide(F.count_if(of & wrong).cast("double"), F.count_if(of))
    return df.agg(rate(~F.coalesce(said, F.lit(False)), own).alias("false_positive_rate"), rate(F.coalesce(said, F.lit(False)), ~own).alias("miss_rate"))


def by_confidence(rows: DataFrame, levels: list[float]) -> DataFrame:
    """min_confidence, coverage and accuracy (null without rows) of the rows that are at least that sure, in one pass."""
    at = [F.struct(F.lit(t).alias("min_confidence"), F.avg((F.col("sure") >= t).cast("int")).alias("coverage"), F.avg(F.when(F.col("sure") >= t, F.col("hit"))).alias("accuracy")) for t in levels]
    return rows.agg(F.array(*at).alias("_l")).select(F.inline("_l"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, sure and accuracy (means) in bins of equal width, the right edge of each in it."""
    at = F.least(F.greatest(F.ceil(F.col("sure") * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("sure").alias("sure"), F.avg("hit").alias("accuracy"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """ece: the gaps between sureness and accuracy of the bins, weighed by their rows."""
    return calibration(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("sure") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def by_motion(df: DataFrame) -> DataFrame:
    """gold, motion, n, accuracy from `fastest` (knots told) and `longest` (km of a step): stationary below 1 knot and 0.1 km."""
    motion = F.when((F.col("fastest") < 1.0) & (F.col("longest") < 0.1), "stationary").otherwise("moving")
    return df.groupBy("gold", motion.alias("motion")).agg(F.count("*").alias("n"), F.avg(F.col("gold").eqNullSafe(F.col("choice")).cast("int")).alias("accuracy"))
