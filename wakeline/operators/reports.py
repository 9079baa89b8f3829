"""Histograms, shares, percentiles and precision."""

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.settings import HISTOGRAM
from wakeline.sources.tables import written

BINS, LOW, PER = HISTOGRAM["bins"], HISTOGRAM["low"], HISTOGRAM["per_decade"]


#: Edges of the bins: bin i holds what lies in [EDGES[i], EDGES[i + 1]).
EDGES = [10.0 ** (math.log10(LOW) + i * (1 / PER)) for i in range(BINS + 1)]


def edges() -> Column:
    return F.array(*map(F.lit, EDGES))


def log_bin(x: Column) -> Column:
    """The bin of a finite value; both ends take what lies beyond.

    A logarithm gives a first guess, and the literal edges beside it decide, so that an edge itself stands in its own bin.
    """
    guess = F.least(F.greatest(F.floor((F.log10(F.greatest(x, F.lit(LOW))) - F.log10(F.lit(LOW))) * PER), F.lit(0)), F.lit(BINS - 1)).cast("int")
    low, high = F.get(edges(), guess), F.get(edges(), guess + 1)
    own = F.when(x < low, guess - 1).when(x >= high, guess + 1).otherwise(guess)
    return F.least(F.greatest(own, F.lit(0)), F.lit(BINS - 1)).cast("int")


def _finite(x: str = "x") -> str:
    return f"{x} is not null and not isnan({x}) and abs({x}) < double('Infinity')"


def log_histogram(df: DataFrame, score: Column) -> DataFrame:
    """bin, n: fixed logarithmic bins; both ends take what lies beyond, null and what is not finite is left out."""
    x = df.select(score.cast("double").alias("x")).where(_finite())
    return x.groupBy(log_bin(F.col("x")).alias("bin")).agg(F.count("*").alias("n"))


def log_histogram_by(df: DataFrame, score: Column, key: Column) -> DataFrame:
    """log_histogram for each value of a key (null is one of them)."""
    x = df.select(key, score.cast("double").alias("x")).where(_finite())
    return x.groupBy(x.columns[0], log_bin(F.col("x")).alias("bin")).agg(F.count("*").alias("n"))


def _array(bins: DataFrame, *keys: str) -> DataFrame:
    """Counts by bin as one array of all bins, for each key."""
    held = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    return bins.groupBy(*keys).agg(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0))).alias("histogram"))


def histogram_array(df: DataFrame, score: Column, *keys: str) -> DataFrame:
    """`histogram`: the counts of all bins as one array, the form in which a cycle's histogram is stored; for each key, if any.

    Without keys there is always one row, also without values.
    """
    x = df.select(*keys, score.cast("double").alias("x")).where(_finite())
    return _array(x.groupBy(*keys, log_bin(F.col("x")).alias("bin")).agg(F.count("*").alias("n")), *keys)


def merged(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("bin").agg(F.sum("n").alias("n"))


def merged_arrays(stored: DataFrame, *keys: str) -> DataFrame:
    """Stored arrays added up place by place, for each key; an array of another length stops the query."""
    whole = F.when(F.size("histogram") == BINS, F.col("histogram")).otherwise(F.raise_error(F.concat(F.lit("a histogram has "), F.size("histogram").cast("string"), F.lit(f" bins, not {BINS}"))))
    return _array(stored.select(*keys, F.posexplode(whole).alias("bin", "_n")).groupBy(*keys, "bin").agg(F.sum("_n").alias("n")), *keys)


def stored_histogram(stats: DataFrame, version: str | None, as_of: Column, hours: int = 72) -> DataFrame:
    """bin, n of the cycles of a model version (null is one) in the hours up to ``as_of``."""
    own = stats.where(F.col("model_version").eqNullSafe(F.lit(version)) & (F.col("cycle_at") > as_of - F.make_interval(hours=F.lit(hours))) & (F.col("cycle_at") <= as_of))
    return own.select(F.posexplode("histogram").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0")


def edge(b: Column) -> Column:
    return F.get(edges(), b.cast("int"))


def shares_above(histogram: DataFrame) -> DataFrame:
    """lower_edge and share of the counts in a bin or above it; at most BINS rows, in one ordered window."""
    above = F.sum("n").over(Window.orderBy(F.desc("bin")))
    total = F.sum("n").over(Window.partitionBy())
    return histogram.select("bin", "n", edge(F.col("bin")).alias("lower_edge"), (above / total).alias("share"), (F.col("n") / total).alias("own"))


def threshold_for_share(histogram: DataFrame, target: float) -> DataFrame:
    """The least threshold above which no more than ``target`` of the counts lie, log-linear inside a bin; null without counts."""
    if not 0 < target < 1:
        raise ValueError("target lies between 0 and 1")
    crossed = shares_above(histogram).where(F.col("share") > target).agg(F.max_by(F.struct("bin", "own", "share"), "bin").alias("c")).select("c.*")
    low, high = F.log(edge(F.col("bin"))), F.log(edge(F.col("bin") + 1))
    return crossed.select(F.exp(high - (target - F.col("share") + F.col("own")) / F.col("own") * (high - low)).alias("threshold"))


def share_above(histogram: DataFrame, threshold: float) -> DataFrame:
    """Share of the counts above a threshold, log-linear inside its bin; 1 at the first edge or below, 0 at the last or above, 0 without counts."""
    if threshold <= EDGES[0] or threshold >= EDGES[-1]:
        inside = F.lit(1.0 if threshold <= EDGES[0] else 0.0)
    else:
        at = bisect_right(EDGES, threshold) - 1
        part = (math.log(EDGES[at + 1]) - math.log(threshold)) / (math.log(EDGES[at + 1]) - math.log(EDGES[at]))
        inside = F.when(F.col("bin") > at, 1.0).when(F.col("bin") == at, part).otherwise(0.0)
    return histogram.agg(F.coalesce(F.sum(F.col("n") * inside) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("share"))


def expected_flags(histogram: DataFrame, threshold: float) -> DataFrame:
    """flag_share at a threshold, reports_scored and the flags that it would have given."""
    n = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reports_scored"))
    return share_above(histogram, threshold).join(n).select(F.col("share").alias("flag_share"), "reports_scored", (F.col("share") * F.col("reports_scored")).alias("expected_flags"))


def score_at_shares(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, threshold for each of a few shares; the histogram is read once."""
    above = shares_above(histogram).select("bin", "share", "own")
    met = above.withColumn("s", F.explode(F.array(*map(F.lit, shares)))).where(F.col("share") > F.col("s")).groupBy("s").agg(F.max_by(F.struct("bin", "own", "share"), "bin").alias("c")).select("s", "c.*")
    low, high = F.log(edge(F.col("bin"))), F.log(edge(F.col("bin") + 1))
    return met.select(F.col("s").alias("share"), F.exp(high - (F.col("s") - F.col("share") + F.col("own")) / F.col("own") * (high - low)).alias("threshold"))


def review_precision(reviews: DataFrame, key: str) -> DataFrame:
    """key (blank or null: untracked), reviewed, unclear, correct and precision (null where nothing was clear) from `verdict`."""
    own = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("untracked")).alias(key)
    n = reviews.where("verdict is not null").groupBy(own).agg(F.count("*").alias("reviewed"), F.count_if(F.col("verdict") == "unclear").alias("unclear"), F.count_if(F.col("verdict") == "correct").alias("correct"))
    return n.withColumn("precision", F.try_divide("correct", F.col("reviewed") - F.col("unclear")))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy; 0 where a denominator is 0."""
    n = df.select(predicted.alias("p"), actual.alias("a")).agg(*(F.count_if(x).alias(k) for k, x in (("tp", F.expr("p and a")), ("fp", F.expr("p and not a")), ("fn", F.expr("not p and a")), ("tn", F.expr("not p and not a")))))
    ratio = lambda x, y: F.when(y != 0, x / y).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def classifier_report(df: DataFrame, sure: float) -> DataFrame:
    """gold, n, accuracy, brier, soft_accuracy, coverage and sure_accuracy from gold (place of the right class) and p (probabilities)."""
    top, right = F.array_max("p"), F.col("gold").cast("int")
    hit = (F.array_position("p", top) - 1 == F.col("gold")).cast("int")
    squared = F.aggregate(F.transform("p", lambda v, k: F.pow(v - (k == right).cast("int"), 2)), F.lit(0.0), lambda s, v: s + v)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return df.groupBy("gold").agg(F.count("*").alias("n"), mean(hit, "accuracy"), mean(squared, "brier"), mean(F.get("p", right), "soft_accuracy"), mean((top >= sure).cast("int"), "coverage"), mean(F.when(top >= sure, hit), "sure_accuracy"))


def percentiles(df: DataFrame, column: str, shares: list[float], per_decade: int = 1000) -> DataFrame:
    """p, value: exact percentiles (linear between ranks) of a column that is never negative.

    Counts of fine logarithmic bins tell which bins hold the wanted ranks; only these bins' values are ordered,
    each bin by itself and equal values as one, so that no task holds the column.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    binned = written(x.withColumn("bin", F.floor(F.log10(F.greatest("x", F.lit(1e-15))) * per_decade)), "percentiles")  # read twice
    bins = binned.groupBy("bin").agg(F.count("*").alias("n"))
    upto = bins.withColumn("_end", F.sum("n").over(Window.orderBy("bin"))).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    at = F.explode(F.array(*map(F.lit, shares))).alias("p")
    ranks = upto.select("bin", (F.col("_end") - F.col("n")).alias("_start"), "_end", "_all", at).withColumn("_r", (F.col("_all") - 1) * F.col("p"))
    wanted = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("_r"), F.ceil("_r"))))).where("rank >= _start and rank < _end").select("bin", "_start", "p", "_r", "rank")
    values = binned.join(F.broadcast(wanted.select("bin").distinct()), "bin").groupBy("bin", "x").agg(F.count("*").alias("n"))
    placed = values.withColumn("_to", F.sum("n").over(Window.partitionBy("bin").orderBy("x")))
    met = placed.join(F.broadcast(wanted), "bin").where("rank >= _start + _to - n and rank < _start + _to")
    share = F.when(F.col("rank") == F.floor("_r"), 1 - (F.col("_r") - F.floor("_r"))).otherwise(F.col("_r") - F.floor("_r"))
    return met.groupBy("p").agg(F.sum(F.col("x") * share).alias("value"))
