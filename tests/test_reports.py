"""Histograms at their edges, shares and thresholds at their ends, stored arrays, the classifier's report."""

import math
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from wakeline.operators import classifier
from wakeline.operators.reports import BINS, EDGES, expected_flags, histogram_array, log_histogram, merged_arrays, score_at_shares, share_above, stored_histogram, threshold_for_share


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def hist(spark, counts):
    return spark.createDataFrame(list(counts.items()), "bin int, n long")


def plain_bin(x):
    return min(max(bisect_right(EDGES, x) - 1, 0), BINS - 1)


def test_each_edge_stands_in_its_own_bin(spark):
    got = {r.bin: r.n for r in log_histogram(frame(spark, EDGES[:-1]), F.col("x")).collect()}
    assert got == {i: 1 for i in range(BINS)}
    below = {r.bin: r.n for r in log_histogram(frame(spark, [math.nextafter(e, 0) for e in EDGES[1:]]), F.col("x")).collect()}
    assert below == {i: 1 for i in range(BINS)}


def test_random_values_and_ends(spark):
    rng = random.Random(2)
    values = [10 ** rng.uniform(-8, 4) for _ in range(3000)] + [0.0, -3.0, 1e300, 5e-324]
    want = {}
    for v in values:
        want[plain_bin(v)] = want.get(plain_bin(v), 0) + 1
    assert {r.bin: r.n for r in log_histogram(frame(spark, [*values, math.nan, math.inf, -math.inf]), F.col("x")).collect()} == want


def test_share_above_at_its_ends(spark):
    h = hist(spark, {3: 5, 7: 15})
    share = lambda t: share_above(h, t).first().share
    assert [share(t) for t in (-1.0, 0.0, EDGES[0], EDGES[3], EDGES[4], EDGES[7], EDGES[8], EDGES[-1], 1e9)] == pytest.approx([1, 1, 1, 1, 0.75, 0.75, 0, 0, 0])
    middle = math.sqrt(EDGES[7] * EDGES[8])
    assert share(middle) == pytest.approx(0.375)
    assert share_above(hist(spark, {3: 1}).where("n > 5"), 0.1).first().share == 0.0
    assert share_above(hist(spark, {3: 1}).where("n > 5"), 0.0).first().share == 0.0


def test_threshold_turns_share_around(spark):
    rng = random.Random(3)
    h = hist(spark, {b: rng.randrange(1, 99) for b in rng.sample(range(BINS), 40)})
    for r in score_at_shares(h, [0.5, 0.1, 0.003]).collect():
        assert share_above(h, r.threshold).first().share == pytest.approx(r.share)
        assert threshold_for_share(h, r.share).first().threshold == pytest.approx(r.threshold)
    assert threshold_for_share(h.where("n < 0"), 0.1).count() == 0 or threshold_for_share(h.where("n < 0"), 0.1).first().threshold is None
    for bad in (0.0, 1.0, -0.1):
        with pytest.raises(ValueError):
            threshold_for_share(h, bad)


def test_stored_arrays_add_up_to_the_whole(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), rng.choice([0, 1, 2]), 10 ** rng.uniform(-6, 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "version string, cycle int, x double")
    parts = histogram_array(df, F.col("x"), "version", "cycle")
    whole = {r.version: r.histogram for r in histogram_array(df, F.col("x"), "version").collect()}
    assert {r.version: r.histogram for r in merged_arrays(parts, "version").collect()} == whole
    assert sum(map(sum, whole.values())) == 500 and all(len(h) == BINS for h in whole.values())
    assert histogram_array(df.where("x < 0"), F.col("x")).first().histogram == [0] * BINS
    with pytest.raises(Exception, match="bins, not"):
        merged_arrays(parts.withColumn("histogram", F.slice("histogram", 1, 119))).collect()


def test_stored_histogram_of_a_version_and_time(spark):
    stats = spark.createDataFrame([("m", "2024-01-04 00:00:00", [1] * BINS), ("m", "2024-01-01 00:00:00", [1] * BINS), (None, "2024-01-03 00:00:00", [2] * BINS), ("m", "2024-01-05 00:00:00", [4] * BINS), ("m", "2024-01-02 12:00:00", [8] * BINS)], "model_version string, cycle_at string, histogram array<long>").withColumn("cycle_at", F.to_timestamp("cycle_at"))
    as_of = F.to_timestamp(F.lit("2024-01-04 00:00:00"))
    count = lambda v: {r.n for r in stored_histogram(stats, v, as_of).collect()}
    assert (count("m"), count(None), count("other")) == ({9}, {2}, set())
    out = expected_flags(stored_histogram(stats, "m", as_of), EDGES[60]).first()
    assert (out.flag_share, out.reports_scored, out.expected_flags) == (pytest.approx(0.5), 9 * BINS, pytest.approx(4.5 * BINS))
    assert expected_flags(stored_histogram(stats, "other", as_of), 1.0).first().expected_flags == 0


LABELS = ["n", "a", "b"]
ROWS = [("n", "n", [0.7, 0.2, 0.1], [1.0, 0.0, 0.0]), ("n", "a", [0.3, 0.5, 0.2], [0.8, 0.1, 0.1]), ("a", "a", [0.0, 2.0, 0.0], [0.0, 1.0, 0.0]), ("b", "n", [0.6, None, 0.4], [0.1, 0.1, 0.8]), ("b", "b", [0.05, 0.05, 0.9], [0.0, 0.0, 1.0])]


def test_classifier_numbers(spark):
    df = spark.createDataFrame(ROWS, "gold string, choice string, p array<double>, q array<double>")
    scored = classifier.scored(df)
    scale = lambda v: [x / sum(1e-6 if y is None else y for y in v) for x in (1e-6 if y is None else y for y in v)]
    pq = [(scale(p), scale(q)) for _, _, p, q in ROWS]
    mean = lambda f: sum(f(p, q) for p, q in pq) / len(pq)
    kl = lambda p, q: sum(b * math.log(min(max(b / a if a else math.inf if b else math.nan, 1e-12), 1e4)) for a, b in zip(p, q) if b)
    out = classifier.overall(scored).first()
    assert out.accuracy == pytest.approx(0.6)
    assert out.soft_accuracy == pytest.approx(mean(lambda p, q: sum(a * b for a, b in zip(p, q))))
    assert out.brier == pytest.approx(mean(lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q))))
    assert out.tv == pytest.approx(mean(lambda p, q: sum(abs(a - b) for a, b in zip(p, q)) / 2))
    assert out.kl == pytest.approx(mean(kl))
    assert {r.gold: (r.n, r.a, r.b) for r in classifier.confusion_matrix(df, LABELS).collect()} == {"n": (1, 1, 0), "a": (0, 1, 0), "b": (1, 0, 1)}
    assert {r.gold: (r.n, r.accuracy) for r in classifier.class_accuracy(df, [*LABELS, "c"]).collect()} == {"n": (2, 0.5), "a": (1, 1.0), "b": (2, 0.5), "c": (0, 0.0)}
    assert tuple(classifier.error_rates(df, "n").first()) == (0.5, pytest.approx(1 / 3))
    assert tuple(classifier.error_rates(df.where("gold = 'n'"), "n").first()) == (0.5, None)
    assert [tuple(r) for r in classifier.by_confidence(scored, [0.0, 0.65, 0.95, 1.1]).orderBy("min_confidence").collect()] == [(0.0, 1.0, 0.6), (0.65, 0.6, 1.0), (0.95, 0.2, 1.0), (1.1, 0.0, None)]
    bins = {r.bin: (r.n, r.accuracy) for r in classifier.calibration(scored).collect()}
    assert sum(n for n, _ in bins.values()) == 5 and bins[9] == (1, 1.0) and bins[8] == (1, 1.0)
    assert classifier.calibration_error(scored).first().ece == pytest.approx(sum(abs(s - h) for s, h in zip((0.7, 0.5, 1.0, 0.6, 0.9), (1, 0, 1, 0, 1))) / 5, abs=1e-5)
    moved = df.withColumns({"fastest": F.when(F.col("gold") == "n", 0.5).otherwise(9.0), "longest": F.lit(0.01)})
    assert {(r.gold, r.motion): r.n for r in classifier.by_motion(moved).collect()} == {("n", "stationary"): 2, ("a", "moving"): 1, ("b", "moving"): 2}
