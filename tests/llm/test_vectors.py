"""op11 and op13 against plain versions: ties, copies, repeated ids, other lengths, unfit vectors, empty tables, clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import queries
from wakeline.llm.centroids import cluster, distances, reassign, scan
from wakeline.llm.topk import exact_top_k

SHAPE = "vec_id long, embedding array<float>, v string, score string, rank string, cluster string, chunk string"
BAD = [None, [None, 1.0], [float("nan"), 0.0], [float("inf"), 0.0], [-float("inf"), 1.0]]


def _fit(v, width=None):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (width is None or len(v) == width)


def _table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", "x") for i, v in rows], SHAPE)


def _ints(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


def plain_top(rows, k, every):
    own = [(i, _ints(v)) for i, v in rows if i is not None and _fit(v)]
    out = []
    for n, (i, q) in enumerate(own):
        if i % every == 0:
            met = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(own) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(met[:k])]
    return sorted(out)


def _vectors(seed, n, width, steps):
    rng = random.Random(seed)
    return [[rng.randrange(-steps, steps + 1) / steps for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize(("lists", "block"), [(1, 1 << 19), (2, 1 << 19), (3, 16)])
def test_top_k_equals_plain(spark, lists, block):
    v = _vectors(1, 160, 5, 2)
    rows = list(enumerate(v)) + [(i + 1000, v[i % 4]) for i in range(60)] + [(20, v[3]), (20, v[3]), (20, v[9]), (None, v[0])]
    rows += [(300 + i, b) for i, b in enumerate(BAD)] + [(400, []), (410, []), (420, [0.5]), (430, [0.0] * 5), (440, [2.0, 1.0])]
    got = exact_top_k(_table(spark, rows), F.col("vec_id") % 10 == 0, 7, lists, block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 7, 10)


def test_top_k_large_components_stay_exact(spark):
    rows = [(i, [16000.0 - i, -15000.0 + i, 3.0]) for i in range(30)] + [(50, [1e30, 0.0, 0.0])]
    got = exact_top_k(_table(spark, rows), F.col("vec_id") % 10 == 0, 4)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows[:-1], 4, 10)


def test_top_k_of_few_and_none(spark):
    assert exact_top_k(_table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert exact_top_k(_table(spark, [(10, [1.0])]), F.col("vec_id") % 10 == 0).count() == 0
    assert exact_top_k(_table(spark, [(3, [1.0]), (4, [2.0])]), F.col("vec_id") % 10 == 0).count() == 0
    got = exact_top_k(_table(spark, [(10, [1.0]), (20, [1.0]), (1, [-1.0])]), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == [(10, 1, 20, 1048576), (10, 2, 1, -1048576), (20, 1, 10, 1048576), (20, 2, 1, -1048576)]


def test_queries_on_small_tables(spark, tmp_path):
    rows = [(i, v) for i, v in zip(range(0, 5000, 25), _vectors(5, 200, 64, 3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, queries.op11_uniform_threshold_top_k(spark, str(tmp_path)).collect())) == plain_top(rows, 10, 100)
    assert sorted(map(tuple, queries.op13_hamerly_clustering(spark, str(tmp_path)).collect())) == plain_clusters(rows, 8, 10, 64, 3)


def plain_clusters(rows, clusters, rounds, width, seed):
    own = [(i, _ints(v)) for i, v in rows if i is not None and _fit(v, width)]
    first = sorted(own, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    at = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        near = [min(range(len(at)), key=lambda j: (far(v, at[j]), j)) for _, v in own]
        if n < rounds:
            for j in range(len(at)):
                mine = [v for (_, v), c in zip(own, near) if c == j]
                if mine:
                    at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, c, far(v, at[c])) for (i, v), c in zip(own, near)]
    whole = sum(d for *_, d in found)
    return sorted((i, c, d, sum(e for _, k, e in found if k == c), whole, hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize("steps", [1, 3, 40])
def test_clusters_equal_plain(spark, steps):
    v = _vectors(2, 300, 4, steps)
    rows = list(enumerate(v)) + [(i, v[7]) for i in range(500, 600)] + [(7, v[8]), (7, v[7]), (None, v[1]), (900, v[0][:3]), (901, []), (902, [0.0] * 4)]
    rows += [(800 + i, b) for i, b in enumerate([None, [None, 1.0, 1.0, 1.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 1.0, 1.0]])]
    got = cluster(_table(spark, rows).repartition(3), 6, 5, 4, 9)
    assert sorted(map(tuple, got.collect())) == plain_clusters(rows, 6, 5, 4, 9)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wakeline_")]


def test_clusters_of_few_and_none(spark):
    assert cluster(_table(spark, []), 3, 2, 2).count() == 0
    assert cluster(_table(spark, [(1, None), (2, [1.0])]), 3, 2, 2).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert sorted(map(tuple, cluster(_table(spark, rows), 3, 2, 2, 1).collect())) == plain_clusters(rows, 3, 2, 2, 1)


def test_bounds_keep_the_clusters_and_spare_scans():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 30, (500, 8)) for c in (-900, -100, 700)]).astype(np.int32)
    before = x[[0, 500, 1000]].astype(np.int64)
    near, upper, lower = scan(x, before)
    scanned = []
    for _ in range(6):
        sums = np.array([x[near == j].sum(0) // max(1, (near == j).sum()) for j in range(3)])
        near, upper, lower, n = reassign(x, near, upper, lower, before, sums)
        d = distances(x, sums)
        assert (near == d.argmin(1)).all()
        own, second = np.sqrt(d.min(1)), np.sqrt(np.partition(d, 1, axis=1)[:, 1])
        assert (upper >= own).all() and (lower <= second).all()
        scanned.append(n)
        before = sums
    assert scanned[-1] == 0


def test_distances_beyond_doubles_are_exact():
    x = np.array([[1 << 24, -(1 << 24)], [3, 5]], np.int64)
    c = np.array([[-(1 << 24), 1 << 24], [1, 1]], np.int64)
    assert distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
