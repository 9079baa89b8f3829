"""op12 against a plain version: copies, nulls, short and very long texts, ties, repeated ids, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib

import pytest

from wakeline.llm import queries
from wakeline.llm.resampling import resample

SHAPE = "doc_id long, text string, k1 string, copies string, weight string, rank string, score string, n_features string"
LOWER = {i: i + 32 for i in range(65, 91)}


def _features(text, buckets, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(docs, target, percent=10, least=20, seed=2024, buckets=10000, longest=1):
    own = [(i, *_features(t, buckets, longest)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, f in own:
        for b in f:
            s[b] += 1
    for _, x in target:
        for b in _features(x, buckets, longest)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    drawn = len(able) * percent // 100
    out = [(i, f, w, x, r + 1 if r < drawn else None) for r, (i, _, f, w, x) in enumerate(able)]
    return sorted(out + [(i, f, w, x, None) for i, n, f, w, x in rows if n < least], key=repr)


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], SHAPE)


def _run(spark, docs, target, **how):
    got = resample(_table(spark, docs), _table(spark, target), **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=repr)


WORDS = "alpha Beta gamma delta Éclair été zeta 7 x9 日本 theta iota".split()
DOCS = [(i, " ".join(WORDS[(i * j + j) % len(WORDS)] for j in range(i % 45))) for i in range(200)]
DOCS += [(1000 + i, "one copy of a text with words " * 4) for i in range(150)]
DOCS += [(7, None), (8, ""), (9, "-- __ !"), (7, "again the same number"), (None, "no number " * 15), (10, "long " * 30000), (1000, "one copy of a text with words " * 4)]
TARGET = [(1, "gamma gamma 日本 theta"), (2, None), (3, "words of a copy")]


@pytest.mark.parametrize("how", [{}, {"percent": 50, "least_words": 3, "buckets": 97, "seed": 5}, {"percent": 100, "least_words": 2, "longest": 2}, {"buckets": 70001, "percent": 30}])
def test_equals_plain(spark, how):
    names = {"least_words": "least"}
    assert _run(spark, DOCS, TARGET, **how) == plain(DOCS, TARGET, **{names.get(k, k): v for k, v in how.items()})


def test_empty_tables(spark):
    assert _run(spark, [], TARGET) == []
    assert _run(spark, DOCS[:50], []) == plain(DOCS[:50], [])
    assert _run(spark, [(1, None)], []) == plain([(1, None)], [])


def test_query_on_small_tables(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TARGET, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, queries.op12_importance_resampling(spark, str(tmp_path)).collect()), key=repr) == plain(DOCS, TARGET)
