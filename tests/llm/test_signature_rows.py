"""op4's signatures: their exchange follows the texts, not the number of buckets; equal sets are dealt once."""

import random

import numpy as np
from pyspark.sql import functions as F

from wakeline.llm import jaccard_join
from wakeline.llm.common import keyed
from wakeline.llm.jaccard_join import Frequencies


def _texts(n, words=300):
    r = random.Random(5)
    return [" ".join(f"w{r.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def test_many_buckets_do_not_make_the_exchange_larger(spark):
    docs = keyed(spark.createDataFrame(list(enumerate(_texts(400))), "doc_id long, text string").coalesce(1)).withColumn("node", F.xxhash64("doc_id", "text_hash"))
    frequent = Frequencies(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def sent(buckets):
        got = jaccard_join._dealt(docs, buckets, 1.0, frequent).toArrow()
        return sum(len(x) for c in got.column_names if str(got.schema.field(c).type).startswith(("binary", "large_binary")) for x in got[c].to_pylist())

    assert sent(300) < 1.1 * sent(4)


def test_copies_are_dealt_once_and_all_get_their_component(spark, monkeypatch):
    texts = _texts(30, 60)
    near = [t + " more" for t in texts[:10]]
    rows = [(100 * k + i, t if k % 2 else t.upper() + " ") for k in range(12) for i, t in enumerate(texts)] + [(5000 + i, t) for i, t in enumerate(near)] + [(9000, None), (9001, "")]
    seen, dealt = [], jaccard_join._dealt
    monkeypatch.setattr(jaccard_join, "_dealt", lambda docs, *a: seen.append(sum(bool((r.text or "").strip()) for r in docs.select("text").collect())) or dealt(docs, *a))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d % 100 if d < 5000 else d - 5000 if d < 9000 else d for d, _ in rows}
    assert seen == [40]


def test_estimated_frequencies_steer_cost_only(spark, monkeypatch):
    r, texts = random.Random(6), _texts(60, 80)
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        w = t.split()
        for _ in range(i % 5):
            w[r.randrange(len(w))] = "x"
        rows.append((100 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs).collect()}
    sets = jaccard_join.shingle_sets([t.encode() for _, t in rows])
    s = np.unique(np.concatenate(sets))
    wrong = Frequencies(s, np.random.default_rng(1).integers(0, 1000, len(s)))
    for other in (Frequencies(s[:0], np.zeros(0, np.int64)), wrong):
        monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *_: other)
        assert {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs).collect()} == one
    assert len(set(one.values())) < len(one) - 20
