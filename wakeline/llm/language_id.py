"""Language ID by multilingual mixture inference.

Every language has a smoothed distribution of hashed byte trigrams of its lower-cased letters.
Expectation maximisation finds each document's language proportions from the likelihoods of its
trigrams; a language joins the set only if the likelihood rises by more than a penalty.

The distributions are fitted on at most SAMPLE_PER_LANG labelled documents of each language (drawn by
a hash of doc_id), so the model has at most languages x BUCKETS counts. Prediction reads whole texts.
A null text or one without letters gives `und` with score 0; a null lang is never learned; repeated
rows are judged one by one; without labelled rows every text is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import tidy

BUCKETS = 1 << 16
SAMPLE_PER_LANG = 3000
#: Languages that one model may have (its size is BUCKETS x languages); a parameter of identify().
MAX_LANGS = 400
#: Trigrams that overlap share evidence: three count as one observation.
OVERLAP = 3.0
PENALTY = 3.0

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_SPACE_GRAM = (((32 << 16 | 32 << 8 | 32) * 0x9E3779B1 & 0xFFFFFFFF) >> 16) & (BUCKETS - 1)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams and their counts; those of blanks alone are left out."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ", np.uint8).astype(np.uint32)
    code = ((a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    u, c = np.unique(code.astype(np.uint16), return_counts=True)
    real = u != _SPACE_GRAM
    return u[real], c[real].astype(np.float64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, c = grams(text)
            total.setdefault(lang, np.zeros(BUCKETS))[u] += c
    for lang, n in total.items():
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(n[full].astype(np.int64))], ["lang", "bucket", "n"])


def fit(docs: DataFrame, learn: Column, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket (rows) in each language (columns)."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(rows) > max_langs:
        raise ValueError(f"over {max_langs} languages: raise max_langs")
    if not rows:
        return [], np.zeros((BUCKETS, 0))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, SAMPLE_PER_LANG / n)) for k, n in rows.items()], "lang string, _share double")
    drawn = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("_share") * 1_000_000)
    counts = drawn.select("lang", "text").mapInArrow(tidy(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows)
    n = np.zeros((BUCKETS, len(langs)))
    n[counts["bucket"], counts["lang"].map({k: i for i, k in enumerate(langs)})] = counts["n"]
    n += 0.5
    return langs, np.log(n / n.sum(axis=0))


def _em(p: np.ndarray, c: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of a mixture of the columns of p."""
    pi, total = np.full(p.shape[1], 1 / p.shape[1]), c.sum()
    for _ in range(rounds):
        z = p @ pi
        pi = pi * ((c / z) @ p) / total
    return pi, float(c @ np.log(p @ pi))


def infer(u: np.ndarray, c: np.ndarray, log_p: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """Chosen languages, their proportions, and how sure the first is over the others alone."""
    lp = log_p[u]
    single = c @ lp
    best = int(np.argmax(single))
    sure = 1 / float(np.exp(np.clip((single - single[best]) / OVERLAP, -700, 0)).sum())
    chosen, pi, like = [best], np.ones(1), float(single[best])
    if len(single) == 1:
        return chosen, pi, sure
    p = np.exp(lp)
    cost = OVERLAP * (PENALTY + 0.5 * np.log(max(c.sum() / OVERLAP, 1)))
    everything, most = _em(p, c)
    if most - like <= cost:
        return chosen, pi, sure
    for k in np.argsort(-everything):
        if k in chosen:
            continue
        trial = [*chosen, int(k)]
        q, at = _em(p[:, trial], c)
        if at - like <= cost:
            break
        chosen, pi, like = trial, q, at
    order = np.argsort(-pi, kind="stable")
    return [chosen[i] for i in order], pi[order], sure


def identify(docs: DataFrame, learn: Column, max_langs: int = MAX_LANGS) -> DataFrame:
    """doc_id, lang_pred, score, langs, proportions and text_hash of every row."""
    langs, log_p = fit(docs, learn, max_langs)
    model = docs.sparkSession.sparkContext.broadcast((langs, log_p))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for b in batches:
            preds, scores, sets, shares = [], [], [], []
            for text in b.column(1).to_pylist():
                u, c = grams(text) if names and text and _LETTER.search(text) else ((), ())
                if not len(u):
                    preds.append("und"), scores.append(0.0), sets.append([]), shares.append([])
                    continue
                chosen, pi, sure = infer(u, c, table)
                preds.append(names[chosen[0]])
                scores.append(min(1.0, max(0.0, float(pi[0]) * (sure if len(chosen) == 1 else 1.0))))
                sets.append([names[i] for i in chosen])
                shares.append([float(x) for x in pi])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), b.column(2)], ["doc_id", "lang_pred", "score", "langs", "proportions", "text_hash"])

    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return own.mapInArrow(tidy(predict), f"doc_id {kind}, lang_pred string, score double, langs array<string>, proportions array<double>, text_hash long")
