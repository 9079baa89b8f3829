"""Importance resampling towards a target: texts are drawn by hashed features' log ratios and their own noise.

Identical texts are one group (grouped by the full text, with its count of copies); its features are computed
once, kept as bucket numbers in a written table, counted times its copies, and weighed once. Weights go back to
documents by a 128 bit key of the text; texts that hold more than a thousandth of all rows, at most a thousand of
them, are broadcast, all others joined, so that no key's rows meet in one task. Noise follows from doc_id alone.

Defined cases: a null text has no words, weighs 0 and is scored like any other; rows that repeat a doc_id are
documents of their own, with the same noise; a null doc_id hashes as an empty one; ties of the score go to the
smaller doc_id (null first); without documents, no rows; without a target text, T is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import as_bytes, bounded_join, checkpoint, tidy
from wakeline.llm.sharding import number_rows

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
TEXT_KEY = ["k1", "k2"]
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), text).alias(k) for i, k in enumerate(TEXT_KEY)]


def feature_buckets(text: bytes, buckets: int, longest: int) -> np.ndarray:
    """Bucket of each run of 1 to ``longest`` words, repeats kept."""
    words = _WORD.findall(text.lower())
    runs = [crc32(w) for w in words]
    for n in range(2, longest + 1):
        runs += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return (np.array(runs, np.uint32) % np.uint32(buckets)).astype(np.uint32)


def text_features(docs: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """Each distinct text once: key, copies, n_words, n_features and the buckets of its features."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select(*text_key(F.col("text")), "copies", "text")
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [feature_buckets(t, buckets, longest) for t in as_bytes(batch.column("text"))]
            n = np.array([len(b) for b in own], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*TEXT_KEY, "copies")), pa.array(n), pa.array([b.astype(kind).tobytes() for b in own], pa.binary())], names=[*TEXT_KEY, "copies", "n_features", "buckets"])

    return texts.mapInArrow(features, "k1 long, k2 long, copies long, n_features long, buckets binary")


def _flat(batch: pa.RecordBatch, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(as_bytes(batch.column("buckets"))), kind)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all documents: every text's, times its copies."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            copies, n = batch.column("copies").to_numpy(), batch.column("n_features").to_numpy()
            total += np.bincount(_flat(batch, kind), weights=np.repeat(copies, n), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) of each bucket, in doubles."""
    buckets, s_all, t_all = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def text_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    @tidy
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            upto = np.concatenate(([0], np.cumsum(gain[_flat(batch, kind)])))
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*TEXT_KEY, "copies", "n_features")), pa.array(upto[end] - upto[end - n])], names=[*TEXT_KEY, "copies", "n_features", "weight"])

    return features.mapInArrow(weigh, "k1 long, k2 long, copies long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel variate that follows from the seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and the rank of those drawn."""
    features = checkpoint(text_features(docs, buckets, longest))
    gain = gains(bucket_counts(features, buckets), bucket_counts(text_features(target, buckets, longest), buckets))
    weights = checkpoint(text_weights(features, gain))
    total = weights.agg(F.sum("copies")).first()[0] or 0
    keys = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.coalesce("text", F.lit("")))))
    often = F.col("copies") * 1000 > total  # of such texts there are fewer than a thousand
    hot = weights.where(often).drop("copies")
    usual = bounded_join(keys.join(F.broadcast(hot), TEXT_KEY, "left_anti"), weights.where(~often).drop("copies"), TEXT_KEY)
    weighed = keys.join(F.broadcast(hot), TEXT_KEY).unionByName(usual)
    scored = checkpoint(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"), (-F.col("weight") - noise(seed)).alias("_behind")))
    words = F.expr(f"(n_features + {longest * (longest - 1) // 2}) div {longest}")  # n words have n + (n - 1) + ... runs
    able = words >= least_words
    numbered, n = number_rows(scored.where(able), ["_behind", "doc_id"])
    rank = F.when(F.col("row_no") < n * percent // 100, F.col("row_no") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return numbered.select(*columns, rank.cast("long").alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
