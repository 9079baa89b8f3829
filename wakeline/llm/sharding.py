"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by (doc_id, text checksum, size); a keyed permutation of 0..N-1 gives each its
place, from which shard (place mod shards) and slot (place div shards) follow. The law is `rows`:
counts differ by at most one. A null text has no bytes and checksum 0; repeated rows get numbers of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import checkpoint, mix

ROUNDS = 6


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each number below n: a balanced Feistel network, walked until the place is below n."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed * ROUNDS & (1 << 63) - 1))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with global row numbers `row_no` in ``order``; only one count a partition goes to the driver."""
    spark = df.sparkSession
    own = checkpoint(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    counts = {r["_p"]: r["n"] for r in own.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_p int, _o long")
    return own.join(F.broadcast(offsets), "_p").withColumn("row_no", F.col("_o") + F.col("_i")).drop("_p", "_o", "_i"), total


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").__add__(1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    numbered, total = number_rows(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, seed).astype(np.int64))

    return numbered.withColumn("_place", place("row_no")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
