"""Best-fit packing by large-item matching.

A document's ids are those of the tokenizer's file (no special tokens added), then one end id. Documents over the capacity are
cut into full pieces (the first piece takes the remainder). Since lengths are whole numbers up to
the capacity, the packing depends only on how many pieces have each length: at most `capacity`
counts go to the driver, however many documents there are. There, pieces above one third of the
capacity are matched greedily, at most two to a bin, and smaller ones best-fit the remaining gaps,
all in runs of equal bins. The plan goes back as ranges (length, first rank) -> (sequence, offset),
whose number depends on the capacity alone, and each piece finds its place by its rank among
pieces of its length. Ranks are counted in salted groups, so a hot length is split over tasks.

A null text is empty: one piece of the end id alone. Repeated rows are packed each on their own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import checkpoint, tidy

#: Fixed value: the pattern by which byte-level BPE of this kind splits a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Runs of white space, or of anything else, from this length on go to the file's own tokenizer.
LONG_RUN = 1000
#: Pieces that one salted rank group should hold.
RANK_GROUP = 50_000


def byte_characters() -> list[str]:
    """The character that stands for each byte value in the file: itself if it is printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class IdBytes:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the merges of the tokenizer's file.

    The merges run in tiktoken, whose ids are the same; texts with strings of special tokens, or with runs
    that its pattern would take too long for, go to the file's own tokenizer.
    """

    odd = re.compile(rf"<\||\s{{{LONG_RUN}}}|[^\s]{{{LONG_RUN}}}")

    def __init__(self, tokenizer_path: str, end_id: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file.get("added_tokens", ())}
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in file["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.own = tokenizer_path, None
        self.end = np.array([end_id], "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        ids = self.whole(text) if self.odd.search(text) else self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes() + self.end

    def whole(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        self.own = self.own or Tokenizer.from_file(self.path)
        return self.own.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, capacity: int, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = IdBytes(tokenizer_path, end_id)  # the task's own: workers live on, and its tables with them if they were kept
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = ids_of(text)
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or capacity, 0
                while start < n:
                    out.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges (length, first rank, first sequence, offset) and the number of sequences, from the counts of lengths.

    Ranks first..next range of that length lie in sequences that follow each other, at one offset.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # gap -> (how many, lengths)
    gaps: list[int] = []

    def add(gap: int, many: int, held: tuple[int, ...]) -> None:
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((many, held))

    for a in reversed(large):
        while c := left.get(a, 0):
            fit = capacity - a
            b = next((n for n in reversed(large[: bisect_left(large, fit + 1)]) if left.get(n, 0) > (n == a)), None)
            if b is None:
                left[a] = 0
                add(fit, c, (a,))
            else:
                many = c // 2 if a == b else min(c, left[b])
                left[a] -= many
                left[b] -= many
                add(fit - b, many, (a, b))
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[s]
        while c:
            i = bisect_left(gaps, s)
            if i == len(gaps):
                add(capacity, -(-c // (capacity // s)), ())
                continue
            gap = gaps[i]
            many, held = bins[gap].pop()
            each = min(gap // s, c)
            full = min(many, c // each)
            if full < many:
                bins[gap].append((many - full, held))
            if not bins[gap]:
                del bins[gap]
                gaps.pop(i)
            c -= full * each
            add(gap - full // full * s * each, full, (*held, *[s] * each))
    ranges, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for group in bins.values():
        for many, held in group:
            offset = 0
            for n in held:
                ranges.append((n, rank[n], sequence, offset))
                rank[n] += many
                offset += n
            sequence += many if held else 0
    return sorted(ranges), sequence


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    pieces = checkpoint(token_pieces(docs, capacity, tokenizer_path, end_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges, _ = packing_plan(counts, capacity)
    salts = max(1, max(counts.values(), default=1) // RANK_GROUP + 1)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_within", F.row_number().over(within) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_within") + F.col("_before"))
    table = np.array(ranges or [(1, 0, 0, 0)], np.int64)
    most = np.int64(1 << 46)
    keys = table[:, 0] * most + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = (b.column(k).to_numpy() for k in ("length", "_rank"))
            i = np.searchsorted(keys, n * most + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(table[i, 2] + r - table[i, 1]), pa.array(table[i, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
