"""Packing: ids against the tokenizer itself, gapless sequences, and the number of bins."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wakeline.llm.packing import IdBytes, pack, packing_plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
IDS = IdBytes(PATH, 0)


@given(st.lists(st.sampled_from([*" \n\t ab'sé1.\x1c\u3000\x85", "<|endoftext|>", "  "]), max_size=40).map("".join))
def test_ids_equal_the_tokenizers(text):
    want = np.array([*PLAIN.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert IDS(text) == want


def test_pieces_and_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(10**6, None, "x"), (10**6 + 1, "", "x"), (10**6 + 1, "", "x"), (10**6 + 2, "word " * 9000, "x")], docs.schema)
    docs = docs.unionByName(extra)
    rows = pack(docs, PATH).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*PLAIN.encode(d.text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[d.doc_id], key=lambda r: (r.piece, r.sequence_id, r.offset))
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        if d.doc_id != 10**6 + 1:
            assert [r.piece for r in own] == list(range(len(own)))
            assert sum(r.length for r in own) == len(ids)
        if len(ids) <= 2048:
            assert {r.length for r in own} == {len(ids)}
        else:
            assert {r.length for r in own[1:]} == {2048}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 2048 + 2


def _best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            fit = capacity
        else:
            gaps.remove(fit)
        gaps.append(fit - length)
    return len(gaps)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=20))
def test_plan_places_every_piece_once(counts):
    ranges, n = packing_plan(counts, 60)
    placed, fill = defaultdict(int), defaultdict(list)
    for i, (length, first, sequence, offset) in enumerate(ranges):
        stop = ranges[i + 1][1] if i + 1 < len(ranges) and ranges[i + 1][0] == length else counts[length]
        placed[length] += stop - first
        for k in range(stop - first):
            fill[sequence + k].append((offset, length))
    assert placed == counts
    assert len(fill) == n
    for b in fill.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 60
    assert n <= 1.1 * _best_fit_decreasing(counts, 60) + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
