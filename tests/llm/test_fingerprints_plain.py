"""op6's whole query against a plain version: entropies, runs, filters and likeness counted one by one."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import queries
from wakeline.llm.common import prefix_hash, span_hash
from wakeline.llm.fingerprints import BIN, BITS, LONGEST, MOST, SHAPES, SUBS, TRIVIAL, fingerprints, rarity, rarity_tables

SF_DIR = "/root/testdata/sf0.001"
PART = [round(c * math.log2(c) * 128) if c else 0 for c in range(LONGEST + 1)]


def _entropies(raw: bytes, span: int) -> list[float]:
    return [math.log2(span) - sum(PART[c] for c in Counter(raw[i : i + span]).values()) / 128 / span for i in range(len(raw) - span + 1)]


def _tables(texts) -> dict[int, list[float]]:
    """Of each shape, the improbability of every bin of the entropies of all texts, in bits."""
    out = {}
    for (span, _, _), limit in SHAPES:
        bins = [0] * (int((math.log2(span)) / BIN) + 1)
        for t in texts:
            raw = t.encode("utf-8", "replace")
            if limit is None or len(raw) < limit:
                for e in _entropies(raw, span):
                    bins[math.floor(max(e, 0) / BIN)] += 1
        out[span] = [-math.log2((n + 1) / (sum(bins) + len(bins))) for n in bins]
    return out


def _rank(entropy: float, span: int, table: list[float]) -> int:
    if entropy < TRIVIAL * math.log2(span):
        return 0
    at = min(max(entropy / BIN - 0.5, 0), len(table) - 1)
    low = min(int(at), len(table) - 2)
    return 1 + round((table[low] + (table[low + 1] - table[low]) * (at - low)) * 1000)


def _chosen(raw: bytes, shape: tuple[int, int, int], table: list[float]) -> list[int]:
    span, run, least = shape
    ranks = [_rank(e, span, table) for e in _entropies(raw, span)]
    points: Counter[int] = Counter()
    for start in range(1 - run, len(ranks)) if ranks else ():
        best = max(range(max(start, 0), min(start + run, len(ranks))), key=lambda i: (ranks[i], -i))
        if ranks[best]:
            points[best] += 1
    chosen = np.array(sorted(i for i, n in points.items() if n >= least), np.int64)
    return [int(h) for h in span_hash(prefix_hash(np.frombuffer(raw, np.uint8)), chosen, chosen + span)] if len(chosen) else []


def _filters(text: str, tables: dict[int, list[float]]) -> list[frozenset[int]]:
    raw = text.encode("utf-8", "replace")
    hashes = [h for shape, limit in SHAPES if limit is None or len(raw) < limit for h in _chosen(raw, shape, tables[shape[0]])]
    if raw and not hashes:
        hashes = [int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")]
    return [frozenset((h >> 11 * i) % BITS for h in hashes[k : k + MOST] for i in range(SUBS)) for k in range(0, len(hashes), MOST)]


def _told(chain: list[frozenset[int]]) -> str:
    bits = np.zeros((len(chain), BITS), np.uint8)
    for row, held in enumerate(chain):
        bits[row, sorted(held)] = 1
    return base64.b64encode(np.packbits(bits).tobytes()).decode() if chain else ""


def _like(a: list[frozenset[int]], b: list[frozenset[int]]) -> float:
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a

    def score(x: frozenset[int], y: frozenset[int]) -> float:
        chance = len(x) * len(y) / BITS
        return min(1.0, max(0.0, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9)))

    return sum(max(score(x, y) for y in b) * len(x) for x in a) / sum(map(len, a))


def test_whole_query_equals_the_plain_version(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, SF_DIR).collect()}
    assert got.keys() == docs.keys()
    order = sorted(docs, reverse=True)
    tables = _tables(docs.values())
    known = {d: _filters(t, tables) for d, t in docs.items()}
    for d, following in zip(order, order[1:] + order[:1], strict=True):
        text, r = docs[d], got[d]
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[following][:half]
        changed = _filters(edited, tables)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (_told(known[d]), _told(changed)), d
        assert r.near_edited == pytest.approx(_like(known[d], changed), abs=1e-9)
        assert r.near_next == pytest.approx(_like(known[d], known[following]), abs=1e-9)


@pytest.mark.parametrize("size", [32, 48, 64, 90, 128, 200, 300, 450, 600, 900])
def test_half_edited_texts_are_nearer_than_the_next_at_every_size(spark, size):
    draw = random.Random(size)
    words = ["".join(draw.choice("abcdefghilmnoprstuvwy") for _ in range(draw.randrange(2, 9))) for _ in range(400)]
    texts = []
    for i in range(60):
        t = ""
        while len(t) < size:
            t += draw.choice(words) + " "
        texts.append((i, t[:size]))
    rows = fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    edited, following = (sorted(getattr(r, c) for r in rows) for c in ("near_edited", "near_next"))
    assert edited[30] > following[57] and sum(r.near_edited > r.near_next for r in rows) >= 54


def test_what_is_rare_follows_from_all_documents(spark):
    few = ["".join(random.Random(i).choices("abcdefghij ", k=70)) for i in range(8)]
    df = spark.range(8000).selectExpr("id AS doc_id", f"element_at(array({', '.join(map(repr, few))}), CAST(id % 8 AS int) + 1) AS text")
    got = rarity_tables(df)
    for ((span, _, _), _), table in zip(SHAPES, got, strict=True):
        bins = np.zeros(int(math.log2(span) / BIN) + 1, np.int64)
        for t in few:
            for e in _entropies(t.encode(), span):
                bins[math.floor(max(e, 0) / BIN)] += 1000
        assert (table == rarity(span, bins)).all()
