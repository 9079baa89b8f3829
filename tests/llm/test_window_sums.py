"""The windows' sums of parts, against counting each window by itself, and their cost."""

import random
import time

import numpy as np

from wakeline.llm.fingerprints import _PARTS, SHAPES, _windows


def test_sums_are_those_of_each_window():
    r = random.Random(5)
    texts = [bytes(r.choices(range(n), k=k)) for n, k in ((256, 900), (3, 700), (1, 200), (40, 64), (40, 63), (2, 0), (90, 15), (7, 16))]
    for (span, run, _), _ in SHAPES:
        a, starts, sums, inside = _windows(texts, span, run)
        plain = [int(_PARTS[np.bincount(a[i : i + span])].sum()) for i in range(len(a) - span + 1)]
        assert sums.tolist() == plain
        within = {int(s) + i for s, t in zip(starts, texts, strict=True) for i in range(len(t) - span + 1)}
        assert np.flatnonzero(inside).tolist() == sorted(within)


def test_cost_does_not_grow_with_the_number_of_byte_values():
    """Before, each frequent byte value took passes of its own over all the bytes."""

    def seconds(values: int) -> float:
        text, took = bytes(np.random.default_rng(1).integers(0, values, 1 << 17, dtype=np.uint8)), []
        for _ in range(3):
            began = time.process_time()
            _windows([text], 64, 64)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(200) < 8 * seconds(2)
