"""op4: groups made one lose no pair that met under some mark, and none is met under many."""

import random
from collections import defaultdict

from wakeline.llm.jaccard_join import families


def pairs(rows):
    held = defaultdict(list)
    for mark, node, use in rows:
        held[mark].append((node, use))
    return {tuple(sorted((a, b))) for g in held.values() for i, (a, x) in enumerate(g) for b, y in g[i + 1 :] if a != b and ((x & 1 and y & 2) or (x & 2 and y & 1))}


def test_no_pair_is_lost_and_few_groups_stay(spark):
    rng = random.Random(3)
    rows = {(m, n, rng.choice([1, 2, 3])) for m in range(40) for n in rng.sample(range(12), 9)}  # the same documents under many marks
    rows |= {(100 + m, 50 + m + k, 3) for m in range(30) for k in range(2)}  # a long chain of small groups
    rows |= {(200, n, 3) for n in range(300, 320)}
    by_key = {(m, n): u for m, n, u in rows}
    given = [(m, n, n // 3, u) for (m, n), u in by_key.items()]
    out = families(spark.createDataFrame(given, "mark long, node long, component long, use long")).collect()
    got = [(r.mark, r.node, r.use) for r in out]
    assert pairs([(m, n, u) for m, n, _, u in given]) <= pairs(got)
    assert all(r.component == r.node // 3 for r in out)
    size = defaultdict(int)
    for m, n, _ in got:
        size[m] += 1
    assert sum(n < 12 for _, n, _ in got) == 12  # one row a document
    assert sorted(size.values()) == [2] * 30 + [12, 20]
    assert families(spark.createDataFrame(given, "mark long, node long, component long, use long").limit(0)).count() == 0
