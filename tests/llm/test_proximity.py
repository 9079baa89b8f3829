"""op10's proximity matches against a plain search of every stretch of words."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from wakeline.llm.decontaminate import SLOP, WINDOW, contamination


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def windows(text):
    w = cut(text)
    return [w[i : i + WINDOW] for i in range(max(1, len(w) - WINDOW + 1))] if w else []


def plain_near(docs, items, slop):
    out = []
    for d, text in docs:
        w, near = cut(text), set()
        for i, item in items:
            for x in windows(item):
                size = len(x) + slop
                if any(set(x) <= set(w[s : s + size]) for s in range(len(w))):
                    near.add(str(i))
        out.append((d, len(near), hashlib.sha256(",".join(sorted(near)).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_near_items_equal_plain(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(8, 18)))) for i in range(12)] + [(20, "lone"), (21, None), (22, "-"), (23, "w1 w1 w1 w2"), (24, "never seen words")]
    docs = []
    for i in range(80):
        w = rng.choices(words, k=rng.randrange(5, 60))
        if i % 2:
            x = cut(rng.choice(items[:12])[1])[:WINDOW]
            if i % 4 == 1:
                rng.shuffle(x)
            for _ in range(rng.randrange(0, 8)):  # words in between, sometimes too many
                x.insert(rng.randrange(1, len(x)), rng.choice(["between", *words]))
            at = rng.randrange(len(w))
            w[at:at] = x
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else ", ".join(w)))
    docs += [(90, None), (91, ""), (92, "a lone word"), (93, "W2 w1"), (5, docs[5][1]), (5, "another text of that number")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").withColumns({"pos": F.lit(1), "around": F.lit("x"), "from": F.lit(2)})
    for slop in (0, SLOP):
        got = contamination(frame(docs, "doc_id"), frame(items, "item_id"), slop)
        found = sorted(((r.doc_id, r.n_near_items, r.near_items_sha256) for r in got.collect()), key=repr)
        want = plain_near(docs, items, slop)
        assert found == want
        rows = got.collect()
        assert all(r.n_near_items >= r.n_items for r in rows) and any(r.n_near_items > r.n_items for r in rows)
    assert "n_near_items" not in contamination(frame(docs, "doc_id"), frame(items, "item_id")).columns
    assert contamination(frame(docs, "doc_id").limit(0), frame(items, "item_id"), SLOP).count() == 0
    none = contamination(frame(docs, "doc_id"), frame(items, "item_id").limit(0), SLOP).collect()
    assert len(none) == len(docs) and not any(r.n_near_items for r in none)
