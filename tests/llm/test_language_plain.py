"""op1 against a plain mixture: trigrams, laws, expectation maximisation and the penalised set, number by number."""

import math
import random
import re

from pyspark.sql import functions as F

from wakeline.llm.language_id import BUCKETS, OVERLAP, PENALTY, identify

ALPHABETS = {"aa": "bcdfgaeo", "bb": "klmnpiuy", "cc": "rstvwaei", "dd": "хжзиклмн"}


def bucket(a, b, c):
    return ((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 & 0xFFFF


def plain_grams(text):
    raw = [32, *(x if x >= 128 or 97 <= x <= 122 else 32 for x in text.lower().encode()), 32]
    out = {}
    for i in range(len(raw) - 2):
        if raw[i : i + 3] != [32, 32, 32]:
            b = bucket(*raw[i : i + 3])
            if b != bucket(32, 32, 32):
                out[b] = out.get(b, 0) + 1
    return out


def plain_em(p, counts, rounds=12):
    m = len(p[0])
    pi = [1 / m] * m
    total = sum(counts)
    for _ in range(rounds):
        new = [0.0] * m
        for row, c in zip(p, counts):
            z = sum(x * w for x, w in zip(row, pi))
            for k in range(m):
                new[k] += c * row[k] * pi[k] / z
        pi = [x / total for x in new]
    return pi, sum(c * math.log(sum(x * w for x, w in zip(row, pi))) for row, c in zip(p, counts))


def plain_predict(text, langs, law):
    g = plain_grams(text) if text and re.search(r"[^\W\d_]", text) else {}
    if not g:
        return "und", 0.0, [], []
    keys, counts = sorted(g), [g[k] for k in sorted(g)]
    p = [[law[lang].get(k, law[lang][None]) for lang in langs] for k in keys]
    single = [sum(c * math.log(row[k]) for row, c in zip(p, counts)) for k in range(len(langs))]
    best = max(range(len(langs)), key=lambda k: single[k])
    sure = 1 / sum(math.exp(max(-700, (s - single[best]) / OVERLAP)) for s in single)
    chosen, pi, like = [best], [1.0], single[best]
    cost = OVERLAP * (PENALTY + 0.5 * math.log(max(sum(counts) / OVERLAP, 1)))
    every, most = plain_em(p, counts)
    if most - like > cost:
        for k in sorted(range(len(langs)), key=lambda k: -every[k]):
            if k in chosen:
                continue
            q, at = plain_em([[row[i] for i in (*chosen, k)] for row in p], counts)
            if at - like <= cost:
                break
            chosen, pi, like = [*chosen, k], q, at
    order = sorted(range(len(chosen)), key=lambda i: -pi[i])
    return langs[chosen[order[0]]], pi[order[0]] * (sure if len(chosen) == 1 else 1.0), [langs[chosen[i]] for i in order], [pi[i] for i in order]


def test_languages_and_proportions_equal_plain(spark):
    rng = random.Random(12)
    say = lambda lang, n: " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    learned = [(i, say(lang, 60), lang) for i, lang in enumerate(list(ALPHABETS) * 8)]
    asked = [(1000 + i, " ".join(say(k, n) for k, n in zip(rng.sample(list(ALPHABETS), 3), shares)), None) for i, shares in enumerate([(50, 0, 0), (40, 40, 0), (60, 20, 0), (30, 30, 30), (80, 3, 0), (1, 0, 0), (1, 1, 1), (200, 90, 40)] * 4)]
    asked += [(2000, None, None), (2001, "", None), (2002, "12 !? 7", None), (2003, "É", None), (2004, "a", "zz")]
    rows = learned + asked
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"langs": F.lit("x"), "score": F.lit("x"), "bucket": F.lit("x")})
    got = {r.doc_id: r for r in identify(df, F.col("doc_id") < 1000).collect()}
    langs = sorted(ALPHABETS)
    counts = {k: {} for k in langs}
    for _, text, lang in learned:
        for b, n in plain_grams(text).items():
            counts[lang][b] = counts[lang].get(b, 0) + n
    law = {}
    for k, c in counts.items():
        total = sum(c.values()) + 0.5 * BUCKETS
        law[k] = {b: (n + 0.5) / total for b, n in c.items()} | {None: 0.5 / total}
    several = 0
    for i, text, _ in rows:
        lang, score, chosen, shares = plain_predict(text, langs, law)
        r = got[i]
        assert (r.lang_pred, r.langs) == (lang, chosen), i
        assert abs(r.score - min(1.0, max(0.0, score))) < 1e-6 and all(abs(a - b) < 1e-6 for a, b in zip(r.proportions, shares, strict=True)), i
        several += len(chosen) > 1
    assert several >= 8
