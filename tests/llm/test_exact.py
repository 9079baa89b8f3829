"""op1, op4, op9 and op10 on all columns against plain versions: nulls, long texts, ties, repeated rows and ids, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.plain import jaccard_groups, removed, shingles
from wakeline.llm.decontaminate import contamination
from wakeline.llm.jaccard_join import jaccard_components
from wakeline.llm.language_id import identify
from wakeline.llm.repeats import remove_repeats, repeat_groups_of

CLASH = ["node", "component", "bucket", "text_hash", "mark", "a", "b", "w", "term", "places", "key", "_share", "twin", "spans", "lang"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(*r, *("x" for _ in CLASH)) for r in rows], SCHEMA)


def words(draw, n, of=10**6):
    return " ".join(f"w{draw.randrange(of)}" for _ in range(n))


def groups_equal(spark, rows):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows)).collect())
    want = jaccard_groups(dict(rows))
    assert got == sorted((k, len(shingles(t)), want[k]) for k, t in rows)


def test_components_of_unrelated_texts(spark):
    draw = random.Random(1)
    groups_equal(spark, [])
    groups_equal(spark, [(1, words(draw, 50)), (2, words(draw, 50)), (3, None), (4, ""), (5, " \n")])
    groups_equal(spark, [(i, words(draw, 60)) for i in range(300)])


def test_components_of_variants_long_texts_and_repeated_rows(spark):
    draw = random.Random(2)
    base, rows = words(draw, 200).split(), []
    for i in range(150):
        own = list(base)
        for _ in range(draw.randrange(14)):
            own[draw.randrange(200)] = words(draw, 1)
        rows.append((i, " ".join(own)))
    long = words(draw, 30_000)
    rows += [(500, long), (501, long + " more"), (502, "a b"), (503, "A  b"), rows[0], rows[0]]
    groups_equal(spark, rows)


def test_components_keep_texts_of_one_id_apart(spark):
    draw = random.Random(3)
    x, y = words(draw, 60), words(draw, 60)
    got = sorted((r.doc_id, r.component_id, r.is_first) for r in jaccard_components(table(spark, [(1, x), (2, x), (2, y), (3, y)])).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)]


def passages_equal(spark, rows):
    got = {(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(table(spark, rows)).collect()}
    gone = removed(dict(rows))
    for k, t in dict(rows).items():
        raw, g = (t or "").encode(), gone[k]
        kept = bytes(b for i, b in enumerate(raw) if i not in g)
        assert got[k] == (len(raw), len(g), sum(i - 1 not in g for i in g), hashlib.sha256(kept).hexdigest()), k


def test_repeated_passages(spark):
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcdefgh é") for _ in range(n))
    p, q = text(150), text(300)
    passages_equal(spark, [(1, p + text(80)), (2, text(50) + p + text(50)), (3, q + q + text(10) + q[:120]), (4, None), (5, ""), (6, text(20) + p[:90]), (7, "a" * 400), (8, "ab" * 30_000), (9, p + text(80))])
    passages_equal(spark, [(i, text(draw.randrange(120)) + p[draw.randrange(40) :] + text(draw.randrange(60))) for i in range(200)])
    assert remove_repeats(table(spark, [])).collect() == []


def test_repeated_ids_lose_nothing(spark):
    draw = random.Random(5)
    p, q = words(draw, 30), words(draw, 40)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(table(spark, [(1, p), (1, p), (2, p), (2, q)])).collect())
    assert got == sorted([(1, len(p), 0), (1, len(p), 0), (2, len(p), len(p)), (2, len(q), 0)])


def test_groups_hold_all_occurrences(spark):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    p = text(130)
    rows = [(1, p + "1" + text(40)), (2, "2" + p + text(40)), (3, "zz" + p[:110] + "q"), (4, text(200))]
    got = {}
    for r in repeat_groups_of(table(spark, rows)).collect():
        got.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    found = [(n, at) for (_, n), at in got.items()]
    assert (110, {(1, 0), (2, 1), (3, 2)}) in found and (130, {(1, 0), (2, 1)}) in found
    texts = dict(rows)
    for n, at in found:
        k, i = min(at)
        assert at == {(k2, j) for k2, t in rows for j in range(len(t)) if t[j : j + n] == texts[k][i : i + n] and len(t[j : j + n]) == n}


def test_contamination(spark):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    draw = random.Random(7)
    items = [("a", words(draw, 25, 40)), ("b", "One, two THREE"), ("c", None), ("d", "..."), ("e", words(draw, 10, 40)), ("b", "One, two THREE"), ("f", "of of of of of of of of of of of")]
    rows = [(i, words(draw, draw.randrange(40), 40) + " " + " ".join(cut(draw.choice(items)[1])[:12])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "of " * 3000), (103, "x one-two three"), (104, words(draw, 5000, 40) + " one two three " + words(draw, 10)), rows[3]]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(table(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect())
    want = []
    for k, t in rows:
        w, hit, named = cut(t), set(), set()
        for name, said in items:
            v = cut(said)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n)), named.add(name)
        want.append((k, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    none = spark.createDataFrame([], "item_id string, text string")
    assert not any(r.contaminated for r in contamination(table(spark, rows[:5]), none).collect())
    assert contamination(table(spark, []), none).collect() == []


def test_languages(spark):
    draw = random.Random(9)
    of = {"en": "the house and this water with stone".split(), "xx": "zał grzyb wczoraj pięć drzewo szkło".split()}
    rows = [(i, " ".join(draw.choice(of[lang]) for _ in range(40)), lang) for i, lang in enumerate(["en", "xx"] * 30)]
    odd = [(100, None, "en"), (101, "", "xx"), (102, "123 ... !!", None), (103, " ".join(draw.choice(of["en"]) for _ in range(100_000)), None), rows[0], (104, rows[0][1], None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], "doc_id long, text string, lang string, _share string, score string")
    got = identify(docs, F.col("doc_id") < 100).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows + odd)
    named = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(named[k][0] == lang for k, _, lang in rows) and all(0 <= s <= 1 for _, s in named.values())
    assert [named[k][0] for k in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "en"]
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs.limit(0), F.lit(True)).collect() == []


def test_languages_in_a_tie_go_to_one_of_them_for_good(spark):
    docs = spark.createDataFrame([(1, "abc def", "b"), (2, "abc def", "a"), (3, "abc def", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(docs, F.lit(True)).collect()} == {"a"}
