"""Sharding, URL rules, page text and fingerprints on small cases: nulls, empty tables, repeated rows, clashing columns."""

import zlib

import numpy as np
import pytest

from wakeline.llm.fingerprints import BIN, bin_of, features, fingerprints, rarity
from wakeline.llm.html_text import extract, main_text
from wakeline.llm.sharding import feistel_shards
from wakeline.llm.url_graph import judge

DOCS = "doc_id long, text string, size string, score string, row_no string"


def test_shards(spark):
    rows = [(i, f"text {i} é", "x", "y", "z") for i in range(101)] + [(500, None, "x", "y", "z"), (501, "", "x", "y", "z"), (7, "text 7 é", "x", "y", "z")]
    got = feistel_shards(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    by_shard = {}
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "rows")
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert feistel_shards(spark.createDataFrame([], DOCS)).collect() == []


def test_urls(spark):
    rows = [
        (1, "http://A.Example.com/en/8?q", None), (2, "http://example.com/en/7x", ""), (3, "http://example.net/de/8", None), (4, "http://b.net/de/9#x", None),
        (5, "http://x.org/es/", None), (6, None, None), (7, "no scheme", None), (7, "no scheme", None), (8, "http://notexample.com", None),
    ]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")).collect())
    assert got[0] == (1, "a.example.com", "/en/8", "com/en/", "block")
    assert [(g[0], g[3], g[4]) for g in got[1:5]] == [(2, "example.com/en/7", "allow"), (3, "example.net/de/8", "block"), (4, "net/de/", "allow"), (5, "org/es/", "block")]
    assert got[5:8] == [(6, "", "", None, "allow"), (7, "", "", None, "allow"), (7, "", "", None, "allow")]
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_distrust_flows_against_links(spark):
    link = '<a href="http://bad.com/">x</a>'
    rows = [(1, "http://bad.com/en/1", None), (2, "http://friend.info/a", link), (3, "http://other.info/a", '<a href="http://friend2.info/">x</a>')]
    got = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].distrust == pytest.approx(0.15)
    assert got[2].distrust == pytest.approx(0.85 * 0.15)
    assert got[3].distrust == 0


def test_unrelated_link_leaves_verdicts(spark):
    rows = [(1, "http://bad.com/en/1", None), (2, "http://bad.com/en/2", None), (3, "http://bad.com/other", None), (4, "http://good.net/de/1", None), (5, "http://good.net/x", None)]
    link = [(6, "http://a.info/", '<a href="http://b.info/">x</a>')]
    seen = []
    for more in ([], link):
        got = judge(spark.createDataFrame(rows + more, "page_id long, url string, html string")).where("page_id < 6").collect()
        seen.append(sorted((r.page_id, r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in got))
    assert seen[0] == seen[1]
    assert [x[1] for x in seen[0]] == ["block", "block", "block", "allow", "allow"] and seen[0][2][3] == 0.15


def test_links_change_verdicts(spark):
    to = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.com/en/1", None), (2, "http://good.net/de/1", to("praised.info"))]
    rows += [(10 + i, f"http://friend{i}.info/", to("bad.com")) for i in range(5)]
    rows += [(20, "http://second.info/", to("friend0.info")), (21, "http://half.info/", to("bad.com", "calm.info")), (22, "http://tenth.info/", to("bad.com", *(f"calm{i}.info" for i in range(9))))]
    rows += [(23, "http://praised.info/", to("bad.com")), (24, "http://calm.info/", to("good.net"))]
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 10, 11, 12, 13, 14, 20, 21}


def test_page_text(spark):
    long = "This is the text of the article and it was written for all of you who are in the house with us. " * 3
    page = f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>{long}</p><p>Short\n end.</p></article><footer>© all rights</footer><script>x<y</script></body></html>"
    assert main_text(page) == f"A & B\n{long.strip()}\nShort end."
    rows = extract(spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", page)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows[:2]] == [(1, "", 0), (2, "", 0)]
    assert rows[2].n_chars == len(rows[2].text) > 0


def test_hidden_elements_without_end_tags():
    said = "This is the text of the article and it was written for all of you who are in the house with us. " * 3
    more = "And that is what they said to us when we were in the town, for it was not on the way to the sea. " * 3
    article = f"<article><p>{said}</p><p>{more}</p></article>"
    want = f"{said.strip()}\n{more.strip()}"
    whole = f"<html><head><title>t</title></head><body>{article}</body></html>"
    assert main_text(whole) == want
    assert main_text(whole.replace("</head>", "")) == want
    assert main_text(whole.replace("</head><body>", "")) == want
    assert main_text(f"<head><meta charset=x><title>t</title>{article}") == want
    for name in ("select", "svg", "object", "canvas", "video", "noscript", "iframe", "template", "math", "audio"):
        assert main_text(f"<body><{name} a='>'>{article}</body>") == want, name
        assert main_text(f"<body><div><{name}></div>{article}<p><{name}>x</{name}></p></body>") == want, name
        assert main_text(f"<body><{name}><p>{more}</p><{name}>x</{name}></{name}>{article}</body>") == want, name
        assert main_text(f"<body>{article.replace('</p><p>', f'</p><{name}>hidden<p>')}</body>") == want, name
        assert main_text(f"<body><{name}/>{article}</body>") == want, name
    assert main_text(f"<body><select><option>{more}<option>{more}{article}</body>") == want
    assert main_text(f"<body><article><p>{said}<svg><title>x</title><path d=y></svg></p><p>{more}</p></article><script>{article}") == want


def test_fingerprints(spark):
    import hashlib

    texts = {1: "alpha beta gamma delta " * 40, 2: None, 3: "alpha beta gamma delta " * 40, 4: "x", 5: "ünï wörd " * 30}
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, fingerprint string")).collect()}
    assert got[1].fingerprint == got[3].fingerprint
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        t, after = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[k].n_chars == len(t)
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert got[4].near_edited == pytest.approx(1.0)


def test_features_do_not_depend_on_the_place_in_a_step():
    import random

    draw = random.Random(6)
    texts = ["".join(draw.choice("aaabcdeefghiijklmnoopqrsttuvwxyz     .,") for _ in range(n)).encode() for n in (100, 250, 700, 2000, 64, 63)]
    tables = [rarity(span, np.exp(-((np.arange(int(bin_of(span).max()) + 1) * BIN - usual) ** 2) * 8) * 1e6 // 1) for span, usual in ((64, 4.0), (16, 3.2), (8, 2.7))]
    alone = [features([t], tables)[0].tolist() for t in texts]
    assert all(map(len, alone))
    for k in range(len(texts)):
        turned = features(texts[k:] + texts[:k], tables)
        assert [x.tolist() for x in turned[len(texts) - k :] + turned[: len(texts) - k]] == alone
