"""Page text by densities, in linear time; host scores against a plain computation and a planted farm of links."""

import random
import time

import duckdb
import pytest

from wakeline.llm.html_text import blocks, judged, main_text
from wakeline.llm.oracle import op7
from wakeline.llm.url_graph import DAMPING, judge

PROSE = "This is the text of the page and it was written for all of you who are in the house with us today. "
LISTS = "Blue widgets red widgets green widgets large widgets small widgets cheap widgets new widgets old widgets. "


def test_densities_decide_without_article_or_class_names():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><div><h2>A title</h2></div><div>{PROSE * 3}</div><div>Short one.</div><div>{PROSE * 3}</div><div>{LISTS}</div><div><a href=c>More</a></div></body>"
    assert main_text(page) == "\n".join(("A title", (PROSE * 3).strip(), "Short one.", (PROSE * 3).strip()))


def test_density_alone_turns_a_label():
    page = lambda said: f"<body><div>{PROSE * 3}</div><div>{said}</div><div>{PROSE * 3}</div></body>"
    assert len(main_text(page(PROSE)).split("\n")) == 3
    assert len(main_text(page(LISTS)).split("\n")) == 2


def test_places_are_one_feature_among_others():
    linked = "<p>" + "<a href=x>One of the links</a> " * 9 + "</p>"
    assert main_text(f"<article><p>{PROSE * 3}</p>{linked}<p>{PROSE * 3}</p></article>").count("links") == 0
    assert main_text(f"<body><aside>{PROSE * 2}</aside><div>{PROSE * 3}</div></body>") == (PROSE * 3).strip()


def test_open_blocks_inherit_from_the_nearest_decided_ones():
    draw = random.Random(4)
    for _ in range(200):
        kinds = [draw.choice("glso") for _ in range(draw.randrange(1, 9))]
        said = {"g": f"<div>{PROSE * 3}</div>", "l": f"<div>{LISTS}</div>", "s": "<div>Short one.</div>", "o": f"<div>{PROSE}</div>"}
        found = list(blocks("".join(said[k] for k in kinds)))
        label = {"g": True, "l": False}
        want = []
        for i, k in enumerate(kinds):
            sides = [next((label[x] for x in part if x in label), False) for part in (kinds[:i][::-1], kinds[i + 1 :])]
            want.append(label[k] if k in label else any(sides) if k == "o" else all(sides))
        assert judged(found) == want, kinds


@pytest.mark.parametrize("part", ["<a ", '<a "', "<div>x", "<b>x", "<b><i>", "<script ", "</script ", "<!--", '<a href="x', "<p>x<a>", "<svg>", "<li>", "&amp", "<br>x"])
def test_hostile_pages_take_linear_time(part):
    began = time.process_time()
    main_text(part * (400_000 // len(part)))
    assert time.process_time() - began < 20


def plain_scores(links, seeds, reverse, stopped=()):
    """Damped scores by plain rounds; links are {source: [targets]}."""
    hosts = {*links, *(t for ts in links.values() for t in ts), *seeds}
    score = dict.fromkeys(hosts, 0.0)
    for _ in range(200):
        new = {h: (1 - DAMPING) * (h in seeds) for h in hosts}
        for a, ts in links.items():
            for t in ts if a not in stopped else ():
                x, y = (t, a) if reverse else (a, t)
                new[y] += DAMPING * score[x] / len(ts)
        score = new
    return score


def test_scores_equal_plain_rounds_and_a_farm_is_found(spark):
    draw = random.Random(8)
    good, farm, bad = [f"g{i}.info" for i in range(30)], [f"f{i}.info" for i in range(12)], ["b0.com", "b1.com"]
    links = {g: draw.sample([x for x in [*good, "seed.net"] if x != g], 4) for g in good}
    links |= {f: [*draw.sample([x for x in farm if x != f], 2), *bad, draw.choice(good)] for f in farm}
    links["seed.net"] = draw.sample(good, 5)
    rows = [(i, f"http://{h}/" + ("en/" if h in bad else "de/" if h == "seed.net" else ""), "".join(f'<a class=c href="http://{t}/x">t</a>' for t in links.get(h, ()))) for i, h in enumerate([*good, *farm, *bad, "seed.net"])]
    found = judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.host: r for r in found.collect()}
    trust, distrust = plain_scores(links, {"seed.net"}, False), plain_scores(links, set(bad), True, {"seed.net"})
    for h, r in got.items():
        assert r.trust == pytest.approx(trust[h], abs=2e-3) and r.distrust == pytest.approx(distrust[h], abs=2e-3), h
    assert {h for h, r in got.items() if r.verdict == "block"} == {*farm, *bad}


def test_sql_equals_the_query_where_there_are_links(spark):
    draw = random.Random(9)
    hosts = [*(f"h{i}.info" for i in range(40)), "a.com", "b.com", "seed.net", "x.org"]
    url = {"a.com": "en/1", "b.com": "en/2", "seed.net": "de/", "x.org": "es/"}
    rows = [(i, f"http://{h}/{url.get(h, 'p')}", "".join(f'<a href="//{t}/x">t</a>' for t in draw.choices(hosts, k=draw.randrange(6)))) for i, h in enumerate([*hosts, *draw.choices(hosts, k=20)])]
    df = judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    q = con.sql(op7())
    columns = sorted(df.columns)
    want = sorted(q.select(*columns).fetchall())
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert columns == sorted(q.columns) and len(got) == len(want) == len(rows)
    assert {r[columns.index("verdict")] for r in want} == {"allow", "block"} and any(r[columns.index("distrust")] > 0 and r[columns.index("rule")] is None for r in want)
    for g, w in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-9 for x, y in zip(g, w, strict=True)), (g, w)
