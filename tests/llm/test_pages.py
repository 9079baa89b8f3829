"""op3 against hand-marked pages (precision, recall), a plain version of both passes, and tables with odd rows."""

import random
import re

import pytest

from wakeline.llm.html_text import BAD, GOOD, HIGH, LINKS, LONG, LOW, RIGHTS, SHORT, STOP_WORDS, VERY_LONG, blocks, extract, judged, main_text

EN = "This is the text of the page and it was written for all of you who are in the house with us today. "
RU = "В этом доме не было никого, и он вошёл в него, как в свой. Но на столе не было ни хлеба, ни воды, и он сел и не знал, что ему делать. "
PL = "To jest dom, w którym nie było nikogo, a on i tak do niego wszedł i nie wiedział, co ma z tym zrobić, bo nie miał się do kogo zwrócić. "
JA = "これは文章です。人々は家にいて、本を読みました。天気はとても良かったので、彼らは外に出ました。"
MENU = "<ul><li><a href=a>Home</a><li><a href=b>News of the day</a><li><a href=c>About us and the others</a></ul>"


def _page(kind, said, rng):
    """html and the marked main text's blocks."""
    paragraphs = [(said * rng.randrange(3, 9)).strip() for _ in range(rng.randrange(2, 6))]
    short = (said[:40]).strip()
    body = f"<h1>{short}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    side, foot, talk = f"<div class=sidebar><p>{said * 2}</p>{MENU}</div>", f"<footer><p>© {said}</p></footer>", f"<section class=comments><p>{said * 20}</p></section>"
    frames = {
        "article": f"<body><nav>{MENU}</nav><article>{body}</article>{side}{talk}{foot}</body>",
        "layout": f"<body><div class='layout has-sidebar'><div>{MENU}</div><article>{body}</article></div>{talk}{foot}</body>",
        "wrapped": f"<body><div class='layout sidebar'><main>{body}</main>{side}</div>{foot}</body>",
        "legal": f"<body><header>{MENU}</header><section class='legal news'>{body}</section>{foot}</body>",
        "aside": f"<body><nav>{MENU}</nav><aside>{body}</aside>{foot}</body>",
        "plain": f"<body><div>{MENU}</div><div>{body}</div>{talk}<div class=footer>{said}</div></body>",
        "form": f"<body><form action=x><input name=q>{body}</form>{foot}</body>",
        "open": f"<body><div class='post comments-open no-sidebar'>{body}</div><div>{MENU}</div></body>",
    }
    return frames[kind], [short, *paragraphs]


@pytest.mark.parametrize("kind", ["article", "layout", "wrapped", "legal", "aside", "plain", "form", "open"])
@pytest.mark.parametrize("said", [EN, RU, PL, JA])
def test_marked_pages(kind, said):
    rng, right, given, asked = random.Random(len(kind)), 0, 0, 0
    for _ in range(10):
        page, marked = _page(kind, said, rng)
        got = main_text(page).split("\n")
        right += sum(len(x) for x in got if x in marked)
        given += sum(map(len, got))
        asked += sum(map(len, marked))
    assert right >= 0.95 * given and right >= 0.95 * asked


def test_a_name_of_a_container_decides_nothing_by_itself():
    for name in ("has-sidebar", "sidebar", "legal", "promo", "widget", "ad", "menu", "with-nav", "related", "header"):
        assert main_text(f"<body><div class={name}><article><p>{EN * 15}</p></article></div></body>") == (EN * 15).strip(), name
        assert main_text(f"<body><div class={name}><p>{EN * 15}</p></div><div>{MENU}</div></body>") == (EN * 15).strip(), name
        assert main_text(f"<body><div class={name}><p>{EN * 3}</p></div><article><p>{EN * 9}</p></article></body>") == (EN * 9).strip(), name


def test_densities_move_blocks_in_and_out_of_containers():
    lists = "Blue widgets red widgets green widgets large widgets small widgets cheap widgets new widgets old widgets. " * 3
    page = lambda inner, outer: f"<body><div class=side><p>{inner}</p></div><div><p>{outer}</p></div></body>"
    assert main_text(page(EN * 9, EN * 3)) == "\n".join(((EN * 9).strip(), (EN * 3).strip()))
    assert main_text(page(lists * 4, EN * 3)) == (EN * 3).strip()
    assert main_text(page(EN * 3, EN * 9)) == (EN * 9).strip()


def test_comments_stay_out_however_long():
    assert main_text(f"<body><div class=post><p>{EN * 3}</p></div><div id=comments><p>{EN * 40}</p></div></body>") == (EN * 3).strip()
    assert main_text(f"<body><article><p>{EN * 3}</p></article><section class=replies><article class=comment>{EN * 40}</article></section></body>") == (EN * 3).strip()
    assert main_text(f"<body><div class=comments><p>{EN * 9}</p></div></body>") == (EN * 9).strip()


def test_short_pages_and_empty_ones():
    assert main_text("<body><p>Closed today.</p></body>") == "Closed today."
    assert main_text(f"<body><nav>{MENU}</nav><p>Closed today.</p></body>") == "Closed today."
    for page in (None, "", "   ", "<script>x</script>", "<nav><a href=a>Home</a></nav>"):
        assert main_text(page) == ""


def plain_labels(found):
    """Both passes, block by block, by looking outward each time (for pages in the four languages)."""
    some = any(b[3] for b in found)

    def first(b):
        text, links, outside, article, _ = b
        against = 3 * outside + (some and not article and not outside) + (not article and bool(RIGHTS.search(text)))
        if links > LINKS:
            return False
        if len(text) < SHORT:
            return None if not against and not (links and not article) else False
        seen = re.findall(r"[^\W\d_]+", text.lower())
        share = sum(w in STOP_WORDS for w in seen) / max(1, len(seen))
        said = (share >= HIGH) - (share < LOW)
        p = said + (len(text) > LONG) + (len(text) > VERY_LONG and said > 0) + bool(article and not outside) - against
        return True if p >= GOOD else False if p <= BAD else None

    labels = [first(b) for b in found]
    out = []
    for i, (text, _, outside, article, heading) in enumerate(found):
        if labels[i] is not None:
            out.append(labels[i])
            continue
        look = lambda order: next((labels[j] for j in order if found[j][3] == article and labels[j] is not None and not (found[j][2] and found[j][3])), None)  # noqa: E731, B023
        one, two = look(range(i - 1, -1, -1)), look(range(i + 1, len(found)))
        sides = [x for x in (one, two) if x is not None] if article else [bool(one), bool(two)]
        if outside:
            out.append(False)
        elif sides and len(set(sides)) == 1:
            out.append(sides[0])
        elif heading and two is not None:
            out.append(two)
        else:
            out.append(bool(article) or (len(text) >= SHORT and any(sides)))
    return out


def test_whole_pages_equal_the_plain_version():
    rng = random.Random(11)
    parts = [f"<p>{EN}</p>", f"<p>{EN * 3}</p>", f"<p>{EN * 12}</p>", "<h2>A head</h2>", "<p>Short.</p>", MENU, "<p>© all rights reserved by the house of words and of numbers, in all the lands of the sea</p>", f"<p><a href=x>{EN}</a> {EN}</p>", "<div>Blue widgets red widgets green widgets large widgets small widgets cheap widgets old.</div>"]
    for _ in range(300):
        wraps = [("", ""), ("<article>", "</article>"), ("<aside>", "</aside>"), ("<div class=sidebar>", "</div>"), ("<nav>", "</nav>"), ("<section class=comments>", "</section>")]
        page = "".join(a + "".join(rng.choices(parts, k=rng.randrange(5))) + b for a, b in rng.choices(wraps, k=rng.randrange(1, 6)))
        found = blocks(f"<body>{page}</body>")
        assert judged(found) == plain_labels(found)


def test_tables_with_odd_rows(spark):
    long_page = f"<body><article>{'<p>' + EN * 3 + '</p>'}{'<p>' + EN * 4 + '</p>'}</article></body>" + "<div>" * 1000
    rows = [(1, None, None, "x", "x"), (2, "u", "", "x", "x"), (2, "u", long_page, "x", "x"), (2, "u", long_page, "x", "x"), (None, "v", "<p>Closed.</p>", "x", "x"), (3, "w", f"<body><article><p>{EN * 20000}</p></article></body>", "x", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted(((r.page_id or 0, r.n_chars) for r in extract(df).collect()))
    one = len(main_text(long_page))
    assert got == [(0, 7), (1, 0), (2, 0), (2, one), (2, one), (3, len((EN * 20000).strip()))]
    assert extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert extract(df.limit(0)).count() == 0
