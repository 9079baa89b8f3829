"""Main text of web pages by two-pass block rules.

First pass: every block (text between block-level tags) gets points: for its stop-word density, its
length, its link density, and for where it stands (in an article, or in a container that usually holds
something else; where a page has an article, also for standing outside). A name of a container decides
nothing by itself: one that holds half of the page's dense unlinked text or more (of that in articles, where there
are any; comments aside) is no side container. Stop words are those of four languages, or, on a page that
hardly has any, its own short frequent words; texts without spaces go by their punctuation. Enough points
make a block good, too few bad, and what lies between, short blocks above all, stays open. Second pass: an
open block takes the label of its nearest decided neighbours in the same article (or outside all); where these
differ or are missing, headings go with what follows, longer prose with a good neighbour, and the rest with the
place. Where no block is good, the open ones are. A linked list or a notice in an article goes.

A hidden element without an end tag ends at the next block-level tag or with its parent, a head at the
first element of the body; a tag without an end swallows the rest, as in browsers. Each page is read in
time linear in its length. Null or empty html gives an empty text; repeated pages are judged one by one;
other columns are ignored; nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous
    als auch auf aus bei das dass dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so um und von war wie wird zu zum
    al como con del el ella en era es esta fue ha hay la las lo los más no para pero por que se ser sin su sus también una uno y ya""".split()
)
#: Elements of raw text, which without an end tag run to the end of the page.
RAW = frozenset("script style textarea".split())
#: Other elements whose text is never shown as text.
HIDDEN = frozenset("noscript template svg iframe object select head math canvas audio video".split())
#: Elements that end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold no main text; a header counts only outside an article.
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Elements whose end also ends hidden elements left open in them.
FRAMES = frozenset("article aside blockquote body div footer form header html main nav section table td".split())
#: What stands in a head, and what does not end a hidden element without an end tag.
IN_HEAD = frozenset("html head title meta base link basefont bgsound style script noscript template noframes".split())
WITHIN = frozenset("option title legend".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that end where a like one begins.
LIKE = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option", "p": "p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|widget\w*|comments?|commentlist|disqus|respond|replies|reply|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|"
    r"cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|toolbar|pagination|pager|skip|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Beginnings of a name that say what a layout has, not what an element is.
LAYOUT = re.compile(r"(?:^|\s)(?:has|no|not|with|without|is)[_-]\S*", re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What ends a tag or opens a quoted value in it.
STEP = re.compile(r"""=\s*["']|>""")
RAW_END = {name: re.compile(f"</{name}(?![a-zA-Z0-9:-])", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
ROLE = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog)\b", re.I)
COMMENT = re.compile(r"comment|reply", re.I)
RIGHTS = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)
WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no spaces between words (Thai, Lao, Burmese, Khmer, Japanese, Chinese), and where their texts pause.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
PAUSE = re.compile(r"[。！？、，；။។\s]")

#: Lengths of a short, a long and a very long block; stop-word densities of prose that may be and that is; share of linked text.
SHORT, LONG, VERY_LONG, LOW, HIGH, LINKS = 70, 200, 1000, 0.18, 0.28, 0.4
#: Stop-word density below which a page's own short words (of at most so many letters, so often) count; characters to a pause in a text without spaces.
FOREIGN, FEW_LETTERS, OFTEN, TO_PAUSE = 0.1, 3, 3, 60
#: Points from which a block is good, and up to which it is bad.
GOOD, BAD = 2, -1

#: start, end, name ("" for text), whether it closes, attributes or text.
Token = tuple[int, int, str, bool, str]


def tokens(page: str) -> list[Token]:
    """Tags and texts in order; comments, declarations and the contents of raw elements are left out."""
    out: list[Token] = []
    at, size = 0, len(page)
    while at < size:
        i = page.find("<", at)
        if i != at:
            stop = i if i >= 0 else size
            out.append((at, stop, "", False, page[at:stop]))
            at = stop
            continue
        if page.startswith("<!--", at):
            i = page.find("-->", at + 2)
            at = i + 3 if i >= 0 else size
            continue
        m = NAME.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "/", "?"):
                i = page.find(">", at)
                at = i + 1 if i >= 0 else size
            else:
                out.append((at, at + 1, "", False, "<"))
                at += 1
            continue
        end = m.end()
        while (step := STEP.search(page, end)) and step[0] != ">":
            i = page.find(step[0][-1], step.end())
            end = i + 1 if i >= 0 else step.end()
        if not step:
            break
        name, closing, said = m[1].lower(), page[at + 1] == "/", page[m.end() : step.start()]
        if name in RAW and not closing:
            if not said.endswith("/"):
                i = RAW_END[name].search(page, step.end())
                i = page.find(">", i.end()) if i else -1
                at = i + 1 if i >= 0 else size
            else:
                at = step.end()
            continue
        out.append((at, step.end(), name, closing, said))
        at = step.end()
    return out


def hidden_ends(found: list[Token]) -> dict[int, int]:
    """Start of each hidden element that has an end tag -> where that tag ends; a body also ends its head."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    for start, end, name, closing, said in found:
        if name not in HIDDEN and name not in FRAMES:
            continue
        if name == "body" and not closing and held.get("head"):
            while (last := stack.pop())[0] != "head":
                held[last[0]] -= 1
            held["head"] -= 1
            ends[last[1]] = start
        if not closing:
            if not said.endswith("/") or name not in HIDDEN:
                stack.append((name, start))
                held[name] = held.get(name, 0) + 1
        elif held.get(name):
            while (last := stack.pop())[0] != name:
                held[last[0]] -= 1
            held[name] -= 1
            if name in HIDDEN:
                ends[last[1]] = end
    return ends


class Open:
    """The open elements: blocks on a stack, each with its open inline elements, and counts of what matters of them."""

    def __init__(self) -> None:
        #: Name, number of the innermost side container or 0, number of its article or 0, inline elements.
        self.stack: list[tuple[str, int, int, dict[str, int]]] = [("", 0, 0, {})]
        self.names: dict[str, int] = {}
        self.links = self.articles = 0
        self.inside = [0]
        #: Of each side container: the one around it, and whether it is one of comments.
        self.around, self.comments = [0], [False]

    def push(self, name: str, outside: bool, article: bool, comment: bool) -> None:
        self.articles += article
        container = self.stack[-1][1]
        if outside:
            self.around.append(container)
            self.comments.append(comment or self.comments[container])
            container = len(self.around) - 1
        self.stack.append((name, container, self.articles if article else 0, {}))
        self.names[name] = self.names.get(name, 0) + 1
        if article:
            self.inside.append(self.articles)

    def pop(self) -> str:
        name, _, article, inline = self.stack.pop()
        self.names[name] -= 1
        self.links -= inline.get("a", 0)
        if article:
            self.inside.pop()
        return name

    def close(self, name: str) -> None:
        if self.names.get(name):
            while self.pop() != name:
                pass

    def inline(self, name: str, closing: bool) -> None:
        held = self.stack[-1][3]
        now = held.get(name, 0)
        if not closing:
            held[name] = 1 if name == "a" else now + 1
        elif now:
            held[name] = now - 1
        if name == "a":
            self.links += held.get(name, 0) - now


#: Text, share of linked text, whether it stands in a container without main text, its article or 0, whether it is a heading.
Block = tuple[str, float, bool, int, bool]


def blocks(page: str) -> list[Block]:
    opened = Open()
    return settled(list(_blocks(page, opened)), opened)


def settled(found: list[tuple[str, float, int, int, bool]], opened: Open) -> list[Block]:
    """Blocks with the number of their side container -> whether they stand in one that is one indeed."""
    stop = own_words(found)
    free = [(len(text), container, bool(article), density(text, stop) >= LOW) for text, links, container, article, _ in found if links <= LINKS]
    plain = [x for x in free if x[3]] or free
    own = [x for x in plain if not opened.comments[x[1]]]
    voices = [x for x in own if x[2]] or own or plain
    held = [0] * len(opened.around)
    for size, container, *_ in voices:
        held[container] += size
    for i in range(len(held) - 1, 0, -1):  # a container comes after the one around it
        held[opened.around[i]] += held[i]
    side = [False]
    for i in range(1, len(held)):
        side.append(side[opened.around[i]] or 2 * held[i] < held[0] or not held[0])
    return [(text, links, side[container], article, heading) for text, links, container, article, heading in found]


def _blocks(page: str, opened: Open) -> Iterator[tuple[str, float, int, int, bool]]:
    parts: list[str] = []
    linked = breaks = skip = 0
    found, hidden = tokens(page), ""
    ends = hidden_ends(found)

    def done() -> Iterator[Block]:
        nonlocal linked, breaks
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            yield text, min(1.0, linked / len(text)), opened.stack[-1][1], opened.inside[-1], opened.stack[-1][0] in HEADINGS
        parts.clear()
        linked = breaks = 0

    for start, _, name, closing, said in found:
        if start < skip:
            continue
        if hidden:
            if not name:
                continue
            if name not in HIDDEN and (name not in IN_HEAD if hidden == "head" else name in BLOCKS and name not in WITHIN or closing and opened.names.get(name)):
                hidden = ""
        if hidden:
            skip = ends.get(start, skip)
        elif not name:
            parts.append(said)
            if not said.isspace():
                breaks = 0
                if opened.links:
                    linked += len(" ".join(entities.unescape(said).split()))
        elif name in HIDDEN:
            if not closing and not said.endswith("/"):
                skip = ends.get(start, 0)
                hidden = "" if skip else name
        elif name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                yield from done()
        elif name in VOID:
            if name == "hr":
                yield from done()
        elif name in BLOCKS:
            yield from done()
            if closing:
                opened.close(name)
                continue
            if opened.stack[-1][0] == "p":
                opened.pop()
            if opened.stack[-1][0] in (name, LIKE.get(name)) and name in LIKE:
                opened.pop()
            marks = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(said))
            article = name in ("article", "main")
            outside = name in OUTSIDE or name == "header" and not opened.inside[-1] or name not in ("html", "body", "article", "main") and bool(MARKED.search(LAYOUT.sub(" ", marks)) or ROLE.search(marks)) or name == "article" and bool(COMMENT.search(marks))
            opened.push(name, outside, article, bool(COMMENT.search(LAYOUT.sub(" ", marks))))
        else:
            opened.inline(name, closing)
    yield from done()


def own_words(found: list) -> frozenset[str]:
    """The stop words of a page: the fixed ones, or its own short frequent words where it hardly has any of those."""
    seen = [w for text, links, *_ in found if links <= LINKS for w in WORD.findall(text.lower())]
    if sum(w in STOP_WORDS for w in seen) >= FOREIGN * len(seen):
        return STOP_WORDS
    counts: dict[str, int] = {}
    for w in seen:
        if len(w) <= FEW_LETTERS:
            counts[w] = counts.get(w, 0) + 1
    return frozenset(w for w, n in counts.items() if n >= OFTEN)


def density(text: str, stop: frozenset[str]) -> float:
    """Share of stop words; of a text without spaces, HIGH where it pauses often enough, else 0."""
    if 2 * len(UNSPACED.findall(text)) > len(text):
        return HIGH if len(PAUSE.findall(text)) * TO_PAUSE >= len(text) else 0.0
    seen = WORD.findall(text.lower())
    return sum(w in stop for w in seen) / max(1, len(seen))


def points(text: str, links: float, outside: bool, article: int, apart: bool, stop: frozenset[str] = STOP_WORDS) -> int | None:
    """The points of a block; None for a short one whose place says nothing against it. ``apart`` is for a block outside the page's articles."""
    against = 3 * outside + (not outside and apart) + (not article and bool(RIGHTS.search(text)))
    if links > LINKS:
        return BAD - against
    if len(text) < SHORT:
        return None if not against and not (links and not article) else BAD - against
    share = density(text, stop)
    said = 1 if share >= HIGH else 0 if share >= LOW else -1
    return said + (len(text) > LONG) + (len(text) > VERY_LONG and said > 0) + bool(article and not outside) - against


def nearest(labels: list[bool | None], of: list[int]) -> list[bool | None]:
    """The last decided label before each block among those of its article."""
    last: dict[int, bool] = {}
    out = []
    for label, article in zip(labels, of, strict=True):
        out.append(last.get(article))
        if label is not None:
            last[article] = label
    return out


def first_labels(found: list[Block]) -> list[bool | None]:
    """The first pass: good, bad or (None) open."""
    some = any(x[3] for x in found)
    stop = own_words(found)
    scores = [points(text, links, outside, article, some and not article, stop) for text, links, outside, article, _ in found]
    return [None if p is None or BAD < p < GOOD else p >= GOOD for p in scores]


def judged(found: list[Block]) -> list[bool]:
    """Both passes: whether each block is main text."""
    labels = first_labels(found)
    # Blocks in side containers decide nothing for those beside them.
    votes = [None if x[2] and x[3] else label for label, x in zip(labels, found, strict=True)]
    of = [x[3] for x in found]
    before, after = nearest(votes, of), nearest(votes[::-1], of[::-1])[::-1]
    out = []
    for (text, _, outside, article, heading), label, one, two in zip(found, labels, before, after, strict=True):
        if label is None:
            sides = [x for x in (one, two) if x is not None] if article else [bool(one), bool(two)]
            if outside:
                label = False
            elif sides and all(x == sides[0] for x in sides):
                label = sides[0]
            elif heading and two is not None:
                label = two
            else:
                label = bool(article) or len(text) >= SHORT and any(sides)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = judged(found)
    if not any(labels):
        labels = [label is None and not x[2] for label, x in zip(first_labels(found), found, strict=True)]
    return "\n".join(x[0] for x, good in zip(found, labels, strict=True) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
