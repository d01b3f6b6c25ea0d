"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path.  Text
length and punctuation are summed per path and divided by the path's nodes; the
two ratios, smoothed over neighbouring nodes with a Gaussian, are fused into one
score; nodes above a share of its spread, on paths that are above it too, are
content.  The content container is the element that holds the content: if the page
marks an ``article`` or ``main``, the first whose content is a fair share of the
largest one's (the outermost of those with the same content, without other articles
that hold none), else the smallest element that holds all content and is no
paragraph, heading, list or table.  Its blocks are returned in page order, without what the page's
own markup declares not to be the article (navigation, footers, asides, forms,
adverts, ...), whose paths take no part in the ratios.  Inside
the container a class, id or role that only contains a word for such parts
("side-effects") takes a block out only if its paths are below the threshold too.

Reader comments are prose like the article, so no score can tell them: an element named
for them ("comments", "comment-list", "commentlist", "discussion") goes out with all it
holds, and an article inside it is never the page's.

Defined results: null or empty html and pages without text: the empty string.
Unclosed elements, comments and scripts end with the page.  Extra columns are
ignored; repeated rows are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe object svg math select button canvas audio video".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
#: What an opening tag ends without an end tag.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = frozenset("ul ol dl table div section article main body html aside nav td th blockquote form".split())
#: Elements that never hold the article.
ASIDE = frozenset("nav footer aside form menu dialog head header fieldset".split())
#: Elements that can hold a whole article without being marked as one.
_CONTAINERS = frozenset(["", *"article blockquote body center details div html main section td th".split()])
#: Words of class, id and role that name page furniture.
_KINDS = (
    r"(?:ads?|adverts?|advertis\w*|banner|sponsor\w*|promo\w*|sidebar|side|widget|menu|nav\w*|breadcrumbs?|header|masthead|footer|"
    r"comments?|replies|reply|respond|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|"
    r"social|related|recommend\w*|toolbar|search|form|complementary|contentinfo|hidden)")
#: Words for a part of the layout, which tell nothing of what it holds.
_PARTS = r"(?:box|boxes|lists?|posts?|articles?|stories|links?|items?|area|section|wrap|wrapper|container|blocks?|bar|unit|slot|panel|buttons?|icons?|group|inner|outer|feed)"
_FURNITURE = re.compile(rf"(?:^|[\s_-]){_KINDS}(?:$|[\s_-])", re.I)
#: The same as a whole name, maybe with words for parts ("ad-box", "related-posts").
_WHOLE = re.compile(rf"(?:^|\s){_KINDS}(?:[_-]?(?:{_KINDS}|{_PARTS}))*(?:$|\s)", re.I)
#: Names that end in a word for reader comments, but for those that say whether there are any ("no-comments").
_COMMENTS = re.compile(
    rf"(?:^|[\s_-])(?<!\bno[_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?:comments?|commenters?|disqus|respond|replies)"
    rf"(?:[_-]?(?:{_PARTS}|threads?|body|content|holder|stream|view|form))*(?:$|\s)", re.I)
_DISCUSSION = re.compile(rf"(?:^|[\s_-])discussions?(?:[_-]?(?:{_PARTS}|threads?))*(?:$|\s)", re.I)
#: Elements whose id is the address of a place in the text.
_PLACES = frozenset("h1 h2 h3 h4 h5 h6 section p li dt dd a span".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、！？]")

SIGMA = 1.0
THRESHOLD = 0.8
#: The least share of the best score that is content, where scores hardly spread.
FLOOR = 0.1
#: The share of the largest marked article's content that an earlier one needs.
FIRST = 1 / 3


class _Element:
    __slots__ = ("tag", "path", "up", "out", "named", "comment")

    def __init__(self, tag, names, up, out, named=False, comment=False):
        self.tag, self.up, self.out = tag, up, out
        #: in an article that is named for comments
        self.comment = comment or bool(up and up.comment)
        #: the nearest element from here up that part of a name calls furniture
        self.named = self if named else up.named if up else None
        self.path = (up.path if up else "") + "/" + tag + ("." + names if names else "")


def _attributes(said: str) -> dict[str, str]:
    """An opening tag's attributes by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(said):
        out.setdefault(name.lower(), a or b or c)
    return out


def text_nodes(html: str) -> list[tuple[str, _Element, int]]:
    """(decoded text, element, block) of the page's text nodes in order.  Nodes
    of one block have the same block number."""
    nodes, block, now = [], 0, _Element("", "", None, False)
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not html[at:end].isspace():
            nodes.append((entities.unescape(html[at:end]), now, block))
        elif end > at:
            nodes.append((" ", now, block))
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in BLOCK:
            block += 1
        if tag == "br":
            nodes.append((" ", now, block))
        if closing:
            e = now
            while e.up and e.tag != tag:
                e = e.up
            if e.up:
                now = e.up
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            e = now
            while e.up and e.tag not in _SCOPE and e.tag != "p":
                e = e.up
            if e.tag == "p":
                now = e.up
        if ends := _CLOSES.get(tag):
            e = now
            while e.up and e.tag not in ends and e.tag not in ("ul", "ol", "dl", "table", "select"):
                e = e.up
            if e.tag in ends:
                now = e.up
        has = _attributes(attributes) if attributes else {}
        names = " ".join(has[a] for a in ("class", "id", "role") if has.get(a))
        inside = now.tag == "article" or "/article" in now.path
        aside = tag in ASIDE and not (tag == "header" and inside)
        hidden = "hidden" in has or has.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(has.get("style", "")))
        named = whole = False
        if names and tag not in ("html", "body", "article", "main"):
            layout = " ".join(has[a] for a in ("class", "role", *(() if tag in _PLACES else ("id",))) if has.get(a))
            if _FURNITURE.search(names):
                whole = bool(_WHOLE.search(layout))
                named = bool(_FURNITURE.search(layout)) or tag not in ("h1", "h2", "h3", "h4", "h5", "h6")
            elif layout:  # two words as one: "adbox", "commentlist"
                whole = bool(_WHOLE.search(layout))
            said = names if tag == "section" else layout
            whole = whole or bool(_COMMENTS.search(said)) or bool(_DISCUSSION.search(has.get("class", "")))
        comment = tag == "article" and bool(_COMMENTS.search(has.get("class", "")))
        if not attributes.endswith("/") or tag in BLOCK:
            first = tag in ("article", "main") and not re.search(r"/(?:article|main)\b", now.path)
            now = _Element(tag, names, now, now.out or aside or whole or hidden, named, comment)
            if first:  # what the page marks as its article is judged by itself, whatever it is wrapped in
                now.named = None
    return nodes


def _smooth(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        num = den = 0.0
        for k, w in enumerate(kernel, i - reach):
            if 0 <= k < len(values):
                num += w * values[k]
                den += w
        out.append(num / den)
    return out


def path_ratios(nodes: list[tuple[str, _Element, int]]) -> tuple[list[float], list[float]]:
    """Text per path and punctuation per path of each node."""
    text, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for said, e, _ in nodes:
        text[e.path] += len(said)
        marks[e.path] += len(_PUNCTUATION.findall(said))
        count[e.path] += 1
    return [text[e.path] / count[e.path] for _, e, _ in nodes], [marks[e.path] / count[e.path] for _, e, _ in nodes]


def _fused(by_text: list[float], by_marks: list[float]) -> list[float]:
    return [a * (1.0 + b) for a, b in zip(by_text, by_marks)]


def path_scores(nodes: list[tuple[str, _Element, int]]) -> list[float]:
    """The fused score of each node: the smoothed text-per-path ratio times the
    smoothed punctuation-per-path ratio (plus one, for text without any)."""
    by_text, by_marks = path_ratios(nodes)
    return _fused(_smooth(by_text, SIGMA), _smooth(by_marks, SIGMA))


def _up(e: _Element):
    while e:
        yield e
        e = e.up


def _container(mass: dict[_Element, int], content: list[_Element]) -> _Element:
    """The smallest container of all content; a table cell only if it holds
    more than its own text."""
    box = next(a for a in _up(content[0]) if mass[a] == len(content))
    while box.up and (box.tag not in _CONTAINERS or box.tag in ("td", "th", "blockquote") and box in content):
        box = box.up
    return box


def _holds(box: _Element, e: _Element, mass: dict[_Element, int]) -> bool:
    """Whether text of ``e`` is in the box, and in no other article without content."""
    for a in _up(e):
        if a is box:
            return True
        if a.tag == "article" and not mass.get(a):
            return False
    return False


def _named(e: _Element, box: _Element):
    """The elements from ``e`` up to the box that a name calls furniture."""
    a = e.named
    while a and a is not box:
        yield a
        a = a.up.named if a.up else None


def _furniture(every: list[tuple[str, _Element, int]], box: _Element, least: float) -> set[_Element]:
    """The named elements of the box that are furniture: less than half of
    their text is on paths above the threshold."""
    nodes = [x for x in every if x[1].named and not x[0].isspace() and any(a is box for a in _up(x[1]))]
    total, content = defaultdict(int), defaultdict(int)
    for (said, e, _), s in zip(nodes, _fused(*path_ratios(nodes))):
        for a in _named(e, box):
            total[a] += len(said)
            content[a] += len(said) if s >= least else 0
    return {a for a in total if 2 * content[a] < total[a]}


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by one line break."""
    every = [x for x in text_nodes(html or "") if not x[1].out]
    every = [x for x in every if not x[1].comment] or every  # unless all of the page is named so
    nodes = [x for x in every if not x[0].isspace()]
    nodes = [x for x in nodes if not x[1].named] or nodes
    if not nodes:
        return ""
    scores = path_scores(nodes)
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
    least = min(max(THRESHOLD * spread, FLOOR * max(scores)), max(scores))
    own = _fused(*path_ratios(nodes))  # a short link beside a long paragraph is not content
    chosen = [s >= least and o >= least for s, o in zip(scores, own)]
    if not any(chosen):
        chosen = [s >= least for s in scores]
    mass, marked = defaultdict(int), defaultdict(float)
    for (said, e, _), content in zip(nodes, chosen):
        for a in _up(e):
            mass[a] += content
            if a.tag in ("article", "main"):
                marked[a] += content * len(said) + 1e-6 * len(said)
    if marked:
        top = max(marked.values())
        first = next(a for a in marked if marked[a] >= FIRST * top)  # the dictionary is in page order
        box = max(reversed([a for a in _up(first) if a in marked]), key=marked.get)  # of equal ones the outermost
    else:
        box = _container(mass, [e for (_, e, _), content in zip(nodes, chosen) if content])
    gone = _furniture(every, box, least)
    blocks: dict[int, list[str]] = {}
    for said, e, block in every:
        if not any(a in gone for a in _named(e, box)) and _holds(box, e, mass):
            blocks.setdefault(block, []).append(said)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    def fn(batch: pa.RecordBatch) -> dict:
        text = [main_text(x) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string()),
                "n_chars": pa.array([len(x) for x in text], pa.int64())}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, fn, "page_id long, url string, text string, n_chars long", "html")


def op1_html_text(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
