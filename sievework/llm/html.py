"""Main text of web pages by equivalence-class template deduction.

A page is read into tokens in page order: tags by their path, text blocks by path and content. On each host, tokens with the
same occurrence vector over the host's pages form an equivalence class; a vector is held as the sum of hash(page, occurrences),
which adds up in any order, so no task sees a host's pages together. Tokens on ``MIN_SHARE`` of at least ``MIN_PAGES`` pages are
the host's candidates. On a page a class of two or more is valid if its tokens keep their order in each repetition and it nests
with the classes taken before it: it lies between two neighbouring tokens of each, or outside them. Text tokens of valid
classes are template; what stands between is in slots. Inside the article they are dropped where they fill a box of their own
(an author's note, a list of links); headings and paragraphs that articles of a host share stand.

The tags of the classes make up the host's template tree. From its root the deduction goes down to the tag whose slots hold
``MAIN_SHARE`` of the words outside links, as long as no heading is left behind: the slots under that tag are the article.
Where a template leaves no tenth of a page's article, the host's pages are copies of each other and their text stands.

Element names help where no template can tell: elements that are never article text (scripts, nav, footer, forms, ...) are left
out, as are elements whose class, id or role is one of the names in ``MARKED`` by itself; an <article> or <main> around or inside
the deduced tag bounds the text, and is all there is on hosts with fewer pages. Without any of these all blocks are text.

Broken markup: a raw element without an end, or closed in itself, takes no text with it; a tag whose quotes don't close ends
at its first ">".

A null html is empty and gives an empty text. A null or malformed url has the empty host. Repeated pages are pages of
their own. Empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_broadcast, materialize, table

#: A template token occurs on this share of its host's pages, and on this many.
MIN_SHARE = 0.6
MIN_PAGES = 3
#: Share of the words outside links below a tag that the article's tag holds.
MAIN_SHARE = 0.6
#: Hosts whose templates are sent to all executors; with more, pages are joined with them.
BROADCAST_HOSTS = 20_000

# fixed values: HTML element names by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mpadded mphantom semantics".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
#: Elements inside formulas whose content repeats them in another notation.
NOTATION = frozenset("annotation annotation-xml".split())
DROPPED = RAW | frozenset("head select object audio video canvas nav footer aside form button menu dialog".split())
#: Elements that an opening tag of the same kind ends.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Elements that a head may hold; others end it.
IN_HEAD = RAW | frozenset("meta link base".split())
REGION = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a block of text themselves; others hold several.
TEXTUAL = HEADING | frozenset("p li dt dd tr td th blockquote pre figcaption caption summary address".split())
#: Class, id or role names, each a whole name, of what is not the article.
MARKED = frozenset("ad ads advert adverts advertisement banner sponsored promo menu navbar navigation breadcrumb breadcrumbs sidebar footer cookie-notice cookie-banner cookies consent notice popup modal newsletter subscribe comment comments comment-list disqus_thread share-buttons social-links related related-posts pagination toolbar masthead skip-link contentinfo".split())

_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES}(?=>)|[^>]*+)(?:>|\Z)|<[!?][^>]*>""", re.S)
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | NOTATION}


class Event(NamedTuple):
    """A tag opened (text is None) or a text block, by the path of its element."""

    path: str
    up: str
    name: str
    text: str | None
    region: bool
    left_out: bool
    marked: bool
    words: int


def parse(page: str | None) -> list[Event]:
    """Tags and blocks in page order; words are those outside links.

    White space in a block becomes one space; tags that never close and end tags without a start are tolerated.
    """
    events: list[Event] = []
    if not page:
        return events
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]  # name, path, region, left out, marked
    held: list[str] = []
    linked = 0  # words of the block inside links
    link_from = -1  # pieces held where a link began

    def flush() -> None:
        nonlocal linked, link_from
        words = entities.unescape("".join(held)).split()
        if link_from >= 0:
            linked += len("".join(held[link_from:]).split())
            link_from = 0
        held.clear()
        if words:
            name, path, region, left_out, marked = stack[-1]
            events.append(Event(path, path, name, " ".join(words), region, left_out, marked, max(0, len(words) - linked)))
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name in NOTATION:
            if not m[1] and (end := _END_RAW[name].search(page, at)):
                at = end.end()
            continue
        if name in INLINE:
            if name == "img":
                held.append(" ")
            elif name == "a":
                if link_from >= 0:
                    linked += len("".join(held[link_from:]).split())
                link_from = -1 if m[1] else len(held)
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            link_from = -1  # a link without an end goes no further
            continue
        if name in VOID:
            continue
        if name in SELF_CLOSING and stack[-1][0] == name or stack[-1][0] == "head" and name not in IN_HEAD:
            stack.pop()
        _, up, region, left_out, marked = stack[-1]
        marks = " ".join(x[0] or x[1] or x[2] for x in _MARKS.findall(m[3])).split() if "=" in m[3] else []
        path = f"{up}/{'.'.join([name, *marks])}"
        # a header belongs to its article when it stands inside one
        left_out = left_out or name in DROPPED or (name == "header" and not region)
        marked = marked or (name not in ("html", "body") and any(x.lower() in MARKED for x in marks))
        events.append(Event(path, up, name, None, region, left_out, marked, 0))
        closed = m[3].endswith("/")
        if name in RAW:
            end = None if closed else _END_RAW[name].search(page, at)
            if end:
                at = end.end()
            elif not closed and (more := re.compile(r"<[a-zA-Z/!]").search(page, at)):
                at = more.start()
            continue
        if closed and name not in ("p", "div", "article", "section", "body"):
            continue
        stack.append((name, path, region or name in REGION, left_out, marked))
    flush()
    return events


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _token(e: Event) -> int:
    return _hash(f"t|{e.path}" if e.text is None else f"x|{e.path}|{e.text}")


#: Kinds of tokens.
TAG, HEADED, TEXT = 0, 1, 2


def page_tokens(page: str | None) -> list[tuple[int, int, int, int, int, int]]:
    """(token, its element's tag (a tag's parent), kind, occurrences, first place, words below it) of a page."""
    found: dict[int, list] = {}
    below: dict[str, int] = defaultdict(int)
    tags: dict[str, int] = {"": _hash("t|")}
    events = parse(page)
    for place, e in enumerate(events):
        token = _token(e)
        if e.text is None:
            tags[e.path] = token
            found.setdefault(token, [tags[e.up], HEADED if e.name in HEADING else TAG, 0, place, e.path])[2] += 1
        else:
            found.setdefault(token, [tags.get(e.path, tags[""]), TEXT, 0, place, None])[2] += 1
            if e.words and not e.left_out:
                at = e.path
                while at:
                    below[at] += e.words
                    at = at[: at.rfind("/")]
    return [(t, up, kind, n, place, below[path] if path else 0) for t, (up, kind, n, place, path) in found.items()]


def host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def deduce(rows: list[dict]) -> tuple[list[list[int]], int | None]:
    """(classes of two tokens or more, by mean place; the article's tag) from a host's candidates."""
    groups: dict[tuple, list] = defaultdict(list)
    below: dict[int, list] = defaultdict(list)
    for r in rows:
        groups[r["vector"], r["df"]].append((r["place"], r["token"]))
        if r["kind"] != TEXT:
            below[r["up"]].append(r)
    classes = [[t for _, t in sorted(g)] for g in groups.values() if len(g) > 1]
    tag, words = _hash("t|"), sum(r["words"] for r in below[_hash("t|")])
    article = None
    while not any(r["kind"] == HEADED for r in below[tag]):
        top = max(below[tag], key=lambda r: (r["words"], r["token"]), default=None)
        if top is None or not words or top["words"] < MAIN_SHARE * words:
            break
        tag, words, article = top["token"], top["words"], top["token"]
    return sorted(classes, key=lambda c: (-len(c), c)), article


def templates(pages: DataFrame) -> DataFrame:
    """(host, classes, article): each host's equivalence classes and the tag of its article, for hosts of MIN_PAGES pages or more."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for b in batches:
            rows = [(h, i, *t) for h, i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for t in page_tokens(p.as_py())]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "page", "token", "up", "kind", "n", "place", "words"])

    def deduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [deduce(rows) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.list_(pa.list_(pa.int64()))), pa.array([a for _, a in found], pa.int64())], ["host", "classes", "article"])

    slim = pages.select(host().alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")
    sizes = slim.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    rows = slim.mapInArrow(tokens, "host string, page long, token long, up long, kind int, n int, place int, words long")
    # the occurrence vector's hash is a sum, so partial sums meet in any order
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).cast("string").alias("vector")
    stats = rows.groupBy("host", "token").agg(F.count("*").alias("df"), vector, F.avg("place").alias("place"), F.min("up").alias("up"), F.max("kind").alias("kind"), F.sum("words").alias("words"))
    stats = stats.where(F.col("df") >= MIN_PAGES).join(sizes, "host").where(F.col("df") >= MIN_SHARE * F.col("pages"))
    by_host = stats.groupBy("host").agg(F.collect_list(F.struct("token", "up", "kind", "df", "vector", "place", "words")).alias("rows"))
    return by_host.mapInArrow(deduced, "host string, classes array<array<long>>, article long")


def template_places(tokens: list[int], classes: list[list[int]]) -> set[int]:
    """Places of a page's tokens that belong to classes that are valid and nest on it."""
    at: dict[int, list[int]] = defaultdict(list)
    for place, t in enumerate(tokens):
        at[t].append(place)
    taken: list[list[int]] = []
    found: set[int] = set()
    for members in classes:
        places = [at[m] for m in members if m in at]
        if len(places) < len(members) or len({len(p) for p in places}) != 1:
            continue
        # repetition by repetition, each in order
        turns = list(zip(*places, strict=True))
        flat = [p for turn in turns for p in turn]
        if any(a >= b for a, b in zip(flat, flat[1:], strict=False)):
            continue
        # each repetition lies between the same two tokens of each class taken so far
        if all(len({bisect_left(t, p) for p in turn}) == 1 for t in taken for turn in turns):
            taken.append(flat)
            found.update(flat)
    return found


def template_boxes(events: list[Event], scope: list[int], template: set[int], root: str | None) -> set[int]:
    """Of a page's template blocks those that are no part of an article: outside one, or in a box of it that holds template alone.

    A box is an element below the article that isn't a block of text itself. Headings and paragraphs that pages share stand.
    """
    held: dict[str, list[int]] = defaultdict(list)
    out: set[int] = set()
    for k in scope:
        names = events[k].path.split("/")
        if root is not None:
            top = root.count("/") + 1
        else:
            top = next((i + 1 for i, x in enumerate(names) if x.split(".")[0] in REGION), 0)
        if not top:
            out |= {k} & template
            continue
        last = len(names) - (names[-1].split(".")[0] in TEXTUAL)
        for i in range(top + 1, last + 1):
            held["/".join(names[:i])].append(k)
    return out.union(*[x for x in held.values() if template.issuperset(x)])


def main_text(page: str | None, classes: list[list[int]] = (), article: int | None = None) -> str:
    """The article's blocks, one per line."""
    events = parse(page)
    scope = [k for k, e in enumerate(events) if e.text is not None and not e.left_out]
    template: set[int] = set()
    root = None
    if classes:
        tokens = [_token(e) for e in events]
        template = template_places(tokens, classes)
        root = next((e.path for e, t in zip(events, tokens, strict=True) if e.text is None and t == article), None)
        if root is not None:
            names = root.split("/")
            outer = next((i for i, x in enumerate(names) if x.split(".")[0] in REGION), len(names) - 1)
            root = "/".join(names[: outer + 1])
            under = [k for k in scope if events[k].path == root or events[k].path.startswith(root + "/")]
            scope = under or scope
    scope = [k for k in scope if events[k].region] or scope
    scope = [k for k in scope if not events[k].marked] or scope
    dropped = template_boxes(events, scope, template, root) if template else template
    own = [k for k in scope if k not in dropped]
    size = lambda some: sum(len(events[k].text) for k in some)
    if 10 * size(own) < size(scope):
        own = scope
    return "\n".join(events[k].text for k in own)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    found = bounded_broadcast(materialize(templates(pages), "html-templates"), BROADCAST_HOSTS)
    out = "page_id long, url string, text string, n_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py(), classes.as_py() or (), article.as_py()) for page, classes, article in zip(*b.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    return slim.join(found, "host", "left").select("page_id", "url", "html", "classes", "article").mapInArrow(read, out)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
