"""Secret scans by a trigram inverted index.

Each rule's regular expression is read once into a Boolean query over trigrams that every match must hold (ANDs along a
concatenation, ORs over alternatives and small character sets, joined across neighbours by their last and first bytes). Texts
are indexed block by block where they are read: a block's postings list, for each trigram that any rule asks for, the texts that
hold it. A rule's query intersects and unites postings; only the candidates left are searched with the expression. A rule
without a mandatory trigram (hex digits) searches every text in full. The index lies with its texts, so no text is shuffled and
memory is bounded by one block; trigrams are of UTF-8 bytes with A-Z lower-cased, so one index serves rules of either case.

Rules are written for ASCII (re.ASCII). A rule's matches are leftmost and don't overlap each other; those whose measured group
is too short are dropped. Matches of different rules may overlap.

A null text is empty and has no spans; so has an empty one. Repeated rows, null and repeated ids stand for themselves, one row
out for each row in. Other columns are left out, so no name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from re import _constants as sre, _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table


class Rule(NamedTuple):
    """A kind of secret: its expression, and the least length of a group's text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the base rules
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the same as runs of one or more digits with the short ones dropped
)
#: Public formats of keys and tokens, and credentials inside addresses.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    Rule("bearer", r"(?i:authorization:\x20*bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    Rule("address", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

#: Sets of strings beyond this size are no longer told apart.
SET_SIZE = 32
#: Bytes of a block that are looked up at a time.
SLICE = 1 << 22

#: A trigram query: True (anything may match), a trigram, or ("and" or "or", queries).
Query = bool | int | tuple


def _all(queries) -> Query:
    parts = {q for q in queries if q is not True}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _any(queries) -> Query:
    parts = set(queries)
    return True if True in parts or not parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _holds(strings) -> Query:
    """What a text with one of the strings must hold."""
    return _any(_all((s[i] << 16) | (s[i + 1] << 8) | s[i + 2] for i in range(len(s) - 2)) for s in strings)


class Facts(NamedTuple):
    """Of a part of an expression: all strings it matches (None: too many), the ways a match may begin and end, the query."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    query: Query


NOTHING = frozenset([b""])
ANYTHING = Facts(None, NOTHING, NOTHING, True)


def _of(strings) -> Facts:
    strings = frozenset(strings)
    if len(strings) > SET_SIZE:
        return ANYTHING
    return Facts(strings, frozenset(s[:2] for s in strings), frozenset(s[-2:] for s in strings), _holds(strings))


def _open(x: Facts) -> Facts:
    return x._replace(exact=None)


def _then(x: Facts, y: Facts) -> Facts:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= SET_SIZE:
        return _of(a + b for a, b in product(x.exact, y.exact))
    ways = lambda a, b: [p + q for p, q in product(a, b)] if len(a) * len(b) <= SET_SIZE else [b""]
    first = ways(x.exact, y.first) if x.exact is not None else x.first
    last = ways(x.last, y.exact) if y.exact is not None else y.last
    return Facts(None, frozenset(s[:2] for s in first), frozenset(s[-2:] for s in last), _all([x.query, y.query, _holds(ways(x.last, y.first))]))


def _either(xs: list[Facts]) -> Facts:
    if all(x.exact is not None for x in xs) and sum(len(x.exact) for x in xs) <= SET_SIZE:
        return _of(s for x in xs for s in x.exact)
    return Facts(None, frozenset().union(*[x.first for x in xs]), frozenset().union(*[x.last for x in xs]), _any(x.query for x in xs))


def _characters(items) -> Facts:
    found: set[bytes] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).encode().lower())
        elif op is sre.RANGE and value[1] - value[0] < SET_SIZE:
            found |= {chr(c).encode().lower() for c in range(value[0], value[1] + 1)}
        else:
            return ANYTHING
    return _of(found)


def _facts(parsed) -> Facts:
    out = _of([b""])
    for op, value in parsed:
        if op is sre.LITERAL:
            part = _of([chr(value).encode().lower()])
        elif op is sre.IN:
            part = _characters(value)
        elif op is sre.SUBPATTERN:
            part = _facts(value[3])
        elif op is sre.ATOMIC_GROUP:
            part = _facts(value)
        elif op is sre.BRANCH:
            part = _either([_facts(p) for p in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _facts(inner)
            if least == 0:
                part = _either([_of([b""]), once]) if most == 1 else ANYTHING
            else:
                part = once
                for _ in range(min(least, 4) - 1):
                    part = _then(part, once)
                part = part if most == least <= 4 else _open(part)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _of([b""])
        else:
            part = ANYTHING
        out = _then(out, part)
    return out


@lru_cache(maxsize=1024)
def trigram_query(pattern: str) -> Query:
    """What a text must hold to match the pattern: True, a trigram (three bytes as a number), or ("and" or "or", queries)."""
    return _facts(_parser.parse(pattern, re.ASCII)).query


def trigrams(query: Query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*[trigrams(q) for q in query[1]])


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class Index:
    """Postings of one block: for each asked trigram the numbers of the texts that hold it, ascending."""

    def __init__(self, texts: pa.StringArray, slots: dict[int, int], lookup: np.ndarray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        found: list[np.ndarray] = []
        for at in range(int(offsets[0]), int(offsets[-1]) - 2, SLICE):
            d = _LOWER[data[at : min(at + SLICE, int(offsets[-1]) - 2) + 2]]
            slot = lookup[(d[:-2] << 16) | (d[1:-1] << 8) | d[2:]]
            here = np.flatnonzero(slot)
            text = np.searchsorted(offsets, here + at, side="right") - 1
            whole = here + at + 3 <= offsets[text + 1]  # not across two texts
            found.append(np.unique((slot[here[whole]].astype(np.int64) << 32) | text[whole]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        self.n, self.slots, self.texts = len(texts), slots, pairs & 0xFFFFFFFF
        self.edges = np.searchsorted(pairs >> 32, np.arange(len(slots) + 2))

    def postings(self, trigram: int) -> np.ndarray:
        k = self.slots[trigram]
        return self.texts[self.edges[k] : self.edges[k + 1]]

    def candidates(self, query: Query) -> np.ndarray:
        """Texts that satisfy a query; all of them if it is True."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.postings(query)
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        out = lists[0]
        for other in lists[1:]:  # the shortest first
            if not len(out):
                break
            out = np.intersect1d(out, other, assume_unique=True)
        return out


def _scanner(rules: tuple[Rule, ...]):
    """A function from an Arrow array of texts to each text's spans (start, rule's place, end)."""
    queries = [trigram_query(r.pattern) for r in rules]
    slots = {t: i + 1 for i, t in enumerate(sorted(set().union(*map(trigrams, queries))))}
    lookup = np.zeros(1 << 24, np.uint8 if len(slots) < 255 else np.uint16)
    for t, k in slots.items():
        lookup[t] = k
    compiled = [re.compile(r.pattern, re.ASCII) for r in rules]

    def scan(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        texts = texts.cast(pa.string()).fill_null("")
        index = Index(texts, slots, lookup)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for k, (rule, query, expression) in enumerate(zip(rules, queries, compiled, strict=True)):
            for i in index.candidates(query).tolist():
                for m in expression.finditer(texts[i].as_py()):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in found]

    return scan


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points, by start, then kind as listed) of each row (doc_id, text)."""
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(rules)
        for b in batches:
            spans = [[(kinds[k], s, e) for s, k, e in x] for x in scan(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text with each stretch covered by spans replaced by [kind] of the first of them; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(rules)
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), scan(b.column(1)), strict=True):
                parts, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        parts += [text[at:s], f"[{rules[k].kind}]"]
                    at = max(at, e)
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents by all rules; those of the base rules counted and hashed."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    base = of(*[r.kind for r in BASE])
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = {f"n_{r.kind}": F.size(of(r.kind)).cast("long") for r in BASE}
    return found.select("doc_id", *[c.alias(name) for name, c in counts.items()], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def oracle() -> str:
    """Places from the lengths of matches and of what stands between them."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    parts = [f"SELECT rid, {k} AS k, '{r.kind}' AS kind, string_split_regex(t, {quote(r.pattern)}) AS gaps, regexp_extract_all(t, {quote(r.pattern)}) AS whole, regexp_extract_all(t, {quote(r.pattern)}, {r.group}) AS held, {r.least} AS least FROM d WHERE regexp_matches(t, {quote(r.pattern)})" for k, r in enumerate(RULES)]
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT rid, k, kind, least, unnest(gaps[1:len(whole)]) AS gap, unnest(whole) AS match, unnest(held) AS own, generate_subscripts(whole, 1) AS i FROM m),
p AS (SELECT rid, k, kind, length(own) >= least AS ok, sum(length(gap) + length(match)) OVER (PARTITION BY rid, k ORDER BY i) AS stop, length(match) AS n FROM e),
s AS (SELECT rid, {counts}, coalesce(string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, k) FILTER (kind IN ({base})), '') AS b, string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, k) AS a FROM p WHERE ok GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN s USING (rid)"""
