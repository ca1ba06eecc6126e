"""Secret scan over whole texts with a trigram inverted index.

The Boolean trigram query of a rule is derived from its regular expression: every run of literal
characters, small classes, alternatives and optional parts gives the strings that it may be, hence an
OR over strings of an AND over their trigrams; runs that follow each other are ANDed. A task indexes
one slice of texts at a time: postings (trigram -> sorted rows) for the trigrams that any query
names, from one pass over the slice's bytes with A-Z lower-cased. Queries intersect and unite
postings; the rows left are verified by the regular expression. Rules without mandatory trigrams
(hexadecimal runs) scan every row. Postings are local to a slice, so nothing is shuffled and no
posting list grows with the corpus.

Cases: null and empty texts have no spans; repeated rows are kept; an empty table gives no rows;
extra columns are ignored, whatever their names. Positions are code points, ends exclusive. A text is
held whole, with its lower-cased bytes and the places of its trigrams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytetext import LOWER, slices, utf8


#: Most strings that one run of characters is expanded to, and most alternatives of a query.
MOST = 64


def codes(word: str) -> list[int]:
    b = word.lower().encode()
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


def _smallest(query: set[frozenset[int]]) -> list[frozenset[int]]:
    """Alternatives that another one's trigrams imply are dropped; all texts match an empty alternative."""
    return [q for q in sorted(query, key=lambda q: (len(q), sorted(q))) if not any(o < q for o in query)]


class _Needs:
    """Walks a parsed pattern; ``runs`` are the strings that the characters just passed may be."""

    def __init__(self) -> None:
        self.query: set[frozenset[int]] = {frozenset()}
        self.runs = {""}

    def both(self, more: set[frozenset[int]]) -> None:
        """AND, unless that makes too many alternatives: a weaker query only lets more rows through."""
        joined = {a | b for a in self.query for b in _smallest(more)}
        if len(joined) <= MOST:
            self.query = joined

    def cut(self) -> None:
        """What comes next is not a known string."""
        self.both({frozenset(codes(r)) for r in self.runs})
        self.runs = {""}

    def append(self, strings: set[str]) -> None:
        if len(self.runs) * len(strings) > MOST:
            self.cut()
        if len(strings) > MOST:
            self.cut()
        else:
            self.runs = {a + b for a in self.runs for b in strings}

    def strings(self, items) -> set[str] | None:
        """All strings that ``items`` may be, if these are few."""
        own = {""}
        for op, arg in items:
            if op == sre.LITERAL:
                some = {chr(arg)}
            elif op == sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
                some = {chr(c) for o, a in arg for c in (range(a[0], a[1] + 1) if o == sre.RANGE else (a,))}
            elif op == sre.SUBPATTERN:
                some = self.strings(arg[3])
            elif op == sre.BRANCH:
                parts = [self.strings(x) for x in arg[1]]
                some = None if None in parts else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
                one = self.strings(arg[2])
                some = None if one is None or len(one) ** arg[1] > MOST else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
            elif op == sre.AT:
                some = {""}
            else:
                return None
            if some is None or len(own) * len(some) > MOST:
                return None
            own = {a + b for a in own for b in some}
        return own

    def walk(self, items) -> None:
        for item in items:
            op, arg = item
            known = self.strings([item])
            if known is not None:
                self.append(known)
            elif op == sre.SUBPATTERN:
                self.walk(arg[3])
            elif op == sre.BRANCH:
                self.cut()
                self.both({q for x in arg[1] for q in _of(x)})
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                self.cut()
                self.both(set(_of(arg[2])))
            else:
                self.cut()


def _of(items) -> list[frozenset[int]]:
    walk = _Needs()
    walk.walk(items)
    walk.cut()
    return _smallest(walk.query)


def trigram_query(pattern: str) -> list[frozenset[int]]:
    """OR of ANDs of trigram codes that every match of ``pattern`` holds, in lower case; an empty list if
    there are none. Patterns are compiled with re.ASCII, so lower-casing A-Z covers re.IGNORECASE."""
    query = _of(re._parser.parse(pattern, re.ASCII))
    return [] if frozenset() in query else query


@dataclass(frozen=True)
class Rule:
    """``at_least``: characters that ``group`` of a match must have; ``fold``: letters in either case."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    fold: bool = False

    def finder(self) -> Callable[[str], list[tuple[int, int]]]:
        find = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0)).finditer
        group, least = self.group, self.at_least
        return lambda text: [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]

    def query(self) -> list[frozenset[int]]:
        return trigram_query(self.pattern)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/=-]{20,})", 0, 0, True),
    Rule("urlpass", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,80}:([^\s:/@]{6,80})@"),
)
RULES = BASE + MORE


class Index:
    """Postings of one slice for the trigrams that the rules name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.query = {r.kind: r.query() for r in rules}
        wanted = sorted({c for own in self.query.values() for q in own for c in q})
        self.number = np.full(1 << 24, -1, np.int16)
        self.number[wanted] = np.arange(len(wanted))
        self.of = {c: i for i, c in enumerate(wanted)}
        self.first = np.zeros(256, bool)
        self.first[[c >> 16 for c in wanted]] = True

    def postings(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        low = LOWER[raw]
        at = np.flatnonzero(self.first[low[:-2]]) if len(low) > 2 else np.zeros(0, np.int64)
        found = self.number[low[at].astype(np.int32) << 16 | low[at + 1].astype(np.int32) << 8 | low[at + 2]] if len(at) else np.zeros(0, np.int16)
        hit = found >= 0
        at, found = at[hit], found[hit]
        row = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[row + 1] if len(at) else hit[:0]
        row, found = row[inside], found[inside]
        return [np.unique(row[found == i]) for i in range(len(self.of))]

    def candidates(self, rule: Rule, postings: list[np.ndarray], n: int) -> np.ndarray:
        if not self.query[rule.kind]:
            return np.arange(n)
        out = np.zeros(0, np.int64)
        for need in self.query[rule.kind]:
            lists = sorted((postings[self.of[c]] for c in need), key=len)
            hit = lists[0]
            for other in lists[1:]:
                hit = np.intersect1d(hit, other, assume_unique=True)
            out = np.union1d(out, hit)
        return out.astype(np.int64)


def _said(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end`` joined by commas)."""
    base = {r.kind for r in BASE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, find = Index(rules), [r.finder() for r in rules]
        for batch in batches:
            for part in slices(batch, "text"):
                raw, off = utf8(part.column(1))
                postings, n = index.postings(raw, off), part.num_rows
                texts = part.column(1).to_pylist()
                spans: list[list] = [[] for _ in range(n)]
                for k, rule in enumerate(rules):
                    for i in index.candidates(rule, postings, n).tolist():
                        if texts[i]:
                            spans[i] += [(a, k, rule.kind, b) for a, b in find[k](texts[i])]
                own = [[x for x in s if x[2] in base] for s in spans]
                count = lambda kind: pa.array([sum(x[2] == kind for x in s) for s in own], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), count("assign"), count("access"), count("hex"), pa.array([hashlib.sha256(_said(s).encode()).hexdigest() for s in own]), pa.array([_said(s) for s in spans])],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
