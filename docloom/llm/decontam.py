"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping passages of ``PASSAGE`` characters and again of ``PART``
(a shorter item is one passage), so every excerpt of PART + PART_STRIDE - 1 = 63 characters or more
holds a whole passage, wherever it starts. A passage of m characters tolerates k = floor(BUDGET * m) edits, fewer where the bound
below would not be positive. By the q-gram lemma a text region within k edits of the passage
shares at least m - q + 1 - k * q of its q-grams, on diagonals that drift by at most k. Shared
q-grams are counted for each text, passage and diagonal band; bands are 2k wide and overlap by k,
so that one band holds all of them. Bands that meet the bound are verified by a banded alignment;
passages shorter than q are searched for as they are.

Characters are code points; A-Z count as a-z and white space characters as blanks.

Cases: null and empty texts and items match nothing; repeated documents are all reported; repeated
items are reported under each of their ids; ties go to the first start; empty tables give no rows;
extra columns are ignored. The benchmark is read in parts of at most ``PART_CHARS`` characters, so
that what a task holds is bounded, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import slices

Q, PASSAGE, STRIDE, BUDGET = 8, 96, 48, 0.10
PART, PART_STRIDE = 48, 16
#: With PART passages there are four times as many passages a character, hence no more than this.
PART_CHARS = 1_000_000
#: Longer than any region of a passage.
STRETCH = 1024
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_BITS = 20


def characters(text: str) -> np.ndarray:
    """Code points, A-Z lower-cased, white space as blanks."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where((c >= 65) & (c <= 90), c + 32, c)
    return np.where((c >= 9) & (c <= 13), 32, c).astype(np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = np.zeros(n, _U)
    for j in range(Q):
        h *= _P
        h += c[j : j + n]
    return h ^ (h >> _U(29))


def edits_allowed(m: int) -> int:
    """k with a positive q-gram bound."""
    return max(0, min(int(BUDGET * m), (m - Q) // Q))


def align(passage: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded alignment of row i of ``passage`` (c x m) along ``width`` diagonals of row i of ``text``
    (c x m + width) -> edits, start and end of the best place, counted from the row's first character."""
    unit = np.int64(1) << 32
    ramp = np.arange(width, dtype=np.int64) * unit
    row = np.tile(np.arange(width, dtype=np.int64), (len(text), 1))  # edits * unit + start
    for i in range(passage.shape[1]):
        new = row + np.where(text[:, i : i + width] == passage[:, i : i + 1], 0, unit)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + unit)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    end = np.argmin(row >> 32, axis=1)
    best = row[np.arange(len(row)), end]
    return best >> 32, best & (unit - 1), end + passage.shape[1]


class Benchmark:
    """Passages and q-gram table of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.passages: list[tuple[int, np.ndarray, int]] = []
        for item, text in items:
            c = characters(text or "")
            for long, stride in ((PASSAGE, STRIDE), (PART, PART_STRIDE)):
                last = max(0, len(c) - long)
                for at in sorted({*range(0, last, stride), last}):
                    if len(c) > (PART if long == PART else 0):
                        self.passages.append((item, c[at : at + long], at))
        size = np.array([len(c) for _, c, _ in self.passages], np.int64)
        self.k = np.array([edits_allowed(m) for m in size.tolist()], np.int64)
        self.need = size - Q + 1 - self.k * Q
        hashes = [grams(c) for _, c, _ in self.passages]
        h = np.concatenate([*hashes, np.zeros(0, _U)])
        owner = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        at = np.concatenate([*(np.arange(len(x)) for x in hashes), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.gram, first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.first, self.owner, self.at = np.append(first, 0).astype(np.int64), owner[order], at[order]
        self.gram = np.append(self.gram, _U(2**64 - 1))
        self.times = np.append(self.times, 0)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.gram[:-1] >> _U(64 - _BITS)] = True
        self.tiny = [(i, c) for i, (_, c, _) in enumerate(self.passages) if len(c) < Q]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(row, passage, start, end, edits) of every region within its budget, the best of each band."""
        chars = [characters(t) for t in texts]
        off = np.concatenate([[0], np.cumsum([len(c) for c in chars])]).astype(np.int64)
        whole = np.concatenate([*chars, np.zeros(0, np.uint32)])
        h = grams(whole)
        pos = np.flatnonzero(self.maybe[h >> _U(64 - _BITS)])
        slot = np.searchsorted(self.gram[:-1], h[pos])
        real = (self.gram[slot] == h[pos]) & (self.times[slot] > 0)
        pos, slot = pos[real], slot[real]
        row = np.searchsorted(off, pos, side="right") - 1
        inside = pos + Q <= off[row + 1] if len(pos) else real[:0]
        pos, slot, row = pos[inside], slot[inside], row[inside]
        times = self.times[slot]
        src = np.repeat(np.arange(len(pos)), times)
        entry = np.repeat(self.first[slot], times) + np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
        passage, n = self.owner[entry], len(self.passages)
        # a region lies in two neighbouring stretches of the text at most
        cell = (pos[src] // STRETCH) * n + passage
        own, which, count = np.unique(cell, return_inverse=True, return_counts=True)
        beside = np.zeros(len(own), np.int64)
        for next_to in (own - n, own + n):
            at = np.minimum(np.searchsorted(own, next_to), max(len(own) - 1, 0))
            beside = np.maximum(beside, np.where(own[at] == next_to, count[at], 0))
        some = (count + beside)[which] >= self.need[passage]
        passage, entry, src = passage[some], entry[some], src[some]
        diagonal = pos[src] - self.at[entry] + PASSAGE  # not negative
        step = np.maximum(self.k[passage], 1)
        band = diagonal // step
        out: list[tuple[int, int, int, int, int]] = []
        if len(band):
            wide = int(band.max()) + 2
            # a band b holds diagonals of steps b and b + 1, so a hit counts for its own step and the one before
            key = (row[src] * n + passage) * wide + band
            key, count = np.unique(np.concatenate([key, key - (band > 0)]), return_counts=True)
            key = key[count >= self.need[key // wide % n]]
            b, p, r = key % wide, key // wide % n, key // wide // n
            size = np.array([len(self.passages[i][1]) for i in p], np.int64)
            for m in np.unique(size).tolist():
                for at in np.array_split(np.flatnonzero(size == m), max(1, int((size == m).sum()) // 512)):
                    k = int(self.k[p[at[0]]])
                    base = b[at] * max(k, 1) - PASSAGE - k
                    width = 4 * max(k, 1) + 1
                    where = base[:, None] + np.arange(m + width)
                    out_of = (where < off[r[at]][:, None]) | (where >= off[r[at] + 1][:, None])
                    text = np.where(out_of, np.uint32(2**32 - 1), whole[np.clip(where, 0, len(whole) - 1)])
                    edits, s, e = align(np.stack([self.passages[i][1] for i in p[at]]), text, width)
                    for x in np.flatnonzero(edits <= k).tolist():
                        i, top = at[x], len(chars[r[at[x]]])
                        lead = int(base[x] - off[r[i]])
                        out.append((int(r[i]), int(p[i]), min(max(lead + int(s[x]), 0), top), min(max(lead + int(e[x]), 0), top), int(edits[x])))
        for p, c in self.tiny:
            for r, t in enumerate(chars):
                if len(t) >= len(c):
                    hit = np.flatnonzero((np.lib.stride_tricks.sliding_window_view(t, len(c)) == c).all(1))
                    out += [(r, p, int(s), int(s) + len(c), 0) for s in hit[:1]]
        return out


COLUMNS = "doc_id long, item_id long, start long, stop long, edits long, n_passages long"


def _parts(docs: DataFrame, benchmark: DataFrame, part_chars: int):
    """The items in broadcast parts of about ``part_chars`` characters."""
    items = benchmark.filter(F.col("text").isNotNull() & (F.length("text") > 0)).select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(size) // part_chars))
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in some.orderBy("item_id", "text").collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One row for each document and benchmark item that share a passage: the place and edits of the
    best one, and how many passages of the item were found."""

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Benchmark(shared.value)
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    ids = part.column(0).to_pylist()
                    best: dict[tuple[int, int], tuple] = {}
                    seen: dict[tuple[int, int], set] = {}
                    for r, p, s, e, n in own.search([t or "" for t in part.column(1).to_pylist()]):
                        key = (r, p if own.passages[p][0] is None else own.passages[p][0])
                        seen.setdefault(key, set()).add(p)
                        best[key] = min(best.get(key, (n, s, e, p)), (n, s, e, p))
                    rows = [(ids[k[0]], own.passages[p][0], s, e, n, len(seen[k])) for k, (n, s, e, p) in sorted(best.items())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "stop", "edits", "n_passages"])

        return run

    found = [docs.select("doc_id", "text").mapInArrow(searcher(shared), COLUMNS) for shared in _parts(docs, benchmark, part_chars)]
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents that share no passage with the benchmark, all columns kept; nothing is shuffled."""

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Benchmark(shared.value)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for part in slices(batch, "text", 1 << 20):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in own.search([t or "" for t in part.column(at).to_pylist()])]] = False
                    yield part.filter(pa.array(keep))

        return run

    for shared in _parts(docs, benchmark, part_chars):
        docs = docs.mapInArrow(clean(shared), docs.schema)
    return docs
