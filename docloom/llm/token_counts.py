"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A leaf holds a short run of pre-tokens with its text, their lengths and their token counts; inner
nodes hold sums of characters and tokens. An edit descends by characters to the leaf it touches,
cuts the text there anew from the last pre-token that cannot have changed (one whose end lies
``CONTEXT`` characters before the edit) and stops at the first new bound beyond the edit that was
also an old bound: from there on the pattern, which never looks back, finds what it found before.
Only pre-tokens in between are encoded again; then the sums on the path to the root are updated.

Cases: null and empty texts count 0 tokens and can be edited by insertion; bounds outside the text
are clamped, a null or reversed range is an insertion at its start, a null replacement deletes;
edits apply in the order given, each to the text the former left; null edit lists change nothing;
repeated rows are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, coder, vocabulary_path
from .bytetext import slices

LEAF = 48
#: A match's choice depends on at most this many characters beyond its end.
CONTEXT = 2


class TokenTree:
    def __init__(self, text: str, bpe: ByteBPE):
        self.bpe, self.recoded = bpe, 0
        matches = bpe.find(text)
        counts = bpe.counts(matches)
        self._build([(matches[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(matches), LEAF)] or [([], [])])

    def _build(self, leaves: list[tuple[list[str], list[int]]]) -> None:
        self.leaves, n = leaves, 1
        while n < len(leaves):
            n *= 2
        self.base = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (m, c) in enumerate(leaves):
            self.chars[n + i], self.tokens[n + i] = sum(map(len, m)), sum(c)
        for i in range(n - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(x for m, _ in self.leaves for x in m)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``; the last one beyond the end."""
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def _set(self, leaf: int, matches: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (matches, counts)
        i = self.base + leaf
        self.chars[i], self.tokens[i] = sum(map(len, matches)), sum(counts)
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start``..``end`` of the present text by ``new``."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, lo = self._find(max(0, start - CONTEXT))
        matches, counts = self.leaves[first]
        keep, at = 0, lo
        while keep < len(matches) and at + len(matches[keep]) + CONTEXT <= start:
            at += len(matches[keep])
            keep += 1
        last, hi = first, lo + self.chars[self.base + first]
        old = list(zip(matches[keep:], counts[keep:], strict=True))

        def grow() -> bool:
            nonlocal last, hi
            while last + 1 < len(self.leaves):
                last += 1
                if self.chars[self.base + last]:
                    hi += self.chars[self.base + last]
                    old.extend(zip(*self.leaves[last], strict=True))
                    return True
            return False

        while hi < end + CONTEXT and grow():
            pass
        while True:
            was = "".join(m for m, _ in old)
            now = was[: start - at] + new + was[end - at :]
            shift, whole = len(now) - len(was), hi >= size
            bounds, p = {}, 0
            for k, (m, _) in enumerate(old):
                bounds[p] = k
                p += len(m)
            found, p, join = [], 0, None
            for m in self.bpe.find(now):
                if p - shift >= end - at and p >= start - at + len(new) and p - shift in bounds:
                    join = bounds[p - shift]
                    break
                if not whole and p + len(m) + CONTEXT > len(now):
                    break  # its choice may hang on text that is not at hand
                found.append(m)
                p += len(m)
            else:
                join = len(old) if whole else None
            if join is not None:
                break
            grow()
        fresh = self.bpe.counts(found)
        self.recoded += len(found)
        rest = old[join:]
        merged = (matches[:keep] + found + [m for m, _ in rest], counts[:keep] + fresh + [c for _, c in rest])
        for i in range(first + 1, last + 1):
            if self.chars[self.base + i]:
                self._set(i, [], [])
        self._set(first, *merged)
        if len(merged[0]) > 16 * LEAF:
            cut = [(m[i : i + LEAF], c[i : i + LEAF]) for m, c in self.leaves for i in range(0, len(m), LEAF)]
            self._build(cut or [([], [])])


def count_with_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``edits array<struct<start, stop, new>>`` -> doc_id, n_tokens_before,
    n_tokens_after, n_pretokens_recoded. Positions are code points."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                before, after, recoded = [], [], []
                for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tree = TokenTree(text or "", bpe)
                    before.append(tree.total)
                    for e in edits or []:
                        if e is not None:
                            at = e["start"] or 0
                            tree.edit(at, at if e["stop"] is None else e["stop"], e["new"] or "")
                    after.append(tree.total)
                    recoded.append(tree.recoded)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (before, after, recoded))], ["doc_id", "n_tokens_before", "n_tokens_after", "n_pretokens_recoded"])

    return docs.select("doc_id", "text", "edits").mapInArrow(run, "doc_id long, n_tokens_before long, n_tokens_after long, n_pretokens_recoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach an edit table (doc_id, seq, start, stop, new) as one ordered list a document."""
    lists = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "new"))), lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["new"].alias("new"))).alias("edits"))
    return docs.select("doc_id", "text").join(lists.hint("merge"), "doc_id", "left")


def derived_edits(source: Column, lang: Column, text: Column) -> Column:
    """The query's edits of each document: an insertion at a quarter, a replacement at the middle
    and a deletion at three quarters of the text, with the row's own lang and source."""
    n = F.coalesce(F.length(text), F.lit(0))

    def one(at: Column, chars: int, new: Column) -> Column:
        return F.struct(at.cast("int").alias("start"), (at + chars).cast("int").alias("stop"), F.coalesce(new, F.lit("")).alias("new"))

    return F.array(one(F.floor(n / 4), 0, F.concat(F.lit(" "), lang)), one(F.floor(n / 2), 12, source), one(F.floor(n * 3 / 4), 7, F.lit("")))
