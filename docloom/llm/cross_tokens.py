"""Alignment of two tokenizers' tokens by the bytes that they cover, as sparse matrix products.

A text's tokens are the rows of a 0/1 matrix over its bytes, kept in compressed rows (``Rows``:
bounds and columns). A row of A . B^T, formed by Gustavson's method, adds up the rows of B^T that a
token's bytes name: its entries are the tokens of the other side that overlap it. Where tokens of
both sides end together a group ends; the product of the incidence of tokens in groups with
that of groups in tokens links what shares a group.

Texts are cut at single spaces between other characters, where both tokenizers begin a token; a
stretch is encoded once and remembered, and the products are formed for all new stretches of a batch
at once. How many documents hold an id pair linked is counted over the whole corpus; pairs are
looked up in a table of the most frequent ones, of a fixed size, and joined beyond it.

Cases: null and empty texts, and texts whose joined token bytes on either side are not the
space and the text (such as a text with U+2581), have no tokens: zeros and no groups; repeated rows and null
doc_ids are kept, each row for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import slices
from .scratch import released, stored

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Id pairs in the table that tasks hold: 16 bytes each. Rarer pairs are joined.
HEAD = 1 << 20
#: Distinct stretches that a worker remembers, and the longest one in characters.
REMEMBERED, LONGEST = 300_000, 64
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Rows:
    """A 0/1 matrix in compressed rows: row i has the columns ``cols[at[i]:at[i + 1]]``."""

    def __init__(self, at: np.ndarray, cols: np.ndarray, width: int):
        self.at, self.cols, self.width = at, cols, width

    @classmethod
    def spans(cls, lengths: np.ndarray) -> Rows:
        """Row i covers the next ``lengths[i]`` columns."""
        at = np.concatenate([[0], np.cumsum(lengths)])
        return cls(at, np.arange(at[-1]), int(at[-1]))

    def transposed(self) -> Rows:
        rows = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        order = np.argsort(self.cols, kind="stable") if np.any(self.cols[1:] < self.cols[:-1]) else slice(None)
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))]), rows[order], len(self.at) - 1)

    def reached(self, other: Rows) -> np.ndarray:
        """For each row, how many terms its product row has before equal columns are added up."""
        terms = np.concatenate([[0], np.cumsum(np.diff(other.at)[self.cols])])
        return np.diff(terms[self.at])

    def times(self, other: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The non-zero entries of the product: row, column, value, in order of rows and columns."""
        each = np.diff(other.at)[self.cols]
        first = other.at[self.cols]
        total = np.cumsum(each)
        cols = other.cols[np.arange(total[-1] if len(total) else 0) - np.repeat(total - each, each) + np.repeat(first, each)]
        rows = np.repeat(np.repeat(np.arange(len(self.at) - 1), np.diff(self.at)), each)
        code = rows * max(other.width, 1) + cols
        if np.any(code[1:] < code[:-1]):
            code = np.sort(code)
        fresh = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        return code[fresh] // max(other.width, 1), code[fresh] % max(other.width, 1), np.diff(np.append(fresh, len(code)))


def groups(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, from the tokens' lengths; a group ends where both sides' tokens end."""
    a, b = np.cumsum(left), np.cumsum(right)
    ends = np.intersect1d(a, b)
    return np.searchsorted(ends, a), np.searchsorted(ends, b)


class Tokenizer:
    """One side: the ids of stretches that begin with a space, and the bytes of each id."""

    def __init__(self, path: str):
        self.pieces = not path.endswith(".json")
        if self.pieces:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.own.id_to_piece(i) for i in range(self.own.vocab_size())]
            self.bytes = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
            self.space = self.own.piece_to_id("▁")
            # no piece may run over a space, or cuts there would change the ids
            self.cuts = all("▁" not in n.lstrip("▁") for n in names)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Library

            from .bpe import byte_characters

            self.own = Library.from_file(path)
            self.own.encode_special_tokens = True  # their strings in texts are plain text
            back = {ord(c): chr(b) for b, c in enumerate(byte_characters())}
            self.bytes = [(self.own.id_to_token(i) or "").translate(back).encode("latin-1", "ignore") for i in range(self.own.get_vocab_size())]
            self.cuts = True
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space."""
        if self.pieces:  # the model adds the space itself
            return [self.space] if text == " " else self.own.encode(text[1:], num_threads=1)
        return self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def gives(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Aligner:
    """Both tokenizers of one worker and the stretches that it remembers."""

    def __init__(self, left: str, right: str):
        self.left, self.right = Tokenizer(left), Tokenizer(right)
        self.cuts = self.left.cuts and self.right.cuts
        self.marked = [f"{i}{m}" for side, ends in ((self.left, ",|"), (self.right, ",;")) for i in range(len(side.bytes)) for m in ends]
        #: stretch -> (tokens left, tokens right, groups, shared-group links, text of the groups, codes of the links), or None
        self.known: dict[str, tuple | None] = {}

    def _encoded(self, part: list[str]) -> list[tuple[str, list[int], list[int]]]:
        """Stretches with the ids of both sides; those that a side does not give back are left out. Stretches that
        end and go on with other characters than white space are encoded as one text."""
        whole = "".join(part)
        a, b, raw = self.left.encode(whole), self.right.encode(whole), whole.encode()
        if len(part) > 1 and (self.left.gives(a) != raw or self.right.gives(b) != raw):
            return [x for s in part for x in self._encoded([s])]
        if len(part) == 1:
            return [(whole, a, b)] if self.left.gives(a) == raw and self.right.gives(b) == raw else []
        ends = np.cumsum([len(s.encode()) for s in part])
        cuts = []
        for side, ids in ((self.left, a), (self.right, b)):
            own = np.cumsum(side.lengths[ids])
            at = np.searchsorted(own, ends)
            if not np.array_equal(own[at], ends):
                return [x for s in part for x in self._encoded([s])]
            cuts.append([0, *(at + 1).tolist()])
        return [(s, a[p:q], b[u:v]) for s, p, q, u, v in zip(part, cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)]

    def _learn(self, new: list[str]) -> dict[str, tuple | None]:
        """Encode and align stretches, all in one block-diagonal product."""
        out: dict[str, tuple | None] = dict.fromkeys(new)
        clean = [s for s in new if len(s) > 1 and not s[1].isspace() and not s[-1].isspace()] if self.cuts else []
        parts = [clean[i : i + 500] for i in range(0, len(clean), 500)] + [[s] for s in new if not self.cuts or not (len(s) > 1 and not s[1].isspace() and not s[-1].isspace())]
        kept = [x for p in parts for x in self._encoded(p)]
        if not kept:
            return out
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x[n] for x in kept), np.int64) for n in (1, 2))
        size_a, size_b = (np.array([len(x[n]) for x in kept]) for n in (1, 2))
        len_a, len_b = self.left.lengths[ids_a], self.right.lengths[ids_b]
        rows, cols, _ = Rows.spans(len_a).times(Rows.spans(len_b).transposed())
        codes = ids_a[rows] << 32 | ids_b[cols]
        group_a, group_b = groups(len_a, len_b)
        count = int(max(group_a[-1], group_b[-1])) + 1
        in_groups = Rows(np.arange(len(ids_a) + 1), group_a, count)
        of_groups = Rows(np.arange(len(ids_b) + 1), group_b, count).transposed()
        shared = in_groups.reached(of_groups)
        at_a, at_b = np.concatenate([[0], np.cumsum(size_a)]), np.concatenate([[0], np.cumsum(size_b)])
        link_at = np.searchsorted(rows, at_a)
        # the text of the groups: left tokens of a group, then its right ones, each with the mark that follows it
        count_a, count_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=count))]) for g in (group_a, group_b))
        marks = np.empty(len(ids_a) + len(ids_b), np.int64)
        places = np.arange(len(ids_a)) + count_b[group_a], np.arange(len(ids_b)) + count_a[group_b + 1]
        marks[places[0]] = 2 * ids_a + (np.append(group_a[1:], -1) != group_a)
        marks[places[1]] = 2 * ids_b + (np.append(group_b[1:], -1) != group_b) + 2 * len(self.left.bytes)
        text = list(map(self.marked.__getitem__, marks.tolist()))
        shared_at = np.concatenate([[0], np.cumsum(shared)])[at_a].tolist()
        group_at = np.append(group_a, count)[at_a].tolist()
        text_at, links, size_a, size_b = (at_a + at_b).tolist(), link_at.tolist(), size_a.tolist(), size_b.tolist()
        for i, (s, _, _) in enumerate(kept):
            out[s] = (size_a[i], size_b[i], group_at[i + 1] - group_at[i], shared_at[i + 1] - shared_at[i], "".join(text[text_at[i] : text_at[i + 1]])[:-1], codes[links[i] : links[i + 1]])
        return out

    def stretches(self, text: str) -> list[str]:
        """The space and the text, cut where both sides begin a token; none for an empty text."""
        if not text:
            return []
        return [" " + s for s in _CUT.split(text)] if self.cuts else [" " + text]

    def align(self, texts: list[str]) -> list[list[tuple] | None]:
        """For each text what its stretches have, in order; None if a side does not give the text back."""
        cut = [self.stretches(t) for t in texts]
        every = dict.fromkeys(chain.from_iterable(cut))
        new = [s for s in every if s not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(every)
        fresh = self._learn(new) if new else {}
        long = {s: x for s, x in fresh.items() if len(s) > LONGEST}
        self.known.update((s, x) for s, x in fresh.items() if s not in long)
        found = ChainMap(self.known, long) if long else self.known
        out = []
        for stretches in cut:
            parts = [found[s] for s in stretches]
            out.append(None if None in parts else parts)
        return out


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    if (left, right) not in _loaded:
        _loaded[left, right] = Aligner(left, right)
    return _loaded[left, right]


def paths(left: str | None = None, right: str | None = None) -> tuple[str, str]:
    import public_tokenizers

    return left or public_tokenizers.path(LEFT), right or public_tokenizers.path(RIGHT)


def group_links(left: list[int], right: list[int], tokenizers: Aligner, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place of a left token, place of a right token) that share a group, as rows of the incidence product,
    in blocks: a group without common ends links each of its tokens with each."""
    len_a, len_b = tokenizers.left.lengths[left], tokenizers.right.lengths[right]
    group_a, group_b = groups(len_a, len_b)
    count = int(max(group_a.max(initial=-1), group_b.max(initial=-1))) + 1
    of_groups = Rows(np.arange(len(group_b) + 1), group_b, count).transposed()
    for at in range(0, len(group_a), block):
        part = group_a[at : at + block]
        rows, cols, _ = Rows(np.arange(len(part) + 1), part, count).times(of_groups)
        yield rows + at, cols


ALIGNED = "row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, codes binary, times binary"


def aligned(docs: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """A row for each document: tokens of both sides, groups, overlap links, shared-group links, the digest of
    the groups, and its distinct linked id pairs (left << 32 | right) with how often each is linked."""
    left, right = paths(left, right)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(left, right)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for parts in own.align([t or "" for t in part.column(2).to_pylist()]):
                    if not parts:
                        rows.append((0, 0, 0, 0, 0, "", b"", b""))
                        continue
                    a, b, count, shared, texts, codes = zip(*parts, strict=True)
                    pairs, times = np.unique(np.concatenate(codes), return_counts=True)
                    rows.append((sum(a), sum(b), sum(count), int(times.sum()), sum(shared), hashlib.sha256(";".join(texts).encode()).hexdigest(), pairs.tobytes(), times.astype("<i4").tobytes()))
                kinds = [*[pa.int64()] * 5, pa.string(), *[pa.binary()] * 2]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "codes", "times"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, ALIGNED.format(kind=kind))


def pair_counts(found: DataFrame, most: int = 1 << 19) -> DataFrame:
    """code, count (documents that hold the pair linked) over all rows of ``aligned``; tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        codes, count, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            one, times = np.unique(np.concatenate(held), return_counts=True)
            every = np.concatenate([codes, one])
            both, place = np.unique(every, return_inverse=True)
            return both, np.bincount(place, np.concatenate([count, times])).astype(np.int64)

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, np.int64))
                size += len(held[-1])
                if size >= most:
                    codes, count = added()
                    held, size = [], 0
                    if len(codes) > most:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(count)], ["code", "count"])
                        codes, count = codes[:0], count[:0]
        if held:
            codes, count = added()
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(count)], ["code", "count"])

    return found.select("codes").mapInArrow(run, "code long, count long").groupBy("code").agg(F.sum("count").alias("count"))


def cross_alignment(docs: DataFrame, left: str | None = None, right: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and n_shared (shared-group links).

    ``n_best`` counts links whose pair is held by as many documents as any pair of its left id; ``count_sum`` adds the
    documents that hold each link's pair. Maxima are one row an id of the left vocabulary, so they are broadcast."""
    spark = docs.sparkSession
    found = stored(aligned(docs, left, right), "aligned")
    counted = stored(pair_counts(found), "counts")
    best = counted.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("count").alias("most"))
    counts = stored(counted.withColumn("a", F.shiftright("code", 32)).join(F.broadcast(best), "a").select("code", "count", (F.col("count") == F.col("most")).alias("best")), "counts")
    released(counted)
    top = counts.orderBy(F.desc("count"), "code").limit(head).toArrow()
    order = np.argsort(top.column("code").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(top.column(n).to_numpy()[order] for n in ("code", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best_ = shared.value
        for batch in batches:
            codes, times = ([np.frombuffer(x, t) for x in batch.column(n).to_pylist()] for n, t in ((1, np.int64), (2, "<i4")))
            size = np.array([len(x) for x in codes])
            row = np.repeat(np.arange(len(codes)), size)
            code, time = np.concatenate(codes), np.concatenate(times).astype(np.int64)
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), bool)
            own, total = (np.zeros(len(codes), np.int64) for _ in range(2))
            np.add.at(own, row[hit], (time * best_[at])[hit] if len(known) else 0)
            np.add.at(total, row[hit], (time * count[at])[hit] if len(known) else 0)
            rest = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(codes)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit])) for x in (code, time)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(total), *lists], ["row", "n_best", "count_sum", "codes", "times"])

    sums = stored(found.select("row", "codes", "times").mapInArrow(run, "row long, n_best long, count_sum long, codes array<long>, times array<long>"), "sums")
    rare = sums.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    rare = rare.join(counts.hint("merge"), "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    parts = found.drop("codes", "times").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    nothing = {n: F.lit(None).cast(parts.schema[n].dataType) for n in parts.columns if n not in ("row", "n_best", "count_sum")}
    every = parts
    for more in (sums.select("row", "n_best", "count_sum"), rare):
        every = every.unionByName(more.withColumns(nothing))
    out = every.groupBy("row").agg(*(F.max(n).alias(n) for n in nothing), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
