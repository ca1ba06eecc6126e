"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in halves, each half is quantised by its own codebook (k-means on a bounded
sample), and a row belongs to the cell of its two nearest centroids. The distance of a query's half from a
centroid is minus the inner product that rows there can be expected to reach: that with the centroid itself
and ``REACH`` times the query's norm times the spread around the centroid, which is wide where norms are
large. A query walks the pairs of centroids by rising summed distance with a heap until the cells seen
hold enough rows; every row of those cells is scored by its exact inner product in double precision.

Rows are grouped by their first centroid, hot groups are salted into blocks, and a query is sent to
the groups it visits with the second centroids it wants there. A task holds one block of rows and
one block of queries; each returns at most ``k`` rows a query.

Cases: vectors that are null, zero or hold null or non-finite components, and vectors of another
length than the most frequent one, take no part; ties go to the smaller vec_id; fewer candidates
than ``k`` are all returned; repeated vec_ids are candidates of their own but never of a query with
that id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import stored

#: Centroids of each half; rows of the sample that the codebooks are fitted on.
CENTROIDS, SAMPLE_ROWS = 64, 20_000
#: Share of all rows that the visited cells hold at least, and rows for each neighbour asked for (so that
#: tables of a few hundred rows still give k neighbours).
SHARE, ROWS_EACH = 0.5, 20
#: Spreads around a centroid, in the direction of the query, that its best rows lie beyond it.
REACH = 0.3
BLOCK_ROWS, BLOCK_QUERIES = 8192, 32_768


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding array<double> of the rows that take part."""
    e = F.col("embedding")
    fine = vectors.filter(e.isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0)).filter(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    )
    common = fine.groupBy(F.size(e).alias("_dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_dim").limit(1).collect()
    dim = common[0]["_dim"] if common else 0
    return fine.filter(F.size(e) == dim).select("vec_id", e.cast("array<double>").alias("embedding"))


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for i in range(len(c)):
            own = x[near == i]
            c[i] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return c


def codebooks(vectors: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centroids and the spreads around them of each half, from the first ``sample_rows`` rows by a hash of vec_id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    return fitted(np.array([r["embedding"] for r in rows], np.float64), centroids)


def fitted(x: np.ndarray, centroids: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not len(x):
        return [(np.zeros((1, 1)), np.zeros(1))] * 2
    out, cut = [], max(1, x.shape[1] // 2)
    for half in (x[:, :cut], x[:, cut:]):
        book = _kmeans(half, centroids) if half.shape[1] else np.zeros((1, 0))
        near = ((book * book).sum(1) - 2 * half @ book.T).argmin(1)
        away = np.bincount(near, ((half - book[near]) ** 2).sum(1), len(book)) / np.maximum(np.bincount(near, minlength=len(book)), 1)
        out.append((book, np.sqrt(away)))
    return out


def _halves(x: np.ndarray, books: list[tuple[np.ndarray, np.ndarray]]):
    cut = books[0][0].shape[1]
    return zip((x[:, :cut], x[:, cut:]), books, strict=True)


def cells(x: np.ndarray, books: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The nearest centroid of each half of each row."""
    return [((c * c).sum(1) - 2 * h @ c.T).argmin(1) for h, (c, _) in _halves(x, books)]


def distances(x: np.ndarray, books: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each half of each query and each centroid: minus the inner product that rows there can reach."""
    return [-(h @ c.T) - REACH * np.linalg.norm(h, axis=1)[:, None] * spread for h, (c, spread) in _halves(x, books)]


def walk(d0: np.ndarray, d1: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells by rising summed distance until they hold ``enough`` rows."""
    o0, o1 = np.argsort(d0, kind="stable"), np.argsort(d1, kind="stable")
    heap, seen, held, out = [(d0[o0[0]] + d1[o1[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and held < enough:
        _, a, b = heapq.heappop(heap)
        out.append((int(o0[a]), int(o1[b])))
        held += sizes[o0[a], o1[b]]
        for p in ((a + 1, b), (a, b + 1)):
            if p[0] < len(o0) and p[1] < len(o1) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (d0[o0[p[0]]] + d1[o1[p[1]]], *p))
    return out


def best(q: np.ndarray, qid: np.ndarray, mask: np.ndarray, x: np.ndarray, vid: np.ndarray, cell: np.ndarray, k: int):
    """(query, row, score) of the k best visited rows of each query; sums run in component order."""
    s = q @ x.T
    s[(mask[:, None] >> cell[None, :].astype(np.uint64)) & np.uint64(1) == 0] = -np.inf
    s[qid[:, None] == vid[None, :]] = -np.inf
    kth = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
    low = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), -np.inf)
    a, b = np.nonzero((s >= low[:, None]) & np.isfinite(s))
    exact = np.zeros(len(a))
    for j in range(q.shape[1]):
        exact += q[a, j] * x[b, j]
    order = np.lexsort((vid[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < k
    return a[keep], b[keep], exact[keep]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, centroids: int = CENTROIDS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best found for each row whose vec_id is divisible by ``every``."""
    assert centroids <= 64, "visited cells of a group are the bits of a long"
    own = usable(vectors)
    books = codebooks(own, centroids)

    def assign(frames):
        for f in frames:
            x = np.array(f["embedding"].tolist(), np.float64).reshape(len(f), -1)
            if len(f):
                c = cells(x, books)
                yield pd.DataFrame({"vec_id": f["vec_id"], "embedding": f["embedding"], "c0": c[0], "c1": c[1]})

    rows = stored(own.mapInPandas(assign, "vec_id long, embedding array<double>, c0 int, c1 int"), "cells")
    sizes = np.zeros((len(books[0][0]), len(books[1][0])), np.int64)
    for r in rows.groupBy("c0", "c1").agg(F.count("*").alias("n")).collect():  # at most centroids**2 rows
        sizes[r["c0"], r["c1"]] = r["n"]
    total = int(sizes.sum())
    enough = max(ROWS_EACH * k, int(np.ceil(share * total)))
    salts = np.maximum(1, -(-sizes.sum(1) // BLOCK_ROWS))
    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def visits(frames):
        for f in frames:
            x = np.array(f["embedding"].tolist(), np.float64).reshape(len(f), -1)
            d0, d1 = distances(x, books) if len(f) else ([], [])
            out = []
            for i in range(len(f)):
                want: dict[int, int] = {}
                for a, b in walk(d0[i], d1[i], sizes, enough):
                    want[a] = want.get(a, 0) | 1 << b
                out += [(int(f["vec_id"].iloc[i]), f["embedding"].iloc[i], a, s, m - (m >> 63 << 64)) for a, m in want.items() if sizes[a].any() for s in range(int(salts[a]))]
            if out:
                yield pd.DataFrame(out, columns=["vec_id", "embedding", "c0", "salt", "mask"])

    block = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    queries = asked.mapInPandas(visits, "vec_id long, embedding array<double>, c0 int, salt int, mask long").withColumn("part", block(blocks))
    salt_of = reduce(lambda c, i: c.when(F.col("c0") == i, F.pmod(F.xxhash64("vec_id"), F.lit(int(salts[i])))), range(len(salts)), F.when(F.lit(False), F.lit(0).cast("long")))
    dealt = rows.select("vec_id", "embedding", "c0", "c1", salt_of.cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, vid, cell = np.array(right["embedding"].tolist()), right["vec_id"].to_numpy(), right["c1"].to_numpy(np.int64)
            q, qid, mask = np.array(left["embedding"].tolist()), left["vec_id"].to_numpy(), left["mask"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(q), 256):
                to = slice(lo, lo + 256)
                a, b, s = best(q[to], qid[to], mask[to], x, vid, cell, k)
                out.append(pd.DataFrame({"query_id": qid[to][a], "vec_id": vid[b], "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    key = ["c0", "salt", "part"]
    found = queries.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(score, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
