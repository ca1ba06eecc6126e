"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Kernel. A piece of text (a word; punctuation and digits inside it are dropped; runs of single
letters count as one word; long words are cut into overlapping windows) maps to its
ordered letter triples, also non-contiguous ones that span at most ``SPAN`` letters, each weighted
DECAY to the letters spanned. Gapped insults and those with inserted characters keep most triples.

Training. Labelled texts are cut into sentences. Landmarks are the words that toxic texts hold
too often for chance and the most frequent words of clean ones. K(x, landmarks) times
the inverse square root of K(landmarks, landmarks) gives Nyström features, on which a
squared-hinge SVM is fitted: every word of a clean text is a negative; positives are the words that
toxic texts hold too often for chance, and for each toxic text without one its highest word, its
witness, chosen again after each round. A text is judged by its ``TOP`` highest distinct words and the number of
its distinct words (of many words some are high by chance); a logistic model of these, fitted on every
third training text, which the machine has not seen, gives 0..1.

The trained machine is one table of triple weights (35**3), so scoring sums table entries and
needs no kernel evaluations. It never sees labels, lang, source or doc_id.

Cases: null and empty texts, and texts without letters, get the score of an empty text; without
toxic or without clean training rows, or if they hold no words, the score is the share of toxic rows (0 without
rows); repeated rows are kept (of a repeated doc_id the machine learns from the smallest text); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import mix, slices, utf8, words

LETTERS, ORDER, SPAN, DECAY = 35, 3, 5, 0.6
WINDOW, STRIDE, FEWEST = 24, 12, 4
#: Most clean and most toxic rows that the machine is fitted on.
SAMPLE_ROWS = (2000, 1000)
#: Most characters of all these rows together; rows beyond, by the same order, are not learned from.
SAMPLE_CHARACTERS = 64_000_000
LANDMARKS = 128
CHANCE, ROUNDS = 0.1, 3
TOP = 3
#: Weight of all negatives against that of all positives, and of the L2 term.
CLEAN_WEIGHT, COST = 30.0, 1e-5

_CODE = np.full(256, -1, np.int8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[0x80:0xC0] = 27 + np.arange(64) % 8  # letters outside a-z by their later bytes; first bytes are dropped


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(at, np.int64).reshape(-1, ORDER)
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return at, (weight / max(np.sqrt((weight**2).sum()), 1e-12)).astype(np.float32)


_BY_LENGTH = {n: _triples(n) for n in range(FEWEST, WINDOW + 1)}


def pieces(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes, start, length, row) of every piece of a slice."""
    code = _CODE[raw]
    keep = code >= 0
    at = np.concatenate([[0], np.cumsum(keep)])
    codes = code[keep]
    start, end, row = words(raw, off)
    a, b = at[start], at[end]
    some = b > a
    a, b, row = a[some], b[some], row[some]
    # runs of single letters
    one = (b - a) == 1
    glued = one[1:] & one[:-1] & (row[1:] == row[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], glued.view(np.int8), [0]]))) if len(one) else np.zeros(0, np.int64)
    ra, rb = edge[::2], edge[1::2]
    a, b, row = np.concatenate([a, a[ra]]), np.concatenate([b, b[rb]]), np.concatenate([row, row[ra]])
    n = b - a
    fits = (n >= FEWEST) & (n <= WINDOW)
    starts, lengths, rows = [a[fits]], [n[fits]], [row[fits]]
    long = np.flatnonzero(n > WINDOW)
    if len(long):
        times = (n[long] - WINDOW + STRIDE - 1) // STRIDE + 1
        which = np.repeat(long, times)
        step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        s = np.minimum(a[which] + step * STRIDE, b[which] - WINDOW)
        starts.append(s), lengths.append(np.full(len(s), WINDOW)), rows.append(row[which])
    return codes, np.concatenate(starts), np.concatenate(lengths), np.concatenate(rows)


def distinct(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each distinct piece, distinct number of each piece)."""
    h = length.astype(np.uint64)
    for j in range(WINDOW):
        more = length > j
        at = np.minimum(start + j, max(len(codes) - 1, 0))
        step = codes[at].astype(np.uint64) + np.uint64(1)
        h = np.where(more, (h ^ step) * np.uint64(0x100000001B3), h)
        if not more.any():
            break
    _, first, which = np.unique(mix(h), return_index=True, return_inverse=True)
    return first, which


def sums(codes: np.ndarray, start: np.ndarray, length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products of each piece's triple map with each row of ``tables`` (m x 35**3)."""
    out = np.zeros((len(start), len(tables)), np.float32)
    for n in np.unique(length):
        at, weight = _BY_LENGTH[int(n)]
        which = np.flatnonzero(length == n)
        for lo in range(0, len(which), 20_000):
            part = which[lo : lo + 20_000]
            c = np.zeros((len(part), n), np.int32)
            c[:] = codes[start[part][:, None] + np.arange(n)]
            u = (c[:, at[:, 0]] * LETTERS + c[:, at[:, 1]]) * LETTERS + c[:, at[:, 2]]
            for m, t in enumerate(tables):
                out[part, m] = t[u] @ weight
    return out


def table_of(word: bytes) -> np.ndarray:
    """The triple map of one word as a dense table."""
    raw = np.frombuffer(word, np.uint8)
    c = _CODE[raw]
    c = c[c >= 0][:WINDOW].astype(np.int64)
    at, weight = _BY_LENGTH[len(c)]
    out = np.zeros(LETTERS**3, np.float32)
    np.add.at(out, (c[at[:, 0]] * LETTERS + c[at[:, 1]]) * LETTERS + c[at[:, 2]], weight)
    return out


def _spelled(codes: np.ndarray, start: np.ndarray, length: np.ndarray, i: int) -> bytes:
    return bytes(96 + c if c < 27 else 0x80 + c - 27 for c in codes[start[i] : start[i] + length[i]].tolist())


def _svm(z: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared hinge with an L2 term over ``z[rows]``, by Newton steps; the last weight is the bias."""
    s, n = weight / weight.sum(), z.shape[1] + 1
    ridge = COST * np.append(np.ones(n - 1), 1e-3)

    def parts():
        for lo in range(0, len(rows), 10_000):
            to = slice(lo, lo + 10_000)
            yield np.hstack([z[rows[to]].astype(np.float64), np.ones((len(rows[to]), 1))]), y[to], s[to]

    loss = lambda w: sum((q * np.maximum(0, 1 - t * (x @ w)) ** 2).sum() for x, t, q in parts()) + (ridge * w * w).sum()
    w = np.zeros(n)
    for _ in range(30):
        grad, hess = 2 * ridge * w, 2 * np.diag(ridge)
        for x, t, q in parts():
            slack = 1 - t * (x @ w)
            on = slack > 0
            x = x[on]
            grad = grad - 2 * x.T @ (q[on] * t[on] * slack[on])
            hess = hess + 2 * (x * q[on][:, None]).T @ x
        step = np.linalg.solve(hess, grad)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-3:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _facts(row: np.ndarray, value: np.ndarray, rows: int, floor: float) -> np.ndarray:
    """rows x TOP + 1: of distinct words (their rows and values) the TOP highest of each row, the highest again where
    there are fewer, ``floor`` without words, and the logarithm of their number."""
    out = np.full((rows, TOP + 1), floor)
    order = np.lexsort((-value, row))
    row, value = row[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    high = rank < TOP
    top = rank == 0
    out[row[top], :TOP] = value[top][:, None]
    out[row[high], rank[high]] = value[high]
    out[:, TOP] = np.log1p(np.bincount(row, minlength=rows))
    return out


def _logistic(facts: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression, by Newton steps over standardised columns."""
    mean, spread = facts.mean(0), facts.std(0) + 1e-9
    x = np.hstack([(facts - mean) / spread, np.ones((len(facts), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - goal) + 0.1 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes, start and length of each distinct word; word and text of each distinct pair),
    gathered sentence by sentence from a bounded number of characters at a time."""
    number: dict[bytes, int] = {}
    pairs, sentences, owner, held = [], [], [], 0

    def gather() -> None:
        codes, start, length, row = pieces(*utf8(pa.array(sentences, pa.string())))
        if len(start):
            first, which = distinct(codes, start, length)
            raw = (codes + 1).astype(np.uint8).tobytes()
            ids = np.array([number.setdefault(raw[s : s + n], len(number)) for s, n in zip(start[first].tolist(), length[first].tolist(), strict=True)], np.int64)
            pairs.append(np.unique(ids[which] * len(texts) + np.array(owner, np.int64)[row]))
        sentences.clear(), owner.clear()

    for i, t in enumerate(texts):
        for x in re.split(r"(?<=[.!?])\s+|\n+", t or ""):
            sentences.append(x)
            owner.append(i)
            held += len(x)
            if held > 500_000:
                gather()
                held = 0
    gather()
    pair = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))
    spelled = list(number)
    length = np.array([len(w) for w in spelled], np.int64)
    codes = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int8) - np.int8(1)
    return codes, np.cumsum(length) - length, length, (pair // len(texts)).astype(np.int32), (pair % len(texts)).astype(np.int32)


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> dict:
    """Fit on labelled texts -> {"table", "bias", "slope", "shift"}; ``table`` is None without both labels."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return {"table": None, "share": share}
    codes, fs, fl, word, doc = _vocabulary(texts)
    # every third text of each label is kept from the machine and serves its logistic curve
    unseen = np.zeros(len(y), bool)
    for label in (0, 1):
        unseen[np.flatnonzero(y == label)[2::3]] = True
    fitted = ~unseen[doc]
    toxic = np.bincount(word, y[doc] * fitted, len(fs))
    clean = np.bincount(word, (1 - y[doc]) * fitted, len(fs))
    seen_toxic, seen_clean = (y * ~unseen).sum(), ((1 - y) * ~unseen).sum()
    odds = np.log((toxic + 0.5) / (seen_toxic + 1)) - np.log((clean + 0.5) / (seen_clean + 1))
    worth = odds * np.sqrt(toxic) * (odds > 0)
    # words of so many toxic and so few clean texts that chance explains fewer than CHANCE of all of them
    expected = (toxic + clean) * share
    gain = np.where(toxic > expected, toxic * np.log(np.maximum(toxic, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    gain += np.where(clean > 0, clean * np.log(np.maximum(clean, 1e-9) / np.maximum((toxic + clean) * (1 - share), 1e-9)), 0.0)
    sure = np.flatnonzero((odds > 1) & (gain > np.log(max(len(fs), 1) / CHANCE)))
    # landmarks: those words, then the most frequent of clean texts
    chosen = [int(i) for i in sure[np.argsort(-worth[sure], kind="stable")][: landmarks // 2]]
    chosen += [int(i) for i in np.argsort(-clean, kind="stable")[:landmarks] if i not in chosen][: landmarks - len(chosen)]
    if not len(sure):
        chosen = [int(i) for i in np.argsort(-worth, kind="stable")[: landmarks // 2]] + chosen[: landmarks // 2]
    if not chosen:
        return {"table": None, "share": share}
    maps = np.stack([table_of(_spelled(codes, fs, fl, i)) for i in chosen])
    value, vector = np.linalg.eigh((maps @ maps.T).astype(float))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    z = np.empty((len(fs), len(chosen)), np.float32)
    for lo in range(0, len(fs), 20_000):
        z[lo : lo + 20_000] = sums(codes, fs[lo : lo + 20_000], fl[lo : lo + 20_000], maps) @ root.astype(np.float32)
    score, negative = worth.copy(), clean > 0
    order = np.argsort(doc, kind="stable")
    word, doc = word[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    spoken = set(sure.tolist())
    for _ in range(ROUNDS):
        witness = Counter({int(i): int(toxic[i]) for i in sure})
        for i in np.flatnonzero((y == 1) & ~unseen):
            own = word[bounds[i] : bounds[i + 1]]
            if len(own) and not spoken.intersection(own.tolist()):
                best = own[np.argmax(score[own])]
                if clean[best] == 0 and (score[best] > 0 or not len(sure)):
                    witness[int(best)] += 1
        pos = np.array(sorted(witness), np.int64)
        if not len(pos):
            return {"table": None, "share": share}
        neg = np.setdiff1d(np.flatnonzero(negative), pos)
        rows = np.concatenate([pos, neg])
        part, seen = np.sqrt(np.array([witness[int(i)] for i in pos], float)), np.sqrt(clean[neg])
        weight = np.concatenate([part / part.sum(), CLEAN_WEIGHT * seen / max(seen.sum(), 1e-9)])
        w = _svm(z, rows, np.concatenate([np.ones(len(pos)), -np.ones(len(neg))]), weight)
        score = z @ w[:-1].astype(np.float32) + w[-1]
    table = ((root @ w[:-1]) @ maps).astype(np.float32)
    floor = float(score[word].min())  # a text without words is as clean as the cleanest word
    facts = _facts(doc, score[word], len(texts), floor)
    if y[unseen].any() and not y[unseen].all():
        facts, y = facts[unseen], y[unseen]
    # texts much shorter or longer than those seen are judged as the shortest or longest of them
    span = (float(facts[:, TOP].min()), float(facts[:, TOP].max()))
    return {"table": table, "bias": float(w[-1]), "floor": floor, "weights": _logistic(facts, y.astype(float)), "span": span, "share": share}


def scores(model: dict, column) -> np.ndarray:
    raw, off = utf8(column)
    if model["table"] is None:
        return np.full(len(off) - 1, model["share"])
    n = len(off) - 1
    codes, start, length, row = pieces(raw, off)
    value = np.zeros(0)
    if len(start):
        first, which = distinct(codes, start, length)
        pair = np.unique(row * len(first) + which)
        row, which = pair // len(first), pair % len(first)
        value = (sums(codes, start[first], length[first], model["table"][None])[:, 0] + model["bias"])[which].astype(float)
    facts = _facts(row, value, n, model["floor"])
    facts[:, TOP] = np.clip(facts[:, TOP], *model["span"])
    return 1 / (1 + np.exp(-np.clip(facts @ model["weights"][:-1] + model["weights"][-1], -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: tuple[int, int] = SAMPLE_ROWS) -> dict:
    """Train on at most ``sample_rows`` labelled rows (clean, toxic), the first by a hash of doc_id."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for label in (0, 1):
        part = own.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows[label])
        sample = part if sample is None else sample.unionByName(part)
    # at most sum(sample_rows) rows: a proven bound for the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    size = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("size", size).filter(F.col("size") <= SAMPLE_CHARACTERS).orderBy("doc_id").select("text", "toxic").collect()
    return train([r["text"] or "" for r in rows], [int(r["toxic"]) for r in rows])


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(shared.value, part.column(1)), pa.float64())], ["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that score below 0.5, all columns kept; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch, "text", 1 << 20):
                yield part.filter(pa.array(scores(shared.value, part.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
