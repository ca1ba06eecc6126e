"""Phrase collocations of each language by best-first growth from rare first words.

A phrase of 2 to 5 words that occurs a times scores floor(1000 a n / (l r)) at a cut into parts that occur l and r
times among n words; its lowest cut counts. Since a <= r, a phrase that begins with a word of frequency f scores
at most floor(1000 n / f): first words are expanded in order of rising frequency, ``FRONTIER`` of a language a round,
word by word along prefixes that are frequent themselves, until no word left can reach the score of
the last phrase wanted (or equal it: ties are settled too) or none is left. Frequent parts that begin with words not expanded are counted
on demand. A phrase is dropped if a longer candidate holds it that is as frequent: then all its occurrences
have the same word before them, or the same word after them, which counting notes.

Counting is a scan: tasks hash words and word runs of their slices, keep those that a bit map of a fixed size
lets through, and add up; Spark adds up by language and phrase. Runs of each length, most of which are rare, are
counted by hash alone first, and spelled out where that count suffices. Bit maps and hashes let some phrases
through that they need not; counts of phrases decide. Within a slice, and for neighbours, words are told apart by 64 bits of hash.

Cases: null texts are empty; a null language is ``und``; texts without words count nothing; repeated rows count each time; ties in
score go by frequency, then by phrase; an empty table gives no rows; very long texts are slices of
their own; other columns are ignored. Products are exact to 38 digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import LOWER, mix, slices, utf8, word_hashes
from .scratch import released, stored

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that a step of a scan works on.
STEP = 1 << 20
#: First words of a language that one round expands, more where frequencies tie.
FRONTIER = 1 << 16
#: Bits of a map of hashes: 8 MB, whatever it holds.
BITS = 1 << 26
#: Languages are split by phrase before their first ``TOP`` are taken.
PARTS = 256
_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[0x20, 9]] = True
_GAP |= _BREAK


def cut(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, piece) of every word."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    gap = _GAP[raw]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | edge[1:n]
    last[:-1] &= gap[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum(_BREAK[raw] | edge[:n])
    return start, end, np.searchsorted(off, start, side="right") - 1, piece[start]


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & _U(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_map(df: DataFrame) -> np.ndarray:
    """The bits of column ``h``, of a fixed size."""
    at = F.pmod("h", F.lit(BITS)) + 1  # Spark's bit functions count from 1
    found = df.select(at.alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    out = np.zeros(BITS >> 3, np.uint8)
    for row in found.collect():
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


COUNTED = "lang string, phrase string, h long, n long, l0 long, l1 long, r0 long, r1 long"


def count(docs: DataFrame, lengths: tuple[int, ...], often: Broadcast | None = None, live: Broadcast | None = None, wanted: Broadcast | None = None, whole: bool = False, hashed: bool = False) -> DataFrame:
    """lang, phrase, h (its hash), n and the least and greatest hash of the words before and after it (0 at the
    edge of a piece), for runs of ``lengths`` words: all of them, those of ``wanted``, or those whose words but the
    last are in ``live`` (if ``whole``, also those but the first) and whose last is in ``often``. With single words
    come rows without a phrase that count all words of a language. ``hashed`` gives h and n alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {k: b.value for k, b in (("often", often), ("live", live), ("wanted", wanted)) if b is not None}
        for batch in batches:
            for part in slices(batch, "text", STEP):
                raw, off = utf8(part.column(1))
                start, end, row, piece = cut(raw, off)
                langs = ["und" if x is None else x for x in part.column(0).to_pylist()]
                seeds = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
                seed = np.array([seeds[x] for x in langs], _U)[row]
                words = word_hashes(raw, start, end)
                runs = {1: words}
                for k in range(2, max(lengths) + 1):
                    runs[k] = mix(runs[k - 1][:-1] * _STEP + words[k - 1 :]) if len(words) >= k else words[:0]
                for k in lengths:
                    if len(runs[k]):
                        yield from table(k, runs, seed, piece, raw, start, end, row, langs, maps)
                if not hashed and 1 in lengths and len(words):
                    names = sorted(seeds)
                    at = {x: i for i, x in enumerate(names)}
                    total = np.bincount(np.array([at[x] for x in langs])[row], minlength=len(names))
                    none = pa.array(np.zeros(len(names), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.string()), none, pa.array(total), *[none] * 4], ["lang", "phrase", "h", "n", "l0", "l1", "r0", "r1"])

    def table(k, runs, seed, piece, raw, start, end, row, langs, maps) -> Iterator[pa.RecordBatch]:
        words, n = runs[1], len(runs[k])
        good = piece[:n] == piece[k - 1 :]
        if "wanted" in maps:
            good &= _has(maps["wanted"], mix(runs[k] + seed[:n]))
        if "live" in maps:
            before = _has(maps["live"], mix(runs[k - 1] + seed[: n + 1]))
            good &= before[:-1] & _has(maps["often"], mix(words + seed))[k - 1 :]
            if whole and k > 2:
                good &= before[1:]
        at = np.flatnonzero(good)
        if not len(at):
            return
        key = mix(runs[k][at] + seed[at])
        if hashed:
            own, times = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(times)], ["h", "n"])
            return
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        signed = words.view(np.int64)
        if k == 1:  # neighbours matter to phrases only
            signed = np.zeros(len(words), np.int64)
        left = np.where((at > 0) & (piece[at - 1] == piece[at]), signed[at - 1], 0)
        after = np.minimum(at + k, len(words) - 1)
        right = np.where((at + k < len(words)) & (piece[after] == piece[at]), signed[after], 0)
        low = LOWER[raw].tobytes()
        ends = [f(x, fresh) for x in (left, right) for f in (np.minimum.reduceat, np.maximum.reduceat)]
        first = at[fresh]
        s, e = start.tolist(), end.tolist()
        if k == 1:
            phrases = [low[s[i] : e[i]].decode() for i in first.tolist()]
        else:
            phrases = [b" ".join([low[s[j] : e[j]] for j in range(i, i + k)]).decode() for i in first.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r in row[first].tolist()]), pa.array(phrases), pa.array(key[fresh].view(np.int64)), pa.array(np.diff(np.append(fresh, len(at)))), *map(pa.array, ends)], ["lang", "phrase", "h", "n", "l0", "l1", "r0", "r1"])

    if hashed:
        return docs.select("lang", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = docs.select("lang", "text").mapInArrow(run, COUNTED)
    return found.groupBy("lang", "phrase").agg(F.max("h").alias("h"), F.sum("n").alias("n"), F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.min("r0").alias("r0"), F.max("r1").alias("r1"))


def _cuts(grams: DataFrame) -> DataFrame:
    """lang, phrase, n, c (words of the first part), first, rest for each cut of each phrase."""
    words = F.split("phrase", " ")
    return grams.select("lang", "phrase", "n", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("c")).select("lang", "phrase", "n", "c", F.array_join(F.slice("w", F.lit(1), F.col("c")), " ").alias("first"), F.array_join(F.expr("slice(w, c + 1, size(w) - c)"), " ").alias("rest"))


def scored(grams: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """The lowest cut of each phrase: lang, phrase, a, l, r, n, score. ``known`` has the counts of all parts;
    ``totals`` has one row a language."""
    part = known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    left = part.select("lang", F.col("part").alias("first"), F.col("f").alias("l"))
    right = part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    every = _cuts(grams).withColumnRenamed("n", "a").join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"]).join(F.broadcast(totals), "lang")
    big = {n: F.col(n).cast("decimal(38,0)") for n in ("a", "l", "r", "total")}
    every = every.withColumns({"over": F.lit(1000) * big["a"] * big["total"], "under": big["l"] * big["r"]}).withColumn("score", F.expr("over div under"))
    best = every.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "c", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("total").alias("n"), F.col("x.score").alias("score"))


def first_of_each(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, with their rank; languages go in parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("_part", F.pmod(F.hash("phrase"), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("_part")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, frontier: int = FRONTIER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score. The driver keeps a few numbers for each language and step of frequency."""
    spark = docs.sparkSession

    def shared(df: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(bit_map(df))

    words = stored(count(docs, (1,), wanted=shared(count(docs, (1,), hashed=True).filter(F.col("n") >= least))), "words")
    totals = stored(words.filter("phrase is null").select("lang", F.col("n").alias("total")), "totals")
    total = {r["lang"]: r["total"] for r in totals.collect()}
    often = words.filter(F.col("phrase").isNotNull() & (F.col("n") >= least)).withColumn("step", F.floor(F.log2(F.col("n") / least) * 8).cast("int"))
    # steps of frequency, 8 to a doubling: at most some hundreds a language
    steps: dict[str, list] = {x: [] for x in total}
    for r in often.groupBy("lang", "step").agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy("lang", "step").collect():
        steps[r["lang"]].append((r["step"], r["words"], r["least"]))
    is_often = shared(often)
    done = {x: -1 for x in total}
    open_ = {x for x in total if steps[x]}
    known, tops, spent = [often.select("lang", "phrase", "n")], [], [words, totals]
    while open_:
        bounds = []
        for x in sorted(open_):
            size, to = 0, done[x]
            for step, number, _ in steps[x]:
                if step > done[x] and size < frontier:
                    size, to = size + number, step
            bounds.append((x, done[x], to))
            done[x] = to
        # if every frequent word is or has been expanded, every frequent part is or has been counted
        whole = all(done[x] == steps[x][-1][0] for x in total if steps[x]) and len(known) == 1
        ranges = F.broadcast(spark.createDataFrame(bounds, "lang string, above int, upto int"))
        grown = often.join(ranges, "lang").filter((F.col("step") > F.col("above")) & (F.col("step") <= F.col("upto")))
        grams = []
        for k in range(2, longest + 1):
            live = shared(grown)
            enough = shared(count(docs, (k,), often=is_often, live=live, whole=whole, hashed=True).filter(F.col("n") >= least))
            grown = stored(count(docs, (k,), wanted=enough).filter(F.col("n") >= least), "grams")
            grams.append(grown.withColumn("k", F.lit(k)))
            if not grown.limit(1).count():
                break
        spent += grams
        candidates = grams[0]
        for more in grams[1:]:
            candidates = candidates.unionByName(more)
        known.append(candidates.select("lang", "phrase", "n"))
        have = known[0]
        for more in known[1:]:
            have = have.unionByName(more)
        if not whole and longest > 2:
            rests = _cuts(candidates).select("lang", F.col("rest").alias("phrase")).filter(F.instr("phrase", " ") > 0).distinct().join(have.hint("merge"), ["lang", "phrase"], "left_anti")
            rests = stored(rests.mapInArrow(_hashed, "lang string, phrase string, h long"), "rests")
            spent.append(rests)
            if rests.limit(1).count():
                parts = stored(count(docs, tuple(range(2, longest)), wanted=shared(rests)).join(rests.select("lang", "phrase").hint("merge"), ["lang", "phrase"], "left_semi"), "parts")
                spent.append(parts)
                known.append(parts.select("lang", "phrase", "n"))
                have = have.unionByName(known[-1])
        same = ((F.col("l0") == F.col("l1")) & (F.col("l0") != 0)) | ((F.col("r0") == F.col("r1")) & (F.col("r0") != 0))
        survive = candidates.filter(~same | (F.col("k") == longest)).select("lang", "phrase", "n")
        both = first_of_each(scored(survive, have, totals), top)
        if tops:
            both = first_of_each(both.drop("rank").unionByName(tops[-1].drop("rank")), top)
        tops.append(stored(both, "top"))
        last = {r["lang"]: r["score"] for r in tops[-1].filter(F.col("rank") == top).collect()}
        left = {x: [least_ for step, _, least_ in steps[x] if step > done[x]] for x in open_}
        open_ = {x for x in open_ if left[x] and (x not in last or last[x] <= 1000 * total[x] // left[x][0])}
    out = tops[-1].select("lang", "rank", "phrase", "a", "l", "r", "n", "score") if tops else spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    for df in spent + tops[:-1]:
        if hasattr(df, "_scratch"):
            released(df)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash that counting gives to a phrase."""
    for batch in batches:
        langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not phrases:
            continue
        raw, off = utf8(batch.column(1))
        start, end, row, _ = cut(raw, off)
        words = word_hashes(raw, start, end)
        size = np.bincount(row, minlength=len(phrases))
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        h = words[at]
        for j in range(1, int(size.max())):
            more = size > j
            h[more] = mix(h[more] * _STEP + words[at[more] + j])
        seed = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], _U)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mix(h + seed).view(np.int64))], ["lang", "phrase", "h"])


# The steps of the score in plain SQL: all runs of one to five words are counted.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
grams AS (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 6) AS s(k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p HAVING k = 1 OR count(*) >= 100),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE k >= 2),
cut AS (SELECT lang, k, p, f AS a, unnest(range(1, k)) AS c FROM often),
scored AS (
  SELECT o.lang, o.k, o.p, o.a, x.f AS l, y.f AS r, t.n, o.c, CAST(1000::HUGEINT * o.a * t.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut o JOIN counts x ON x.lang = o.lang AND x.k = o.c AND x.p = o.p[:o.c]
  JOIN counts y ON y.lang = o.lang AND y.k = o.k - o.c AND y.p = o.p[o.c + 1:] JOIN totals t ON t.lang = o.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
held AS (SELECT lang, p[1:k - 1] AS p, f FROM often WHERE k > 2 UNION ALL SELECT lang, p[2:k] AS p, f FROM often WHERE k > 2),
kept AS (SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = s.lang AND h.p = s.p AND h.f >= s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase,
  a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM kept QUALIFY rank <= 2000"""
