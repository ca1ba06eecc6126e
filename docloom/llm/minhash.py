"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is its set of distinct k-word shingles, a signature of ``COORDINATES`` minima and a
sketch: four bits of each of ``COMPARED`` minima, packed into longs. Documents are posted under each
(coordinate, value) pair of the signature. Documents with equal sets are one class, named by
its smallest doc_id, so copies never meet each other in a posting list. A pair is retained if it
collides in at least ``MATCHES`` coordinates of the sketch; that and the ``LIVE`` bound below let a
pair of Jaccard 0.8 slip with a probability of about 1.2e-6. Merging is by prefix and skip:
postings that only one class holds are skipped, a class with fewer than ``LIVE`` live postings is
skipped, and only the ``live - LIVE + 1`` rarest postings of a class make candidates (two classes
that collide often enough share one of those). Collisions and sizes are compared inside the join of
lists, so only retained pairs leave it; these are confirmed on the full sets.

Groups. In a first pass every class meets only the smallest class of each of its posting lists;
what is confirmed is joined into components. After that only lists that still hold more than
one component are merged, and only pairs of different components. Classes that still have a partner there
get one bit of each of ``FINE`` minima, which tells 0.76 from 0.8. Long lists are cut into blocks of ``BLOCK``
classes and every two blocks meet in a task of their own; a pair is kept under the first of its common keys
alone. First five of sixteen parts of the pairs (those whose ids' four hash bits differ in one bit or none,
so that all parts stay connected) are confirmed and joined into components, then the pairs that these
leave. So a list of n near copies costs about n pairs, and no link between components is lost.

Cases: null and empty texts, and texts without words, have an empty set and link with nothing;
fewer than k words are one shingle; repeated doc_ids are one document whose sets are all linked;
rows with a null doc_id take no part in links and are kept; an empty table gives no rows; extra
columns are ignored by ``near_duplicates`` and kept by ``keep_one``, whatever their names. A text is
held whole, with some 30 bytes of working memory a byte.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import maybe_in
from .bytetext import mix, shingles, slices, utf8
from .graph import components
from .scratch import released, stored

COORDINATES, LIVE = 32, 14
COMPARED, MATCHES = 128, 80
#: Bits of the fine sketch, and how many may differ: 410 do on average at 0.8, 4.5 deviations below 496.
FINE, DIFFER = 4096, 496
#: Classes of a list that one task compares with each other or with as many others.
BLOCK = 512
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(97))
_A = (_rng.integers(0, 2**32, FINE, dtype=np.uint64) | _U(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, FINE, dtype=np.uint64).astype(np.uint32)
#: Longs of the sketch, sixteen minima each.
_LONGS = COMPARED // 16
_LOW = 0x1111111111111111


def minima(sets: list[np.ndarray], coordinates: int = COMPARED) -> np.ndarray:
    """sets x coordinates minima of the non-empty sets, one pass over all their hashes a coordinate."""
    size = np.array([len(s) for s in sets], np.int64)
    if not len(size):
        return np.zeros((0, coordinates), np.uint32)
    h, first = (np.concatenate(sets) >> _U(32)).astype(np.uint32), np.cumsum(size) - size
    return np.stack([np.minimum.reduceat(h * a + b, first) for a, b in zip(_A[:coordinates], _B[:coordinates], strict=True)], axis=1)


def sketch(low: np.ndarray) -> np.ndarray:
    """Four mixed bits of each minimum -> sets x _LONGS signed longs."""
    four = ((low * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(_U).reshape(len(low), _LONGS, 16)
    return (four << (_U(4) * np.arange(16, dtype=_U))).sum(2, dtype=_U).astype(np.int64)


def fine_bits(low: np.ndarray) -> np.ndarray:
    """One mixed bit of each minimum -> sets x FINE / 8 bytes."""
    return np.packbits(((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8), axis=1)


def _sums(sets: list[np.ndarray]) -> list[pa.Array]:
    """n, f1, f2: size and fingerprint of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    f1 = np.array([s.sum(dtype=_U) for s in sets], _U).astype(np.int64)
    f2 = np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) for s in sets], _U).astype(np.int64)
    return [pa.array(n), pa.array(f1), pa.array(f2)]


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, f1, f2 (size and fingerprint of the set), signature array<int>, sketch array<long>."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(*utf8(part.column(1)), k)
                some = np.array([len(s) > 0 for s in sets], bool)
                low = minima([s for s in sets if len(s)])
                lists = []
                for rows in (low[:, :COORDINATES].astype(np.int32), sketch(low)):
                    at = np.concatenate([[0], np.cumsum(some * rows.shape[1])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel())))
                yield pa.RecordBatch.from_arrays([part.column(0), *_sums(sets), *lists], ["doc_id", "n", "f1", "f2", "signature", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, signature array<int>, sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, f1, f2, hashes binary (the sorted set)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(*utf8(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([part.column(0), *_sums(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "f1", "f2", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, hashes binary")


def fine_sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, f1, f2, fine binary of the rows that have words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingles(*utf8(part.column(1)), k)
                some = [i for i, s in enumerate(sets) if len(s)]
                sets = [sets[i] for i in some]
                fine = [b.tobytes() for b in fine_bits(minima(sets, FINE))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some, pa.int64())), *_sums(sets), pa.array(fine, pa.binary())], ["doc_id", "n", "f1", "f2", "fine"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, fine binary")


_SET = ["id", "n", "f1", "f2"]
_LANES = [f"s{i}" for i in range(_LONGS)]


def _alike(x: Column, y: Column, percent: int) -> Column:
    """Whether two sets, structs of n and sketch longs, may reach the similarity: their sizes allow it
    and they collide in at least MATCHES coordinates (four equal bits count as a collision)."""

    def equal(lane: str) -> Column:
        d = x[lane].bitwiseXOR(y[lane])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_LOW)))

    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    return sizes & (reduce(lambda p, q: p + q, [equal(c) for c in _LANES]) <= COMPARED - MATCHES)


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (x, y) of sets, structs of id, n, f1 and f2, the links (a, b) of ids whose full sets, made
    again from the texts concerned, reach the similarity."""
    near = stored(pairs.distinct(), "retained")
    if near.isEmpty():
        return near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    asked = stored(near.select("x.*").union(near.select("y.*")).distinct(), "asked")
    made = full_sets(maybe_in(docs.select("doc_id", "text"), asked, "id", "doc_id"), k).withColumnRenamed("doc_id", "id")
    full = stored(made.join(asked.hint("merge"), _SET).select(F.struct(*_SET).alias("set"), "hashes").dropDuplicates(["set"]), "sets")

    def check(frames):
        for f in frames:
            keep = []
            for x, y in zip(f["hx"], f["hy"], strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": f["a"][keep], "b": f["b"][keep]})

    sets = lambda c: full.select(F.col("set").alias(c), F.col("hashes").alias("h" + c)).hint("merge")
    told = near.join(sets("x"), "x").join(sets("y"), "y").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "hx", "hy")
    links = stored(told.mapInPandas(check, "a long, b long").distinct(), "links")
    released(near, asked, full)
    return links


def _meetings(start: np.ndarray, size: int):
    """Pairs (i, j) of rows i < j of one group, by their distance; ``start``: first row of each row's group."""
    for d in range(1, size):
        i = np.flatnonzero(start[d:] == start[:-d])
        if not len(i):
            return
        yield i, i + d


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of sets of different parts that share a list and differ in at most DIFFER fine bits, each under
    the first of its common keys. rows: id, n, f1, f2, key, part, times (classes of the list), all (hashes of the
    set's keys), fine."""
    blocks = F.ceil(F.col("times") / BLOCK).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("id", "f1"), blocks).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.select(*_SET, "key", F.hash("key").alias("hash"), "part", "all", "fine", "own", F.least("own", "to").alias("low"), F.greatest("own", "to").alias("high"))
    group = ["key", "low", "high"]

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        col = {c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in (*_SET, *group, "own", "part", "hash")}
        fine = np.frombuffer(b"".join(t.column("fine").to_pylist()), _U).reshape(len(t), -1)
        lists = t.column("all").to_pylist()
        every = np.full((len(t), max(map(len, lists))), np.iinfo(np.int64).max)
        for i, x in enumerate(lists):
            every[i, : len(x)] = x
        new = np.ones(len(t), bool)
        new[1:] = reduce(np.logical_or, [col[c][1:] != col[c][:-1] for c in group])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        out = []
        for i, j in _meetings(start, int(np.bincount(start).max())):
            n, m = col["n"][i], col["n"][j]
            fits = (col["part"][i] != col["part"][j]) & ((col["low"][i] == col["high"][i]) | (col["own"][i] != col["own"][j])) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
            i, j = i[fits], j[fits]
            for lo in range(0, len(i), 8192):
                a, b = i[lo : lo + 8192], j[lo : lo + 8192]
                near = np.bitwise_count(fine[a] ^ fine[b]).sum(1, dtype=np.int64) <= DIFFER
                a, b = a[near], b[near]
                shared = (every[a][:, :, None] == every[b][:, None, :]).any(2)
                first = np.where(shared, every[a], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == col["hash"][a]
                out.append(np.stack([a[first], b[first]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        sides = [pa.StructArray.from_arrays([pa.array(col[c][side]) for c in _SET], _SET) for side in found]
        return pa.RecordBatch.from_arrays(sides, ["x", "y"])

    def run(batches):
        held = None  # rows of the last group, which may go on; a group has two blocks at most
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = [t.column(c)[-1].as_py() for c in group]
            same = reduce(np.logical_and, [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) == v for c, v in zip(group, last, strict=True)]) if len(t) else np.zeros(0, bool)
            cut = int(len(t) - same.sum())
            held = t.slice(cut)
            if cut:
                yield pairs(t.slice(0, cut))
        if held is not None and len(held):
            yield pairs(held)

    side = "struct<id: bigint, n: bigint, f1: bigint, f2: bigint>"
    return own.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, f"x {side}, y {side}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: the smallest doc_id that links of
    Jaccard >= percent/100 reach, and whether the row is that one."""
    made = stored(fingerprints(docs, k), "fingerprints")
    some = made.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    key = ["n", "f1", "f2"]
    reps = some.groupBy(*key).agg(F.min("doc_id").alias("id"))
    first_of = some.join(reps.hint("merge"), key).filter("doc_id = id")
    classes = stored(first_of.select(*_SET, "signature", *(F.col("sketch")[i].alias(c) for i, c in enumerate(_LANES))).dropDuplicates(_SET), "classes")
    posted = classes.select(*_SET, F.posexplode("signature").alias("c", "v")).select(*_SET, (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("key"))
    live = posted.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    lists = posted.join(live.hint("merge"), "key").groupBy(*_SET).agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("l")).filter(F.size("l") >= LIVE)
    rare = lists.select(*_SET, F.slice("l.key", 1, F.size("l") - LIVE + 1).alias("l")).withColumn("all", F.transform("l", lambda x: F.hash(x)))
    own = rare.join(classes.select(*_SET, *_LANES).hint("merge"), _SET).select(F.struct(*_SET, *_LANES).alias("x"), "all", F.explode("l").alias("key"))
    prefix = stored(own, "prefixes")
    pair = [F.struct(*(F.col(f"{c}.{f}") for f in _SET)).alias(c) for c in "xy"]
    alike = _alike(F.col("x"), F.col("y"), percent)
    heads = prefix.groupBy("key").agg(F.min("x").alias("y"), F.count("*").alias("times")).filter("times > 1").select("key", "y")
    first = prefix.join(heads.hint("merge"), "key").filter((F.col("x") != F.col("y")) & alike).select(*pair)
    links = _confirmed(first, docs, k, percent)
    labels = components(links)

    part = F.coalesce("component", "x.id").alias("part")
    placed = stored(prefix.withColumn("id", F.col("x.id")).join(labels.hint("merge"), "id", "left").select("key", "x", "all", part), "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("times")).filter("lo < hi and times > 2").select("key", "times")
    rest = stored(placed.join(mixed.hint("merge"), "key").select("key", "x", "all", "part", "times"), "unmet")
    other = rest.select(F.col("key").alias("k"), F.col("x").alias("y"), F.col("part").alias("other")).hint("merge")
    some_left = rest.join(other, (F.col("key") == F.col("k")) & (F.col("part") != F.col("other")) & alike, "left_semi")
    some_left = stored(some_left.select("x.id", "x.n", "x.f1", "x.f2", "key", "part", "times", "all"), "candidates")
    links = [links]
    if not some_left.isEmpty():
        fine = fine_sketches(maybe_in(docs.select("doc_id", "text"), some_left.select("id").distinct(), "id", "doc_id"), k)
        fine = stored(fine.withColumnRenamed("doc_id", "id").join(some_left.select(_SET).distinct().hint("merge"), _SET).dropDuplicates(_SET), "fine")
        met = stored(_compared(some_left.join(fine.hint("merge"), _SET), percent), "pairs")
        spread = F.pmod(F.xxhash64("x.id"), F.lit(16)).bitwiseXOR(F.pmod(F.xxhash64("y.id"), F.lit(16)))
        links.append(_confirmed(met.filter(F.bit_count(spread) <= 1), docs, k, percent))
        labels = components(reduce(DataFrame.unionByName, links))
        later = met.filter(F.bit_count(spread) > 1).select("x", "y", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        for c in "ab":
            named = labels.select(F.col("id").alias(c), F.col("component").alias("part_" + c))
            later = later.join(named.hint("merge"), c, "left").withColumn("part_" + c, F.coalesce("part_" + c, c))
        links.append(_confirmed(later.filter("part_a != part_b").select("x", "y"), docs, k, percent))
        released(fine, met)
    links = reduce(DataFrame.unionByName, links)
    # a doc_id that is repeated with several sets links their classes
    several = some.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("f1", "f2") for f in (F.min, F.max))).filter("min_f1 < max_f1 or min_f2 < max_f2")
    member = some.join(several.select("doc_id").hint("merge"), "doc_id").join(reps.hint("merge"), key).select("doc_id", "id").distinct()
    twice = member.join(member.groupBy("doc_id").agg(F.min("id").alias("a")).hint("merge"), "doc_id").select("a", F.col("id").alias("b")).filter("a < b")
    labels = components(links.unionByName(twice))
    of_class = stored(reps.join(labels.hint("merge"), "id", "left").select(*key, F.coalesce("component", "id").alias("component")), "groups")
    found = made.select("doc_id", *key).join(of_class.hint("merge"), key, "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"))
    released(classes, prefix, placed, rest, some_left)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, all columns kept (repeats of that doc_id stay with it)."""
    gone = stored(near_duplicates(docs, k, percent).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)
