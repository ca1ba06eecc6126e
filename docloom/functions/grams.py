"""Trigrams of texts as 63-bit numbers (three code points of 21 bits), made in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that one step works on; a longer text is a step of its own.
STEP = 1 << 21
#: Bits of a map of trigrams: 512 KB, whatever it holds. More trigrams only let more through.
BITS = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spot(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * _MIX >> np.uint64(42)).astype(np.int64)


def bit_map(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, bool)
    out[_spot(codes)] = True
    return np.packbits(out, bitorder="little")


def _has(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = _spot(codes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _six(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Negative hashes of six characters in a row, from the numbers of their halves."""
    mixed = (first.astype(np.uint64) * _MIX ^ second.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return ~(mixed >> np.uint64(1)).astype(np.int64)


def distinct_grams(texts: list[str], bits: np.ndarray | None = None, sixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct trigrams of each text, in order of rows and codes; also hashes of ``sixes``."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    good, at = row[:-2] == row[2:], row[:-2]
    if sixes and len(points) >= 6:
        good, at = np.concatenate([good, row[:-5] == row[5:]]), np.concatenate([at, row[:-5]])
        codes = np.concatenate([codes, _six(codes[:-3], codes[3:])])
    if bits is not None:
        good &= _has(bits, codes)
    codes, row = codes[good], at[good]
    order = np.argsort(codes, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    codes, row = codes[order], row[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    return row[fresh], codes[fresh]


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with at most STEP characters each, or one text; nulls are empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= STEP:
                size, to = size + len(texts[to]), to + 1
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def grams(df: DataFrame, key: str, text: str, only: Broadcast | None = None) -> DataFrame:
    """(key, gram): distinct trigrams of the lower-cased text; with a map, those that it lets through."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if only is None else only.value
        for part, texts in steps(batches, 1):
            row, codes = distinct_grams(texts, bits)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(codes)], [key, "gram"])

    return df.select(key, F.lower(text).alias("low")).mapInArrow(run, f"{key} {kind}, gram long")


def marks(df: DataFrame, carry: list[str], text: str, only: Broadcast) -> DataFrame:
    """``carry``, low, grams: a row for each text, lower-cased, with those of its distinct trigrams and sixes that a map lets through."""
    own = df.select(*carry, F.lower(text).alias("low"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = only.value
        for part, texts in steps(batches, len(carry)):
            row, codes = distinct_grams(texts, bits, True)
            at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(codes))], [*part.schema.names, "grams"])

    return own.mapInArrow(run, f"{kind}, grams array<bigint>")


def led(df: DataFrame) -> DataFrame:
    """(term, gram, rows) with the hash of a term's first six characters in place of its trigram, where it has so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_numpy(zero_copy_only=False).copy()
            for i, t in enumerate(batch.column(0).to_pylist()):
                if len(t) >= 6:
                    p = np.frombuffer(t[:6].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                    half = p[0::3] << 42 | p[1::3] << 21 | p[2::3]
                    grams[i] = _six(half[:1], half[1:])[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams), batch.column(2)], ["term", "gram", "rows"])

    return df.select("term", "gram", "rows").mapInArrow(run, "term string, gram long, rows long")


def gram_counts(df: DataFrame, text: str, only: Broadcast | None = None) -> DataFrame:
    """gram, rows: how many texts hold a trigram (those that the map lets through); tasks add up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if only is None else only.value
        for _, texts in steps(batches, 0):
            own, count = np.unique(distinct_grams(texts, bits)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count)], ["gram", "rows"])

    return df.select(F.lower(text).alias("low")).mapInArrow(run, "gram long, rows long").groupBy("gram").agg(F.sum("rows").alias("rows"))


def mapped(codes: DataFrame) -> np.ndarray:
    """The map of a table of trigrams (gram), made where they are: tasks send bits, not trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_spot(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["x"])

    found = codes.select("gram").mapInArrow(run, "x long").select((F.col("x") + 1).alias("x"))  # Spark's bit functions count from 1
    out = np.zeros(BITS >> 3, np.uint8)
    for r in found.groupBy(F.expr("bitmap_bucket_number(x)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")).collect():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out
