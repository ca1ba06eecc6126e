"""Results that hold only for the inputs they were computed from: fingerprints before and after, then a rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, remove, renamed


@dataclass(frozen=True)
class Fingerprint:
    """Rows, and sum and exclusive or of their hashes: the same for the same rows in any order, with repeats."""

    rows: int
    total: int
    either: int


def row_hash(df: DataFrame):
    """A hash of all columns in the order of their names; nulls count, so do the names."""
    own = sorted(df.columns)
    return F.xxhash64(F.lit(",".join(own)), *(x for c in own for x in (F.isnull(F.col(f"`{c}`")), F.col(f"`{c}`"))))


def fingerprint(df: DataFrame) -> Fingerprint:
    """One partial aggregate over the table; nothing is sorted or shuffled but one row a task."""
    h = row_hash(df)
    second = F.xxhash64(F.lit(1), h)  # equal rows cancel in the exclusive or, not in the sum
    found = df.select(h.alias("h"), second.alias("g")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("g").alias("x")).first()
    return Fingerprint(found["n"], int(found["s"] or 0), int(found["x"] or 0))


class Moved(Exception):
    """An input changed while its result was computed; nothing was published."""


def publish(spark: SparkSession, inputs: dict[str, Callable[[], DataFrame]], make: Callable[[dict[str, DataFrame]], DataFrame], path: str) -> dict[str, Fingerprint]:
    """Write ``make(inputs)`` as Parquet under ``path`` if no input has changed meanwhile.

    Each input is a function that opens its table anew, so that the second fingerprint sees what is there
    then. The result is written beside and gets its name by one rename. Raises Moved if an input
    changed, and FileExistsError if the name is in use; then nothing stays behind.
    """
    before = {name: fingerprint(open_()) for name, open_ in inputs.items()}
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        make({name: open_() for name, open_ in inputs.items()}).write.parquet(beside)
        moved = [name for name, open_ in inputs.items() if fingerprint(open_()) != before[name]]
        if moved:
            raise Moved(", ".join(sorted(moved)))
        if not renamed(spark, beside, path):
            raise FileExistsError(path)
    finally:
        if exists(spark, beside):
            remove(spark, beside)
    return before
