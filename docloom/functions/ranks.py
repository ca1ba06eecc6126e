"""Ranks inside groups of any size: a group is split by ranges of its order, and counts before a range are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def in_ranges(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows with ``_range``: tasks hold ranges of (group, order), so a large group lies in several. ``order`` must be
    total within a group, else rows of equal order may change places. Stored, since ranges are read more than once."""
    return cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", carry: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the number of each row in its group, from 1, as a window over the group would give it.

    ``carry`` adds the last value that is not null of an expression in the rows before, ``sums`` the sum of one over
    the rows before (0 for the first). Windows stand over (group, range), so no task sorts more than a range; those
    over ranges have a row for each range.
    """
    carry, sums = carry or {}, sums or {}
    local = Window.partitionBy(*group, "_range").orderBy(*order)
    ahead = local.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = in_ranges(df, group, order).withColumns({"_local": F.row_number().over(local), **{f"_at_{n}": x for n, x in carry.items()}, **{f"_own_{n}": F.last(x, ignorenulls=True).over(ahead) for n, x in carry.items()}, **{f"_add_{n}": x for n, x in sums.items()}, **{f"_sum_{n}": F.coalesce(F.sum(x).over(ahead), F.lit(0)) for n, x in sums.items()}})
    own = cut(own) if carry or sums else own
    last = [F.max_by(F.struct(F.col(f"_at_{n}").alias("v")), F.when(F.col(f"_at_{n}").isNotNull(), F.col("_local"))).alias(f"_last_{n}") for n in carry]
    parts = own.groupBy(*group, "_range").agg(F.count("*").alias("_rows"), *last, *(F.sum(f"_add_{n}").alias(f"_all_{n}") for n in sums))
    parts = parts.select(*group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), *(F.last(F.col(f"_last_{n}.v"), ignorenulls=True).over(before).alias(f"_last_{n}") for n in carry), *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_all_{n}") for n in sums))
    joined = own.alias("o").join(parts.alias("p").hint("merge"), [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*group, "_range"]])
    place = (F.col("o._local") + F.col("p._before")).alias(name)
    return joined.select(*(F.col(f"o.{c}") for c in df.columns), place, *(F.coalesce(F.col(f"o._own_{n}"), F.col(f"p._last_{n}")).alias(n) for n in carry), *((F.col(f"o._sum_{n}") + F.col(f"p._all_{n}")).alias(n) for n in sums))
