"""A bit map of ids, of a fixed size and so safe to broadcast, that lets scans skip other rows early."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 MB at most, whatever the number of ids; more ids only let more rows through.
BITS = 1 << 24


def maybe_in(df: DataFrame, ids: DataFrame, column: str, own: str | None = None) -> DataFrame:
    """The rows of ``df`` whose column ``own`` (or ``column``) may be in ``column`` of ``ids``, and all that
    are; a join still decides."""
    spot = F.pmod(F.xxhash64(own or column), F.lit(BITS))
    bits = ids.select(F.pmod(F.xxhash64(column), F.lit(BITS)).alias("_x")).groupBy(F.expr("bitmap_bucket_number(_x)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_x))").alias("_bits"))
    near = df.withColumn("_x", spot).withColumn("_bucket", F.expr("bitmap_bucket_number(_x)")).join(F.broadcast(bits), "_bucket")
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_x) div 8 as int) + 1, 1)), 16, 10) as int)"
    return near.filter(F.expr(f"shiftright({byte}, cast(bitmap_bit_position(_x) % 8 as int)) & 1 = 1")).select(df.columns)
