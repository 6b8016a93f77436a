"""Which rows may be of a set of ids, told by a bitmap of bounded size, so that the others needn't move."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Places of the bitmap: 8 MB are broadcast at most, in up to 2048 rows.
PLACES = 1 << 26


def marked(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false where ``key`` surely isn't among the one column of ``ids``; true for all that are and for a few others.

    Null keys are in no set; no ids mark no row. ``key`` and ``ids`` must be of one type; names that start with marked_ are taken.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES)) + 1
    known = ids.where(F.col(ids.columns[0]).isNotNull()).select(place(F.col(ids.columns[0])).alias("place"))
    bits = known.groupBy(F.bitmap_bucket_number("place").alias("marked_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marked_bits"))
    at = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.substring("marked_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.col(key).isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1), F.lit(False))
    held = rows.withColumn("marked_bucket", F.bitmap_bucket_number(place(F.col(key))))
    return held.join(F.broadcast(bits), "marked_bucket", "left").withColumn(name, there).drop("marked_bucket", "marked_bits")
