"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smallest_hashes(keys: DataFrame, id_col: str, class_col: str, per_class: int | dict) -> DataFrame:
    """At most per_class rows of each class (a dict has a limit for each class, 0 for others), those with the smallest hash of the id.

    Classes must be few, for their counts come to the driver. They tell below which hash about one and a half times the wanted rows lie, so
    only those are ranked and no class gathers in one task.
    """
    h = F.xxhash64(F.col(id_col))
    near, wanted = F.lit(False), F.lit(0)
    for r in keys.groupBy(class_col).count().collect():
        limit = per_class.get(r[class_col], 0) if isinstance(per_class, dict) else per_class
        share = min(1.0, (1.5 * limit + 1_000) / r["count"])
        same = F.col(class_col).eqNullSafe(F.lit(r[class_col]))
        near = near | (same & (h <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))))
        wanted = F.when(same, F.lit(limit)).otherwise(wanted)
    order = Window.partitionBy(class_col).orderBy(h, F.col(id_col))
    return keys.where(near).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= wanted).drop("_rank")
