"""Positions of rows in an order, without a task that holds a whole group.

A plain ``row_number`` over a group sorts the group in one task. Here the caller gives a
bucket that follows the order (all of bucket 3 stands before bucket 4). Rows are numbered
within (group, bucket), and the sizes of the buckets before are added. The sizes are one
row per (group, bucket), so their running sum is small whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, group: list[str], bucket: str, order: list[str], out: str, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Add ``out``, the 0-based position of each row of its group by (bucket, *order), and
    optionally ``total``, the number of rows of the group. Given ``weight``, a row takes that
    many places, of which ``out`` is the first.

    ``df`` is read twice, so it should be a table or a cheap scan. ``group`` may be empty:
    then all rows are one group. Nulls in ``group`` are a group, nulls in ``order`` come
    first; rows equal in all of ``order`` get neighbouring positions in any order. An empty
    ``df`` gives an empty result.
    """
    keys = [*group, bucket]
    sizes = df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(*group)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    place = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(inside) - 1
    numbered = df.withColumn("_r", place)
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    joined = numbered.join(offsets, same, "inner").withColumn(out, F.col("_before") + F.col("_r"))
    return joined.drop("_r", "_before", *[f"_o_{k}" for k in keys])
