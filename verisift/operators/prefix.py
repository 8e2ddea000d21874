"""Positions and running sums over whole tables, without a window that takes all rows to one task.

Rows are dealt by ranges of the order and sorted where they are; each range then only needs what the ranges before it
add up to, a table of one row a range. Equal rows may be parted: put a unique column last where they must not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: ``monotonically_increasing_id`` holds the partition above these bits.
_ROW_BITS = 33


def in_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` stored in the order given, with ``_part`` (its range) and ``_at`` (its place there, rising)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    return placed.withColumn("_part", F.shiftrightunsigned("_at", _ROW_BITS).cast("int"))


def positions(df: DataFrame, order: list[Column | str], group: list[str], into: str) -> DataFrame:
    """``df`` with the row's place from 0 in its group; ``order`` starts with the columns of ``group``, free of nulls.

    A group of any size is spread over as many ranges as it fills.
    """
    rows = in_order(df, order)
    parts = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    found = rows.join(parts, ["_part", *group])
    return found.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(into))


def sums_before(df: DataFrame, order: list[Column | str], group: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with ``sums`` (new column: summed column) over the earlier rows of the group, 0 for its first row.

    ``order`` starts with the columns of ``group``, which may hold nulls, and is total within a group. A window only adds
    up rows of one range.
    """
    rows = in_order(df, order)
    totals = rows.groupBy("_part", *group).agg(*(F.sum(c).alias(f"_all_{into}") for into, c in sums.items()))
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        F.col("_part").alias("_range"),
        *(F.col(g).alias(f"_group_{g}") for g in group),
        *(F.coalesce(F.sum(f"_all_{into}").over(earlier), F.lit(0)).alias(f"_before_{into}") for into in sums),
    )
    same = [F.col("_part") == F.col("_range"), *(F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in group)]
    here = W.partitionBy("_part", *group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    within = {into: F.coalesce(F.sum(c).over(here), F.lit(0)) for into, c in sums.items()}
    return rows.join(totals, same).select(
        *df.columns, *((F.col(f"_before_{into}") + inner).alias(into) for into, inner in within.items())
    )
