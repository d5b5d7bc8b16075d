"""Running sums along a key's positions without a whole key in one task.

Both operators read their input twice, for the stretches and for what lies before
them; it is written once, or a chain of them would compute it ever more often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import checkpointed, written


def running_sum(df: DataFrame, key: str, pos: str, value: str, *, out: str = "running", width: int = 1 << 16) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the key's rows up to this position, ties included.

    Sums within stretches of ``width`` positions, plus the stretches' totals before:
    a hot key is as many tasks as it has stretches, and only totals meet per key.
    Rows of one position should be folded before. Nulls in ``value`` add nothing.
    """
    binned = written(df.withColumn("__bin", F.floor(F.col(pos) / width)))
    before = Window.partitionBy(key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        binned.groupBy(key, "__bin").agg(F.sum(value).alias("__sum"))
        .select(key, "__bin", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy(key, "__bin").orderBy(pos)
    return (
        binned.join(totals, [key, "__bin"])
        .withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("__bin", "__before")
    )


def previous(df: DataFrame, key: str, pos: str, value: str, *, out: str = "previous", width: int = 1 << 16) -> DataFrame:
    """``df`` with ``out``: the ``value`` of the key's row before this one, null for the first.

    Positions are whole numbers, one row each. Looks within stretches of ``width``
    positions, and at the last row of the stretch before; no key is one task.
    """
    binned = written(df.withColumn("__bin", F.floor(F.col(pos) / width)))
    last = binned.groupBy(key, "__bin").agg(F.max_by(F.struct(F.col(value).alias("v")), pos).alias("__last"))
    handed = last.select(key, "__bin", F.lag("__last").over(Window.partitionBy(key).orderBy("__bin")).alias("__handed"))
    within = Window.partitionBy(key, "__bin").orderBy(pos)
    found = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(within), F.col("__handed"))
    return binned.join(handed, [key, "__bin"]).withColumn(out, found["v"]).drop("__bin", "__handed")


def number_rows(df: DataFrame, order: list[str], *, out: str = "number") -> DataFrame:
    """``df`` with ``out``: 0, 1, ... along ``order``, by a range sort and the rows of the partitions before.

    No task holds more than its range. Rows that tie in ``order`` are numbered in any order.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit(2**33 - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return placed.withColumn("__part", part).join(starts, "__part").withColumn(out, F.col("__first") + row).drop("__part", "__first", "__id")


def number_within(df: DataFrame, key: str, order: list[str], *, out: str = "number") -> DataFrame:
    """``df`` with ``out``: 0, 1, ... along ``order`` within each key, by one range sort of all keys; no key is one task."""
    numbered = written(number_rows(df, [key, *order], out="__at"))
    first = numbered.groupBy(key).agg(F.min("__at").alias("__first"))
    return numbered.join(first, key).withColumn(out, F.col("__at") - F.col("__first")).drop("__at", "__first")
