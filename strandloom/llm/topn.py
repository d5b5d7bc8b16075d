"""The N highest-scoring items of every group, by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandloom.session import written

#: Shares of all rows below the lower bound of each band but the last.
BANDS = (0.98, 0.85, 0.5)
#: Filled groups up to this many are broadcast to the next band's scan; more of them meet it in a shuffle.
BROADCAST_GROUPS = 200_000


def banded(df: DataFrame, group: str, item: str, score: str, bands: tuple[float, ...], bounds_from: DataFrame | None) -> tuple[DataFrame, int]:
    """``group, item, score, band`` written as a partition for each score range, the highest is band 0; and their number.

    Nothing is sorted or ranked here, and no row moves.
    """
    rows = df.select(F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).alias("score")).where(
        "group is not null and item is not null and score is not null"
    )
    bounds = (df if bounds_from is None else bounds_from).select(F.percentile_approx(F.col(score), list(bands), 1000)).first()[0] if bands else None
    bounds = sorted(set(bounds or []), reverse=True)
    band = reduce(lambda otherwise, kb: F.when(F.col("score") >= F.lit(kb[1]), kb[0]).otherwise(otherwise), reversed([*enumerate(bounds)]), F.lit(len(bounds)))
    return written(rows.withColumn("band", band), "band"), len(bounds) + 1


def top_n(
    df: DataFrame, group: str, item: str, score: str, n: int, *,
    bands: tuple[float, ...] = BANDS, bounds_from: DataFrame | None = None, broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """``group, item, score, place``: the ``n`` highest scores of each group, of equal ones the smaller item.

    Rows are written in bands of score ranges. From the top band down, groups that
    the bands above have filled are anti-joined out of the band, then what is left
    of it is ranked within its groups; a group takes from its boundary band as many
    as it lacks. Band bounds only decide how much work is skipped, never the result.
    They are read off ``bounds_from`` (default ``df``), whose ``score`` may be a
    rough one.

    Filled groups are broadcast to the scan of the band while there are at most
    ``broadcast_groups``, so that their rows are gone before the shuffle. Beyond
    that they meet the band by group. Either way each task keeps the ``n`` best per
    group before anything is shuffled: a group with a third of all rows sends
    ``n`` rows per task.

    A null group, item or score is no row of the ranking. Repeated (item, score)
    rows are ranked each; a group of fewer than ``n`` gives all it has.
    """
    rows, count = banded(df, group, item, score, bands, bounds_from)
    best = Window.partitionBy("group").orderBy(F.desc("score"), "item")
    taken: list[DataFrame] = []
    have: DataFrame | None = None  # group, have: how many the bands so far gave
    n_filled = 0
    for k in range(count):
        here = rows.where(F.col("band") == k).drop("band")
        if n_filled and n_filled <= broadcast_groups:
            here = here.join(F.broadcast(have.where(F.col("have") >= n).select("group")), "group", "left_anti")
        here = here.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
        if have is not None:
            here = (
                here.join(have, "group", "left")
                .withColumn("place", F.col("place") + F.coalesce("have", F.lit(0)).cast("int"))
                .where(F.col("place") <= n).drop("have")
            )
        if k + 1 == count:
            taken.append(here)
            break
        seen = Observation()
        taken.append(written(here.observe(seen, F.count_if(F.col("place") == n).alias("filled"))))
        n_filled += seen.get["filled"]
        have = reduce(DataFrame.unionByName, taken).groupBy("group").agg(F.max("place").alias("have"))
    return reduce(DataFrame.unionByName, taken)
