"""Exact or bounded-error percentiles per group, by distributed multi-select."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.session import partitions, written

#: A group with at least one in so many of all values is spread: that many groups at most.
SPREAD_BELOW = 1000
#: Parts for each shuffle partition that a group with all values would have.
PARTS = 16


def day_states(df: DataFrame, group: str, value: str, part: Column | str) -> DataFrame:
    """``group, part, value, n``: how often each value occurs in a part (a day).

    States of disjoint rows are combined by adding ``n``: from days, from tasks, or
    from tables written earlier. Rows without a group or a value do not count.
    """
    part = F.col(part) if isinstance(part, str) else part
    return (
        df.select(F.col(group).alias("group"), part.alias("part"), F.col(value).alias("value"))
        .where("group is not null and value is not null")
        .groupBy("group", "part", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def day_sketches(df: DataFrame, group: str, value: str, part: Column | str, *, error: float) -> DataFrame:
    """``group, part, value, n`` of bounded size: at most about 2 / ``error`` values for each group and part.

    For values that hardly repeat, where :func:`day_states` would be as large as the
    data. Each value stands for an equal number of rows; ranks are off by at most
    ``error`` of the part's rows, and so by ``error`` of all rows once parts are
    combined. Values of the type's own; rows without a group or a value do not count.
    """
    part = F.col(part) if isinstance(part, str) else part
    steps = max(1, math.ceil(2 / error))
    cuts = F.array(*[F.lit((k + 0.5) / steps) for k in range(steps)])
    whole, at = F.col("whole"), F.col("at")
    return (
        df.select(F.col(group).alias("group"), part.alias("part"), F.col(value).alias("value"))
        .where("group is not null and value is not null")
        .groupBy("group", "part")
        .agg(F.percentile_approx("value", cuts, 4 * steps).alias("values"), F.count(F.lit(1)).alias("whole"))
        .select("group", "part", "whole", F.posexplode("values").alias("at", "value"))
        .withColumn("n", F.floor(whole * (at + 1) / steps) - F.floor(whole * at / steps))
        .groupBy("group", "part", "value").agg(F.sum("n").cast("long").alias("n")).where("n > 0")
    )


def combine_states(*states: DataFrame) -> DataFrame:
    """One state out of several; rows of the same part add up."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("group", "part", "value").agg(F.sum("n").alias("n"))


def spread_values(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``group, value, n, bucket`` and ``group, buckets``: hot groups cut into buckets by the hash of their values.

    A group with a third of the values has more buckets than there are shuffle
    partitions. Groups that need none are not in the second table, which has at most
    ``SPREAD_BELOW`` rows.
    """
    spark = states.sparkSession
    folded = written(states.groupBy("group", "value").agg(F.sum("n").alias("n")))
    whole = folded.count()
    hot = written(
        folded.groupBy("group").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") * SPREAD_BELOW >= whole)
        .select("group", F.ceil(F.col("d") / max(1, whole) * partitions(spark) * PARTS).cast("int").alias("buckets")).where("buckets > 1")
    )
    return folded.join(F.broadcast(hot), "group", "left").withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("value"), F.col("buckets")), F.lit(0)).cast("int")).drop("buckets"), hot


def multi_select(states: DataFrame, shares: list[float], *, error: float = 0.0, max_rounds: int = 200) -> DataFrame:
    """``group, share, value, n, rank_error``: for each group the smallest value with at least ``share`` of all at or below it.

    States of all parts are combined first. Every round, each part of a group proposes
    the median of the values it has left for each open (group, share); the median of
    the proposals weighted by how many rows stand behind them becomes the pivot; all
    parts count below, at and above it; the ranges it rules out are dropped. At
    least about a quarter of the rows goes each round.
    With ``error`` > 0 a group also ends once the ranks left are no more than that
    share of its rows: then ``value`` is a proposal and ``rank_error`` bounds its
    distance; else ``rank_error`` is 0.

    A part is a group's bucket (see :func:`spread_values`). Values are laid out by
    (group, bucket) and pivots are sent to every bucket, so a group with a third of
    the values works in all partitions, whether or not pivots are few enough to be
    broadcast. The number of groups may be large: the open ones are a table, never
    on the driver.
    """
    if not all(0 < s <= 1 for s in shares):
        raise ValueError("shares lie in (0, 1]")
    values, hot = spread_values(states)
    totals = values.groupBy("group", "bucket").agg(F.sum("n").alias("n")).groupBy("group").agg(F.sum("n").alias("total"))
    # the rank asked for; a share that is a whole number of rows but for its last bits counts as whole
    asked = totals.select("group", "total", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = asked.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("total"), 6))).cast("long"))
    in_parts = lambda df: (
        df.join(F.broadcast(hot), "group", "left").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("buckets") - 1, F.lit(0))))).drop("buckets")
    )
    left = written(values.join(in_parts(asked), ["group", "bucket"]).select("group", "share", "bucket", "value", "n", "total", "rank"))
    key, found = ["group", "share"], None
    none = f"cast(null as {left.schema['value'].dataType.simpleString()})"
    # over a row for each part of a group: the first proposal at which half of the rows is reached
    weighted_median = f"""aggregate(p, named_struct('upto', 0L, 'at', {none}), (a, x) -> named_struct(
        'upto', a.upto + x.w, 'at', coalesce(a.at, if(2 * (a.upto + x.w) >= all, x.value, {none})))).at"""
    for _ in range(max_rounds):
        proposals = left.groupBy(*key, "bucket").agg(F.percentile_approx("value", 0.5, 200).alias("value"), F.sum("n").alias("w"))
        pivots = (
            proposals.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("value", "bucket", "w"))).alias("p"), F.sum("w").alias("all"))
            .select(*key, F.expr(weighted_median).alias("pivot"))
        )
        side = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
        counts = (
            left.join(in_parts(pivots), [*key, "bucket"]).groupBy(*key)
            .agg(
                F.first("pivot").alias("pivot"), F.first("total").alias("total"), F.first("rank").alias("rank"),
                side(F.col("value") < F.col("pivot")).alias("below"), side(F.col("value") == F.col("pivot")).alias("at"), side(F.col("value") > F.col("pivot")).alias("above"),
            )
        )
        seen = Observation()
        open_ = written(
            counts.withColumn("side", F.when(F.col("rank") <= F.col("below"), -1).when(F.col("rank") <= F.col("below") + F.col("at"), 0).otherwise(1))
            .withColumn("kept", F.when(F.col("side") < 0, F.col("below")).when(F.col("side") > 0, F.col("above")).otherwise(0))
            .withColumn("done", (F.col("side") == 0) | (F.col("kept") + F.col("at") <= F.lit(error) * F.col("total")))
            .observe(seen, F.count_if(~F.col("done")).alias("going"))
        )
        ended = open_.where("done").select(
            *key, F.col("pivot").alias("value"), F.col("total").alias("n"),
            F.when(F.col("side") == 0, 0.0).otherwise((F.col("kept") + F.col("at")) / F.col("total")).alias("rank_error"),
        )
        found = ended if found is None else found.unionByName(ended)
        if not seen.get["going"]:
            return found
        gone = F.when(F.col("side") > 0, F.col("below") + F.col("at")).otherwise(0)
        going = in_parts(open_.where("not done").select(*key, "pivot", "side", gone.alias("gone")))
        left = written(
            left.join(going, [*key, "bucket"])
            .where("case when side > 0 then value > pivot else value < pivot end")
            .withColumn("rank", F.col("rank") - F.col("gone")).select(*left.columns)
        )
    raise RuntimeError("the values do not order: are there NaNs?")
