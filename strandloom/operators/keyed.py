"""Results per key where a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.records import paf_records


def keyed_totals(df: DataFrame, key: str, *, summed: str, low: str, high: str) -> DataFrame:
    """``key, n, total, low, high, span`` for every key that is not null.

    Only algebraic aggregates: each task folds its rows into a bounded hash table
    (Spark sorts and spills it when memory ends) and ships one partial state per
    key it saw. A key with a third of the rows costs the shuffle one row per task.
    Nulls in the other columns count as absent; a key without any has nulls.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(summed).alias("total"),
            F.min(low).alias("low"), F.max(high).alias("high"),
        )
        .withColumn("span", F.col("high") - F.col("low"))
    )


def target_totals(paf: DataFrame) -> DataFrame:
    """``tname, n_records, sum_match, span_start, span_end, span`` of each target, over distinct records."""
    out = keyed_totals(paf_records(paf), "tname", summed="match", low="tstart", high="tend")
    return out.select(
        F.col("key").alias("tname"), F.col("n").alias("n_records"), F.col("total").alias("sum_match"),
        F.col("low").alias("span_start"), F.col("high").alias("span_end"), "span",
    )


def heavy_keys(totals: DataFrame, key: str, count: str, share: float) -> DataFrame:
    """The keys with at least ``share`` of all that ``totals`` counts (one row per key)."""
    whole = totals.agg(F.sum(count)).scalar()
    return totals.where(F.col(count) >= F.lit(share) * whole).select(key)
