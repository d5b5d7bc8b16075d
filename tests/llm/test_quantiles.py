"""Percentiles: exact ranks, bounded error, combination of states, odd input."""

import math
import random

import pytest

from pyspark.sql import functions as F

from strandloom.llm import quantiles
from strandloom.llm.quantiles import combine_states, day_sketches, day_states, multi_select, spread_values

SCHEMA = "g string, d int, v double"


def brute(rows, shares):
    by = {}
    for g, _, v in rows:
        if g is not None and v is not None:
            by.setdefault(g, []).append(v)
    return {(g, s): sorted(xs)[max(1, math.ceil(round(s * len(xs), 6))) - 1] for g, xs in by.items() for s in shares}


def got(df, shares, **kw):
    return {(r["group"], r.share): r.value for r in multi_select(day_states(df, "g", "v", "d"), shares, **kw).collect()}


def test_random_groups_days_ties_and_extremes(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "a", "b", f"s{r.randrange(20)}"]), r.randrange(6), r.choice([1.0, 2.0, 2.0, -5.5, 1e15, r.random() * 100])) for _ in range(900)]
    shares = [0.05, 0.5, 0.95, 1.0]
    assert got(spark.createDataFrame(rows, SCHEMA), shares) == brute(rows, shares)


def test_nulls_and_one_value(spark):
    rows = [("a", 1, 3.0), ("a", None, 3.0), ("a", 2, None), (None, 1, 2.0), ("b", 1, 7.0)]
    assert got(spark.createDataFrame(rows, SCHEMA), [0.5]) == {("a", 0.5): 3.0, ("b", 0.5): 7.0}
    assert got(spark.createDataFrame([], SCHEMA), [0.5]) == {}


def test_bounded_error(spark):
    rows = [("a", i % 9, float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for r in multi_select(day_states(df, "g", "v", "d"), [0.25, 0.5, 0.9], error=0.05).collect():
        assert r.rank_error <= 0.05
        assert abs((r.value + 1) / 2000 - r.share) <= 0.05


def test_states_of_days_and_of_repeated_runs_combine(spark):
    rows = [("a", d, float(v)) for d in range(3) for v in range(d, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [day_states(df.where(f"d = {d}"), "g", "v", "d") for d in range(3)]
    out = multi_select(combine_states(*parts), [0.5, 0.9])
    assert {(r["group"], r.share): r.value for r in out.collect()} == brute(rows, [0.5, 0.9])


def test_shares_out_of_range(spark):
    with pytest.raises(ValueError):
        multi_select(spark.createDataFrame([], "group string, part int, value double, n long"), [0.0])


def hot_rows():
    return [("hot", 0, float(i * 37 % 5003)) for i in range(5000)] + [(f"g{i % 1000}", 0, float(i % 7 + i // 1000)) for i in range(10_000)]


def test_a_hot_group_is_in_all_partitions_without_broadcasts(spark, monkeypatch):
    df, old = spark.createDataFrame(hot_rows(), SCHEMA), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables, plain = [], quantiles.written
    monkeypatch.setattr(quantiles, "written", lambda out: tables.append(plain(out)) or tables[-1])
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shares = [0.5, 0.95]
        assert got(df, shares) == brute(hot_rows(), shares)
        first = next(t for t in tables if "bucket" in t.columns)
        parts = first.where("group = 'hot' and share = 0.5").repartition(4, "group", "bucket").groupBy(F.spark_partition_id()).count().collect()
        sizes = sorted(r["count"] for r in parts)
        assert len(sizes) == 4 and sizes[-1] < 0.6 * sum(sizes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_hot_groups_are_cut(spark):
    values, hot = spread_values(day_states(spark.createDataFrame(hot_rows(), SCHEMA), "g", "v", "d"))
    assert [r["group"] for r in hot.collect()] == ["hot"]
    assert values.where("group <> 'hot' and bucket > 0").count() == 0
    assert values.where("group = 'hot'").select("bucket").distinct().count() > 8


def test_weights_are_rows(spark):
    """One value with most rows is the median at once, however many others there are."""
    rows = [("a", 0, 5.0)] * 400 + [("a", 0, float(i)) for i in range(100, 200)]
    assert got(spark.createDataFrame(rows, SCHEMA), [0.5, 0.9]) == brute(rows, [0.5, 0.9])


def test_sketches_are_small_and_combine_within_their_error(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b"]), d, r.gauss(d, 5)) for d in range(4) for _ in range(1500)]
    sketches = day_sketches(spark.createDataFrame(rows, SCHEMA), "g", "v", "d", error=0.02)
    assert sketches.groupBy("group", "part").count().agg(F.max("count")).first()[0] <= 101
    assert {r["group"]: r.n for r in sketches.groupBy("group").agg(F.sum("n").alias("n")).collect()} == {g: sum(x[0] == g for x in rows) for g in "ab"}
    for q in multi_select(combine_states(sketches), [0.1, 0.5, 0.95]).collect():
        mine = [v for g, _, v in rows if g == q["group"]]
        assert abs(sum(v <= q.value for v in mine) / len(mine) - q.share) <= 0.02
