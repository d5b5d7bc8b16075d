"""Top items per group: against sorting, ties, hot groups, odd input."""

import random

import pytest

from strandloom.llm import topn
from strandloom.llm.topn import top_n

SCHEMA = "g string, i long, s long"


def brute(rows, n):
    by = {}
    for g, i, s in rows:
        if None not in (g, i, s):
            by.setdefault(g, []).append((-s, i))
    return sorted((g, i, -s, k + 1) for g, xs in by.items() for k, (s, i) in enumerate(sorted(xs)[:n]))


def got(df, n, **kw):
    return sorted(tuple(r) for r in top_n(df, "g", "i", "s", n, **kw).select("group", "item", "score", "place").collect())


@pytest.mark.parametrize("bands", [(0.9,), (0.98, 0.85, 0.5), (0.5, 0.5), ()])
def test_random_with_ties_and_a_hot_group(spark, bands):
    r = random.Random(7)
    rows = [(r.choice(["hot"] * 9 + [f"g{r.randrange(60)}"]), i, r.choice([1, 2, 2, 3, r.randrange(1000)])) for i in range(1200)]
    assert got(spark.createDataFrame(rows, SCHEMA), 4, bands=bands) == brute(rows, 4)


def test_nulls_repeats_few_items_negative_scores(spark):
    rows = [("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("b", 1, -7), (None, 1, 9), ("c", None, 9), ("c", 3, None)]
    assert got(spark.createDataFrame(rows, SCHEMA), 2) == brute(rows, 2)


def test_empty_clashing_columns_and_text_items(spark):
    assert got(spark.createDataFrame([], SCHEMA), 3) == []
    odd = spark.createDataFrame([("x", "b", 1.5, 1, 2), ("x", "a", 1.5, 3, 4)], "g string, i string, s double, band int, place int")
    assert got(odd, 1) == [("x", "a", 1.5, 1)]


@pytest.mark.parametrize("broadcast_groups", [0, 1000])
def test_same_rows_whether_filled_groups_are_broadcast(spark, broadcast_groups):
    rows = [(f"g{i % 40}", i, (i * 7919) % 500) for i in range(2000)]
    assert got(spark.createDataFrame(rows, SCHEMA), 3, broadcast_groups=broadcast_groups) == brute(rows, 3)


def test_filled_groups_are_gone_before_a_band_is_ranked(spark, monkeypatch):
    """Every group is filled by the top band: of the bands below no row may reach a ranking, and without them nothing changes."""
    rows = [(f"g{i % 20}", i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    read, plain = [], topn.written

    def spy(out, *by):
        made = plain(out, *by)
        if not by:
            read.append(made.count())
        return made

    monkeypatch.setattr(topn, "written", spy)
    assert got(df, 3, bands=(0.9, 0.5)) == brute(rows, 3)
    assert read == [60, 0], "the second band gives nothing"


def test_bands_decide_what_is_ranked(spark, monkeypatch):
    """With the bands the wrong way round, lower scores fill the groups first: the rows come through the bands."""
    rows = [(f"g{i % 20}", i, i) for i in range(2000)]
    plain = topn.banded

    def swapped(*a):
        out, count = plain(*a)
        return out.withColumn("band", count - 1 - out.band), count

    monkeypatch.setattr(topn, "banded", swapped)
    assert got(spark.createDataFrame(rows, SCHEMA), 3, bands=(0.9, 0.5)) != brute(rows, 3)
