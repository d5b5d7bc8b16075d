"""Periods and gaps: against brute force, over partition borders, and odd input."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators import intervals as iv

SCHEMA = "q string, s long, e long"


def brute(rows):
    """Periods and gaps by marking."""
    by = {}
    for q, s, e in rows:
        if None not in (q, s, e) and s < e:
            by.setdefault(q, []).append((s, e))
    periods, gaps = set(), set()
    for q, xs in by.items():
        xs.sort()
        a, b = xs[0]
        for s, e in xs[1:]:
            if s > b:
                periods.add((q, a, b))
                gaps.add((q, b, s))
                a, b = s, e
            b = max(b, e)
        periods.add((q, a, b))
    return periods, gaps


def both(df, **kw):
    p = {(r["entity"], r["start"], r["end"]) for r in iv.periods(df, "q", "s", "e", **kw).collect()}
    g = [(r["entity"], r["gap_start"], r["gap_end"]) for r in iv.gaps(df, "q", "s", "e", **kw).collect()]
    assert len(g) == len(set(g))
    return p, set(g)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_random_against_brute_force(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["a", "b", "hot", "hot", "hot"]), s := r.randrange(3000), s + r.choice([1, 5, 20, 300])) for _ in range(400)]
    assert both(spark.createDataFrame(rows, SCHEMA), parts=parts) == brute(rows)


def test_nulls_reversed_empty_touching_nested(spark):
    rows = [("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 9, 9), ("a", 12, 10), ("a", 20, 30), ("a", 20, 30), (None, 1, 2), ("b", None, 3), ("b", 3, None), ("c", -5, -3), ("c", 2, 3)]
    assert both(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_rows_of_a_period_are_counted(spark):
    rows = [("a", 0, 5), ("a", 0, 5), ("a", 3, 8), ("a", 9, 10)]
    out = iv.periods(spark.createDataFrame(rows, SCHEMA), "q", "s", "e", parts=3)
    assert sorted((r["start"], r["n"]) for r in out.collect()) == [(0, 3), (9, 1)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert both(empty) == (set(), set())
    odd = spark.createDataFrame([("a", 0, 2, 7, "x", 1), ("a", 4, 6, 8, "y", 2)], "q string, s long, e long, part int, entity string, tie int")
    assert both(odd) == ({("a", 0, 2), ("a", 4, 6)}, {("a", 2, 4)})


def test_one_interval_repeated_spreads_over_partitions(spark):
    df = spark.range(4000).selectExpr("'x' as q", "0L as s", "9L as e")
    frag = iv.island_fragments(df, "q", "s", "e", parts=4).collect()
    assert len(frag) > 1 and sum(f.n for f in frag) == 4000
    assert both(df, parts=4) == ({("x", 0, 9)}, set())


def test_summaries_are_associative():
    a = iv.Summary("x", iv.State("x", 10, 50))
    assert a.after(iv.State("x", 0, 60)) == iv.State("x", 0, 60)
    assert a.after(iv.State("x", 0, 9)) == iv.State("x", 10, 50)
    assert a.after(iv.State("w", 0, 99)) == iv.State("x", 10, 50)
    assert iv.combine([(0, a), (1, iv.Summary("x", iv.State("y", 5, 6))), (2, iv.Summary("y", iv.State("y", 7, 9)))]) == {1: iv.State("x", 10, 50), 2: iv.State("y", 5, 6)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-(2**62), 2**62)), min_size=1, max_size=30), st.none() | st.integers(-(2**61), 2**61))
def test_running_end_for_any_numbers(rows, floor):
    rows.sort(key=lambda r: r[0])
    codes = {g: k for k, g in enumerate(dict.fromkeys(g for g, _ in rows))}
    group, end = np.array([codes[g] for g, _ in rows]), np.array([e for _, e in rows])
    best, want = {0: floor} if floor is not None else {}, []
    for g, e in zip(group.tolist(), end.tolist(), strict=True):
        best[g] = max(best.get(g, e), e)
        want.append(best[g])
    assert iv.running_end(group, end, floor).tolist() == want
