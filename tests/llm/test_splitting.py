"""Pieces: limits, overlaps, natural boundaries, odd input."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import splitting
from strandloom.llm.splitting import pieces_of, split_units

UNITS = "unit_id long, head string, sub_head string, seq string, quality string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 260), min_size=1, max_size=25), st.lists(st.integers(10, 150), min_size=24, max_size=24), st.integers(0, 30))
def test_pieces_fit_follow_and_cover(stretches, runs, overlap):
    size, runs = 100, runs[: len(stretches) - 1]
    total = sum(stretches) + sum(runs)
    out = pieces_of(stretches, runs, size, overlap)
    assert (not out) == (total == 0)
    if not out:
        return
    assert out[0][1] == 0 and out[-1][2] == total and [p[0] for p in out] == list(range(len(out)))
    for p, q in zip(out, out[1:]):
        assert p[2] - q[1] == min(overlap, p[2]), "the overlap"
    assert all(0 < b - a <= size for _, a, b, _ in out)
    # a stretch that fits a piece is never cut: it lies in one piece whole
    at = 0
    for k, s in enumerate(stretches):
        if 0 < s <= size:
            assert any(a <= at and at + s <= b for _, a, b, _ in out), (at, s, out)
        at += s + (runs[k] if k < len(runs) else 0)
    if all(s <= size for s in stretches):
        assert all(c != "hard" for *_, c in out)


def test_weakest_boundaries_are_merged_first():
    out = pieces_of([30, 30, 30], [10, 20], 100, 0)
    assert [(a, b, c) for _, a, b, c in out] == [(0, 90, "gap"), (90, 120, "end")]
    out = pieces_of([30, 30, 30], [20, 10], 100, 0)
    assert [(a, b, c) for _, a, b, c in out] == [(0, 50, "gap"), (50, 120, "end")]


def test_records_pieces_and_kinds(spark):
    r = random.Random(3)
    dna = lambda n: "".join(r.choice("ACGTacgt") for _ in range(n))
    short, gap, hard = dna(90), dna(60) + "N" * 12 + dna(80), dna(50) + "n" * 15 + dna(250)
    wrapped = "\n".join(re.findall(".{1,17}", gap)) + " \r\n"
    rows = [
        (1, "c1", None, short, None), (2, ">c2 len=1", None, gap, None), (2, "c2", None, wrapped, None), (3, "c3 ", None, hard, None),
        (4, "c4", None, None, None), (5, "c5", None, "", None), (6, None, None, gap, None), (None, "c7", None, hard, None),
    ]
    out = split_units(spark.createDataFrame(rows, UNITS), size=100, overlap=5).orderBy("unit_id", "piece").collect()
    assert {(x.head, x.cut_kind) for x in out} == {("c2", "gap"), ("c3", "hard"), (None, "gap")}
    for unit, seq in ((2, gap), (3, hard), (6, gap)):
        mine = [x for x in out if x.unit_id == unit]
        assert [x.piece for x in mine] == list(range(len(mine)))
        assert all(x.text == seq[x.start : x.end] and len(x.text) <= 100 for x in mine)
        assert mine[0].text + "".join(x.text[5:] for x in mine[1:]) == seq
    assert {x.cut for x in out if x.unit_id == 2} == {"gap", "end"}


def test_run_below_ten_is_no_boundary_and_long_runs(spark):
    seq = "A" * 60 + "N" * 9 + "A" * 60
    all_n = "N" * 350
    out = split_units(spark.createDataFrame([(1, "a", None, seq, None), (2, "b", None, all_n, None)], UNITS), size=100, overlap=10)
    assert {(x.head, x.cut_kind) for x in out.collect()} == {("a", "hard"), ("b", "gap")}


def test_very_long_empty_and_extra_columns(spark):
    long = ("ACGT" * 900 + "N" * 20) * 300  # about a million bases
    df = spark.createDataFrame([(1, "x", None, long, None, "p", 0)], UNITS + ", piece string, pieces int")
    out = split_units(df).select("start", "end").orderBy("start").collect()
    assert out[0].start == 0 and out[-1].end == len(long) and max(x.end - x.start for x in out) <= 4000
    assert split_units(spark.createDataFrame([], UNITS)).count() == 0
    with pytest.raises(ValueError):
        split_units(df, size=100, overlap=50)


def test_kind_comes_from_the_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", "ACGT" * 30), (2, "b", ("A" * 40 + "N" * 12) * 3)], "unit_id long, head string, seq string")
    kinds = lambda: {x.unit_id: x.cut_kind for x in splitting.split_units(df, size=100, overlap=5).collect()}
    assert kinds() == {1: "hard", 2: "gap"}
    monkeypatch.setattr(splitting, "_planner", lambda *_: lambda *_: F.array().cast(splitting.PIECES))
    assert kinds() == {1: None, 2: None}


def test_the_plan_decides_the_kind(spark, small, monkeypatch):
    """Without planned pieces there is no kind, and with other pieces another one."""
    from strandloom.llm import algorithm_queries, splitting

    want = {tuple(r) for r in algorithm_queries.p4_found(spark, small).collect()}
    assert {k for _, k in want} == {"gap", "hard"}

    def stub(*cuts):
        def planner(size, overlap):
            from pyspark.sql import functions as F

            return lambda *_: F.array(*[F.struct(F.lit(k).alias("piece"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit(c).alias("cut")) for k, c in enumerate(cuts)]).cast(splitting.PIECES)

        return planner

    monkeypatch.setattr(splitting, "_planner", stub())
    assert {k for _, k in algorithm_queries.p4_found(spark, small).collect()} == {None}
    monkeypatch.setattr(splitting, "_planner", stub("gap", "end"))
    assert {k for _, k in algorithm_queries.p4_found(spark, small).collect()} == {"gap"}
