"""Haplotypes cut alike and merged: against brute force and worked examples."""

import random

from pyspark.sql import functions as F

from strandloom.operators import dual

PAF = "paf_id long, qname string, qlen long, qstart long, qend long, strand string, tname string, tlen long, tstart long, tend long, cigar string"


def test_cuts_on_both_strands(spark):
    rows = [
        (1, "q", 100, 10, 70, "+", "t", 500, 200, 260, "20X20=20X"),
        (2, "q", 100, 10, 70, "-", "t", 500, 200, 265, "20X20=5D20X"),
        (3, "q", 100, 0, 60, "+", "t", 500, 0, 60, "5X20=35X"),  # too little before the run
        (4, "q", 20, 0, 20, "+", "t", 500, 0, 20, "20="),
        (5, "q", 100, 0, 60, "+", "t", 500, 0, 60, None),
    ]
    got = [tuple(r) for r in dual.cut_at_equal_runs(spark.createDataFrame(rows, PAF), 10).select("paf_id", "piece", "qstart", "qend", "tstart", "tend").orderBy("paf_id", "piece").collect()]
    assert got == [(1, 0, 10, 30, 200, 220), (1, 1, 50, 70, 240, 260), (2, 0, 50, 70, 200, 220), (2, 1, 10, 30, 240, 265)]
    assert dual.cut_at_equal_runs(spark.createDataFrame([], PAF), 10).count() == 0


def test_first_matches_are_the_greedy_ones(spark):
    r = random.Random(3)
    rows = list({(f"a{r.randrange(12)}", f"b{r.randrange(12)}") for _ in range(60)})
    rows = [(a, b, at) for at, (a, b) in enumerate(rows)]
    used, want = set(), []
    for a, b, at in rows:
        if a not in used and b not in used:
            want.append(at)
            used |= {a, b}
    df = spark.createDataFrame(rows, "a string, b string, at long")
    assert sorted(x["at"] for x in dual.first_matches(df).collect()) == want
    assert dual.first_matches(df.limit(0)).count() == 0


def test_contained_on_either_side_goes(spark):
    r = random.Random(5)
    rows = [(f"c{r.randrange(2)}", a := r.randrange(20), a + r.randrange(1, 9), f"d{r.randrange(2)}", b := r.randrange(20), b + r.randrange(1, 9), "+", at) for at in range(40)]
    rows += [(*rows[0][:7], 99)]

    def inside(x, y, k):  # x in y on side k
        return x[k] == y[k] and y[k + 1] <= x[k + 1] and x[k + 2] <= y[k + 2] and (y[k + 1 : k + 3] != x[k + 1 : k + 3] or y[-1] < x[-1])

    want = sorted(x[-1] for x in rows if not any(inside(x, y, k) for y in rows for k in (0, 3) if y is not x))
    df = spark.createDataFrame(rows, "c1 string, s1 long, e1 long, c2 string, s2 long, e2 long, strand string, at long")
    assert sorted(x["at"] for x in dual.free_on_both_sides(df).collect()) == want and len(want) < 41


def test_segments_that_touch_become_one_region(spark):
    rows = [
        ("h:0-10", "+", 0, 10, "t", 0), ("h:10-30", "+", 0, 20, "t", 10), ("h:30-35", "+", 0, 5, "t", 40), ("h:50-60", "+", 0, 10, "t", 60),
        ("g:20-40", "-", 0, 20, "u", 0), ("g:0-20", "-", 0, 20, "u", 20), ("g:0-20", "+", 0, 30, "v", 0), (None, "+", 0, 5, "t", 1),
    ]
    hits = spark.createDataFrame(rows, "segment string, strand string, qstart long, qend long, tname string, tstart long")
    got = {tuple(r) for r in dual.merged_regions(hits).collect()}
    assert got == {("h:0-10", "h:0-35"), ("h:10-30", "h:0-35"), ("h:30-35", "h:0-35"), ("g:20-40", "g:0-40"), ("g:0-20", "g:0-20")}
    assert dual.merged_regions(hits.limit(0)).count() == 0


def test_long_chains_merge_in_few_rounds(spark):
    n = 300
    hits = spark.range(n).select(F.format_string("h:%d-%d", F.col("id") * 5, F.col("id") * 5 + 5).alias("segment"), F.lit("+").alias("strand"), F.lit(0).alias("qstart"), F.lit(5).alias("qend"), F.lit("t").alias("tname"), (F.col("id") * 5).alias("tstart"))
    scored = dual.merged_regions(hits.limit(20))
    assert {r.merged for r in scored.collect()} == {"h:0-100"}


def test_pairs_of_merged_regions(spark):
    pairs = spark.createDataFrame([("p:0-10", "h:0-10", "+", 0), ("p:10-30", "h:10-30", "+", 1), ("p:100-120", "h:100-120", "-", 2)], "a string, b string, strand string, at long")
    kind = "segment string, strand string, qstart long, qend long, tname string, tstart long"
    one = spark.createDataFrame([("p:0-10", "+", 0, 10, "t", 0), ("p:10-30", "+", 0, 20, "t", 10), ("p:100-120", "+", 0, 20, "u", 0)], kind)
    two = spark.createDataFrame([("h:0-10", "+", 0, 10, "t", 0), ("h:10-30", "+", 0, 20, "t", 10), ("h:100-120", "+", 0, 20, "u", 0)], kind)
    assert {tuple(r) for r in dual.merge_pairs(pairs, one, two).collect()} == {("p:0-30", "h:0-30", "+"), ("p:100-120", "h:100-120", "-")}


def test_both_haplotypes_are_cut_whole(spark):
    pieces = spark.createDataFrame([("t", 10, 20, "q", 0, 5), ("t", 15, 30, "q", 8, 9)], "tname string, tstart long, tend long, qname string, qstart long, qend long")
    first, second = (spark.createDataFrame(x, "name string, length long") for x in ([("t", 40), ("z", 7)], [("q", 9)]))
    got = {tuple(r) for r in dual.cut_both(pieces, first, second).where("kind = 'collapsed'").select("hap", "contig", "start", "end").collect()}
    assert got == {(1, "t", 0, 10), (1, "t", 30, 40), (1, "z", 0, 7), (2, "q", 5, 8)}
