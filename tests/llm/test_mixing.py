"""Mixing: shares, repeats, positions, odd input."""

import math

import pytest

from strandloom.llm import mixing
from strandloom.llm.mixing import Schedule, clean_source, mix
from strandloom.llm.tokens import VOCABULARY, encoding

DOCS, TARGETS = "doc_id long, text string, source string", "source string, target_share double, max_repeat int"


@pytest.fixture(scope="module", autouse=True)
def vocabulary():
    pytest.importorskip("public_tokenizers")


def corpus(spark):
    rows = [(i, "the quick brown fox jumps over it " * 5, "Big Web") for i in range(300)]
    rows += [(1000 + i, "le petit chat noir dort encore " * 5, "small-set ") for i in range(40)]
    rows += [(2000 + i, "un deux trois quatre cinq six " * 5, "tiny") for i in range(5)]
    rows += [(3000, "text without a source here", None), (3001, None, "tiny"), (3002, "", "tiny"), (None, "no id", "tiny"), (3003, "other", "untargeted")]
    return spark.createDataFrame(rows, DOCS)


TARGET_ROWS = [("big_web", 0.6, 1), ("small_set", 0.25, 4), ("tiny", 0.1, 2), ("absent", 0.05, 3)]


def test_shares_repeats_and_short_sources(spark):
    out = mix(corpus(spark), spark.createDataFrame(TARGET_ROWS, TARGETS))
    report = {r.source: r for r in out.report.collect()}
    enc = encoding(VOCABULARY, None)
    count = lambda t: len(enc.encode_ordinary(t)) if t else 0
    all_rows = corpus(spark).collect()
    whole = sum(count(r.text) for r in all_rows)
    for r in report.values():
        assert math.isclose(r.demand, r.target_share * whole)
        largest = 100
        assert r.placed == r.supply if r.short else r.demand <= r.placed < r.demand + largest
    assert {s for s, r in report.items() if r.short} == {"tiny", "absent"}
    assert report["absent"].placed == 0 and report["tiny"].copies == 10
    order = out.order.collect()
    assert all(0 <= r.position <= 1 for r in order) and sum(r.tokens for r in order) == sum(r.placed for r in report.values())
    assert [r.position for r in order] == sorted(r.position for r in order), "range-sorted"
    copies = {}
    for r in order:
        copies.setdefault((r["doc"], r.source), set()).add(r["copy"])
    assert all(c == set(range(len(c))) for c in copies.values())
    assert max(len(c) for (_, s), c in copies.items() if s == "small_set") <= 4


def test_same_order_whatever_the_buckets(spark, monkeypatch):
    key = lambda m: sorted((r["doc"], r["copy"], round(r.position, 9)) for r in m.order.collect())
    one = key(mix(corpus(spark), spark.createDataFrame(TARGET_ROWS, TARGETS)))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert key(mix(corpus(spark), spark.createDataFrame(TARGET_ROWS, TARGETS))) == one


@pytest.mark.parametrize("weights", [(1.0,), (0.5, 1.5), (2.0, 0.0), (0.0, 1.0, 4.0, 0.5)])
def test_positions_follow_the_integral_of_the_schedule(spark, weights):
    out = mix(corpus(spark), spark.createDataFrame([("big_web", 1.0, 1)], TARGETS), schedules={"big_web": Schedule(weights)}, budget=10_000)
    rows = out.order.orderBy("position").collect()
    seg = Schedule(weights).segments()
    at = 0
    for r in rows:
        u = at / 10_000
        lo, _, t, w, slope = next(s for s in reversed(seg) if s[0] <= u)
        x = r.position - t
        assert math.isclose(w * x + slope * x * x / 2, u - lo, abs_tol=1e-9)
        at += r.tokens


def test_empty_tables_and_bad_targets(spark):
    empty = spark.createDataFrame([], DOCS)
    out = mix(empty, spark.createDataFrame(TARGET_ROWS, TARGETS))
    assert out.order.count() == 0 and {r.placed for r in out.report.collect()} == {0}
    assert mix(corpus(spark), spark.createDataFrame([], TARGETS)).report.count() == 0
    with pytest.raises(ValueError):
        mix(corpus(spark), spark.createDataFrame([("tiny", 0.5, 1), ("tiny", 0.5, 1)], TARGETS))
    with pytest.raises(ValueError):
        Schedule((1.0, -1.0)).segments()


def test_repeated_rows_ties_clashing_columns_and_long_text(spark):
    rows = [(1, "a b c", "s", 1, 2)] * 4 + [(2, "word " * 200_000, "s", 3, 4)]
    df = spark.createDataFrame(rows, DOCS + ", tokens int, bucket int")
    out = mix(df, spark.createDataFrame([("s", 1.0, 1)], TARGETS))
    assert out.order.count() == 5 and out.report.first().share == 1.0


def test_sources_in_other_spellings(spark):
    df = spark.createDataFrame([(" Web-Crawl ",), ("web crawl",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(clean_source("s")).collect()] == ["web_crawl", "web_crawl", None, None]


def test_short_comes_from_what_is_placed(spark, monkeypatch):
    """A curriculum that places only first copies leaves sources short that repeats would fill."""
    targets = spark.createDataFrame(TARGET_ROWS, TARGETS)
    plain = mixing._at
    monkeypatch.setattr(mixing, "_at", lambda rows, u, *a: plain(rows.where("copy = 0") if u == "u" else rows, u, *a))
    assert {r.source for r in mix(corpus(spark), targets).report.where("short").collect()} == {"small_set", "tiny", "absent"}


def test_until_is_where_a_source_runs_out(spark):
    df = spark.createDataFrame([(i, "a b c d", "s") for i in range(10)], DOCS)
    n = len(encoding(VOCABULARY, None).encode_ordinary("a b c d")) * 10
    flat = mix(df, spark.createDataFrame([("s", 1.0, 1)], TARGETS), budget=2 * n, schedules={"s": Schedule()}).report.first()
    assert flat.short and math.isclose(flat.until, 0.5)
    late = mix(df, spark.createDataFrame([("s", 1.0, 1)], TARGETS), budget=2 * n, schedules={"s": Schedule((0.0, 2.0))}).report.first()
    assert late.short and math.isclose(late.until, 0.5**0.5)
    full = mix(df, spark.createDataFrame([("s", 1.0, 1)], TARGETS), budget=n).report.first()
    assert not full.short and math.isclose(full.until, 1.0)


def test_many_sources(spark):
    df = spark.range(3000).selectExpr("id doc_id", "'word and word' text", "concat('s', id % 1500) source")
    targets = df.select("source").distinct().selectExpr("source", "1D / 1500 target_share", "1 max_repeat")
    report = mix(df, targets).report
    assert report.count() == 1500 and report.where("short").count() == 0
