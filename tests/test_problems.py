"""The core problems' queries against SQL, and heavy keys on odd input."""

import pytest

from strandloom.operators.keyed import heavy_keys, keyed_totals, target_totals
from strandloom.plans import core_problems as cp

PAF = "paf_id long, qname string, qlen long, qstart long, qend long, strand string, tname string, tlen long, tstart long, tend long, nmatch long, alnlen long, mapq int, cigar string, run_at timestamp, loaded_at timestamp"


@pytest.mark.parametrize("name", list(cp.QUERIES))
def test_same_as_sql(spark, small, same_as_sql, name):
    same_as_sql(spark, small, cp.QUERIES[name], cp.SQL[name])


def rows(spark, *xs):
    base = dict.fromkeys(c.split()[0] for c in PAF.split(", "))
    return spark.createDataFrame([tuple({**base, **x}.values()) for x in xs], PAF)


def test_records_targets_and_nulls(spark):
    paf = rows(
        spark,
        {"paf_id": 1, "tname": ">t1 len=3", "nmatch": 5, "tstart": 3, "tend": 9},
        {"paf_id": 1, "tname": "t1", "cigar": "3=1X2="},  # a repeated row of which less is there
        {"paf_id": 2, "tname": "t1 ", "cigar": "4=2D1=", "tstart": 20, "tend": 25},
        {"paf_id": 3, "tname": "*", "nmatch": 9},
        {"paf_id": 4, "nmatch": 9},
        {"tname": "t1", "nmatch": 100},
        {"paf_id": 5, "tname": "t2"},
    )
    got = {r.tname: r[1:] for r in target_totals(paf).collect()}
    assert got == {"t1": (2, 10, 3, 25, 22), "t2": (1, None, None, None, None)}
    assert target_totals(rows(spark)).count() == 0


def test_heavy_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 0, 1, 5)] * 97 + [("b", 1, 0, 1, 5)] * 3 + [(None, 1, 0, 1, 5)] * 50, "k string, n long, low long, high long, total long")
    totals = keyed_totals(df, "k", summed="n", low="low", high="high")
    assert {r["key"]: (r["n"], r["total"], r["span"]) for r in totals.collect()} == {"a": (97, 97, 1), "b": (3, 3, 1)}
    assert {r["key"] for r in heavy_keys(totals, "key", "n", 0.03).collect()} == {"a", "b"}
    assert {r["key"] for r in heavy_keys(totals, "key", "n", 0.031).collect()} == {"a"}
