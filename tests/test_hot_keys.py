"""One key with a third of all rows or more: same results, and no task or row holds it all where that is promised."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import assembly, contacts, kernels, metrics, prefix, runs


def hot(spark, n=900):
    """``k, i``: every other row is of one key."""
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 30).cast("string"))).alias("k"), F.col("id").alias("i"))


def test_kernels_join_the_batches_of_a_key(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        one = lambda g: {"k": g["k"][:1], "n": np.array([len(g["i"])]), "total": np.array([g["i"].sum()])}
        got = {tuple(r) for r in kernels.by_key(hot(spark), "k", ["i"], one, "k string, n long, total long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {tuple(r) for r in hot(spark).groupBy("k").agg(F.count(F.lit(1)), F.sum("i")).collect()}


def test_numbers_within_keys(spark):
    got = prefix.number_within(hot(spark), "k", ["i"], out="n").collect()
    for key in {r.k for r in got}:
        mine = sorted((r.i, r.n) for r in got if r.k == key)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert prefix.number_within(hot(spark, 0), "k", ["i"]).count() == 0


def test_parts_stay_rows(spark):
    df = hot(spark, 200).withColumn("s", F.expr("repeat('A', cast(i % 5 as int))")).withColumn("g", (F.col("i") % 3).cast("int"))
    parts = assembly.ordered_parts(df, "k", "i", "s", gap="g").collect()
    whole = {r.k: r.seq for r in assembly.ordered_concat(df, "k", "i", "s", gap="g").collect()}
    assert len(parts) == 200
    for key, seq in whole.items():
        mine = sorted((r for r in parts if r.k == key), key=lambda r: r.place)
        assert "".join(r.seq + "N" * r.gap for r in mine) == seq and all(seq[r.offset :].startswith(r.seq) for r in mine)


def test_a_sequence_moves_once_whatever_its_segments(spark):
    segs = spark.range(300).selectExpr("'dual' kind", "'c' contig", "id * 3 start", "id * 3 + 5 end", "if(id % 2 = 0, '+', '-') strand")
    seqs = spark.createDataFrame([("c", "ACGTTGCA" * 200), ("d", "A")], "name string, seq string")
    got = {r.segment: r.seq for r in assembly.cut(segs, seqs).collect()}
    assert len(got) == 300 and got["c:0-5"] == "ACGTT" and got["c:3-8"] == "TGCAA"


@pytest.mark.parametrize("targets", [40, 1100])
def test_reads_of_many_targets(spark, targets):
    df = spark.range(targets * 2).selectExpr("if(id % 2 = 0, 'wide', concat('r', id div 4)) r", "id div 2 t")
    got = {(r.t1, r.t2): r.n for r in contacts.multi_contacts(df, "r", "t").collect()}
    assert len(got) == targets * (targets - 1) and got[0, 1] == 2 and got[0, targets - 1] == 1


def test_ranks_and_lengths_of_one_group(spark):
    df = hot(spark).withColumn("len", F.col("i") % 97 + 1)
    lens = sorted((r.len for r in df.collect()), reverse=True)
    out = metrics.nx_stats(df, "len").first()
    half, total = 0, sum(lens)
    for k, x in enumerate(lens):
        half += x
        if 2 * half >= total:
            break
    assert (out.n50, out.l50, out.total, out.n) == (x, k + 1, total, 900)
    assert runs.position_of_rank(df, None, "len", 0.5).first()["len"] == sorted(lens)[449]
    assert runs.position_of_rank(df.where("k = 'none'"), None, "len", 0.5).count() == 0
