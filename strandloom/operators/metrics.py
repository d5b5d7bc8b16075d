"""Measures of assemblies and phasings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.prefix import previous, running_sum
from strandloom.session import written


def _by_length(df: DataFrame, group: str | None, length: str) -> DataFrame:
    """``grp, l, c, upto, before, total``: distinct lengths in falling order with running sums.

    Lengths are folded first; the sums over distinct ones are taken in two levels.
    """
    grp = F.col(group) if group else F.lit("all")
    counts = written(df.where(F.col(length).isNotNull()).groupBy(grp.alias("grp"), F.col(length).cast("long").alias("l")).agg(F.count(F.lit(1)).alias("c")))
    x = counts.withColumn("down", -F.col("l")).withColumn("bases", F.col("l") * F.col("c"))
    x = running_sum(running_sum(x, "grp", "down", "bases", out="upto"), "grp", "down", "c", out="n_upto")
    totals = counts.groupBy("grp").agg(F.sum(F.col("l") * F.col("c")).alias("total"))
    return x.join(totals, "grp").select("grp", "l", "c", "upto", "n_upto", "total")


def nx_stats(df: DataFrame, length: str, group: str | None = None, shares: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """``grp, n10, l10, ..., total, count, longest, shortest``: Nx is the length at which the longest sequences reach x per cent, Lx how many those are."""
    x = _by_length(df, group, length)
    aggs = []
    for s in shares:
        reached = F.col("upto") * 100 >= F.col("total") * s
        aggs.append(F.max(F.when(reached, F.col("l"))).alias(f"n{s}"))
        # within the length that reaches the share, only as many as are needed
        before = F.col("upto") - F.col("l") * F.col("c")
        need = F.ceil((F.col("total") * s / F.lit(100.0) - before) / F.col("l"))
        aggs.append(F.min(F.when(reached, F.col("n_upto") - F.col("c") + F.greatest(need, F.lit(1)))).cast("long").alias(f"l{s}"))
    return x.where("l > 0").groupBy("grp").agg(*aggs, F.max("total").alias("total"), F.sum("c").alias("n"), F.max("l").alias("longest"), F.min("l").alias("shortest"))


def ng50(df: DataFrame, length: str, genome_size: int | Column, group: str | None = None) -> DataFrame:
    """``grp, ng50``: the length at which the longest sequences reach half the genome; null if they don't."""
    size = F.lit(genome_size) if isinstance(genome_size, int) else genome_size
    return _by_length(df, group, length).groupBy("grp").agg(F.max(F.when(F.col("upto") * 2 >= size, F.col("l"))).alias("ng50"))


def hamming_error(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """``group, error``: per cent of markers that are on the smaller side of their contig; null without markers."""
    small, large = F.sum(F.least(a, b)), F.sum(F.greatest(a, b))
    return df.groupBy(group).agg((100 * small / F.nullif(small + large, F.lit(0))).alias("error"))


def phase_error(df: DataFrame, group: str, votes: str) -> DataFrame:
    """``n_groups, agreeing, errors``: each group follows the majority of its votes (0/1); the minority are errors. Null votes don't count."""
    per = df.where(F.col(votes).isNotNull()).groupBy(group).agg(F.count_if(F.col(votes) == 0).alias("z"), F.count_if(F.col(votes) == 1).alias("o"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.greatest("z", "o")), F.lit(0)).alias("agreeing"), F.coalesce(F.sum(F.least("z", "o")), F.lit(0)).alias("errors"))


def run_histogram(runs: DataFrame, length: str = "len", width: int = 1000, most: int = 500) -> DataFrame:
    """``bin, n``: runs by length, the first ``most`` bins."""
    return runs.groupBy(F.floor(F.col(length) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where(F.col("bin") < most)


def site_consistency(df: DataFrame, read: str, pos: str, allele: str) -> DataFrame:
    """``pos, n, inconsistent``: at each site, how many reads pass from the site before, and for how many the allele changes."""
    x = previous(df.where(F.col(allele).isNotNull()).select(read, pos, F.col(allele).alias("a")), read, pos, "a", out="b").where("b is not null")
    return x.groupBy(pos).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("inconsistent"))


def breakpoints(consistency: DataFrame, least: int = 10, share: float = 0.75) -> DataFrame:
    """Sites with ``least`` reads or more of which at least ``share`` (rounded up) are inconsistent."""
    return consistency.where((F.col("n") >= least) & (F.col("inconsistent") >= F.ceil(F.col("n") * share)))


def phase_eval(phasing: DataFrame, counts: DataFrame, *, extra: int = 0) -> DataFrame:
    """``hap, correct, incorrect, error``: each haplotype's groups follow the majority of their segments, the minority are errors.

    ``phasing``: grp, hap0, hap1; ``counts``: segment, n1, n2 (markers of either
    parent). Segments and groups of equal counts, and segments without any, don't
    count. ``error`` is in per cent of the sum and ``extra``; null if that is 0.
    """
    each = phasing.select("grp", F.explode(F.array(*[F.struct(F.lit(h).alias("hap"), F.col(f"hap{h}").alias("segment")) for h in (0, 1)])).alias("x")).select("grp", "x.hap", "x.segment")
    per = each.join(counts, "segment").groupBy("hap", "grp").agg(F.count_if(F.col("n1") > F.col("n2")).alias("p"), F.count_if(F.col("n1") < F.col("n2")).alias("m"))
    sums = per.where("p != m").groupBy("hap").agg(F.sum(F.greatest("p", "m")).alias("correct"), F.sum(F.least("p", "m")).alias("incorrect"))
    return sums.withColumn("error", 100 * F.col("incorrect") / F.nullif(F.col("correct") + F.col("incorrect") + extra, F.lit(0)))
