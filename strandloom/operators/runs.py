"""Runs of equal or qualifying values, and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.prefix import previous, running_sum
from strandloom.session import written


def _numbered(df: DataFrame, key: str, order: str, fresh: Column, out: str) -> DataFrame:
    """``df`` with ``out``: how many rows of the key up to this one are ``fresh``."""
    return running_sum(df.withColumn("_fresh", fresh.cast("long")), key, order, "_fresh", out=out).drop("_fresh")


def islands(df: DataFrame, key: str, order: str, value: str, *, reach: str | None = None) -> DataFrame:
    """``key, value, start, end, n``: stretches of rows with an equal value; nulls equal each other.

    With ``reach``, ``end`` is the largest of that column instead of the last ``order``.

    ``order`` is a whole number, one row each. A row opens an island if its value
    differs from the one before; islands are numbered by a two-level running count.
    """
    x = previous(df.select(key, order, value, F.col(reach or order).alias("_reach"), F.lit(1).alias("_one")).withColumn("_pair", F.struct(value, "_one")), key, order, "_pair", out="_before")
    x = _numbered(x, key, order, F.col("_before").isNull() | ~F.col("_before")[value].eqNullSafe(F.col(value)), "_g")
    return x.groupBy(key, "_g").agg(F.first(value).alias(value), F.min(order).alias("start"), F.max("_reach").alias("end"), F.count(F.lit(1)).alias("n")).drop("_g")


def long_islands(runs: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """``key, value, start, end, n``: islands of fewer than ``least`` rows join the one before, then equal neighbours merge.

    The first island of a key stays. ``runs`` is what :func:`islands` gives.
    """
    x = previous(runs.withColumn("_one", F.lit(1)), key, "start", "_one", out="_before")
    x = _numbered(x, key, "start", (F.col("n") >= least) | F.col("_before").isNull(), "_g")
    kept = x.groupBy(key, "_g").agg(F.min_by(value, "start").alias(value), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    y = previous(kept.withColumn("_pair", F.struct(value, F.lit(1).alias("_one"))), key, "start", "_pair", out="_before")
    y = _numbered(y, key, "start", F.col("_before").isNull() | ~F.col("_before")[value].eqNullSafe(F.col(value)), "_h")
    return y.groupBy(key, "_h").agg(F.first(value).alias(value), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_h")


def moving_average(df: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """``key, order, average`` over ``width`` rows up to this one; the first ``width - 1`` rows of a key have none.

    The difference of two running sums, ``width`` rows apart; ``order`` is a whole
    number, one row each, and ``value`` has no nulls.
    """
    x = running_sum(df.select(key, order, value, F.lit(1).cast("long").alias("_one")), key, order, "_one", out="_n")
    x = written(running_sum(x, key, order, value, out="_sum").select(key, order, "_n", "_sum"))
    ago = x.select(key, (F.col("_n") + width).alias("_n"), F.col("_sum").alias("_ago"))
    return x.where(F.col("_n") >= width).join(ago, [key, "_n"], "left").select(key, order, ((F.col("_sum") - F.coalesce("_ago", F.lit(0))) / width).alias("average"))


def midpoints(df: DataFrame, key: str, pos: str) -> DataFrame:
    """``key, pos, midpoint`` with the position before it, 0 for the first; halves are cut off."""
    x = previous(df.select(key, pos), key, pos, pos, out="_before")
    return x.select(key, pos, ((F.coalesce("_before", F.lit(0)) + F.col(pos)) / 2).cast("long").alias("midpoint"))


def block_identity(placed_runs: DataFrame, contig: str, block: int) -> DataFrame:
    """``contig, block, matched, covered``: bases of ``=`` runs, and of ``=`` and ``X`` runs, per block of a contig.

    ``placed_runs`` has tpos, op, len. Where alignments overlap, each counts.
    """
    cut = placed_runs.where("op in ('=', 'X') and len > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("tpos") / block), F.floor((F.col("tpos") + F.col("len") - 1) / block))))
    inside = F.least(F.col("tpos") + F.col("len"), (F.col("_b") + 1) * block) - F.greatest(F.col("tpos"), F.col("_b") * block)
    return cut.groupBy(contig, F.col("_b").alias("block")).agg(F.sum(F.when(F.col("op") == "=", inside).otherwise(0)).alias("matched"), F.sum(inside).alias("covered"))


def pivoted_sites(df: DataFrame, row: str, column: str, value: str | Column, columns: list) -> DataFrame:
    """A row per ``row`` and a column per entry of ``columns`` with its first value; entries are given, so nothing is collected."""
    return df.groupBy(row).pivot(column, columns).agg(F.min(value))


def position_of_rank(df: DataFrame, key: str | None, value: str, share: float, *, least: int = 0) -> DataFrame:
    """``key, value, n``: the value at place ``int(share * n) - 1`` (counted from 0) of the sorted values of at least ``least``.

    A share above 1 is in per cent. Only counts per distinct value are ordered, and summed in two levels.
    """
    p = share / 100 if share > 1 else share
    k = F.col(key) if key else F.lit(0)
    counts = written(df.where(F.col(value) >= least).groupBy(k.alias("_k"), value).agg(F.count(F.lit(1)).alias("_c")))
    totals = counts.groupBy("_k").agg(F.sum("_c").alias("n"))
    ranked = running_sum(counts, "_k", value, "_c", out="_upto").join(totals, "_k")
    reached = ranked.where(F.col("_upto") > F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(p)) - 1))
    out = reached.groupBy("_k").agg(F.min(value).alias(value), F.first("n").alias("n"))
    return out.withColumnRenamed("_k", key) if key else out.drop("_k")


def short_switches(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """``key, pos, kind``: where the value changes; ``short`` if it changes back at the very next row, else ``long``.

    A change that undoes a short one is part of it and not listed.
    """
    x = previous(df.select(key, pos, F.col(value).alias("_v")), key, pos, "_v", out="_before")
    x = x.withColumn("_flip", F.coalesce((F.col("_v") != F.col("_before")).cast("int"), F.lit(0)))
    # in a stretch of rows that each differ from the one before, every other change closes a short one
    numbered = _numbered(x, key, pos, F.col("_flip") == 0, "_g")
    g = Window.partitionBy(key, "_g").orderBy(pos)
    place = numbered.where("_flip = 1").withColumn("_k", F.row_number().over(g)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "_g")))
    return place.where("_k % 2 = 1").select(key, pos, F.when(F.col("_k") < F.col("_n"), "short").otherwise("long").alias("kind"))


def depth_histogram(runs: DataFrame, value: str = "cov") -> DataFrame:
    """``cov, bases``: how many bases have each coverage."""
    return runs.groupBy(F.col(value).alias("cov")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


def switch_error(markers: DataFrame, key: str, start: str, end: str, hap: str, *, short_num: int = 100, short_limit: int = 20_000) -> DataFrame:
    """``switches, markers, error``: markers on the wrong haplotype in short stretches, of all that lie in blocks.

    Markers of a scaffold (``key``) form stretches of one haplotype out of two. A
    stretch of ``short_num`` markers or more, or of at least two over more than
    ``short_limit`` bases, opens a block, as does a scaffold's first one. A shorter
    stretch on the other haplotype than its block's is a short switch, each of its
    markers an error; one that ends the scaffold is no switch, but on its own.
    Blocks of one marker don't count. Null haplotypes are left out; ``start`` is a
    whole number, one marker each.
    """
    x = islands(markers.where(F.col(hap).isNotNull()), key, start, hap, reach=end)
    x = previous(x.withColumn("_one", F.lit(1)), key, "start", "_one", out="_before")
    long = (F.col("n") >= max(2, short_num)) | ((F.col("n") >= 2) & (F.col("end") - F.col("start") > short_limit))
    x = written(_numbered(x, key, "start", long | F.col("_before").isNull(), "_part"))
    # the stretch that opens a part sets its side; a part on the same side as the one before belongs to its block
    heads = x.groupBy(key, "_part").agg(F.min("start").alias("start"), F.min_by(hap, "start").alias("_side"))
    heads = _numbered(previous(heads, key, "start", "_side", out="_other"), key, "start", F.col("_other").isNull() | (F.col("_other") != F.col("_side")), "_block")
    tails = x.groupBy(key).agg(F.max("start").alias("_tail"))
    y = x.join(heads.select(key, "_part", "_side", "_block"), [key, "_part"]).join(tails, key)
    off = F.col(hap) != F.col("_side")
    trailing = off & (F.col("start") == F.col("_tail"))
    per = y.groupBy(key, "_block").agg(
        F.sum(F.when(~trailing, F.col("n")).otherwise(0)).alias("m"), F.sum(F.when(off & ~trailing, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(trailing, F.col("n")).otherwise(0)).alias("t")
    )
    out = per.agg(F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("s"))), F.lit(0)).alias("switches"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0) + F.when(F.col("t") > 1, F.col("t")).otherwise(0)), F.lit(0)).alias("markers"))
    return out.select("switches", "markers", (100 * F.col("switches") / F.nullif("markers", F.lit(0))).alias("error"))
