"""Variant sites and the alignments that span them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequences import lifted_start

#: Positions per bin; a bin holds at most so many sites.
BIN = 4096


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def first_site(alignments: DataFrame, sites: DataFrame, *, key: list[str], contig: str = "contig", start: str = "start", end: str = "end", site_contig: str = "contig", site_pos: str = "pos", width: int = BIN) -> DataFrame:
    """``alignments`` with ``first_site``: the first site at or after the start and before the end, else null.

    ``key`` identifies an alignment. Both sides are cut into bins of ``width``
    positions and meet in an equi-join on (contig, bin), each bin's sites as one
    sorted array: a contig with a third of the rows spreads over its bins, and an
    alignment never multiplies by its sites. Null contigs or bounds find nothing.
    """
    binned = (
        sites.select(F.col(site_contig).alias("_c"), F.col(site_pos).cast("long").alias("_p")).where("_c is not null and _p is not null")
        .groupBy("_c", F.floor(F.col("_p") / width).alias("_b")).agg(F.sort_array(F.collect_set("_p")).alias("_sites"))
    )
    found = (
        alignments.select(*key, F.col(contig).alias("_c"), F.col(start).alias("_s"), F.col(end).alias("_e"))
        .where("_c is not null and _s < _e")
        .withColumn("_b", F.explode(_bins(F.col("_s"), F.col("_e"), width)))
        .join(binned, ["_c", "_b"])
        .select(*key, F.array_min(F.expr("filter(_sites, x -> x >= _s and x < _e)")).alias("_first"))
        .where("_first is not null")
        .groupBy(*key).agg(F.min("_first").alias("first_site"))
    )
    return alignments.join(found, key, "left")


def spans_site(start: str = "start") -> Column:
    """Whether an alignment counts as spanning a site: one at the very start hides those behind it."""
    return F.coalesce(F.col("first_site") > F.col(start), F.lit(False))


def cigar_sites(paf: DataFrame) -> DataFrame:
    """``contig, pos``: all places where alignments differ, on target and query.

    A mismatch gives each of its bases on both sides. A deletion gives each target
    base and the query bases on either side of the break; an insertion each query
    base and the target base after it.
    """
    runs = cg.walk(paf.select("qname", "qlen", "qstart", "qend", "strand", "tname", "tstart", "cigar").where("cigar is not null"))
    offset = F.col("qpos") - F.col("qstart")
    forward = F.col("strand") != "-"
    first = lifted_start("strand", "qstart", "qend")
    at = lambda k: F.when(forward, first + offset + k).otherwise(first - offset - k)
    each = F.sequence(F.lit(0).cast("long"), F.col("len") - 1)
    site = lambda name, pos: F.struct(F.col(name).alias("contig"), pos.cast("long").alias("pos"))
    op, lit = F.col("op"), lambda k: F.lit(k).cast("long")
    along = F.transform(each, lambda k: site("tname", F.col("tpos") + k))
    query = F.transform(each, lambda k: site("qname", at(k)))
    places = (
        F.when(op == "X", F.concat(along, query))
        .when(op == "D", F.concat(along, F.array(site("qname", at(lit(-1))), site("qname", at(lit(1))))))
        .otherwise(F.concat(query, F.array(site("tname", F.col("tpos") + 1))))
    )
    changed = runs.where("op in ('X', 'D', 'I') and len > 0")
    return changed.select(F.inline(places)).where("contig is not null and pos >= 0").distinct()


def called_sites(mismatches: DataFrame, primary: DataFrame, alternate: DataFrame, *, complement: bool = False) -> DataFrame:
    """Sites where an alignment's mismatch is called on both sides with the same alleles.

    ``mismatches``: tname, tpos, qname, qpos; the others: chrom, pos, allele. With
    ``complement`` also ``strand``: on ``-`` the alternate's bases are complemented
    before they are compared, which files of both strands need.
    """
    p = primary.select(F.col("chrom").alias("tname"), F.col("pos").alias("tpos"), "allele")
    a = alternate.select(F.col("chrom").alias("qname"), F.col("pos").alias("qpos"), F.col("allele").alias("_other"))
    other = F.when(F.col("strand") == "-", F.translate("_other", "ACGTacgt", "TGCAtgca")).otherwise(F.col("_other")) if complement else F.col("_other")
    x = mismatches.join(p, ["tname", "tpos"]).join(a, ["qname", "qpos"]).where(F.col("allele") == other)
    return x.select("tname", "tpos", "qname", "qpos", "allele").distinct()


def mismatch_positions(paf: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``tname, tpos, qname, qpos`` of every base in an ``X`` run, and the columns to ``keep``."""
    runs = cg.walk(paf.select("qname", "qstart", "qend", "strand", "tname", "tstart", "cigar").where("cigar is not null")).where("op = 'X'")
    offset = F.col("qpos") - F.col("qstart") + F.col("k")
    return runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("k")).select(
        "tname", (F.col("tpos") + F.col("k")).alias("tpos"), "qname",
        F.when(F.col("strand") == "-", F.col("qend") - 1 - offset).otherwise(F.col("qstart") + offset).alias("qpos"), *(keep or []),
    )
