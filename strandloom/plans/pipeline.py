"""Whole runs: from read pairs and homologous pairs to haplotypes, and regrouping of scaffolds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import contacts as ct
from strandloom.operators import coverage as cv
from strandloom.operators import kernels, sites
from strandloom.session import written


@dataclass(frozen=True)
class Phased:
    matrix: DataFrame
    labels: DataFrame
    haplotypes: DataFrame
    switches: DataFrame
    scores: DataFrame
    #: The read pairs that passed the filters.
    mates: DataFrame


def phase(alignments: DataFrame, variants: DataFrame, pairs: DataFrame, lengths: DataFrame, *, mapq: int = 10, rounds: int = kernels.ROUNDS, seed: int = 10_000) -> Phased:
    """Filters read pairs by sites, counts contacts, finds switches and labels the pairs of each group.

    ``alignments``: read, seg (1, 2), contig, pos, endpos, mapq, nm; ``variants``:
    contig, pos; ``pairs``: grp, idx, a, b; ``lengths``: contig, length. Names that
    no pair has drop out of the votes. What several steps read is written once.
    """
    sited = sites.first_site(alignments, variants, key=["read", "seg"], start="pos", end="endpos").withColumn("c", ct.mate_class(sites.spans_site("pos"), F.col("mapq"), F.col("nm"), mapq))
    mates = ct.pair_up(sited.select("read", "seg", F.col("contig").alias("tid"), "pos", F.col("endpos").alias("end"), "c"), "read", "seg")
    mates = written(mates.withColumn("kind", ct.pair_class(F.col("c1"), F.col("c2"))).where("kind != 0").drop("c1", "c2"))
    matrix = written(ct.contact_matrix(mates, "tid1", "tid2"))
    found = cv.switch_points(cv.clamp_spikes(cv.coverage_runs(cv.pair_deltas(mates.where("kind = 2 and tid1 = tid2"), "tid1"), lengths)))
    points = ct.both_have(pairs, found.select(F.col("contig").alias("segment"), "pos"))
    masked = matrix.join(points.select(F.col("segment").alias("t1")), "t1", "left_anti").join(points.select(F.col("segment").alias("t2")), "t2", "left_anti")
    labels = written(kernels.phase_labels(ct.block_sums(masked, pairs), pairs, rounds=rounds, seed=seed))
    kinds = ct.switch_kinds(ct.sided_contacts(mates, points), labels)
    members = pairs.select("grp", "idx", F.explode(F.array("a", "b")).alias("segment"))
    switches = kinds.join(members, ["grp", "idx"]).join(points, "segment").select("segment", "pos", "kind")
    scores = ct.pair_scores(ct.block_sums(matrix, pairs), labels.select("grp", "idx", "label"))
    return Phased(matrix, labels, kernels.haplotypes(labels), switches, scores, mates)


def regroup(contacts: DataFrame, segment_to_scaffold: DataFrame, scaffold_pairs: DataFrame, *, least: int = 5, rounds: int = kernels.ROUNDS, seed: int = 1000) -> DataFrame:
    """``grp, idx, a, b, label``: scaffold pairs as one group, from pairs' contacts (tid1, tid2), weak blocks masked."""
    pairs = scaffold_pairs.select(F.lit("all").alias("grp"), "idx", "a", "b")
    matrix = ct.mapped_contacts(contacts, "tid1", "tid2", segment_to_scaffold, "segment", "scaffold")
    return kernels.phase_labels(ct.block_sums(ct.masked_blocks(matrix, pairs, least), pairs), pairs, rounds=rounds, seed=seed, start=0, split=True)
