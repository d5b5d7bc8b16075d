"""``python -m strandloom COMMAND ...``: whole runs and measures over files; results are folders of part files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar
from strandloom.functions.sequences import region
from strandloom.operators import assembly, contacts, coverage, dual, intervals, kernels, metrics, runs, sites
from strandloom.operators.prefix import number_rows, number_within
from strandloom.plans import pipeline
from strandloom.sources import readers, writers


def _phase(spark: SparkSession, a: argparse.Namespace) -> None:
    sam = readers.sam(spark, a.sam).where(F.col("flag").bitwiseAND(2316) == 0)
    seg = F.when(F.col("flag").bitwiseAND(64) != 0, 1).otherwise(2)
    aln = sam.select(F.col("qname").alias("read"), seg.alias("seg"), F.col("rname").alias("contig"), "pos", "endpos", "mapq", "nm")
    p = readers.pairs(spark, a.pairs).withColumn("grp", F.split("a", ":")[0])
    p = number_within(p, "grp", ["a", "b"], out="idx")
    lengths = readers.fai(spark, a.fai).select(F.col("name").alias("contig"), "length")
    out = pipeline.phase(aln, readers.variant_sites(spark, a.variants), p, lengths, mapq=a.mapq, rounds=a.iter, seed=a.seed)
    writers.phasing(out.haplotypes, f"{a.out}/result")
    writers.switches(out.switches, f"{a.out}/switch")
    writers.delimited(out.scores, f"{a.out}/score", out.scores.columns)
    out.matrix.write.parquet(f"{a.out}/matrix")
    out.mates.write.parquet(f"{a.out}/filtered")


def _group(spark: SparkSession, a: argparse.Namespace) -> None:
    links = readers.links(spark, a.links).select(F.col("ctg1").alias("tid1"), F.col("ctg2").alias("tid2"))
    p = number_rows(readers.pairs(spark, a.pairs), ["a", "b"], out="idx")
    out = pipeline.regroup(links, readers.segment_map(spark, a.bed), p, rounds=a.iter, seed=a.seed)
    writers.phasing(kernels.haplotypes(out), a.out)


def _paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with a number that follows from what they hold."""
    x = readers.paf(spark, path).where("qname is not null and tname is not null").withColumn("match", F.col("nmatch"))
    return number_rows(x, ["tname", "tstart", "tend", "qname", "qstart", "qend", "strand"], out="paf_id")


def _place(spark: SparkSession, a: argparse.Namespace) -> None:
    out = kernels.placements(kernels.chain_hits(_paf(spark, a.paf), a.least))
    writers.delimited(out, a.out, out.columns)


def _cut(spark: SparkSession, a: argparse.Namespace) -> None:
    placed = readers._fields(readers._lines(spark, a.placed), "\t", "qname string, qstart bigint, qend bigint, tname string, tstart bigint, tend bigint, strand string").drop("f")
    seqs = readers.sequences(spark, a.primary).unionByName(readers.sequences(spark, a.alternate))
    segs = assembly.segments(placed, readers.sequences(spark, a.primary).select("name", "length"))
    for kind in ("hap1", "hap2", "collapsed"):
        mine = segs.where(F.col("kind") == kind)
        writers.fasta(assembly.cut(mine, seqs), f"{a.out}/{kind}.fasta", name="segment")
        writers.bed(mine.drop("mate"), f"{a.out}/{kind}.bed")
    writers.delimited(assembly.homologous_pairs(segs), f"{a.out}/pairs", ["a", "b"], order=["a"])


def _n50(spark: SparkSession, a: argparse.Namespace) -> None:
    metrics.nx_stats(readers.sequences(spark, a.file), "length").show(truncate=False)


def _ng50(spark: SparkSession, a: argparse.Namespace) -> None:
    metrics.ng50(readers.sequences(spark, a.file), "length", a.size).show(truncate=False)


def _hamming(spark: SparkSession, a: argparse.Namespace) -> None:
    metrics.hamming_error(readers.hapmer_counts(spark, a.file), "assembly", "n1", "n2").show(truncate=False)


def _contacts(spark: SparkSession, a: argparse.Namespace) -> None:
    contacts.contact_totals(readers.matrix_text(spark, a.file)).show(truncate=False)


def _coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    x = coverage.coverage_runs(coverage.interval_deltas(readers.bed(spark, a.bed), "contig", "start", "end"), readers.fai(spark, a.fai).select(F.col("name").alias("contig"), "length"))
    writers.delimited(x, a.out, x.columns, order=["contig", "start"])


def _gaps(spark: SparkSession, a: argparse.Namespace) -> None:
    x = intervals.gaps(readers.bed(spark, a.bed), "contig", "start", "end")
    writers.delimited(x, a.out, x.columns)


def _variant(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mismatches of the alignments that are called on both sides."""
    call = lambda path: readers.vcf_snvs(spark, path).select("chrom", "pos", F.col("alt").alias("allele"))
    out = sites.called_sites(sites.mismatch_positions(readers.paf(spark, a.paf), ["strand"]), call(a.primary), call(a.alternate), complement=bool(a.complement))
    both = F.explode(F.array(F.struct(F.col("tname").alias("contig"), F.col("tpos").alias("pos")), F.struct(F.col("qname").alias("contig"), F.col("qpos").alias("pos"))))
    writers.sites(out.select(both.alias("x")).select("x.*").distinct(), a.out)


def _sites(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.sites(sites.cigar_sites(readers.paf(spark, a.paf)), a.out)


def _filter(spark: SparkSession, a: argparse.Namespace) -> None:
    x = readers.sequences(spark, a.file)
    writers.fasta(x.where(F.col("length") >= a.least), f"{a.out}/kept")
    writers.fasta(x.where(F.col("length") < a.least), f"{a.out}/short")


def _unzip(spark: SparkSession, a: argparse.Namespace) -> None:
    out = assembly.unzip_names(readers.fai(spark, a.fai), _paf(spark, a.paf))
    writers.delimited(out, a.out, ["name", "new_name"], order=["name"])


def _scaffold(spark: SparkSession, a: argparse.Namespace) -> None:
    out = assembly.scaffolds(readers.orderings(spark, a.ordering), readers.sequences(spark, a.fasta))
    writers.fasta(out, a.out, name="scaffold")


def _dualcut(spark: SparkSession, a: argparse.Namespace) -> None:
    out = assembly.dual_cut(_paf(spark, a.paf), a.least)
    writers.delimited(out, a.out, out.columns, order=["tname", "piece"])


def _write_cut(pieces: DataFrame, spark: SparkSession, a: argparse.Namespace) -> None:
    pair = pieces.select(region("qname", "qstart", "qend").alias("a"), region("tname", "tstart", "tend").alias("b"), "strand")
    writers.delimited(pair, f"{a.out}/pairs", ["a", "b", "strand"], order=["b", "a"])
    first, second = readers.sequences(spark, a.first), readers.sequences(spark, a.second)
    parts = dual.cut_both(pieces, first.select("name", "length"), second.select("name", "length"))
    for hap, seqs in ((1, first), (2, second)):
        for kind in ("dual", "collapsed"):
            mine = parts.where((F.col("hap") == hap) & (F.col("kind") == kind)).withColumn("strand", F.lit("+"))
            writers.fasta(assembly.cut(mine, seqs), f"{a.out}/{kind}{hap}.fasta", name="segment")
            writers.bed(mine.select("contig", "start", "end"), f"{a.out}/{kind}{hap}.bed")


def _replace(spark: SparkSession, a: argparse.Namespace) -> None:
    pieces = dual.replaced(_paf(spark, a.paf), a.least)
    writers.delimited(pieces, a.out, ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend"], order=["tname", "tstart"])
    dual.overlap_summary(pieces, ["paf_id", "piece"]).show()


def _chain(spark: SparkSession, a: argparse.Namespace) -> None:
    paf = _paf(spark, a.paf)
    _write_cut(dual.chained(paf, dual.run_threshold(paf, a.share, a.shortest)), spark, a)


def _merge(spark: SparkSession, a: argparse.Namespace) -> None:
    hits = lambda path: readers.paf(spark, path).select(F.col("qname").alias("segment"), "strand", "qstart", "qend", "tname", "tstart")
    out = dual.merge_pairs(number_rows(readers.pairs(spark, a.pairs), ["a", "b"], out="at"), hits(a.first), hits(a.second))
    writers.delimited(out, a.out, ["a", "b", "strand"], order=["a", "b"])


def _clean(spark: SparkSession, a: argparse.Namespace) -> None:
    """Segments that are in a haplotype, in the order of their scaffold."""
    segs = readers.bed(spark, a.bed).withColumn("segment", region("contig", "start", "end"))
    named = readers.phasing(spark, a.result).select(F.explode(F.array("hap0", "hap1")).alias("segment")).distinct()
    writers.bed(segs.join(named, "segment", "left_semi"), a.out)


def _identity(spark: SparkSession, a: argparse.Namespace) -> None:
    out = runs.block_identity(cigar.walk(readers.paf(spark, a.paf).where("cigar is not null")), "tname", a.block)
    writers.delimited(out, a.out, out.columns, order=["tname", "block"])


def _switch(spark: SparkSession, a: argparse.Namespace) -> None:
    """Switch errors of markers: a BED of scaffold, start, end and haplotype (0 or 1)."""
    x = readers.bed(spark, a.file).withColumn("hap", F.expr("try_cast(name as int)"))
    runs.switch_error(x, "contig", "start", "end", "hap", short_num=a.snum, short_limit=a.slimit).show(truncate=False)


def _sides(spark: SparkSession, path: str, tie: int) -> DataFrame:
    return contacts.hap_sides(readers.hapmer_counts(spark, path).select(F.col("contig").alias("segment"), "n1", "n2"), tie=tie)


def _phase_eval(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = readers.hapmer_counts(spark, a.counts).select(F.col("contig").alias("segment"), "n1", "n2")
    metrics.phase_eval(readers.phasing(spark, a.result), counts, extra=a.extra).show(truncate=False)


def _hic(spark: SparkSession, a: argparse.Namespace) -> None:
    """Verdicts on read pairs; segments of one group share the first seven letters."""
    sam = readers.sam(spark, a.sam).where(F.col("flag").bitwiseAND(2316) == 0)
    seg = F.when(F.col("flag").bitwiseAND(64) != 0, 1).otherwise(2)
    mates = contacts.pair_up(sam.select("qname", seg.alias("seg"), F.col("rname").alias("tid"), "mapq", "nm"), "qname", "seg")
    members = readers.pairs(spark, a.pairs).select(F.explode(F.array("a", "b")).alias("segment"), F.col("a").alias("pair")).withColumn("grp", F.left("segment", F.lit(7)))
    contacts.contact_classes(mates, members, _sides(spark, a.counts, -1), mapq=a.mapq).show(truncate=False)


def _link(spark: SparkSession, a: argparse.Namespace) -> None:
    members = readers.pairs(spark, a.pairs).select(F.explode(F.array("a", "b")).alias("segment"), F.col("a").alias("pair"))
    contacts.judged_links(readers.links(spark, a.links), members, _sides(spark, a.counts, 0), least=a.least).groupBy("verdict").count().show()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandloom")
    sub = parser.add_subparsers(required=True)

    def command(name, f, *flags, **more):
        p = sub.add_parser(name)
        for x in flags:
            p.add_argument(x, **({"nargs": "+"} if x == "--bed" and name == "group" else {"required": True} if x.startswith("--") else {}))
        for x, default in more.items():
            p.add_argument(f"--{x}", type=type(default), default=default)
        p.set_defaults(run=f)

    command("phase", _phase, "--sam", "--variants", "--pairs", "--fai", "--out", mapq=10, iter=kernels.ROUNDS, seed=10_000)
    command("group", _group, "--links", "--bed", "--pairs", "--out", iter=kernels.ROUNDS, seed=1000)
    command("place", _place, "--paf", "--out", least=5000)
    command("cut", _cut, "--placed", "--primary", "--alternate", "--out")
    command("n50", _n50, "file")
    command("ng50", _ng50, "file", size=3_000_000_000)
    command("hamming", _hamming, "file")
    command("contact", _contacts, "file")
    command("coverage", _coverage, "--bed", "--fai", "--out")
    command("gaps", _gaps, "--bed", "--out")
    command("variant", _variant, "--paf", "--primary", "--alternate", "--out", complement=0)
    command("sites", _sites, "--paf", "--out")
    command("filter", _filter, "file", "--out", least=1000)
    command("unzip", _unzip, "--fai", "--paf", "--out")
    command("scaffold", _scaffold, "--ordering", "--fasta", "--out")
    command("dualcut", _dualcut, "--paf", "--out", least=10_000)
    command("replace", _replace, "--paf", "--out", least=10_000)
    command("chain", _chain, "--paf", "--first", "--second", "--out", share=50.0, shortest=10_000)
    command("merge", _merge, "--pairs", "--first", "--second", "--out")
    command("clean", _clean, "--bed", "--result", "--out")
    command("identity", _identity, "--paf", "--out", block=1_000_000)
    command("switch", _switch, "file", snum=100, slimit=20_000)
    command("phase-eval", _phase_eval, "--result", "--counts", extra=0)
    command("hic", _hic, "--sam", "--pairs", "--counts", mapq=10)
    command("link", _link, "--links", "--pairs", "--counts", least=100)
    a = parser.parse_args(argv)
    a.run(SparkSession.builder.appName("strandloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
