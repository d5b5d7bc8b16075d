"""Given tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import contacts as ct
from strandloom.operators.prefix import number_rows
from strandloom.plans import views as v
from strandloom.records import table
from strandloom.session import scratch, written
from strandloom.sources import readers, writers


def _units(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).where("name is not null").select("name", "seq")


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark) + ".fasta"
    writers.fasta(_units(spark, d), path, width=60)
    return readers.sequences(spark, path).select("name", F.md5("seq").alias("digest"), F.col("length").cast("long").alias("length"))


def fastq_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    writers.fastq(_units(spark, d).withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), path)
    return readers.fastq(spark, path, least=1000).select("name", F.md5("seq").alias("digest"), F.length("qual").cast("long").alias("quals"))


def paf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    writers.paf(v.hits(spark, d).where("match is not null and alnlen is not null and mapq is not null and qlen is not null and tlen is not null").withColumn("nmatch", F.col("match")), path)
    out = readers.paf(spark, path)
    return out.groupBy("tname", "strand").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in ("qstart", "qend", "tstart", "tend", "nmatch", "mapq")], F.sum(F.coalesce(F.length("cigar"), F.lit(0))).alias("cigar_chars"))


def sam_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Alignments as SAM text; the end on the target comes from the CIGAR again."""
    path = scratch(spark)
    flag = F.when(F.col("strand") == "-", 16).otherwise(0)
    x = v.hits(spark, d).where("cigar is not null and mapq is not null").select("qname", flag.alias("flag"), F.col("tname").alias("rname"), F.col("tstart").alias("pos"), "mapq", "cigar", F.col("alnlen").alias("nm"))
    writers.sam(x, path, v.contigs(spark, d))
    return readers.sam(spark, path).select("qname", "flag", "rname", "pos", "endpos", "mapq", "nm")


def sam_references(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    none = spark.createDataFrame([], "qname string, flag int, rname string, pos long, mapq int, cigar string, nm int")
    writers.sam(none, path, v.contigs(spark, d))
    return readers.sam_references(spark, path)


def bed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    writers.bed(v.hits(spark, d).select(F.col("tname").alias("contig"), F.col("tstart").alias("start"), F.col("tend").alias("end"), F.col("qname").alias("name")), path)
    return readers.bed(spark, path).select("contig", F.col("start").alias("from_base"), F.col("end").alias("to_base"), "name")


def sites_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    writers.sites(v.positions(spark, d).where("is_var = 1").select(F.col("ctg").alias("contig"), "pos"), path)
    return readers.variant_sites(spark, path)


def pairs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of segments, and the phasing made of them, as text."""
    pairs, result = scratch(spark), scratch(spark)
    p = v.segment_pairs(spark, d)
    writers.delimited(p.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), pairs, ["a", "b"])
    writers.phasing(p.select("grp", F.col("a").alias("hap0"), F.col("b").alias("hap1")), result)
    return readers.phasing(spark, result).join(readers.pairs(spark, pairs), F.col("hap0") == F.col("a")).select("grp", "hap0", F.col("b").alias("hap1"))


def links_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("r"), F.col("l_suppkey").cast("string").alias("c1"), F.lit("+").alias("s1"), F.col("l_partkey").alias("p1"), F.col("l_quantity").cast("long").alias("n1"), F.col("l_partkey").cast("string").alias("c2"), F.lit("-").alias("s2"), F.col("l_orderkey").alias("p2"), F.col("l_linenumber").alias("n2"))
    writers.delimited(x, path, x.columns)
    return readers.links(spark, path).groupBy("ctg1").agg(F.count(F.lit(1)).alias("n"), F.sum("pos1").alias("sum_pos1"), F.sum("len1").alias("sum_len1"), F.sum("pos2").alias("sum_pos2"), F.sum("len2").alias("sum_len2"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mates = ct.pair_up(v.alignments(spark, d).select("read", "seg", "tid"), "read", "seg")
    cells = written(ct.contact_matrix(mates, "tid1", "tid2").select(F.col("t1").cast("string").alias("t1"), F.col("t2").cast("string").alias("t2"), "n"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("name"))
    return cells, written(number_rows(names, ["k"], out="i").select("name", "i"))


def matrix_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    writers.matrix_text(*_cells(spark, d), path, compression="gzip")
    return readers.matrix_text(spark, path)


def matrix_binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    writers.matrix_binary(*_cells(spark, d), path, compression="gzip")
    return readers.matrix_binary(spark, path).select(F.col("i").alias("t1"), F.col("j").alias("t2"), "n")


QUERIES = {f.__name__: f for f in (
    fasta_round_trip, fastq_round_trip, paf_round_trip, sam_round_trip, sam_references, bed_round_trip, sites_round_trip, pairs_round_trip, links_round_trip, matrix_text_round_trip, matrix_binary_round_trip,
)}

SQL = {
    "fasta_round_trip": f"WITH {v.UNITS} SELECT name, md5(seq) AS digest, length(seq) AS length FROM unt WHERE name IS NOT NULL",
    "fastq_round_trip": f"WITH {v.UNITS} SELECT name, md5(seq) AS digest, length(seq) AS quals FROM unt WHERE name IS NOT NULL AND length(seq) >= 1000",
    "paf_round_trip": f"""WITH {v.HITS} SELECT tname, strand, count(*) AS n, CAST(sum(qstart) AS BIGINT) AS sum_qstart, CAST(sum(qend) AS BIGINT) AS sum_qend, CAST(sum(tstart) AS BIGINT) AS sum_tstart, CAST(sum(tend) AS BIGINT) AS sum_tend,
        CAST(sum(match) AS BIGINT) AS sum_nmatch, CAST(sum(mapq) AS BIGINT) AS sum_mapq, CAST(sum(coalesce(length(cigar), 0)) AS BIGINT) AS cigar_chars FROM hits
        WHERE match IS NOT NULL AND alnlen IS NOT NULL AND mapq IS NOT NULL AND qlen IS NOT NULL AND tlen IS NOT NULL GROUP BY tname, strand""",
    "sam_round_trip": f"""WITH {v.RUNS}, s AS (SELECT paf_id, CAST(coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN len END), 0) AS BIGINT) AS n FROM runs GROUP BY paf_id)
        SELECT qname, CASE WHEN strand = '-' THEN 16 ELSE 0 END AS flag, tname AS rname, tstart AS pos, tstart + n AS endpos, mapq, alnlen AS nm FROM hits JOIN s USING (paf_id) WHERE mapq IS NOT NULL""",
    "sam_references": "SELECT name, length FROM fai",
    "bed_round_trip": f"WITH {v.HITS} SELECT tname AS contig, tstart AS from_base, tend AS to_base, qname AS name FROM hits",
    "sites_round_trip": f"WITH {v.POSITIONS} SELECT ctg AS contig, pos FROM pstn WHERE is_var = 1",
    "pairs_round_trip": f"WITH {v.PAIRS} SELECT CAST(grp AS VARCHAR) AS grp, CAST(a AS VARCHAR) AS hap0, CAST(b AS VARCHAR) AS hap1 FROM prs",
    "links_round_trip": """SELECT CAST(l_suppkey AS VARCHAR) AS ctg1, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS sum_pos1, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_len1,
        CAST(sum(l_orderkey) AS BIGINT) AS sum_pos2, CAST(sum(l_linenumber) AS BIGINT) AS sum_len2 FROM lineitem GROUP BY 1""",
    "matrix_text_round_trip": f"WITH {v.MATRIX} SELECT CAST(t1 AS VARCHAR) AS t1, CAST(t2 AS VARCHAR) AS t2, n FROM mat",
    "matrix_binary_round_trip": f"WITH {v.MATRIX}, nm AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) SELECT a.i AS t1, b.i AS t2, n FROM mat JOIN nm a ON a.k = t1 JOIN nm b ON b.k = t2",
}
