"""Projections, filters and scalar functions over sequences and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequences as sq
from strandloom.operators import assembly
from strandloom.plans import views as v
from strandloom.records import table


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).select("unit_id", F.md5(sq.revcomp("seq")).alias("digest"), sq.is_dna("seq").alias("is_dna"))


def fasta_wrap(spark: SparkSession, d: str) -> DataFrame:
    return v.units(spark, d).select("unit_id", F.md5(sq.wrapped("seq", 80)).alias("digest"))


def length_split(spark: SparkSession, d: str) -> DataFrame:
    x = v.units(spark, d).select((F.length("seq") >= 4000).alias("is_long"), F.length("seq").cast("long").alias("l"))
    return x.groupBy("is_long").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("bases"))


def segment_name_parse(spark: SparkSession, d: str) -> DataFrame:
    name = sq.region("tname", "tstart", "tend")
    parsed = sq.parse_region(name)
    return v.hits(spark, d).select("paf_id", name.alias("segment"), parsed["name"].alias("contig"), parsed["start"].alias("seg_start"), parsed["end"].alias("seg_end"))


def split_collapse(spark: SparkSession, d: str) -> DataFrame:
    f = sq.split_fields("head", " ")
    return table(spark, d, "units").select("unit_id", F.array_join(f, "|").alias("fields"), F.size(f).alias("n_fields")).distinct()


def flag_filter(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_partkey") * 7 % 4096).cast("int").alias("flag"))
    return x.where(sq.without_flags("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def allele_keys(spark: SparkSession, d: str) -> DataFrame:
    top = F.greatest("n_a", "n_c", "n_g", "n_t")
    alt = F.when(F.col("n_a") == top, 0).when(F.col("n_c") == top, 1).when(F.col("n_g") == top, 2).when(F.col("n_t") == top, 3)
    x = v.positions(spark, d).select("ctg", "pos", sq.base_letter("base").alias("ref"), sq.base_letter(alt).alias("alt"))
    return x.where(sq.is_snv("ref", "alt") & (F.col("ref") != F.col("alt"))).select("ctg", "pos", sq.allele_key("ref", "alt").alias("primary_key"), sq.allele_key("ref", "alt", False).alias("alternate_key"))


def strand_lift(spark: SparkSession, d: str) -> DataFrame:
    return v.hits(spark, d).select("paf_id", sq.lifted_start("strand", "qstart", "qend").alias("first_base"))


def region_query(spark: SparkSession, d: str) -> DataFrame:
    x = v.hits(spark, d).where("tstart < 6000 and tend > 1000")
    return x.groupBy("tname").agg(F.count(F.lit(1)).alias("n"), F.min("tstart").alias("low"), F.max("tend").alias("high"))


def filter_expression(spark: SparkSession, d: str) -> DataFrame:
    x = v.hits(spark, d).where("mapq >= 20 and strand = '-' and alnlen % 2 = 1 and qname rlike '_0[0-4]' and length(cigar) > 3 and (match * 10 > alnlen * 9 or qlen > 4000)")
    return x.select("paf_id", "qname", "mapq", "alnlen")


def full_queries(spark: SparkSession, d: str) -> DataFrame:
    return v.hits(spark, d).where("qstart = 0 and qend = qlen").select("paf_id", "qname", "tname")


def span_filter(spark: SparkSession, d: str) -> DataFrame:
    return v.hits(spark, d).where("qend - qstart >= 300 and tend - tstart >= 300 and match >= 250").select("paf_id", "match")


def _names(spark: SparkSession, d: str) -> DataFrame:
    names = v.hits(spark, d).select("qname").distinct()
    primary = names.select(F.split("qname", "_")[0].alias("name")).where("substring(name, 7, 1) in ('0', '2', '4', '6', '8')")
    return names.select(F.col("qname").alias("name")).unionByName(primary.distinct())


def name_mapping(spark: SparkSession, d: str) -> DataFrame:
    return assembly.name_mapping(_names(spark, d))[0]


def omitted_names(spark: SparkSession, d: str) -> DataFrame:
    return assembly.name_mapping(_names(spark, d))[1]


def unzip_names(spark: SparkSession, d: str) -> DataFrame:
    return assembly.unzip_names(v.contigs(spark, d).select("name"), v.hits(spark, d))


QUERIES = {f.__name__: f for f in (revcomp, fasta_wrap, length_split, segment_name_parse, split_collapse, flag_filter, allele_keys, strand_lift, region_query, filter_expression, full_queries, span_filter, name_mapping, omitted_names, unzip_names)}

NAMES = f"""{v.HITS}, q AS (SELECT DISTINCT qname AS name FROM hits),
    nm AS (SELECT name FROM q UNION ALL SELECT DISTINCT string_split(name, '_')[1] FROM q WHERE substring(string_split(name, '_')[1], 7, 1) IN ('0', '2', '4', '6', '8')),
    pri AS (SELECT name AS "primary" FROM nm WHERE len(string_split(name, '_')) = 1),
    alt AS (SELECT name AS alternate, string_split(name, '_')[1] AS "primary" FROM nm WHERE len(string_split(name, '_')) = 2)"""
SQL = {
    "revcomp": f"WITH {v.UNITS} SELECT unit_id, md5(translate(reverse(seq), 'ACGTacgt', 'TGCAtgca')) AS digest, regexp_full_match(seq, '[ACGTNacgtn]*') AS is_dna FROM unt",
    "fasta_wrap": f"WITH {v.UNITS} SELECT unit_id, md5(rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10))) AS digest FROM unt",
    "length_split": f"WITH {v.UNITS} SELECT length(seq) >= 4000 AS is_long, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM unt GROUP BY 1",
    "segment_name_parse": f"WITH {v.HITS} SELECT paf_id, tname || ':' || tstart || '-' || tend AS segment, tname AS contig, tstart AS seg_start, tend AS seg_end FROM hits",
    "split_collapse": """SELECT DISTINCT unit_id, array_to_string(list_filter(string_split(head, ' '), lambda x: x <> ''), '|') AS fields,
        CAST(len(list_filter(string_split(head, ' '), lambda x: x <> '')) AS INTEGER) AS n_fields FROM units""",
    "flag_filter": "SELECT flag, count(*) AS n FROM (SELECT CAST(l_partkey * 7 % 4096 AS INTEGER) AS flag FROM lineitem) WHERE flag & 2316 = 0 GROUP BY flag",
    "allele_keys": f"""WITH {v.POSITIONS}, x AS (SELECT ctg, pos, substr('ACGT', base + 1, 1) AS ref, CASE greatest(n_a, n_c, n_g, n_t) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' WHEN n_t THEN 'T' END AS alt FROM pstn)
        SELECT ctg, pos, ref || alt AS primary_key, alt || ref AS alternate_key FROM x WHERE ref <> alt""",
    "strand_lift": f"WITH {v.HITS} SELECT paf_id, CASE WHEN strand = '-' THEN qend - 1 ELSE qstart END AS first_base FROM hits",
    "region_query": f"WITH {v.HITS} SELECT tname, count(*) AS n, min(tstart) AS low, max(tend) AS high FROM hits WHERE tstart < 6000 AND tend > 1000 GROUP BY tname",
    "filter_expression": f"""WITH {v.HITS} SELECT paf_id, qname, mapq, alnlen FROM hits WHERE mapq >= 20 AND strand = '-' AND alnlen % 2 = 1 AND regexp_matches(qname, '_0[0-4]')
        AND length(cigar) > 3 AND (match * 10 > alnlen * 9 OR qlen > 4000)""",
    "full_queries": f"WITH {v.HITS} SELECT paf_id, qname, tname FROM hits WHERE qstart = 0 AND qend = qlen",
    "span_filter": f"WITH {v.HITS} SELECT paf_id, match FROM hits WHERE qend - qstart >= 300 AND tend - tstart >= 300 AND match >= 250",
    "name_mapping": f'WITH {NAMES} SELECT "primary", alternate FROM pri JOIN alt USING ("primary")',
    "omitted_names": f'WITH {NAMES} SELECT alternate, "primary" FROM alt WHERE "primary" NOT IN (SELECT "primary" FROM pri)',
    "unzip_names": f"""WITH {v.HITS}, pri AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS n FROM fai),
        f AS (SELECT * FROM (SELECT qname, tname, tstart, row_number() OVER (PARTITION BY qname ORDER BY tname, tstart) AS r FROM hits) WHERE r = 1),
        k AS (SELECT qname, n, row_number() OVER (PARTITION BY tname ORDER BY tstart, qname) AS k FROM f JOIN pri ON pri.name = f.tname)
        SELECT name, lpad(CAST(n AS VARCHAR), 6, '0') || 'F' AS new_name FROM pri UNION ALL SELECT qname, lpad(CAST(n AS VARCHAR), 6, '0') || 'F_' || lpad(CAST(k AS VARCHAR), 3, '0') FROM k""",
}
