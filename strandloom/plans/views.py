"""What the core queries read: the given tables as alignments, sites, pairs and contigs; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.names import clean_name
from strandloom.records import paf_records, table, variant_records


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as alignments of reads (orders) to segments (suppliers)."""
    seg = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    quantity = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("read"), seg.alias("seg"), F.col("l_suppkey").alias("tid"), F.col("l_partkey").alias("pos"),
        (F.col("l_partkey") + quantity).alias("endpos"), quantity.alias("mapq"), F.round(F.col("l_discount") * 100).cast("int").alias("nm"),
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("score"), (F.col("l_tax") < 0.04).alias("is_primary"),
    )


def sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_suppkey").alias("tid"), F.col("l_partkey").alias("pos")).distinct()


def segment_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``grp, idx, a, b``: neighbouring suppliers are a pair, five pairs a group."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a")).where("a % 2 = 0")
    return s.select(F.floor(F.col("a") / 10).alias("grp"), F.floor(F.col("a") % 10 / 2).alias("idx"), "a", (F.col("a") + 1).alias("b"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Distinct alignments with a target and a usable interval on both sides."""
    return paf_records(table(spark, d, "paf")).where("qname is not null and tname is not null and 0 <= qstart and qstart < qend and qend <= qlen and tstart < tend")


def positions(spark: SparkSession, d: str) -> DataFrame:
    return variant_records(table(spark, d, "variants"))


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fai")


def units(spark: SparkSession, d: str) -> DataFrame:
    """``unit_id, name, seq``: one row per record with bases, without blanks."""
    x = table(spark, d, "units").select("unit_id", clean_name("head").alias("name"), F.regexp_replace("seq", r"\s+", "").alias("seq")).where("unit_id is not null and seq != ''")
    return x.groupBy("unit_id").agg(F.max("name").alias("name"), F.max("seq").alias("seq"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Each query's alignment of highest match: where an alternate contig lies."""
    h = hits(spark, d).where("match is not null")
    best = h.groupBy("qname").agg(F.max_by(F.struct("paf_id", "qlen", "qstart", "qend", "strand", "tname", "tstart", "tend"), F.struct("match", -F.col("paf_id"))).alias("b"))
    return best.select("qname", "b.*")


ALN = """aln AS (SELECT l_orderkey AS read, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seg,
    l_suppkey AS tid, l_partkey AS pos, l_partkey + CAST(l_quantity AS INTEGER) AS endpos, CAST(l_quantity AS INTEGER) AS mapq,
    CAST(round(l_discount * 100) AS INTEGER) AS nm FROM lineitem)"""
SITES = "sites AS (SELECT DISTINCT l_suppkey AS tid, l_partkey AS pos FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')"
SITED = f"""{ALN}, {SITES}, sited AS (SELECT a.*, CASE WHEN s.pos < a.endpos THEN s.pos END AS first_site
    FROM aln a ASOF LEFT JOIN sites s ON a.tid = s.tid AND a.pos <= s.pos)"""
PAIRS = "prs AS (SELECT s_suppkey // 10 AS grp, (s_suppkey % 10) // 2 AS idx, s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 2 = 0)"
MATES = "mates AS (SELECT a.tid AS tid1, a.pos AS pos1, a.endpos AS end1, b.tid AS tid2, b.pos AS pos2, b.endpos AS end2 FROM aln a JOIN aln b ON a.read = b.read AND a.seg = 1 AND b.seg = 2)"
MATRIX = f"""{ALN}, {MATES}, mat AS (SELECT t1, t2, count(*) AS n FROM (SELECT tid1 AS t1, tid2 AS t2 FROM mates UNION ALL SELECT tid2, tid1 FROM mates) GROUP BY t1, t2)"""
NAME = "nullif(regexp_extract({0}, '^\\s*>?(\\S*)', 1), '')"
MATCH = "coalesce(nmatch, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)=', 1), lambda x: CAST(x AS BIGINT))), CASE WHEN cigar IS NOT NULL THEN 0 END)"
HITS = f"""hits AS (SELECT * FROM (SELECT paf_id, max({NAME.format("qname")}) AS qname, max(qlen) AS qlen, max(qstart) AS qstart, max(qend) AS qend, max(strand) AS strand,
    max(nullif({NAME.format("tname")}, '*')) AS tname, max(tlen) AS tlen, max(tstart) AS tstart, max(tend) AS tend, max({MATCH}) AS match, max(alnlen) AS alnlen, max(mapq) AS mapq,
    max(cigar) AS cigar FROM paf WHERE paf_id IS NOT NULL GROUP BY paf_id)
    WHERE qname IS NOT NULL AND tname IS NOT NULL AND 0 <= qstart AND qstart < qend AND qend <= qlen AND tstart < tend)"""
POSITIONS = f"""pstn AS (SELECT {NAME.format("ctg")} AS ctg, pos, max(base) AS base, max(n_a) AS n_a, max(n_c) AS n_c, max(n_g) AS n_g, max(n_t) AS n_t, max(cov) AS cov, max(is_var) AS is_var,
    max(called_at) AS called_at FROM variants WHERE {NAME.format("ctg")} IS NOT NULL AND pos IS NOT NULL GROUP BY 1, 2)"""
UNITS = f"""unt AS (SELECT unit_id, max({NAME.format("head")}) AS name, max(regexp_replace(seq, '\\s+', '', 'g')) AS seq FROM units
    WHERE unit_id IS NOT NULL AND regexp_replace(seq, '\\s+', '', 'g') <> '' GROUP BY unit_id)"""
PLACED = f"""{HITS}, placed AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY match DESC, paf_id) AS r FROM hits WHERE match IS NOT NULL) WHERE r = 1)"""
RUNS = f"""{HITS}, split AS (SELECT *, regexp_extract_all(cigar, '\\d+[MIDNSHP=X]') AS rs FROM hits WHERE cigar IS NOT NULL),
    one AS (SELECT * EXCLUDE rs, unnest(rs) AS run, generate_subscripts(rs, 1) - 1 AS run_no FROM split),
    parts AS (SELECT *, CAST(run[:-2] AS BIGINT) AS len, run[-1] AS op FROM one),
    runs AS (SELECT *, tstart + coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN len END) OVER w, 0) AS tpos,
        qstart + coalesce(sum(CASE WHEN op IN ('M','=','X','I','S') THEN len END) OVER w, 0) AS qpos
        FROM parts WINDOW w AS (PARTITION BY paf_id ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
