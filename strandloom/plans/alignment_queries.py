"""CIGARs, sites within alignments, and alignments as intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequences import chain_gap
from strandloom.operators import assembly, coverage, intervals, kernels, metrics, runs, sites
from strandloom.plans import views as v
from strandloom.records import table
from strandloom.session import written


def cigar_walk(spark: SparkSession, d: str) -> DataFrame:
    return cg.walk(v.hits(spark, d).where("cigar is not null")).select("paf_id", "run_no", "op", "len", "tpos", "qpos")


def cigar_spans(spark: SparkSession, d: str) -> DataFrame:
    return v.hits(spark, d).where("cigar is not null").select("paf_id", cg.span("cigar").alias("on_target"), cg.span("cigar", cg.ON_QUERY).alias("on_query"))


def cigar_sites(spark: SparkSession, d: str) -> DataFrame:
    return sites.cigar_sites(v.hits(spark, d))


def mismatch_positions(spark: SparkSession, d: str) -> DataFrame:
    return sites.mismatch_positions(v.hits(spark, d)).groupBy("tname").agg(F.count(F.lit(1)).alias("n"), F.sum("tpos").alias("sum_tpos"), F.sum("qpos").alias("sum_qpos"))


def called_sites(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    mismatches = x.select(F.col("l_suppkey").alias("tname"), F.col("l_partkey").alias("tpos"), F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("qpos"))
    primary = x.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("allele")).distinct()
    alternate = x.where("l_quantity < 25").select(F.col("l_orderkey").alias("chrom"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("allele")).distinct()
    return sites.called_sites(mismatches, primary, alternate)


def called_sites_stranded(spark: SparkSession, d: str) -> DataFrame:
    """Bases of mismatches on both sides of alignments, the query's complemented on the reverse strand."""
    x = written(sites.mismatch_positions(v.hits(spark, d), keep=["strand"]))
    base = lambda c: F.element_at(F.array(*[F.lit(b) for b in "ACGT"]), (F.pmod(c, F.lit(4)) + 1).cast("int"))
    primary = x.select(F.col("tname").alias("chrom"), F.col("tpos").alias("pos"), base(F.col("tpos")).alias("allele")).distinct()
    alternate = x.select(F.col("qname").alias("chrom"), F.col("qpos").alias("pos"), base(F.col("qpos")).alias("allele")).distinct()
    return sites.called_sites(x, primary, alternate, complement=True)


def cs_tags(spark: SparkSession, d: str) -> DataFrame:
    """CIGARs written as ``cs`` tags and read back: bases on both sides."""
    text = """array_join(transform(regexp_extract_all(cigar, '([0-9]+[=XID])', 1), r -> case right(r, 1)
        when '=' then concat(':', left(r, length(r) - 1)) when 'X' then repeat('*ac', cast(left(r, length(r) - 1) as int))
        when 'I' then concat('+', repeat('g', cast(left(r, length(r) - 1) as int))) else concat('-', repeat('t', cast(left(r, length(r) - 1) as int))) end), '')"""
    back = v.hits(spark, d).where("cigar is not null").select("paf_id", cg.of_cs(F.expr(text)).alias("c"))
    return back.select("paf_id", cg.span("c").alias("on_target"), cg.span("c", cg.ON_QUERY).alias("on_query"), F.size(cg.runs("c")).alias("n_runs"))


def first_site_asof(spark: SparkSession, d: str) -> DataFrame:
    found = sites.first_site(v.hits(spark, d), v.positions(spark, d).where("is_var = 1"), key=["paf_id"], contig="tname", start="tstart", end="tend", site_contig="ctg")
    return found.select("paf_id", "first_site", sites.spans_site("tstart").alias("spans"))


def exact_runs(spark: SparkSession, d: str) -> DataFrame:
    return assembly.exact_runs(v.hits(spark, d), 50)


def run_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_histogram(assembly.exact_runs(v.hits(spark, d), 1), width=100)


def run_percentile(spark: SparkSession, d: str) -> DataFrame:
    return runs.position_of_rank(assembly.exact_runs(v.hits(spark, d), 1), "strand", "len", 90, least=10).select("strand", "len", "n")


def block_identity(spark: SparkSession, d: str) -> DataFrame:
    return runs.block_identity(cg.walk(v.hits(spark, d).where("cigar is not null")), "tname", 1000)


def target_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_runs(coverage.interval_deltas(v.hits(spark, d), "tname", "tstart", "tend"))


def depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    lengths = v.contigs(spark, d).select(F.col("name").alias("contig"), "length")
    return runs.depth_histogram(coverage.coverage_runs(coverage.interval_deltas(v.hits(spark, d), "tname", "tstart", "tend"), lengths))


def interval_complement(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.complement(v.hits(spark, d), "tname", "tstart", "tend", v.contigs(spark, d))
    return out.select(F.col("entity").alias("name"), F.col("start").alias("open_start"), F.col("end").alias("open_end"))


def containment_anti(spark: SparkSession, d: str) -> DataFrame:
    return intervals.outer_intervals(v.hits(spark, d), "tname", "tstart", "tend").select("paf_id", "tname", "tstart", "tend")


def running_max_filter(spark: SparkSession, d: str) -> DataFrame:
    return assembly.not_overtaken(v.hits(spark, d), "tname", "tstart", "tend").select("tname", "tstart", "tend")


def overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_counts(v.hits(spark, d), "paf_id", "tname", "tstart", "tend")


def dominant_query(spark: SparkSession, d: str) -> DataFrame:
    return assembly.dominant_queries(v.hits(spark, d))


def top_target(spark: SparkSession, d: str) -> DataFrame:
    return assembly.top_targets(v.hits(spark, d).where("match is not null"))


def chain_dp(spark: SparkSession, d: str) -> DataFrame:
    return kernels.chain_hits(v.hits(spark, d), least_match=100).select("qname", "chain_no", "paf_id")


def chain_placements(spark: SparkSession, d: str) -> DataFrame:
    return kernels.placements(kernels.chain_hits(v.hits(spark, d), least_match=100))


def chain_gaps(spark: SparkSession, d: str) -> DataFrame:
    """By how much neighbours in a chain are further apart on one side than on the other."""
    x = written(kernels.chain_hits(v.hits(spark, d), least_match=100))
    one = x.select("qname", (F.col("chain_no") + 1).alias("chain_no"), F.col("qend").alias("qe"), F.col("tstart").alias("ts"), F.col("tend").alias("te"))
    return x.join(one, ["qname", "chain_no"]).select("qname", "chain_no", chain_gap("strand", "qe", "ts", "te", "qstart", "tstart", "tend").alias("gap"))


QUERIES = {f.__name__: f for f in (
    cigar_walk, cigar_spans, cigar_sites, mismatch_positions, called_sites, called_sites_stranded, cs_tags, first_site_asof, exact_runs, run_histogram, run_percentile, block_identity, target_coverage,
    depth_histogram, interval_complement, containment_anti, running_max_filter, overlap_counts, dominant_query, top_target, chain_dp, chain_placements, chain_gaps,
)}

FIRST = "CASE WHEN strand <> '-' THEN qstart + (qpos - qstart) + k ELSE qend - 1 - (qpos - qstart) - k END"
EXACT = f"{v.RUNS}, ex AS (SELECT paf_id, qname, tname, strand, qpos, tpos, len FROM runs WHERE op IN ('=', 'M') AND len <> qlen)"
#: Each query's hits in order; then the best score of a chain that ends at each hit, and the hit before it; then the best chain, from its end.
CHAIN = f"""{v.HITS}, hl AS (SELECT qname, list({{'id': paf_id, 'qs': qstart, 'qe': qend, 'st': strand, 't': tname, 'a': CASE WHEN strand = '+' THEN tstart ELSE tend END, 'b': CASE WHEN strand = '+' THEN tend ELSE tstart END,
        'ts': tstart, 'te': tend, 'm': match}} ORDER BY qstart, qend, paf_id) AS h FROM hits WHERE match >= 100 AND strand IS NOT NULL AND tstart IS NOT NULL GROUP BY qname),
    dp AS (SELECT qname, 1 AS k, [h[1].m] AS sc, [0] AS pv FROM hl UNION ALL SELECT qname, k + 1, list_append(sc, h[k + 1].m + CASE WHEN g > 0 THEN g ELSE 0 END), list_append(pv, CASE WHEN g > 0 THEN list_position(c, g) ELSE 0 END) FROM (
        SELECT *, list_max(c) AS g FROM (SELECT dp.*, h, list_transform(range(1, k + 1), lambda j: CASE WHEN h[j].st = h[k + 1].st THEN sc[j] - abs(h[k + 1].a - h[j].b) END) AS c FROM dp JOIN hl USING (qname) WHERE k < len(h)))),
    dn AS (SELECT qname, sc, pv, h FROM dp JOIN hl USING (qname) WHERE k = len(h)),
    bt AS (SELECT qname, list_position(sc, list_max(sc)) AS loc, 0 AS back FROM dn UNION ALL SELECT qname, pv[loc], back + 1 FROM bt JOIN dn USING (qname) WHERE pv[loc] > 0),
    ch AS (SELECT qname, CAST(max(back) OVER (PARTITION BY qname) - back AS INTEGER) AS chain_no, h[loc] AS x FROM bt JOIN dn USING (qname))"""
DEPTH = f"""{v.HITS}, ev AS (SELECT tname AS contig, tstart AS pos, 1 AS delta FROM hits UNION ALL SELECT tname, tend, -1 FROM hits)"""
SQL = {
    "called_sites_stranded": f"""WITH {v.RUNS}, ch AS (SELECT *, unnest(generate_series(0, len - 1)) AS k FROM runs WHERE op = 'X' AND len > 0),
        m AS (SELECT DISTINCT tname, tpos + k AS tpos, qname, strand, CASE WHEN strand = '-' THEN qend - 1 - (qpos - qstart) - k ELSE qpos + k END AS qpos FROM ch)
        SELECT DISTINCT tname, CAST(tpos AS BIGINT) AS tpos, qname, CAST(qpos AS BIGINT) AS qpos, substring('ACGT', CAST(tpos % 4 + 1 AS BIGINT), 1) AS allele FROM m
        WHERE substring('ACGT', CAST(tpos % 4 + 1 AS BIGINT), 1) = CASE WHEN strand = '-' THEN substring('TGCA', CAST(((qpos % 4) + 4) % 4 + 1 AS BIGINT), 1) ELSE substring('ACGT', CAST(((qpos % 4) + 4) % 4 + 1 AS BIGINT), 1) END""",
    "cs_tags": f"""WITH {v.RUNS} SELECT paf_id, CAST(coalesce(sum(len) FILTER (WHERE op IN ('=', 'X', 'D')), 0) AS BIGINT) AS on_target, CAST(coalesce(sum(len) FILTER (WHERE op IN ('=', 'X', 'I')), 0) AS BIGINT) AS on_query,
        CAST(count(*) FILTER (WHERE op IN ('=', 'X', 'I', 'D')) AS INTEGER) AS n_runs FROM runs GROUP BY paf_id""",
    "chain_dp": f"WITH RECURSIVE {CHAIN} SELECT qname, chain_no, x.id AS paf_id FROM ch",
    "chain_gaps": f"""WITH RECURSIVE {CHAIN}, p AS (SELECT qname, chain_no, x, lag(x) OVER (PARTITION BY qname ORDER BY chain_no) AS y FROM ch)
        SELECT qname, chain_no, abs((x.qs - y.qe) - CASE WHEN x.st = '-' THEN y.ts - x.te ELSE x.ts - y.te END) AS gap FROM p WHERE y IS NOT NULL""",
    "chain_placements": f"""WITH RECURSIVE {CHAIN}, en AS (SELECT qname, arg_min(x, chain_no) AS f, arg_max(x, chain_no) AS l FROM ch GROUP BY qname)
        SELECT qname, f.qs AS qstart, l.qe AS qend, f.t AS tname, CASE WHEN f.st = '-' THEN l.ts ELSE f.ts END AS tstart, CASE WHEN f.st = '-' THEN f.te ELSE l.te END AS tend, f.st AS strand FROM en""",
    "cigar_walk": f"WITH {v.RUNS} SELECT paf_id, CAST(run_no AS INTEGER) AS run_no, op, len, CAST(tpos AS BIGINT) AS tpos, CAST(qpos AS BIGINT) AS qpos FROM runs",
    "cigar_spans": f"""WITH {v.RUNS} SELECT paf_id, CAST(coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN len END), 0) AS BIGINT) AS on_target,
        CAST(coalesce(sum(CASE WHEN op IN ('M','=','X','I','S') THEN len END), 0) AS BIGINT) AS on_query FROM runs GROUP BY paf_id""",
    "cigar_sites": f"""WITH {v.RUNS}, ch AS (SELECT *, unnest(generate_series(0, len - 1)) AS k FROM runs WHERE op IN ('X', 'D', 'I') AND len > 0),
        s AS (SELECT tname AS contig, tpos + k AS pos FROM ch WHERE op <> 'I' UNION ALL SELECT tname, tpos + 1 FROM ch WHERE op = 'I' UNION ALL SELECT qname, {FIRST} FROM ch WHERE op <> 'D'
        UNION ALL SELECT qname, {FIRST.replace("+ k", "- 1").replace("- k", "+ 1")} FROM ch WHERE op = 'D' UNION ALL SELECT qname, {FIRST.replace("+ k", "+ 1").replace("- k", "- 1")} FROM ch WHERE op = 'D')
        SELECT DISTINCT contig, CAST(pos AS BIGINT) AS pos FROM s WHERE pos >= 0""",
    "mismatch_positions": f"""WITH {v.RUNS}, ch AS (SELECT *, unnest(generate_series(0, len - 1)) AS k FROM runs WHERE op = 'X')
        SELECT tname, count(*) AS n, CAST(sum(tpos + k) AS BIGINT) AS sum_tpos, CAST(sum({FIRST}) AS BIGINT) AS sum_qpos FROM ch GROUP BY tname""",
    "called_sites": """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O'), a AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity < 25),
        m AS (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem)
        SELECT l_suppkey AS tname, l_partkey AS tpos, l_orderkey AS qname, l_linenumber AS qpos, l_returnflag AS allele FROM m JOIN a USING (l_orderkey, l_linenumber)
        WHERE (l_suppkey, l_partkey, l_returnflag) IN (SELECT * FROM p)""",
    "first_site_asof": f"""WITH {v.HITS}, {v.POSITIONS}, s AS (SELECT ctg, pos FROM pstn WHERE is_var = 1), f AS (SELECT paf_id, tstart, CASE WHEN pos < tend THEN pos END AS first_site
        FROM hits h ASOF LEFT JOIN s ON h.tname = s.ctg AND h.tstart <= s.pos) SELECT paf_id, first_site, coalesce(first_site > tstart, false) AS spans FROM f""",
    "exact_runs": f"WITH {EXACT} SELECT paf_id, qname, tname, strand, CAST(qpos AS BIGINT) AS qpos, CAST(tpos AS BIGINT) AS tpos, len FROM ex WHERE len >= 50",
    "run_histogram": f"WITH {EXACT} SELECT len // 100 AS bin, count(*) AS n FROM ex WHERE len >= 1 AND len // 100 < 500 GROUP BY 1",
    "run_percentile": f"""WITH {EXACT}, r AS (SELECT strand, len, row_number() OVER (PARTITION BY strand ORDER BY len) - 1 AS i, count(*) OVER (PARTITION BY strand) AS n FROM ex WHERE len >= 10)
        SELECT strand, len, n FROM r WHERE i = greatest(0, CAST(floor(n * 0.9) AS BIGINT) - 1)""",
    "block_identity": f"""WITH {v.RUNS}, c AS (SELECT *, unnest(generate_series(tpos // 1000, (tpos + len - 1) // 1000)) AS block FROM (SELECT tname, op, len, CAST(tpos AS BIGINT) AS tpos FROM runs WHERE op IN ('=', 'X') AND len > 0)),
        i AS (SELECT tname, block, op, least(tpos + len, (block + 1) * 1000) - greatest(tpos, block * 1000) AS inside FROM c)
        SELECT tname, block, CAST(sum(CASE WHEN op = '=' THEN inside ELSE 0 END) AS BIGINT) AS matched, CAST(sum(inside) AS BIGINT) AS covered FROM i GROUP BY tname, block""",
    "target_coverage": f"""WITH {DEPTH}, f AS (SELECT contig, pos, sum(delta) AS delta FROM ev GROUP BY contig, pos HAVING sum(delta) <> 0),
        r AS (SELECT contig, pos AS "start", lead(pos) OVER w AS "end", sum(delta) OVER w AS cov FROM f WINDOW w AS (PARTITION BY contig ORDER BY pos))
        SELECT contig, "start", "end", CAST(cov AS BIGINT) AS cov FROM r WHERE "end" IS NOT NULL""",
    "depth_histogram": f"""WITH {DEPTH}, e2 AS (SELECT * FROM ev UNION ALL SELECT name, 0, 0 FROM fai UNION ALL SELECT name, length, 0 FROM fai), f AS (SELECT contig, pos, sum(delta) AS delta FROM e2 GROUP BY contig, pos),
        r AS (SELECT pos, lead(pos) OVER w AS e, sum(delta) OVER w AS cov FROM f WINDOW w AS (PARTITION BY contig ORDER BY pos))
        SELECT CAST(cov AS BIGINT) AS cov, CAST(sum(e - pos) AS BIGINT) AS bases FROM r WHERE e IS NOT NULL GROUP BY cov""",
    "interval_complement": f"""WITH {v.HITS}, i AS (SELECT tname, tstart, tend FROM hits JOIN fai ON name = tname UNION ALL SELECT name, length, length FROM fai),
        g AS (SELECT tname AS name, coalesce(max(tend) OVER (PARTITION BY tname ORDER BY tstart, tend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_start, tstart AS open_end FROM i)
        SELECT name, open_start, least(open_end, length) AS open_end FROM g JOIN fai USING (name) WHERE open_start < least(open_end, length)""",
    "containment_anti": f"""WITH {v.HITS} SELECT paf_id, tname, tstart, tend FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.tname = a.tname AND b.tstart < a.tstart AND b.tend > a.tend)""",
    "running_max_filter": f"""WITH {v.HITS}, m AS (SELECT tname, tstart, max(tend) AS tend FROM hits GROUP BY tname, tstart),
        r AS (SELECT *, max(tend) OVER (PARTITION BY tname ORDER BY tstart ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m) SELECT tname, tstart, tend FROM r WHERE reach IS NULL OR tend > reach""",
    "overlap_counts": f"""WITH {v.HITS} SELECT a.paf_id, count(b.paf_id) AS overlaps FROM hits a LEFT JOIN hits b ON b.tname = a.tname AND b.tstart < a.tend AND b.tend > a.tstart AND b.paf_id <> a.paf_id GROUP BY a.paf_id""",
    "dominant_query": f"""WITH {v.HITS}, s AS (SELECT tname, qname, strand, sum(tend - tstart) AS covered FROM hits GROUP BY ALL)
        SELECT tname, qname, strand, CAST(covered AS BIGINT) AS covered FROM (SELECT *, row_number() OVER (PARTITION BY tname ORDER BY covered DESC, qname, strand) AS r FROM s) WHERE r = 1""",
    "top_target": f"""WITH {v.HITS}, s AS (SELECT qname, tname, sum(match) AS match FROM hits WHERE match IS NOT NULL GROUP BY ALL)
        SELECT qname, tname, CAST(match AS BIGINT) AS match FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY match DESC, tname) AS r FROM s) WHERE r = 1""",
}
