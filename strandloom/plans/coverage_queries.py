"""Coverage, spikes and switches; runs and other ordered operators; measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.operators import contacts as ct
from strandloom.operators import coverage as cv
from strandloom.operators import metrics, runs
from strandloom.plans import views as v
from strandloom.records import table


def _same_segment(spark: SparkSession, d: str) -> DataFrame:
    """Mates of a read on segments of the same nation as pairs within one contig."""
    x = v.alignments(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("tid"), (F.col("s_nationkey") % 5).alias("ctg")), "tid")
    return ct.pair_up(x.select("read", "seg", "ctg", "pos", F.col("endpos").alias("end")), "read", "seg").where("ctg1 = ctg2")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    """Every contig as 2,060 long, as the SQL has it."""
    lengths = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("contig"), F.lit(2060).cast("long").alias("length")).distinct()
    return cv.coverage_runs(cv.pair_deltas(_same_segment(spark, d), "ctg1"), lengths)


def coverage_runs(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).select("contig", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "cov")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Measured positions of each contig as runs up to the next one."""
    return v.positions(spark, d).where("cov >= 0").select(F.col("ctg").alias("contig"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "cov")


def coverage_clamped(spark: SparkSession, d: str) -> DataFrame:
    return cv.clamp_spikes(_measured(spark, d)).select("contig", F.col("start").alias("pos"), "cov", "clamped")


def switch_argmin(spark: SparkSession, d: str) -> DataFrame:
    """Where measured coverage collapses once its spikes are clamped."""
    return cv.switch_points(cv.clamp_spikes(_measured(spark, d))).select("contig", "pos", F.round("mean", 6).alias("mean"))


def switch_argmin_measured(spark: SparkSession, d: str) -> DataFrame:
    return cv.switch_points(_measured(spark, d), "cov").select("contig", "pos", F.round("mean", 6).alias("mean"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "event_type")


def islands(spark: SparkSession, d: str) -> DataFrame:
    return runs.islands(_typed(spark, d), "user_id", "event_id", "event_type").select("user_id", "event_type", F.col("start").alias("first_id"), F.col("end").alias("last_id"), "n")


def small_run_absorption(spark: SparkSession, d: str) -> DataFrame:
    out = runs.long_islands(runs.islands(_typed(spark, d), "user_id", "event_id", "event_type"), "user_id", "event_type", 2)
    return out.select("user_id", "event_type", F.col("start").alias("first_id"), F.col("end").alias("last_id"), "n")


def short_switch_scan(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 20).cast("int").alias("hap"))
    return runs.short_switches(x, "user_id", "event_id", "hap")


def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return runs.moving_average(v.positions(spark, d).where("cov >= 0"), "ctg", "pos", "cov", 5).withColumn("average", F.round("average", 6))


def breakpoint_midpoint(spark: SparkSession, d: str) -> DataFrame:
    return runs.midpoints(v.positions(spark, d).where("is_var = 1"), "ctg", "pos")


def pivot_sites(spark: SparkSession, d: str) -> DataFrame:
    """A column for each day a month can have."""
    x = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"), F.col("event_type"))
    days = list(range(1, 32))
    return runs.pivoted_sites(x, "user_id", "day", "event_type", days).select("user_id", *[F.col(str(k)).alias(f"day{k}") for k in days])


def pivot_sites_whole(spark: SparkSession, d: str) -> DataFrame:
    """Alias of :func:`pivot_sites`."""
    return pivot_sites(spark, d)


def exact_percentile(spark: SparkSession, d: str) -> DataFrame:
    return runs.position_of_rank(v.positions(spark, d).where("cov >= 0"), "ctg", "cov", 0.9)


def n50(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nx_stats(v.contigs(spark, d), "length")


def n50_by_strand(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nx_stats(v.hits(spark, d).withColumn("span", F.col("qend") - F.col("qstart")), "span", "strand")


def ng50(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ng50(v.contigs(spark, d), "length", 1_000_000_000)


def hamming(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hamming_error(v.positions(spark, d).where("ctg is not null"), "ctg", "n_a", "n_c").withColumn("error", F.round("error", 6))


def majority_phase_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.phase_error(v.positions(spark, d), "ctg", "is_var")


def site_consistency(spark: SparkSession, d: str) -> DataFrame:
    x = _reads(spark, d)
    return metrics.site_consistency(x, "read", "site", "allele")


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """One allele per order and segment class."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("read"), (F.col("l_suppkey") % 40).alias("site")).agg((F.max("l_partkey") % 2).alias("allele"))


def breakpoints(spark: SparkSession, d: str) -> DataFrame:
    return metrics.breakpoints(site_consistency(spark, d), 10, 0.5)


def switch_error(spark: SparkSession, d: str) -> DataFrame:
    x = v.positions(spark, d).select("ctg", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), (F.col("n_a") + F.col("n_c") > F.col("n_g") + F.col("n_t")).cast("int").alias("hap"))
    return runs.switch_error(x, "ctg", "start", "end", "hap", short_num=4, short_limit=500).withColumn("error", F.round("error", 6))


def pileup_depth(spark: SparkSession, d: str) -> DataFrame:
    """Bases of reads over each place: deletions don't cover."""
    x = cg.walk(v.hits(spark, d).where("cigar is not null")).where("op in ('M', '=', 'X')").select("tname", "tpos", (F.col("tpos") + F.col("len")).alias("tstop"))
    return cv.coverage_runs(cv.interval_deltas(x, "tname", "tpos", "tstop")).where("cov > 0").groupBy("contig").agg(F.sum((F.col("end") - F.col("start")) * F.col("cov")).alias("bases"), F.max("cov").alias("deepest"))


QUERIES = {f.__name__: f for f in (
    switch_error, pileup_depth, coverage_runs, coverage_clamped, switch_argmin, switch_argmin_measured, islands, small_run_absorption, short_switch_scan, moving_average, breakpoint_midpoint, pivot_sites, pivot_sites_whole,
    exact_percentile, n50, n50_by_strand, ng50, hamming, majority_phase_error, site_consistency, breakpoints,
)}

COV = f"""{v.ALN}, al AS (SELECT a.*, s_nationkey % 5 AS ctg FROM aln a JOIN supplier ON s_suppkey = tid),
    m AS (SELECT a.ctg, CASE WHEN a.pos < b.pos THEN a.pos ELSE b.pos END AS lo, CASE WHEN a.pos < b.pos THEN b.endpos ELSE a.endpos END AS hi FROM al a JOIN al b ON a.read = b.read AND a.seg = 1 AND b.seg = 2 AND a.ctg = b.ctg),
    ev AS (SELECT ctg AS contig, lo AS pos, 1 AS delta FROM m UNION ALL SELECT ctg, hi, -1 FROM m),
    nz AS (SELECT contig, pos, sum(delta) AS delta FROM ev GROUP BY contig, pos HAVING sum(delta) <> 0),
    e2 AS (SELECT * FROM nz UNION ALL SELECT DISTINCT s_nationkey % 5, 0, 0 FROM supplier UNION ALL SELECT DISTINCT s_nationkey % 5, 2060, 0 FROM supplier),
    f AS (SELECT contig, pos, sum(delta) AS delta FROM e2 GROUP BY contig, pos),
    cr AS (SELECT contig, run_start, run_end, CAST(cov AS BIGINT) AS cov FROM (SELECT contig, pos AS run_start, lead(pos) OVER w AS run_end, sum(delta) OVER w AS cov FROM f WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE run_end IS NOT NULL)"""
MEASURED = f"{v.POSITIONS}, ms AS (SELECT ctg AS contig, pos, cov FROM pstn WHERE cov >= 0)"


def _switch(source: str) -> str:
    return f"""mn AS (SELECT contig, sum((e - s) * c) / (sum(e - s) + 1) AS mean FROM {source} GROUP BY contig HAVING floor(sum((e - s) * c) / (sum(e - s) + 1)) >= 35),
        bd AS (SELECT contig, mean, min(s) FILTER (WHERE c >= floor(mean * 0.8)) AS l, max(e) FILTER (WHERE c >= floor(mean * 0.8)) AS r FROM {source} JOIN mn USING (contig) GROUP BY contig, mean),
        ins AS (SELECT contig, mean, c, greatest(s, l) AS place FROM {source} JOIN bd USING (contig) WHERE e > l AND s < r)
        SELECT contig, CAST(arg_min(place, c * 1000000000000 + place) AS BIGINT) AS pos, round(mean, 6) AS mean FROM ins GROUP BY contig, mean HAVING min(c) < floor(mean * 0.4) AND max(c) > floor(mean * 1.6)"""


ISLANDS = """isl AS (SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id)
    - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY user_id, event_type, g)"""
NX = """c AS (SELECT grp, l, count(*) AS c FROM src GROUP BY grp, l), u AS (SELECT *, sum(l * c) OVER (PARTITION BY grp ORDER BY l DESC) AS upto, sum(l * c) OVER (PARTITION BY grp) AS total FROM c)"""
ORDERED = "o AS (SELECT grp, l, row_number() OVER (PARTITION BY grp ORDER BY l DESC) AS i, sum(l) OVER (PARTITION BY grp ORDER BY l DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(l) OVER (PARTITION BY grp) AS total FROM src)"
NXS = f"{ORDERED} SELECT grp, " + ", ".join(f"max(l) FILTER (WHERE upto * 100 >= total * {s}) AS n{s}, min(i) FILTER (WHERE upto * 100 >= total * {s}) AS l{s}" for s in (10, 25, 50, 75, 90)) + ", CAST(max(total) AS BIGINT) AS total, count(*) AS n, max(l) AS longest, min(l) AS shortest FROM o GROUP BY grp"
CONSISTENCY = """rd AS (SELECT l_orderkey AS read, l_suppkey % 40 AS site, max(l_partkey) % 2 AS allele FROM lineitem GROUP BY 1, 2),
    lg AS (SELECT site, allele, lag(allele) OVER (PARTITION BY read ORDER BY site) AS b FROM rd), sc AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE allele <> b) AS inconsistent FROM lg WHERE b IS NOT NULL GROUP BY site)"""
CLAMPED = f"""{MEASURED}, n AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY pos) AS r FROM ms),
    w AS (SELECT contig, pos, cov, r, cov AS clamped FROM n WHERE r = 1 UNION ALL SELECT n.contig, n.pos, n.cov, n.r, CASE WHEN (w.clamped > 100 AND n.cov > 5 * w.clamped) OR n.cov > 5000 THEN w.clamped ELSE n.cov END FROM w JOIN n ON n.contig = w.contig AND n.r = w.r + 1)"""
SQL = {
    "switch_error": f"""WITH {v.POSITIONS}, mk AS (SELECT ctg, pos, CAST(n_a + n_c > n_g + n_t AS INTEGER) AS hap FROM pstn WHERE n_a + n_c > n_g + n_t IS NOT NULL),
        gr AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY pos) - row_number() OVER (PARTITION BY ctg, hap ORDER BY pos) AS g FROM mk),
        st AS (SELECT ctg, hap, min(pos) AS s, max(pos) + 1 AS e, count(*) AS n FROM gr GROUP BY ctg, hap, g),
        lg AS (SELECT *, n >= 4 OR (n >= 2 AND e - s > 500) OR row_number() OVER w = 1 AS opens, s = max(s) OVER (PARTITION BY ctg) AS ends FROM st WINDOW w AS (PARTITION BY ctg ORDER BY s)),
        pt AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY ctg ORDER BY s) AS part FROM lg),
        sd AS (SELECT *, first_value(hap) OVER (PARTITION BY ctg, part ORDER BY s) AS side FROM pt),
        hd AS (SELECT *, CASE WHEN opens THEN coalesce(side <> lag(side) OVER (PARTITION BY ctg ORDER BY s), true) ELSE false END AS fresh FROM sd),
        bk AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY ctg ORDER BY s) AS block FROM hd),
        pr AS (SELECT coalesce(sum(n) FILTER (WHERE NOT (hap <> side AND ends)), 0) AS m, coalesce(sum(n) FILTER (WHERE hap <> side AND NOT ends), 0) AS x, coalesce(sum(n) FILTER (WHERE hap <> side AND ends), 0) AS t FROM bk GROUP BY ctg, block),
        tt AS (SELECT coalesce(sum(x) FILTER (WHERE m > 1), 0) AS switches, sum(CASE WHEN m > 1 THEN m ELSE 0 END + CASE WHEN t > 1 THEN t ELSE 0 END) AS markers FROM pr)
        SELECT CAST(switches AS BIGINT) AS switches, CAST(markers AS BIGINT) AS markers, round(100.0 * switches / nullif(markers, 0), 6) AS error FROM tt""",
    "pileup_depth": f"""WITH {v.RUNS}, r AS (SELECT tname AS contig, tpos, len FROM runs WHERE op IN ('M', '=', 'X') AND len > 0), ev AS (SELECT contig, tpos AS p, 1 AS x FROM r UNION ALL SELECT contig, tpos + len, -1 FROM r),
        c AS (SELECT contig, sum(sum(x)) OVER (PARTITION BY contig ORDER BY p) AS cov FROM ev GROUP BY contig, p) SELECT contig, CAST(any_value(b) AS BIGINT) AS bases, CAST(max(cov) AS BIGINT) AS deepest
        FROM c JOIN (SELECT contig, sum(len) AS b FROM r GROUP BY contig) USING (contig) GROUP BY contig""",
    "coverage_runs": f"WITH {COV} SELECT * FROM cr",
    "coverage_clamped": f"WITH RECURSIVE {CLAMPED} SELECT contig, pos, cov, clamped FROM w",
    "switch_argmin": f"WITH RECURSIVE {CLAMPED}, src AS (SELECT contig, pos AS s, pos + 1 AS e, clamped AS c FROM w), {_switch('src')}",
    "switch_argmin_measured": f"WITH {MEASURED}, src AS (SELECT contig, pos AS s, pos + 1 AS e, cov AS c FROM ms), {_switch('src')}",
    "islands": f"WITH {ISLANDS} SELECT * FROM isl",
    "small_run_absorption": f"""WITH {ISLANDS}, k AS (SELECT *, CASE WHEN n >= 2 OR row_number() OVER w = 1 THEN event_type END AS v FROM isl WINDOW w AS (PARTITION BY user_id ORDER BY first_id)),
        f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM k),
        g AS (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY user_id ORDER BY first_id) THEN 0 ELSE 1 END AS fresh FROM f),
        h AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY first_id) AS grp FROM g)
        SELECT user_id, any_value(t) AS event_type, min(first_id) AS first_id, max(last_id) AS last_id, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY user_id, grp""",
    "short_switch_scan": """WITH x AS (SELECT user_id, event_id, CAST(value > 20 AS INTEGER) AS hap FROM events), f AS (SELECT *, coalesce(CAST(hap <> lag(hap) OVER w AS INTEGER), 0) AS flip FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        g AS (SELECT *, sum(1 - flip) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, g) AS n FROM g WHERE flip = 1)
        SELECT user_id, event_id, CASE WHEN k < n THEN 'short' ELSE 'long' END AS kind FROM k WHERE k % 2 = 1""",
    "moving_average": f"""WITH {MEASURED}, a AS (SELECT contig AS ctg, pos, avg(cov) OVER w AS average, count(*) OVER w AS n FROM ms WINDOW w AS (PARTITION BY contig ORDER BY pos ROWS 4 PRECEDING)) SELECT ctg, pos, round(average, 6) AS average FROM a WHERE n = 5""",
    "breakpoint_midpoint": f"WITH {v.POSITIONS} SELECT ctg, pos, (lag(pos, 1, 0) OVER (PARTITION BY ctg ORDER BY pos) + pos) // 2 AS midpoint FROM pstn WHERE is_var = 1",
    **dict.fromkeys(("pivot_sites", "pivot_sites_whole"), "SELECT user_id, " + ", ".join(f"min(event_type) FILTER (WHERE day(ts) = {k}) AS day{k}" for k in range(1, 32)) + " FROM events GROUP BY user_id"),
    "exact_percentile": f"""WITH {MEASURED}, r AS (SELECT contig AS ctg, cov, row_number() OVER (PARTITION BY contig ORDER BY cov) - 1 AS i, count(*) OVER (PARTITION BY contig) AS n FROM ms)
        SELECT ctg, cov, n FROM r WHERE i = greatest(0, CAST(floor(n * 0.9) AS BIGINT) - 1)""",
    "n50": f"WITH src AS (SELECT 'all' AS grp, length AS l FROM fai), {NXS}",
    "n50_by_strand": f"WITH {v.HITS}, src AS (SELECT strand AS grp, qend - qstart AS l FROM hits), {NXS}",
    "ng50": f"WITH src AS (SELECT 'all' AS grp, length AS l FROM fai), {NX} SELECT grp, max(l) FILTER (WHERE upto * 2 >= 1000000000) AS ng50 FROM u GROUP BY grp",
    "hamming": f"WITH {v.POSITIONS} SELECT ctg, round(100.0 * sum(least(n_a, n_c)) / nullif(sum(n_a) + sum(n_c), 0), 6) AS error FROM pstn GROUP BY ctg",
    "majority_phase_error": f"""WITH {v.POSITIONS}, p AS (SELECT count(*) FILTER (WHERE is_var = 0) AS z, count(*) FILTER (WHERE is_var = 1) AS o FROM pstn WHERE is_var IS NOT NULL GROUP BY ctg)
        SELECT count(*) AS n_groups, CAST(sum(greatest(z, o)) AS BIGINT) AS agreeing, CAST(sum(least(z, o)) AS BIGINT) AS errors FROM p""",
    "site_consistency": f"WITH {CONSISTENCY} SELECT * FROM sc",
    "breakpoints": f"WITH {CONSISTENCY} SELECT * FROM sc WHERE n >= 10 AND inconsistent >= ceil(n * 0.5)",
}
