"""Two haplotypes cut alike, what overlaps among the pieces, and regions merged again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import region
from strandloom.operators import dual
from strandloom.plans import views as v
from strandloom.session import written

LEAST = 20


def replaced_pieces(spark: SparkSession, d: str) -> DataFrame:
    return dual.replaced(v.hits(spark, d), LEAST)


def dual_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return dual.overlap_summary(replaced_pieces(spark, d), ["paf_id", "piece"])


def run_threshold(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(dual.run_threshold(v.hits(spark, d), 50, least=10)).cast("long").alias("threshold"))


def chained_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Cut at the runs longer than half of all."""
    h = written(v.hits(spark, d))
    return dual.chained(h, dual.run_threshold(h, 50, least=10)).select("paf_id", "piece", "qname", "qstart", "qend", "tname", "tstart", "tend")


def dual_regions(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d)
    queries = h.groupBy(F.col("qname").alias("name")).agg(F.max("qlen").alias("length"))
    out = dual.cut_both(written(replaced_pieces(spark, d)), v.contigs(spark, d), queries)
    return out.select("hap", "kind", "contig", F.col("start").alias("from_base"), F.col("end").alias("to_base"))


def _thirds(spark: SparkSession, d: str) -> DataFrame:
    """Each query's best alignment cut into three on both sides, as finely cut haplotypes: a, b, strand, at, tname, ts, te, qs, qe."""
    p = v.placed(spark, d)
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    at = lambda lo, hi, n: F.col(lo) + F.floor((F.col(hi) - F.col(lo)) * n / 3)
    x = p.where("tend - tstart >= 3 and qend - qstart >= 3").select("*", k)
    back = F.col("strand") == "-"
    j = F.when(back, 2 - F.col("k")).otherwise(F.col("k"))
    x = x.select(
        "paf_id", "k", "strand", "tname", "qname", at("tstart", "tend", F.col("k")).alias("ts"), at("tstart", "tend", F.col("k") + 1).alias("te"),
        at("qstart", "qend", j).alias("qs"), at("qstart", "qend", j + 1).alias("qe"),
    )
    return x.select("*", region("tname", "ts", "te").alias("a"), region("qname", "qs", "qe").alias("b"), (F.col("paf_id") * 3 + F.col("k")).alias("at"))


def _on_targets(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = x.select(F.col("a").alias("segment"), F.lit("+").alias("strand"), F.lit(0).cast("long").alias("qstart"), (F.col("te") - F.col("ts")).alias("qend"), "tname", F.col("ts").alias("tstart"))
    second = x.select(F.col("b").alias("segment"), "strand", F.lit(0).cast("long").alias("qstart"), (F.col("qe") - F.col("qs")).alias("qend"), "tname", F.col("ts").alias("tstart"))
    return first, second


def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the second haplotype that follow each other on a target, as one region."""
    return dual.merged_regions(_on_targets(_thirds(spark, d))[1])


def merged_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = written(_thirds(spark, d))
    return dual.merge_pairs(x.select("a", "b", "strand", "at"), *_on_targets(x))


QUERIES = {f.__name__: f for f in (replaced_pieces, dual_overlaps, run_threshold, chained_pieces, dual_regions, merged_segments, merged_pairs)}


def _pieces(source: str, least: str) -> str:
    """SQL that cuts the alignments of ``source`` at equal runs: the runs of each in order, then cut by cut."""
    return f"""lr AS (SELECT paf_id, qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, list({{'q': qpos - qstart, 't': tpos, 'n': len}} ORDER BY run_no) AS r
            FROM runs WHERE paf_id IN (SELECT paf_id FROM {source}) AND op IN ('=', 'M') AND len >= {least} AND len <> qlen GROUP BY ALL),
        cu AS (SELECT paf_id, 0 AS k, CAST(0 AS HUGEINT) AS q, CAST(tstart AS HUGEINT) AS t, CAST([] AS STRUCT(a HUGEINT, b HUGEINT, c HUGEINT, d HUGEINT)[]) AS o FROM lr UNION ALL
            SELECT paf_id, k + 1, CASE WHEN ok THEN x.q + x.n ELSE q END, CASE WHEN ok THEN x.t + x.n ELSE t END, CASE WHEN ok THEN list_append(o, {{'a': q, 'b': x.q, 'c': t, 'd': x.t}}) ELSE o END
            FROM (SELECT *, x.q - q >= {least} AND x.t - t >= {least} AS ok FROM (SELECT cu.*, r[k + 1] AS x FROM cu JOIN lr USING (paf_id) WHERE k < len(r)))),
        al AS (SELECT lr.*, CASE WHEN qend - qstart - q >= {least} AND tend - t >= {least} THEN list_append(o, {{'a': q, 'b': qend - qstart, 'c': t, 'd': tend}}) ELSE o END AS p
            FROM cu JOIN lr USING (paf_id) WHERE k = len(r) AND len(o) > 0),
        px AS (SELECT *, unnest(p) AS y, generate_subscripts(p, 1) - 1 AS piece FROM al),
        pc AS (SELECT paf_id, CAST(piece AS INTEGER) AS piece, qname, qlen, CAST(CASE WHEN strand = '-' THEN qend - y.b ELSE qstart + y.a END AS BIGINT) AS qstart, CAST(CASE WHEN strand = '-' THEN qend - y.a ELSE qstart + y.b END AS BIGINT) AS qend,
            strand, tname, tlen, CAST(y.c AS BIGINT) AS tstart, CAST(y.d AS BIGINT) AS tend FROM px)"""


LONG = f"lg AS (SELECT * FROM hits WHERE qend - qstart >= {3 * LEAST} AND tend - tstart >= {3 * LEAST})"
REPLACED = f"{v.RUNS}, {LONG}, {_pieces('lg', str(LEAST))}"
THRESHOLD = "th AS (SELECT coalesce((SELECT len FROM (SELECT len, row_number() OVER (ORDER BY len) - 1 AS i, count(*) OVER () AS n FROM runs WHERE op IN ('=', 'M') AND len <> qlen AND len >= 10) WHERE i = greatest(0, CAST(floor(n * 0.5) AS BIGINT) - 1)), 0) AS thr)"


def _side(side: str, name: str, s: str, e: str) -> str:
    x = f"(SELECT *, row_number() OVER () AS id FROM pc WHERE {s} < {e})"
    return f"""SELECT '{side}' AS side, (SELECT count(*) FROM pc WHERE {s} < {e}) AS pieces,
        (SELECT count(*) FROM pc x WHERE {s} < {e}) - (SELECT count(*) FROM (SELECT DISTINCT {name}, {s}, {e} FROM pc WHERE {s} < {e}) x WHERE NOT EXISTS
            (SELECT 1 FROM pc y WHERE y.{name} = x.{name} AND y.{s} <= x.{s} AND y.{e} >= x.{e} AND (y.{s} < x.{s} OR y.{e} > x.{e}))) AS contained,
        (SELECT count(*) FROM {x} x JOIN {x} y ON x.{name} = y.{name} AND x.id < y.id AND x.{s} < y.{e} AND y.{s} < x.{e}) AS overlapping"""


def _rest(hap: int, name: str, s: str, e: str, lengths: str) -> str:
    return f"""SELECT {hap} AS hap, 'dual' AS kind, {name} AS contig, {s} AS from_base, {e} AS to_base FROM pc WHERE 0 <= {s} AND {s} < {e} UNION ALL
        SELECT {hap}, 'collapsed', name, CAST(so_far AS BIGINT), CAST(least(s, length) AS BIGINT) FROM (SELECT name, length, s, coalesce(max(e) OVER (PARTITION BY name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
            FROM (SELECT name, length, {s} AS s, {e} AS e FROM pc JOIN {lengths} ON name = {name} WHERE 0 <= {s} AND {s} < {e} UNION ALL SELECT name, length, length, length FROM {lengths})) WHERE so_far < least(s, length)"""


SQL = {
    "replaced_pieces": f"WITH RECURSIVE {REPLACED} SELECT * FROM pc",
    "dual_overlaps": f"WITH RECURSIVE {REPLACED} {_side('target', 'tname', 'tstart', 'tend')} UNION ALL {_side('query', 'qname', 'qstart', 'qend')}",
    "run_threshold": f"WITH {v.RUNS}, {THRESHOLD} SELECT CAST(thr AS BIGINT) AS threshold FROM th",
    "chained_pieces": f"""WITH RECURSIVE {v.RUNS}, {THRESHOLD}, lg AS (SELECT * FROM hits, th WHERE qend - qstart >= 3 * thr AND tend - tstart >= 3 * thr),
        t1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tname, tstart, tend ORDER BY paf_id) AS z FROM lg x WHERE NOT EXISTS (SELECT 1 FROM lg y WHERE y.tname = x.tname AND ((y.tstart < x.tstart AND y.tend >= x.tend) OR (y.tstart = x.tstart AND y.tend > x.tend)))) WHERE z = 1),
        t2 AS (SELECT * FROM t1 WHERE paf_id IN (SELECT paf_id FROM runs, th WHERE op IN ('=', 'M') AND len >= thr AND len <> qlen)),
        t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname, qstart, qend ORDER BY paf_id) AS zz FROM t2 x WHERE NOT EXISTS (SELECT 1 FROM t2 y WHERE y.qname = x.qname AND ((y.qstart < x.qstart AND y.qend >= x.qend) OR (y.qstart = x.qstart AND y.qend > x.qend)))) WHERE zz = 1),
        {_pieces("t3", "(SELECT thr FROM th)")} SELECT paf_id, piece, qname, qstart, qend, tname, tstart, tend FROM pc""",
    "dual_regions": f"WITH RECURSIVE {REPLACED}, ql AS (SELECT qname AS name, max(qlen) AS length FROM hits GROUP BY qname) {_rest(1, 'tname', 'tstart', 'tend', 'fai')} UNION ALL {_rest(2, 'qname', 'qstart', 'qend', 'ql')}",
    "merged_segments": f"""WITH RECURSIVE {v.PLACED}, th AS (SELECT *, CASE WHEN strand = '-' THEN 2 - k ELSE k END AS j FROM placed, (VALUES (0), (1), (2)) n(k) WHERE tend - tstart >= 3 AND qend - qstart >= 3),
        sg AS (SELECT tname, strand, qname AS ctg, tstart + (tend - tstart) * k // 3 AS ts, qstart + (qend - qstart) * j // 3 AS s, qstart + (qend - qstart) * (j + 1) // 3 AS e FROM th),
        nm AS (SELECT *, ctg || ':' || s || '-' || e AS segment, row_number() OVER (ORDER BY tname, ts, ctg || ':' || s || '-' || e, strand, e - s) AS id FROM sg),
        lk AS (SELECT a.id, max(b.id) AS prev FROM nm a JOIN nm b ON a.tname = b.tname AND a.ctg = b.ctg AND a.strand = b.strand AND b.id < a.id AND (a.s = b.e OR a.e = b.s) GROUP BY a.id),
        sc AS (SELECT nm.id, nm.e - nm.s AS score FROM nm LEFT JOIN lk ON lk.id = nm.id WHERE prev IS NULL UNION ALL SELECT lk.id, sc.score + nm.e - nm.s FROM sc JOIN lk ON lk.prev = sc.id JOIN nm ON nm.id = lk.id),
        be AS (SELECT tname, id FROM (SELECT tname, nm.id, row_number() OVER (PARTITION BY tname ORDER BY score DESC, nm.id) AS r FROM nm JOIN sc USING (id)) WHERE r = 1),
        ch AS (SELECT tname, id FROM be UNION ALL SELECT ch.tname, prev FROM ch JOIN lk USING (id)),
        sp AS (SELECT tname, min(ctg) AS c, min(s) AS lo, max(e) AS hi FROM ch JOIN (SELECT id, ctg, s, e FROM nm) USING (id) GROUP BY tname)
        SELECT segment, min(c || ':' || lo || '-' || hi) AS merged FROM ch JOIN sp USING (tname) JOIN (SELECT id, segment FROM nm) USING (id) GROUP BY segment""",
}
