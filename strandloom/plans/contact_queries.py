"""Contacts between segments, from filters of read pairs to labels of haplotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import contacts as ct
from strandloom.operators import coverage as cv
from strandloom.operators import kernels, metrics, sites
from strandloom.plans import views as v
from strandloom.records import table
from strandloom.session import written


def _mates(spark: SparkSession, d: str) -> DataFrame:
    return ct.pair_up(v.alignments(spark, d).select("read", "seg", "tid", "pos", "endpos"), "read", "seg")


def _sited(spark: SparkSession, d: str) -> DataFrame:
    return sites.first_site(v.alignments(spark, d), v.sites(spark, d), key=["read", "seg"], contig="tid", start="pos", end="endpos", site_contig="tid", width=256).withColumn("site", sites.spans_site("pos"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return ct.contact_matrix(_mates(spark, d), "tid1", "tid2")


def pair_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    return _mates(spark, d).select("read", "tid1", "tid2", (F.col("pos2") - F.col("pos1")).alias("apart"))


def contact_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


def classified_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ct.pair_up(_sited(spark, d).withColumn("c", ct.mate_class(F.col("site"), F.col("mapq"), F.col("nm"))).select("read", "seg", "tid", "c"), "read", "seg").select(
        "read", "tid1", "tid2", ct.pair_class(F.col("c1"), F.col("c2")).alias("pair_class")
    )


def contacts_filtered_quality(spark: SparkSession, d: str) -> DataFrame:
    return ct.contact_matrix(classified_pairs(spark, d).where("pair_class != 0"), "tid1", "tid2")


def contacts_by_choice(spark: SparkSession, d: str) -> DataFrame:
    x = _sited(spark, d).withColumn("mate", F.col("seg") % 2 + 1).withColumn("good", (F.col("mapq") > 10) & (F.col("nm") < 5))
    chosen = ct.choose_mate(x, "read", "mate", "seg").select("read", "mate", F.col("chosen").alias("seg"))
    return ct.contact_matrix(ct.pair_up(x.join(chosen, ["read", "mate", "seg"]).select("read", "mate", "tid"), "read", "mate"), "tid1", "tid2")


def porec_contacts(spark: SparkSession, d: str) -> DataFrame:
    kept = _sited(spark, d).where(ct.keeps_multi_contact(F.col("site"), F.col("mapq"), F.col("nm")))
    return ct.multi_contacts(kept, "read", "tid")


def multiway_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ct.multi_contacts(v.alignments(spark, d), "read", "tid")


def link_contacts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_quantity >= 10").select((F.col("l_suppkey") % 100).alias("s1"), (F.col("l_partkey") % 100).alias("s2"), F.col("l_quantity").cast("long").alias("w"))
    return ct.contact_matrix(x, "s1", "s2", "w")


def scaffold_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in debt stand for segments without a scaffold."""
    mapping = table(spark, d, "supplier").where("s_acctbal >= 0").select("s_suppkey", F.col("s_nationkey").alias("scaffold"))
    return ct.mapped_contacts(_mates(spark, d), "tid1", "tid2", mapping, "s_suppkey", "scaffold")


def total_contacts(spark: SparkSession, d: str) -> DataFrame:
    return ct.contact_totals(_matrix(spark, d))


def block_votes(spark: SparkSession, d: str) -> DataFrame:
    return ct.block_sums(_matrix(spark, d), v.segment_pairs(spark, d))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return v.segment_pairs(spark, d).withColumn("label", ((F.col("grp") + F.col("idx")) % 2).cast("int"))


def pair_score(spark: SparkSession, d: str) -> DataFrame:
    return ct.pair_scores(block_votes(spark, d), _labels(spark, d).select("grp", "idx", "label"))


def objective(spark: SparkSession, d: str) -> DataFrame:
    return ct.objective(pair_score(spark, d))


def low_count_mask(spark: SparkSession, d: str) -> DataFrame:
    return ct.masked_blocks(_matrix(spark, d), v.segment_pairs(spark, d), 5)


def block_normalise(spark: SparkSession, d: str) -> DataFrame:
    return ct.normalised_blocks(_matrix(spark, d), v.segment_pairs(spark, d)).withColumn("share", F.round("share", 6))


def link_eval(spark: SparkSession, d: str) -> DataFrame:
    side = table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("segment"), (F.col("s_nationkey") % 2).alias("hap"))
    p = v.segment_pairs(spark, d)
    members = p.select(F.explode(F.array("a", "b")).alias("segment"), "grp", F.col("idx").alias("pair"))
    return ct.contact_eval(_matrix(spark, d), side, members)


def _switches(spark: SparkSession, d: str) -> DataFrame:
    """In the middle of what aligns to each segment, for those with no fewer alignments than the mean."""
    per = v.alignments(spark, d).groupBy(F.col("tid").alias("segment")).agg(F.floor(F.avg("pos")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return per.where(F.col("n") >= per.agg(F.avg("n")).scalar()).drop("n")


def both_side_semi(spark: SparkSession, d: str) -> DataFrame:
    return ct.both_have(v.segment_pairs(spark, d), _switches(spark, d))


def switch_votes(spark: SparkSession, d: str) -> DataFrame:
    return ct.switch_kinds(ct.sided_contacts(_mates(spark, d), _switches(spark, d)), _labels(spark, d))


def local_search_labels(spark: SparkSession, d: str) -> DataFrame:
    return kernels.phase_labels(block_votes(spark, d), v.segment_pairs(spark, d))


def regroup_labels(spark: SparkSession, d: str) -> DataFrame:
    """All pairs as one group of scaffolds, weak blocks masked, labels starting at 0."""
    p = v.segment_pairs(spark, d).select(F.lit("all").alias("grp"), (F.col("grp") * 5 + F.col("idx")).alias("idx"), "a", "b")
    return kernels.phase_labels(ct.block_sums(ct.masked_blocks(_matrix(spark, d), p, 5), p), p, seed=1000, start=0, split=True)


def haplotypes(spark: SparkSession, d: str) -> DataFrame:
    return kernels.haplotypes(local_search_labels(spark, d))


def reachable(spark: SparkSession, d: str) -> DataFrame:
    """From every segment that has a strong contact, in the operator's 30 steps."""
    edges = written(_matrix(spark, d).where("n >= 3 and t1 != t2").select(F.col("t1").alias("src"), F.col("t2").alias("dst")))
    return kernels.reachable(edges, edges.select("src").distinct())


def reachable_whole(spark: SparkSession, d: str) -> DataFrame:
    """Alias of :func:`reachable`."""
    return reachable(spark, d)


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    x = _sited(spark, d).withColumn("mate", F.col("seg") % 2 + 1).withColumn("good", (F.col("mapq") > 10) & (F.col("nm") < 5))
    return ct.choice_pairs(x.select("read", "mate", "seg", "tid", "pos", F.col("endpos").alias("end")), ct.choose_mate(x, "read", "mate", "seg"), "read", "mate", "seg")


def choice_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by pairs within a segment whose first mate was chosen by its quality."""
    pairs = _chosen(spark, d).where("not by_site1 and tid1 = tid2")
    return cv.coverage_runs(cv.pair_deltas(pairs, "tid1")).select("contig", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "cov")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as links between nations."""
    n = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("ctg1"), F.col("l_orderkey").alias("pos1"), n.alias("len1"), (F.col("l_partkey") % 25).alias("ctg2"), (F.col("l_orderkey") + F.col("l_partkey") % 7 - 3).alias("pos2"), (n + 5).alias("len2")
    )


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where("n_regionkey != 0").select(F.col("n_nationkey").cast("long").alias("name"))


def link_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each contig by the links that have both ends on it."""
    x = ct.named_links(_links(spark, d), _known(spark, d)).where("ctg1 = ctg2")
    pairs = x.select("ctg1", "pos1", (F.col("pos1") + F.col("len1")).alias("end1"), "pos2", (F.col("pos2") + F.col("len2")).alias("end2"))
    return cv.coverage_runs(cv.pair_deltas(pairs, "ctg1")).select("contig", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "cov")


def link_report(spark: SparkSession, d: str) -> DataFrame:
    return ct.link_report(_links(spark, d), _known(spark, d))


def porec_scaffold_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of reads of many segments, counted between scaffolds (nations)."""
    mapping = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_nationkey").alias("scaffold"))
    return ct.multi_contacts(v.alignments(spark, d).join(mapping, "tid"), "read", "scaffold")


def _markers(spark: SparkSession, d: str) -> DataFrame:
    """Returned and accepted order lines as the markers of either parent."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("segment"))
    return x.agg(F.count_if(F.col("l_returnflag") == "A").alias("n1"), F.count_if(F.col("l_returnflag") == "R").alias("n2"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return v.segment_pairs(spark, d).select(F.explode(F.array("a", "b")).alias("segment"), "grp", F.col("idx").alias("pair"))


def phase_eval(spark: SparkSession, d: str) -> DataFrame:
    p = v.segment_pairs(spark, d).select("grp", F.col("a").alias("hap0"), F.col("b").alias("hap1"))
    return metrics.phase_eval(p, _markers(spark, d)).withColumn("error", F.round("error", 6))


def contact_classes(spark: SparkSession, d: str) -> DataFrame:
    mates = ct.pair_up(v.alignments(spark, d).select("read", "seg", "tid", "mapq", "nm"), "read", "seg")
    return ct.contact_classes(mates, _members(spark, d), ct.hap_sides(_markers(spark, d), tie=-1))


def link_classes(spark: SparkSession, d: str) -> DataFrame:
    """Links of lines of at least ten pieces, by the verdict on them."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ctg1"), F.col("l_quantity").alias("len1"), (F.col("l_partkey") % 100).alias("ctg2"), F.col("l_quantity").alias("len2"))
    members = v.segment_pairs(spark, d).select(F.explode(F.array("a", "b")).alias("segment"), F.col("a").alias("pair"))
    return ct.judged_links(x, members, ct.hap_sides(_markers(spark, d)), least=10).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    pair_selfjoin, contact_matrix, classified_pairs, contacts_filtered_quality, contacts_by_choice, porec_contacts, multiway_pairs, link_contacts, scaffold_contacts, total_contacts,
    block_votes, pair_score, objective, low_count_mask, block_normalise, link_eval, both_side_semi, switch_votes, local_search_labels, regroup_labels, haplotypes, reachable, reachable_whole,
    choice_coverage, link_coverage, link_report, porec_scaffold_contacts, phase_eval, contact_classes, link_classes,
)}

CLASS = f"""{v.SITED}, cls AS (SELECT read, seg, tid, CASE WHEN coalesce(first_site > pos, false) THEN 2 WHEN mapq > 10 AND nm < 5 THEN 1 ELSE 0 END AS c FROM sited),
    cp AS (SELECT a.read, a.tid AS tid1, b.tid AS tid2, CASE WHEN a.c = 0 OR b.c = 0 THEN 0 WHEN a.c = 2 AND b.c = 2 THEN 2 ELSE 1 END AS pair_class FROM cls a JOIN cls b ON a.read = b.read AND a.seg = 1 AND b.seg = 2)"""
BLOCKS = f"""{v.MATRIX}, {v.PAIRS}, side AS (SELECT grp, idx, a AS s, 0 AS h FROM prs UNION ALL SELECT grp, idx, b, 1 FROM prs),
    blk AS (SELECT x.grp, x.idx AS i, y.idx AS j, CAST(sum(CASE WHEN x.h = y.h THEN n ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN x.h <> y.h THEN n ELSE 0 END) AS BIGINT) AS cross_n
        FROM mat JOIN side x ON x.s = t1 JOIN side y ON y.s = t2 AND y.grp = x.grp WHERE x.idx <> y.idx GROUP BY 1, 2, 3)"""
SCORES = f"""{BLOCKS}, lb AS (SELECT grp, idx, (grp + idx) % 2 AS label FROM prs),
    pc AS (SELECT b.grp, b.i, CASE WHEN x.label = y.label THEN same ELSE cross_n END AS pro, CASE WHEN x.label = y.label THEN cross_n ELSE same END AS con
        FROM blk b JOIN lb x ON x.grp = b.grp AND x.idx = b.i JOIN lb y ON y.grp = b.grp AND y.idx = b.j),
    sc AS (SELECT grp, i AS idx, CAST(sum(pro) AS BIGINT) AS consistent, CAST(sum(con) AS BIGINT) AS inconsistent, count(*) FILTER (WHERE pro > con) AS votes_for, count(*) FILTER (WHERE pro < con) AS votes_against,
        count(*) FILTER (WHERE pro = con AND pro > 0) AS ties FROM pc GROUP BY grp, i)"""
CELLS = f"{v.MATRIX}, {v.PAIRS}, side AS (SELECT grp, idx, a AS s FROM prs UNION ALL SELECT grp, idx, b FROM prs), cells AS (SELECT t1, t2, n, x.grp AS g1, x.idx AS i, y.grp AS g2, y.idx AS j FROM mat JOIN side x ON x.s = t1 JOIN side y ON y.s = t2)"
SWITCHES = "sw AS (SELECT tid AS segment, CAST(floor(avg(pos)) AS BIGINT) AS pos FROM aln GROUP BY tid HAVING count(*) >= (SELECT count(*) / count(DISTINCT tid) FROM aln))"
WAYS = "SELECT t1, t2, count(*) AS n FROM (SELECT x.tid AS t1, y.tid AS t2 FROM k x JOIN k y ON x.read = y.read AND x.seg <> y.seg) GROUP BY t1, t2"
REACH = f"""WITH RECURSIVE {v.MATRIX}, e AS (SELECT t1 AS src, t2 AS dst FROM mat WHERE n >= 3 AND t1 <> t2),
    w AS (SELECT DISTINCT src, src AS dst, 0 AS steps FROM e UNION SELECT w.src, e.dst, w.steps + 1 FROM w JOIN e ON e.src = w.dst WHERE w.steps < 30)
    SELECT src, dst, min(steps) AS steps FROM w GROUP BY src, dst HAVING min(steps) > 0"""
LINKS = """lk AS (SELECT l_suppkey % 25 AS ctg1, l_orderkey AS pos1, CAST(l_quantity AS BIGINT) AS len1, l_partkey % 25 AS ctg2, l_orderkey + l_partkey % 7 - 3 AS pos2, CAST(l_quantity AS BIGINT) + 5 AS len2 FROM lineitem),
    kn AS (SELECT n_nationkey AS name FROM nation WHERE n_regionkey <> 0)"""
COVERED = """ev AS (SELECT contig, lo AS pos, 1 AS delta FROM m UNION ALL SELECT contig, hi, -1 FROM m), nz AS (SELECT contig, pos, sum(delta) AS delta FROM ev GROUP BY contig, pos HAVING sum(delta) <> 0)
    SELECT contig, run_start, run_end, CAST(cov AS BIGINT) AS cov FROM (SELECT contig, pos AS run_start, lead(pos) OVER w AS run_end, sum(delta) OVER w AS cov FROM nz WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE run_end IS NOT NULL"""
MARKERS = "mk AS (SELECT l_suppkey AS segment, count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2 FROM lineitem GROUP BY l_suppkey)"
MORE = """SELECT l_orderkey AS read, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seg, l_tax < 0.04 AS prim, CAST(floor(l_extendedprice / 100) AS BIGINT) AS score FROM lineitem"""
CHOICE = f"""{v.SITED}, more AS ({MORE}), x AS (SELECT read, seg, tid, pos, endpos, seg % 2 + 1 AS mate, coalesce(first_site > pos, false) AS site, (mapq > 10 AND nm < 5) AS good, prim, score FROM sited JOIN more USING (read, seg)),
    f AS (SELECT *, min(CASE WHEN prim AND (site OR good) THEN seg END) OVER (PARTITION BY read, mate) AS final FROM x),
    t AS (SELECT read, mate, final, list({{'o': seg, 'site': site, 'good': good, 'score': score}} ORDER BY seg) AS rows FROM f WHERE final IS NULL GROUP BY ALL),
    c AS (SELECT DISTINCT read, mate, final AS seg FROM f WHERE final IS NOT NULL UNION ALL
        SELECT read, mate, coalesce(list_filter(rows, lambda r: r.site AND r.score = list_max(list_transform(list_filter(rows, lambda q: q.site), lambda q: q.score)))[1].o, list_filter(rows, lambda r: r.good)[1].o) FROM t),
    p AS (SELECT x.* FROM c JOIN x ON x.read = c.read AND x.mate = c.mate AND x.seg = c.seg)"""
SQL = {
    "pair_selfjoin": f"WITH {v.ALN} SELECT a.read, a.tid AS tid1, b.tid AS tid2, b.pos - a.pos AS apart FROM aln a JOIN aln b ON a.read = b.read AND a.seg = 1 AND b.seg = 2",
    "contact_matrix": f"WITH {v.MATRIX} SELECT * FROM mat",
    "classified_pairs": f"WITH {CLASS} SELECT * FROM cp",
    "contacts_filtered_quality": f"WITH {CLASS}, f AS (SELECT * FROM cp WHERE pair_class <> 0) SELECT t1, t2, count(*) AS n FROM (SELECT tid1 AS t1, tid2 AS t2 FROM f UNION ALL SELECT tid2, tid1 FROM f) GROUP BY t1, t2",
    "porec_contacts": f"WITH {v.SITED}, k AS (SELECT * FROM sited WHERE (mapq >= 10 AND nm < 5) OR (mapq < 10 AND coalesce(first_site > pos, false))) {WAYS}",
    "multiway_pairs": f"WITH {v.ALN}, k AS (SELECT * FROM aln) {WAYS}",
    "link_contacts": """WITH x AS (SELECT l_suppkey % 100 AS s1, l_partkey % 100 AS s2, CAST(l_quantity AS BIGINT) AS w FROM lineitem WHERE l_quantity >= 10)
        SELECT t1, t2, CAST(sum(w) AS BIGINT) AS n FROM (SELECT s1 AS t1, s2 AS t2, w FROM x UNION ALL SELECT s2, s1, w FROM x) GROUP BY t1, t2""",
    "scaffold_contacts": f"""WITH {v.ALN}, {v.MATES}, m AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal >= 0), x AS (SELECT p.s_nationkey AS s1, q.s_nationkey AS s2 FROM mates JOIN m p ON p.s_suppkey = tid1 JOIN m q ON q.s_suppkey = tid2)
        SELECT t1, t2, count(*) AS n FROM (SELECT s1 AS t1, s2 AS t2 FROM x UNION ALL SELECT s2, s1 FROM x) GROUP BY t1, t2""",
    "total_contacts": f"""WITH {v.MATRIX} SELECT CAST(coalesce(sum(m.n) FILTER (WHERE m.t1 <> m.t2), 0) AS BIGINT) AS off_diagonal, CAST(coalesce(sum(m.n) FILTER (WHERE m.t1 = m.t2), 0) AS BIGINT) AS diagonal,
        count(*) FILTER (WHERE coalesce(r.n, 0) <> m.n) AS asymmetric FROM mat m LEFT JOIN mat r ON r.t1 = m.t2 AND r.t2 = m.t1""",
    "block_votes": f'WITH {BLOCKS} SELECT grp, i, j, same, cross_n AS "cross" FROM blk',
    "pair_score": f"WITH {SCORES} SELECT * FROM sc",
    "objective": f"WITH {SCORES} SELECT grp, CAST(sum(votes_for) AS BIGINT) AS score FROM sc GROUP BY grp",
    "low_count_mask": f"WITH {CELLS} SELECT t1, t2, n FROM (SELECT *, max(n) OVER (PARTITION BY g1, i, g2, j) AS top FROM cells) WHERE top >= 5",
    "block_normalise": f"""WITH {CELLS} SELECT t1, t2, n, round(n / (block + 1e-6), 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY g1, i, g2, j) AS block FROM cells WHERE NOT (g1 = g2 AND i = j))""",
    "link_eval": f"""WITH {CELLS}, hp AS (SELECT s_suppkey, s_nationkey % 2 AS hap FROM supplier WHERE s_acctbal >= 0),
        x AS (SELECT n, p.hap AS h1, q.hap AS h2 FROM cells LEFT JOIN hp p ON p.s_suppkey = t1 LEFT JOIN hp q ON q.s_suppkey = t2 WHERE g1 = g2 AND i <> j)
        SELECT CAST(coalesce(sum(n) FILTER (WHERE h1 = h2), 0) AS BIGINT) AS correct, CAST(coalesce(sum(n) FILTER (WHERE h1 <> h2), 0) AS BIGINT) AS incorrect,
        CAST(coalesce(sum(n) FILTER (WHERE h1 IS NULL OR h2 IS NULL), 0) AS BIGINT) AS unknown FROM x""",
    "both_side_semi": f"""WITH {v.ALN}, {v.PAIRS}, {SWITCHES}, b AS (SELECT a, b FROM prs WHERE a IN (SELECT segment FROM sw) AND b IN (SELECT segment FROM sw))
        SELECT segment, pos FROM sw WHERE segment IN (SELECT a FROM b UNION ALL SELECT b FROM b)""",
    "switch_votes": f"""WITH {v.ALN}, {v.MATES}, {v.PAIRS}, {SWITCHES}, x AS (SELECT m.*, p.pos AS s1, q.pos AS s2 FROM mates m LEFT JOIN sw p ON p.segment = tid1 LEFT JOIN sw q ON q.segment = tid2 WHERE tid1 <> tid2 AND (p.pos IS NOT NULL OR q.pos IS NOT NULL)),
        sided AS (SELECT CASE WHEN s1 IS NOT NULL THEN tid1 ELSE tid2 END AS segment, CASE WHEN s1 IS NOT NULL THEN tid2 ELSE tid1 END AS other, CASE WHEN s1 IS NOT NULL THEN pos1 < s1 ELSE pos2 < s2 END AS head FROM x),
        side AS (SELECT grp, idx, (grp + idx) % 2 AS label, a AS s, 0 AS h FROM prs UNION ALL SELECT grp, idx, (grp + idx) % 2, b, 1 FROM prs),
        vt AS (SELECT o.grp, o.idx AS i, t.idx AS j, head, sign(sum(CASE WHEN (o.h = t.h) = (o.label = t.label) THEN 1 ELSE -1 END)) AS m FROM sided JOIN side o ON o.s = segment JOIN side t ON t.s = other AND t.grp = o.grp WHERE o.idx <> t.idx GROUP BY ALL),
        sm AS (SELECT grp, i AS idx, coalesce(sum(m) FILTER (WHERE head), 0) AS hs, coalesce(sum(m) FILTER (WHERE NOT head), 0) AS ts FROM vt GROUP BY grp, i)
        SELECT grp, idx, CASE WHEN hs > 0 THEN 'F' ELSE 'S' END AS kind FROM sm WHERE (hs > 0 AND ts < 0) OR (hs < 0 AND ts > 0)""",
    "reachable": REACH, "reachable_whole": REACH,
    "contacts_by_choice": f"WITH {CHOICE}, m AS (SELECT a.tid AS s1, b.tid AS s2 FROM p a JOIN p b ON a.read = b.read AND a.mate = 1 AND b.mate = 2) SELECT t1, t2, count(*) AS n FROM (SELECT s1 AS t1, s2 AS t2 FROM m UNION ALL SELECT s2, s1 FROM m) GROUP BY t1, t2",
    "choice_coverage": f"""WITH {CHOICE}, m AS (SELECT a.tid AS contig, CASE WHEN a.pos < b.pos THEN a.pos ELSE b.pos END AS lo, CASE WHEN a.pos < b.pos THEN b.endpos ELSE a.endpos END AS hi FROM p a JOIN p b ON a.read = b.read AND a.mate = 1 AND b.mate = 2 WHERE a.tid = b.tid AND NOT a.site),
        {COVERED}""",
    "link_coverage": f"""WITH {LINKS}, m AS (SELECT ctg1 AS contig, CASE WHEN pos1 < pos2 THEN pos1 ELSE pos2 END AS lo, CASE WHEN pos1 < pos2 THEN pos2 + len2 ELSE pos1 + len1 END AS hi FROM lk WHERE ctg1 = ctg2 AND ctg1 IN (SELECT name FROM kn)), {COVERED}""",
    "link_report": f"WITH {LINKS}, c AS (SELECT count(*) AS links, count(*) FILTER (WHERE ctg1 IN (SELECT name FROM kn) AND ctg2 IN (SELECT name FROM kn)) AS kept FROM lk) SELECT links, kept, links - kept AS dropped FROM c",
    "porec_scaffold_contacts": f"WITH {v.ALN}, k AS (SELECT read, seg, s_nationkey AS tid FROM aln JOIN supplier ON s_suppkey = tid) {WAYS}",
    "phase_eval": f"""WITH {MARKERS}, {v.PAIRS}, e AS (SELECT grp, 0 AS hap, a AS segment FROM prs UNION ALL SELECT grp, 1, b FROM prs),
        g AS (SELECT hap, grp, count(*) FILTER (WHERE n1 > n2) AS p, count(*) FILTER (WHERE n1 < n2) AS m FROM e JOIN mk USING (segment) GROUP BY hap, grp)
        SELECT hap, CAST(sum(greatest(p, m)) AS BIGINT) AS correct, CAST(sum(least(p, m)) AS BIGINT) AS incorrect, round(100.0 * sum(least(p, m)) / sum(p + m), 6) AS error FROM g WHERE p <> m GROUP BY hap""",
    "contact_classes": f"""WITH {v.ALN}, {MARKERS}, {v.PAIRS}, mb AS (SELECT grp, idx, a AS s FROM prs UNION ALL SELECT grp, idx, b FROM prs), sd AS (SELECT segment, CASE WHEN n1 + n2 = 0 THEN 0 WHEN n1 > n2 THEN 1 ELSE -1 END AS h FROM mk),
        m AS (SELECT x.tid AS t1, y.tid AS t2, x.mapq < 10 OR y.mapq < 10 OR x.nm >= 5 OR y.nm >= 5 AS weak FROM aln x JOIN aln y ON x.read = y.read AND x.seg = 1 AND y.seg = 2),
        j AS (SELECT weak, p.h AS h1, q.h AS h2 FROM m JOIN mb a ON a.s = t1 JOIN mb b ON b.s = t2 AND b.grp = a.grp AND b.idx <> a.idx LEFT JOIN sd p ON p.segment = t1 LEFT JOIN sd q ON q.segment = t2)
        SELECT (SELECT count(*) FROM m) AS total, count(*) FILTER (WHERE coalesce(h1 * h2 >= 0, true)) AS correct, count(*) FILTER (WHERE h1 * h2 < 0) AS incorrect, count(*) FILTER (WHERE h1 * h2 IS NULL) AS unknown,
        count(*) FILTER (WHERE h1 = 0 AND h2 = 0) AS zero, count(*) FILTER (WHERE h1 * h2 >= 0 AND weak) AS snp_correct, count(*) FILTER (WHERE h1 * h2 < 0 AND weak) AS snp_incorrect FROM j""",
    "link_classes": f"""WITH {MARKERS}, {v.PAIRS}, mb AS (SELECT a AS pair, a AS s FROM prs UNION ALL SELECT a, b FROM prs), sd AS (SELECT segment, sign(n1 - n2) AS h FROM mk),
        l AS (SELECT l_suppkey AS t1, l_partkey % 100 AS t2 FROM lineitem WHERE l_quantity >= 10)
        SELECT CASE WHEN p.h * q.h IS NULL THEN 'unknown' WHEN p.h * q.h >= 0 THEN 'correct' ELSE 'incorrect' END AS verdict, count(*) AS n
        FROM l JOIN mb a ON a.s = t1 JOIN mb b ON b.s = t2 AND b.pair <> a.pair LEFT JOIN sd p ON p.segment = t1 LEFT JOIN sd q ON q.segment = t2 GROUP BY 1""",
}
