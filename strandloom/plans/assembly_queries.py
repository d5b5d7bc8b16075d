"""Placing, cutting, joining and lifting segments of an assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import region, revcomp
from strandloom.operators import assembly as asm
from strandloom.operators.prefix import number_within, running_sum
from strandloom.plans import views as v


def filter_alt(spark: SparkSession, d: str) -> DataFrame:
    return asm.filter_placements(v.placed(spark, d)).select("qname", "tname", "tstart", "tend", "qstart", "qend")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return asm.segments(v.placed(spark, d), v.contigs(spark, d))


def cut_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("kind", "contig", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "strand")


def segment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return asm.homologous_pairs(_segments(spark, d))


def cut_sequences(spark: SparkSession, d: str) -> DataFrame:
    out = asm.cut(_segments(spark, d), v.units(spark, d).select("name", "seq").where("name is not null"))
    return out.select("kind", "segment", F.md5("seq").alias("digest"))


def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    x = v.units(spark, d).withColumn("scaffold", F.floor(F.col("unit_id") / 10))
    return asm.ordered_concat(x, "scaffold", "unit_id", "seq").select("scaffold", F.md5("seq").alias("digest"), "n")


def _ordering(spark: SparkSession, d: str) -> DataFrame:
    """Units that a query is placed on are in a scaffold, the others in none."""
    gap = F.when(F.col("unit_id") % 3 == 0, ".").otherwise((F.col("unit_id") % 50).cast("string"))
    u = v.units(spark, d).join(v.placed(spark, d).select(F.col("tname").alias("name")).distinct(), "name", "left_semi")
    return u.select(F.floor(F.col("unit_id") / 20).alias("scaffold"), F.col("unit_id").alias("place"), "name", (F.col("unit_id") % 2).alias("rc"), gap.alias("gap"))


def scaffolds(spark: SparkSession, d: str) -> DataFrame:
    out = asm.scaffolds(_ordering(spark, d), v.units(spark, d))
    return out.select("scaffold", F.md5("seq").alias("digest"), F.length("seq").cast("long").alias("length"), "n")


def scaffold_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same scaffolds as rows: each contig's bases with its place and offset, for writers of any length."""
    out = asm.scaffold_parts(_ordering(spark, d), v.units(spark, d))
    return out.select("scaffold", "place", "offset", F.md5("seq").alias("digest"), "gap")


def leftover_contigs(spark: SparkSession, d: str) -> DataFrame:
    u = v.units(spark, d).where("name is not null")
    return asm.leftover(u, _ordering(spark, d), v.hits(spark, d).select(F.col("tname").alias("name")))


def _phasing(pairs: DataFrame) -> DataFrame:
    """A haplotype for each segment of a pair, by the parity of its name's digest."""
    even = F.md5("b") < "8"
    return pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("hap0"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("hap1"))


def _segment_switches(spark: SparkSession, d: str) -> DataFrame:
    """A switch in the middle of both segments of each pair whose names' digests agree on its kind."""
    kind = lambda c: F.when(F.md5(c) < "6", "F").when(F.md5(c) < "b", "S").otherwise("C")
    h = v.placed(spark, d).select(region("tname", "tstart", "tend").alias("a"), F.expr("(tend - tstart) div 2").alias("pa"), region("qname", "qstart", "qend").alias("b"), F.expr("(qend - qstart) div 2").alias("pb"))
    both = h.withColumn("kind", kind("a")).where(F.col("kind") == kind("b"))
    one = F.struct(F.col("a").alias("segment"), F.col("pa").alias("pos"), "kind")
    two = F.struct(F.col("b").alias("segment"), F.col("pb").alias("pos"), F.when(F.col("kind") == "C", "C").otherwise(F.translate("kind", "FS", "SF")).alias("kind"))
    return both.select(F.inline(F.array(one, two)))


def haplotype_layout(spark: SparkSession, d: str) -> DataFrame:
    segs = _segments(spark, d)
    out = asm.haplotype_layout(segs.where("kind != 'hap1'"), _phasing(asm.homologous_pairs(segs)), _segment_switches(spark, d))
    return out.select("hap", "contig", "place", "segment", F.col("start").alias("from_base"), F.col("end").alias("to_base"))


def variant_lift(spark: SparkSession, d: str) -> DataFrame:
    """Each contig whole on a scaffold, whose offset adds the pieces' ends."""
    bed = v.contigs(spark, d).where("length > 0").select(
        F.col("name").alias("contig"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.concat(F.lit("S"), (F.col("tid") % 50).cast("string")).alias("name"), F.col("tid").alias("place")
    )
    return asm.lift_variants(v.positions(spark, d).where("is_var = 1").select(F.col("ctg").alias("contig"), "pos"), bed)


def variant_lift_whole(spark: SparkSession, d: str) -> DataFrame:
    """Each contig from its start to its end, in pieces of 65,536 bases; a scaffold's offset adds their lengths."""
    size = 1 << 16
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))).alias("k")
    tiles = v.contigs(spark, d).where("name is not null and length > 0").select(F.col("name").alias("contig"), "length", "tid", each)
    start = F.col("k").cast("long") * size
    bed = tiles.select("contig", start.alias("start"), F.least(F.col("length"), start + size).alias("end"), F.concat(F.lit("S"), (F.col("tid") % 50).cast("string")).alias("name"), F.struct("tid", "k").alias("place"))
    return asm.lift_variants(v.positions(spark, d).where("is_var = 1").select(F.col("ctg").alias("contig"), "pos"), bed, by_length=True)


def switch_lift(spark: SparkSession, d: str) -> DataFrame:
    h = v.hits(spark, d).where("cigar is not null")
    one = h.groupBy("qname").agg(F.min("paf_id").alias("paf_id")).join(h, ["qname", "paf_id"])
    # the partner's own position is about where the switch falls on the target, offset by where the segment begins
    pri = F.when(F.col("strand") == "-", F.col("tlen") - F.col("tend")).otherwise(F.col("tstart"))
    half = F.floor((F.col("qend") - F.col("qstart")) / 2)
    sw = one.select("qname", F.col("qname").alias("segment"), (F.col("qstart") + half).alias("pos"), F.lit("F").alias("kind"), (half + 50).alias("mate_pos"), (pri - 50).alias("offset"))
    return asm.lift_switches(sw, one)


def chosen_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Of each name the bases of the first haplotype that has it, here the records without an unknown base, else of the second."""
    u = v.units(spark, d).where("name is not null")
    names = v.contigs(spark, d).select("name")
    first, second = u.where("not contains(upper(seq), 'N')").select("name", F.col("seq").alias("s1")), u.select("name", revcomp("seq").alias("s2"))
    x = names.join(first, "name", "left").join(second, "name", "left").withColumn("seq", F.coalesce("s1", "s2")).where("seq is not null")
    return x.select("name", F.md5("seq").alias("digest"))


def scaffold_index(spark: SparkSession, d: str) -> DataFrame:
    """Contigs of each cluster (fifty neighbours) with their numbers, longest first: an index for phasing tools."""
    x = v.contigs(spark, d).select(F.floor(F.col("tid") / 50).alias("cluster"), (-F.col("length")).alias("shorter"), "name", "tid")
    return number_within(x, "cluster", ["shorter", "name"], out="place").select("cluster", "place", "name", "tid")


def clean_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Segments that are in a haplotype, per scaffold in order: the lengths of what is kept."""
    segs = _segments(spark, d).where("kind != 'hap1'").withColumn("segment", region("contig", "start", "end"))
    kept = segs.join(segs.where("kind = 'hap2'").select("segment").distinct(), "segment", "left_semi").dropDuplicates(["segment"])
    sized = number_within(kept.select("contig", "segment", "start", "end", (F.col("end") - F.col("start")).alias("len")), "contig", ["start", "end"], out="place")
    return running_sum(sized, "contig", "place", "len", out="upto").select("contig", "segment", "upto")


def split_alignments(spark: SparkSession, d: str) -> DataFrame:
    return asm.split_at_runs(v.hits(spark, d), 100)


def dual_cut(spark: SparkSession, d: str) -> DataFrame:
    return asm.dual_cut(v.hits(spark, d), 40)


def planted_switches(spark: SparkSession, d: str) -> DataFrame:
    return asm.midpoints_on_query(v.hits(spark, d), 200)


def renamed_units(spark: SparkSession, d: str) -> DataFrame:
    u = v.units(spark, d).where("name is not null").select("name", F.length("seq").cast("long").alias("length"))
    return asm.renamed(u, asm.unzip_names(v.contigs(spark, d).select("name"), v.hits(spark, d)))


def scaffold_pairs(spark: SparkSession, d: str) -> DataFrame:
    return asm.scaffold_pairs(v.hits(spark, d).select(F.col("qname").alias("name")))


def synced_variants(spark: SparkSession, d: str) -> DataFrame:
    x = v.positions(spark, d)
    return asm.synced(x.where("cov >= 40").select("ctg", "pos", "base"), x.where("is_var = 1").select("ctg", "pos", "cov"), ["ctg", "pos"])


def segment_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """How often each segment, in its kilobases, occurs among the primary segments and among all hits together, where more than once."""
    kilo = lambda c: F.floor(F.col(c) / 1000).alias(c)
    pick = lambda df: df.select("tname", kilo("tstart"), kilo("tend"))
    x = pick(v.placed(spark, d)).unionByName(pick(v.hits(spark, d))).groupBy("tname", "tstart", "tend").agg(F.count(F.lit(1)).alias("n"))
    return x.where("n > 1")


QUERIES = {f.__name__: f for f in (
    split_alignments, dual_cut, planted_switches, renamed_units, scaffold_pairs, synced_variants, segment_multiplicity,
    filter_alt, cut_segments, segment_pairs, cut_sequences, ordered_concat, scaffolds, scaffold_parts, leftover_contigs, haplotype_layout, variant_lift, variant_lift_whole, switch_lift, chosen_sequences, scaffold_index, clean_collapsed,
)}

OPEN = """op AS (SELECT contig, s, least(e, length) AS e FROM (SELECT tname AS contig, coalesce(max(tend) OVER (PARTITION BY tname ORDER BY tstart, tend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, tstart AS e
    FROM (SELECT tname, tstart, tend FROM placed JOIN fai ON name = tname UNION ALL SELECT name, length, length FROM fai)) JOIN fai ON name = contig WHERE s < least(e, length))"""
SEGS = f"""{v.PLACED}, {OPEN}, sg AS (SELECT 'hap1' AS kind, qname AS contig, qstart AS s, qend AS e, strand, tname || ':' || tstart || '-' || tend AS mate FROM placed
    UNION ALL SELECT 'hap2', tname, tstart, tend, '+', qname || ':' || qstart || '-' || qend FROM placed UNION ALL SELECT 'collapsed', contig, s, e, '+', NULL FROM op)"""
ORD = f"{v.PLACED}, {v.UNITS}, od AS (SELECT unit_id // 20 AS scaffold, unit_id AS place, name, unit_id % 2 AS rc, seq, CASE WHEN unit_id % 3 = 0 THEN 1000 ELSE unit_id % 50 END AS gap FROM unt WHERE name IN (SELECT tname FROM placed))"
REV = "translate(reverse(seq), 'ACGTacgt', 'TGCAtgca')"
UNZIP = f"""pri AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS n FROM fai)"""
SQL = {
    "dual_cut": f"""WITH RECURSIVE {v.RUNS}, dq AS (SELECT * FROM (SELECT tname, qname, strand, row_number() OVER (PARTITION BY tname ORDER BY sum(tend - tstart) DESC, qname, strand) AS r FROM hits GROUP BY tname, qname, strand) WHERE r = 1),
        rl AS (SELECT tname, any_value(qname) AS qname, any_value(strand) AS strand, any_value(qlen) AS ql, any_value(tlen) AS tl, list({{'q0': qpos, 'q1': qpos + len, 't0': tpos, 't1': tpos + len}} ORDER BY qpos, tpos) AS h
            FROM runs JOIN dq USING (tname, qname, strand) WHERE op IN ('=', 'M') AND len <> qlen AND len >= 40 AND tlen IS NOT NULL GROUP BY tname),
        fr AS (SELECT *, CASE WHEN h[1].q0 + h[1].t0 <> 0 AND (h[1].q0 < 40 OR h[1].t0 < 40) THEN 2 ELSE 1 END AS f FROM rl),
        mg AS (SELECT tname, f AS k, [h[f]] AS kept FROM fr WHERE f <= len(h) UNION ALL SELECT tname, k + 1, CASE
                WHEN k + 1 = len(h) AND NOT ((ql - x.q1 >= 40 AND tl - x.t1 >= 40) OR (x.q1 = ql AND x.t1 = tl)) THEN kept
                WHEN x.q0 - y.q1 <= 40 OR x.t0 - y.t1 <= 40 THEN CASE WHEN x.q1 - x.q0 >= y.q1 - y.q0 THEN list_append(kept[:-2], x) ELSE kept END
                ELSE list_append(kept, x) END FROM (SELECT mg.*, h, ql, tl, h[k + 1] AS x, kept[-1] AS y FROM mg JOIN fr USING (tname) WHERE k < len(h))),
        pc AS (SELECT tname, qname, strand, list_concat(CASE WHEN kept[1].q0 <> 0 AND kept[1].t0 <> 0 THEN [{{'a': 0, 'b': kept[1].q0, 'c': 0, 'd': kept[1].t0}}] ELSE [] END,
            list_transform(range(1, len(kept)), lambda i: {{'a': kept[i].q1, 'b': kept[i + 1].q0, 'c': kept[i].t1, 'd': kept[i + 1].t0}}),
            CASE WHEN kept[-1].q1 <> ql AND kept[-1].t1 <> tl THEN [{{'a': kept[-1].q1, 'b': ql, 'c': kept[-1].t1, 'd': tl}}] ELSE [] END) AS e FROM mg JOIN fr USING (tname) WHERE k = len(h)),
        un AS (SELECT tname, qname, strand, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS piece FROM pc)
        SELECT tname, qname, strand, CAST(piece AS INTEGER) AS piece, CAST(x.a AS BIGINT) AS qstart, CAST(x.b AS BIGINT) AS qend, CAST(x.c AS BIGINT) AS tstart, CAST(x.d AS BIGINT) AS tend FROM un""",
    "split_alignments": f"""WITH {v.RUNS}, r AS (SELECT paf_id, qstart, qend, tstart, tend, run_no, qpos, tpos, len, row_number() OVER (PARTITION BY paf_id ORDER BY run_no) AS k, count(*) OVER (PARTITION BY paf_id) AS n
            FROM runs WHERE op IN ('=', 'M') AND len >= 100),
        c AS (SELECT paf_id, k - 1 AS piece, lag(qpos + len, 1, qstart) OVER w AS qs, qpos AS qe, lag(tpos + len, 1, tstart) OVER w AS ts, tpos AS te FROM r WINDOW w AS (PARTITION BY paf_id ORDER BY k)
            UNION ALL SELECT paf_id, n, qpos + len, qend, tpos + len, tend FROM r WHERE k = n)
        SELECT paf_id, CAST(piece AS INTEGER) AS piece, CAST(qs AS BIGINT) AS qstart, CAST(qe AS BIGINT) AS qend, CAST(ts AS BIGINT) AS tstart, CAST(te AS BIGINT) AS tend FROM c WHERE qe > qs OR te > ts""",
    "planted_switches": f"""WITH {v.RUNS}, m AS (SELECT *, tstart + (tend - tstart) // 2 AS mid FROM runs WHERE tend - tstart >= 200 AND op IN ('M', '=', 'X', 'D', 'N'))
        SELECT paf_id, tname, mid AS tpos, qname, CAST(qpos + CASE WHEN op IN ('D', 'N') THEN 0 ELSE mid - tpos END AS BIGINT) AS qpos FROM m WHERE tpos <= mid AND mid < tpos + len""",
    "renamed_units": f"WITH {v.UNITS}, {UNZIP} SELECT lpad(CAST(n AS VARCHAR), 6, '0') || 'F' AS name, length(seq) AS length FROM unt JOIN pri USING (name)",
    "scaffold_pairs": f"""WITH {v.HITS}, x AS (SELECT DISTINCT qname AS n, string_split(qname, '_')[1] AS grp FROM hits), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n) - 1 AS k FROM x)
        SELECT grp, k // 2 AS idx, min(n) FILTER (WHERE k % 2 = 0) AS a, min(n) FILTER (WHERE k % 2 = 1) AS b FROM k GROUP BY grp, k // 2 HAVING count(*) = 2""",
    "synced_variants": f"""WITH {v.POSITIONS}, l AS (SELECT ctg, pos, base AS base_1 FROM pstn WHERE cov >= 40), r AS (SELECT ctg, pos, cov AS cov_2 FROM pstn WHERE is_var = 1)
        SELECT * FROM l FULL JOIN r USING (ctg, pos)""",
    "segment_multiplicity": f"""WITH {v.PLACED}, x AS (SELECT tname, tstart, tend FROM placed UNION ALL SELECT tname, tstart, tend FROM hits)
        SELECT tname, tstart // 1000 AS tstart, tend // 1000 AS tend, count(*) AS n FROM x GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "filter_alt": f"""WITH {v.PLACED}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tname, tstart, tend ORDER BY qname DESC) AS k FROM placed) WHERE k = 1)
        SELECT qname, tname, tstart, tend, CAST(0 AS BIGINT) AS qstart, qlen AS qend FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.tname = a.tname AND b.tstart < a.tstart AND b.tend > a.tend)""",
    "cut_segments": f"WITH {SEGS} SELECT kind, contig, s AS seg_start, e AS seg_end, strand FROM sg",
    "segment_pairs": f"WITH {SEGS} SELECT contig || ':' || s || '-' || e AS a, mate AS b FROM sg WHERE kind = 'hap2'",
    "cut_sequences": f"""WITH {SEGS}, {v.UNITS} SELECT kind, contig || ':' || s || '-' || e AS segment, md5(CASE WHEN strand = '-' THEN {REV.replace("seq", "substring(seq, s + 1, e - s)")} ELSE substring(seq, s + 1, e - s) END) AS digest
        FROM sg JOIN unt ON unt.name = contig""",
    "ordered_concat": f"WITH {v.UNITS} SELECT unit_id // 10 AS scaffold, md5(string_agg(seq, '' ORDER BY unit_id)) AS digest, CAST(count(*) AS INTEGER) AS n FROM unt GROUP BY 1",
    "scaffolds": f"""WITH {ORD}, x AS (SELECT scaffold, place, CASE WHEN rc = 1 THEN {REV} ELSE seq END || CASE WHEN place = max(place) OVER (PARTITION BY scaffold) THEN '' ELSE repeat('N', gap) END AS s FROM od)
        SELECT scaffold, md5(string_agg(s, '' ORDER BY place)) AS digest, CAST(sum(length(s)) AS BIGINT) AS length, CAST(count(*) AS INTEGER) AS n FROM x GROUP BY scaffold""",
    "scaffold_parts": f"""WITH {ORD}, x AS (SELECT scaffold, row_number() OVER w - 1 AS place, CASE WHEN rc = 1 THEN {REV} ELSE seq END AS s, CASE WHEN lead(place) OVER w IS NULL THEN 0 ELSE gap END AS gap, od.place AS o FROM od WINDOW w AS (PARTITION BY scaffold ORDER BY place))
        SELECT scaffold, place, CAST(coalesce(sum(length(s) + gap) OVER (PARTITION BY scaffold ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", md5(s) AS digest, CAST(gap AS BIGINT) AS gap FROM x""",
    "leftover_contigs": f"WITH {ORD} SELECT name, CASE WHEN name IN (SELECT tname FROM hits) THEN 'unordered' ELSE 'unclustered' END AS label FROM unt WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM od)",
    "variant_lift": f"""WITH {v.POSITIONS}, bed AS (SELECT name AS contig, 0 AS s, length AS e, 'S' || tid % 50 AS scf, tid FROM fai WHERE length > 0), b AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY scf ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bed)
        SELECT scf AS name, CAST(before + pos - s AS BIGINT) AS pos, pos AS source_pos FROM pstn JOIN b ON contig = ctg AND pos >= s AND pos < e WHERE is_var = 1""",
    "variant_lift_whole": f"""WITH {v.POSITIONS}, b AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY tid % 50 ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fai WHERE length > 0)
        SELECT 'S' || tid % 50 AS name, CAST(before + pos AS BIGINT) AS pos, pos AS source_pos FROM pstn JOIN b ON name = ctg AND pos >= 0 AND pos < length WHERE is_var = 1""",
    "haplotype_layout": f"""WITH {SEGS}, ph AS (SELECT tname || ':' || tstart || '-' || tend AS a, qname || ':' || qstart || '-' || qend AS b, (tend - tstart) // 2 AS pa, (qend - qstart) // 2 AS pb, tend - tstart AS la, qend - qstart AS lb FROM placed),
        kd AS (SELECT *, CASE WHEN md5(a) < '6' THEN 'F' WHEN md5(a) < 'b' THEN 'S' ELSE 'C' END AS k1, CASE WHEN md5(b) < '6' THEN 'F' WHEN md5(b) < 'b' THEN 'S' ELSE 'C' END AS k2 FROM ph),
        sw AS (SELECT *, CASE WHEN k1 = k2 THEN k1 END AS kind FROM kd),
        hp AS (SELECT *, (md5(b) < '8') <> (coalesce(kind, '') = 'C') AS a_first FROM sw),
        own AS (SELECT contig, s, contig || ':' || s || '-' || e AS seg, e - s AS len FROM sg WHERE kind <> 'hap1'),
        lk AS (SELECT a AS own, * FROM hp UNION ALL SELECT b, * FROM hp),
        ea AS (SELECT h.hap, contig, s, seg, len, lk.*, (a_first = (h.hap = 0)) AS is_a FROM own LEFT JOIN lk ON lk.own = seg, (VALUES (0), (1)) h(hap)),
        tw AS (SELECT hap, contig, s, coalesce(CASE WHEN is_a THEN a ELSE b END, seg) AS x, CASE WHEN is_a THEN b ELSE a END AS y, coalesce(CASE WHEN is_a THEN la ELSE lb END, len) AS lx, CASE WHEN is_a THEN lb ELSE la END AS ly,
            CASE WHEN is_a THEN pa ELSE pb END AS px, CASE WHEN is_a THEN pb ELSE pa END AS py, CASE WHEN is_a THEN kind ELSE translate(kind, 'FS', 'SF') END AS kind FROM ea),
        sl AS (SELECT hap, contig, s * 2 AS place, CASE WHEN kind = 'S' THEN y ELSE x END AS segment, 0 AS from_base, CASE kind WHEN 'F' THEN px WHEN 'S' THEN py ELSE lx END AS to_base FROM tw
            UNION ALL SELECT hap, contig, s * 2 + 1, CASE WHEN kind = 'S' THEN x ELSE y END, CASE WHEN kind = 'F' THEN py ELSE px END, CASE WHEN kind = 'F' THEN ly ELSE lx END FROM tw WHERE kind IN ('F', 'S'))
        SELECT hap, contig, place, segment, CAST(from_base AS BIGINT) AS from_base, CAST(to_base AS BIGINT) AS to_base FROM sl""",
    "switch_lift": f"""WITH {v.HITS}, fh AS (SELECT * FROM hits WHERE cigar IS NOT NULL), one AS (SELECT * FROM fh WHERE paf_id IN (SELECT min(paf_id) FROM fh GROUP BY qname)),
        sw AS (SELECT *, CASE WHEN strand = '-' THEN tlen - tend ELSE tstart END AS pri, (qend - qstart) // 2 AS half FROM one),
        un AS (SELECT * EXCLUDE rs, unnest(rs) AS run, generate_subscripts(rs, 1) - 1 AS run_no FROM (SELECT *, regexp_extract_all(cigar, '\\d+[MIDNSHP=X]') AS rs FROM sw)),
        rn AS (SELECT *, CAST(run[:-2] AS BIGINT) AS len, run[-1] AS op FROM un),
        wk AS (SELECT *, pri + coalesce(sum(CASE WHEN op IN ('M','=','X','D','N') THEN len END) OVER w, 0) AS tpos, qstart + coalesce(sum(CASE WHEN op IN ('M','=','X','I','S') THEN len END) OVER w, 0) AS qpos, qstart + half AS pos
            FROM rn WINDOW w AS (PARTITION BY paf_id ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        ht AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY run_no) AS k FROM wk WHERE qpos < pos AND qpos + len > pos AND op IN ('M','X','=','I','S')) WHERE k = 1),
        mv AS (SELECT qname, pos, half + 50 AS mate, CASE WHEN op IN ('I','S') THEN qpos + len ELSE pos END AS moved, CASE WHEN op IN ('I','S') THEN tpos ELSE tpos + pos - qpos END - (pri - 50) AS lifted FROM ht)
        SELECT qname AS segment, CAST(moved AS BIGINT) AS pos, 'F' AS kind, CAST(lifted AS BIGINT) AS lifted FROM mv
        WHERE pos <> 0 AND mate <> 0 AND moved / pos BETWEEN 0.9 AND 1.1 AND lifted / mate BETWEEN 0.9 AND 1.1""",
    "chosen_sequences": f"""WITH {v.UNITS}, a AS (SELECT name, seq FROM unt WHERE NOT contains(upper(seq), 'N')), b AS (SELECT name, {REV} AS seq FROM unt)
        SELECT f.name, md5(coalesce(a.seq, b.seq)) AS digest FROM fai f LEFT JOIN a ON a.name = f.name LEFT JOIN b ON b.name = f.name WHERE coalesce(a.seq, b.seq) IS NOT NULL""",
    "scaffold_index": "SELECT tid // 50 AS cluster, row_number() OVER (PARTITION BY tid // 50 ORDER BY length DESC, name) - 1 AS place, name, tid FROM fai",
    "clean_collapsed": f"""WITH {SEGS}, k AS (SELECT DISTINCT contig, s, e FROM sg WHERE kind = 'hap2') SELECT contig, contig || ':' || s || '-' || e AS segment,
        CAST(sum(e - s) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM k""",
}
