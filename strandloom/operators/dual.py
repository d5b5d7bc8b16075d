"""Two haplotypes of one genome: cutting them alike at long equal stretches, and merging what was cut too finely."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequences import parse_region, region
from strandloom.operators import intervals, runs
from strandloom.operators.assembly import not_overtaken
from strandloom.operators.prefix import number_rows, running_sum
from strandloom.session import written


def long_alignments(paf: DataFrame, least: int) -> DataFrame:
    """Alignments that span at least three times ``least`` on both sides."""
    return paf.where((F.col("qend") - F.col("qstart") >= 3 * least) & (F.col("tend") - F.col("tstart") >= 3 * least))


def cut_at_equal_runs(paf: DataFrame, least: int) -> DataFrame:
    """``paf_id, piece, qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend``: what lies between long equal runs.

    In the order of the alignment, a run of ``least`` equal bases or more is a cut if
    ``least`` bases or more lie before it, behind the last cut, on both sides. What
    follows the last cut is a piece under the same condition; an alignment without a
    cut has no pieces. On the reverse strand query positions count down from ``qend``.
    Long runs are the few of one alignment and fold in its row.
    """
    keep = ["paf_id", "qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend"]
    long = cg.walk(paf.select(*keep, "cigar").where("cigar is not null")).where((F.col("op").isin("=", "M")) & (F.col("len") >= least) & (F.col("len") != F.col("qlen")))
    per = long.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("run_no", (F.col("qpos") - F.col("qstart")).alias("q"), F.col("tpos").alias("t"), "len"))).alias("r"))
    fold = f"""aggregate(r, named_struct('q', 0L, 't', tstart, 'out', cast(array() as array<struct<a:bigint,b:bigint,c:bigint,d:bigint>>)),
        (s, x) -> if(x.q - s.q >= {least} and x.t - s.t >= {least},
            named_struct('q', x.q + x.len, 't', x.t + x.len, 'out', concat(s.out, array(named_struct('a', s.q, 'b', x.q, 'c', s.t, 'd', x.t)))), s))"""
    span = F.col("qend") - F.col("qstart")
    folded = per.withColumn("s", F.expr(fold)).where("size(s.out) > 0")
    tail = F.when((span - F.col("s.q") >= least) & (F.col("tend") - F.col("s.t") >= least), F.array(F.struct(F.col("s.q").alias("a"), span.alias("b"), F.col("s.t").alias("c"), F.col("tend").alias("d"))))
    pieces = folded.withColumn("p", F.concat("s.out", F.coalesce(tail, F.array().cast("array<struct<a:bigint,b:bigint,c:bigint,d:bigint>>"))))
    back = F.col("strand") == "-"
    x = pieces.select(*keep, F.posexplode("p").alias("piece", "x"))
    return x.select(
        "paf_id", "piece", "qname", "qlen", F.when(back, F.col("qend") - F.col("x.b")).otherwise(F.col("qstart") + F.col("x.a")).alias("qs"),
        F.when(back, F.col("qend") - F.col("x.a")).otherwise(F.col("qstart") + F.col("x.b")).alias("qe"), "strand", "tname", "tlen", F.col("x.c").alias("ts"), F.col("x.d").alias("te"),
    ).toDF("paf_id", "piece", "qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend")


def replaced(paf: DataFrame, least: int) -> DataFrame:
    """Pieces of all long alignments."""
    return cut_at_equal_runs(long_alignments(paf, least), least)


def overlap_summary(pieces: DataFrame, key: list[str]) -> DataFrame:
    """``side, pieces, contained, overlapping``: on target and query, how many pieces lie in another one, and how many pairs share a base.

    Equal pieces lie in each other but for one. Nothing is paired: see ``intervals``.
    """
    out = None
    for side, name, start, end in (("target", "tname", "tstart", "tend"), ("query", "qname", "qstart", "qend")):
        x = written(pieces.select(F.concat_ws("/", *key).alias("k"), name, start, end).where((F.col(start) < F.col(end)) & F.col(name).isNotNull()))
        free = intervals.outer_intervals(x, name, start, end, strict=False).agg(F.count(F.lit(1)).alias("free"))
        pairs = intervals.overlap_counts(x, "k", name, start, end).agg(F.coalesce(F.expr("sum(overlaps) div 2"), F.lit(0)).alias("overlapping"))
        whole = x.agg(F.count(F.lit(1)).alias("pieces"))
        one = whole.select(F.lit(side).alias("side"), "pieces", (F.col("pieces") - free.scalar()).alias("contained"), pairs.scalar().alias("overlapping"))
        out = one if out is None else out.unionByName(one)
    return out


def chained(paf: DataFrame, least: int) -> DataFrame:
    """Pieces of the long alignments that no other overtakes: first on the target, among those with a long equal run, then on the query.

    An alignment is overtaken if one that begins before it ends no earlier.
    """
    has_run = cg.walk(paf.select("paf_id", "qlen", "qstart", "tstart", "cigar").where("cigar is not null")).where((F.col("op").isin("=", "M")) & (F.col("len") >= least) & (F.col("len") != F.col("qlen"))).select("paf_id").distinct()
    on_target = not_overtaken(long_alignments(paf, least), "tname", "tstart", "tend").join(has_run, "paf_id", "left_semi")
    return cut_at_equal_runs(not_overtaken(written(on_target), "qname", "qstart", "qend"), least)


def run_threshold(paf: DataFrame, share: float, least: int = 10_000) -> int:
    """The length that a share of the equal runs of at least ``least`` do not reach (a share above 100 is a length itself); 0 without runs."""
    if share > 100:
        return int(share)
    lens = cg.walk(paf.select("qlen", "qstart", "tstart", "cigar").where("cigar is not null")).where((F.col("op").isin("=", "M")) & (F.col("len") != F.col("qlen")))
    row = runs.position_of_rank(lens, None, "len", share, least=least).first()
    return int(row["len"]) if row else 0


def cut_both(pieces: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``hap, kind, contig, start, end``: both haplotypes cut at the pieces: ``dual`` parts, and the ``collapsed`` rest.

    ``pieces``: tname, tstart, tend on haplotype 1 (``first``: name, length) and qname,
    qstart, qend on haplotype 2. Contigs without a piece are collapsed whole; parts
    that overlap or nest leave no rest between them.
    """
    out = None
    for hap, name, start, end, lengths in ((1, "tname", "tstart", "tend", first), (2, "qname", "qstart", "qend", second)):
        mine = pieces.select(F.col(name).alias("contig"), F.col(start).alias("start"), F.col(end).alias("end")).where("0 <= start and start < end")
        rest = intervals.complement(mine, "contig", "start", "end", lengths).select(F.col("entity").alias("contig"), "start", "end")
        one = mine.withColumn("kind", F.lit("dual")).unionByName(rest.withColumn("kind", F.lit("collapsed"))).select(F.lit(hap).alias("hap"), "kind", "contig", "start", "end")
        out = one if out is None else out.unionByName(one)
    return out


def merged_regions(hits: DataFrame) -> DataFrame:
    """``segment, merged``: segments of one target that follow each other without a gap, as one region.

    ``hits``: segment (``contig:start-end``), strand, qstart, qend, tname, tstart. Along a
    target, each hit follows the last one before it whose segment touches its own on the
    same contig and strand; the chain of most aligned bases counts, of equal ones
    that which ends first. Chains are summed by pointer doubling: as many rounds as the
    logarithm of the longest one, and no target is one task.
    """
    r = parse_region("segment")
    x = hits.select("segment", "strand", "tname", "tstart", (F.col("qend") - F.col("qstart")).alias("span"), r["name"].alias("ctg"), r["start"].alias("s"), r["end"].alias("e")).where("tname is not null and ctg is not null")
    x = written(number_rows(x, ["tname", "tstart", "segment", "strand", "span"], out="id"))
    touch = F.explode(F.array(F.struct(F.lit("after").alias("how"), F.col("s").alias("at")), F.struct(F.lit("before").alias("how"), F.col("e").alias("at"))))
    ends = x.select("id", "tname", "ctg", "strand", touch.alias("x")).select("id", "tname", "ctg", "strand", "x.how", "x.at")
    a = ends.select("id", "tname", "ctg", "strand", F.when(F.col("how") == "after", "before").otherwise("after").alias("how"), "at")
    b = ends.select(F.col("id").alias("prev"), "tname", "ctg", "strand", "how", "at")
    link = a.join(b, ["tname", "ctg", "strand", "how", "at"]).where("prev < id").groupBy("id").agg(F.max("prev").alias("prev"))
    at = written(x.select("id", "span").join(link, "id", "left").select("id", "prev", F.col("span").alias("score")))
    jumps = []  # 1, 2, 4, ... hits back
    while not at.where("prev is not null").isEmpty():
        jumps.append(at.where("prev is not null").select("id", "prev"))
        up = at.select(F.col("id").alias("prev"), F.col("prev").alias("further"), F.col("score").alias("more"))
        at = written(at.join(up, "prev", "left").select("id", F.col("further").alias("prev"), (F.col("score") + F.coalesce("more", F.lit(0))).alias("score")))
    best = x.join(at.select("id", "score"), "id").groupBy("tname").agg(F.min(F.struct((-F.col("score")).alias("k"), "id")).alias("b"))
    chain = written(best.select("tname", F.col("b.id").alias("id")))
    for jump in jumps:
        chain = written(chain.unionByName(chain.join(jump, "id").select("tname", F.col("prev").alias("id"))))
    members = written(chain.join(x.select("id", "segment", "ctg", "s", "e"), "id"))
    span = members.groupBy("tname").agg(F.min("ctg").alias("c"), F.min("s").alias("lo"), F.max("e").alias("hi"))
    return members.join(span, "tname").select("segment", region("c", "lo", "hi").alias("merged")).groupBy("segment").agg(F.min("merged").alias("merged"))


def first_matches(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, at, ...) of which no earlier one has either side: taken in the order of ``at``, in rounds of joins.

    In each round the pairs go that come first on both sides, and with them all
    that share a side. ``at`` is different for each pair.
    """
    cols, kept = pairs.columns, None
    left = written(pairs)
    while not left.isEmpty():
        firsts = lambda c: left.groupBy(c).agg(F.min("at").alias(f"_{c}"))  # noqa: B023, E731
        win = written(left.join(firsts("a"), "a").join(firsts("b"), "b").where("at = _a and at = _b").select(*cols))
        kept = win if kept is None else kept.unionByName(win)
        left = written(left.join(win.select("a"), "a", "left_anti").join(win.select("b"), "b", "left_anti").select(*cols))
    return pairs.limit(0) if kept is None else kept


def free_on_both_sides(pairs: DataFrame) -> DataFrame:
    """Rows (c1, s1, e1, c2, s2, e2, at, ...) that lie in no other one's interval on either side; of equal ones the first by ``at`` stays."""
    out = pairs
    for c, s, e in (("c1", "s1", "e1"), ("c2", "s2", "e2")):
        x = written(pairs.select(c, s, e, "at"))
        first = x.groupBy(c, s, e).agg(F.min("at").alias("at"))
        outer = intervals.outer_intervals(x.select(c, s, e).distinct(), c, s, e, strict=False)
        out = out.join(first.join(outer, [c, s, e], "left_semi").select("at"), "at", "left_semi")
    return out.select(*pairs.columns)


def merge_pairs(pairs: DataFrame, *hits: DataFrame) -> DataFrame:
    """``a, b, strand``: pairs of regions after merging: haplotype 1's, haplotype 2's.

    ``pairs``: a, b, strand, at (their order); ``hits``: segments of the one and of
    the other haplotype on targets, see :func:`merged_regions`. Both segments of a pair become their
    merged regions; a region is used once, by the first pair; pairs inside another on
    either side go; those of the same contigs and strand that overlap on side ``b``
    become one.
    """
    names = written(reduce(DataFrame.unionByName, [merged_regions(h) for h in hits]).groupBy("segment").agg(F.min("merged").alias("merged")))
    look = lambda c: names.select(F.col("segment").alias(c), F.col("merged").alias(f"m{c}"))
    mapped = pairs.join(look("a"), "a").join(look("b"), "b").groupBy(F.col("ma").alias("a"), F.col("mb").alias("b")).agg(F.min(F.struct("at", "strand")).alias("x")).select("a", "b", "x.at", "x.strand")
    one = first_matches(mapped)
    ra, rb = parse_region("a"), parse_region("b")
    x = one.select(ra["name"].alias("c1"), ra["start"].alias("s1"), ra["end"].alias("e1"), rb["name"].alias("c2"), rb["start"].alias("s2"), rb["end"].alias("e2"), "strand", "at")
    free = free_on_both_sides(written(x)).withColumn("key", F.concat_ws("\u0001", "c1", "c2", "strand"))
    free = written(free)
    reach = intervals.reach_before(free, "key", "s2", "e2").select(F.col("entity").alias("key"), F.col("start").alias("s2"), "reach")
    starts = reach.withColumn("fresh", (F.col("reach").isNull() | (F.col("reach") <= F.col("s2"))).cast("long"))
    island = running_sum(starts, "key", "s2", "fresh", out="island").select("key", "s2", "island")
    out = free.join(island, ["key", "s2"]).groupBy("c1", "c2", "strand", "island").agg(F.min("s1").alias("s1"), F.max("e1").alias("e1"), F.min("s2").alias("s2"), F.max("e2").alias("e2"))
    return out.select(region("c1", "s1", "e1").alias("a"), region("c2", "s2", "e2").alias("b"), "strand")
