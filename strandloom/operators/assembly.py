"""Segments of assemblies: placing, cutting, naming, joining in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions.sequences import padded_name, parse_region, region, revcomp
from strandloom.operators import intervals
from strandloom.operators.prefix import number_rows, number_within, running_sum
from strandloom.session import written


def filter_placements(placed: DataFrame) -> DataFrame:
    """Placements of which no other on the target begins before and ends behind; equal ones but the last drop out.

    ``placed``: qname, qlen, tname, tstart, tend, ... The query then counts whole.
    """
    last = Window.partitionBy("tname", "tstart", "tend").orderBy(F.desc("qname"))
    one = placed.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return intervals.outer_intervals(one, "tname", "tstart", "tend").withColumn("qstart", F.lit(0).cast("long")).withColumn("qend", F.col("qlen"))


def segments(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """``kind, contig, start, end, strand, mate``: what an assembly is cut into.

    ``hap1`` are the placed parts of alternate contigs, ``hap2`` their places on the
    primary ones (``mate`` is the other's name), ``collapsed`` the rest of those
    primary contigs and all contigs (of ``lengths``) without a placement.
    """
    p = placed.where("qstart < qend and tstart < tend and qstart >= 0 and tstart >= 0")
    alt = region("qname", "qstart", "qend")
    pri = region("tname", "tstart", "tend")
    hap1 = p.select(F.lit("hap1").alias("kind"), F.col("qname").alias("contig"), F.col("qstart").alias("start"), F.col("qend").alias("end"), "strand", pri.alias("mate"))
    hap2 = p.select(F.lit("hap2").alias("kind"), F.col("tname").alias("contig"), F.col("tstart").alias("start"), F.col("tend").alias("end"), F.lit("+").alias("strand"), alt.alias("mate"))
    rest = intervals.complement(p, "tname", "tstart", "tend", lengths)
    collapsed = rest.select(F.lit("collapsed").alias("kind"), F.col("entity").alias("contig"), "start", "end", F.lit("+").alias("strand"), F.lit(None).cast("string").alias("mate"))
    return hap1.unionByName(hap2).unionByName(collapsed)


def homologous_pairs(segs: DataFrame) -> DataFrame:
    """``a, b``: primary and alternate segment of each placement."""
    return segs.where("kind = 'hap2'").select(region("contig", "start", "end").alias("a"), F.col("mate").alias("b"))


def cut(segs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``kind, segment, seq``: the bases of segments, reversed where the strand is ``-``. ``sequences``: name, seq.

    A contig's bounds go to its sequence and are cut there: a sequence moves once,
    however many segments it has.
    """
    bounds = segs.groupBy("contig").agg(F.collect_list(F.struct("kind", "start", "end", "strand")).alias("_x"))
    joined = sequences.select(F.col("name").alias("contig"), "seq").join(bounds, "contig").select("contig", "seq", F.explode("_x").alias("x")).select("contig", "seq", "x.*")
    part = F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return joined.select("kind", region("contig", "start", "end").alias("segment"), F.when(F.col("strand") == "-", revcomp(part)).otherwise(part).alias("seq"))


def unzip_names(contigs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``name, new_name``: primary contigs numbered by name; alternate ones by their place on their primary.

    ``contigs``: name; ``overlaps``: qname, tname, tstart. Of several overlaps of an
    alternate contig the smallest (tname, tstart) counts.
    """
    pri = written(number_rows(contigs.select("name").distinct(), ["name"], out="_n"))
    first = overlaps.groupBy("qname").agg(F.min(F.struct("tname", "tstart")).alias("o")).select("qname", "o.tname", "o.tstart")
    placed = number_within(first, "tname", ["tstart", "qname"], out="_k").join(pri.select(F.col("name").alias("tname"), "_n"), "tname")
    return pri.select("name", padded_name("_n").alias("new_name")).unionByName(placed.select(F.col("qname").alias("name"), padded_name("_n", F.col("_k") + 1).alias("new_name")))


def name_mapping(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary names (no ``_``) with their alternates (one ``_``), and the alternates whose primary is missing."""
    n = names.select("name", F.split("name", "_").alias("p"))
    pri = n.where(F.size("p") == 1).select(F.col("name").alias("primary"))
    alt = n.where(F.size("p") == 2).select(F.col("name").alias("alternate"), F.col("p")[0].alias("primary"))
    return pri.join(alt, "primary"), alt.join(pri, "primary", "left_anti")


def ordered_parts(parts: DataFrame, key: str, order: str, seq: str, *, gap: str | None = None) -> DataFrame:
    """``key, place, offset, seq, gap``: a key's parts in order with where each begins, as rows: no key is one row.

    ``gap`` times N follow each part but the key's last. ``order`` is any type with an order.
    """
    x = parts.select(key, F.col(order).alias("_o"), F.col(seq).alias("seq"), (F.col(gap) if gap else F.lit(0)).cast("long").alias("gap"))
    x = written(number_within(x, key, ["_o"], out="place").drop("_o"))
    last = x.groupBy(key).agg(F.max("place").alias("_last"))
    sized = x.join(last, key).withColumn("gap", F.when(F.col("place") < F.col("_last"), F.coalesce("gap", F.lit(0))).otherwise(0)).drop("_last")
    sized = sized.withColumn("_size", F.length("seq") + F.col("gap"))
    return running_sum(sized, key, "place", "_size", out="_upto").select(key, "place", (F.col("_upto") - F.col("_size")).alias("offset"), "seq", "gap")


def ordered_concat(parts: DataFrame, key: str, order: str, seq: str, *, gap: str | None = None) -> DataFrame:
    """``key, seq, n``: a key's parts joined in order, with ``gap`` times N behind each but the last."""
    fields = [F.col(order).alias("o"), F.col(seq).alias("s"), (F.col(gap) if gap else F.lit(0)).cast("int").alias("g")]
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("x"))
    joined = F.array_join(F.transform("x", lambda p, i: F.concat(p["s"], F.when(i < F.size("x") - 1, F.repeat(F.lit("N"), p["g"])).otherwise(F.lit("")))), "")
    return rows.select(key, joined.alias("seq"), F.size("x").alias("n"))


def _oriented(ordering: DataFrame, sequences: DataFrame, unknown_gap: int) -> DataFrame:
    x = ordering.join(sequences.select("name", "seq"), "name")
    return x.withColumn("s", F.when(F.col("rc") == 1, revcomp("seq")).otherwise(F.col("seq"))).withColumn("g", F.when(F.col("gap") == ".", unknown_gap).otherwise(F.expr("try_cast(gap as int)")))


def scaffolds(ordering: DataFrame, sequences: DataFrame, unknown_gap: int = 1000) -> DataFrame:
    """``scaffold, seq, n``: contigs in order, reversed where asked, with gaps of N (``.`` stands for ``unknown_gap``).

    ``ordering``: scaffold, place, name, rc (0/1), gap. A scaffold is one row, of at
    most 2 GB; :func:`scaffold_parts` has no such limit.
    """
    return ordered_concat(_oriented(ordering, sequences, unknown_gap), "scaffold", "place", "s", gap="g")


def scaffold_parts(ordering: DataFrame, sequences: DataFrame, unknown_gap: int = 1000) -> DataFrame:
    """``scaffold, place, offset, seq, gap``: what :func:`scaffolds` joins, as rows in order."""
    return ordered_parts(_oriented(ordering, sequences, unknown_gap), "scaffold", "place", "s", gap="g")


def leftover(contigs: DataFrame, ordering: DataFrame, clusters: DataFrame) -> DataFrame:
    """``name, label``: contigs in no scaffold: ``unordered`` if clustered, else ``unclustered``."""
    rest = contigs.select("name").join(ordering.select("name"), "name", "left_anti")
    c = clusters.select("name").distinct().withColumn("_c", F.lit(True))
    return rest.join(c, "name", "left").select("name", F.when(F.col("_c"), "unordered").otherwise("unclustered").alias("label"))


def haplotype_layout(segs: DataFrame, phasing: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """``hap, contig, place, segment, start, end``: slices whose bases make up each haplotype, in order.

    ``segs``: primary segments (contig, start, end); ``phasing``: hap0, hap1;
    ``switches``: segment, pos, kind. Slices count from the start of their segment.
    ``F``: own head, then the partner's tail; ``S``: the partner's head, then the own
    tail; ``C``: phased the other way round. Unphased segments are in both.
    """
    s = segs.select("contig", "start", region("contig", "start", "end").alias("own"))
    sw = None if switches is None else switches.select("segment", "pos", "kind")
    ph = phasing.select("hap0", "hap1")
    if sw is not None:
        c = sw.where("kind = 'C'").select("segment")
        both = ph.join(c.select(F.col("segment").alias("hap0"), F.lit(1).alias("_c0")), "hap0", "left").join(c.select(F.col("segment").alias("hap1"), F.lit(1).alias("_c1")), "hap1", "left")
        turned = F.col("_c0").isNotNull() & F.col("_c1").isNotNull()
        ph = both.select(F.when(turned, F.col("hap1")).otherwise(F.col("hap0")).alias("hap0"), F.when(turned, F.col("hap0")).otherwise(F.col("hap1")).alias("hap1"))
    lookup = ph.select(F.col("hap0").alias("own"), "hap0", "hap1").unionByName(ph.select(F.col("hap1").alias("own"), "hap0", "hap1"))
    x = s.join(lookup, "own", "left").select("contig", F.col("start").alias("place"), F.coalesce("hap0", "own").alias("h0"), F.coalesce("hap1", "own").alias("h1"))
    each = x.select("contig", "place", F.explode(F.array(F.struct(F.lit(0).alias("hap"), F.col("h0").alias("segment"), F.col("h1").alias("partner")), F.struct(F.lit(1).alias("hap"), F.col("h1").alias("segment"), F.col("h0").alias("partner")))).alias("e")).select("contig", "place", "e.*")
    size = lambda col: parse_region(col)["end"] - parse_region(col)["start"]
    whole = lambda seg: F.array(F.struct(F.col(seg).alias("segment"), F.lit(0).cast("long").alias("start"), size(seg).alias("end")))
    if sw is None:
        slices = whole("segment")
    else:
        fs = sw.where("kind in ('F', 'S')")
        each = each.join(fs.select("segment", F.col("pos").alias("p1"), "kind"), "segment", "left").join(fs.select(F.col("segment").alias("partner"), F.col("pos").alias("p2")), "partner", "left")
        part = lambda seg, a, b: F.struct(F.col(seg).alias("segment"), a.cast("long").alias("start"), b.cast("long").alias("end"))
        f = F.array(part("segment", F.lit(0), F.col("p1")), part("partner", F.col("p2"), size("partner")))
        t = F.array(part("partner", F.lit(0), F.col("p2")), part("segment", F.col("p1"), size("segment")))
        known = F.col("p1").isNotNull() & F.col("p2").isNotNull()
        slices = F.when(known & (F.col("kind") == "F"), f).when(known & (F.col("kind") == "S"), t).otherwise(whole("segment"))
    return each.select("hap", "contig", "place", F.posexplode(slices).alias("k", "x")).select("hap", "contig", (F.col("place") * 2 + F.col("k")).alias("place"), "x.segment", "x.start", "x.end")


def haplotype_sequences(layout: DataFrame, segment_seqs: DataFrame) -> DataFrame:
    """``name, seq, n``: the haplotypes' contigs. ``segment_seqs``: segment, seq."""
    x = layout.join(segment_seqs.select("segment", "seq"), "segment").withColumn("s", F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    return ordered_concat(x.withColumn("name", F.concat_ws("_", "contig", "hap")), "name", "place", "s")


def lift_switches(switches: DataFrame, paf: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """``segment, pos, kind, lifted``: a position on a query carried through its alignment's CIGAR to the target.

    ``switches``: qname, segment, pos, kind, mate_pos (the other side's own position),
    offset (where the mate begins on the target). Strictly inside a run of bases on
    both sides the position is carried along; inside an insertion it moves to the
    run's end. One that moves by more than ``tolerance``, on either side, is dropped.
    ``paf``: paf_id, qname, qstart, strand, tlen, tstart, tend, cigar; the smallest
    ``paf_id`` that holds the position counts.
    """
    pri = F.when(F.col("strand") == "-", F.col("tlen") - F.col("tend")).otherwise(F.col("tstart"))
    x = paf.withColumn("pri", pri).select("paf_id", "qname", "qstart", "pri", "cigar").join(switches, "qname")
    runs = cg.walk(x, tstart="pri", qstart="qstart").where("qpos < pos and qpos + len > pos")
    hit = runs.where("op in ('M', 'X', '=', 'I', 'S')").groupBy("segment").agg(F.min(F.struct("paf_id", "run_no", "op", "len", "tpos", "qpos", "pos", "kind", "mate_pos", "offset")).alias("h")).select("segment", "h.*")
    ins = F.col("op").isin("I", "S")
    out = hit.withColumn("moved", F.when(ins, F.col("qpos") + F.col("len")).otherwise(F.col("pos"))).withColumn("lifted", F.when(ins, F.col("tpos")).otherwise(F.col("tpos") + F.col("pos") - F.col("qpos")) - F.col("offset"))
    near = lambda a, b: (a / b <= 1 + tolerance) & (a / b >= 1 - tolerance)
    return out.where((F.col("pos") != 0) & (F.col("mate_pos") != 0) & near(F.col("moved"), F.col("pos")) & near(F.col("lifted"), F.col("mate_pos"))).select("segment", F.col("moved").alias("pos"), "kind", "lifted")


def lift_variants(variants: DataFrame, bed: DataFrame, *, by_length: bool = False, width: int = 1 << 16) -> DataFrame:
    """``name, pos, source_pos``: variants of contigs on the scaffold made of their pieces.

    ``bed``: contig, start, end, name, place. A scaffold's running offset adds each
    piece's end, or with ``by_length`` its length. Pieces of a contig that overlap
    each carry a variant. The two meet in (contig, bin): a piece is in all bins it
    touches, a variant in one.
    """
    step = F.col("end") - F.col("start") if by_length else F.col("end")
    w = Window.partitionBy("name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = bed.withColumn("_before", F.coalesce(F.sum(step).over(w), F.lit(0)))
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    binned = placed.where("start < end").withColumn("_bin", bins).withColumnRenamed("contig", "_c")
    x = variants.select(F.col("contig").alias("_c"), "pos", F.floor(F.col("pos") / width).alias("_bin")).join(binned, ["_c", "_bin"]).where("pos >= start and pos < end")
    return x.select("name", (F.col("_before") + F.col("pos") - F.col("start")).alias("pos"), F.col("pos").alias("source_pos"))


def dominant_queries(paf: DataFrame) -> DataFrame:
    """``tname, qname, strand, covered``: the query and strand that cover most of each target; ties by name, ``+`` first."""
    s = paf.where("tname is not null and qname is not null").groupBy("tname", "qname", "strand").agg(F.sum(F.col("tend") - F.col("tstart")).alias("covered"))
    # the smallest of (most covered, name, strand) is an aggregate: a target of very many queries is no single sort
    best = s.groupBy("tname").agg(F.min(F.struct((-F.col("covered")).alias("k"), "qname", "strand")).alias("b"))
    return best.select("tname", "b.qname", "b.strand", (-F.col("b.k")).alias("covered"))


def top_targets(paf: DataFrame) -> DataFrame:
    """``qname, tname, match``: the target each query matches most; ties by name."""
    s = paf.where("tname is not null and qname is not null").groupBy("qname", "tname").agg(F.sum("match").alias("match"))
    best = s.groupBy("qname").agg(F.min(F.struct((-F.col("match")).alias("k"), "tname")).alias("b"))
    return best.select("qname", "b.tname", (-F.col("b.k")).alias("match"))


def not_overtaken(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows that end behind every row that begins before them; equal ones count once."""
    r = intervals.reach_before(df, key, start, end).select(F.col("entity").alias("_e"), F.col("start").alias("_s"), "longest", "reach")
    x = df.join(r, (F.col(key).cast("string") == F.col("_e")) & (F.col(start) == F.col("_s")))
    kept = x.where(((F.col("reach").isNull()) | (F.col("reach") < F.col(end))) & (F.col(end) == F.col("longest")))
    return kept.select(*[kept[c] for c in df.columns]).dropDuplicates([key, start, end])


def exact_runs(paf: DataFrame, least: int) -> DataFrame:
    """Runs of equal bases of at least ``least``, but for those as long as the query: ``paf_id, qname, tname, strand, qpos, tpos, len``."""
    runs = cg.walk(paf.select("paf_id", "qname", "qlen", "qstart", "strand", "tname", "tstart", "cigar").where("cigar is not null"))
    return runs.where((F.col("op").isin("=", "M")) & (F.col("len") >= least) & (F.col("len") != F.col("qlen"))).select("paf_id", "qname", "tname", "strand", "qpos", "tpos", "len")


def split_at_runs(paf: DataFrame, least: int) -> DataFrame:
    """``paf_id, piece, qstart, qend, tstart, tend``: each alignment cut at its runs of at least ``least`` equal bases, which are left out.

    Query positions count along the alignment's strand. Pieces empty on both sides
    are none. Runs are the few of one alignment, so they are taken in order within it.
    """
    x = cg.walk(paf.select("paf_id", "qstart", "qend", "tstart", "tend", "cigar").where("cigar is not null")).where((F.col("op").isin("=", "M")) & (F.col("len") >= least))
    per = x.groupBy("paf_id", "qstart", "qend", "tstart", "tend").agg(F.array_sort(F.collect_list(F.struct("run_no", "qpos", "tpos", "len"))).alias("r"))
    cuts = """transform(sequence(0, size(r)), i -> named_struct(
        'qs', if(i = 0, qstart, r[i - 1].qpos + r[i - 1].len), 'qe', if(i = size(r), qend, r[i].qpos),
        'ts', if(i = 0, tstart, r[i - 1].tpos + r[i - 1].len), 'te', if(i = size(r), tend, r[i].tpos)))"""
    cuts = cuts.replace("r[i - 1]", "get(r, i - 1)").replace("r[i]", "get(r, i)")
    out = per.select("paf_id", F.posexplode(F.expr(cuts)).alias("piece", "c")).where("c.qe > c.qs or c.te > c.ts")
    return out.select("paf_id", "piece", F.col("c.qs").alias("qstart"), F.col("c.qe").alias("qend"), F.col("c.ts").alias("tstart"), F.col("c.te").alias("tend"))


def dual_cut(paf: DataFrame, least: int) -> DataFrame:
    """Pieces of each target and the query that covers most of it, cut at long equal runs: see ``kernels.cut_between_runs``."""
    from strandloom.operators import kernels

    best = dominant_queries(paf).select("tname", "qname", "strand")
    runs = cg.walk(paf.join(best, ["tname", "qname", "strand"]).select("tname", "qname", "strand", "qlen", "tlen", "qstart", "tstart", "cigar").where("cigar is not null"))
    return kernels.cut_between_runs(runs.where((F.col("op").isin("=", "M")) & (F.col("len") != F.col("qlen"))), least)


def midpoints_on_query(paf: DataFrame, least: int = 0) -> DataFrame:
    """``paf_id, tname, tpos, qname, qpos``: the middle of each alignment's target span on both sides: where a switch may be planted.

    ``qpos`` counts along the alignment's strand; within a deletion it is the base after it.
    """
    x = paf.where((F.col("tend") - F.col("tstart") >= least) & F.col("cigar").isNotNull()).withColumn("mid", F.col("tstart") + F.expr("(tend - tstart) div 2"))
    at = cg.walk(x.select("paf_id", "tname", "qname", "mid", "qstart", "tstart", "cigar")).where("op in ('M', '=', 'X', 'D', 'N') and tpos <= mid and mid < tpos + len")
    return at.select("paf_id", "tname", F.col("mid").alias("tpos"), "qname", (F.col("qpos") + F.when(F.col("op").isin("D", "N"), 0).otherwise(F.col("mid") - F.col("tpos"))).alias("qpos"))


def renamed(df: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """``df`` with names looked up in ``names`` (name, new_name); rows of unknown names drop out."""
    return df.join(names.select(F.col("name").alias(column), "new_name"), column).drop(column).withColumnRenamed("new_name", column)


def scaffold_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """``grp, idx, a, b``: neighbours in the order of names that share what stands before ``_``; one left over has no partner."""
    x = names.select(F.col(column).alias("n"), F.split(column, "_")[0].alias("grp")).where("n is not null").distinct()
    x = number_within(x, "grp", ["n"], out="k").withColumn("idx", F.expr("k div 2"))
    return x.groupBy("grp", "idx").agg(F.min(F.when(F.col("k") % 2 == 0, F.col("n"))).alias("a"), F.min(F.when(F.col("k") % 2 == 1, F.col("n"))).alias("b")).where("b is not null")


def synced(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Variant tables side by side: ``on``, then each side's other columns with ``_1`` and ``_2``, nulls where a side has none."""
    name = lambda df, k: df.select(*on, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c not in on])
    return name(left, 1).join(name(right, 2), on, "full")


def parse_bubble_names(names: DataFrame) -> DataFrame:
    """``name, kind, chain, place, side, hap``: parts of ``PR.b.p.x.h`` (phased) and ``UR.b.p.x`` (unphased) names."""
    p = F.split("name", r"\.")
    part = lambda k: F.expr(f"try_cast(get(p, {k}) as bigint)")
    x = names.select("name", p.alias("p")).where("p[0] in ('PR', 'UR')")
    return x.select("name", F.col("p")[0].alias("kind"), part(1).alias("chain"), part(2).alias("place"), part(3).alias("side"), part(4).alias("hap"))


def suffix_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """``stem, a, b``: names that differ only in a last ``1`` or ``2``: the same contig of either haplotype."""
    n = names.select(F.col(column).alias("n")).where(F.col(column).rlike("[12]$")).distinct().withColumn("stem", F.expr("left(n, length(n) - 1)"))
    side = lambda k, c: n.where(F.col("n").endswith(k)).select("stem", F.col("n").alias(c))
    return side("1", "a").join(side("2", "b"), "stem")
