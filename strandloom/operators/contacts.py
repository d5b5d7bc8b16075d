"""Read pairs, their filters, and contact counts between segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import written


def pair_up(alignments: DataFrame, read: str, seg: str) -> DataFrame:
    """Mates of a read in one row: columns of segment 1 with suffix ``1``, of segment 2 with ``2``."""
    side = lambda k: alignments.where(F.col(seg) == k).select(F.col(read).alias("read"), *[F.col(c).alias(f"{c}{k}") for c in alignments.columns if c not in (read, seg)])
    return side(1).join(side(2), "read")


def mate_class(site: Column, mapq: Column, nm: Column, threshold: int = 10, most_nm: int = 5) -> Column:
    """2 if the mate spans a site, 1 if it is well mapped (strictly above the threshold, few or unknown mismatches), else 0."""
    good = (mapq > threshold) & (nm.isNull() | (nm < most_nm))
    return F.when(site, 2).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def pair_class(first: Column, second: Column) -> Column:
    """2 if both mates span a site, 0 if either fails, else 1."""
    return F.when((first == 0) | (second == 0), 0).when((first == 2) & (second == 2), 2).otherwise(1)


def keeps_multi_contact(site: Column, mapq: Column, nm: Column, threshold: int = 10, most_nm: int = 5) -> Column:
    """The filter for reads of many segments: well mapped (at the threshold too), or badly mapped but spanning a site."""
    good = (mapq >= threshold) & (nm.isNull() | (nm < most_nm))
    return F.coalesce(good, F.lit(False)) | F.coalesce((mapq < threshold) & site, F.lit(False))


def choose_mate(alignments: DataFrame, read: str, mate: str, order: str) -> DataFrame:
    """One alignment per read and mate out of several.

    In file order: the first primary one is final. Before it, one that spans a site
    replaces what is there if its score is strictly higher (any beats none); else,
    while nothing is chosen, a well mapped one stands in. Expects ``is_primary``,
    ``site``, ``good``, ``score``. A read's alignments are few; they fold in one row.
    """
    fields = ["is_primary", "site", "good", "score"]
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *fields)))
    grouped = alignments.groupBy(read, mate).agg(rows.alias("rows"))
    fold = """aggregate(rows, named_struct('at', cast(null as bigint), 'score', cast(-1 as bigint), 'site', false, 'done', false),
        (a, r) -> case
            when a.done then a
            when r.is_primary and (r.site or r.good) then named_struct('at', cast(r.o as bigint), 'score', cast(coalesce(r.score, 0) as bigint), 'site', r.site, 'done', true)
            when r.site and coalesce(r.score, 0) > a.score then named_struct('at', cast(r.o as bigint), 'score', cast(coalesce(r.score, 0) as bigint), 'site', true, 'done', false)
            when a.at is null and r.good then named_struct('at', cast(r.o as bigint), 'score', a.score, 'site', false, 'done', false)
            else a end)"""
    return grouped.withColumn("c", F.expr(fold)).where("c.at is not null").select(read, mate, F.col("c.at").alias("chosen"), F.col("c.site").alias("by_site"))


def contact_matrix(pairs: DataFrame, a: str, b: str, weight: str | Column = "1") -> DataFrame:
    """``t1, t2, n``: symmetric sparse counts; a pair within one segment adds two on the diagonal.

    Each pair becomes its two directions inside the task and folds there before the
    shuffle. Pairs with an unknown end count for nothing.
    """
    w = F.expr(weight) if isinstance(weight, str) else weight
    both = F.explode(F.array(F.struct(F.col(a).alias("t1"), F.col(b).alias("t2")), F.struct(F.col(b).alias("t1"), F.col(a).alias("t2"))))
    return (
        pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(both.alias("p"), w.alias("w"))
        .groupBy("p.t1", "p.t2").agg(F.sum("w").cast("long").alias("n"))
    )


#: Targets of a read that meet in one block of pairs; a read with more is split over blocks x blocks (fixed value).
BLOCK_TARGETS = 500


def multi_contacts(segments: DataFrame, read: str, target: str) -> DataFrame:
    """``t1, t2, n`` over all pairs of segments within each read.

    A read's segments are first counted per target; the counts are joined to
    themselves, a row per pair of distinct targets of a read, weighted by the product
    of their counts, and folded inside the task before the shuffle. Pairs within one
    target are its count over two. A read of many targets is split: each block of
    about 500 targets meets each other block under a key of its own, so no read is one
    task or row.
    """
    counts = written(segments.where(F.col(read).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(read).alias("read"), F.col(target).alias("t")).agg(F.count(F.lit(1)).alias("k")))
    hot = counts.groupBy("read").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TARGETS)).cast("int").alias("blocks")).where("blocks > 1")
    placed = counts.join(hot, "read", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = placed.select("read", F.col("block").alias("b1"), each.alias("b2"), F.col("t").alias("t1"), F.col("k").alias("k1"))
    right = placed.select("read", each.alias("b1"), F.col("block").alias("b2"), F.col("t").alias("t2"), F.col("k").alias("k2"))
    w = F.when(F.col("t1") == F.col("t2"), F.col("k1") * (F.col("k1") - 1)).otherwise(F.col("k1") * F.col("k2"))
    pairs = left.join(right, ["read", "b1", "b2"]).where("t1 != t2 or k1 > 1").select("t1", "t2", w.alias("w"))
    return pairs.groupBy("t1", "t2").agg(F.sum("w").cast("long").alias("n"))


def mapped_contacts(pairs: DataFrame, a: str, b: str, mapping: DataFrame, segment: str, scaffold: str, weight: str = "1") -> DataFrame:
    """The contact matrix between scaffolds; pairs of which an end has no scaffold are dropped."""
    side = lambda k: mapping.select(F.col(segment).alias(f"_k{k}"), F.col(scaffold).alias(f"_s{k}"))
    joined = pairs.join(side(1), F.col(a) == F.col("_k1")).join(side(2), F.col(b) == F.col("_k2"))
    return contact_matrix(joined, "_s1", "_s2", weight)


def contact_totals(contacts: DataFrame) -> DataFrame:
    """``off_diagonal, diagonal, asymmetric``: sums, and how many cells differ from their mirror image."""
    mirror = contacts.select(F.col("t1").alias("t2"), F.col("t2").alias("t1"), F.col("n").alias("m"))
    return contacts.join(mirror, ["t1", "t2"], "left").agg(
        F.coalesce(F.sum(F.when(F.col("t1") != F.col("t2"), F.col("n"))), F.lit(0)).alias("off_diagonal"),
        F.coalesce(F.sum(F.when(F.col("t1") == F.col("t2"), F.col("n"))), F.lit(0)).alias("diagonal"),
        F.count_if(F.coalesce("m", F.lit(0)) != F.col("n")).alias("asymmetric"),
    )


def block_sums(contacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``grp, i, j, same, cross``: the four counts between pairs i != j of a group, folded.

    ``pairs``: grp, idx, a, b. ``same`` adds a-a and b-b, ``cross`` a-b and b-a.
    """
    side = pairs.select("grp", "idx", F.explode(F.array(F.struct(F.col("a").alias("s"), F.lit(0).alias("h")), F.struct(F.col("b").alias("s"), F.lit(1).alias("h")))).alias("x")).select("grp", "idx", "x.s", "x.h")
    one = side.select(F.col("s").alias("t1"), F.col("grp"), F.col("idx").alias("i"), F.col("h").alias("h1"))
    two = side.select(F.col("s").alias("t2"), F.col("grp"), F.col("idx").alias("j"), F.col("h").alias("h2"))
    return (
        contacts.join(one, "t1").join(two, ["t2", "grp"]).where("i != j")
        .groupBy("grp", "i", "j")
        .agg(F.sum(F.when(F.col("h1") == F.col("h2"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(F.col("h1") != F.col("h2"), F.col("n")).otherwise(0)).alias("cross"))
    )


def masked_blocks(contacts: DataFrame, pairs: DataFrame, least: int = 5) -> DataFrame:
    """``grp, i, j, n_blocks cells``: cells of 2x2 blocks of which at least one count reaches ``least``."""
    idx = reduce(DataFrame.unionByName, [pairs.select(F.col(c).alias("s"), "grp", "idx") for c in ("a", "b")])
    one, two = idx.select(F.col("s").alias("t1"), "grp", F.col("idx").alias("i")), idx.select(F.col("s").alias("t2"), F.col("grp").alias("g2"), F.col("idx").alias("j"))
    cells = contacts.join(one, "t1").join(two, "t2")
    strong = cells.groupBy("grp", "i", "g2", "j").agg(F.max("n").alias("top")).where(F.col("top") >= least).drop("top")
    return cells.join(strong, ["grp", "i", "g2", "j"], "left_semi").select("t1", "t2", "n")


def normalised_blocks(contacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``t1, t2, n, share``: each cell over the sum of its 2x2 block plus 1e-6; blocks on the diagonal are left out."""
    idx = reduce(DataFrame.unionByName, [pairs.select(F.col(c).alias("s"), F.struct("grp", "idx").alias("p")) for c in ("a", "b")])
    cells = contacts.join(idx.select(F.col("s").alias("t1"), F.col("p").alias("p1")), "t1").join(idx.select(F.col("s").alias("t2"), F.col("p").alias("p2")), "t2").where("p1 != p2")
    sums = cells.groupBy("p1", "p2").agg(F.sum("n").alias("block"))
    return cells.join(sums, ["p1", "p2"]).select("t1", "t2", "n", (F.col("n") / (F.col("block") + 1e-6)).alias("share"))


def pair_scores(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per pair: consistent and inconsistent weight, votes each way, and ties that are not zero.

    ``labels``: grp, idx, label. A block supports equal labels if ``same`` is larger.
    """
    li, lj = labels.select("grp", F.col("idx").alias("i"), F.col("label").alias("l1")), labels.select("grp", F.col("idx").alias("j"), F.col("label").alias("l2"))
    b = blocks.join(li, ["grp", "i"]).join(lj, ["grp", "j"])
    b = b.withColumn("pro", F.when(F.col("l1") == F.col("l2"), F.col("same")).otherwise(F.col("cross"))).withColumn("con", F.when(F.col("l1") == F.col("l2"), F.col("cross")).otherwise(F.col("same")))
    return b.groupBy("grp", F.col("i").alias("idx")).agg(
        F.sum("pro").alias("consistent"), F.sum("con").alias("inconsistent"),
        F.count_if(F.col("pro") > F.col("con")).alias("votes_for"), F.count_if(F.col("pro") < F.col("con")).alias("votes_against"),
        F.count_if((F.col("pro") == F.col("con")) & (F.col("pro") > 0)).alias("ties"),
    )


def objective(scores: DataFrame) -> DataFrame:
    """``grp, score``: consistent votes over ordered pairs, what the local search maximises."""
    return scores.groupBy("grp").agg(F.sum("votes_for").alias("score"))


def contact_eval(contacts: DataFrame, side: DataFrame, same_group: DataFrame) -> DataFrame:
    """``correct, incorrect, unknown``: contacts between pairs of a group whose segments lie on one haplotype, on two, or of which one is unclassified.

    ``side``: segment, hap; ``same_group``: segment, grp, pair. Contacts within a pair are left out.
    """
    at = lambda k: same_group.select(F.col("segment").alias(f"t{k}"), "grp", F.col("pair").alias(f"p{k}"))
    hap = lambda k: side.select(F.col("segment").alias(f"t{k}"), F.col("hap").alias(f"h{k}"))
    x = contacts.join(at(1), "t1").join(at(2), ["t2", "grp"]).where("p1 != p2").join(hap(1), "t1", "left").join(hap(2), "t2", "left")
    known = F.col("h1").isNotNull() & F.col("h2").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return x.agg(total(known & (F.col("h1") == F.col("h2"))).alias("correct"), total(known & (F.col("h1") != F.col("h2"))).alias("incorrect"), total(~known).alias("unknown"))


def sided_contacts(pairs: DataFrame, switches: DataFrame) -> DataFrame:
    """``segment, other, head``: contacts of segments that have a switch, and whether the mate lies before it.

    ``pairs``: tid1, pos1, tid2, pos2; ``switches``: segment, pos. The first mate's
    segment is asked first, else the second one's; pairs within a segment are left out.
    """
    s = lambda k: switches.select(F.col("segment").alias(f"tid{k}"), F.col("pos").alias(f"s{k}"))
    x = pairs.where("tid1 != tid2").join(s(1), "tid1", "left").join(s(2), "tid2", "left").where("s1 is not null or s2 is not null")
    first = F.col("s1").isNotNull()
    return x.select(
        F.when(first, F.col("tid1")).otherwise(F.col("tid2")).alias("segment"), F.when(first, F.col("tid2")).otherwise(F.col("tid1")).alias("other"),
        F.when(first, F.col("pos1") < F.col("s1")).otherwise(F.col("pos2") < F.col("s2")).alias("head"),
    )


def switch_kinds(sided: DataFrame, labelled: DataFrame) -> DataFrame:
    """``grp, idx, kind``: ``F`` where the heads of a pair's segments agree with the group's labels and the tails don't, ``S`` the other way round.

    ``labelled``: grp, idx, a, b, label. Each other pair of the group has one vote
    from heads and one from tails; ties don't vote.
    """
    side = labelled.select("grp", "idx", "label", F.explode(F.array(F.struct(F.col("a").alias("s"), F.lit(0).alias("h")), F.struct(F.col("b").alias("s"), F.lit(1).alias("h")))).alias("x")).select("grp", "idx", "label", "x.s", "x.h")
    one = side.select("grp", F.col("idx").alias("i"), F.col("label").alias("l1"), F.col("s").alias("segment"), F.col("h").alias("h1"))
    two = side.select("grp", F.col("idx").alias("j"), F.col("label").alias("l2"), F.col("s").alias("other"), F.col("h").alias("h2"))
    folded = sided.groupBy("segment", "other", "head").agg(F.count(F.lit(1)).alias("n"))
    x = folded.join(one, "segment").join(two, ["grp", "other"]).where("i != j").withColumn("agrees", (F.col("h1") == F.col("h2")) == (F.col("l1") == F.col("l2")))
    votes = x.groupBy("grp", "i", "j", "head").agg(F.sum(F.when(F.col("agrees"), F.col("n")).otherwise(-F.col("n"))).alias("m"))
    sums = votes.groupBy("grp", F.col("i").alias("idx")).agg(*[F.sum(F.when(F.col("head") == h, F.signum("m")).otherwise(0)).alias(c) for h, c in ((True, "heads"), (False, "tails"))])
    return sums.select("grp", "idx", F.when((F.col("heads") > 0) & (F.col("tails") < 0), "F").when((F.col("heads") < 0) & (F.col("tails") > 0), "S").alias("kind")).where("kind is not null")


def both_have(pairs: DataFrame, switches: DataFrame) -> DataFrame:
    """``segment, pos`` of switches whose partner has one too."""
    p = pairs.select("a", "b").join(switches.select(F.col("segment").alias("a"), F.col("pos").alias("pa")), "a").join(switches.select(F.col("segment").alias("b"), F.col("pos").alias("pb")), "b")
    return p.select(F.explode(F.array(F.struct(F.col("a").alias("segment"), F.col("pa").alias("pos")), F.struct(F.col("b").alias("segment"), F.col("pb").alias("pos")))).alias("x")).select("x.segment", "x.pos")


def choice_pairs(alignments: DataFrame, chosen: DataFrame, read: str, mate: str, order: str) -> DataFrame:
    """Mates 1 and 2 as chosen by :func:`choose_mate`, in one row per read; ``by_site1`` and ``by_site2`` say how."""
    picked = alignments.join(chosen.withColumnRenamed("chosen", order), [read, mate, order])
    return pair_up(picked, read, mate)


def named_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (ctg1, ctg2, ...) of which both ends are in ``names`` (name)."""
    known = names.select("name").distinct()
    return links.join(known.select(F.col("name").alias("ctg1")), "ctg1", "left_semi").join(known.select(F.col("name").alias("ctg2")), "ctg2", "left_semi")


def link_report(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links, kept, dropped``: how many links name an unknown contig."""
    whole, kept = links.agg(F.count(F.lit(1)).alias("links")), named_links(links, names).agg(F.count(F.lit(1)))
    return whole.select("links", kept.scalar().alias("kept")).withColumn("dropped", F.col("links") - F.col("kept"))


def hap_sides(counts: DataFrame, *, tie: int = 0) -> DataFrame:
    """``segment, side``: 1 where the first parent's markers are more, -1 where the second's are; ``tie`` if equal, 0 without any.

    ``counts``: segment, n1, n2.
    """
    even = F.when(F.col("n1") + F.col("n2") == 0, 0).otherwise(tie)
    return counts.select("segment", F.when(F.col("n1") > F.col("n2"), 1).when(F.col("n1") < F.col("n2"), -1).otherwise(even).alias("side"))


def judged_contacts(contacts: DataFrame, members: DataFrame, sides: DataFrame) -> DataFrame:
    """Contacts (t1, t2, ...) between pairs, with ``verdict``: ``correct``, ``incorrect`` or ``unknown``, and ``zero``.

    ``members``: segment, grp, pair. Both segments are in pairs of one group, but not
    of one pair. Sides (segment, side) that disagree are incorrect; ``zero`` if
    neither side has a majority; unknown if a segment has no side.
    """
    at = lambda k: members.select(F.col("segment").alias(f"t{k}"), "grp", F.col("pair").alias(f"_p{k}"))
    side = lambda k: sides.select(F.col("segment").alias(f"t{k}"), F.col("side").alias(f"_h{k}"))
    x = contacts.join(at(1), "t1").join(at(2), ["t2", "grp"]).where("_p1 != _p2 and t1 != t2").join(side(1), "t1", "left").join(side(2), "t2", "left")
    product = F.col("_h1") * F.col("_h2")
    verdict = F.when(product.isNull(), "unknown").when(product >= 0, "correct").otherwise("incorrect")
    return x.withColumn("verdict", verdict).withColumn("zero", F.coalesce((F.col("_h1") == 0) & (F.col("_h2") == 0), F.lit(False))).drop("_p1", "_p2", "_h1", "_h2")


def contact_classes(mates: DataFrame, members: DataFrame, sides: DataFrame, *, mapq: int = 10, most_nm: int = 5) -> DataFrame:
    """``total, correct, incorrect, unknown, zero, snp_correct, snp_incorrect`` of mates: tid1, tid2, mapq1, mapq2, nm1, nm2.

    ``total`` counts all mates, also those not between pairs of one group. Contacts
    with a segment of no side count as correct, too. The ``snp`` ones are those that
    only a site could have kept: of low quality or of many mismatches on an end.
    """
    weak = (F.col("mapq1") < mapq) | (F.col("mapq2") < mapq) | (F.col("nm1") >= most_nm) | (F.col("nm2") >= most_nm)
    x = judged_contacts(mates.withColumnsRenamed({"tid1": "t1", "tid2": "t2"}).withColumn("weak", F.coalesce(weak, F.lit(False))), members, sides)
    v = F.col("verdict")
    out = x.agg(
        F.count_if(v != "incorrect").alias("correct"), F.count_if(v == "incorrect").alias("incorrect"), F.count_if(v == "unknown").alias("unknown"), F.count_if("zero").alias("zero"),
        F.count_if((v == "correct") & F.col("weak")).alias("snp_correct"), F.count_if((v == "incorrect") & F.col("weak")).alias("snp_incorrect"),
    )
    return out.select(mates.agg(F.count(F.lit(1))).scalar().alias("total"), "*")


def judged_links(links: DataFrame, members: DataFrame, sides: DataFrame, *, least: int = 100) -> DataFrame:
    """Links of at least ``least`` bases on both ends between different pairs, with their ``verdict``; all pairs are one group."""
    x = links.where((F.col("len1") >= least) & (F.col("len2") >= least)).withColumnsRenamed({"ctg1": "t1", "ctg2": "t2"})
    return judged_contacts(x, members.withColumn("grp", F.lit(0)), sides).drop("grp")
