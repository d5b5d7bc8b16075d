"""Cases worked out by hand, kernels against brute force, invariants of whole runs."""

import inspect
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.functions import sequences as sq
from strandloom.operators import assembly, contacts, coverage, intervals, kernels, metrics, prefix, runs, sites
from strandloom.plans import assembly_queries, contact_queries, coverage_queries, pipeline
from strandloom.streaming import contacts as stream


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*(order or df.columns)).collect()]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a\t\tb", "ACGTNacgtn", "c1:5-9", "odd name")], "s string, d string, g string, o string")
    got = df.select(
        sq.split_fields("s", "\t"), sq.revcomp("d"), sq.parse_region("g"), sq.parse_region("o"), sq.wrapped(F.repeat(F.lit("A"), 160), 80),
        sq.padded_name(F.lit(12)), sq.padded_name(F.lit(12), F.lit(3)), sq.base_code(F.lit("g")), sq.base_letter(F.lit(4)),
    ).first()
    assert got[0] == ["a", "b"] and got[1] == "nacgtNACGT" and tuple(got[2]) == ("c1", 5, 9) and tuple(got[3]) == ("odd name", 0, None)
    assert got[4] == "A" * 80 + "\n" + "A" * 80 and got[5:] == ("000012F", "000012F_003", 2, None)


def test_cigar_walk(spark):
    df = spark.createDataFrame([(1, "5=1X3=2D4=1I2=", 10, 0), (2, None, 0, 0), (3, "", 0, 0), (4, "1=1X" * 300, 0, 7)], "id int, cigar string, tstart int, qstart int")
    x = cg.walk(df)
    assert [r.tpos for r in x.where("id = 1").orderBy("run_no").collect()] == [10, 15, 16, 19, 21, 25, 25]
    long = x.where("id = 4").orderBy("run_no").collect()
    assert len(long) == 600 and all(r.tpos == r.run_no and r.qpos == 7 + r.run_no for r in long)
    assert {r.id for r in x.collect()} == {1, 4}


@pytest.mark.parametrize(("at", "hit"), [([10, 15], False), ([11], True), ([20], False), ([], False)])
def test_first_site(spark, at, hit):
    a = spark.createDataFrame([(1, "c", 10, 20)], "id int, contig string, start long, end long")
    s = spark.createDataFrame([("c", p) for p in at] + [("d", 12), (None, 12)], "contig string, pos long")
    for width in (4, 4096):
        assert sites.first_site(a, s, key=["id"], width=width).select(sites.spans_site()).first()[0] is hit


def test_pair_rules(spark):
    x = spark.createDataFrame([(True, 0, 9, False, 11, 0), (True, 0, 9, True, 0, 9), (False, 10, 0, True, 0, 0), (False, 11, None, False, 11, 4)], "s1 boolean, q1 int, n1 int, s2 boolean, q2 int, n2 int")
    c = contacts.pair_class(contacts.mate_class(F.col("s1"), F.col("q1"), F.col("n1")), contacts.mate_class(F.col("s2"), F.col("q2"), F.col("n2")))
    assert [r[0] for r in x.select(c).collect()] == [1, 2, 0, 1]
    keep = contacts.keeps_multi_contact(F.col("s1"), F.col("q1"), F.col("n1"))
    assert [r[0] for r in x.select(keep).collect()] == [True, True, True, True]


def choose(rows_):
    """The choice of a mate, row by row."""
    at, score = None, -1
    for o, primary, site, good, s in rows_:
        if primary and (site or good):
            return o
        if site and (s or 0) > score:
            at, score = o, s or 0
        elif at is None and good:
            at = o
    return at


def test_choice_of_mates(spark):
    r, data, want = random.Random(1), [], {}
    for read in range(120):
        mine = [(o, r.random() < 0.3, r.random() < 0.4, r.random() < 0.5, r.choice([None, 0, 3, 5])) for o in range(r.randrange(1, 6))]
        data += [(read, 1, *x) for x in mine]
        if (c := choose(mine)) is not None:
            want[read] = c
    df = spark.createDataFrame(data, "read int, mate int, o int, is_primary boolean, site boolean, good boolean, score int").repartition(7)
    assert {x.read: x.chosen for x in contacts.choose_mate(df, "read", "mate", "o").collect()} == want


def test_contacts(spark):
    p = spark.createDataFrame([("A", "B"), ("A", "A"), (None, "A")], "a string, b string")
    assert rows(contacts.contact_matrix(p, "a", "b")) == [("A", "A", 2), ("A", "B", 1), ("B", "A", 1)]
    m = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "C"), (None, "A")], "read int, t string")
    assert rows(contacts.multi_contacts(m, "read", "t")) == [("A", "A", 2), ("A", "B", 2), ("B", "A", 2)]


def test_a_read_of_many_targets_is_split(spark, monkeypatch):
    monkeypatch.setattr(contacts, "BLOCK_TARGETS", 7)
    r = random.Random(6)
    data = [(1, r.randrange(60)) for _ in range(150)] + [(k, r.randrange(60)) for k in range(2, 30) for _ in range(r.randrange(5))]
    out = contacts.multi_contacts(spark.createDataFrame(data, "read int, t int"), "read", "t")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want = {}
    for (_, x), (_, y) in ((a, b) for k, a in enumerate(data) for m, b in enumerate(data) if k != m and a[0] == b[0]):
        want[x, y] = want.get((x, y), 0) + 1
    assert {(x.t1, x.t2): x.n for x in out.collect()} == want


def test_coverage_delta_and_spikes(spark):
    p = spark.createDataFrame([("c", 5, 6, 9, 12)], "ctg string, pos1 long, end1 long, pos2 long, end2 long")
    d = coverage.pair_deltas(p, "ctg")
    assert rows(d, "pos") == [("c", 5, 1), ("c", 12, -1)]
    lengths = spark.createDataFrame([("c", 20), ("e", 3)], "contig string, length long")
    assert rows(coverage.coverage_runs(d, lengths)) == [("c", 0, 5, 0), ("c", 5, 12, 1), ("c", 12, 20, 0), ("e", 0, 3, 0)]
    far = spark.createDataFrame([("c", 1, 2, 10**9, 10**9 + 5)], p.schema)
    assert rows(coverage.coverage_runs(coverage.pair_deltas(far, "ctg"))) == [("c", 1, 10**9 + 5, 1)]
    cov = [1, 200, 2000, 900, 6000, 10, 7000, 7000, 400, 3000, 100, 9000]
    df = spark.createDataFrame([("c", i, i + 1, x) for i, x in enumerate(cov)] + [("z", 0, 1, 9000), ("z", 1, 2, 5)], "contig string, start long, end long, cov long")
    want, prev = [], cov[0]
    for x in cov:
        prev = prev if (prev > 100 and x > 5 * prev) or x > 5000 else x
        want.append(prev)
    got = coverage.clamp_spikes(df.repartition(5)).orderBy("contig", "start").collect()
    assert [x.clamped for x in got if x.contig == "c"] == want and want[:6] == [1, 200, 200, 900, 900, 10]
    assert [x.clamped for x in got if x.contig == "z"] == [9000, 5]


def test_spikes_are_clamped_across_partitions(spark):
    r = random.Random(4)
    for _ in range(200):
        cov = [r.choice([0, 3, 90, 101, 300, 505, 506, 1500, 3000, 5000, 5001, 9000]) for _ in range(r.randrange(12))]
        steps = coverage.Steps()
        for x in cov:
            steps.add(x)
        assert len(steps.steps) <= 5
        for start in (0, 100, 101, 150, 301, 1000, 1001, 4999, 9000):
            now = start
            for x in cov:
                now = coverage.clamp(now, x)
            assert steps(start) == now
    # one unbroken stretch above 500, over many partitions; never an array of it
    data = [("c", i, i + 1, r.choice([501, 700, 2600, 3600, 4900, 6000])) for i in range(3000)] + [("d", i, i + 1, 600 + i) for i in range(50)]
    df = spark.createDataFrame(data, "contig string, start long, end long, cov long").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = coverage.clamp_spikes(df)
        got = {(x.contig, x.start): x.clamped for x in out.collect()}
        assert out.rdd.getNumPartitions() > 1 and "collect_list" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want, last = {}, None
    for contig, start, _, x in data:
        prev = coverage.clamp(prev, x) if contig == last else x
        want[contig, start], last = prev, contig
    assert got == want


def test_switch_point(spark):
    runs_ = [("c", 0, 200, 60), ("c", 200, 210, 3), ("c", 210, 300, 60), ("c", 300, 310, 3), ("c", 310, 350, 150), ("low", 0, 9, 5)]
    df = spark.createDataFrame(runs_, "contig string, start long, end long, clamped long")
    (r,) = coverage.switch_points(df).collect()
    assert (r.contig, r.pos) == ("c", 200)


def test_complement_nesting_and_duplicates(spark):
    iv = spark.createDataFrame([("c", 2, 5), ("c", 7, 9), ("d", 0, 10), ("d", 2, 5), ("e", 0, 10), ("e", 0, 5), (None, 1, 2)], "c string, s long, e long")
    size = spark.createDataFrame([("c", 12), ("f", 3)], "name string, length long")
    assert rows(intervals.complement(iv, "c", "s", "e", size)) == [("c", 0, 2), ("c", 5, 7), ("c", 9, 12), ("f", 0, 3)]
    assert rows(intervals.outer_intervals(iv, "c", "s", "e")) == [("c", 2, 5), ("c", 7, 9), ("d", 0, 10), ("e", 0, 5), ("e", 0, 10)]
    p = spark.createDataFrame([(q, 9, "t", 0, 5) for q in ("q1", "q2")], "qname string, qlen long, tname string, tstart long, tend long")
    assert [x.qname for x in assembly.filter_placements(p).collect()] == ["q2"]


def test_running_sum_over_bins(spark):
    r = random.Random(0)
    data = sorted({(r.choice("ab"), r.randrange(1000)) for _ in range(300)})
    df = spark.createDataFrame([(k, p, r.randrange(9)) for k, p in data], "k string, p long, v long")
    want, total = [], {}
    for k, p, x in rows(df, "k", "p"):
        total[k] = total.get(k, 0) + x
        want.append((k, p, total[k]))
    for width in (7, 100, 1 << 16):
        assert rows(prefix.running_sum(df, "k", "p", "v", width=width).select("k", "p", "running")) == want


def brute_chain(strand, ts, te, match):
    best = (-1, [])
    for n in range(1, len(match) + 1):
        for c in itertools.combinations(range(len(match)), n):
            if len({strand[i] for i in c}) > 1:
                continue
            s = sum(match[i] for i in c) - sum(abs(ts[j] - te[i]) if strand[i] == "+" else abs(ts[i] - te[j]) for i, j in zip(c, c[1:]))
            best = max(best, (s, []), key=lambda x: x[0])
    return best[0]


def test_chains_score_best():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 8))
        strand, ts, match = r.choice(["+", "-"], n), r.integers(0, 60, n), r.integers(1, 30, n)
        te = ts + r.integers(1, 30, n)
        c = kernels.chain(strand, ts, te, match)
        got = sum(match[i] for i in c) - sum(abs(ts[j] - te[i]) if strand[i] == "+" else abs(ts[i] - te[j]) for i, j in zip(c, c[1:]))
        assert got == brute_chain(strand, ts, te, match) and c == sorted(c) and len({strand[i] for i in c}) == 1


def planted(spark, r, n=12, weak=False):
    truth = [r.randrange(2) for _ in range(n)]
    pairs = [("g", i, f"a{i}", f"b{i}") for i in range(n)]
    name = lambda i, h: f"{'ab'[h ^ truth[i]]}{i}"
    m = []
    for i, j in itertools.combinations(range(n), 2):
        for h in (0, 1):
            same, cross = (name(i, h), name(j, h)), (name(i, h), name(j, 1 - h))
            m += [(*same, 9), (*same[::-1], 9), (*cross, 2), (*cross[::-1], 2)]
    return truth, spark.createDataFrame(pairs, "grp string, idx long, a string, b string"), spark.createDataFrame(m, "t1 string, t2 string, n long")


def test_local_search_recovers_and_is_deterministic(spark):
    truth, pairs, m = planted(spark, random.Random(2))
    blocks = contacts.block_sums(m, pairs)
    got = rows(kernels.phase_labels(blocks, pairs, rounds=20).select("idx", "label"))
    labels = [x for _, x in got]
    assert labels in (truth, [1 - x for x in truth])
    assert rows(kernels.phase_labels(blocks.repartition(7), pairs.repartition(3), rounds=20).select("idx", "label")) == got
    sc = contacts.pair_scores(blocks, spark.createDataFrame([("g", i, x) for i, x in got], "grp string, idx long, label int"))
    assert contacts.objective(sc).first().score == 12 * 11
    lonely = kernels.phase_labels(blocks.limit(0), pairs, rounds=3, start=0)
    assert [x for _, x in rows(lonely.select("idx", "label"))] == [0] * 12


def test_local_search_never_loses():
    r = np.random.default_rng(5)
    for _ in range(20):
        n = 8
        i, j = np.triu_indices(n, 1)
        s = r.choice([-1, 1], len(i))
        i, j, s = np.append(i, j), np.append(j, i), np.append(s, s)
        label, score = kernels.local_search(n, i, j, s, 30, np.random.default_rng(1))
        best = max(int((s * (1 - 2 * np.array(x)[i]) * (1 - 2 * np.array(x)[j]) > 0).sum()) for x in itertools.product((0, 1), repeat=n))
        spin = 1 - 2 * label.astype(int)
        assert score == int((s * spin[i] * spin[j] > 0).sum()) and best * 0.9 <= score <= best


def test_search_takes_all_rounds_and_ties_touch(spark):
    defaults = [inspect.signature(f).parameters["rounds"].default for f in (kernels.phase_labels, pipeline.phase, pipeline.regroup)]
    assert defaults == [10_000] * 3
    r = np.random.default_rng(3)
    for n in (14, 70):
        i, j = np.triu_indices(n, 1)
        kept = r.random(len(i)) < 0.3
        i, j = i[kept], j[kept]
        s = r.choice([-1, 0, 1], len(i))
        i, j, s = np.append(i, j), np.append(j, i), np.append(s, s)
        label, score = kernels.local_search(n, i, j, s, 60, np.random.default_rng(1), np.zeros(n))
        # the same by recounting all edges
        spin, best, want = np.ones(n, int), 0, None
        draws = np.random.default_rng(1).integers(n, size=59)
        for k in range(60):
            while True:
                before = spin.copy()
                for x in range(n):
                    if spin[x] * (s[i == x] * spin[j[i == x]]).sum() < 0:
                        spin[x] = -spin[x]
                if (before == spin).all():
                    break
            now = int((s * spin[i] * spin[j] > 0).sum())
            if now > best:
                best, want = now, (1 - spin) // 2
            if k < 59:
                spin[np.union1d(j[i == draws[k]], draws[k])] *= -1
        assert score == best and label.tolist() in (want.tolist(), (1 - want).tolist())
        assert kernels.local_search(n, i, j, s, 10_000, np.random.default_rng(1), np.zeros(n))[1] >= score
    # two parts of one group: the pair 0-2 is tied and so one part with 2-4; 9 is alone
    pairs = spark.createDataFrame([("g", k, f"a{k}", f"b{k}") for k in (0, 2, 4, 7, 8, 9)], "grp string, idx long, a string, b string")
    e = [(0, 2, 3, 3), (2, 4, 0, 5), (7, 8, 1, 4)]
    blocks = spark.createDataFrame([("g", *x) for a, b, p, q in e for x in ((a, b, p, q), (b, a, p, q))], "grp string, i long, j long, same long, cross long")
    assert rows(kernels.components(blocks, pairs).select("idx", "part")) == [(0, 0), (2, 0), (4, 0), (7, 7), (8, 7), (9, 9)]
    got = dict(rows(kernels.phase_labels(blocks, pairs, start=0, split=True).select("idx", "label")))
    assert got[2] != got[4] and got[7] != got[8] and got[9] == 0 and len(got) == 6


def test_layout_of_haplotypes(spark):
    segs = spark.createDataFrame([("p", 0, 10), ("p", 10, 30), ("p", 30, 40)], "contig string, start long, end long")
    ph = spark.createDataFrame([("x:0-20", "p:10-30"), ("y:0-8", "p:30-40")], "hap0 string, hap1 string")
    x = assembly.haplotype_layout(segs, ph)
    assert [r.segment for r in x.where("hap = 0").orderBy("place").collect()] == ["p:0-10", "x:0-20", "y:0-8"]
    sw = spark.createDataFrame([("x:0-20", 5, "F"), ("p:10-30", 6, "F"), ("y:0-8", 3, "S"), ("p:30-40", 4, "S")], "segment string, pos long, kind string")
    got = [(r.segment, r.start, r.end) for r in assembly.haplotype_layout(segs, ph, sw).where("hap = 0").orderBy("place").collect()]
    assert got == [("p:0-10", 0, 10), ("x:0-20", 0, 5), ("p:10-30", 6, 20), ("p:30-40", 0, 4), ("y:0-8", 3, 8)]
    seqs = spark.createDataFrame([("p:0-10", "A" * 10), ("x:0-20", "C" * 20), ("p:10-30", "G" * 20), ("p:30-40", "T" * 10), ("y:0-8", "N" * 8)], "segment string, seq string")
    one = assembly.haplotype_sequences(assembly.haplotype_layout(segs, ph, sw), seqs).where("name = 'p_0'").first()
    assert one.seq == "A" * 10 + "C" * 5 + "G" * 14 + "T" * 4 + "N" * 5


def test_contigs_are_cut_and_lifted_whole(spark, monkeypatch):
    n = 150_000
    views, q = assembly_queries.v, assembly_queries
    segs = spark.createDataFrame([("collapsed", "c", 0, 10, "+", None), ("collapsed", "c", 120_000, n, "+", None)], "kind string, contig string, start long, end long, strand string, mate string")
    monkeypatch.setattr(q, "_segments", lambda *_: segs)
    monkeypatch.setattr(views, "units", lambda *_: spark.createDataFrame([("c", "ACGTT" * (n // 5))], "name string, seq string"))
    assert [x[1] for x in rows(q.cut_sequences(spark, ""))] == ["c:0-10", "c:120000-150000"]
    monkeypatch.setattr(views, "contigs", lambda *_: spark.createDataFrame([("c", n, 1), ("d", 70_000, 51), ("e", 9, 2)], "name string, length long, tid long"))
    at = [("c", x) for x in (0, 99, 65_535, 65_536, 100_000, n - 1, n)] + [("d", 5), ("d", 69_999), ("e", 3), ("f", 1)]
    monkeypatch.setattr(views, "positions", lambda *_: spark.createDataFrame([(*x, 1) for x in at], "ctg string, pos long, is_var int"))
    want = sorted([("S1", x, x) for c, x in at if c == "c" and x < n] + [("S1", n + x, x) for c, x in at if c == "d"] + [("S2", 3, 3)])
    assert rows(q.variant_lift_whole(spark, "")) == want


def test_pivot_has_all_days(spark, small):
    got = coverage_queries.pivot_sites_whole(spark, small)
    want = {}
    for x in spark.read.parquet(f"{small}/events.parquet").select("user_id", F.dayofmonth("ts").alias("day"), "event_type").collect():
        want.setdefault(x.user_id, {}).setdefault(f"day{x.day}", []).append(x.event_type)
    assert got.columns == ["user_id", *[f"day{k}" for k in range(1, 32)]]
    assert {x.user_id: {c: x[c] for c in got.columns[1:] if x[c] is not None} for x in got.collect()} == {u: {c: min(e) for c, e in w.items()} for u, w in want.items()}


def test_all_segments_reach_in_thirty_steps(spark, monkeypatch):
    both = [(a, a + 1) for a in range(100, 106)] + [(7, 20)]
    cells = [(*x, 3) for a, b in both for x in ((a, b), (b, a))] + [(7, 100, 2), (7, 7, 9)]
    monkeypatch.setattr(contact_queries, "_matrix", lambda *_: spark.createDataFrame(cells, "t1 long, t2 long, n long"))
    want = sorted([(a, b, abs(a - b)) for a in range(100, 107) for b in range(100, 107) if a != b] + [(7, 20, 1), (20, 7, 1)])
    assert rows(contact_queries.reachable_whole(spark, "")) == want


def test_switches_are_lifted(spark):
    paf = spark.createDataFrame([(1, "q", 0, "+", 100, 10, 40, "10=5D10=5I5="), (2, "q", 0, "+", 100, 0, 9, "30=")], "paf_id long, qname string, qstart long, strand string, tlen long, tstart long, tend long, cigar string")
    cols = "qname string, segment string, pos long, kind string, mate_pos long, offset long"
    f = lambda pos, mate: rows(assembly.lift_switches(spark.createDataFrame([("q", "s", pos, "F", mate, 10)], cols), paf))
    assert f(15, 20) == [("s", 15, "F", 20)]
    assert f(23, 25) == [("s", 25, "F", 25)]
    assert f(15, 50) == []


def test_measures(spark):
    df = spark.createDataFrame([(5,), (3,), (2,), (None,)], "l long")
    r = metrics.nx_stats(df, "l").first()
    assert (r.n50, r.l50, r.n90, r.l90, r.total, r.n) == (5, 1, 2, 3, 10, 3)
    assert metrics.ng50(df, "l", 10).first().ng50 == 5 and metrics.ng50(df, "l", 100).first().ng50 is None
    assert metrics.nx_stats(df.limit(0), "l").count() == 0
    v = spark.createDataFrame([("g", 1), ("g", 1), ("g", 0), ("h", None)], "g string, v int")
    assert tuple(metrics.phase_error(v, "g", "v").first()) == (1, 2, 1)


def test_short_switches(spark):
    haps = [0, 0, 1, 0, 0, 1, 1, 0, 1, 0, 0]
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(haps)], "k string, p int, h int")
    assert rows(runs.short_switches(df, "k", "p", "h"), "p") == [("k", 2, "short"), ("k", 5, "long"), ("k", 7, "short"), ("k", 9, "long")]


def test_whole_run(spark):
    r = random.Random(9)
    truth, pairs, m = planted(spark, r, 6)
    aln, read = [], 0
    for a, b, n in ((x.t1, x.t2, x.n) for x in m.collect() if x.t1 < x.t2):
        for _ in range(n):
            aln += [(read, 1, a, 10, 30, 60, 0), (read, 2, b, 10, 30, 60, 0)]
            read += 1
    df = spark.createDataFrame(aln, "read long, seg int, contig string, pos long, endpos long, mapq int, nm int")
    names = [x for p in pairs.collect() for x in (p.a, p.b)]
    var = spark.createDataFrame([(x, 20) for x in names], "contig string, pos long")
    out = pipeline.phase(df, var, pairs, spark.createDataFrame([(x, 100) for x in names], "contig string, length long"), rounds=20)
    labels = [x.label for x in out.labels.orderBy("idx").collect()]
    assert labels in (truth, [1 - x for x in truth]) and out.switches.count() == 0
    cells = {(x.t1, x.t2): x.n for x in out.matrix.collect()}
    assert all(cells[b, a] == n for (a, b), n in cells.items())
    con = sum(x.consistent for x in out.scores.collect())
    assert con > sum(x.inconsistent for x in out.scores.collect())
    scf = spark.createDataFrame([(x, x[0] + "S" + str(int(x[1:]) // 2)) for x in names], "segment string, scaffold string")
    sp = spark.createDataFrame([(k, f"aS{k}", f"bS{k}") for k in range(3)], "idx long, a string, b string")
    mates = contacts.pair_up(df.select("read", "seg", F.col("contig").alias("tid")), "read", "seg")
    assert pipeline.regroup(mates, scf, sp).count() == 3


def test_streams_add_up_as_batches(spark, tmp_path):
    data = [("A", "B", "2024-01-01 00:10:00"), ("A", "A", "2024-01-01 00:20:00"), (None, "B", "2024-01-01 00:20:00"), ("B", "C", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(data, "a string, b string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    for k in range(2):
        df.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda n: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(str(tmp_path / "in"))
    stream.run_once(stream.contact_stream(read(1), "a", "b"), "live", "complete", str(tmp_path / "c1"))
    assert rows(spark.table("live")) == rows(contacts.contact_matrix(df.unionByName(df), "a", "b"))
    stream.run_once(stream.windowed_contacts(read(99), "a", "b", "ts"), "windows", "append", str(tmp_path / "c2"))
    assert spark.table("windows").where("t1 = 'A' and t2 = 'A'").first().n == 4


def scan_switches(haps, starts, short_num, short_limit):
    """Marker by marker over one scaffold."""
    if not haps:
        return 0, 0
    side, m, s, run, first, blocks, tail = haps[0], 1, 0, 0, 0, [], 0
    for h, p in zip(haps[1:], starts[1:]):
        m += 1
        if h == side:
            s, run = s + run, 0
        else:
            first = first if run else p
            run += 1
            if run > 1 and (run >= short_num or p + 1 - first > short_limit):
                blocks.append((m - run, s))
                side, m, s, run = h, run, 0, 0
    blocks.append((m - run, s))
    tail = run if run > 1 else 0
    return sum(e for k, e in blocks if k > 1), sum(k for k, _ in blocks if k > 1) + tail


def test_switch_error_like_a_scan(spark):
    r = random.Random(8)
    data, want = [], [0, 0]
    for c in range(25):
        haps, h = [], 0
        for _ in range(r.randrange(1, 60)):
            h = h if r.random() < 0.7 else 1 - h
            haps.append(h)
        starts = sorted(r.sample(range(3000), len(haps)))
        a, b = scan_switches(haps, starts, 4, 150)
        want = [want[0] + a, want[1] + b]
        data += [(f"c{c}", p, p + 1, h) for p, h in zip(starts, haps)]
    df = spark.createDataFrame(data, "c string, s long, e long, h int").repartition(5)
    got = runs.switch_error(df, "c", "s", "e", "h", short_num=4, short_limit=150).first()
    assert [got.switches, got.markers] == want
    assert runs.switch_error(df.limit(0), "c", "s", "e", "h").first().error is None


def test_runs_to_cut_at():
    a = lambda *x: np.array(x)
    q0, q1 = a(5, 100, 160, 300), a(40, 150, 260, 380)
    assert kernels.merge_runs(q0, q1, q0, q1, 500, 500, 30) == [2, 3]
    assert kernels.merge_runs(q0, q1, q0, q1, 400, 400, 30) == [2]
    assert kernels.merge_runs(q0, q1, q0, q1, 380, 380, 30) == [2, 3]
    assert kernels.merge_runs(a(5), a(50), a(5), a(50), 500, 500, 30) == []
    assert kernels.merge_runs(a(), a(), a(), a(), 5, 5, 3) == []


def test_bubble_names(spark):
    df = spark.createDataFrame([("PR.1.2.3.1",), ("UR.4.5.6",), ("other",)], "name string")
    assert rows(assembly.parse_bubble_names(df)) == [("PR.1.2.3.1", "PR", 1, 2, 3, 1), ("UR.4.5.6", "UR", 4, 5, 6, None)]


def test_rows_are_numbered_over_partitions(spark):
    df = spark.range(500).selectExpr("concat('n', lpad(cast((id * 7919) % 1000 as string), 4, '0')) as name").repartition(9)
    got = rows(prefix.number_rows(df, ["name"]), "name")
    assert [n for _, n in got] == list(range(500))
    assert prefix.number_rows(df.limit(0), ["name"]).count() == 0
