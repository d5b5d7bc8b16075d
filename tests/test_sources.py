"""Readers and writers over small files, also split and compressed ones."""

import gzip
import json
import struct

import pytest

from strandloom.sources import readers as r
from strandloom.sources import writers as w


def put(folder, name, text):
    p = folder / name
    if name.endswith(".gz"):
        p.write_bytes(gzip.compress(text.encode()))
    else:
        p.write_text(text)
    return str(p)


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*(order or df.columns[:1])).collect()]


FA = ">b second one\nACGT\nacgtN\n\n>a\nTT\n>empty\n>c x\nG"


@pytest.mark.parametrize("name", ["x.fasta", "x.fa.gz"])
def test_fasta(spark, tmp_path, name):
    df = r.sequences(spark, put(tmp_path, name, FA))
    assert rows(df) == [("a", None, "TT", None, 2), ("b", "second one", "ACGTacgtN", None, 9), ("c", "x", "G", None, 1), ("empty", None, "", None, 0)]
    assert r.fasta(spark, put(tmp_path, "y.fna", FA), least=2).count() == 2


def test_fastq_over_split_borders(spark, tmp_path):
    recs = [(f"r{k}", "ACGT" * (k % 5 + 1)) for k in range(500)]
    text = "".join(f"@{n} d{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in recs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {x.name: x.seq for x in r.sequences(spark, put(tmp_path, "x.fq", text)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(recs)
    with pytest.raises(Exception, match="differ in length"):
        r.fastq(spark, put(tmp_path, "bad.fastq", "@a\nACGT\n+\n@@\n")).collect()


def test_paf_sam_vcf(spark, tmp_path):
    paf = put(tmp_path, "x.paf", "q\t9\t0\t5\t+\tt\t20\t1\t6\t5\t5\t60\ttp:A:P\tcg:Z:5=\nq2\t9\t0\t5\t-\tt\t20\t1\t6\t5\t5\t60\n")
    assert [(x.qname, x.tend, x.cigar) for x in r.paf(spark, paf).orderBy("qname").collect()] == [("q", 6, "5="), ("q2", 6, None)]
    sam = put(tmp_path, "x.sam", "@HD\tVN:1\n@SQ\tSN:c1\tLN:99\nr\t99\tc1\t11\t60\t3M1D2M4S\t=\t1\t0\tA\t*\tNM:i:2\tAS:i:-7\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    assert rows(r.sam(spark, sam).drop("tags"), "qname") == [("r", 99, "c1", 10, 16, 60, "3M1D2M4S", 2, -7), ("u", 4, None, -1, None, 0, None, None, None)]
    assert rows(r.sam_references(spark, sam)) == [("c1", 99)]
    vcf = put(tmp_path, "x.vcf", "##h\n#CHROM\tPOS\nc\t5\t.\tA\tG\t.\nc\t6\t.\tAT\tG\t.\n")
    assert rows(r.vcf_snvs(spark, vcf)) == [("c", 4, "A", "G")]


def test_small_tables(spark, tmp_path):
    assert rows(r.fai(spark, put(tmp_path, "a.fai", "c1\t100\t3\t60\t61\nc2\t50\n"))) == [("c1", 100), ("c2", 50)]
    assert rows(r.variant_sites(spark, put(tmp_path, "v", "c1\t4\nc1\t9\n")), "pos") == [("c1", 4), ("c1", 9)]
    b1, b2 = put(tmp_path, "1.bed", "c1\t0\t5\tS1\nc2\t0\t5\tS1\n"), put(tmp_path, "2.bed", "c1\t0\t5\tS2\n")
    assert rows(r.segment_map(spark, [b1, b2])) == [("c1:0-5", "S2"), ("c2:0-5", "S1")]
    assert rows(r.pairs(spark, put(tmp_path, "p", "a b\nc d +\n"))) == [("a", "b", None), ("c", "d", "+")]
    assert rows(r.links(spark, put(tmp_path, "l", "x A y 1 10 B z 2 20\n")).select("ctg1", "len2")) == [("A", 20)]
    assert rows(r.phasing(spark, put(tmp_path, "r", "g a b\n"))) == [("g", "a", "b")]
    assert rows(r.switches(spark, put(tmp_path, "s", "a\t4\tF\nb\t5\tX\n"))) == [("a", 4, "F")]
    assert rows(r.hapmer_counts(spark, put(tmp_path, "h", "Assembly c x y\nasm c 3 4\n"))) == [("asm", "c", 3, 4)]
    assert rows(r.clusters(spark, put(tmp_path, "c", "# x\na\tb\n\nc\n")), "name") == [(0, "a"), (0, "b"), (1, "c")]
    o = r.orderings(spark, put(tmp_path, "group0.ordering", "# h\n0 a 0 1 .\n1 b 1 1 50\n"))
    assert [(x.scaffold, x.name, x.rc, x.gap) for x in o.orderBy("place").collect()] == [("group0", "a", 0, "."), ("group0", "b", 1, "50")]
    s = r.read_sites(spark, put(tmp_path, "ri", "c r 5|x|y|A 7|x|y|g\n"))
    assert rows(s, "pos") == [("c", "r", 5, "A"), ("c", "r", 7, "g")]


def test_graph_bubbles_matrices(spark, tmp_path):
    gfa = put(tmp_path, "g.gfa", "S\ta\tAC\nS\tb\tG\nL\ta\t+\tb\t-\t0M\nL\ta\t+\tb\t-\t0M\n")
    assert rows(r.gfa_edges(spark, gfa), "src") == [("a", "end", "b", "end"), ("b", "end", "a", "end")]
    assert rows(r.gfa_segments(spark, gfa)) == [("a", "AC"), ("b", "G")]
    j = put(tmp_path, "b.json", json.dumps({"1": {"bubbles": [{"ends": ["x", "y"], "inside": ["z"]}, {"ends": ["z", "y"], "inside": []}]}}))
    assert rows(r.bubble_ends(spark, j), "name") == [("1", "x"), ("1", "y")]
    m = put(tmp_path, "m.txt", "a b\n0 3\n3 2\n")
    assert rows(r.matrix_text(spark, m), "t1", "t2") == [("a", "b", 3), ("b", "a", 3), ("b", "b", 2)]
    (tmp_path / "m.bin").write_bytes(b"12345678" + struct.pack("<II4d", 2, 2, 0, 5, 5, 1) + b"12345678")
    assert rows(r.matrix_binary(spark, str(tmp_path / "m.bin")), "i", "j") == [(0, 1, 5), (1, 0, 5), (1, 1, 1)]


def test_round_trips(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGT" * 50), ("b", ""), (None, "A")], "name string, seq string")
    w.fasta(seqs, str(tmp_path / "f.fasta"), width=80)
    assert rows(r.fasta(spark, str(tmp_path / "f.fasta")).select("name", "seq")) == [("a", "ACGT" * 50), ("b", "")]
    fq = spark.createDataFrame([("a", "ACG", "III")], "name string, seq string, qual string")
    w.fastq(fq, str(tmp_path / "q"))
    assert rows(r.fastq(spark, str(tmp_path / "q")).select("name", "seq", "qual")) == [("a", "ACG", "III")]
    bed = spark.createDataFrame([("c", 5, 9, "x"), ("a", 1, 2, "y")], "contig string, start long, end long, name string")
    w.bed(bed, str(tmp_path / "b"))
    assert rows(r.bed(spark, str(tmp_path / "b"))) == [("a", 1, 2, "y"), ("c", 5, 9, "x")]
    ph = spark.createDataFrame([("g", "a:0-5", "b:0-5")], "grp string, hap0 string, hap1 string")
    w.phasing(ph, str(tmp_path / "ph"))
    assert rows(r.phasing(spark, str(tmp_path / "ph"))) == [("g", "a:0-5", "b:0-5")]
    paf = r.paf(spark, put(tmp_path, "x.paf", "q\t9\t0\t5\t+\tt\t20\t1\t6\t5\t5\t60\tcg:Z:5=\n"))
    w.paf(paf, str(tmp_path / "p"))
    assert rows(r.paf(spark, str(tmp_path / "p"))) == rows(paf)


def _matrix(spark, size):
    """Cells of names of which one is called 0 and some have no counts, and what the matrix is as a dictionary."""
    names = spark.createDataFrame([(str(3 * k % size), k) for k in range(size)], "name string, i long")
    want = {(i, j): i * size + j + 1 for i in range(size) for j in range(size) if i % 5 and (i + j) % 4 == 0}
    cells = spark.createDataFrame([(str(3 * i % size), str(3 * j % size), n) for (i, j), n in want.items()], "t1 string, t2 string, n long")
    return cells, names, want


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_binary_matrix_in_parts_of_many_rows(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(w, "PART_CELLS", 320)
    size = 40
    cells, names, want = _matrix(spark, size)
    w.matrix_binary(cells, names, str(tmp_path / "m"), magic=b"12345678", compression=compression)
    parts = sorted(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part-"))
    assert len(parts) == 5  # of eight rows each
    body = b"".join(p.read_bytes() for p in parts)
    (tmp_path / ("one.bin.gz" if compression == "gzip" else "one.bin")).write_bytes(body)
    plain = gzip.decompress(body) if compression == "gzip" else body
    assert plain == b"12345678" + struct.pack(f"<II{size * size}d", size, size, *[want.get((i, j), 0) for i in range(size) for j in range(size)]) + b"12345678"
    for path in ("m", "one.bin*"):
        assert {(x.i, x.j): x.n for x in r.matrix_binary(spark, str(tmp_path / path)).collect()} == want
    with pytest.raises(Exception, match="given twice"):
        w.matrix_binary(cells.union(cells.limit(1)), names, str(tmp_path / "twice"))


def test_small_binary_matrix_is_one_part(spark, tmp_path):
    cells, names, want = _matrix(spark, 40)
    w.matrix_binary(cells, names, str(tmp_path / "m"))
    assert [p.name for p in (tmp_path / "m").iterdir() if p.name.startswith("part-")] == ["part-0000000000-of-0000000040"]
    assert {(x.i, x.j): x.n for x in r.matrix_binary(spark, str(tmp_path / "m")).collect()} == want


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_text_matrix_in_several_parts(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(w, "PART_CELLS", 320, raising=False)
    size = 40
    cells, names, want = _matrix(spark, size)
    w.matrix_text(cells, names, str(tmp_path / "m"), compression=compression)
    parts = sorted(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part-"))
    assert len(parts) > 2
    body = b"".join(p.read_bytes() for p in parts)
    lines = [" ".join(str(3 * k % size) for k in range(size)), *[" ".join(str(want.get((i, j), 0)) for j in range(size)) for i in range(size)]]
    assert (gzip.decompress(body) if compression == "gzip" else body).decode() == "\n".join(lines) + "\n"
    assert {(x.t1, x.t2): x.n for x in r.matrix_text(spark, str(tmp_path / "m")).collect()} == {(str(3 * i % size), str(3 * j % size)): n for (i, j), n in want.items()}


def test_text_matrix_split_between_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    put(tmp_path / "m", "part-0", "0\tb  c\n0 0.0 5\n\n")
    put(tmp_path / "m", "part-1", " 7 0 10\n2.0 0 00\n")
    assert rows(r.matrix_text(spark, str(tmp_path / "m")), "t1", "t2") == [("0", "c", 5), ("b", "0", 7), ("b", "c", 10), ("c", "0", 2)]
