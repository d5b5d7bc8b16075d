"""Commands over small files: each runs and writes or shows what it should."""

import pytest

from strandloom.__main__ import main
from strandloom.sources import readers as r


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


PAF = "q\t60\t0\t60\t+\tt\t90\t10\t70\t60\t60\t60\tcg:Z:20X20=20X\nq2\t30\t0\t30\t-\tt\t90\t40\t70\t29\t30\t60\tcg:Z:10=1X19=\n"


def test_files_of_alignments(spark, put, tmp_path):
    paf, out = put("x.paf", PAF), str(tmp_path / "o")
    main(["sites", "--paf", paf, "--out", out + "1"])
    assert r.variant_sites(spark, out + "1").count() == 82 - 1  # one base of t differs from both queries
    main(["replace", "--paf", paf, "--out", out + "2", "--least", "10"])
    assert sorted(x.value.split("\t")[2:4] for x in spark.read.text(out + "2").collect()) == [["0", "20"], ["19", "30"], ["40", "60"]]
    main(["dualcut", "--paf", paf, "--out", out + "3", "--least", "10"])
    main(["identity", "--paf", paf, "--out", out + "4", "--block", "50"])
    assert sorted(tuple(x.value.split("\t")) for x in spark.read.text(out + "4").collect()) == [("t", "0", "30", "50"), ("t", "1", "19", "40")]
    main(["place", "--paf", paf, "--out", out + "5", "--least", "10"])
    assert spark.read.text(out + "5").count() == 2
    fasta = [put("a.fasta", ">t\n" + "A" * 90), put("b.fasta", ">q\n" + "C" * 60)]
    main(["chain", "--paf", paf, "--first", fasta[0], "--second", fasta[1], "--out", out + "6", "--share", "101", "--shortest", "10"])
    assert {x.name: x.length for x in r.fasta(spark, out + "6/collapsed1.fasta").collect()} == {"t:0-90": 90}
    vcf = [put("p.vcf", "t\t11\t.\tA\tG\n"), put("s.vcf", "q\t1\t.\tA\tG\n")]
    main(["variant", "--paf", paf, "--primary", vcf[0], "--alternate", vcf[1], "--out", out + "7"])
    assert sorted(tuple(x) for x in r.variant_sites(spark, out + "7").collect()) == [("q", 0), ("t", 10)]
    main(["unzip", "--fai", put("f.fai", "t\t90\nz\t5\n"), "--paf", paf, "--out", out + "8"])
    assert {x.value.split("\t")[0] for x in spark.read.text(out + "8").collect()} == {"t", "z", "q", "q2"}


def test_files_of_segments(spark, put, tmp_path):
    out = str(tmp_path / "o")
    main(["filter", put("x.fasta", ">a\nACGT\n>b\nA\n"), "--out", out, "--least", "3"])
    assert [x.name for x in r.fasta(spark, out + "/kept").collect()] == ["a"] and [x.name for x in r.fasta(spark, out + "/short").collect()] == ["b"]
    main(["scaffold", "--ordering", put("g.ordering", "0 a 0 1 2\n1 b 1 1 .\n"), "--fasta", str(tmp_path / "x.fasta"), "--out", out + "2"])
    assert [x.seq for x in r.fasta(spark, out + "2").collect()] == ["ACGTNNT"]
    main(["clean", "--bed", put("s.bed", "a\t0\t5\na\t5\t9\n"), "--result", put("r.txt", "g a:0-5 b:0-5\n"), "--out", out + "3"])
    assert [tuple(x)[:3] for x in r.bed(spark, out + "3").collect()] == [("a", 0, 5)]
    hits = "h:0-10\t10\t0\t10\t+\tt\t99\t0\t10\t9\t10\t60\nh:10-30\t20\t0\t20\t+\tt\t99\t10\t30\t9\t20\t60\n"
    pairs = put("p.txt", "p:0-10 h:0-10 +\np:10-30 h:10-30 +\n")
    main(["merge", "--pairs", pairs, "--first", put("1.paf", hits.replace("h:", "p:")), "--second", put("2.paf", hits), "--out", out + "4"])
    assert [x.value for x in spark.read.text(out + "4").collect()] == ["p:0-30\th:0-30\t+"]


def test_measures(spark, put, capsys):
    counts = put("c.txt", "Assembly c x y\na s000001A 5 1\na s000001B 1 5\na s000001C 4 1\na s000001D 0 3\n")
    pairs = put("p.txt", "s000001A s000001B\ns000001C s000001D\n")
    main(["phase-eval", "--result", put("r.txt", "g s000001A s000001B\ng s000001C s000001D\n"), "--counts", counts])
    sam = "".join(f"r{k}\t{f}\t{c}\t1\t60\t5M\t*\t0\t0\t*\t*\tNM:i:0\n" for k, (x, y) in enumerate([("A", "C"), ("A", "D"), ("A", "B")]) for f, c in ((64, f"s000001{x}"), (128, f"s000001{y}")))
    main(["hic", "--sam", put("x.sam", sam), "--pairs", pairs, "--counts", counts])
    main(["link", "--links", put("l", "x s000001A y 1 200 s000001D z 2 200\nx s000001A y 1 20 s000001D z 2 200\n"), "--pairs", pairs, "--counts", counts])
    main(["switch", put("m.bed", "".join(f"c\t{k * 10}\t{k * 10 + 1}\t{int(k in (5, 6))}\n" for k in range(20))), "--snum", "5"])
    shown = capsys.readouterr().out.replace(" ", "")
    assert "|0|2|0|0.0|" in shown and "|1|2|0|0.0|" in shown
    assert "|3|1|1|0|0|0|0|" in shown and "|incorrect|1|" in shown
    assert "|2|20|10.0|" in shown
