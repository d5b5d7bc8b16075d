"""Readers of sequence and alignment files, as text sources with fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import cigar as cg
from strandloom.session import written


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where("trim(value) != ''")


def _fields(df: DataFrame, pattern: str, columns: str) -> DataFrame:
    """Columns ``name type, ...`` from the fields of each line; missing or malformed ones are null."""
    x = df.select(F.split(F.rtrim("value"), pattern).alias("f"))
    out = []
    for k, c in enumerate(columns.split(", ")):
        name, kind = c.split(" ")
        out.append(F.expr(f"try_cast(get(f, {k}) as {kind})").alias(name))
    return x.select(*out, "f")


def fasta(spark: SparkSession, path: str | list[str], *, least: int = 0) -> DataFrame:
    """``name, descr, seq, length`` of FASTA files (any Hadoop codec): each record is one split of the file."""
    raw = spark.read.option("lineSep", "\n>").text(path).where("trim(value) != ''")
    head = F.regexp_extract("value", r"^>?([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+", "")
    out = raw.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(head, r"^\s*\S*\s+(.*)$", 1)), F.lit("")).alias("descr"), seq.alias("seq"))
    return out.withColumn("length", F.length("seq").cast("long")).where(F.col("length") >= least)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line, value``: lines numbered from 0 in their file.

    A line's number is its place in its split plus the lines of the splits before,
    which are counted in a first pass; there is one count per split.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = raw.groupBy("file", "block").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("first") + F.col("id") - F.col("lo")).alias("line"), "value")


def fastq(spark: SparkSession, path: str | list[str], *, least: int = 0) -> DataFrame:
    """``name, descr, seq, qual, length`` of four-line FASTQ files; a record whose lengths differ raises an error."""
    x = numbered_lines(spark, path).groupBy("file", F.floor(F.col("line") / 4).alias("rec")).agg(
        *[F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(c) for k, c in ((0, "h"), (1, "seq"), (3, "qual"))]
    )
    bad = F.raise_error(F.concat(F.lit("sequence and quality differ in length: "), F.col("h")))
    name = F.regexp_extract("h", r"^@?(\S*)", 1)
    return x.where("h is not null and trim(h) != ''").select(
        name.alias("name"), F.nullif(F.regexp_extract("h", r"^@?\S*\s+(.*)$", 1), F.lit("")).alias("descr"),
        F.when(F.length("seq") == F.length("qual"), F.col("seq")).otherwise(bad).alias("seq"), "qual", F.length("seq").cast("long").alias("length"),
    ).where(F.col("length") >= least)


def sequences(spark: SparkSession, path: str, *, least: int = 0) -> DataFrame:
    """FASTA or FASTQ by the file's extension (fa, fasta, fna, fq, fastq, each also with .gz)."""
    base = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if base in ("fa", "fasta", "fna"):
        return fasta(spark, path, least=least).select("name", "descr", "seq", F.lit(None).cast("string").alias("qual"), "length")
    if base in ("fq", "fastq"):
        return fastq(spark, path, least=least)
    raise ValueError(f"neither FASTA nor FASTQ: {path}")


def _tag(tags: Column, name: str) -> Column:
    return F.get(F.filter(tags, lambda t: t.startswith(name)), F.lit(0))


def paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    columns = "qname string, qlen bigint, qstart bigint, qend bigint, strand string, tname string, tlen bigint, tstart bigint, tend bigint, nmatch bigint, alnlen bigint, mapq int"
    out = _fields(_lines(spark, path), "\t", columns)
    tags = F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0)))
    return out.withColumn("cigar", F.substring(_tag(tags, "cg:Z:"), F.lit(6), F.lit(2**30))).drop("f")


SAM = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string"


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``qname, flag, rname, pos, endpos, mapq, cigar, nm, as_score, tags``; ``pos`` counts from 0, ``*`` is null."""
    out = _fields(_lines(spark, path).where("value not like '@__\t%'"), "\t", SAM)
    tags = F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))
    number = lambda name: F.substring(_tag(tags, name), F.lit(6), F.lit(12)).cast("int")
    star = lambda c: F.nullif(F.col(c), F.lit("*"))
    x = out.select("qname", "flag", star("rname").alias("rname"), (F.col("pos") - 1).alias("pos"), "mapq", star("cigar").alias("cigar"), number("NM:i:").alias("nm"), number("AS:i:").alias("as_score"),
                   F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring(t, F.lit(1), F.lit(2)), F.substring(t, F.lit(6), F.lit(2**30))))).alias("tags"))
    return x.withColumn("endpos", F.col("pos") + cg.span("cigar")).select("qname", "flag", "rname", "pos", "endpos", "mapq", "cigar", "nm", "as_score", "tags")


def sam_references(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name, length`` of the ``@SQ`` lines."""
    x = spark.read.text(path).where("value like '@SQ\t%'")
    return x.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def vcf_snvs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``chrom, pos, ref, alt`` of single-base substitutions; ``pos`` counts from 0."""
    out = _fields(_lines(spark, path).where("value not like '#%'"), "\t", "chrom string, pos bigint, id string, ref string, alt string")
    return out.where("length(ref) = 1 and length(alt) = 1").select("chrom", (F.col("pos") - 1).alias("pos"), "ref", "alt")


def variant_sites(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), r"\s+", "contig string, pos bigint").drop("f")


def fai(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), r"\s+", "name string, length bigint").drop("f")


def bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), r"\s+", "contig string, start bigint, end bigint, name string").drop("f")


def segment_map(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``segment, scaffold`` of BED files with names; where several have a segment, the last one counts."""
    x = None
    for k, p in enumerate(paths):
        one = bed(spark, p).withColumn("_k", F.lit(k))
        x = one if x is None else x.unionByName(one)
    return x.groupBy(F.format_string("%s:%d-%d", "contig", "start", "end").alias("segment")).agg(F.max_by("name", F.struct("_k", "name")).alias("scaffold"))


def pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), r"\s+", "a string, b string, strand string").drop("f")


def links(spark: SparkSession, path: str | list[str]) -> DataFrame:
    columns = "c0 string, ctg1 string, c2 string, pos1 bigint, len1 bigint, ctg2 string, c6 string, pos2 bigint, len2 bigint"
    return _fields(_lines(spark, path), r"\s+", columns).drop("f")


def phasing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), r"\s+", "grp string, hap0 string, hap1 string").drop("f")


def switches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path), r"\s+", "segment string, pos bigint, kind string").drop("f").where("kind in ('F', 'S', 'C')")


def clusters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``grp, name``: the names on each line; lines with ``#`` are comments and don't count."""
    x = numbered_lines(spark, path).where("value not like '#%' and trim(value) != ''").withColumn("grp", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)
    return x.select("grp", F.explode(F.filter(F.split(F.trim("value"), r"\s+"), lambda v: v != "")).alias("name"))


def orderings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``scaffold, place, name, rc, quality, gap`` of ordering files; the scaffold is the file's name."""
    x = numbered_lines(spark, path).where("value not like '#%' and trim(value) != ''")
    f = F.split(F.trim("value"), r"\s+")
    return x.select(F.regexp_extract("file", r"([^/]+?)(\.ordering)?$", 1).alias("scaffold"), F.col("line").alias("place"), f[1].alias("name"), f[2].cast("int").alias("rc"), f[3].alias("quality"), f[4].alias("gap"))


def read_sites(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``contig, read, pos, base``: a row per site of lines ``contig read pos|..|..|base ...``."""
    f = F.split(F.trim("value"), r"\s+")
    x = _lines(spark, path).select(f[0].alias("contig"), f[1].alias("read"), F.explode(F.slice(f, F.lit(3), F.size(f))).alias("s"))
    return x.select("contig", "read", F.split("s", r"\|")[0].cast("long").alias("pos"), F.split("s", r"\|")[3].alias("base"))


def hapmer_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _fields(_lines(spark, path).where("value not like 'Assembly%'"), r"\s+", "assembly string, contig string, n1 bigint, n2 bigint").drop("f")


def gfa_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``src, src_end, dst, dst_end``: both directions of each link; an end is ``start`` or ``end``."""
    f = F.split("value", "\t")
    x = spark.read.text(path).where("value like 'L\t%'").select(f[1].alias("a"), f[2].alias("o1"), f[3].alias("b"), f[4].alias("o2"))
    out = x.withColumn("e1", F.when(F.col("o1") == "+", "end").otherwise("start")).withColumn("e2", F.when(F.col("o2") == "+", "start").otherwise("end"))
    there = out.select(F.col("a").alias("src"), F.col("e1").alias("src_end"), F.col("b").alias("dst"), F.col("e2").alias("dst_end"))
    back = out.select(F.col("b").alias("src"), F.col("e2").alias("src_end"), F.col("a").alias("dst"), F.col("e1").alias("dst_end"))
    return there.unionByName(back).distinct()


def gfa_segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).where("value like 'S\t%'").select(f[1].alias("name"), f[2].alias("seq"))


def bubble_ends(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``chain, name``: ends of bubbles that are inside none, of JSON files ``{chain: {bubbles: [{ends, inside}]}}``."""
    raw = spark.read.option("wholetext", True).text(path)
    kind = "map<string, struct<bubbles: array<struct<ends: array<string>, inside: array<string>>>>>"
    b = raw.select(F.explode(F.from_json("value", kind)).alias("chain", "v")).select("chain", F.explode("v.bubbles").alias("b"))
    ends, inside = b.select("chain", F.explode("b.ends").alias("name")).distinct(), b.select(F.explode("b.inside").alias("name")).distinct()
    return ends.join(inside, "name", "left_anti").select("chain", "name")


def matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """``t1, t2, n``, without zeros, of a text matrix: a line of names, then a line of counts for each.

    Part files make one matrix in the order of their names. One pass over the text keeps
    of each line how many words it has and those other than 0; all else rests on these.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kept = written(raw.where("trim(value) != ''").withColumn("id", F.monotonically_increasing_id()).mapInArrow(_words, "file string, block long, id long, width long, words array<struct<j: long, v: string>>"))
    counts = kept.groupBy("file", "block").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))  # a row per split
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    x = kept.join(starts, ["file", "block"]).select((F.col("first") + F.col("id") - F.col("lo") - 1).alias("i"), "width", "words")
    head = x.where("i = -1")
    names = head.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("j")).join(head.selectExpr("inline(words)"), "j", "left").select("j", F.coalesce("v", F.lit("0")).alias("t2"))
    by = names.select(F.col("j").alias("i"), F.col("t2").alias("t1"))
    cells = x.where("i >= 0").join(by, "i").selectExpr("t1", "inline(words)")
    return cells.withColumn("n", F.col("v").cast("double").cast("long")).where("n != 0").join(names, "j").select("t1", "t2", "n")


def _words(batches):
    """``width``, the words of a line; ``words``, those other than 0 with their places: without them a line of names is whole, too."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        width, at, j, v = [], [0], [], []
        for line in batch.column("value"):
            text = line.as_buffer().to_pybytes()
            u = np.frombuffer(text, np.uint8)
            word = np.zeros(len(u) + 2, bool)
            np.greater(u, 32, out=word[1:-1])
            edge = np.flatnonzero(word[1:] != word[:-1])
            begin, end = edge[::2], edge[1::2]
            k = np.flatnonzero((end - begin != 1) | (u[begin] != 48))
            width.append(len(begin))
            at.append(at[-1] + len(k))
            j.append(k)
            v += [text[b:e].decode() for b, e in zip(begin[k].tolist(), end[k].tolist(), strict=True)]
        words = pa.StructArray.from_arrays([pa.array(np.concatenate([*j, np.array([], "int64")]), pa.int64()), pa.array(v, pa.string())], ["j", "v"])
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("file", "block", "id")}, "width": pa.array(width, pa.int64()), "words": pa.ListArray.from_arrays(pa.array(at, pa.int32()), words)})


def matrix_binary(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, n``, without zeros, of binary matrices, plain or gzip: eight bytes, two u32 of rows and columns, rows of f64, eight bytes.

    A folder of the writer's parts is read part by part; another file is one value,
    as the format has no splits, and several files run in parallel.
    """
    import gzip

    import numpy as np
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                name, body = name.as_py(), content.as_buffer()
                if name.endswith(".gz"):
                    name, body = name[:-3], gzip.decompress(body)
                first = 0
                if name.startswith("part-"):  # rows of the writer's, as the name says: part-<first row>-of-<rows>
                    first, cols = (int(x) for x in name[5:].split("-of-"))
                    skip = 0 if first else 16
                    rows = min((len(body) - skip) // (8 * cols), cols - first)
                else:
                    skip, (rows, cols) = 16, np.frombuffer(body, "<u4", 2, 8).tolist()
                m = np.frombuffer(body, "<f8", rows * cols, skip)
                at = np.flatnonzero(m != 0)
                yield pa.RecordBatch.from_pydict({"i": pa.array(at // cols + first, pa.int64()), "j": pa.array(at % cols, pa.int64()), "n": pa.array(m[at].astype("int64"))})

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(parse, "i long, j long, n long")
