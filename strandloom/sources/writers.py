"""Writers; each task writes the part it holds, so a result is a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import wrapped


def fasta(df: DataFrame, path: str, *, name: str = "name", seq: str = "seq", width: int | None = None, compression: str = "none") -> None:
    """``>name`` and the sequence, on one line or on lines of ``width``."""
    s = F.col(seq) if width is None else wrapped(seq, width)
    df.where(F.col(name).isNotNull()).select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.coalesce(s, F.lit(""))).alias("value")).write.option("compression", compression).text(path)


def fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def delimited(df: DataFrame, path: str, columns: list[str], *, sep: str = "\t", order: list[str] | None = None) -> None:
    """Plain columns without a header, range-sorted if ``order`` is given: results, scores, switches, BED, sites."""
    x = df.select(*columns) if order is None else df.orderBy(*order).select(*columns)
    x.write.option("sep", sep).option("quote", "\u0000").csv(path)


def phasing(df: DataFrame, path: str) -> None:
    delimited(df, path, ["grp", "hap0", "hap1"], sep=" ")


def switches(df: DataFrame, path: str) -> None:
    delimited(df.where("kind in ('F', 'S')"), path, ["segment", "pos", "kind"])


def sites(df: DataFrame, path: str) -> None:
    delimited(df, path, ["contig", "pos"], order=["contig", "pos"])


def bed(df: DataFrame, path: str) -> None:
    delimited(df, path, [c for c in ("contig", "start", "end", "name") if c in df.columns], order=["contig", "start"])


def paf(df: DataFrame, path: str) -> None:
    columns = ["qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "nmatch", "alnlen", "mapq"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("*" if c.endswith("name") else "0")) for c in columns]
    tag = F.when(F.col("cigar").isNotNull(), F.concat(F.lit("\tcg:Z:"), "cigar")).otherwise(F.lit(""))
    df.select(F.concat(F.concat_ws("\t", *text), tag).alias("value")).write.text(path)


def sam(df: DataFrame, path: str, references: DataFrame | None = None) -> None:
    """SAM lines without bases of qname, flag, rname, pos (from 0), mapq, cigar and nm; ``references`` (name, length) make the header, in the first part."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    pos = F.coalesce(F.col("pos") + 1, F.lit(0)).cast("string")
    fields = [star("qname"), F.col("flag").cast("string"), star("rname"), pos, F.coalesce(F.col("mapq"), F.lit(255)).cast("string"), star("cigar")]
    tag = F.when(F.col("nm").isNotNull(), F.concat(F.lit("\tNM:i:"), "nm")).otherwise(F.lit(""))
    body = df.select(F.concat(F.concat_ws("\t", *fields, *[F.lit(x) for x in ("*", "0", "0", "*", "*")]), tag).alias("value"))
    if references is not None:
        head = references.select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), "length").alias("value")).coalesce(1)
        body = head.union(body)
    body.write.text(path)


#: Counts that a part of a dense matrix holds, at least one row: 8 MB of zeros as text, 34 MB as f64 (fixed value).
PART_CELLS = 1 << 22


def matrix_text(cells: DataFrame, names: DataFrame, path: str, *, compression: str = "none") -> None:
    """A line of names, then a line of counts for each. ``cells``: t1, t2, n, without zeros; ``names``: name, i (0, 1, ...).

    The format is dense, so a line has as many counts as there are names; lines are
    put together where they are written, and each stretch of zeros at once.
    """
    size = names.count()
    head = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), " ").alias("value")).select(F.lit(-1).cast("long").alias("i"), "value")
    line = F.expr(f"""array_join(concat(
        transform(cells, (x, k) -> concat(repeat('0 ', cast(x.j - coalesce(get(cells, k - 1).j, -1) - 1 as int)), cast(x.n as string))),
        case when coalesce(get(cells, size(cells) - 1).j, -1) < {size - 1} then array(concat('0', repeat(' 0', cast({size - 2} - coalesce(get(cells, size(cells) - 1).j, -1) as int))))
             else cast(array() as array<string>) end), ' ')""")
    rows = head.unionByName(_rows(cells, names), allowMissingColumns=True).repartitionByRange(_tasks(size), "i").sortWithinPartitions("i")
    rows.select(F.coalesce("value", line).alias("value")).write.option("compression", compression).text(path)


def _rows(cells: DataFrame, names: DataFrame) -> DataFrame:
    """``i, cells``: each name's counts (j, n) in the order of names, without zeros; a cell given twice raises."""
    at = lambda k, c: names.select(F.col("name").alias(f"t{k}"), F.col("i").cast("long").alias(c))
    cell = F.struct("j", F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n"))
    per = cells.join(at(1, "i"), "t1").join(at(2, "j"), "t2").groupBy("i").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    once = F.size(F.array_distinct("c.j")) == F.size("c")
    none = F.expr("cast(array() as array<struct<j: bigint, n: bigint>>)")
    return names.select(F.col("i").cast("long").alias("i")).join(per, "i", "left").select("i", F.when(F.col("c").isNull(), none).when(once, F.col("c")).otherwise(F.raise_error(F.lit("a cell of the matrix is given twice"))).alias("cells"))


def _per_part(size: int) -> int:
    """Rows of a dense matrix of ``size`` names in a part."""
    return max(1, PART_CELLS // max(1, size))


def _tasks(size: int) -> int:
    """Tasks that write it, by what comes out; the order of Spark's own file names ends beyond five digits."""
    return min(10_000, max(1, -(-size // _per_part(size))))


def matrix_binary(cells: DataFrame, names: DataFrame, path: str, *, magic: bytes = b"\0" * 8, compression: str = "none") -> None:
    """The binary matrix: ``magic``, two u32 of rows and columns, rows of f64, ``magic``; as parts that make the file in the order of their names.

    Each task fills and writes one row at a time, so no matrix is in one place; ``path`` is a
    folder that all executors share. ``compression`` is none or gzip; put together, gzip parts make a gzip file.
    """
    import gzip
    from collections.abc import Iterator
    from contextlib import ExitStack

    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    if compression not in ("none", "gzip"):
        raise ValueError(f"unknown compression {compression}")
    size = names.count()
    per, end = _per_part(size), ".gz" if compression == "gzip" else ""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        with ExitStack() as part:
            for batch in batches:
                js, ns = (batch.column(c) for c in ("js", "ns"))
                at, j, n = np.asarray(js.offsets), np.asarray(js.values), np.asarray(ns.values)
                for k, i in enumerate(batch.column("i").to_pylist()):
                    if i % per == 0:
                        part.close()
                        out = part.enter_context(system.open_output_stream(f"{root}/part-{i:010d}-of-{size:010d}{end}", compression=None))
                        out = part.enter_context(gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0)) if end else out
                    if i == 0:
                        out.write(magic + np.array([size, size], "<u4").tobytes())
                    row = np.zeros(size, "<f8")
                    row[j[at[k] : at[k + 1]]] = n[at[k] : at[k + 1]]
                    out.write(row.tobytes())
                    if i == size - 1:
                        out.write(magic)
                yield pa.RecordBatch.from_pydict({"i": batch.column("i")})

    rows = _rows(cells, names).repartitionByRange(_tasks(size), F.floor(F.col("i") / per)).sortWithinPartitions("i")
    rows.select("i", F.col("cells.j").alias("js"), F.col("cells.n").alias("ns")).mapInArrow(put, "i long").write.format("noop").mode("overwrite").save()
