"""CIGAR strings as arrays of runs, and positions along both sequences.

Each function works row by row in the JVM, on the few runs of one alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that move along the reference, and along the query (fixed values).
ON_REFERENCE, ON_QUERY = "M=XDN", "M=XIS"


def runs(cigar: Column | str) -> Column:
    """``array<struct<len long, op string>>``; empty for an empty or ``*`` CIGAR, null for null."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    found = F.regexp_extract_all(c, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("long").alias("len"), F.right(x, F.lit(1)).alias("op")))


def span(cigar: Column | str, ops: str = ON_REFERENCE) -> Column:
    """Bases of the reference (or, with ``ON_QUERY``, of the query) that it covers."""
    return F.aggregate(runs(cigar), F.lit(0).cast("long"), lambda acc, r: acc + F.when(F.instr(F.lit(ops), r["op"]) > 0, r["len"]).otherwise(0))


#: Runs folded at once; longer CIGARs are cut, so that the work stays in proportion to the runs.
CHUNK = 128
_PLACED = "array<struct<op:string,len:bigint,tpos:bigint,qpos:bigint>>"


def _along(run: Column, ops: str) -> Column:
    return F.when(F.instr(F.lit(ops), run["op"]) > 0, run["len"]).otherwise(0)


def walk(df: DataFrame, cigar: str = "cigar", *, tstart: str = "tstart", qstart: str = "qstart") -> DataFrame:
    """``df`` with a row per run: ``run_no, op, len, tpos, qpos``.

    ``tpos`` and ``qpos`` are where the run starts; ``qpos`` counts along the strand
    of the alignment from ``qstart``. Rows without a CIGAR give none.
    """
    total = lambda xs, ops: F.aggregate(xs, F.lit(0).cast("long"), lambda a, r: a + _along(r, ops))
    cut = df.withColumn("_runs", runs(cigar)).where(F.size("_runs") > 0)
    cut = cut.withColumn("_chunks", F.expr(f"transform(sequence(0, cast((size(_runs) - 1) div {CHUNK} as int)), i -> slice(_runs, i * {CHUNK} + 1, {CHUNK}))")).drop("_runs")
    begin = F.struct(F.array().cast("array<struct<t:bigint,q:bigint>>").alias("out"), F.col(tstart).cast("long").alias("t"), F.col(qstart).cast("long").alias("q"))
    starts = F.aggregate(
        "_chunks", begin,
        lambda a, xs: F.struct(F.concat(a["out"], F.array(F.struct(a["t"].alias("t"), a["q"].alias("q")))).alias("out"), (a["t"] + total(xs, ON_REFERENCE)).alias("t"), (a["q"] + total(xs, ON_QUERY)).alias("q")),
        lambda a: a["out"],
    )
    chunks = cut.select(*df.columns, F.posexplode(F.arrays_zip(F.col("_chunks").alias("runs"), starts.alias("at"))).alias("_no", "_chunk"))
    inner = F.aggregate(
        F.col("_chunk.runs"), F.struct(F.array().cast(_PLACED).alias("out"), F.col("_chunk.at.t").alias("t"), F.col("_chunk.at.q").alias("q")),
        lambda a, r: F.struct(
            F.concat(a["out"], F.array(F.struct(r["op"].alias("op"), r["len"].alias("len"), a["t"].alias("tpos"), a["q"].alias("qpos")))).alias("out"),
            (a["t"] + _along(r, ON_REFERENCE)).alias("t"), (a["q"] + _along(r, ON_QUERY)).alias("q"),
        ),
        lambda a: a["out"],
    )
    placed = chunks.select(*df.columns, "_no", F.posexplode(inner).alias("_k", "_run"))
    return placed.select(*df.columns, (F.col("_no") * CHUNK + F.col("_k")).cast("int").alias("run_no"), "_run.op", "_run.len", "_run.tpos", "_run.qpos")


def of_cs(cs: Column | str) -> Column:
    """The CIGAR that a ``cs`` tag stands for: ``:n`` and ``=bases`` are equal, ``*xy`` differ, ``+bases`` are inserted, ``-bases`` deleted, ``~..n..`` skipped.

    Bases that differ one after another are one run. Null for null, empty for a tag without runs.
    """
    c = F.col(cs) if isinstance(cs, str) else cs
    parts = F.regexp_extract_all(c, F.lit(r"(:\d+|(?:\*[a-zA-Z]{2})+|[=+-][a-zA-Z]+|~[a-zA-Z]{2}\d+[a-zA-Z]{2})"), F.lit(1))
    size = lambda p: F.when(p.startswith(":"), F.substr(p, F.lit(2))).when(p.startswith("~"), F.regexp_extract(p, r"\d+", 0)).when(p.startswith("*"), (F.length(p) / 3).cast("int").cast("string")).otherwise((F.length(p) - 1).cast("string"))
    kind = lambda p: F.translate(F.left(p, F.lit(1)), ":=*+-~", "==XIDN")
    return F.array_join(F.transform(parts, lambda p: F.concat(size(p), kind(p))), "")
