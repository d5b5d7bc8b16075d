"""The given tables as records: clean names, repeated rows folded into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import clean_name, clean_target


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cigar_match(cigar: Column | str) -> Column:
    """Summed length of the ``=`` runs; null where there is no CIGAR."""
    cigar = F.col(cigar) if isinstance(cigar, str) else cigar
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)="), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def match_of(nmatch: Column | str = "nmatch", cigar: Column | str = "cigar") -> Column:
    """``nmatch``, or where it is null what the CIGAR says."""
    nmatch = F.col(nmatch) if isinstance(nmatch, str) else nmatch
    return F.coalesce(nmatch, cigar_match(cigar))


def paf_records(paf: DataFrame) -> DataFrame:
    """One row per ``paf_id``.

    Repeated rows agree but for spelling and for what is missing, so the maximum
    of each column is the record's value whichever row held it. Rows without a
    ``paf_id`` are no record and drop out. The key is unique enough that the
    shuffle is even, however uneven the names are.
    """
    fields = {
        "qname": clean_name("qname"), "qlen": F.col("qlen"), "qstart": F.col("qstart"), "qend": F.col("qend"),
        "strand": F.col("strand"), "tname": clean_target("tname"), "tlen": F.col("tlen"),
        "tstart": F.col("tstart"), "tend": F.col("tend"), "match": match_of(),
        "alnlen": F.col("alnlen"), "mapq": F.col("mapq"), "cigar": F.col("cigar"), "run_at": F.col("run_at"),
    }
    return (
        paf.where(F.col("paf_id").isNotNull())
        .groupBy("paf_id")
        .agg(*[F.max(c).alias(n) for n, c in fields.items()])
    )


def variant_records(variants: DataFrame) -> DataFrame:
    """One row per clean (``ctg``, ``pos``); rows without either drop out."""
    rest = ["base", "n_a", "n_c", "n_g", "n_t", "cov", "is_var", "called_at"]
    return (
        variants.select(clean_name("ctg").alias("ctg"), "pos", *rest)
        .where(F.col("ctg").isNotNull() & F.col("pos").isNotNull())
        .groupBy("ctg", "pos")
        .agg(*[F.max(c).alias(c) for c in rest])
    )
