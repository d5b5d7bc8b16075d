"""Bases, segment names and other small expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; case and any other letter (N) stay."""
    return F.translate(F.reverse(_c(seq)), "ACGTacgt", "TGCAtgca")


def is_dna(seq: Column | str) -> Column:
    return _c(seq).rlike("^[ACGTNacgtn]*$")


def base_letter(code: Column | str, lower: bool = False) -> Column:
    """0-3 as A, C, G, T; null for any other code."""
    letters = F.array(*[F.lit(x) for x in ("acgt" if lower else "ACGT")])
    return F.when(_c(code).between(0, 3), F.try_element_at(letters, _c(code).cast("int") + 1))


def base_code(letter: Column | str) -> Column:
    """A, C, G, T in either case as 0-3; null for any other letter."""
    at = F.instr(F.lit("ACGT"), F.upper(_c(letter)))
    return F.when((at > 0) & (F.length(_c(letter)) == 1), at - 1)


def split_fields(text: Column | str, delimiter: str) -> Column:
    """Fields between delimiters; neighbouring delimiters count once, so no field is empty."""
    import re

    return F.filter(F.split(_c(text), re.escape(delimiter)), lambda x: x != "")


def region(name: Column | str, start: Column | str, end: Column | str) -> Column:
    """``name:start-end``, the name of a segment."""
    return F.format_string("%s:%d-%d", _c(name), _c(start), _c(end))


def parse_region(segment: Column | str) -> Column:
    """Struct (name, start, end) of a segment's name; another name stays whole, from 0, without an end."""
    seg, pattern = _c(segment), r"^(\w+):(\d+)-(\d+)"
    part = lambda k: F.nullif(F.regexp_extract(seg, pattern, k), F.lit(""))
    return F.struct(
        F.coalesce(part(1), seg).alias("name"), F.coalesce(part(2).cast("long"), F.lit(0)).cast("long").alias("start"), part(3).cast("long").alias("end")
    )


def wrapped(seq: Column | str, width: int = 80) -> Column:
    """A sequence on lines of ``width`` letters."""
    return F.regexp_replace(_c(seq), f"(.{{{width}}})(?=.)", "$1\n")


def padded_name(number: Column | str, homolog: Column | str | None = None) -> Column:
    """``000012F`` or, with the number of a homolog, ``000012F_003``."""
    base = F.concat(F.lpad(_c(number).cast("string"), 6, "0"), F.lit("F"))
    return base if homolog is None else F.concat(base, F.lit("_"), F.lpad(_c(homolog).cast("string"), 3, "0"))


def lifted_start(strand: Column | str, start: Column | str, end: Column | str) -> Column:
    """First base of a query along the target: on the reverse strand its last one."""
    return F.when(_c(strand) == "-", _c(end) - 1).otherwise(_c(start))


def is_snv(ref: Column | str, alt: Column | str) -> Column:
    return (F.length(_c(ref)) == 1) & (F.length(_c(alt)) == 1)


def allele_key(ref: Column | str, alt: Column | str, primary: bool = True) -> Column:
    """Equal for the two sides of a site: the alternate side is written the other way round."""
    return F.concat(_c(ref), _c(alt)) if primary else F.concat(_c(alt), _c(ref))


def without_flags(flag: Column | str, bits: int = 2316) -> Column:
    """Alignments with none of the bits (default: unmapped, mate unmapped, secondary, supplementary)."""
    return _c(flag).bitwiseAND(bits) == 0


def chain_gap(strand: Column | str, qend1, tstart1, tend1, qstart2, tstart2, tend2) -> Column:
    """Difference between the query's and the target's distance of two hits in a chain."""
    target = F.when(_c(strand) == "-", _c(tstart1) - _c(tend2)).otherwise(_c(tstart2) - _c(tend1))
    return F.abs((_c(qstart2) - _c(qend1)) - target)
