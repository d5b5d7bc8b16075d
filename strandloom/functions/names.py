"""Names of sequences, which files spell in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(col: Column | str) -> Column:
    """Without outer blanks, a leading ``>`` and everything from the first blank on.

    A name of which nothing is left is null.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(col, r"^\s*>?(\S*)", 1), F.lit(""))


def clean_target(col: Column | str) -> Column:
    """As :func:`clean_name`; ``*``, which stands for unmapped, is null too."""
    return F.nullif(clean_name(col), F.lit("*"))
