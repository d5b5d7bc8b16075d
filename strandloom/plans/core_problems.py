"""Queries p1 and p3, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.names import clean_name
from strandloom.operators import intervals
from strandloom.operators.keyed import heavy_keys, target_totals
from strandloom.records import table


def usable_intervals(paf: DataFrame) -> DataFrame:
    """Rows with a name and 0 <= qstart < qend <= qlen; repeated rows don't change a union."""
    return paf.where("0 <= qstart and qstart < qend and qend <= qlen").select(clean_name("qname").alias("qname"), "qstart", "qend")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.gaps(usable_intervals(table(spark, d, "paf")), "qname", "qstart", "qend")
    return out.select(F.col("entity").alias("qname"), "gap_start", "gap_end")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.periods(usable_intervals(table(spark, d, "paf")), "qname", "qstart", "qend")
    return out.select(F.col("entity").alias("qname"), F.col("start").alias("period_start"), F.col("end").alias("period_end"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(target_totals(table(spark, d, "paf")), "tname", "n_records", 0.03)


def p3_target_totals(spark: SparkSession, d: str) -> DataFrame:
    return target_totals(table(spark, d, "paf"))


QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods, "p3_found": p3_found, "p3_target_totals": p3_target_totals}

NAME = "nullif(regexp_extract({0}, '^\\s*>?(\\S*)', 1), '')"
Q, T = NAME.format("qname"), NAME.format("tname")
MATCH = "coalesce(nmatch, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)=', 1), lambda x: CAST(x AS BIGINT))), CASE WHEN cigar IS NOT NULL THEN 0 END)"
USABLE = f"""usable AS (SELECT {Q} AS qname, qstart, qend FROM paf
    WHERE 0 <= qstart AND qstart < qend AND qend <= qlen AND {Q} IS NOT NULL),
reach AS (SELECT *, max(qend) OVER (PARTITION BY qname ORDER BY qstart, qend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM usable)"""
RECORDS = f"""records AS (SELECT paf_id, max({Q}) AS qname, max(nullif({T}, '*')) AS tname, max({MATCH}) AS match,
    max(tstart) AS tstart, max(tend) AS tend FROM paf WHERE paf_id IS NOT NULL GROUP BY paf_id)"""
TOTALS = f"""{RECORDS}, totals AS (SELECT tname, count(*) AS n_records, CAST(sum(match) AS BIGINT) AS sum_match, min(tstart) AS span_start,
    max(tend) AS span_end, max(tend) - min(tstart) AS span FROM records WHERE tname IS NOT NULL GROUP BY tname)"""

SQL = {
    "p1_found": f"WITH {USABLE} SELECT qname, so_far AS gap_start, qstart AS gap_end FROM reach WHERE qstart > so_far",
    "p1_periods": f"""WITH {USABLE}, label AS (SELECT *, sum(CASE WHEN so_far IS NULL OR qstart > so_far THEN 1 ELSE 0 END)
        OVER (PARTITION BY qname ORDER BY qstart, qend ROWS UNBOUNDED PRECEDING) AS island FROM reach)
        SELECT qname, min(qstart) AS period_start, max(qend) AS period_end FROM label GROUP BY qname, island""",
    "p3_found": f"WITH {TOTALS} SELECT tname FROM totals WHERE n_records >= 0.03 * (SELECT sum(n_records) FROM totals)",
    "p3_target_totals": f"WITH {TOTALS} SELECT * FROM totals",
}
