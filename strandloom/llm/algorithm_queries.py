"""Queries p2, p4 and p5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.quantiles import day_states, multi_select
from strandloom.llm.splitting import split_units
from strandloom.llm.topn import top_n
from strandloom.records import paf_records, table, variant_records


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    paf = table(spark, d, "paf")
    best = top_n(paf_records(paf), "qname", "paf_id", "match", 3, bounds_from=paf.select(F.col("nmatch").alias("match")))
    return best.select(F.col("group").alias("qname"), F.col("item").alias("paf_id"), F.col("score").alias("match"), "place")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top(spark, d).select("qname", "paf_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_units(table(spark, d, "units")).select(
        "head", "piece", F.col("start").alias("piece_start"), F.col("end").alias("piece_end"), "cut", F.col("text").alias("piece_seq")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_units(table(spark, d, "units")).select("head", "cut_kind").distinct()


def p4_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each record put together again from its pieces, without what they repeat; and whether all pieces fit."""
    pieces = split_units(table(spark, d, "units"))
    per = pieces.groupBy("unit_id").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"), F.max(F.length("text")).alias("most"))
    whole = F.array_join(F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], 201, 1 << 30))), "")
    return per.select("unit_id", "head", F.md5(whole).alias("digest"), (F.col("most") <= 4000).alias("fits"))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return day_states(variant_records(table(spark, d, "variants")).where("cov >= 0"), "ctg", "cov", F.to_date("called_at"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    out = multi_select(_coverage(spark, d), [*shares.values()])
    return out.groupBy(F.col("group").alias("ctg")).agg(
        F.first("n").alias("n_positions"), *[F.max(F.when(F.col("share") == s, F.col("value"))).alias(c) for c, s in shares.items()]
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = multi_select(_coverage(spark, d), [0.5, 0.95])
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    return out.groupBy(F.col("group").alias("ctg")).agg(at(0.5).alias("p50"), at(0.95).alias("p95")).where("p95 >= 2 * p50").select("ctg")


QUERIES = {"p2_found": p2_found, "p2_top": p2_top, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rebuilt": p4_rebuilt, "p5_found": p5_found, "p5_percentiles": p5_percentiles}

NAME = "nullif(regexp_extract({0}, '^\\s*>?(\\S*)', 1), '')"
MATCH = "coalesce(nmatch, list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)=', 1), lambda x: CAST(x AS BIGINT))), CASE WHEN cigar IS NOT NULL THEN 0 END)"
TOP = f"""WITH records AS (SELECT paf_id, max({NAME.format("qname")}) AS qname, max({MATCH}) AS match FROM paf WHERE paf_id IS NOT NULL GROUP BY paf_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qname ORDER BY match DESC, paf_id) AS INTEGER) AS place FROM records WHERE qname IS NOT NULL AND match IS NOT NULL)"""
COV = f"""WITH positions AS (SELECT {NAME.format("ctg")} AS ctg, pos, max(cov) AS cov FROM variants WHERE {NAME.format("ctg")} IS NOT NULL AND pos IS NOT NULL GROUP BY 1, 2),
    ranked AS (SELECT ctg, cov, row_number() OVER (PARTITION BY ctg ORDER BY cov) AS r, count(*) OVER (PARTITION BY ctg) AS n FROM positions WHERE cov >= 0)"""

SQL = {
    "p2_found": f"{TOP} SELECT qname, paf_id FROM ranked WHERE place <= 3",
    "p2_top": f"{TOP} SELECT qname, paf_id, match, place FROM ranked WHERE place <= 3",
    "p4_found": f"""WITH records AS (SELECT unit_id, max({NAME.format("head")}) AS head, max(regexp_replace(seq, '\\s+', '', 'g')) AS seq FROM units WHERE unit_id IS NOT NULL GROUP BY unit_id)
        SELECT DISTINCT head, CASE WHEN list_max(list_transform(regexp_split_to_array(seq, '[Nn]{{10,}}'), lambda x: length(x))) > 4000 THEN 'hard' ELSE 'gap' END AS cut_kind
        FROM records WHERE length(seq) > 4000""",
    "p4_rebuilt": f"""SELECT unit_id, max({NAME.format("head")}) AS head, md5(max(regexp_replace(seq, '\\s+', '', 'g'))) AS digest, true AS fits FROM units
        WHERE unit_id IS NOT NULL AND length(regexp_replace(seq, '\\s+', '', 'g')) > 4000 GROUP BY unit_id""",
    "p5_found": f"{COV} SELECT ctg FROM ranked GROUP BY ctg HAVING min(cov) FILTER (WHERE 100 * r >= 95 * n) >= 2 * min(cov) FILTER (WHERE 2 * r >= n)",
    "p5_percentiles": f"{COV} SELECT ctg, max(n) AS n_positions, "
    + ", ".join(f"min(cov) FILTER (WHERE 100 * r >= {p} * n) AS p{p:02d}" for p in (5, 25, 50, 75, 95))
    + " FROM ranked GROUP BY ctg",
}
