"""Queries p6, p7 and p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import languages as lang
from strandloom.llm.leakage import leaks, without_leaks
from strandloom.llm.mixing import mix
from strandloom.records import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("longest").alias("longest_run"), F.col("covered").alias("covered_words")
    )


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    out = without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return out.select(F.col("doc").alias("doc_id"), F.col("text").alias("clean_text"), F.col("removed").alias("removed_words"), F.round("share", 6).alias("removed_share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report.where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p7_order(spark: SparkSession, d: str) -> DataFrame:
    out = mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).order
    return out.select(F.col("doc").alias("doc_id"), "source", "copy", "tokens", "position")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return lang.wrong_labels(documents, lang.fit(table(spark, d, "lang_samples"), documents)).select(F.col("doc").alias("doc_id"), "text_lang")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    out = lang.languages(documents, lang.fit(table(spark, d, "lang_samples"), documents))
    return out.select(F.col("doc").alias("doc_id"), F.posexplode("segments").alias("segment", "s")).select(
        "doc_id", "segment", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.lang").alias("text_lang"), F.round("s.confidence", 6).alias("confidence")
    )


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's main language, the share of its words, and the mean confidence of its segments in it."""
    documents = table(spark, d, "documents")
    out = lang.languages(documents, lang.fit(table(spark, d, "lang_samples"), documents))
    return lang.main_language(out).select(F.col("doc").alias("doc_id"), "text_lang", F.round("share", 6).alias("word_share"), F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "p6_found": p6_found, "p6_leaks": p6_leaks, "p6_cleaned": p6_cleaned,
    "p7_found": p7_found, "p7_report": p7_report, "p7_order": p7_order,
    "p8_found": p8_found, "p8_segments": p8_segments, "p8_documents": p8_documents,
}

#: The words of a text without case and accents; the strokes and the sharp s are no accents.
WORDS = r"regexp_extract_all(replace(replace(replace(translate(strip_accents(lower(text)), 'łøđħŧ', 'lodht'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '[\p{L}\p{N}]+')"
#: Any common tokenizer gives the same cases for p7; here a token is a word or a sign.
SQL = {
    "p6_found": f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        t AS (SELECT item_id, {WORDS} AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
        dw AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), tw AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS j FROM t),
        ds AS (SELECT doc_id, i, array_to_string(w[i : i + 9], ' ') AS run FROM dw WHERE i + 9 <= len(w)),
        ts AS (SELECT item_id, j, array_to_string(w[j : j + 9], ' ') AS run FROM tw WHERE j + 9 <= len(w)),
        shifts AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM ds JOIN ts USING (run)),
        same AS (SELECT s.doc_id, s.item_id, s.shift, dw.i, CAST(dw.w[dw.i] = tw.w[tw.j] AS INTEGER) AS e
            FROM shifts s JOIN dw ON dw.doc_id = s.doc_id JOIN tw ON tw.item_id = s.item_id AND tw.j = dw.i - s.shift),
        runs AS (SELECT doc_id, item_id, sum(e) OVER (o ROWS 11 PRECEDING) AS e12, sum(e) OVER (o ROWS 29 PRECEDING) AS e30
            FROM same WINDOW o AS (PARTITION BY doc_id, item_id, shift ORDER BY i))
        SELECT DISTINCT doc_id, item_id FROM runs WHERE e12 = 12 OR e30 >= 28""",
    "p7_found": r"""WITH sizes AS (SELECT nullif(regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g'), '') AS source,
        len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS tokens FROM documents),
        have AS (SELECT source, sum(tokens) AS tokens FROM sizes GROUP BY source)
        SELECT t.source FROM mix_targets t LEFT JOIN have h ON h.source = t.source
        WHERE t.max_repeat * coalesce(h.tokens, 0) < t.target_share * (SELECT sum(tokens) FROM sizes)""",
}
