"""Mixing sources to target shares over a training run, with weights that vary over time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.tokens import VOCABULARY, n_tokens
from strandloom.session import checkpointed, partitions, spread, written

#: Rows of a source whose running sum one task may hold.
BUCKET_ROWS = 50_000
#: What sums of doubles may differ by where a source ends exactly at its demand.
EVEN = 1e-12


def clean_source(col: str | Column) -> Column:
    """Without outer blanks, in lower case, blanks and ``-`` as ``_``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_"), F.lit(""))


@dataclass(frozen=True)
class Schedule:
    """Relative weight of a source at evenly spaced times from 0 to 1, linear between.

    Only the shape counts: weights are scaled so that their integral is 1, and a
    source then gets its target share of the tokens over the whole run.
    """

    weights: tuple[float, ...] = (1.0,)

    def segments(self) -> list[tuple[float, float, float, float, float]]:
        """(u_low, u_high, t_low, w_low, slope) of each piece; u is the scaled integral."""
        w = list(self.weights) if len(self.weights) > 1 else [self.weights[0]] * 2
        h = 1 / (len(w) - 1)
        area = sum((a + b) / 2 * h for a, b in zip(w, w[1:], strict=False))
        if min(w) < 0 or area <= 0:
            raise ValueError("weights must not be negative, nor all zero")
        out, u = [], 0.0
        for k, (a, b) in enumerate(zip(w, w[1:], strict=False)):
            du = (a + b) / 2 * h / area
            out.append((u, u + du, k * h, a / area, (b - a) / h / area))
            u += du
        out[-1] = (out[-1][0], 2.0, *out[-1][2:])  # the last document may reach past the demand
        return out


@dataclass(frozen=True)
class Mix:
    """``plan``: a row per source. ``order``: a row per copy of a document, range-sorted by its position."""

    plan: DataFrame
    order: DataFrame
    report: DataFrame = field(repr=False)


def mix(
    documents: DataFrame, targets: DataFrame, *, doc: str = "doc_id", text: str = "text", source: str = "source",
    schedules: dict[str, Schedule] | None = None, budget: int | None = None, vocabulary: str = VOCABULARY, seed: int = 0,
) -> Mix:
    """Orders copies of documents so that each source has its share of the tokens.

    ``targets`` has ``source, target_share, max_repeat``. Each source demands its
    share of ``budget`` tokens (default: those of all documents, also of sources
    without a target). Its documents stand in a random order fixed by ``seed``; a
    document's first token within the source's demand, by inverting the integral of
    the source's schedule, gives its position in [0, 1]. After the last document the
    source starts again, at most ``max_repeat`` times. Sources without a schedule
    keep constant weight; those that may repeat, being small, rise from half to
    one and a half of it.

    ``order``: ``doc, source, copy, tokens, position``. ``report``: ``source,
    target_share, max_repeat, have, demand, supply, placed, copies, share, until, short``;
    ``share`` is the one reached among what was placed, ``until`` the time at which the
    source's last copy ends; ``short`` sources end before their demand is met.

    Documents without tokens (null or empty text) are not placed. Null sources,
    ids, or sources without a target only count towards the budget. Repeated rows
    are documents of their own. A source listed twice in ``targets`` is an error; one
    without documents is short unless it demands nothing.
    """
    spark = documents.sparkSession
    sizes = written(
        spread(documents.select(F.col(doc).alias("doc"), clean_source(source).alias("source"), F.col(text).alias("text")))
        .select("doc", "source", n_tokens("text", vocabulary).alias("tokens")).where("tokens > 0")
    )
    whole = budget if budget is not None else (sizes.agg(F.sum("tokens")).first()[0] or 0)
    goals = targets.select("source", "target_share", "max_repeat").where("source is not null")
    if goals.groupBy("source").count().where("count > 1").limit(1).count():
        raise ValueError("a source has two targets")
    mine = sizes.where("source is not null and doc is not null")
    have = mine.groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("n"))
    share, repeat = F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeat", F.lit(0))
    plan = written(
        goals.join(have, "source", "left").select(
            "source", share.alias("target_share"), repeat.alias("max_repeat"), F.coalesce("have", F.lit(0)).alias("have"),
            (share * F.lit(whole)).alias("demand"), (F.coalesce("have", F.lit(0)) * repeat).alias("supply"), F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
    pieces = _pieces(plan, schedules or {})

    # running sums without a source in one task: within hash buckets, then over the buckets' totals
    buckets = max(1, -(-(plan.agg(F.max("n")).first()[0] or 0) // BUCKET_ROWS))
    key = F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(2**40))
    keyed = mine.join(plan.select("source"), "source").withColumn("key", key)
    keyed = keyed.withColumn("bucket", F.floor(F.col("key") / F.lit(2**40 / buckets)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    start = (
        keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
        .withColumn("start", F.coalesce(F.sum("sum").over(before.partitionBy("source").orderBy("bucket")), F.lit(0)))
        .drop("sum")
    )
    within = before.partitionBy("source", "bucket").orderBy("key", "doc")
    offset = keyed.withColumn("within", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(start, ["source", "bucket"]).withColumn("offset", F.col("start") + F.col("within"))
    copies = (
        offset.join(plan.drop("n"), "source")
        .withColumn("copies", F.least(F.col("max_repeat"), F.ceil((F.col("demand") - F.col("offset")) / F.col("have"))).cast("int"))
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("u", (F.col("copy") * F.col("have") + F.col("offset")) / F.col("demand"))
        .withColumn("reach", F.col("u") + F.col("tokens") / F.col("demand"))
    )
    by = ["position", "source", "doc", "copy"]
    placed = checkpointed(
        _at(copies, "u", pieces, "position").select("doc", "source", "copy", "tokens", "position", "reach")
        .repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    )
    reached = placed.groupBy("source").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("copies"), F.max("reach").alias("reach"))
    all_placed = placed.agg(F.sum("tokens")).first()[0] or 0
    ended = _at(reached.withColumn("end", F.least("reach", F.lit(1.0))), "end", pieces, "until").drop("end")
    none = F.lit(0)
    report = plan.join(ended, "source", "left").select(
        "source", "target_share", "max_repeat", "have", "demand", "supply",
        F.coalesce("placed", none).alias("placed"), F.coalesce("copies", none).alias("copies"),
        (F.coalesce("placed", none) / F.lit(max(1, all_placed))).alias("share"), F.coalesce("until", F.lit(0.0)).alias("until"),
        ((F.col("demand") > 0) & (F.coalesce("reach", F.lit(0.0)) < 1 - EVEN)).alias("short"),
    )
    return Mix(plan.drop("n"), placed.drop("reach"), report)


def _pieces(plan: DataFrame, schedules: dict[str, Schedule]) -> DataFrame:
    """``source, u_low, u_high, t_low, w_low, slope``: a row for each linear piece of each source's schedule."""
    names = ["u_low", "u_high", "t_low", "w_low", "slope"]
    kind = "array<struct<" + ",".join(f"{c}:double" for c in names) + ">>"
    plain = lambda s: F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(p, names, strict=True)]) for p in s.segments()])
    given = plan.sparkSession.createDataFrame([(k, s.segments()) for k, s in schedules.items()], f"source string, given {kind}")
    default = F.when(F.col("max_repeat") > 1, plain(Schedule((0.5, 1.5)))).otherwise(plain(Schedule()))
    return plan.join(given, "source", "left").select("source", F.inline(F.coalesce("given", default)))


def _at(rows: DataFrame, u: str, pieces: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: the time at which the integral of the source's schedule reaches ``u``."""
    rest = F.col(u) - F.col("u_low")  # the root of w x + slope x^2 / 2 = rest
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("w_low") * F.col("w_low") + 2 * F.col("slope") * rest))
    return (
        rows.join(pieces, "source").where((F.col(u) >= F.col("u_low")) & (F.col(u) < F.col("u_high")))
        .withColumn(out, F.col("t_low") + F.when(rest <= 0, 0.0).otherwise(2 * rest / (F.col("w_low") + root)))
        .drop("u_low", "u_high", "t_low", "w_low", "slope")
    )
