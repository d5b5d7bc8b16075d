"""Coverage of segments from pairs, spikes in it, and places where a phase switches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.prefix import running_sum
from strandloom.session import checkpointed, written


def pair_deltas(pairs: DataFrame, contig: str) -> DataFrame:
    """``contig, pos, delta``: a pair covers from its left mate's start to the right one's end.

    ``pairs`` has pos1, end1, pos2, end2. Deltas of one place are folded.
    """
    first = F.col("pos1") < F.col("pos2")
    low, high = F.when(first, F.col("pos1")).otherwise(F.col("pos2")), F.when(first, F.col("end2")).otherwise(F.col("end1"))
    each = F.explode(F.array(F.struct(low.alias("pos"), F.lit(1).alias("delta")), F.struct(high.alias("pos"), F.lit(-1).alias("delta"))))
    return (
        pairs.select(F.col(contig).alias("contig"), each.alias("d")).where("contig is not null and d.pos is not null")
        .groupBy("contig", "d.pos").agg(F.sum("d.delta").cast("long").alias("delta")).where("delta != 0")
    )


def interval_deltas(df: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """``contig, pos, delta`` of plain intervals; empty ones and nulls count for nothing."""
    each = F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("delta")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("delta"))))
    return (
        df.where(F.col(contig).isNotNull() & (F.col(start) < F.col(end)))
        .select(F.col(contig).alias("contig"), each.alias("d"))
        .groupBy("contig", "d.pos").agg(F.sum("d.delta").cast("long").alias("delta")).where("delta != 0")
    )


def coverage_runs(deltas: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """``contig, start, end, cov``: stretches of equal coverage between events.

    With ``lengths`` (contig, length) the parts before the first and behind the last
    event are runs of 0. Nothing grows with the length of a contig.
    """
    events = deltas
    if lengths is not None:
        ends = lengths.select("contig", F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("pos"), F.lit(0).cast("long").alias("delta"))
        events = deltas.unionByName(ends).groupBy("contig", "pos").agg(F.sum("delta").alias("delta"))
    summed = running_sum(events, "contig", "pos", "delta", out="cov")
    upto = Window.partitionBy("contig", F.floor(F.col("pos") / F.lit(1 << 16))).orderBy("pos")
    # the next event: within the stretch, else the first one of the next stretch that has any
    binned = written(summed.withColumn("_b", F.floor(F.col("pos") / F.lit(1 << 16))))
    heads = binned.groupBy("contig", "_b").agg(F.min("pos").alias("_head"))
    after = heads.select("contig", "_b", F.lead("_head").over(Window.partitionBy("contig").orderBy("_b")).alias("_after"))
    runs = binned.withColumn("_next", F.lead("pos").over(upto)).join(after, ["contig", "_b"]).select("contig", F.col("pos").alias("start"), F.coalesce("_next", "_after").alias("end"), F.col("cov").cast("long"))
    return runs.where("end is not null")


#: A run of more than five times the one before counts as a spike only above this; lower ones never depend on what came before (fixed values).
SPIKE_FLOOR, SPIKE_TIMES, SPIKE_MOST = 100, 5, 5000


def clamp(prev: int, cov: int) -> int:
    """The clamped value of a run of ``cov`` after one of ``prev``."""
    return prev if cov > SPIKE_MOST or (prev > SPIKE_FLOOR and cov > SPIKE_TIMES * prev) else cov


class Steps:
    """What the runs of a stretch make of any value before them.

    A value passes unchanged until a run is no spike for it: the first run of at most
    5000 if the value is at most 100, else the first such run of at most five times
    it. ``steps`` are (that run's coverage, value now), the coverages falling. Few:
    values that differ lie five times apart, and equal neighbours are one.
    """

    def __init__(self, steps: list[tuple[int, int]] | None = None):
        self.steps = steps or []

    def add(self, cov: int) -> None:
        if cov > SPIKE_MOST:
            return
        moved = [(c, clamp(x, cov)) for c, x in self.steps]
        if not moved or cov < moved[-1][0]:
            moved.append((cov, cov))
        self.steps = [m for k, m in enumerate(moved) if k + 1 == len(moved) or moved[k + 1][1] != m[1]]

    def __call__(self, prev: int) -> int:
        if not self.steps:
            return prev
        if prev <= SPIKE_FLOOR:
            return self.steps[0][1]
        return next((x for c, x in self.steps if c <= SPIKE_TIMES * prev), prev)


NO_COVERAGE = -(2**62)  # stands for null, which clamps nothing


def _columns(batch: pa.RecordBatch) -> tuple[list, list]:
    return batch.column("_entity").to_pylist(), batch.column("_cov").to_pylist()


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, first, last, value, steps = None, None, None, None, Steps()
    for batch in batches:
        for entity, cov in zip(*_columns(batch), strict=True):
            if last is None:
                part, first = batch.column("_part")[0].as_py(), entity
            value = cov if entity != last else clamp(value, cov)
            if entity == first:
                steps.add(cov)
            last = entity
    if last is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [last], "value": [value], "bounds": [[c for c, _ in steps.steps]], "values": [[x for _, x in steps.steps]]}, schema=SUMMARY)


SUMMARY = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("value", pa.int64()), ("bounds", pa.list_(pa.int64())), ("values", pa.list_(pa.int64()))])


def _clamper(into: dict[int, tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value, started = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not started:
                (last, value), started = into.get(batch.column("_part")[0].as_py(), (None, None)), True
            out = []
            for entity, cov in zip(*_columns(batch), strict=True):
                value = cov if entity != last else clamp(value, cov)
                last = entity
                out.append(None if value == NO_COVERAGE else value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("contig", "start", "end", "cov")], pa.array(out, pa.int64())], ["contig", "start", "end", "cov", "clamped"])

    return run


def clamp_spikes(runs: DataFrame) -> DataFrame:
    """``contig, start, end, cov, clamped``: a spike takes the value before it, itself clamped.

    A run is a spike if it exceeds 5000, or five times a predecessor above 100; a
    contig's first run is none. Range-sorted by (contig, start): each partition is
    summed up as what it makes of any value before it, the driver chains the
    summaries, and a second pass starts from the carried values. No contig is one task or row.
    """
    contig = runs.schema["contig"].dataType.simpleString()
    whole = runs.where("contig is not null").select("contig", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "cov")])
    ordered = whole.withColumn("_entity", F.col("contig").cast("string")).withColumn("_cov", F.coalesce("cov", F.lit(NO_COVERAGE))).orderBy("_entity", "start", "end", "_cov")
    ordered = checkpointed(ordered.withColumn("_part", F.spark_partition_id()))  # both passes must see the same partitions
    summaries = ordered.mapInArrow(_summarise, "part int, first string, last string, value long, bounds array<long>, values array<long>").collect()
    into, state = {}, (None, None)
    for s in sorted(summaries, key=lambda x: x.part):
        if state[0] == s.first:
            into[s.part] = state
        goes_on = state[0] == s.first == s.last
        state = s.last, Steps(list(zip(s.bounds, s["values"], strict=True)))(state[1]) if goes_on else s.value
    return ordered.mapInArrow(_clamper(into), f"contig {contig}, start long, end long, cov long, clamped long")


def switch_points(runs: DataFrame, value: str = "clamped", *, least_mean: int = 35) -> DataFrame:
    """``contig, pos, mean``: where coverage collapses in a contig, if it does.

    The mean is over all bases and one more; below ``least_mean`` nothing is called. Between the first and the last base of at least 0.8 of the
    mean, the lowest run is a switch if it is below 0.4 of the mean while the highest
    is above 1.6 of it; the first of equally low ones counts.
    """
    runs = written(runs.select("contig", "start", "end", value))  # read three times
    w = F.col("end") - F.col("start")
    mean = runs.groupBy("contig").agg((F.sum(w * F.col(value)) / (F.sum(w) + 1)).alias("mean")).where(F.floor("mean") >= least_mean)
    x = runs.join(mean, "contig")
    high = F.col(value) >= F.floor(F.col("mean") * 0.8)
    bounds = x.groupBy("contig").agg(F.min(F.when(high, F.col("start"))).alias("left"), F.max(F.when(high, F.col("end"))).alias("right"))
    inside = x.join(bounds, "contig").where("left is not null and end > left and start < right")
    out = inside.groupBy("contig").agg(
        F.first("mean").alias("mean"), F.min(F.struct(F.col(value).alias("v"), F.greatest("start", "left").alias("at"))).alias("low"), F.max(value).alias("top")
    )
    return out.where("low.v < floor(mean * 0.4) and top > floor(mean * 1.6)").select("contig", F.col("low.at").alias("pos"), "mean")
