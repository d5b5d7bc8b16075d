"""Continuous periods and gaps of intervals that overlap, nest or leave stretches open.

All rows are range-sorted once by (entity, start), so an entity with a third of
the rows spreads over as many tasks as its share. Each partition is then
summarised by a few values, the summaries are combined from left to right, and a
second pass over the same partitions starts from the state carried into them.
Summaries form a monoid; there is one per partition, whatever the data's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import checkpointed, partitions, written


class State(NamedTuple):
    """The island still open after some rows of the sorted table."""

    entity: object
    island: int  # its start, which is its label
    end: int  # the largest end so far


class Summary(NamedTuple):
    """One partition: the state it ends in, and whether it holds one entity only."""

    first: object
    state: State

    def after(self, carried: State | None) -> State:
        """The state after this partition when ``carried`` comes in from the left."""
        own = self.state
        if carried is None or self.first != carried.entity or own.entity != self.first:
            return own
        island = carried.island if carried.end >= own.island else own.island
        return State(own.entity, island, max(carried.end, own.end))


def running_end(group: np.ndarray, end: np.ndarray, floor: int | None) -> np.ndarray:
    """Largest ``end`` so far within each run of equal ``group`` (0, 1, 2, ...).

    ``floor`` is what group 0 brings along.
    """
    low = int(end.min()) if floor is None else min(int(end.min()), floor)
    width = max(int(end.max()), low if floor is None else floor) - low + 1
    if (int(group[-1]) + 1) * width < 2**62:
        lifted = group * width + (end - low)
        if floor is not None:
            lifted[0] = max(lifted[0], floor - low)
        return np.maximum.accumulate(lifted) - group * width + low
    out = end.copy()
    if floor is not None:
        out[0] = max(out[0], floor)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(out)], strict=True):
        np.maximum.accumulate(out[a:b], out=out[a:b])
    return out


def scan(batch: pa.RecordBatch, carried: State | None):
    """Rows of a sorted batch: entity codes, running ends, starts of islands, ends just before.

    The first row opens no island where ``carried`` reaches it.
    """
    coded = pa.Table.from_batches([batch]).column("entity").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary
    start = batch.column("start").to_numpy(zero_copy_only=False)
    end = batch.column("end").to_numpy(zero_copy_only=False)
    fresh = np.ones(len(code), bool)
    fresh[1:] = code[1:] != code[:-1]
    goes_on = carried is not None and names[int(code[0])].as_py() == carried.entity
    group = np.cumsum(fresh) - 1
    so_far = running_end(group, end, carried.end if goes_on else None)
    before = np.empty_like(so_far)
    before[1:] = so_far[:-1]
    before[0] = carried.end if goes_on else 0
    fresh[0] = not goes_on
    opens = fresh | (start > before)
    return names, code, start, so_far, before, fresh, opens


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, state, part, rows = None, None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names, code, start, so_far, _, _, opens = scan(batch, state)
        if state is None:
            first, part = names[int(code[0])].as_py(), batch.column("part")[0].as_py()
        at = np.flatnonzero(opens)
        island = int(start[at[-1]]) if len(at) else state.island
        state, rows = State(names[int(code[-1])].as_py(), island, int(so_far[-1])), rows + batch.num_rows
    if state is not None:
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "first": [first], "last": [state.entity], "island": [state.island], "end": [state.end], "n": [rows]}
        )


def combine(summaries: list[tuple[int, Summary]]) -> dict[int, State]:
    """The state carried into each partition, by prefix combination."""
    into, state = {}, None
    for part, summary in sorted(summaries, key=lambda x: x[0]):
        if state is not None and state.entity == summary.first:
            into[part] = state
        state = summary.after(state)
    return into


FRAGMENT = pa.schema([("entity", pa.string()), ("island", pa.int64()), ("end", pa.int64()), ("n", pa.int64()), ("gap_start", pa.int64())])


def _rescanner(into: dict[int, State]):
    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n, gap, started = None, 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not started:
                state, started = into.get(batch.column("part")[0].as_py()), True
            names, code, start, so_far, before, fresh, opens = scan(batch, state)
            at = np.flatnonzero(opens)
            entities, islands, ends, counts, gaps = [], [], [], [], []
            if state is not None and (len(at) == 0 or at[0] > 0):  # rows that still belong to the open island
                upto = int(at[0]) if len(at) else batch.num_rows
                n, state = n + upto, State(state.entity, state.island, int(so_far[upto - 1]))
            if len(at):
                if n:
                    entities, islands, ends, counts, gaps = [state.entity], [state.island], [state.end], [n], [gap]
                closed = np.append(at[1:], batch.num_rows)
                gap_of = [None if f else int(b) for f, b in zip(fresh[at], before[at], strict=True)]
                entities += names.take(pa.array(code[at[:-1]])).to_pylist()
                islands += start[at[:-1]].tolist()
                ends += so_far[closed[:-1] - 1].tolist()
                counts += (closed - at)[:-1].tolist()
                gaps += gap_of[:-1]
                n, gap = int(batch.num_rows - at[-1]), gap_of[-1]
                state = State(names[int(code[-1])].as_py(), int(start[at[-1]]), int(so_far[-1]))
            if entities:
                yield pa.RecordBatch.from_pydict(dict(zip(FRAGMENT.names, (entities, islands, ends, counts, gaps), strict=True)), FRAGMENT)
        if n:
            yield pa.RecordBatch.from_pydict(dict(zip(FRAGMENT.names, ([state.entity], [state.island], [state.end], [n], [gap]), strict=True)), FRAGMENT)

    return rescan


def _reacher(into: dict[int, State]):
    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, started = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not started:
                state, started = into.get(batch.column("part")[0].as_py()), True
            names, code, start, so_far, before, fresh, _ = scan(batch, state)
            known = pa.array(before, pa.int64(), mask=fresh)
            yield pa.RecordBatch.from_arrays([batch.column("entity"), batch.column("start"), batch.column("end"), known], names=["entity", "start", "end", "reach"])
            state = State(names[int(code[-1])].as_py(), int(start[-1]), int(so_far[-1]))

    return reach


def _ordered(df: DataFrame, entity, start, end, parts: int | None) -> tuple[DataFrame, dict[int, State]]:
    """The usable rows, range-sorted and checkpointed, and the state carried into each partition."""
    parts = parts or partitions(df.sparkSession)
    column = lambda c: c if isinstance(c, Column) else F.col(c)
    usable = df.select(column(entity).cast("string").alias("entity"), column(start).cast("long").alias("start"), column(end).cast("long").alias("end")).where(
        F.col("entity").isNotNull() & (F.col("start") < F.col("end"))
    )
    # the last key splits equal intervals, so no repeated one can fill a partition
    ordered = (
        usable.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, "entity", "start", "end", "tie")
        .sortWithinPartitions("entity", "start", "end")
        .select("entity", "start", "end", F.spark_partition_id().alias("part"))
    )
    ordered = checkpointed(ordered)  # both passes must see the same partitions
    rows = ordered.mapInArrow(_summarise, "part int, first string, last string, island long, end long, n long").collect()
    return ordered, combine([(r.part, Summary(r.first, State(r["last"], r.island, r.end))) for r in rows])


def island_fragments(df: DataFrame, entity: str | Column, start: str | Column, end: str | Column, *, parts: int | None = None) -> DataFrame:
    """``entity, island, end, n, gap_start``: the islands, cut where partitions end.

    ``island`` is the start of the whole island and its label; ``gap_start`` is set
    on the fragment that opens an island after another one of the same entity.
    Rows with a null in one of the three, or that are empty or reversed, count for
    nothing. Bounds are whole numbers; entities are compared as strings.
    """
    ordered, into = _ordered(df, entity, start, end, parts)
    return ordered.mapInArrow(_rescanner(into), "entity string, island long, end long, n long, gap_start long")


def periods(df: DataFrame, entity, start, end, **kw) -> DataFrame:
    """``entity, start, end, n``: the continuous periods; intervals that touch are one.

    ``n`` counts the rows of a period, repeated ones each time.
    """
    return (
        island_fragments(df, entity, start, end, **kw)
        .groupBy("entity", F.col("island").alias("start"))
        .agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    )


def gaps(df: DataFrame, entity, start, end, **kw) -> DataFrame:
    """``entity, gap_start, gap_end``: what lies uncovered between an entity's first and last covered place."""
    return (
        island_fragments(df, entity, start, end, **kw)
        .where(F.col("gap_start").isNotNull())
        .select("entity", "gap_start", F.col("island").alias("gap_end"))
    )


def reach_before(df: DataFrame, entity, start, end, *, parts: int | None = None) -> DataFrame:
    """``entity, start, longest, reach``: for each start of an entity its largest end, and the largest end of any earlier start (null for the first)."""
    folded = df.where(F.col(start) < F.col(end)).groupBy(F.col(entity).alias("e"), F.col(start).alias("s")).agg(F.max(end).alias("x"))
    ordered, into = _ordered(folded, "e", "s", "x", parts)
    out = ordered.mapInArrow(_reacher(into), "entity string, start long, end long, reach long")
    return out.withColumnRenamed("end", "longest")


def outer_intervals(df: DataFrame, entity: str, start: str, end: str, *, strict: bool = True) -> DataFrame:
    """The rows of ``df`` that lie in no other interval of their entity.

    ``strict``: only one that begins before and ends behind a row hides it. Else an
    interval with an equal bound hides it too, and equal ones hide each other but
    for one: the anti-join of containment, without comparing pairs.
    """
    r = reach_before(df, entity, start, end).select(F.col("entity").alias("_e"), F.col("start").alias("_s"), "longest", "reach")
    joined = df.join(r, (F.col(entity).cast("string") == F.col("_e")) & (F.col(start) == F.col("_s")))
    if strict:
        kept = joined.where(F.col("reach").isNull() | (F.col("reach") <= F.col(end)))
    else:
        kept = joined.where((F.col("reach").isNull() | (F.col("reach") < F.col(end))) & (F.col(end) == F.col("longest")))
    kept = kept.select(*[kept[c] for c in df.columns])
    return kept if strict else kept.dropDuplicates([entity, start, end])


def complement(df: DataFrame, entity: str, start: str, end: str, lengths: DataFrame, *, name: str = "name", length: str = "length") -> DataFrame:
    """``entity, start, end``: what no interval covers of each entity in ``lengths``, which has one row each.

    Intervals of entities without a length count for nothing; so does what lies
    beyond the length.
    """
    p = periods(df, entity, start, end).select("entity", F.col("start").alias("s"), F.col("end").alias("e"))
    sized = lengths.select(F.col(name).alias("entity"), F.col(length).cast("long").alias("size"))
    ends = p.groupBy("entity").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    heads_tails = sized.join(ends, "entity", "left").select(
        "entity", "size",
        F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("start"), F.coalesce("first", "size").alias("end")),
            F.struct(F.coalesce("last", "size").alias("start"), F.col("size").alias("end")),
        )).alias("x"),
    ).select("entity", "x.start", F.least("x.end", "size").alias("end"))
    inner = gaps(df, entity, start, end).join(sized, "entity").select("entity", F.col("gap_start").alias("start"), F.least("gap_end", "size").alias("end"))
    return heads_tails.unionByName(inner).where("start < end")


def overlap_counts(df: DataFrame, key: str, entity: str, start: str, end: str) -> DataFrame:
    """``key, overlaps``: how many other intervals of its entity each one overlaps, without pairing them.

    Those that begin before its end, less those that end at or before its start, less
    itself: two running counts over places, read at its bounds.
    """
    from strandloom.operators.prefix import running_sum

    x = df.select(F.col(key).alias("_k"), F.col(entity).alias("_t"), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_t is not null and _s < _e")
    begun = running_sum(x.groupBy("_t", F.col("_s").alias("p")).agg(F.count(F.lit(1)).alias("c")), "_t", "p", "c", out="r")
    ended = running_sum(x.groupBy("_t", F.col("_e").alias("p")).agg(F.count(F.lit(1)).alias("c")), "_t", "p", "c", out="r")
    # both counts at every bound: the last known value at or before it, carried over bins of places
    marks = begun.select("_t", "p", F.col("r").alias("b"), F.lit(None).cast("long").alias("e")).unionByName(ended.select("_t", "p", F.lit(None).cast("long").alias("b"), F.col("r").alias("e")))
    marks = marks.groupBy("_t", "p").agg(F.max("b").alias("b"), F.max("e").alias("e"))
    binned = written(marks.withColumn("_b", F.floor(F.col("p") / F.lit(1 << 16))))  # read twice
    tops = binned.groupBy("_t", "_b").agg(F.max("b").alias("tb"), F.max("e").alias("te"))
    before = Window.partitionBy("_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_t", "_b", F.coalesce(F.max("tb").over(before), F.lit(0)).alias("tb"), F.coalesce(F.max("te").over(before), F.lit(0)).alias("te"))
    within = Window.partitionBy("_t", "_b").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    strictly = Window.partitionBy("_t", "_b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    known = binned.join(tops, ["_t", "_b"]).select(
        "_t", "p", F.greatest(F.coalesce(F.max("b").over(strictly), F.lit(0)), "tb").alias("begun_before"), F.greatest(F.coalesce(F.max("e").over(within), F.lit(0)), "te").alias("ended_by")
    )
    at_end = known.select("_t", F.col("p").alias("_e"), "begun_before")
    at_start = known.select("_t", F.col("p").alias("_s"), "ended_by")
    out = x.join(at_end, ["_t", "_e"]).join(at_start, ["_t", "_s"])
    return out.select(F.col("_k").alias(key), (F.col("begun_before") - F.col("ended_by") - 1).alias("overlaps"))
