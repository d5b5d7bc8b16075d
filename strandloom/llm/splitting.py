"""Cutting oversized sequences into overlapping pieces at natural boundaries."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.names import clean_name

PIECES = "array<struct<piece:int,start:int,end:int,cut:string>>"


def atoms_of(stretches: Iterable[int], runs: Iterable[int], size: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(length, strength of the boundary before it, stands alone) of each atomic segment.

    Stretches and boundary runs alternate. A boundary is as strong as its run is
    long; a cut inside a stretch that is too long has strength 0. A stretch that
    fits a piece but not together with an overlap stands alone: its neighbours
    carry the overlap on both its sides.
    """
    room, out = size - overlap, []

    def add(length: int, before: int, inside: int, most: int) -> None:
        if length <= 0:
            return
        if length <= most:
            out.append((length, before, length > room))
            return
        k = -(-length // min(most, room))
        for i in range(k):
            out.append((length * (i + 1) // k - length * i // k, inside if i else before, False))

    runs = [int(r) for r in runs]
    for i, length in enumerate(stretches):
        add(int(length), runs[i - 1] if i else 0, 0, size)
        if i < len(runs):
            add(runs[i], runs[i], runs[i], room - overlap)  # may lie between two that stand alone
    return out


def pieces_of(stretches: Iterable[int], runs: Iterable[int], size: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(piece, start, end, cut) over one item, by agglomerative merging.

    Adjacent atoms sit in a heap by the strength of the boundary between them,
    then by place; the weakest is merged first while the two and their overlap fit.
    ``cut`` says how the piece ends: ``gap``, ``hard`` or ``end``.
    """
    atoms = atoms_of(stretches, runs, size, overlap)
    if not atoms:
        return []
    n = len(atoms)
    length = [a[0] for a in atoms]
    alone = [a[2] for a in atoms]
    strength = [a[1] for a in atoms]
    right, left, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    version = [0] * n

    def cost(i: int, j: int) -> int:
        """Size of the piece i..j with what it repeats of its neighbours."""
        before = left[i] >= 0
        after = right[j] >= 0 and alone[right[j]]
        return length[i] + (length[j] if j != i else 0) + overlap * (before + after)

    heap = [(strength[i + 1], i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or version[i] != vi or version[j] != vj or alone[i] or alone[j]:
            continue
        if cost(i, j) > size:
            continue
        length[i] += length[j]
        alive[j], right[i] = False, right[j]
        version[i] += 1
        if right[i] >= 0:
            left[right[i]] = i
            heapq.heappush(heap, (strength[right[i]], i, right[i], version[i], version[right[i]]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[i], left[i], i, version[left[i]], version[i]))
    out, at, i, k, total = [], 0, 0, 0, sum(a[0] for a in atoms)
    while i >= 0:
        start, end, j = at, at + length[i], right[i]
        if not alone[i] and left[i] >= 0:
            start = max(0, start - overlap)
        if j >= 0 and alone[j]:
            end = min(total, end + overlap)
        kind = "end" if j < 0 else "gap" if strength[j] else "hard"
        out.append((k, start, end, kind))
        at, i, k = at + length[i], j, k + 1
    return out


def _planner(size: int, overlap: int):
    @F.pandas_udf(PIECES)
    def plan(stretches: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([[{"piece": p, "start": a, "end": b, "cut": c} for p, a, b, c in pieces_of(s, r, size, overlap)] for s, r in zip(stretches, runs, strict=True)])

    return plan


def unit_records(units: DataFrame, over: int) -> DataFrame:
    """``unit_id, head, seq, n_bases``: one row per record with more than ``over`` bases.

    Line breaks and blanks within ``seq`` are removed; a null or empty one has no
    bases. Short records go before anything is shuffled. Rows of one record are
    folded by the longest, then greatest sequence. A null ``unit_id`` is no record.
    """
    return (
        units.select("unit_id", clean_name("head").alias("head"), F.regexp_replace("seq", r"\s+", "").alias("seq"))
        .withColumn("n_bases", F.length("seq"))
        .where((F.col("n_bases") > over) & F.col("unit_id").isNotNull())
        .groupBy("unit_id")
        .agg(F.max("head").alias("head"), F.max(F.struct("n_bases", "seq")).alias("s"))
        .select("unit_id", "head", "s.seq", "s.n_bases")
    )


def _cut(seq: Column, start: Column, length: Column) -> Column:
    """A piece in time of its own length; text that is not ASCII is counted in characters."""
    by_bytes = F.substring(seq.cast("binary"), start + 1, length).cast("string")
    return F.when(F.octet_length(seq) == F.length(seq), by_bytes).otherwise(F.substring(seq, start + 1, length))


def split_units(units: DataFrame, *, size: int = 4000, overlap: int = 200, min_run: int = 10) -> DataFrame:
    """Pieces of at most ``size`` bases of every record with more than that.

    ``unit_id, head, cut_kind, longest, piece, start, end, cut, text``. Consecutive
    pieces share ``overlap`` bases. ``longest`` is the longest stretch without a run
    of ``min_run`` N; ``cut_kind`` is ``hard`` if a piece ends so (then it exceeds
    ``size``), else ``gap``; null without pieces.

    Only the lengths of stretches and runs go to Python, which plans the cuts; the
    bases stay in the JVM, so that a batch of long records stays small.
    """
    if not 0 <= 2 * overlap < size:
        raise ValueError("two overlaps must fit a piece")
    run = "[Nn]{" + str(min_run) + ",}"
    records = unit_records(units, size).select(
        "*",
        F.transform(F.split("seq", run, -1), F.length).alias("stretches"),
        F.transform(F.regexp_extract_all("seq", F.lit(run), F.lit(0)), F.length).alias("runs"),
    )
    # the plain explode would infer a filter on the plan and run it twice
    planned = records.withColumn("longest", F.array_max("stretches")).withColumn("pieces", _planner(size, overlap)("stretches", "runs"))
    kind = F.when(F.size("pieces") > 0, F.when(F.exists("pieces", lambda p: p["cut"] == "hard"), "hard").otherwise("gap"))
    return planned.select("unit_id", "head", kind.alias("cut_kind"), "longest", "seq", F.explode_outer("pieces").alias("p")).select(
        "unit_id", "head", "cut_kind", "longest", "p.piece", "p.start", "p.end", "p.cut",
        _cut(F.col("seq"), F.col("p.start"), F.col("p.end") - F.col("p.start")).alias("text"),
    )
