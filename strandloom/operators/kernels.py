"""Per-key algorithms that no expression states: chaining, local search, bounded paths.

Each takes the rows of one key (a query's hits, a contig's segment pairs) and is
plain numpy; Spark partitions the keys.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import written


def by_key(df: DataFrame, key: str, order: list[str], fn, schema: str) -> DataFrame:
    """``fn`` over each key's rows, which come in ``order`` as arrays by column; it returns arrays by column.

    Keys are hash-partitioned and sorted within partitions; a task streams its
    partition in batches and holds one key's rows at a time. Much cheaper than a
    grouped map where most keys are small.
    """
    out_schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(table: pa.Table, cuts: list[int]) -> pa.RecordBatch | None:
            arrays = {c: table.column(c).to_numpy() for c in table.column_names}
            parts = [r for a, b in zip(cuts, cuts[1:], strict=False) if (r := fn({c: x[a:b] for c, x in arrays.items()})) is not None]
            if not parts:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[f.name] for p in parts]), f.type) for f in out_schema], schema=out_schema)

        held: list[pa.RecordBatch] = []  # of the key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).dictionary_encode().indices.to_numpy()
            inside = (np.flatnonzero(np.diff(keys)) + 1).tolist()
            if held and held[-1].column(key)[-1].as_py() == batch.column(key)[0].as_py() and not inside:
                held.append(batch)
                continue
            rows = sum(b.num_rows for b in held)
            same = held and held[-1].column(key)[-1].as_py() == batch.column(key)[0].as_py()
            cuts = [0, *([] if same or not held else [rows]), *[rows + k for k in inside]]
            table = pa.Table.from_batches([*held, batch])
            if len(cuts) > 1 and (out := groups(table.slice(0, cuts[-1]), cuts)) is not None:
                yield out
            held = table.slice(cuts[-1]).combine_chunks().to_batches()
        if held and (out := groups(pa.Table.from_batches(held), [0, sum(b.num_rows for b in held)])) is not None:
            yield out

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class _Best:
    """Largest (value, earliest row) over a prefix of ranks."""

    def __init__(self, n: int):
        self.tree = [(-np.inf, 0)] * (n + 1)

    def add(self, rank: int, value: float, row: int) -> None:
        k = rank + 1
        while k < len(self.tree):
            self.tree[k] = max(self.tree[k], (value, -row))
            k += k & -k

    def upto(self, count: int) -> tuple[float, int]:
        best, k = (-np.inf, 0), count
        while k:
            best = max(best, self.tree[k])
            k -= k & -k
        return best


def chain(strand: np.ndarray, tstart: np.ndarray, tend: np.ndarray, match: np.ndarray) -> list[int]:
    """Rows, in the given order, of the chain with the highest score.

    A chain keeps one strand; its score is the matches less the distances on the
    target between neighbours, whichever way they lie. Equal scores: the earlier
    row. Takes n log n steps: the distance splits into the neighbours in front and
    those behind, and each side keeps a running best.
    """
    n = len(match)
    if not n:
        return []
    score, prev = match.astype(float).copy(), np.full(n, -1)
    for sign in ("+", "-"):
        rows = np.flatnonzero(strand == sign)
        if not len(rows):
            continue
        # what a hit offers those after it, and where they reach for it
        offer = tend[rows] if sign == "+" else tstart[rows]
        reach = tstart[rows] if sign == "+" else tend[rows]
        ranks = np.unique(offer)
        below, above = _Best(len(ranks)), _Best(len(ranks))
        for at, row in enumerate(rows.tolist()):
            k = bisect.bisect_right(ranks, reach[at])
            a, b = below.upto(k), above.upto(len(ranks) - k)
            options = [(a[0] - reach[at], a[1]), (b[0] + reach[at], b[1])]
            gained, i = max(options)
            if match[row] + gained > score[row]:
                score[row], prev[row] = match[row] + gained, -i
            r = int(np.searchsorted(ranks, offer[at]))
            below.add(r, score[row] + offer[at], row)
            above.add(len(ranks) - 1 - r, score[row] - offer[at], row)
    out = [int(np.argmax(score))]
    while prev[out[-1]] >= 0:
        out.append(int(prev[out[-1]]))
    return out[::-1]


CHAINED = "qname string, chain_no int, paf_id long, qstart long, qend long, strand string, tname string, tstart long, tend long, match long"


def chain_hits(paf: DataFrame, least_match: int = 5000) -> DataFrame:
    """Members of the best chain of each query; hits below ``least_match`` don't take part.

    Expects clean records: qname, paf_id, qstart, qend, strand, tname, tstart, tend,
    match. The filter and the columns go to the scan; a query's hits are one task.
    """
    columns = ["qname", "paf_id", "qstart", "qend", "strand", "tname", "tstart", "tend", "match"]

    def one(g: dict) -> dict:
        rows = chain(g["strand"], g["tstart"], g["tend"], g["match"])
        return {"chain_no": np.arange(len(rows), dtype="int32"), **{c: g[c][rows] for c in columns}}

    usable = paf.select(*columns).where(F.col("match") >= least_match).dropna()
    return by_key(usable, "qname", ["qstart", "qend", "paf_id"], one, CHAINED)


def placements(chained: DataFrame) -> DataFrame:
    """A row per query: the span of its chain on both sides; on the reverse strand the target's ends swap."""
    ends = chained.groupBy("qname").agg(
        F.min_by(F.struct("qstart", "strand", "tname", "tstart", "tend"), "chain_no").alias("f"),
        F.max_by(F.struct("qend", "tstart", "tend"), "chain_no").alias("l"),
    )
    back = F.col("f.strand") == "-"
    return ends.select(
        "qname", "f.qstart", "l.qend", "f.tname", F.when(back, F.col("l.tstart")).otherwise(F.col("f.tstart")).alias("tstart"),
        F.when(back, F.col("f.tend")).otherwise(F.col("l.tend")).alias("tend"), "f.strand",
    )


#: Rounds of the search; the reference's default, and the least its pipeline allows.
ROUNDS = 10_000


def local_search(n: int, i: np.ndarray, j: np.ndarray, sign: np.ndarray, rounds: int, rng: np.random.Generator, start: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Labels 0/1 of n nodes and their score: consistent ordered pairs.

    ``sign`` is +1 where a pair of nodes wants equal labels, -1 where different, 0 where
    it touches without a vote; edges come in both directions, once each. A
    sweep flips, one after another, each node with more inconsistent than consistent
    votes, until none is left. Then a random node and all it touches flip, and it
    starts again from there; the best labels are kept, the start if none scores.

    Each node's gain (consistent less inconsistent votes) is kept up to date, so a flip
    costs its edges and a score the nodes. Small graphs come back to the same labels
    again and again: where a perturbation leads from there is remembered.
    """
    label = (rng.integers(0, 2, n) if start is None else start).astype(np.int8)
    if not len(i):
        return label, 0
    order = np.argsort(i, kind="stable")
    to, want, first = j[order], sign[order].astype(np.int64), np.searchsorted(i[order], np.arange(n + 1))
    votes, touches = np.count_nonzero(want), [np.unique(np.append(to[a:b], k)) for k, (a, b) in enumerate(zip(first, first[1:], strict=False))]
    spin = 1 - 2 * label.astype(np.int64)
    gain = np.bincount(i[order], want * spin[i[order]] * spin[to], n).astype(np.int64)

    def flip(node: int) -> None:
        a, b = first[node], first[node + 1]
        spin[node], gain[node] = -spin[node], -gain[node]
        gain[to[a:b]] += 2 * want[a:b] * spin[node] * spin[to[a:b]]

    def sweep() -> None:
        at = 0
        while True:
            low = gain[at:] < 0
            k = int(low.argmax()) if len(low) else 0
            if len(low) and low[k]:
                flip(at + k)
                at += k + 1
            elif at:
                at = 0
            else:
                return

    def perturb(node: int) -> None:
        touched = touches[node]
        if 2 * len(touched) > n:  # all nodes at once change no gain: flip all, and the others back
            spin[:] = -spin
            touched = np.setdiff1d(np.arange(n), touched, assume_unique=True)
        for x in touched.tolist():
            flip(x)

    best, best_score = label.copy(), 0
    draws = rng.integers(n, size=max(0, rounds - 1)).tolist()
    places: dict[bytes, int] = {}  # where sweeps ended: its number
    held: list[tuple[np.ndarray, np.ndarray]] = []
    onward: dict[tuple[int, int], int] = {}  # and where a sweep ends from there, by the node drawn
    at = -1
    for k in range(max(1, rounds)):
        if k and n <= 64:
            step = at, draws[k - 1]
            if (seen := onward.get(step)) is not None:
                at = seen
                continue
            spin[:], gain[:] = held[at]
        if k:
            perturb(draws[k - 1])
        sweep()
        score = int(gain.sum() + votes) // 2
        if score > best_score:
            best, best_score = ((1 - spin) // 2).astype(np.int8), score
        if n <= 64:
            at = places.setdefault(spin.tobytes(), len(held))
            if at == len(held):
                held.append((spin.copy(), gain.copy()))
            if k:
                onward[step] = at
    return best, best_score


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``grp, idx, part``: the smallest idx that a node is connected with, by joins.

    ``edges``: grp, i, j in both directions; ``nodes``: grp, idx. Each round takes the
    smallest part around a node, then the part of that part: long paths take few rounds.
    """
    edges = written(edges.select("grp", "i", "j"))
    found = written(nodes.select("grp", "idx", F.col("idx").alias("part")))
    while True:
        near = edges.join(found.select("grp", F.col("idx").alias("j"), "part"), ["grp", "j"]).groupBy("grp", F.col("i").alias("idx")).agg(F.min("part").alias("_near"))
        lower = written(found.join(near, ["grp", "idx"], "left").select("grp", "idx", F.col("part").alias("_was"), F.least("part", "_near").alias("part")))
        jump = lower.select("grp", F.col("idx").alias("part"), F.col("part").alias("_next"))
        found = written(lower.join(jump, ["grp", "part"]).select("grp", "idx", F.col("_next").alias("part"), (F.col("_next") != F.col("_was")).alias("_moved")))
        if found.where("_moved").isEmpty():
            return found.drop("_moved")
        found = found.drop("_moved")


def phase_labels(blocks: DataFrame, pairs: DataFrame, *, rounds: int = ROUNDS, seed: int = 10_000, start: int | None = None, split: bool = False) -> DataFrame:
    """``grp, idx, a, b, label``: which of a pair's segments goes to which haplotype.

    ``blocks`` as of ``contacts.block_sums``; tied ones don't vote, but the pairs touch.
    The generator is seeded by (seed, grp),
    so neither partitioning nor order changes a result. Labels start at random, or
    at ``start``; pairs without contacts keep theirs. One task holds one group's
    contacts, as lists: groups are contigs or, for scaffolds, all their pairs. With
    ``split`` each connected part of a group is searched on its own, in all rounds.
    """
    grp_type = pairs.schema["grp"].dataType.simpleString()

    def one(g: dict) -> dict:
        # every pair has a row i = j, so the nodes are known
        i, j, sign = g["i"], g["j"], g["sign"]
        edge = i != j
        nodes = i[~edge]
        rng = np.random.default_rng([seed, zlib.crc32(str(g["key"][0]).encode())])
        at = lambda x: np.searchsorted(nodes, x[edge])
        labels, _ = local_search(len(nodes), at(i), at(j), sign[edge], rounds, rng, None if start is None else np.full(len(nodes), start))
        return {"grp": g["grp"][: len(nodes)], "idx": nodes, "label": labels.astype("int32")}

    want = blocks.where("same + cross > 0").select("grp", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.signum(F.col("same") - F.col("cross")).cast("long").alias("sign"))
    nodes = pairs.select("grp", F.col("idx").cast("long").alias("i"), F.col("idx").cast("long").alias("j"), F.lit(0).cast("long").alias("sign"))
    key = F.col("grp").cast("string")
    if split:
        want = written(want)
        part = components(want, nodes.select("grp", F.col("i").alias("idx")))
        rows = nodes.unionByName(want).join(part.withColumnRenamed("idx", "i"), ["grp", "i"]).withColumn("key", F.concat_ws(":", key, "part")).drop("part")
    else:
        rows = nodes.unionByName(want).withColumn("key", key)
    found = by_key(rows, "key", ["i", "j"], one, f"grp {grp_type}, idx long, label int")
    return pairs.select("grp", "idx", "a", "b").join(found, ["grp", "idx"])


def haplotypes(labelled: DataFrame) -> DataFrame:
    """``grp, hap0, hap1``: the result of phasing, a row per pair."""
    own = F.col("label") == 0
    return labelled.select("grp", F.when(own, F.col("a")).otherwise(F.col("b")).alias("hap0"), F.when(own, F.col("b")).otherwise(F.col("a")).alias("hap1"))


def reachable(edges: DataFrame, sources: DataFrame, most: int = 30) -> DataFrame:
    """``src, dst, steps``: what each source reaches in at most ``most`` steps, by frontier joins.

    ``edges``: src, dst. A node is visited once per source, at its fewest steps.
    """
    steps = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    seen = written(sources.select(F.col("src"), F.col("src").alias("dst"), F.lit(0).alias("steps")).distinct())
    front = seen
    for k in range(1, most + 1):
        onward = front.select("src", F.col("dst").alias("at")).join(steps.select(F.col("src").alias("at"), "dst"), "at").select("src", "dst").distinct()
        front = written(onward.join(seen, ["src", "dst"], "left_anti").withColumn("steps", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("steps > 0")


def merge_runs(q0: np.ndarray, q1: np.ndarray, t0: np.ndarray, t1: np.ndarray, qlen: int, tlen: int, least: int) -> list[int]:
    """Places of the runs of equal bases that a target and its query are cut at, in order.

    The first is left out if it begins within ``least`` of either start but not at
    both. One that follows the last kept within ``least`` on either side takes its
    place if it is at least as long, else it is left out. The last one counts only
    if it ends ``least`` before both ends, or at both.
    """
    n, first = len(q0), 0
    if n and q0[0] + t0[0] != 0 and (q0[0] < least or t0[0] < least):
        first = 1
    if first >= n:
        return []
    kept = [first]
    for k in range(first + 1, n):
        if k == n - 1 and not ((qlen - q1[k] >= least and tlen - t1[k] >= least) or (q1[k] == qlen and t1[k] == tlen)):
            continue
        last = kept[-1]
        if q0[k] - q1[last] <= least or t0[k] - t1[last] <= least:
            if q1[k] - q0[k] >= q1[last] - q0[last]:
                kept[-1] = k
        else:
            kept.append(k)
    return kept


CUT = "tname string, qname string, strand string, piece int, qstart long, qend long, tstart long, tend long"


def cut_between_runs(runs: DataFrame, least: int) -> DataFrame:
    """``tname, qname, strand, piece, qstart, qend, tstart, tend``: what lies between the kept runs of a target and its query.

    ``runs``: tname, qname, strand, qlen, tlen, qpos, tpos, len: the runs of one
    query and strand per target. Runs below ``least`` bases don't count.
    """

    def one(g: dict) -> dict | None:
        q0, t0, q1, t1, qlen, tlen = g["qpos"], g["tpos"], g["qpos"] + g["len"], g["tpos"] + g["len"], int(g["qlen"][0]), int(g["tlen"][0])
        kept = merge_runs(q0, q1, t0, t1, qlen, tlen, least)
        if not kept:
            return None
        edges = [(0, q0[kept[0]], 0, t0[kept[0]])] if q0[kept[0]] and t0[kept[0]] else []
        edges += [(q1[a], q0[b], t1[a], t0[b]) for a, b in zip(kept, kept[1:], strict=False)]
        if q1[kept[-1]] != qlen and t1[kept[-1]] != tlen:
            edges.append((q1[kept[-1]], qlen, t1[kept[-1]], tlen))
        if not edges:
            return None
        n, e = len(edges), np.array(edges, dtype="int64")
        same = {c: np.repeat(g[c][:1], n) for c in ("tname", "qname", "strand")}
        return {**same, "piece": np.arange(n, dtype="int32"), "qstart": e[:, 0], "qend": e[:, 1], "tstart": e[:, 2], "tend": e[:, 3]}

    usable = runs.where(F.col("len") >= least).select("tname", "qname", "strand", "qlen", "tlen", "qpos", "tpos", "len").dropna()
    return by_key(usable, "tname", ["qpos", "tpos"], one, CUT)
