"""Passages of test items in a corpus, found with a generalised suffix automaton of the items."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import spread, written

#: A run of letters and digits, with the marks that may follow a letter.
TOKEN = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ])*")
#: Letters whose stroke Unicode does not treat as a mark (fixed values).
STROKES = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "æ": "ae", "œ": "oe"})


def normal(word: str) -> str:
    """A word without case and accents."""
    if word.isascii():
        return word.lower()
    bare = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return bare.casefold().translate(STROKES)


class Automaton:
    """Generalised suffix automaton over the words of the items.

    After each word of a text it gives the length of the longest run of words that
    ends there and occurs in some item. ``seed`` is the shortest run whose places
    in the items are looked up. All that is kept is linear in the words: the places
    of a state are a range of one array, in which those of longer runs that end in
    its run stand beside its own.
    """

    def __init__(self, items: list[tuple[object, str]], seed: int):
        self.seed = seed
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.vocabulary.setdefault(normal(w), len(self.vocabulary)) for w in TOKEN.findall(t)], np.int32) for _, t in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        state = np.zeros(sum(map(len, self.items)), np.int64)  # of the whole item up to each word
        item, at = np.zeros_like(state), np.zeros_like(state)
        n = 0
        for k, words in enumerate(self.items):
            last = 0
            for j, w in enumerate(words.tolist()):
                last = self._extend(last, w)
                state[n], item[n], at[n] = last, k, j
                n += 1
        self._place(state, item, at)
        width = max(1, len(self.vocabulary))
        self.steps = {v * width + w: to for v, following in enumerate(self.next) for w, to in following.items()}
        del self.next

    def _place(self, state: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        own = np.bincount(state, minlength=len(self.link)).tolist()
        whole, link = own.copy(), self.link
        shortest_first = sorted(range(1, len(link)), key=self.length.__getitem__)
        for v in reversed(shortest_first):  # a run occurs wherever a longer one that ends in it does
            whole[link[v]] += whole[v]
        begin, free = [0] * len(link), [0] * len(link)
        for v in shortest_first:
            begin[v] = free[link[v]]
            free[link[v]] += whole[v]
            free[v] = begin[v] + own[v]
        order = np.argsort(state, kind="stable")
        start = np.repeat(np.array(begin), own)
        within = np.arange(len(order)) - np.repeat(np.cumsum(own) - own, own)
        self.end_item, self.end_at = np.zeros_like(item), np.zeros_like(at)
        self.end_item[start + within], self.end_at[start + within] = item[order], at[order]
        self.begin, self.whole = begin, whole
        self.anchor = [0] * len(link)  # the state of the run's last ``seed`` words
        for v in shortest_first:
            if self.length[v] >= self.seed:
                self.anchor[v] = v if self.length[link[v]] < self.seed else self.anchor[link[v]]

    def places(self, v: int) -> list[tuple[int, int]]:
        """(item, place of its last word) of each time the state's run occurs."""
        here = slice(self.begin[v], self.begin[v] + self.whole[v])
        return list(zip(self.end_item[here].tolist(), self.end_at[here].tolist(), strict=True))

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        v = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p < 0:
            self.link[v] = 0
        else:
            q = self.next[p][w]
            self.link[v] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return v

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def seeds(self, words: list[int]) -> set[tuple[int, int]]:
        """(item, shift) of every run of ``seed`` words that the text shares with an item.

        ``shift`` is the place in the text less the place in the item. A word that
        no item has is -1.
        """
        out: set[tuple[int, int]] = set()
        step, link, length, anchor, seed, width = self.steps.get, self.link, self.length, self.anchor, self.seed, max(1, len(self.vocabulary))
        held: dict[int, list[tuple[int, int]]] = {}
        v = n = 0
        for i, w in enumerate(words):
            if w < 0:
                v = n = 0
                continue
            to = step(v * width + w)
            while v and to is None:
                v = link[v]
                n = length[v]
                to = step(v * width + w)
            v = to or 0
            n = n + 1 if v else 0
            if n >= seed:
                # the state holds runs of several lengths; the seed is in its chain of shorter ones
                a = anchor[v]
                if a not in held:
                    held[a] = self.places(a)
                out.update((k, i - j) for k, j in held[a])
        return out


def spans_on(text: np.ndarray, item: np.ndarray, shift: int, exact: int, window: int, replaced: int) -> list[tuple[int, int, int]]:
    """(start, end, longest run) of the leaked spans of a text against one shift of one item.

    A span is a run of ``exact`` equal words or more, or the union of windows of
    ``window`` words with at most ``replaced`` unequal ones, cut to equal ends.
    """
    a, b = max(0, shift), min(len(text), shift + len(item))
    if b - a < min(exact, window):
        return []
    same = (text[a:b] == item[a - shift : b - shift]).astype(np.int32)
    n = len(same)
    hit = np.zeros(n + 1, np.int32)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same, [0]))))
    runs = [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]
    for s, e in runs:
        if e - s >= exact:
            hit[s] += 1
            hit[e] -= 1
    if n >= window:
        total = np.concatenate(([0], np.cumsum(same)))
        for s in np.flatnonzero(total[window:] - total[:-window] >= window - replaced).tolist():
            hit[s] += 1
            hit[s + window] -= 1
    cover = np.cumsum(hit[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0]))))
    out = []
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        inside = np.flatnonzero(same[s:e])
        s, e = s + int(inside[0]), s + int(inside[-1]) + 1
        longest = max(min(y, e) - max(x, s) for x, y in runs if x < e and y > s)
        out.append((a + s, a + e, longest))
    return out


HITS = pa.schema([("doc", pa.string()), ("item", pa.string()), ("n_words", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("longest", pa.int64())])


def seed_length(exact: int, window: int, replaced: int) -> int:
    """Every passage of either kind has an equal run this long: ``replaced`` words cut a window into that many runs and one."""
    return max(1, min(exact, -(-(window - replaced) // (replaced + 1))))


def _builder(seed: int):
    def build(table: pa.Table) -> pa.Table:
        items = list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))
        made = pickle.dumps(Automaton(items, seed), protocol=5)
        return pa.table({"block": table.column("block").slice(0, 1), "automaton": pa.array([made], pa.binary())})

    return build


def _finder(automata, exact: int, window: int, replaced: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Automaton] = [pickle.loads(b) for b in automata.value]
        known: list[dict[str, int]] = [{} for _ in blocks]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, places = TOKEN.findall(text), None
                for au, codes in zip(blocks, known, strict=True):
                    coded = []
                    for w in words:
                        code = codes.get(w)
                        if code is None:
                            if len(codes) > 200_000:
                                codes.clear()
                            code = codes[w] = au.vocabulary.get(normal(w), -1)
                        coded.append(code)
                    seeds = au.seeds(coded)
                    if not seeds:
                        continue
                    array, places = np.array(coded, np.int32), places or [m.span() for m in TOKEN.finditer(text)]
                    for k, shift in sorted(seeds):
                        for s, e, longest in spans_on(array, au.items[k], shift, exact, window, replaced):
                            rows.append((doc, au.ids[k], len(words), s, e, places[s][0], places[e - 1][1], longest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), HITS, strict=True)], schema=HITS)

    return find


def leaked_spans(
    documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    exact: int = 12, window: int = 30, replaced: int = 2, block_words: int = 100_000, scan_blocks: int = 4,
) -> DataFrame:
    """``doc, item, n_words, start_word, end_word, start, end, longest``: every leaked span of every document.

    A span holds ``exact`` consecutive words of an item, or ``window`` of which at
    most ``replaced`` are replaced one for one. The automaton finds the seeds, and
    each is checked along its shift. A span shared by items has a row for each.
    ``start`` and ``end`` are characters of the text.

    Items are dealt into blocks of about ``block_words`` words, and each block's
    automaton is built in a task. Documents are scanned where they lie, without a
    shuffle, against ``scan_blocks`` automata at a time: these alone are on the driver
    and broadcast, and are dropped when their scan has been written. Few items are
    one scan, which is not written. An item is never cut, so a longer one makes its
    block as large as it is.

    Null or empty texts and items hold nothing; rows without an id are left out.
    Repeated rows give repeated spans.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    kinds = docs.schema["doc"].dataType, items.schema[item].dataType
    docs = spread(docs.withColumn("doc", F.col("doc").cast("string")))
    held = items.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    total = held.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    built = dealt.groupBy("block").applyInArrow(_builder(seed_length(exact, window, replaced)), "block int, automaton binary")
    scans = -(-blocks // scan_blocks)
    if scans > 1:
        built = written(built)
    out = None
    for s in range(scans):
        mine = built.where((F.col("block") >= s * scan_blocks) & (F.col("block") < (s + 1) * scan_blocks)).select("automaton").collect()
        automata = spark.sparkContext.broadcast([bytes(r["automaton"]) for r in mine])
        hits = docs.mapInArrow(_finder(automata, exact, window, replaced), "doc string, item string, n_words long, start_word long, end_word long, start long, end long, longest long")
        if scans > 1:
            hits = written(hits)
            automata.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out.withColumn("doc", F.col("doc").cast(kinds[0])).withColumn("item", F.col("item").cast(kinds[1]))


def leaks(documents: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``doc, item, longest, covered``: a row for each document and item it holds a passage of."""
    return (
        leaked_spans(documents, items, **kw)
        .groupBy("doc", "item")
        .agg(F.max("longest").alias("longest"), F.max(F.col("end_word") - F.col("start_word")).alias("covered"))
    )


def without_leaks(documents: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", coverage: float = 0.5, **kw) -> DataFrame:
    """``doc, text, removed, share``: all documents, leaked spans cut out of the text.

    ``removed`` is the number of words cut and ``share`` their share of the
    document's; from ``coverage`` on, ``text`` is null: too little would be left.
    Spans that overlap are cut once. Documents without a leak keep their text.
    """
    spans = (
        leaked_spans(documents, items, doc=doc, text=text, **kw)
        .groupBy("doc")
        .agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "end", "start_word", "end_word"))).alias("spans"))
    )
    # folds the sorted spans: what is kept so far, where the last one ended, the words gone
    cut = """aggregate(spans, named_struct('out', '', 'at', 0L, 'word', 0L, 'gone', 0L),
        (a, s) -> named_struct(
            'out', if(s.start > a.at, concat(a.out, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int))), a.out),
            'at', greatest(a.at, s.end), 'word', greatest(a.word, s.end_word),
            'gone', a.gone + greatest(0L, s.end_word - greatest(a.word, s.start_word))))"""
    joined = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(spans, "doc", "left").withColumn("c", F.expr(cut))
    share = F.coalesce(F.col("c.gone") / F.col("n_words"), F.lit(0.0))
    rest = F.expr("if(c is null, text, concat(c.out, substring(text, cast(c.at + 1 as int))))")
    return joined.select("doc", F.when(share < coverage, rest).alias("text"), F.coalesce("c.gone", F.lit(0)).alias("removed"), share.alias("share"))
