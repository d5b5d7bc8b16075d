"""Leaks: against brute force over all shifts, alterations, odd input."""

import random
import unicodedata

from strandloom.llm.leakage import TOKEN, Automaton, leaked_spans, leaks, normal, seed_length, without_leaks

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return [normal(w) for w in TOKEN.findall(text or "")]


def brute(docs, items, exact=12, window=30, replaced=2):
    out = set()
    for d, t in docs:
        for k, u in items:
            a, b = words(t), words(u)
            for n, most in ((exact, 0), (window, replaced)):
                if any(sum(x != y for x, y in zip(a[i : i + n], b[j : j + n])) <= most for i in range(len(a) - n + 1) for j in range(len(b) - n + 1)):
                    out.add((d, k))
    return out


def got(spark, docs, items, **kw):
    return {(r["doc"], r["item"]) for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw).collect()}


def text_of(r, n, vocabulary=60):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_random_against_brute_force(spark):
    r = random.Random(5)
    shared = text_of(r, 14)
    items = [(k, " ".join(text_of(r, 25) + (shared if k % 3 == 0 else []) + text_of(r, 25))) for k in range(8)]
    docs = []
    for d in range(60):
        k, n = r.randrange(8), r.choice([11, 12, 20, 29, 30, 31, 45])
        piece = items[k][1].split()
        start = r.randrange(max(1, len(piece) - n))
        piece = piece[start : start + n]
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            piece[r.randrange(len(piece))] = f"x{r.randrange(9)}"
        docs.append((d, " ".join(text_of(r, r.randrange(20)) + piece + text_of(r, r.randrange(20)))))
    want = brute(docs, items)
    assert 10 < len(want) < 60 * 8
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, block_words=100, scan_blocks=2) == want, "five blocks, three scans"


def test_case_accents_punctuation_and_spacing(spark):
    item = "Zażółć gęślą jaźń, the quick brown fox's école is naïve; über alles çok güzel Ёлка"
    doc = unicodedata.normalize("NFD", item.upper()).replace(" ", " --\n ") + " tail"
    bare = "zazolc gesla jazn the quick brown fox s ecole is naive uber alles cok guzel елка"
    assert got(spark, [(1, doc), (2, bare), (3, "nothing of it")], [(7, item)]) == {(1, 7), (2, 7)}


def test_nulls_empty_repeats_and_no_items(spark):
    item = " ".join(f"a{i}" for i in range(40))
    docs = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "a1 a2")]
    items = [(1, item), (2, item), (3, None), (4, ""), (None, item), (5, "a1 a2 a3")]
    assert got(spark, docs, items) == {(1, 1), (1, 2)}
    assert got(spark, docs, [(9, None)]) == set()
    assert got(spark, [(1, None)], items) == set()
    assert leaked_spans(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_very_long_text_and_clashing_columns(spark):
    item = " ".join(f"a{i}" for i in range(40))
    long = "lorem ipsum " * 100_000 + item + " dolor" * 100_000
    df = spark.createDataFrame([("d", long, "x", 1)], "id string, text string, item_id string, doc int")
    items = spark.createDataFrame([("i", item, 1)], "item_id string, text string, doc int")
    (r,) = leaked_spans(df, items, doc="id").collect()
    assert (r["doc"], r["item"], r.longest, r.n_words) == ("d", "i", 40, 300_040)
    assert long[r.start : r.end] == item


def test_spans_are_cut_out(spark):
    item = " ".join(f"a{i}" for i in range(20))
    docs = [(1, f"keep one. {item}! keep two " + "k " * 30), (2, item), (3, "clean text"), (4, None)]
    out = {r["doc"]: r for r in without_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item), (2, "zz " + item)], ITEMS)).collect()}
    assert out[1].text == "keep one. ! keep two " + "k " * 30 and out[1].removed == 20
    assert out[2].text is None and out[2].share == 1.0
    assert out[3].text == "clean text" and out[3].removed == 0 and out[4].text is None


def test_automaton_finds_every_seed():
    r = random.Random(2)
    items = [(k, " ".join(text_of(r, 40, 3))) for k in range(3)]
    au = Automaton(items, 5)
    doc = [au.vocabulary.get(w, -1) for w in text_of(r, 300, 4)]
    want = {(k, i - j) for k, it in enumerate(au.items) for i in range(len(doc) - 4) for j in range(len(it) - 4) if doc[i : i + 5] == it[j : j + 5].tolist()}
    assert au.seeds(doc) == want and want
    assert seed_length(12, 30, 2) == 10


def test_one_block_is_live_at_a_time(spark, monkeypatch):
    """Each scan broadcasts its own automata only, and they are gone once it is written."""
    live, most = set(), []
    context = type(spark.sparkContext)
    plain = context.broadcast

    def broadcast(self, value):
        made = plain(self, value)
        live.add(id(made))
        most.append((len(live), len(value)))
        drop = made.destroy
        made.destroy = lambda *a: (live.discard(id(made)), drop(*a))
        return made

    monkeypatch.setattr(context, "broadcast", broadcast)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(40))) for k in range(30)]
    docs = [(d, f"before {items[d][1]} behind") for d in range(30)]
    assert got(spark, docs, items, block_words=100, scan_blocks=2) == {(d, d) for d in range(30)}
    assert len(most) == 6 and {n for n, _ in most} == {1} and max(b for _, b in most) <= 2


def test_repetitive_items_stay_linear():
    au = Automaton([(0, "ha " * 5000), (1, "ha ho " * 3000)], 10)
    assert len(au.end_at) == 11_000 and len(au.steps) < 40_000
    assert au.seeds([au.vocabulary["ha"]] * 10) == {(0, 9 - j) for j in range(9, 5000)}
