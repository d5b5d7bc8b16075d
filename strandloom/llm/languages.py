"""Languages of documents and of their segments, as a mixture inferred from character n-grams."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.leakage import TOKEN, normal
from strandloom.session import spread

#: Other spellings of each language's label, in lower case (fixed values).
LABELS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "pl": ["pl", "pol", "polish", "polski"],
    "ru": ["ru", "rus", "russian", "русский"],
}
#: Labels that say that the language is not known (fixed values).
UNKNOWN = ["", "und", "unknown", "unk", "xx", "xxx", "zxx", "mis", "mul", "n/a", "na", "none", "null", "?", "-"]
#: A sentence ends where one of these stands.
STOP = re.compile(r"[.!?…。\n]")
#: The words of a text and the ends of its sentences.
WORD_OR_STOP = re.compile(f"{TOKEN.pattern}|{STOP.pattern}")
#: What text in none of the model's languages is called.
OTHER = "und"


def clean_label(label: str | Column) -> Column:
    """The two-letter code of a label; null where it is missing, ``other`` where it is none of ours.

    Case, outer blanks and a region after ``-`` or ``_`` do not count.
    """
    text = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    base = F.when(text.isin(UNKNOWN), None).otherwise(F.regexp_extract(text, r"^([^\s_\-]+)", 1))
    codes = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in names for x in (n, code)])
    return F.when(text.isNull() | text.isin(UNKNOWN) | (base == ""), None).otherwise(F.coalesce(F.try_element_at(codes, base), F.lit("other")))


def grams(word: str) -> list[str]:
    """Character n-grams of three and of four of a word with its ends marked."""
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 4] for i in range(len(w) - 3)]


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of words and character n-grams in each language against all of them together.

    A word speaks by the mean of its n-grams of three and four, within ``cap``, and,
    if it was seen often enough, as a whole. The last column is text in none of the
    languages: there, words are unknown ones at the rate ``strange``, while in a
    language they are at the rate ``rare`` that was counted. An unknown word counts as
    one by the share of its n-grams that are unknown too.
    """

    langs: tuple[str, ...]
    #: The row of each word and of each n-gram in ``word_ratios`` and ``gram_ratios``.
    words: dict[str, int]
    word_ratios: np.ndarray
    grams: dict[str, int]
    gram_ratios: np.ndarray
    rare: float
    strange: float = 0.9
    cap: float = 1.5

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each language and one for none of them."""
        out = np.zeros((len(words), len(self.langs) + 1))
        mine, rows, sizes, lacking, row, k = [], [], [], [], self.grams.get, len(self.langs)
        for x in words:
            w = normal(x)
            mine.append(self.words.get(w, -1))
            every = grams(w) if w.isalpha() else []
            held = [r for g in every if (r := row(g)) is not None]
            rows += held
            sizes.append(len(held))
            lacking.append(1 - len(held) / len(every) if every else 0.0)
        sizes = np.array(sizes)
        some = np.flatnonzero(sizes)
        if len(some):
            sums = np.add.reduceat(self.gram_ratios[rows], np.cumsum(sizes[some]) - sizes[some], 0)
            out[some, :k] = np.clip(sums / sizes[some, None], -self.cap, self.cap)
        mine = np.array(mine, np.int64)
        known = mine >= 0
        out[known, :k] += self.word_ratios[mine[known]]
        alpha = np.array([x[0].isalpha() for x in words], bool)
        unseen = np.where(known, 0.0, lacking)  # how little of the word was seen
        out[:, k] = (unseen * np.log(self.strange / self.rare) + (1 - unseen) * np.log((1 - self.strange) / (1 - self.rare))) * alpha
        return out

    def word(self, word: str) -> np.ndarray:
        return self.scores([word])[0, :-1]


class Scorer:
    """Rows of scores of words, each worked out once as long as no more than ``most`` are held. Row 0 is no word."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = dict.fromkeys(".!?…。\n", 0)
        self.scores, self.used = np.zeros((1024, len(self.model.langs) + 1)), 1

    def __call__(self, words: list[str]) -> np.ndarray:
        """The row of each word in ``self.scores``, which holds until the next call."""
        if self.used > self.most:
            self._clear()
        new = list(set(words).difference(self.row))
        if new:
            end = self.used + len(new)
            if end > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros((max(end, len(self.scores)), self.scores.shape[1]))))
            self.scores[self.used : end] = self.model.scores(new)
            self.row.update(zip(new, range(self.used, end), strict=True))
            self.used = end
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))


def _counts(labelled: DataFrame) -> DataFrame:
    """``feature, lang, count`` over ``lang, text``; words have the mark ``w`` before them, n-grams ``g``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter[tuple[str, str]] = Counter()
            for code, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in TOKEN.findall(t):
                    if (x := normal(w)).isalpha():
                        held[f"w{x}", code] += 1
                        for g in grams(x):
                            held[f"g{g}", code] += 1
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(held.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "lang", "n"])

    return labelled.mapInArrow(explode, "feature string, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame, prior: float, least: int, langs: tuple[str, ...] | None = None) -> Model:
    per = counts.groupBy("feature").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    every = per.collect()  # as many as the bounded labelled texts have
    langs = langs or tuple(sorted({k for r in every for k in r["by"]}))
    if not langs:
        raise ValueError("no labelled texts")
    parts = []
    for kind in "wg":
        mine = [r for r in every if r["feature"][0] == kind and r["all"] >= least]
        count = np.array([[r["by"].get(k, 0) for k in langs] for r in mine], float).reshape(-1, len(langs))
        share = count.sum(0)
        share = (share + 1) / (share + 1).sum()
        ratios = np.log((count + prior * share) / (count.sum(1, keepdims=True) + prior) / share)
        parts += [{r["feature"][1:]: k for k, r in enumerate(mine)}, ratios]
    words = [r["all"] for r in every if r["feature"][0] == "w"]
    rare = sum(n for n in words if n < max(2, least)) / sum(words)  # words as rare as these will be met unknown
    return Model(langs, *parts, rare=min(0.5, max(0.05, rare)))


def fit(
    samples: DataFrame, documents: DataFrame | None = None, *, lang: str = "lang", text: str = "text", doc: str = "doc_id",
    prior: float = 0.7, train_docs: int = 5000, least: int = 3,
) -> Model:
    """A model from checked samples, a small table, and from a bounded number of labelled documents.

    A first model is fitted on ``samples``. With it, the sentences of ``train_docs``
    documents (those of smallest hash) whose label it confirms are counted as well.
    Of both together, all words and n-grams seen ``least`` times or more are kept: the
    texts of ``train_docs`` documents bound what is broadcast. Documents only add
    vocabulary; which ones are labelled afterwards does not depend on them.
    """
    checked = samples.select(clean_label(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and lang != 'other' and text is not null")
    base = _counts(checked)
    first = _model(base, prior, 1)
    if documents is None:
        return first
    labelled = documents.select(clean_label(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc).alias("h")).where("lang is not null and text is not null")
    bounded = spread(labelled.orderBy("h", "text").limit(train_docs))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(first)
        for batch in batches:
            codes, out = [], []
            for code, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for sentence in STOP.split(t):
                    words = TOKEN.findall(sentence)
                    if len(words) < 4:
                        continue
                    rows = scorer(words)
                    if first.langs[int(scorer.scores[rows].sum(0)[:-1].argmax())] == code:
                        codes.append(code)
                        out.append(sentence)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(codes, pa.string()), "text": pa.array(out, pa.string())})

    more = _counts(bounded.select("lang", "text").mapInArrow(confirmed, "lang string, text string"))
    return _model(base.unionByName(more).groupBy("feature", "lang").agg(F.sum("n").alias("n")), prior, least, first.langs)


def em(scores: np.ndarray, first: np.ndarray, allowed: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of the languages in each document, responsibilities of each chunk, and the documents' log-likelihoods.

    ``scores`` has the log-likelihoods of chunks, documents' chunks together;
    ``first`` is where each document's begin, ``allowed`` the languages each may
    hold. All documents of a batch at once.
    """
    sizes = np.diff(np.append(first, len(scores)))
    allowed = np.ones((len(first), scores.shape[1]), bool) if allowed is None else allowed
    mine = np.repeat(allowed, sizes, 0)
    top = np.where(mine, scores, -np.inf).max(1, keepdims=True)
    weight = np.exp(np.where(mine, scores, -np.inf) - top)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        held = weight * np.repeat(share, sizes, 0)
        held /= held.sum(1, keepdims=True)
        before, share = share, np.add.reduceat(held, first, 0) / sizes[:, None]
        if np.abs(share - before).max() < 1e-5:
            break
    total = (weight * np.repeat(share, sizes, 0)).sum(1, keepdims=True)
    held = weight * np.repeat(share, sizes, 0) / total
    return share, held, np.add.reduceat(np.log(total[:, 0]) + top[:, 0], first)


def chunks_of(rows: np.ndarray, sizes: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of each chunk, where its words begin) over words and, as row 0, ends of sentences.

    Begins count words only. A sentence of more than ``chunk`` words is cut into
    equal chunks of no more than that.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    word = rows > 0
    sentence = np.cumsum(~word)[word]
    doc = doc[word]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(doc)))
    at = np.arange(len(doc)) - np.repeat(begin, length)
    parts = np.repeat(-(-length // chunk), length)
    piece = at * parts // np.repeat(length, length)
    new[1:] |= piece[1:] != piece[:-1]
    starts = np.flatnonzero(new)
    return doc[starts], starts


def choose(scores: np.ndarray, first: np.ndarray, words: np.ndarray, penalty: float, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages, proportions, responsibilities): each document's set of highest penalised likelihood.

    ``scores`` and ``words`` are of chunks; the last column is text in none of the
    languages. A set's likelihood is that of the mixture of its languages in the
    proportions that expectation-maximisation finds. The one language that explains
    most comes first. Then the language is added that raises the likelihood most, as
    long as that exceeds ``penalty`` and at least ``least_words`` words fall to it;
    last, languages go that the others make up for but for less than ``penalty``.

    A mixture explains no chunk better than its best language does. Where that
    already rules out every second language, nothing is left to estimate.
    """
    n, k = len(first), scores.shape[1]
    sizes = np.diff(np.append(first, len(scores)))
    single = np.add.reduceat(scores, first, 0)
    best = single[:, :-1].argmax(1)
    chosen = np.arange(k) == best[:, None]
    reached = single[np.arange(n), best]
    share, held = chosen.astype(float), np.repeat(chosen, sizes, 0).astype(float)

    def chunks(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum(sizes[docs]) - sizes[docs]
        return np.arange(sizes[docs].sum()) + np.repeat(first[docs] - starts, sizes[docs]), starts

    def attempt(docs: np.ndarray, lang: np.ndarray, change: float) -> np.ndarray:
        """Each document with one language more or less; keeps the best change of a document if it changes the likelihood by more than that."""
        tried = chosen[docs].copy()
        tried[np.arange(len(docs)), lang] ^= True
        rows, starts = chunks(docs)
        shares, resp, likely = em(scores[rows], starts, tried)
        gain = likely - reached[docs]
        if change > 0:
            fallen = np.add.reduceat(words[rows] * (resp[np.arange(len(rows)), np.repeat(lang, sizes[docs])] > 0.5), starts)
            gain = np.where(fallen >= least_words, gain, -np.inf)
        order = np.lexsort((lang, -gain, docs))
        order = order[np.append(True, docs[order][1:] != docs[order][:-1])]
        order = order[gain[order] > change]
        for i in order.tolist():
            d = docs[i]
            chosen[d], share[d], reached[d] = tried[i], shares[i], likely[i]
            held[first[d] : first[d] + sizes[d]] = resp[starts[i] : starts[i] + sizes[d]]
        return docs[order]

    going = np.arange(n)
    while len(going):
        rows, starts = chunks(going)
        top = np.where(np.repeat(chosen[going], sizes[going], 0), scores[rows], -np.inf).max(1, keepdims=True)
        most = np.add.reduceat(np.maximum(scores[rows], top), starts, 0) - reached[going][:, None]
        who, lang = np.nonzero((most > penalty) & ~chosen[going])
        going = attempt(going[who], lang, penalty) if len(who) else who
    going = np.flatnonzero(chosen.sum(1) > 1)
    while len(going):
        who, lang = np.nonzero(chosen[going])
        going = attempt(going[who], lang, -penalty)
        going = going[chosen[going].sum(1) > 1]
    return chosen, share, held


def runs_of(held: np.ndarray, sure: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, language) of each stretch of a document's chunks; an undecided chunk goes with the one before."""
    label = held.argmax(1)
    decided = np.flatnonzero(held.max(1) >= sure)
    if len(decided):
        label = label[decided[np.maximum(np.searchsorted(decided, np.arange(len(held)), "right") - 1, 0)]]
    at = np.append(0, np.flatnonzero(np.diff(label)) + 1)
    return at, label[at]


SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64())]))
SHARES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
OUT = "segments array<struct<start:long,end:long,words:long,lang:string,confidence:double>>, mixture array<struct<lang:string,share:double>>"


def _labeller(model, penalty: float, least_words: int, chunk: int):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(model.value))
        langs = [*scorer.model.langs, OTHER]
        for batch in batches:
            docs, texts = batch.column("doc"), batch.column("text").to_pylist()
            found = [WORD_OR_STOP.findall(t) for t in texts]
            rows = scorer([*chain.from_iterable(found)])
            doc, starts = chunks_of(rows, np.array([len(x) for x in found], np.int64), chunk)
            segments, mixtures = [[] for _ in texts], [[] for _ in texts]
            if len(doc):
                per_word = scorer.scores[rows[rows > 0]]
                scores, words = np.add.reduceat(per_word, starts, 0), np.diff(np.append(starts, len(per_word)))
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                chosen, share, held = choose(scores, first, words, penalty, least_words)
                single = np.add.reduceat(scores, first, 0)
                sure = np.exp(single - single.max(1, keepdims=True))
                sure /= sure.sum(1, keepdims=True)
                n_words, count = np.add.reduceat(words, first), chosen.sum(1)
                ends = np.append(first[1:], len(doc))
                for i, d in enumerate(doc[first].tolist()):
                    if count[i] == 1:
                        one = int(chosen[i].argmax())
                        segments[d] = [{"start": 0, "end": len(texts[d]), "words": int(n_words[i]), "lang": langs[one], "confidence": float(sure[i, one])}]
                        mixtures[d] = [{"lang": langs[one], "share": 1.0}]
                    else:
                        mine = slice(first[i], ends[i])
                        segments[d] = _segments(texts[d], scores[mine], words[mine], held[mine], share[i], langs)
                        mixtures[d] = [{"lang": langs[j], "share": float(share[i, j])} for j in np.flatnonzero(chosen[i]).tolist()]
            yield pa.RecordBatch.from_arrays([docs, pa.array(segments, SEGMENTS), pa.array(mixtures, SHARES)], names=["doc", "segments", "mixture"])

    return label


def _segments(text: str, scores: np.ndarray, words: np.ndarray, held: np.ndarray, share: np.ndarray, langs: list[str]) -> list[dict]:
    places = [m.start() for m in TOKEN.finditer(text)]
    at, label = runs_of(held)
    before = np.append(0, np.cumsum(words))
    prior = np.log(0.99 * share + 0.01 / len(share))  # a language outside the set is not ruled out
    out = []
    for a, b, k in zip(at.tolist(), [*at[1:].tolist(), len(words)], label.tolist(), strict=True):
        p = scores[a:b].sum(0) + prior
        p = np.exp(p - p.max())
        start, end = (places[before[a]] if a else 0), (places[before[b]] if b < len(words) else len(text))
        out.append({"start": start, "end": end, "words": int(before[b] - before[a]), "lang": langs[k], "confidence": float(p[k] / p.sum())})
    return out


def languages(
    documents: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text", penalty: float = 8.0, least_words: int = 4, chunk: int = 6,
) -> DataFrame:
    """``doc, segments, mixture``: the languages of each document, in one pass without a shuffle.

    A text is a mixture of languages that give off its chunks: sentences, or parts of
    at most ``chunk`` words. ``mixture`` has the proportions that expectation-maximisation
    finds for the set of highest penalised likelihood: a language joins if that raises
    the log-likelihood by more than ``penalty`` (it must be e^penalty times as likely),
    and ``least_words`` words or more fall to it. ``segments`` (start, end, words, lang,
    confidence) tile the text by the chunks' responsibilities; ``confidence`` is the
    posterior of the segment's language under the mixture. Text in none of the model's
    languages is ``und``, unless it shares too many words and n-grams with one of them.

    A null text or id gives no row; a text without words has no segments.
    """
    broadcast = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))  # bounded by fit's train_docs
    rows = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    kind = rows.schema["doc"].dataType.simpleString()
    return spread(rows).mapInArrow(_labeller(broadcast, penalty, least_words, chunk), f"doc {kind}, {OUT}")


def main_language(found: DataFrame) -> DataFrame:
    """``doc, text_lang, share, confidence`` of what :func:`languages` gives: the language of most words, ties by code.

    ``share`` is its share of the words, ``confidence`` the mean over its segments
    weighted by their words. Folded within each row; documents without words are left out.
    """
    total = "aggregate(segments, 0L, (a, s) -> a + s.words)"
    per = """transform(array_distinct(transform(segments, s -> s.lang)), l -> named_struct(
        'words', aggregate(filter(segments, s -> s.lang = l), 0L, (a, s) -> a + s.words), 'lang', l,
        'sure', aggregate(filter(segments, s -> s.lang = l), 0D, (a, s) -> a + s.words * s.confidence)))"""
    best = "array_sort(per, (x, y) -> case when x.words > y.words or (x.words = y.words and x.lang < y.lang) then -1 when x.lang = y.lang then 0 else 1 end)[0]"
    x = found.where("size(segments) > 0").select("doc", F.expr(total).alias("n"), F.expr(per).alias("per")).select("doc", "n", F.expr(best).alias("b"))
    return x.select("doc", F.col("b.lang").alias("text_lang"), (F.col("b.words") / F.col("n")).alias("share"), (F.col("b.sure") / F.col("b.words")).alias("confidence"))


def wrong_labels(documents: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text", label: str = "lang", **kw) -> DataFrame:
    """``doc, text_lang``: documents whose label is missing or wrong or whose text has several languages; a row for each.

    Text in none of the model's languages has no code and gives no row of its own.
    """
    keyed = documents.where(F.col(doc).isNotNull()).select(F.struct(F.col(doc).alias("id"), clean_label(label).alias("label")).alias("key"), F.col(text).alias("text"))
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    found = languages(keyed, model, doc="key", text="text", **kw).select("doc.id", "doc.label", langs.alias("langs"))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return found.where(wrong).select(F.col("id").alias("doc"), F.explode("langs").alias("text_lang")).where(F.col("text_lang") != OTHER).distinct()
