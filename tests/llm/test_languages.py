"""Languages: held-out accuracy, planted mixtures, labels, odd input."""

import random

import numpy as np
import pytest

from strandloom.llm.languages import TOKEN, choose, chunks_of, clean_label, em, fit, grams, languages, main_language, runs_of, wrong_labels

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def samples(spark, small):
    return spark.read.parquet(f"{small}/lang_samples.parquet")


@pytest.fixture(scope="module")
def model(spark, small, samples):
    return fit(samples.where("sample_id % 2 = 0"), spark.read.parquet(f"{small}/documents.parquet"))


def test_held_out_sentences(samples, model):
    rows = samples.where("sample_id % 2 = 1").collect()
    right = sum(model.langs[int(sum(model.word(w) for w in TOKEN.findall(r.text)).argmax())] == r.lang for r in rows)
    assert len(rows) > 100 and right == len(rows)


def test_planted_mixtures_with_and_without_punctuation(spark, samples, model):
    r, rows = random.Random(4), samples.where("sample_id % 2 = 1").collect()
    docs, want = [], set()
    for d in range(60):
        parts = [r.choice(rows)]
        parts += [r.choice([x for x in rows if x.lang != parts[0].lang or d % 2])]
        parts += [r.choice([x for x in rows if x.lang == parts[0].lang])]
        text = " ".join(x.text for x in parts)
        if d % 3 == 0:
            text = " ".join(TOKEN.findall(text))
        langs = {x.lang for x in parts}
        label = r.choice([parts[0].lang, None, "xx", parts[0].lang.upper() + "-ZZ", "it"])
        docs.append((d, text, label))
        if len(langs) > 1 or label in (None, "xx", "it"):
            want |= {(d, x) for x in langs}
    got = {tuple(r) for r in wrong_labels(spark.createDataFrame(docs, DOCS), model).collect()}
    assert got == want


def test_segments_tile_the_text(spark, model):
    en, de = "The old man closed the window behind the town hall because the boat came too late.", "Der Garten am Fluss war nicht mehr da und die Uhr kam viel zu spät."
    text = f"  {en} {de} {en}"
    (r,) = languages(spark.createDataFrame([(1, text, None)], DOCS), model).collect()
    assert [s.lang for s in r.segments] == ["en", "de", "en"]
    assert "".join(text[s.start : s.end] for s in r.segments) == text
    assert all(s.confidence > 0.9 for s in r.segments)
    assert abs(sum(m.share for m in r.mixture) - 1) < 0.05
    main = main_language(languages(spark.createDataFrame([(1, text, None), (2, "", None)], DOCS), model)).collect()
    assert [(x["doc"], x.text_lang) for x in main] == [(1, "en")] and 0.5 < main[0].share < 0.8 and main[0].confidence > 0.9


def test_odd_texts(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "... 123 !?", "en"), (None, "the house", "de"), (4, "the house was sold " * 60_000, "en"), (5, "x", None), (5, "x", None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as segments", "2 as id", "3 as label")
    out = {r["doc"]: r.segments for r in languages(df, model).collect()}
    assert set(out) == {2, 3, 4, 5} and out[2] == [] and len(out[4]) == 1
    found = wrong_labels(df, model).collect()
    assert {r["doc"] for r in found} <= {3, 5} and 4 not in {r["doc"] for r in found}
    assert languages(spark.createDataFrame([], DOCS), model).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["EN", "en-GB", "de_XX", "ger", " Polish ", "und", "", None, "xx", "it"]], "lang string")
    assert [r[0] for r in df.select(clean_label("lang")).collect()] == ["en", "en", "de", "de", "pl", None, None, None, None, "other"]


def test_no_samples(spark, samples):
    with pytest.raises(ValueError):
        fit(samples.limit(0))


def test_em_stays_within_the_allowed_languages():
    scores, first = np.log(np.array([[0.9, 0.1], [0.9, 0.1], [0.1, 0.9], [0.2, 0.8]])), np.array([0, 3])
    share, held, likely = em(scores, first)
    assert share[0, 0] > 0.6 and share[1, 1] > 0.9 and np.allclose(held.sum(1), 1)
    share, held, less = em(scores, first, np.array([[True, False], [True, True]]))
    assert share[0].tolist() == [1, 0] and less[0] < likely[0] and np.isclose(less[0], scores[:3, 0].sum())


def test_chunks_are_sentences_or_equal_parts_of_them():
    rows = np.array([5, 5, 0, 5] + [5] * 13 + [0, 0, 5])
    doc, starts = chunks_of(rows, np.array([4, 0, 16]), 6)
    assert doc.tolist() == [0, 0, 2, 2, 2, 2] and starts.tolist() == [0, 2, 3, 8, 12, 16]


def test_undecided_chunks_go_with_the_one_before():
    at, label = runs_of(np.array([[0.6, 0.4], [0.05, 0.95], [0.6, 0.4], [1, 0]]))
    assert at.tolist() == [0, 3] and label.tolist() == [1, 0]


def test_words_have_n_grams_of_three_and_four():
    assert set(grams("haus")) == {" ha", "hau", "aus", "us ", " hau", "haus", "aus "}


def mixed_documents():
    """One sentence in fifteen is of the second language: by far the best set is both, in these proportions."""
    scores = np.tile([8.0, 0.0, -4.0], (15, 1))
    scores[7] = [0.0, 17.0, -4.0]
    return scores, np.array([0]), np.full(15, 9)


def test_proportions_decide_the_set(monkeypatch):
    from strandloom.llm import languages as lang

    scores, first, words = mixed_documents()
    chosen, share, _ = choose(scores, first, words, 12.0, 4)
    assert chosen.tolist() == [[True, True, False]] and abs(share[0, 1] - 1 / 15) < 0.01
    plain = lang.em
    monkeypatch.setattr(lang, "em", lambda s, f, allowed=None: plain(s, f, allowed, 0))  # uniform proportions
    assert choose(scores, first, words, 12.0, 4)[0].tolist() == [[True, False, False]]


def test_no_estimate_changes_what_the_bound_rules_out():
    r = np.random.default_rng(1)
    scores, first = r.normal(0, 3, (400, 5)), np.arange(0, 400, 8)
    chosen, _, _ = choose(scores, first, np.full(400, 9), 6.0, 4)
    for d, f in enumerate(first):
        mine, zero = scores[f : f + 8], np.array([0])
        sets = {d: em(mine, zero, s[None])[2][0] - 6.0 * (s.sum() - 1) - 6.0 * s[-1] for d, s in enumerate([np.isin(np.arange(5), [a, b]) for a in range(5) for b in range(a, 5)])}
        assert chosen[d].sum() > 1 or max(sets.values()) <= mine[:, chosen[d]].sum() - 6.0 * chosen[d, -1] + 1e-6 or mine.sum(0)[:-1].argmax() not in np.flatnonzero(chosen[d])


def test_a_language_of_none_of_the_samples(spark, model):
    greek = "Ο παλιός χάρτης είναι πίσω από το δημαρχείο. Το σπίτι κοντά στο ποτάμι δεν έχει ιδιοκτήτη. Δύο φορές το χρόνο ήρθε πολύ αργά."
    hebrew = "המפה הישנה נמצאת מאחורי בית העירייה. לבית ליד הנהר אין בעלים. פעמיים בשנה הוא הגיע מאוחר מדי."
    english = "The old map is behind the town hall. The house by the river has no owner. Twice a year it came too late."
    df = spark.createDataFrame([(1, greek, "en"), (2, hebrew, None), (3, english, "en"), (4, f"{english} {greek}", "en")], DOCS)
    got = {r["doc"]: [s.lang for s in r.segments] for r in languages(df, model).collect()}
    assert got == {1: ["und"], 2: ["und"], 3: ["en"], 4: ["en", "und"]}
