from __future__ import annotations

import random

import numpy as np
import pytest

from mnemark.llm import subjects as S

WORDS = {"law": "court judge lease clause verdict appeal tenant notary".split(), "music": "guitar chord violin tempo melody album choir lyric".split(), "health": "doctor fever clinic vaccine symptom bandage surgeon ward".split(), "sport": "goal referee stadium league trophy hurdle relay umpire".split(), "travel": "hotel luggage ferry museum passport harbour hostel border".split(), "garden": "lawn compost shovel orchard rose seedling hedge slug".split()}
KINDS = [*WORDS, None, "both"]


def sentence(how, subject):
    a, b, c = how.sample(WORDS[subject], 3) if subject else ("lamp", "door", "street")
    return f"Later the {a} and the {b} were near the {c}."


def corpus(spark):
    how = random.Random(5)
    docs, truth, labels = [], {}, []
    for i in range(480):
        kind = KINDS[i % 8]
        parts = [sentence(how, {"both": ("law", "music")[k % 2]}.get(kind, kind)) for k in range(6)]
        docs.append((i, " ".join(parts), "EN"))
        truth[i] = {"law", "music"} if kind == "both" else {kind} - {None}
        if i < 160 and kind != "both":
            labels.append((i, f" {(kind or 'none').upper()} "))
    docs += [(900, None, "en"), (901, "", None), (902, "12 34.", "xx"), (903, sentence(how, "law") + " " + " ".join(sentence(how, None) for _ in range(20)), "en")]
    d = spark.createDataFrame([(i, t, g, "q") for i, t, g in docs], "doc_id long, text string, lang string, subject string")
    l = spark.createDataFrame([*labels, labels[0], (None, "law"), (5, None), (6, "weather")], "doc_id long, subject string")
    names = spark.createDataFrame([*enumerate(WORDS), (1, "music"), (7, None)], "subject_id int, subject string")
    got: dict[int, set] = {}
    for r in S.subjects_of(d, l, names).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got, truth


@pytest.fixture
def small(monkeypatch):
    for k, v in {"TOPICS": 16, "ROUNDS": 20, "MODELS": 3, "MOST_SHARE": 0.6}.items():
        monkeypatch.setattr(S, k, v)
    return monkeypatch


def test_subjects(spark, small):
    got, truth = corpus(spark)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right / len(truth) >= 0.95
    assert not any(i in got for i in (900, 901, 902, 903))


def test_random_topics_find_nothing(spark, small):
    how = np.random.default_rng(3)

    def chance(terms):
        """One random topic a term."""
        m = np.full((terms, S.TOPICS), 1e-6)
        m[np.arange(terms), how.integers(0, S.TOPICS, terms)] = 1
        return m / m.sum(0)

    small.setattr(S, "topics", lambda tokens, vocabulary, seed: {g: [chance(len(v)) for _ in range(S.MODELS)] for g, v in vocabulary.items()})
    got, truth = corpus(spark)
    with_subjects = {i: t for i, t in truth.items() if t}
    assert sum(got.get(i, set()) == t for i, t in with_subjects.items()) / len(with_subjects) < 0.5


def test_topics_are_named_by_their_top_terms():
    by_label = {"court": np.array([0.9, 0.0, 0.1]), "lamp": np.array([0.3, 0.3, 0.4])}
    assert S.topic_subjects(np.array([0.9, 0.1]), ["court", "lamp"], by_label, 2).round(2).tolist() == [0.84, 0.0, 0.16]
    assert S.topic_subjects(np.array([0.0, 1.0]), ["court", "lamp"], by_label, 2).tolist() == [0.0, 0.0, 1.0]
    assert S.topic_subjects(np.array([1.0]), ["unlabelled"], by_label, 2).tolist() == [0.0, 0.0, 1.0]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    l = spark.createDataFrame([], "doc_id long, subject string")
    names = spark.createDataFrame([(1, "law")], "subject_id int, subject string")
    assert S.subjects_of(d, l, names).count() == 0


def test_topics_come_from_all_documents(spark, small):
    """The last sums behind the topics hold every word of every document, although a round draws few."""
    small.setattr(S, "ROUNDS", 2)
    small.setattr(S, "BATCH_DOCS", 3)
    small.setattr(S, "LANGUAGE_DOCS", 40)
    how = random.Random(2)
    docs = [(i, " ".join(how.choices(WORDS["law" if i % 2 else "music"], k=9)) + " rare" * (i % 60 == 0), "de" if i % 5 == 0 else "en") for i in range(300)]
    tokens = S.tokenised(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    vocabulary = {"en": sorted({*WORDS["law"], *WORDS["music"]}), "de": sorted({*WORDS["law"], *WORDS["music"], "rare"})}
    sums, whole = [], S.expected
    small.setattr(S, "expected", lambda *x: sums.append(whole(*x)) or sums[-1])
    got = S.topics(tokens, vocabulary, 1)
    assert len(sums) == S.PASSES
    for lang, v in vocabulary.items():
        n = [sum(t.split().count(w) for _, t, g in docs if g == lang) for w in v]
        assert sums[-1][lang].shape == (S.MODELS, len(v), S.TOPICS) and np.allclose(sums[-1][lang].sum(2), n)
        assert np.allclose(np.array(got[lang]).sum(1), 1)
