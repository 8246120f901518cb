"""Subject areas of documents: distributed latent Dirichlet topic models, topics mapped to subjects through their top terms, and
subjects assigned from the topics' proportions among a document's sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemark.session import cut

#: Topics of one language's model, models of each language (with other seeds), rounds of a fit, and documents that a round draws, at
#: random, from all documents of the language.
TOPICS, MODELS, ROUNDS, BATCH_DOCS = 30, 3, 40, 400
#: Terms that a model knows (its language's most frequent), the least documents of a term, and the largest share of a language's
#: documents: terms above it in any language are that language's function words.
VOCABULARY, LEAST_DOCS, MOST_SHARE = 20_000, 5, 0.25
#: Least documents of a language for models of its own, and most such languages; the documents of all others share their models.
LANGUAGE_DOCS, LANGUAGES = 200, 20
#: Models fitted at a time.
AT_A_TIME = 4
#: After the rounds, passes over all documents, each of which sets the topics anew; turns in which a document's topic proportions are
#: inferred, documents taken together, and terms in a row of sums.
PASSES, TURNS, TOGETHER, CHUNK = 2, 8, 200, 1000
TOP_TERMS = 10
#: Least share of a subject among a topic's top terms for the topic to be about it; topics about nothing are of no subject.
TOPIC_SURE = 0.35
#: Least share of a subject among the topics of a sentence.
SENTENCE_SURE = 0.4
FOLDS, PRIOR, UNSEEN = 4, 0.02, 1e-7
LEAST_SHARE = 1 / 8
NONE = "none"
PATTERN = r"\p{L}{3,}(?:-\p{L}+)*"
WORD, SENTENCES = re.compile(r"[^\W\d_]{3,}(?:-[^\W\d_]+)*"), re.compile(r"(?<=[.!?])[\"'»”)\]]*\s+|\n+")


def label_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def sentences(text: str) -> list[str]:
    """Sentences and list items; lines without closing punctuation are headings, and parts without words aren't sentences."""
    parts = [s.strip() for s in SENTENCES.split(text)]
    return [s for s in parts if s and s.rstrip("\"'»”)] ")[-1:] in (".", "!", "?", "…") and WORD.search(s)]


def tokenised(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(id, lang, words) of the texts with words; lang is empty for languages without models of their own."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(PATTERN), F.lit(0))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.substring(label_key(F.col(lang)), 1, 2), F.lit("")).alias("written"), words.alias("words")).filter(F.size("words") > 0)
    rows = cut(rows)
    own = rows.groupBy("written").agg(F.count("*").alias("n")).filter((F.col("n") >= LANGUAGE_DOCS) & (F.col("written") != "")).orderBy(F.desc("n"), "written").limit(LANGUAGES).select("written", F.col("written").alias("lang"))
    return rows.join(F.broadcast(own), "written", "left").select("id", F.coalesce("lang", F.lit("")).alias("lang"), "words")


def vocabularies(tokens: DataFrame) -> dict[str, list[str]]:
    """For each language its terms, counted over all documents: at most VOCABULARY of each come to the driver."""
    docs = tokens.groupBy("lang").agg(F.count("*").alias("docs"))
    per = tokens.select("lang", F.explode(F.array_distinct("words")).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    per = cut(per.filter(F.col("n") >= LEAST_DOCS).join(F.broadcast(docs), "lang").withColumn("function", F.col("n") > MOST_SHARE * F.col("docs")))
    kept = per.join(per.filter("function").select("term").distinct(), "term", "left_anti")
    top = kept.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term"))).filter(F.col("r") <= VOCABULARY)
    out: dict[str, list[str]] = {}
    for lang, term in top.orderBy("lang", "r").select("lang", "term").collect():
        out.setdefault(lang, []).append(term)
    return out


def add_expected(sums: np.ndarray, topics: np.ndarray, docs: list[list[int]]) -> None:
    """Adds to sums (models x terms x topics) how often each topic has said each term, as expected from the topics (same shape) and from
    each document's own proportions of them. docs: the terms of each document, repeated as they are."""
    counted = [np.unique(d, return_counts=True) for d in docs if d]
    if not counted:
        return
    term, n = (np.concatenate(x) for x in zip(*counted))
    sizes = np.array([len(x[0]) for x in counted])
    rows, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    order = np.argsort(term, kind="stable")
    at = np.flatnonzero(np.diff(term[order], prepend=-1))
    for into, model in zip(sums, topics):
        e = np.maximum(model[term], UNSEEN)
        share = np.full((len(sizes), e.shape[1]), 1 / e.shape[1])
        for _ in range(TURNS):
            r = e * share[rows]
            r *= (n / r.sum(1))[:, None]
            share = np.add.reduceat(r, first, axis=0) + PRIOR
            share /= share.sum(1, keepdims=True)
        into[term[order[at]]] += np.add.reduceat(r[order], at, axis=0)


def expected(tokens: DataFrame, vocabulary: dict[str, list[str]], fitted: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """add_expected() over all documents of each language, added up on the executors; as large as the topics, which come to the driver."""
    sc = tokens.sparkSession.sparkContext
    shared = sc.broadcast((vocabulary, fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, topics_ = shared.value
        at = {g: {t: i for i, t in enumerate(v)} for g, v in known.items()}
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            docs: dict[str, list[list[int]]] = {}
            for g, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if g in at:
                    docs.setdefault(g, []).append([at[g][w] for w in words if w in at[g]])
            for g, d in docs.items():
                own = sums.setdefault(g, np.zeros(topics_[g].shape))
                for s in range(0, len(d), TOGETHER):
                    add_expected(own, topics_[g], d[s : s + TOGETHER])
        for g, own in sums.items():
            starts = range(0, own.shape[1], CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(starts)), pa.array(starts, pa.int32()), pa.array([own[:, s : s + CHUNK].tobytes() for s in starts], pa.binary())], names=["lang", "start", "sums"])

    def total(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": g["lang"][:1], "start": g["start"][:1], "sums": [np.sum([np.frombuffer(x) for x in g["sums"]], axis=0).tobytes()]})

    parts = tokens.select("lang", "words").coalesce(sc.defaultParallelism).mapInArrow(run, "lang string, start int, sums binary")
    out = {g: np.zeros(m.shape) for g, m in fitted.items()}
    for r in parts.groupBy("lang", "start").applyInPandas(total, "lang string, start int, sums binary").collect():
        into = out[r["lang"]][:, r["start"] : r["start"] + CHUNK]
        into[:] = np.frombuffer(r["sums"]).reshape(into.shape)
    shared.unpersist()
    return out


def topics(tokens: DataFrame, vocabulary: dict[str, list[str]], seed: int) -> dict[str, list[np.ndarray]]:
    """For each language MODELS matrices (terms x TOPICS), each topic a distribution over terms, of topic models fitted on the
    executors to the term vectors of the language's documents: rounds on random draws find where the topics lie, then PASSES over all
    documents set them. Only these matrices come to the driver."""
    sizes = {r["lang"]: r["count"] for r in tokens.groupBy("lang").count().collect()}  # at most LANGUAGES + 1 rows
    parallelism = tokens.sparkSession.sparkContext.defaultParallelism

    def vectors(lang: str) -> DataFrame:
        own = tokens.filter(F.col("lang") == lang).coalesce(min(parallelism, ceil(sizes[lang] / 2000)))
        return CountVectorizerModel.from_vocabulary(vocabulary[lang], "words", "features").transform(own).select("features").persist(StorageLevel.MEMORY_AND_DISK)

    features = {lang: vectors(lang) for lang in vocabulary}

    def fit(lang: str, k: int) -> np.ndarray:
        lda = LDA(k=TOPICS, maxIter=ROUNDS, seed=seed + k, optimizer="online", subsamplingRate=min(1.0, BATCH_DOCS / sizes[lang]), learningOffset=4.0, learningDecay=0.6, docConcentration=[PRIOR], topicConcentration=PRIOR)
        m = lda.fit(features[lang]).topicsMatrix().toArray()
        return m / m.sum(0)

    jobs = [(lang, k) for k in range(MODELS) for lang in vocabulary]
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        fitted = list(pool.map(lambda j: fit(*j), jobs))
    for f in features.values():
        f.unpersist()
    found = {lang: np.array([m for (at, _), m in zip(jobs, fitted) if at == lang]) for lang in vocabulary}
    for _ in range(PASSES):
        sums = {lang: x + PRIOR for lang, x in expected(tokens, vocabulary, found).items()}
        found = {lang: x / x.sum(1, keepdims=True) for lang, x in sums.items()}
    return {lang: list(x) for lang, x in found.items()}


def term_subjects(tokens: DataFrame, labels: DataFrame, vocabulary: dict[str, list[str]], subjects: list[str]) -> dict[str, np.ndarray]:
    """For each term how its labelled documents divide among the subjects and, last, `none`, each subject counting alike; terms without
    labels aren't there. Labels are brought to one spelling, and repeated ones count once."""
    spark, names = tokens.sparkSession, [*subjects, NONE]
    l = labels.select(F.col("doc_id").cast("long").alias("id"), label_key(F.col("subject")).alias("subject")).filter("id IS NOT NULL").distinct()
    l = l.join(F.broadcast(spark.createDataFrame([(s,) for s in names], "subject string")), "subject", "left_semi")
    known = spark.createDataFrame([(t,) for t in sorted({t for v in vocabulary.values() for t in v})], "term string")
    labelled = cut(tokens.join(l, "id").select("subject", F.array_distinct("words").alias("words")))
    sizes = {r["subject"]: r["count"] for r in labelled.groupBy("subject").count().collect()}
    out: dict[str, np.ndarray] = {}
    for s, t, n in labelled.select("subject", F.explode("words").alias("term")).join(known, "term", "left_semi").groupBy("subject", "term").count().collect():  # at most terms x subjects
        out.setdefault(t, np.zeros(len(names)))[names.index(s)] = n / sizes[s]
    return {t: v / v.sum() for t, v in out.items()}


def topic_subjects(topic: np.ndarray, terms: list[str], by_label: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The n subjects of one topic (a distribution over terms): those to which its TOP_TERMS point, each by TOPIC_SURE or more; the rest
    is `none`, last. Top terms that no labelled document has say nothing."""
    told = [i for i in np.argsort(-topic, kind="stable")[:TOP_TERMS] if terms[i] in by_label]
    out = np.zeros(n + 1)
    if told:
        share = np.average([by_label[terms[i]] for i in told], axis=0, weights=topic[told])[:n]
        out[:n] = np.where(share >= TOPIC_SURE, share, 0)
    out[n] = max(0.0, 1 - out.sum())
    return out


class Model:
    """The topics of all languages, as one table of terms x topics for each of the MODELS, and their subjects."""

    def __init__(self, vocabulary: dict[str, list[str]], fitted: dict[str, list[np.ndarray]], by_label: dict[str, np.ndarray], n: int) -> None:
        self.at = {t: i for i, t in enumerate(sorted({t for v in vocabulary.values() for t in v}))}
        self.log, self.subjects = [], []
        for k in range(MODELS):
            table, subjects = [], []
            for lang, v in vocabulary.items():
                m = np.full((len(self.at), TOPICS), UNSEEN)
                m[[self.at[t] for t in v]] = np.maximum(fitted[lang][k], UNSEEN)
                table.append(np.log(m).astype(np.float32))
                subjects += [topic_subjects(fitted[lang][k][:, j], v, by_label, n) for j in range(TOPICS)]
            self.log.append(np.concatenate(table, axis=1))
            self.subjects.append(np.array(subjects))

    def assign(self, text: str) -> list[int]:
        """Subjects of at least LEAST_SHARE of the document's sentences.

        Each model infers the document's topic proportions from its sentences, whose topics follow from their terms and these
        proportions, in FOLDS turns. A sentence has the subject of its topics, on average over the models, if that reaches
        SENTENCE_SURE; sentences without known terms have none.
        """
        parts = sentences(text)
        terms = [t for s in parts if (t := sorted({self.at[w] for w in WORD.findall(s.lower()) if w in self.at}))]
        if not terms:
            return []
        rows, flat = np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.concatenate(terms)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        votes = np.zeros((len(terms), self.subjects[0].shape[1]))
        for log, subjects in zip(self.log, self.subjects):
            e = np.add.reduceat(log[flat], first, axis=0)
            e = np.exp(e - e.max(1, keepdims=True))
            share = np.full(e.shape[1], 1 / e.shape[1])
            for _ in range(FOLDS):
                r = e * share
                r /= r.sum(1, keepdims=True)
                share = (r.sum(0) + PRIOR) / (len(r) + PRIOR * r.shape[1])
            votes += r @ subjects
        votes /= len(self.log)
        best = votes.argmax(1)
        sure = votes[np.arange(len(best)), best] >= SENTENCE_SURE
        counts = np.bincount(best[sure], minlength=votes.shape[1])[:-1]
        return [int(s) for s in np.flatnonzero(counts >= max(1.0, LEAST_SHARE * len(parts)))]


def subjects_of(docs: DataFrame, labels: DataFrame, subject_list: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 7) -> DataFrame:
    """(doc_id, subject): each subject of at least an eighth of the document's sentences.

    Null, empty and wordless texts have no subject; whole texts are read. The topic models' rounds begin with random draws, but the
    topics are set by passes over all documents, as the vocabulary's counts are. Labels other than the listed subjects and `none` tell nothing. A missing or wrong
    language only decides whose models the document helps to fit: every text is judged by the topics of all languages. A repeated
    document id gives its subjects once for each row. Subjects that no labelled document of a language has aren't found in it.
    """
    tokens = tokenised(docs, doc_id, text, lang)
    listed = subject_list.select(label_key(F.col("subject")).alias("key"), "subject").filter("key <> ''").groupBy("key").agg(F.min("subject").alias("subject"))
    shown = {r["key"]: r["subject"] for r in listed.orderBy("key").collect()}  # a row per subject, the result's own names
    vocabulary = vocabularies(tokens)
    names = list(shown)
    model = Model(vocabulary, topics(tokens, vocabulary, seed), term_subjects(tokens, labels, vocabulary, names), len(names)) if vocabulary and names else None
    shared = docs.sparkSession.sparkContext.broadcast((model, list(shown.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, labels_ = shared.value
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s in m.assign(t) if m else ():
                    ids.append(i), out.append(labels_[s])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "subject"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(run, "doc_id long, subject string")
