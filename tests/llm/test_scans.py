from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemark.llm import scans

WORDS = "nobody marinated the dough until yeast looked sour and a finished oven was warm we kept some for third time she baked bread before lunch".split()


def plain_text(how):
    return 'Document (PDF): x.pdf — "Report on the oven"\n' + " ".join(" ".join(how.choices(WORDS, k=how.randint(5, 14))).capitalize() + "." for _ in range(25))


@pytest.fixture(scope="module")
def weights(spark):
    how = random.Random(2)
    return scans.line_weights(spark.createDataFrame([(plain_text(how),) for _ in range(60)], "text string"), "text")

PAGE = 'Document (PDF, 2 pages): s.pdf — "Report on the dough"\n\nNobody marinated the dough until the yeast looked sour and\nthe half-\nfinished oven was warm. We kept the mar-\n\n— Report on the d0ugh —\n[12]\ninade for the third time.\x0cAnnual Notes\nShe baked the bread.'


def test_page(weights):
    headers, pages, broken, words, _ = scans.parse(PAGE, weights)
    assert headers == ["Annual Notes", "— Report on the d0ugh —"] and pages == ["[12]"]
    assert broken == [("half", "finished"), ("mar", "inade")] and "inade" not in words and "dough" in words


def test_numbered_list_is_no_page_number(weights):
    assert scans.parse("Document\n\n1\nThis is a sentence.\n2\nThis is another.", weights)[1] == []
    assert scans.parse("Document\n\n25\nThis is a sentence\nover two lines.\n26\nThis is another.", weights)[1] == ["25", "26"]


def test_noise(spark):
    text = "the morning dinner was about nothing before the early lunch and the usual culture again"
    rows = [(i, f"Document\n{text} with half-finished work.") for i in range(120)] + [(500, "Document\nThe rnorning was carly and\nhalf-\nfinished."), (501, None), (502, ""), (503, "Document"), (504, "Document\nNothinq is wr0ng."), (504, "Document\nNothinq is wr0ng."), (505, "Document\n" + "early lunch " * 20_000)]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "id long, text string, noise_type string")
    got = {(r.id, r.noise_type, r.noise_text) for r in scans.noise(df, "id", "text").collect()}
    assert got == {(500, "hyphen", "half-finished"), (500, "misread", "morning"), (500, "misread", "early"), (504, "misread", "Nothing")}
    assert scans.noise(df.limit(0), "id", "text").count() == 0


def test_misread_capitals(weights):
    words = scans.parse("Document\n5omebody left. lt was 8etween us, lt is.", weights)[3]
    assert words == sorted(["^5omebody", "left", "^lt", "was", "8etween", "us", "lt", "is"])


def test_repair(weights):
    fixes = {"half\nfinished": "half-finished", "d0ugh": "dough", "^5he": "She", "=rnarinade": "marinade"}
    text = PAGE.replace("the dough until", "the d0ugh until").replace("mar-", "rnar-").replace("She baked", "5he baked")
    want = 'Document (PDF, 2 pages): s.pdf — "Report on the dough"\n\nNobody marinated the dough until the yeast looked sour and the half-finished oven was warm. We kept the marinade for the third time.\n\nShe baked the bread.'
    assert scans.repair(text, fixes, weights) == want
    assert scans.repair("Document\n\n1\nThis is a sentence.\n2\nThis is another.", {}, weights) == "Document\n\n1 This is a sentence.\n\n2 This is another."
    assert scans.repair("Document\nsomething un-\nbeliev-\nable happened", {"un\nbeliev": "unbeliev"}, weights) == "Document\n\nsomething unbelievable happened"
    assert scans.repair("Document", {}, weights) == "Document" and scans.repair("", {}, weights) == ""


def test_repaired(spark):
    text = "the morning dinner was about nothing before the early lunch and the usual culture again"
    rows = [(i, f"Document\n{text} with half-finished work.") for i in range(120)] + [(500, "Document\nThe rnorning was carly and\nhalf-\nfinished\n12\nin the rnorn-\ning."), (501, None), (504, "Document\nNothinq is wr0ng."), (504, "Document\nNothinq is wr0ng."), (505, "Document\n" + "early lunch " * 20_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [(r.id, r.repaired) for r in scans.repaired(df, "id", "text").collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[500] == "Document\n\nThe morning was early and half-finished in the morning." and by[501] is None
    assert by[504] == "Document\n\nNothing is wr0ng." and by[505] == "Document\n\n" + ("early lunch " * 20_000).strip() and by[7] == f"Document\n\n{text} with half-finished work."
    assert scans.repaired(df.limit(0), "id", "text").count() == 0


def test_rare_word_among_many_documents(spark):
    common = spark.range(20_000).select("id", F.lit("Document\nthe morning dinner was about nothing.").alias("text"))
    rare = spark.createDataFrame([(100_000 + i, "Document\nthe syzygometer was about.") for i in range(9)] + [(200_000, "Document\nthe syzyg0meter was about.")], "id long, text string")
    got = [tuple(r) for r in scans.noise(common.unionByName(rare), "id", "text").collect()]
    assert got == [(200_000, "misread", "syzygometer")]


def test_planted_headers_are_found(weights):
    how, right, found, planted = random.Random(9), 0, 0, 0
    for _ in range(60):
        lines, breaks, title, headers = scans.made_page(plain_text(how), how)
        got = {i for i, k in enumerate(scans.furniture(lines, breaks, title, weights)) if k == "header"}
        right, found, planted = right + len(got & set(headers)), found + len(got), planted + len(headers)
    assert right / planted >= 0.9 and right / found >= 0.9
    assert not any(k == "header" for k in scans.furniture(lines, breaks, title, np.append(np.zeros(len(scans.PAIR_FEATURES)), -1.0)))


def test_trees_choose(spark, monkeypatch):
    """Without the trees' ranking nothing is replaced."""
    text = "the morning dinner was about nothing before the early lunch and the usual culture again"
    rows = [(i, f"Document\n{text}.") for i in range(120)] + [(500, "Document\nThe rnorning was carly.")]
    df = spark.createDataFrame(rows, "id long, text string")
    words = lambda: {r.noise_text for r in scans.noise(df, "id", "text").collect() if r.noise_type == "misread"}
    assert words() == {"morning", "early"}
    monkeypatch.setattr(scans, "SURE", 1.1)
    assert words() == set()
