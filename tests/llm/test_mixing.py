from __future__ import annotations

from mnemark.llm import mixing as M


def test_mixture(spark):
    rows = [(i, "Mail-Export " if i % 2 else "mail_export", "one two three four five") for i in range(300)] + [(1000 + i, "notes", "one two three four five") for i in range(40)] + [(2000, "other", "one"), (2001, None, "one"), (2002, "notes", None), (2003, "notes", "")]
    docs = spark.createDataFrame([(i, s, t, 5) for i, s, t in rows], "doc_id long, source string, text string, tokens int")
    targets = spark.createDataFrame([("mail_export", 0.5, 1), ("notes", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = M.mixed(docs, targets, "doc_id", "source", "text")
    r = {x.source: x for x in report.collect()}
    assert r["notes"].rate == 3 and r["notes"].mixed_tokens == 3 * r["notes"].tokens and r["notes"].largest_repeat == 3
    assert r["absent"].rate is None and r["absent"].mixed_tokens == 0 and set(r) == {"mail_export", "notes", "absent"}
    assert abs(r["mail_export"].mixed_tokens / r["notes"].mixed_tokens - 1.25) < 0.01
    assert all(x.largest_repeat <= x.max_repeats for x in r.values())
    got = {x.id: x.copies for x in mix.collect()}
    assert {got.get(1000 + i) for i in range(40)} == {3} and 2000 not in got and 2002 not in got
    again = {x.id: x.copies for x in M.mixed(docs.repartition(7), targets, "doc_id", "source", "text")[0].collect()}
    assert again == got


def test_larger_total_is_capped(spark):
    docs = spark.createDataFrame([(i, "a" if i < 10 else "b", "x y z") for i in range(110)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    r = {x.source: x for x in M.mixed(docs, targets, "doc_id", "source", "text", total_tokens=400)[1].collect()}
    assert r["a"].rate == 2 and r["a"].largest_repeat == 2 and r["b"].largest_repeat == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = M.mixed(docs, targets, "doc_id", "source", "text")
    assert mix.count() == 0 and report.count() == 1
