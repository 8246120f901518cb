from __future__ import annotations

from mnemark.llm import copies

TEXTS = [
    (1, "Hello,  World! 12"), (2, "hello world​ 1-2"), (3, "HELLO WORLD 12"), (4, None), (5, ""), (6, " ... "), (7, "vendor: A B; amount: 1.50; ref: x"), (8, '{"amount": "1.50", "ref": "X", "vendor": "a b"}'),
    (9, "ref: x\nvendor: A-B\namount: 150"), (10, "Straße"), (11, "STRASSE"), (12, "vendor: AB; amount: 15.1; ref: x"), (13, "y" * 200_000), (14, "Y" * 200_000), (3, "HELLO WORLD 12"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "id long, text string, key string, first_id int")


def test_pairs_and_counts(spark):
    df = frame(spark, TEXTS)
    got = sorted((r.first_id, r.copy_id) for r in copies.copy_pairs(df, "id", "text").collect())
    assert got == [(1, 2), (1, 3), (5, 6), (7, 8), (7, 9), (10, 11), (13, 14)]
    groups = {r.first_id: r.copies for r in copies.copy_groups(df, "id", "text")[1].collect()}
    assert groups == {1: 4, 5: 2, 7: 3, 10: 2, 12: 1, 13: 2}
    assert copies.collisions(copies.copy_groups(df, "id", "text")[1]).count() == 0


def test_hot_group_is_whole(spark, monkeypatch):
    import mnemark.llm.copies as m

    real = m.join_hot
    monkeypatch.setattr(m, "join_hot", lambda *a, **k: real(*a, **k, piece=10))
    df = frame(spark, [(i, "Same text!" if i % 3 else f"other {i}") for i in range(600)])
    got = copies.copy_pairs(df, "id", "text").collect()
    assert len(got) == 399 and {r.first_id for r in got} == {1}


def test_empty(spark):
    assert copies.copy_pairs(frame(spark, []), "id", "text").count() == 0


def test_json_records_of_any_values():
    same = ['{"id": 1, "b": "y"}', '{ "B": "Y", "ID": 1 }', '{"b":"y",\n"id":1}']
    assert len({copies.canonical(t) for t in same}) == 1 and copies.canonical('{"id": 1, "b": "z"}') != copies.canonical(same[0])
    assert copies.canonical('{"id": null, "a": [1, "x"], "c": true}') == copies.canonical('{"c": true, "a": [1,"X"], "id": null}')
    assert copies.canonical('{"a": "1", "b": "2", "c": "3"}') == copies.canonical("c: 3; a: 1; b: 2")
    assert copies.canonical('{"a": 1') == copies.canonical("a 1") and copies.canonical("{}") == copies.canonical("") and copies.json_fields("[" * 100_000) == []
