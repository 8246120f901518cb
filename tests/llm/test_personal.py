from __future__ import annotations

from pyspark.sql import functions as F

from mnemark.llm import personal as P

FINDER = P.Finder(["mara", "noe", "stefan"], ["hollikson", "birkwick"])
CASES = {
    "Write to a.b+c@post.x.example today": [("email", "a.b+c@post.x.example")],
    "reach ann dot lee at home dot example or bob [at] mail [dot] test.": [("email", "ann dot lee at home dot example"), ("email", "bob [at] mail [dot] test")],
    "Meet at @2pm near the Willow Road stop.": [],
    "Call (555) 322-1391 ext. 50 or +49 (0)30 23125-886, 01 99 00 06 17.": [("phone", "(555) 322-1391 ext. 50"), ("phone", "+49 (0)30 23125-886"), ("phone", "01 99 00 06 17")],
    "Order 5551-204-77, score 21-17, 19-21, total 1 555.20, batch 2024-11-03/0042, v2.14.3": [],
    "SSN 987-03-8596, 1 90 13 99 836 034 88 and X0302375E; V396-7894-5116": [("id_number", "987-03-8596"), ("id_number", "1 90 13 99 836 034 88"), ("id_number", "X0302375E"), ("id_number", "V396-7894-5116")],
    "To 70 Ferryman Road, Apt 31, Wexholm 75712. Orchard Street was closed.": [("address", "70 Ferryman Road, Apt 31, Wexholm 75712")],
    "Beaconstraße 3, 99947 Wexholm; 22 rue du Beacon, 84345 Norvale; Calle Willow 8, Lowmere.": [("address", "Beaconstraße 3, 99947 Wexholm"), ("address", "22 rue du Beacon, 84345 Norvale"), ("address", "Calle Willow 8, Lowmere")],
    "Mara Hollikson, Hollikson, Mara. Herr Stefan B. Birkwick; B. Birkwick; noé birkwick": [("name", "Mara Hollikson"), ("name", "Hollikson, Mara"), ("name", "Stefan B. Birkwick"), ("name", "B. Birkwick"), ("name", "noé birkwick")],
    "Clerk at Birkwick Press. Mara Birkwick Bank pays.": [],
}


def test_pieces():
    for text, want in CASES.items():
        assert sorted((k, text[a:b]) for a, b, k in FINDER.spans(text)) == sorted(want), text


def test_operator(spark):
    long = "word " * 50_000 + "x@y.example"
    rows = [(1, "Call (555) 322-1391 now"), (2, None), (3, ""), (4, long), (None, "a@b.example"), (1, "Call (555) 322-1391 now"), (6, "1" * 100_000), (7, "." * 50_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "id long, text string, pii_text string")
    lex = (["mara"], ["hollikson"])
    got = sorted((r.id or 0, r.pii_type, r.pii_text) for r in P.found(df, "id", "text", lex).collect())
    assert got == [(0, "email", "a@b.example"), (1, "phone", "(555) 322-1391"), (1, "phone", "(555) 322-1391"), (4, "email", "x@y.example")]
    out = {r.id: r.redacted for r in P.redacted(df, "id", "text", lex).collect()}
    assert out[1] == "Call [PHONE] now" and out[2] is None and out[3] == "" and out[4] == "word " * 50_000 + "[EMAIL]"
    assert P.found(df.limit(0), "id", "text", lex).count() == 0


def test_lexicons(spark):
    df = spark.createDataFrame([("Mara  Hollikson",), ("Hollikson, Noé",), ("M. Hollikson",), (None,), ("Single",), ("",)], "name string")
    assert P.name_lexicons(df, "name") == (["mara", "noe"], ["hollikson"])
    assert P.name_lexicons(df.limit(0), "name") == ([], [])


def test_rare_names_on_large_tables(spark, monkeypatch):
    people = spark.range(30_000).select(F.when(F.col("id") == 7, "Zephyrine Quillfeather").when(F.col("id") == 8, "Ann-Lou d'Oré").otherwise("Mara Hollikson").alias("name"))
    names = P.name_table(people, "name")
    assert {tuple(r) for r in names.collect()} == {("mara", True), ("hollikson", False), ("zephyrine", True), ("quillfeather", False), ("ann-lou", True), ("d'ore", False)}
    texts = ["ZEPHYRINE QUILLFEATHER called", "Z. Quillfeather, then Quillfeather, Zephyrine and Mara Hollikson.", "Zephyrine Newname left Ann-Lou Hollikson (zephyrine hollikson)", None, "", "nobody"]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (0, texts[0])], "id long, text string")
    want = [(-1, "ZEPHYRINE QUILLFEATHER"), (0, "ZEPHYRINE QUILLFEATHER"), (0, "ZEPHYRINE QUILLFEATHER"), (1, "Mara Hollikson"), (1, "Quillfeather, Zephyrine"), (1, "Z. Quillfeather"), (2, "Ann-Lou Hollikson"), (2, "Zephyrine Newname"), (2, "zephyrine hollikson")]
    for limit in (100, 1):  # sent to the tasks, and joined
        monkeypatch.setattr(P, "NAMES_BROADCAST", limit)
        assert sorted((-1 if r.id is None else r.id, r.pii_text) for r in P.found(df, "id", "text", names).collect()) == want
        assert P.redacted(df, "id", "text", names).count() == 8


def test_a_reused_worker_takes_the_names_of_its_own_lexicon(spark):
    df = spark.createDataFrame([(1, "Mara Hollikson met Noe Birkwick.")], "id long, text string").repartition(1)
    for lex, want in (((["mara"], ["hollikson"]), ["Mara Hollikson"]), ((["noe"], ["birkwick"]), ["Noe Birkwick"]), ((["mara"], ["hollikson"]), ["Mara Hollikson"])):
        assert [r.pii_text for r in P.found(df, "id", "text", lex).collect()] == want
    assert P.digest((["a"], ["b"])) != P.digest((["a", "b"], [])) != P.digest(([], ["a", "b"]))


def test_many_pieces_in_one_text():
    text = " ".join(f"user{i}@post.example, (555) 322-{1000 + i}" for i in range(4000))
    assert len(FINDER.spans(text)) == 8000 and FINDER.spans(text) == sorted(FINDER.spans(text))
