from __future__ import annotations

import random

from mnemark.functions import scalars as S
from mnemark.operators import annotate, graph, search
from pyspark.sql import functions as F


def aliases(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, alias string, alias_type string")


def test_annotation(spark):
    art = spark.createDataFrame([(1, "From +1 555-111-2222? no: +15551112222 and a@x.example, a@x.example; b@x.example."), (2, "+15551112222"), (3, None)], "id long, text_repr string")
    links = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "artifact_id long, entity_id long")
    ents = spark.createDataFrame([(10, "Mara"), (11, "Ann"), (12, "Bob")], "id long, canonical_name string")
    al = aliases(spark, [(10, "(555) 111-2222", "phone"), (11, "A@x.example", "email"), (11, "b@x.example", "email"), (12, "b@x.example", "email")])
    got = {r.artifact_id: r.display_text for r in annotate.annotated(art, links, ents, al).collect()}
    assert got == {1: "From +1 Mara (555-111-2222)? no: Mara (+15551112222) and Ann (a@x.example), Ann (a@x.example); b@x.example."}


def test_resolution(spark):
    al = aliases(spark, [(1, "Quinn Lee", "name"), (2, "sam a", "name"), (3, "sam b", "name"), (4, "555.111.2222", "phone"), (5, " ", "name"), (6, None, "name")])
    terms = spark.createDataFrame([("QUINN",), ("sam",), ("quinn lee",), ("1-555-111-2222",), (None,)], "term string")
    assert sorted(tuple(r) for r in graph.resolve(terms, al).collect()) == [("1-555-111-2222", 4), ("quinn lee", 1)]
    assert [tuple(r) for r in graph.resolve_prefix(terms, al).collect()] == [("QUINN", 1)]


def test_hints_and_confidence(spark):
    df = spark.createDataFrame([("email", 0.5), ("name", 0.99), ("name", None), ("name", float("nan")), ("name", -1.0), ("handle", 0.4), ("name", float("inf"))], "t string, c double")
    assert [r[0] for r in df.select(S.hint_confidence(F.col("t"), F.col("c"))).collect()] == [1.0, 0.9, 0.7, 0.7, 0.7, 0.4, 0.7]
    hints = spark.createDataFrame([(1, "M@x.example", "email", "sender", 0.2), (1, "mara", "name", "sender", 0.3), (2, "nobody", "name", "sender", None)], "artifact_id long, alias string, alias_type string, role string, supplied double")
    links, staged = graph.link_hints(hints, aliases(spark, [(9, "m@x.example", "email"), (9, "Mara", "name")]))
    assert [tuple(r) for r in links.collect()] == [(1, 9, "sender", 1.0)] and [r.alias for r in staged.collect()] == ["nobody"]


def test_merge_follows_chains(spark):
    ents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None)], "id long, merged_into long")
    links = spark.createDataFrame([(7, 4, "a", 0.9), (7, 1, "a", 0.1), (8, 3, "a", None), (8, 2, "a", 0.4), (9, 5, "b", None)], "artifact_id long, entity_id long, role string, confidence double")
    got = sorted(tuple(r) for r in graph.merged_links(links, ents).collect())
    assert got == [(7, 1, "a", 0.1), (8, 1, "a", 0.4), (9, 5, "b", None)]


def test_similar_names_lose_no_pair(spark):
    how = random.Random(8)
    base = ["mara hollikson", "stefan birkwick", "ann lee", "o"]
    names = set(base)
    for _ in range(150):
        w = list(how.choice(base))
        for _ in range(how.randint(1, 4)):
            k = how.randrange(len(w) + 1)
            w[k : k + how.randint(0, 1)] = how.choice(["", "x", "q"])
        names.add("".join(w).strip() or "z")
    ents = spark.createDataFrame([(i, "person", n, None) for i, n in enumerate(sorted(names))], "id long, kind string, canonical_name string, merged_into long")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    norm = sorted({n.strip() for n in names})
    want = {(a, b) for a in norm for b in norm if a < b and 1 - lev(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9}
    assert {(r.name_a, r.name_b) for r in graph.similar_names(ents).collect()} == want


def test_fusion_and_fallback(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.2)], "artifact_id long, distance double")
    w = spark.createDataFrame([(2, 9.0), (3, 8.0)], "artifact_id long, score double")
    assert [r.artifact_id for r in search.fuse(v, w, 5).collect()] == [2, 1, 3]
    art = spark.createDataFrame([(1, "note", "2026-06-10", "spare guitar", "Norvale"), (2, "visit", "2026-06-10", "spare guitar", None), (3, "note", "2026-01-10", "spare guitar", None)], "id long, type string, occurred_at string, text_repr string, place_label string")
    vec = spark.createDataFrame([], "artifact_id long, embedding array<float>")
    links = spark.createDataFrame([], "artifact_id long, entity_id long, role string")
    find = lambda **k: [r.artifact_id for r in search.search(art, vec, links, aliases(spark, [(1, "a", "name")]), search.live_index(art), search.Query("guitar", **k)).collect()]
    assert sorted(find()) == [1, 3] and find(types=["visit"]) == [2] and find(start="2026-06-01", end="2026-06-30") == [1] and find(place="nor") == [1]
    assert sorted(find(place="nowhere")) == [1, 3] and find(start="2030-01-01", end="2030-02-01") == []


def test_dates(spark):
    t = ["2026-03-15T20:00-08:00", "2026-03-15", "2026-03-15 10:00", "2026-02-30", "junk", None, "2026-03-15T20:00:00Z\n", "2026-03-15T00:30+05:30"]
    got = [str(r[0]) if r[0] else None for r in spark.createDataFrame([(x,) for x in t], "t string").select(S.utc_date(F.col("t"))).collect()]
    assert got == ["2026-03-16", "2026-03-15", "2026-03-15", None, None, None, None, "2026-03-14"]


def test_cycles_of_merges_end_at_the_smallest(spark):
    ents = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (0, 4), (4, 1), (5, 6), (6, None), (7, 7), *((i, i - 1) for i in range(101, 300)), (100, None)], "id long, merged_into long")
    got = {r.id: r.keep for r in graph.final_ids(ents).collect()}
    assert [got[i] for i in (1, 2, 3, 0, 4, 5, 7)] == [1, 1, 1, 1, 1, 6, 7] and {got[i] for i in range(101, 300)} == {100}
    assert graph.final_ids(ents.limit(0)).count() == 0


def test_accents_of_any_language(spark):
    df = spark.createDataFrame([("Dvořák Erdős Łódź naïve e\u0301tude",), (None,)], "t string")
    assert [r[0] for r in df.select(S.search_terms(F.col("t"))).collect()] == [["dvorak", "erdos", "łodz", "naive", "etude"], None]


def test_bm25_index_follows_changes(spark, tmp_path):
    art = spark.createDataFrame([(1, "red lamp lamp"), (2, "blue lamp"), (3, None), (4, "")], "id long, text_repr string")
    search.index_texts(art, str(tmp_path / "i"))
    new = spark.createDataFrame([(2, "green door"), (5, "lamp")], "id long, text_repr string")
    search.index_texts(new, str(tmp_path / "i"), 1)
    whole = search.live_index(art.filter("id <> 2").unionByName(new))
    rows = lambda index, q: [tuple(r) for r in search.bm25(index, q, 9).collect()]
    for q in ("lamp", "lamp lamp green", "nothing", "?"):
        assert rows(search.read_index(spark, str(tmp_path / "i")), q) == rows(whole, q)
    asked = spark.createDataFrame([(7, "lamp lamp green"), (8, None), (9, "?")], "query_id long, text string")
    got = [(r.artifact_id, r.score) for r in search.bm25_set(whole, asked, 9).orderBy("rank").collect()]
    assert got == rows(whole, "lamp lamp green")


def test_search_options(spark):
    art = spark.createDataFrame([(1, "note", "2024-01-01", "Austin, TX", 0.0, 0.0, "a lamp"), (2, "note", "2024-01-02", None, 0.0, 179.99, "b"), (3, "visit", "2024-01-03", "x", 89.99, 100.0, "lamp"), (4, "note", None, None, None, None, None)], "id long, type string, occurred_at string, place_label string, latitude double, longitude double, text_repr string")
    links = spark.createDataFrame([(1, 10, "sender"), (2, 11, "sender")], "artifact_id long, entity_id long, role string")
    al = aliases(spark, [(10, "Mara Hollikson", "name"), (11, "Noe Lee", "name"), (12, "Noe Birk", "name")])
    ids = lambda **k: sorted(r.id for r in search.found(art, links, al, search.Query(**k))[0].collect())
    assert ids(place="Texas") == [1] and ids(entities=["mara", "noe"]) == [1] and ids(entities=["noe"]) == [1, 2, 4]
    assert ids(near=(0.0, -179.99), radius_km=10) == [2] and ids(near=(91.0, 0.0)) == [1, 2, 4]
    assert ids(types=["visit"], near=(90.0, 0.0), radius_km=9999) == [3]
    assert ids(types=["visit"], place="Texas") == [3]
    assert search.found(art, links, al, search.Query("q", place="Nowhere", entities=["zed"]))[1] == "q zed Nowhere"


def test_query_set_of_vectors(spark):
    import numpy as np

    how = np.random.default_rng(2)
    x = how.normal(size=(60, 4)).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3, [9.0] * 4), (61, None), (62, [1.0])], "artifact_id long, embedding array<double>")
    q = df.filter("artifact_id IN (3, 7)").filter("embedding[0] < 9").withColumnRenamed("artifact_id", "query_id")
    got = {(r.query_id, r["rank"]): r.artifact_id for r in search.knn_set(df, q, 5, 4, block=1, slice_rows=7).collect()}
    for i in (3, 7):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        assert [got[i, r] for r in range(1, 6)] == sorted(range(60), key=lambda k: (d[k], k))[:5]


def test_one_key_of_many_rows(spark):
    from mnemark.operators import ingest, places

    e = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS u", "timestamp_seconds(id * 700 + IF(id > 1500, 9000, 0)) AS ts")
    assert places.sessions(e.filter("u = 1"), "u", "ts", 60).select("n").orderBy("started").collect() == [(502,), (499,)]
    waves = spark.range(300).selectExpr("id", "'s' AS source", "'k' AS source_id", "'note' AS type", "CAST(NULL AS STRING) AS occurred_at", "CAST(NULL AS DOUBLE) AS latitude", "1.0D AS longitude", "IF(id % 100 = 0, CAST(id AS STRING), NULL) AS place_label", "'t' AS text_repr", "NULL AS extra_json")
    assert sorted((r.seq, r.changed) for r in ingest.history(waves, piece=7).collect()) == [(100, "place_label"), (200, "place_label")]


def test_dates_and_labels(spark):
    us = lambda f, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(f(F.col("t"))).collect()]
    assert us(lambda c: S.pdf_date(c, F.lit(1_700_000_000_000_000)), "D:20200101003000+01'00'", "D:20200101000000Z", "D:20200231000000Z", "D:19700101000000Z", "D:20990101000000Z", None) == [1577835000000000, 1577836800000000, None, None, None, None]
    assert us(S.office_date, "2020-01-01T00:00:00Z", "2020-01-01T00:00:00-01:00", "2020-01-01T00:00:00", "1980-01-01T00:00:00Z", "junk") == [1577836800000000, 1577840400000000, 1577836800000000, None, None]
    assert us(S.full_place, "Austin, TX", "Paris, FR", None) == ["Austin, Texas", "Paris, FR", None]
    assert us(S.redacted_url, "https://u:p@h.example/a/0123456789abcdef01?token=s&x=1#f") == ["https://h.example/a/…?token=…&x=…#f"]


def test_similarity_of_vectors_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [1.0])], "artifact_id long, embedding array<float>")
    links = spark.createDataFrame([(i, 10 + i, "self") for i in range(1, 7)], "artifact_id long, entity_id long, role string")
    pairs = spark.createDataFrame([(11, 10 + i) for i in range(2, 8)], "entity_id_a long, entity_id_b long")
    got = {r.entity_id_b: r.similarity for r in graph.with_text_similarity(pairs, links, vectors).collect()}
    assert got == {12: 100, 13: None, 14: None, 15: None, 16: None, 17: None}


def test_query_set_of_texts(spark):
    """As single searches, whatever the slices, and without rows for pairs of queries and artifacts that share a word."""
    how = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    text = lambda: " ".join(how.choice(words[: how.choice([4, 20, 80])]) for _ in range(how.randint(1, 25)))
    art = spark.createDataFrame([(i, "note" if i % 5 else "digest", text()) for i in range(600)] + [(600, "note", None), (601, "note", "...")], "id long, type string, text_repr string").repartition(3).cache()
    index, cands = search.live_index(art), art.filter("type = 'note'")
    asked = [(1, "w1 w2 w1 w70"), (2, text()), (3, "w79"), (4, "unheard"), (5, None), (6, "W0 w0 w3 unheard")]
    found = search.bm25_set(index, spark.createDataFrame(asked, "query_id long, text string"), 5, cands, slice_postings=100)
    assert "HashAggregate(keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r["rank"]): (r.artifact_id, r.score) for r in found.collect()}
    want = {(q, n): tuple(r) for q, t in asked if t for n, r in enumerate(search.bm25(index, t, 5, cands).collect(), 1)}
    assert len(got) == 20 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_query_set_of_vectors_keeps_only_the_nearest(spark):
    """Small tables are measured by several tasks too; an artifact's repeated vectors count by the nearest."""
    df = spark.createDataFrame([(i % 40, [float(i), 1.0]) for i in range(120)], "artifact_id long, embedding array<double>")
    near = search.knn_set(df, spark.createDataFrame([(1, [0.0, 1.0]), (2, [100.0, 1.0])], "query_id long, embedding array<double>"), 3, 2)
    assert f", {search.LEAST_SLICES})" in near._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r["rank"], r.artifact_id, r.distance) for r in near.collect()) == [(1, 1, 0, 0.0), (1, 2, 1, 1.0), (1, 3, 2, 2.0), (2, 1, 20, 0.0), (2, 2, 19, 1.0), (2, 3, 21, 1.0)]
