from __future__ import annotations

import json

from mnemark.llm import survivors as V


def tables(spark, people, aliases):
    ent = spark.createDataFrame([(i, "person", n, a if a is None or isinstance(a, str) else json.dumps(a), m, "x") for i, n, a, m in people], "id long, kind string, canonical_name string, attrs_json string, merged_into long, person string")
    al = spark.createDataFrame(aliases, "entity_id long, alias string, alias_type string")
    prof = spark.createDataFrame([("vcard", 1), ("gmail", 3)], "source string, trust_rank int")
    return ent, al, prof


def test_groups_and_survivor(spark):
    people = [
        (1, "Mara Hollikson", {"emails": ["<M@x.example>"], "phones": ["(555) 111-2222"], "updated_at": "2024-01-01", "source": "gmail", "org": "N/A", "title": "Clerk"}, None),
        (2, "M. Hollikson", {"emails": [], "phones": ["+1 555 111 2222"], "updated_at": "2025-01-01T10:00:00Z", "source": "vcard", "org": "Mill"}, None),
        (3, "Stefan Hollikson", {"phones": ["5551112222"], "updated_at": "2020-01-01", "source": "gmail"}, None),
        (4, "Hollikson, Mara", '{"emails": [], "updated_at": "2021-01-01", "source": "gma', None),
        (5, "Other Person", None, None),
        (6, "Mara Hollikson", {"emails": ["bridge@x.example"]}, 1),
        (7, "Noé Birk", {"emails": ["n@x.example"], "updated_at": "2022-02-02", "source": "gmail"}, None),
        (8, "Noe Birk", {"emails": ["mailto:N@X.example"], "updated_at": "2022-02-02", "source": "vcard"}, None),
        (9, None, {"phones": ["555-111-2222"]}, None),
    ]
    aliases = [(4, "m@x.example", "email"), (4, "m@x.example", "email"), (6, "M@X.example", "email"), (5, None, "email"), (99, "m@x.example", "email")]
    ent, al, prof = tables(spark, people, aliases)
    people_df = V.survivors(ent, al, prof)
    pairs = sorted(tuple(r) for r in V.same_person_pairs(people_df).collect())
    assert pairs == [(1, 2, 2), (1, 4, 2), (2, 4, 2), (7, 8, 8)]
    best = {r.keep_id: r for r in V.best_records(people_df).collect()}
    assert set(best) == {2, 3, 5, 8, 9} and best[2].records == 3 and best[2].org == "Mill" and best[2].title == "Clerk" and best[2].emails == "m@x.example" and best[2].phones == "5551112222"


def test_initial_that_fits_two_names_ties_no_one(spark):
    ent, al, prof = tables(spark, [(1, "Dario Birk", {"phones": ["5551112222"]}, None), (2, "Dimitri Birk", {"phones": ["5551112222"]}, None), (3, "D. Birk", {"phones": ["5551112222"]}, None)], [])
    assert V.same_person_pairs(V.survivors(ent, al, prof)).count() == 0


def test_long_chain_and_empty(spark):
    chain = [(i, f"Ann B{i}", {"emails": [f"e{i}@x.example", f"e{i + 1}@x.example"]}, None) for i in range(40)]
    ent, al, prof = tables(spark, chain, [])
    assert V.survivors(ent, al, prof).select("person").distinct().count() == 1
    ent, al, prof = tables(spark, [], [])
    assert V.same_person_pairs(V.survivors(ent, al, prof)).count() == 0


def test_plans_stay_small(spark, monkeypatch):
    """The driver holds each plan: contacts and members that are read several times must not repeat the plans below them."""
    leaves, cut = [], V.cut
    monkeypatch.setattr(V, "cut", lambda df: (leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size()), cut(df))[1])
    V.survivors(*tables(spark, [(1, "Mara Hollikson", {"emails": ["m@x.example"]}, None), (2, "M. Hollikson", {"emails": ["m@x.example"]}, None)], []))
    assert leaves and max(leaves) <= 8
