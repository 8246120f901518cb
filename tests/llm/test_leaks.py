from __future__ import annotations

import random

from mnemark.llm import leaks as L

HOW = random.Random(4)
VOCAB = [f"w{i}" for i in range(3000)]
ITEM = [HOW.choice(VOCAB) for _ in range(60)]
STOCK = [f"stock{i}" for i in range(30)]
OTHER = [HOW.choice(VOCAB) for _ in range(40)] + STOCK
noise = lambda n: [HOW.choice(VOCAB) for _ in range(n)]


def test_leaks(spark):
    changed = list(ITEM)
    for k in range(4, 60, 12):
        changed[k] = "changed"
    docs = {
        1: " ".join(noise(80) + ITEM + noise(80)), 2: " ".join(noise(40) + changed + noise(40)), 3: "<p>" + "<br/>".join(ITEM[:35]).upper() + "&nbsp;</p>",
        4: " ".join(ITEM[:18] + noise(12) + ITEM[30:48]), 5: " ".join(noise(50) + ITEM[:10] + noise(50)), 6: " ".join(noise(40) + STOCK + noise(40)), 7: None, 8: "", 9: " ".join(noise(40_000) + ITEM),
        10: " ".join(reversed(ITEM)), 11: " ".join(OTHER),
    }
    d = spark.createDataFrame([(k, v, "s") for k, v in docs.items()] + [(1, docs[1], "s"), (None, docs[1], "s")], "doc_id long, text string, hash string")
    i = spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(OTHER)), (3, " ".join(noise(40) + STOCK)), (4, None), (5, "too short")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in L.leaked(d, i, "doc_id", "text", "item_id", "text").collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (11, 2)]
    assert L.leaked(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert L.leaked(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_winnowing_guarantee():
    span = noise(L.K + L.WINDOW - 1)
    for _ in range(50):
        a, b = L.kgrams(noise(20) + span + noise(20)), L.kgrams(noise(5) + span + noise(9))
        assert set(a[L.winnow(a)]) & set(b[L.winnow(b)])


def test_items_alike(spark):
    passage, stock = noise(80), noise(15)
    same = [(k, " ".join(ITEM).upper() if k % 2 else " ".join(ITEM)) for k in range(1, 6)]
    questions = [(k, " ".join(passage + noise(12))) for k in range(11, 16)]
    asked = [(k, " ".join(noise(40) + stock)) for k in range(21, 27)] + [(27, " ".join(stock + noise(8)))]
    i = spark.createDataFrame(same + questions + asked, "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(noise(50) + ITEM + noise(50))), (2, " ".join(noise(50) + passage + noise(50))), (3, " ".join(noise(50) + stock + noise(50))), (4, asked[6][1])], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in L.leaked(d, i, "doc_id", "text", "item_id", "text").collect())
    assert got == [(1, k) for k in range(1, 6)] + [(2, k) for k in range(11, 16)] + [(4, 27)]
