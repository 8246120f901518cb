from __future__ import annotations

import math
import random

from mnemark.operators import places, spatial


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def brute(pts, regs):
    ok = lambda y, x: y is not None and x is not None and abs(y) <= 90 and abs(x) <= 180
    return sorted((p, r) for p, a, b in pts for r, c, d, k in regs if ok(a, b) and ok(c, d) and k and k > 0 and km(a, b, c, d) <= k)


def run(spark, pts, regs):
    p = spark.createDataFrame([(*x, "n") for x in pts], "pid long, latitude double, longitude double, radius_km string")
    r = spark.createDataFrame(regs, "rid long, latitude double, longitude double, radius_km double")
    return sorted((x.pid, x.rid) for x in spatial.within(p, r, "pid", "rid").collect())


def test_against_brute_force(spark):
    how = random.Random(3)
    pts = [(i, how.uniform(-90, 90), how.uniform(-180, 180)) for i in range(400)] + [(1000 + i, how.choice([-90.0, 90.0, -89.99, 89.99]), how.uniform(-180, 180)) for i in range(20)] + [(2000 + i, how.uniform(-1, 1), how.choice([-180.0, 180.0, -179.99, 179.99])) for i in range(20)]
    regs = [(i, how.uniform(-90, 90), how.uniform(-180, 180), how.choice([0.3, 5.0, 40.0, 700.0, 3000.0, 12000.0, 21000.0])) for i in range(60)] + [(100, 90.0, 0.0, 500.0), (101, -89.9, 10.0, 900.0), (102, 0.0, 179.9, 300.0), (103, 0.0, -180.0, 100.0)]
    assert run(spark, pts, regs) == brute(pts, regs)


def test_edges(spark, monkeypatch):
    nan = float("nan")
    pts = [(1, 10.0, 10.0), (1, 10.0, 10.0), (2, None, 10.0), (3, nan, 10.0), (4, 91.0, 0.0), (5, 0.0, 0.0), (6, 10.0, nan)]
    regs = [(1, 10.0, 10.0, 1.0), (2, 0.0, 0.0, 5.0), (3, 10.0, 10.0, 0.0), (4, 10.0, 10.0, None), (5, nan, 1.0, 3.0), (6, 10.0, 10.0, nan), (7, 10.0, 10.0, -1.0)]
    want = [(1, 1), (1, 1), (5, 2)]
    assert run(spark, pts, regs) == want
    monkeypatch.setattr(spatial, "BROADCAST_CELLS", 0)
    assert run(spark, pts, regs) == want
    assert run(spark, [], regs) == [] and run(spark, pts, []) == []


def test_reverse_geocode_prefers_the_nearest(spark):
    art = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 11.5), (3, 60.0, 60.0), (4, None, 1.0)], "id long, latitude double, longitude double")
    gaz = spark.createDataFrame([("Here", 10.01, 10.0), ("There", 10.3, 10.0)], "name string, latitude double, longitude double")
    got = {r.artifact_id: r.label for r in places.reverse_geocode(art, gaz).collect()}
    assert got == {1: "Here", 2: "near Here"}
