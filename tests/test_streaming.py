from __future__ import annotations

import json

from mnemark.operators import ingest
from mnemark.streaming import ingest as stream, sessions


def row(i, key, **k):
    return {"id": i, "type": "note", "source": "s", "source_id": key, "text_repr": f"t{i}", **k}


def test_stream_equals_batch(spark, tmp_path):
    waves = [row(1, "a", content_hash="0" * 64), row(2, "a", place_label="home"), row(3, None), row(4, "b", type="x-Bad"), row(5, "a", text_repr=None, occurred_at="2024-01-01")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, waves[:3])))
    for part in (None, waves[3:]):
        if part:
            (tmp_path / "in/2.json").write_text("\n".join(map(json.dumps, part)))
        stream.keep(stream.waves(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in stream.current(spark, str(tmp_path / "log")).collect()}
    good = [w for w in waves if w["type"] == "note" and w["text_repr"]]
    want = {tuple(r) for r in ingest.fold(spark.createDataFrame([{**dict.fromkeys(f.split()[0] for f in stream.SCHEMA.split(", ")), **w} for w in good], stream.SCHEMA)).collect()}
    assert got == want and spark.read.parquet(str(tmp_path / "log_rejected")).count() == 2


def test_fold_against_a_loop(spark):
    import random

    how = random.Random(6)
    waves = [(i, how.choice(["note", None, "post"]), "s", how.choice(["k1", "k2", None]), how.choice([None, "h1", "h2"]), how.choice([None, "2024"]), how.choice([None, 1.5]), how.choice([None, -2.5, 3.0]), how.choice([None, "p"]), how.choice([None, "r"]), how.choice([None, "t1", "t2"]), None) for i in range(200)]
    names = [f.split()[0] for f in stream.SCHEMA.split(", ")]
    state: dict = {}
    for w in (dict(zip(names, x)) for x in waves):
        k = w["source_id"] or w["id"]
        if k not in state:
            state[k] = dict(w)
        else:
            state[k].update({c: w[c] for c in ingest.MUTABLE if w[c] is not None})
    got = {(r.source_id or r.first_id): r for r in ingest.fold(spark.createDataFrame(waves, stream.SCHEMA)).collect()}
    assert set(got) == set(state) and all(got[k][c] == v[c] for k, v in state.items() for c in [*ingest.MUTABLE, *ingest.FIRST])


def test_sessions(spark, tmp_path):
    e = [(1, 7, "2024-01-01T00:00:00"), (2, 7, "2024-01-01T00:20:00"), (2, 7, "2024-01-01T00:20:00"), (3, 7, "2024-01-01T02:00:00"), (4, 8, "2024-01-01T00:00:00"), (5, 9, "2024-01-09T00:00:00")]
    df = spark.createDataFrame(e, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "timestamp(ts) ts")
    batch = sorted((r.user_id, r.n) for r in sessions.sessions(df).collect())
    assert batch == [(7, 1), (7, 2), (8, 1), (9, 1)]
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = sessions.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    closed = sorted((r.user_id, r.n) for r in spark.sql("SELECT * FROM sess").collect())
    assert closed == [x for x in batch if x[0] != 9]


def test_only_touched_days_are_renewed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    days = lambda k, *ds: "\n".join(json.dumps(row(k + i, f"{k}-{i}", occurred_at=f"{x}T10:00:00Z")) for i, x in enumerate(ds))
    for n, text in enumerate((days(1, "2024-01-01", "2024-01-02"), days(10, "2024-01-02"))):
        (tmp_path / f"in/{n}.json").write_text(text)
        stream.keep(stream.waves(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    none = spark.createDataFrame([], "day date, input_hash string")
    renewed = lambda known, b: sorted(str(r.day) for r in stream.digests_to_renew(spark, str(tmp_path / "log"), known, b).collect())
    assert renewed(none, None) == ["2024-01-01", "2024-01-02"] and renewed(none, [1]) == ["2024-01-02"]
