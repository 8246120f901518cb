from __future__ import annotations

import io
import json
import plistlib
import sqlite3
import zipfile

from mnemark.functions import states
from mnemark.operators import graph
from mnemark.sources import chat, files, vcard
from pyspark.sql import functions as F

CARDS = "BEGIN:VCARD\r\nVERSION:3.0\r\nUID:u1\r\nFN:Mara\r\n  Hollikson\r\nN:Hollikson;Mara;;;\r\nitem1.EMAIL;TYPE=HOME:M@X.example\r\nTEL;TYPE=CELL:+1 (555) 111-2222\r\nTEL:+1 (555) 111-2222\r\nORG:Mill\\, Inc;Ops\r\nEND:VCARD\r\nBEGIN:VCARD\nFN:Acme\nKIND:org\nEND:VCARD\nBEGIN:VCARD\nTEL:12\nEND:VCARD\n"


def test_vcards(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(CARDS)
    cards = vcard.read_cards(spark, str(tmp_path))
    got = {r.fn: r for r in cards.collect()}
    assert set(got) == {"Mara Hollikson", "Acme", None}
    m = got["Mara Hollikson"]
    assert (m.uid, m.given, m.family, m.emails, m.phones, m.org, m.kind) == ("u1", "Mara", "Hollikson", ["M@X.example"], ["+1 (555) 111-2222"], "Mill, Inc", "person")
    assert got["Acme"].kind == "org"
    aliases = spark.createDataFrame([(7, "m@x.example", "email"), (8, "acme", "name"), (9, "5551112222", "phone")], "entity_id long, alias string, alias_type string")
    assert {r.fn: r.entity_id for r in vcard.match(cards, aliases).collect()} == {"Mara Hollikson": 7, "Acme": 8, None: None}


def test_chat(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "chat.db")
    db.executescript("CREATE TABLE handle(id TEXT, service TEXT); CREATE TABLE message(guid TEXT, text TEXT, attributedBody BLOB, handle_id INT, is_from_me INT, date INT);")
    db.execute("INSERT INTO handle VALUES ('+15551112222', 'SMS')")
    blob = plistlib.dumps({"$objects": ["NSString", "hello from a list", {"x": "hi"}]}, fmt=plistlib.FMT_BINARY)
    db.executemany("INSERT INTO message VALUES (?, ?, ?, ?, ?, ?)", [("a", "plain", None, 1, 0, 736300000), ("b", None, blob, 1, 1, 736300000 * 10**9), ("c", " ", None, None, 0, 0), ("d", None, b"junk", None, 0, 0)])
    db.commit()
    got = {r.rowid: r.text_repr for r in chat.messages(spark, str(tmp_path / "chat.db")).collect()}
    assert got == {1: 'Message from +15551112222: "plain"', 2: 'Message to +15551112222: "hello from a list"'}
    assert len({r.occurred for r in chat.messages(spark, str(tmp_path / "chat.db")).collect()}) == 1
    assert chat.messages(spark, str(tmp_path / "chat.db"), after=1).count() == 1


def test_documents_and_manifest(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp;lt; two</w:t></w:p><w:p><w:t>&#233;</w:t></w:p>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.docx").write_bytes(b.getvalue())
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("skip")
    docs = files.read_documents(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in docs.collect()}
    assert got == {"a.docx": "One &lt; two\né", "bad.xlsx": None}
    assert files.changed_files(docs, docs).count() == 0


def test_sidecars(spark):
    photos = spark.createDataFrame([("a.jpg",), ("b(1).jpg",), ("a_very_long_name.jpg",), ("x.jpg",)], "photo string")
    side = spark.createDataFrame([("a.jpg.json",), ("b.jpg(1).json",), ("a_very_long.json",), ("other.json",)], "sidecar string")
    assert {r.photo: r.sidecar for r in files.match_sidecars(photos, side).collect()} == {"a.jpg": "a.jpg.json", "b(1).jpg": "b.jpg(1).json", "a_very_long_name.jpg": "a_very_long.json"}


def test_events_gazetteer_payloads(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(json.dumps(x) for x in [{"tool_name": "Bash", "tool_input": json.dumps({"command": "gh pr create"}), "tool_response": "https://github.com/o/r/pull/5"}, {"tool_name": "Bash", "tool_input": json.dumps({"command": "gh pr merge"}), "tool_response": "merged o/r#6"}, {"tool_name": "Read", "tool_input": "{}", "tool_response": ""}]))
    assert sorted(tuple(r) for r in files.tool_events(spark, str(tmp_path / "e.json")).collect()) == [("pull", "merge", "o", "r", 6), ("pull", "open", "o", "r", 5)]
    line = lambda n, lat, lon, cc, a: "\t".join(["1", n, n, "", lat, lon, "P", "PPL", cc, "", a, *[""] * 8])
    (tmp_path / "g.tsv").write_text("\n".join([line("Austin", "30.2", "-97.7", "US", "TX"), line("Bad", "x", "1", "FR", ""), line("Paris", "48.8", "2.3", "FR", "11")]))
    got = sorted((r.name, r.region) for r in files.read_gazetteer(spark, str(tmp_path / "g.tsv"), {"TX": "Texas"}).collect())
    assert got == [("Austin", "Texas"), ("Paris", None)]
    ok = {"source": "s", "source_id": "1", "type": "note", "text_repr": "t"}
    (tmp_path / "p.json").write_text(json.dumps({"artifacts": [ok, {**ok, "zzz": 1}, {**ok, "type": "x-Bad"}, {**ok, "text_repr": " "}, {**ok, "type": "x-fine"}]}))
    assert [r.error for r in files.read_payloads(spark, str(tmp_path / "p.json")).orderBy("item").collect()] == [None, "unknown key", "unknown type", "missing field", None]


def test_tool_events_read_commands_not_titles(spark, tmp_path):
    bash = lambda c, r: {"tool_name": "Bash", "tool_input": json.dumps({"command": c}), "tool_response": r}
    link = "https://github.com/o/r/pull/5"
    rows = [bash("cd x && gh pr create --title 'fix merge order'", link), bash("echo gh pr merge", link), bash("gh issue create", json.dumps({"is_error": True, "out": "https://github.com/o/r/issues/8"}))]
    rows += [{"tool_name": "mcp__host__create_issue", "tool_input": "{}", "tool_response": "https://github.com/o/r/issues/9"}, {"tool_name": "mcp__host__get_issue", "tool_input": "{}", "tool_response": "https://github.com/o/r/issues/9"}, bash("gh pr merge o/r#6 --squash", ""), {"tool_name": None, "tool_input": None, "tool_response": None}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, rows)))
    assert sorted(tuple(r) for r in files.tool_events(spark, str(tmp_path / "e.json")).collect()) == [("issue", "open", "o", "r", 9), ("pull", "merge", "o", "r", 6), ("pull", "open", "o", "r", 5)]


def test_transcripts(spark, tmp_path):
    said = [("a", 2, "assistant", "two"), ("a", 1, "user", "one"), ("a", 1, "user", "one"), ("b", 1, "assistant", "alone"), ("c", 1, "user", "x" * 90), ("c", 2, "assistant", "end"), ("d", 1, "user", " "), (None, 1, "user", "q")]
    (tmp_path / "t.json").write_text("\n".join(json.dumps(dict(zip(("session", "turn", "role", "text"), r))) for r in said))
    got = {r.session: (r.turns, r.user_turns, r.text) for r in files.transcripts(spark, str(tmp_path / "t.json"), 40).collect()}
    assert got == {"a": (2, 1, "user: one\nassistant: two"), "c": (2, 1, "x" * 25 + "\nassistant: end")}


def test_takeout_roots(spark):
    df = spark.createDataFrame([("/x/Takeout/a.jpg",), ("/y/p/b.jpg",), ("/y/p/b.jpg.json",), ("/z/c.jpg",)], "path string")
    assert sorted(r.root for r in files.takeout_roots(df).collect()) == ["/x/Takeout", "/y/p"]


def test_card_relations_and_addresses(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("BEGIN:VCARD\nFN:Mara\nADR;TYPE=HOME:;;1 Elm Road;Wexholm;;75712;\nitem2.X-ABRELATEDNAMES;type=pref:Noe Lee Birkwick\nitem2.X-ABLabel:_$!<Brother>!$_\nRELATED;VALUE=text;TYPE=friend:Ann\nEND:VCARD\n")
    cards = vcard.read_cards(spark, str(tmp_path))
    r = cards.first()
    assert r.addresses == ["1 Elm Road, Wexholm, 75712"] and [tuple(x) for x in r.related] == [("Noe Lee Birkwick", "Brother"), ("Ann", "friend")]
    assert vcard.unchanged(cards, cards).count() == 0
    staged = graph.staged_relations(vcard.relation_hints(cards.withColumn("artifact_id", F.lit(1))))
    assert sorted((x.alias, x.label) for x in staged.collect()) == [("ann", "friend"), ("noe birkwick", "Brother"), ("noe lee birkwick", "Brother")]


def test_states():
    assert states.state("tx") == ("TX", "Texas") and states.state("District of Columbia") == ("DC", "District of Columbia") and states.state("Paris") is None
    assert states.place_patterns("Texas") == ["%Texas%", "%, TX"] and states.place_patterns("Norvale") == ["%Norvale%"]
