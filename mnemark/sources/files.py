"""Documents, sidecars, tool events, gazetteers and JSON payloads from files."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mnemark import model

PARTS = {".docx": r"word/document\.xml", ".pptx": r"ppt/slides/slide\d+\.xml", ".xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml"}
MOST_BYTES = 50 * 1024 * 1024
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
# Where an issue or pull request stands: a link to it on the host, or owner/repo#number.
NAME = r"[\w.-]+"
LINK = rf"https?://github[.]com/({NAME})/({NAME})/(issues|pull)/([0-9]+)"
SHORT = rf"(?<![\w/])({NAME})/({NAME})#([0-9]+)"
# A command line that makes or merges one: the tool's name, its object and its verb, at the beginning of a command.
COMMAND = r"(?:^|[;&|]\s*)gh\s+(issue|pr)\s+(create|merge)\b"
# The name of a tool that does, after its server's: create_issue, create_pull_request, merge_pull_request.
TOOL = r"__(create|merge)_(issue|pull_request)$"


def xml_text(xml: str) -> str:
    """Text of an office document's part: paragraphs, slides and rows on lines of their own, character references decoded once."""
    xml = re.sub(r"</(?:w:p|a:p|row|si)>", "\n", xml)
    text = re.sub(r"<[^>]+>", "", re.sub(r"<w:tab/>|</c>", "\t", xml))
    decode = lambda m: ENTITIES.get(m[1]) or (chr(int(m[1][2:], 16)) if m[1][1:2] in "xX" else chr(int(m[1][1:]))) if m[1] in ENTITIES or m[1][0] == "#" else m[0]
    return re.sub(r"&(#?\w+);", decode, text)


def office_text(name: str, content: bytes) -> str | None:
    kind = PARTS.get(name[name.rfind(".") :].lower())
    if kind is None or content is None or len(content) > MOST_BYTES:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts = sorted((n for n in z.namelist() if re.fullmatch(kind, n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])
            return "\n".join(xml_text(z.read(n).decode("utf-8", "replace")) for n in parts).strip()
    except (zipfile.BadZipFile, ValueError, OverflowError):
        return None


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, size, text): office documents below a folder, too large ones left out, unreadable ones with null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    extract = F.pandas_udf(lambda p, c: pd.Series([office_text(a, b) for a, b in zip(p, c)], dtype=object), "string")
    return files.filter((F.col("length") <= MOST_BYTES) & F.lower("path").rlike(r"\.(docx|pptx|xlsx)$")).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), extract("path", "content").alias("text"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest doesn't have with the same time and size."""
    return files.join(manifest.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")


def match_sidecars(photos: DataFrame, sidecars: DataFrame, least: int = 6) -> DataFrame:
    """(photo, sidecar): by whole name, by name with its copy number at the other place, else by a cut-off beginning of six characters
    or more, the longest; candidates are joined by equality, the cut-off ones by every length that a sidecar has."""
    base = F.regexp_replace("sidecar", r"(\.supplemental-metadata)?\.json$", "")
    s = sidecars.select("sidecar", base.alias("key"))
    stem, number, ext = (F.regexp_extract("photo", r"^(.*?)(\(\d+\))?(\.[^.]*)$", i) for i in (1, 2, 3))
    p = photos.select("photo", F.array_distinct(F.array(F.col("photo"), F.concat(stem, ext, number), stem)).alias("names"))
    exact = p.select("photo", F.posexplode("names").alias("rank", "key")).join(s, "key").groupBy("photo").agg(F.min(F.struct("rank", "sidecar")).alias("b")).select("photo", F.col("b.sidecar").alias("sidecar"))
    rest = p.join(exact, "photo", "left_anti").select("photo", F.explode(F.when(F.length("photo") > least, F.sequence(F.lit(least), F.length("photo") - 1)).otherwise(F.array().cast("array<int>"))).alias("n"))
    begun = rest.select("photo", "n", F.expr("substring(photo, 1, n)").alias("key")).join(s, "key").groupBy("photo").agg(F.max_by("sidecar", F.struct("n", "sidecar")).alias("sidecar"))
    return exact.unionByName(begun)


def tool_events(spark: SparkSession, path: str) -> DataFrame:
    """(kind, action, owner, repo, number): issues and pull requests opened or merged, from one JSON event a line.

    What was done is read from the command itself or from the tool's name, never from words of a title; the number from the response,
    else, for a merge, from the command. Events whose response tells of an error, and others, give no row.
    """
    e = spark.read.schema("tool_name string, tool_input string, tool_response string").json(path)
    command = F.coalesce(F.get_json_object("tool_input", "$.command"), F.lit(""))
    part = lambda c, p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    verb, what = F.coalesce(part(command, COMMAND, 2), part(F.col("tool_name"), TOOL, 1)), F.coalesce(part(command, COMMAND, 1), part(F.col("tool_name"), TOOL, 2))
    response = F.coalesce(F.col("tool_response"), F.lit(""))
    failed = F.coalesce(F.get_json_object("tool_response", "$.is_error") == "true", F.lit(False)) | F.coalesce(F.get_json_object("tool_response", "$.interrupted") == "true", F.lit(False)) | F.coalesce(F.get_json_object("tool_response", "$.exit_code").try_cast("int") != 0, F.lit(False))
    where = F.when(response.rlike(LINK) | response.rlike(SHORT), response).when(verb == "merge", F.concat_ws(" ", command, "tool_input"))
    out = e.select(
        F.when(what == "issue", "issue").otherwise("pull").alias("kind"), F.when(verb == "merge", "merge").otherwise("open").alias("action"),
        F.coalesce(part(where, LINK, 1), part(where, SHORT, 1)).alias("owner"), F.coalesce(part(where, LINK, 2), part(where, SHORT, 2)).alias("repo"),
        F.coalesce(part(where, LINK, 4), part(where, SHORT, 3)).cast("long").alias("number"), verb.alias("verb"), failed.alias("failed"),
    )
    return out.filter("verb IS NOT NULL AND NOT failed AND number IS NOT NULL").drop("verb", "failed")


def takeout_roots(files: DataFrame) -> DataFrame:
    """(root, sidecars, media): folders with `Takeout` in their path, or with photos beside JSON sidecars of theirs, from (path)."""
    p = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("root"), F.lower("path").alias("path"))
    counts = p.groupBy("root").agg(F.sum(F.col("path").rlike(r"[.](jpe?g|heic|png|mp4|mov)[.][^/]*json$|[.](jpe?g|heic|png|mp4|mov)[.]json$").cast("int")).alias("sidecars"), F.sum(F.col("path").rlike(r"[.](jpe?g|heic|png|mp4|mov)$").cast("int")).alias("media"))
    return counts.filter(F.lower("root").rlike("(^|/)takeout(/|$)") | ((F.col("sidecars") > 0) & (F.col("media") > 0)))


#: Characters of a session's end that its text keeps.
TAIL = 16_000


def transcripts(spark: SparkSession, path: str, tail: int = TAIL) -> DataFrame:
    """(session, turns, user_turns, text): sessions of one JSON message a line (session, turn, role, text), in the order of their turns,
    with the role before each, as the last `tail` characters. Messages without text aren't counted, repeated turns count once, and
    sessions without a turn of the user give none.

    A session's turns are reduced to the newest that fill the tail before they are put together, so a session of any length fits.
    """
    m = spark.read.schema("session string, turn long, role string, text string").json(path).filter("session IS NOT NULL AND trim(text) <> ''")
    m = m.groupBy("session", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("session", "turn", "m.role", F.concat_ws(": ", "m.role", F.col("m.text")).alias("line"))
    counts = m.groupBy("session").agg(F.count("*").alias("turns"), F.sum((F.col("role") == "user").cast("int")).alias("user_turns")).filter("user_turns > 0")
    after = F.sum(F.length("line") + 1).over(W.partitionBy("session").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1))
    kept = m.withColumn("after", F.coalesce(after, F.lit(0))).filter(F.col("after") < tail)
    text = kept.groupBy("session").agg(F.right(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.right("line", F.lit(tail)).alias("line")))), lambda x: x["line"]), "\n"), F.lit(tail)).alias("text"))
    return counts.join(text, "session")


def read_gazetteer(spark: SparkSession, path: str, states: dict[str, str]) -> DataFrame:
    """(name, region, country, latitude, longitude) from a tab-separated dump; lines with bad coordinates are left out; regions of US
    places as state names."""
    names = F.create_map(*(F.lit(x) for kv in states.items() for x in kv)) if states else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    g = spark.read.option("sep", "\t").option("quote", "").schema(", ".join(f"c{i} string" for i in range(19))).csv(path)
    out = g.select(F.col("c1").alias("name"), F.when(F.col("c8") == "US", names[F.col("c10")]).alias("region"), F.col("c8").alias("country"), F.col("c4").try_cast("double").alias("latitude"), F.col("c5").try_cast("double").alias("longitude"))
    return out.filter(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & (F.col("name") != ""))


PAYLOAD = "source string, source_id string, type string, text_repr string, occurred_at string, content_hash string, latitude double, longitude double, place_label string, raw_path string, extra string, entity_hints string"
KNOWN = [f.split()[0] for f in PAYLOAD.split(", ")]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON batches ({"artifacts": [...]}, one batch a line), each judged alone: the payload's fields, its place in the batch,
    and `error` for unknown keys, missing fields and unknown types."""
    raw = spark.read.text(path).select(F.posexplode(F.from_json(F.get_json_object("value", "$.artifacts"), "array<string>")).alias("item", "json"))
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    p = raw.withColumn("p", F.from_json("json", PAYLOAD)).select("item", keys.alias("keys"), "p.*")
    missing = F.coalesce(F.trim("source") == "", F.lit(True)) | F.coalesce(F.trim("text_repr") == "", F.lit(True)) | F.coalesce(F.trim("source_id") == "", F.lit(True))
    kind = F.col("type").isin(list(model.TYPES)) | F.coalesce(F.col("type").rlike("^x-[a-z0-9-]+$"), F.lit(False))
    error = F.when(F.size(F.array_except("keys", F.array(*map(F.lit, KNOWN)))) > 0, "unknown key").when(missing, "missing field").when(~F.coalesce(kind, F.lit(False)), "unknown type")
    return p.withColumn("error", error).drop("keys")
