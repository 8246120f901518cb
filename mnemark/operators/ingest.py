"""Taking artifacts in: validation, idempotent folding of waves, and what is already there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mnemark import model
from mnemark.operators import places

MUTABLE = ["type", "occurred_at", "latitude", "longitude", "place_label", "text_repr", "extra_json"]
FIRST = ["content_hash", "raw_path"]


def validate(artifacts: DataFrame) -> DataFrame:
    """Rows with `errors`: names of the fields that a payload may not have so."""
    known = F.col("type").isin(list(model.TYPES)) | F.col("type").rlike("^x-[a-z0-9-]+$")
    bad = {
        "source": F.coalesce(F.trim("source") == "", F.lit(True)),
        "type": ~F.coalesce(known, F.lit(False)),
        "text_repr": F.coalesce(F.trim("text_repr") == "", F.lit(True)),
        "content_hash": F.coalesce(~F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "extra": F.col("extra_json").isNotNull() & F.try_parse_json("extra_json").isNull(),
    }
    return artifacts.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in bad.items()))))


def fold(waves: DataFrame, seq: str = "id") -> DataFrame:
    """One row per (source, source_id): of changing fields the last value that isn't null, of the others the first row's, even null.

    Rows without source_id are rows of their own. A key with a third of all rows is folded in every task before the shuffle.
    """
    key = F.when(F.col("source_id").isNull(), F.col(seq))
    w = waves.withColumn("_own", key)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in MUTABLE]
    return w.groupBy("source", "source_id", "_own").agg(F.min(seq).alias("first_id"), F.count("*").alias("waves"), *last, *(F.min_by(c, seq).alias(c) for c in FIRST)).drop("_own")


#: Arrival numbers that stand in one piece of a key's history.
PIECE = 100_000


def history(waves: DataFrame, seq: str = "id", piece: int = PIECE) -> DataFrame:
    """(source, source_id, seq, changed): the changing fields that a wave gave another value than the folded waves before it.

    A key's waves are cut into pieces of arrival numbers; what the pieces before left is carried over from one row a piece, so a key
    that is delivered again and again is no single task's.
    """
    w = waves.filter("source_id IS NOT NULL").select("source", "source_id", F.col(seq).alias("seq"), *MUTABLE).withColumn("_p", F.floor(F.col("seq") / piece))
    key = ["source", "source_id"]
    left = w.groupBy(*key, "_p").agg(F.count("*").alias("_n"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in MUTABLE))
    pieces = W.partitionBy(*key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    left = left.select(*key, "_p", F.coalesce(F.sum("_n").over(pieces), F.lit(0)).alias("_n"), *(F.last(f"_{c}", ignorenulls=True).over(pieces).alias(f"_{c}") for c in MUTABLE))
    at = W.partitionBy(*key, "_p").orderBy("seq")
    before = at.rowsBetween(W.unboundedPreceding, -1)
    w = w.join(left, [*key, "_p"]).withColumn("_n", F.col("_n") + F.row_number().over(at))
    was = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(f"_{c}"))
    changed = [F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(was(c)), F.lit(c)) for c in MUTABLE]
    out = w.withColumn("changed", F.array_join(F.array_compact(F.array(*changed)), ","))
    return out.filter("_n > 1 AND changed <> ''").select(*key, "seq", "changed")


def labels(waves: DataFrame, gazetteer: DataFrame, seq: str = "id") -> DataFrame:
    """(source, source_id, label, explicit): a key's last place label that isn't empty, else the name of the first of its waves' positions
    that has one (see places.reverse_geocode). Rows without source_id are keys of their own; keys without either give null."""
    said = F.nullif(F.trim("place_label"), F.lit(""))
    geo = places.reverse_geocode(waves.withColumn("id", F.col(seq)), gazetteer).select(F.col("artifact_id").alias("_seq"), F.col("label").alias("_geo"))
    w = waves.select("source", "source_id", F.col(seq).alias("_seq"), said.alias("_said")).join(geo, "_seq", "left").withColumn("_own", F.when(F.col("source_id").isNull(), F.col("_seq")))
    last, first = F.max_by("_said", F.when(F.col("_said").isNotNull(), F.col("_seq"))), F.min_by("_geo", F.when(F.col("_geo").isNotNull(), F.col("_seq")))
    return w.groupBy("source", "source_id", "_own").agg(last.alias("_l"), first.alias("_g")).select("source", "source_id", F.coalesce("_l", "_g").alias("label"), F.col("_l").isNotNull().alias("explicit"))


def outcomes(items: DataFrame, seq: str = "id") -> DataFrame:
    """items (see validate) with `outcome`, a row for each item: failed where it has errors, created for the first sound item of its key
    or one without source_id, updated for the others."""
    judged = validate(items).withColumn("_own", F.coalesce("source_id", F.concat(F.lit("\x00"), F.col(seq).cast("string"))))
    first = judged.filter(F.size("errors") == 0).groupBy("source", "_own").agg(F.min(seq).alias(seq)).select(seq, F.lit(True).alias("_first"))
    out = F.when(F.size("errors") > 0, "failed").when(F.col("_first"), "created").otherwise("updated")
    return judged.join(first, seq, "left").withColumn("outcome", out).drop("_own", "_first")


def existing(asked: DataFrame, artifacts: DataFrame, seq: str = "seq") -> DataFrame:
    """(source, source_id, first): the asked keys that are stored, once each, with the place of their first occurrence."""
    once = asked.filter("source_id IS NOT NULL").groupBy("source", "source_id").agg(F.min(seq).alias("first"))
    return once.join(artifacts.select("source", "source_id").distinct(), ["source", "source_id"], "left_semi")


def audit(waves: DataFrame, seq: str = "id", actor: str = "ingest") -> DataFrame:
    """(seq, event_type, actor, details): a row for each key that a wave made and for each wave that changed it, details as JSON."""
    keyed = waves.filter("source_id IS NOT NULL")
    made = keyed.groupBy("source", "source_id").agg(F.min(seq).alias("seq")).select("seq", F.lit("ingest_create").alias("event_type"), F.to_json(F.struct("source", "source_id")).alias("details"))
    changed = history(waves, seq).select("seq", F.lit("ingest_update").alias("event_type"), F.to_json(F.struct("source", "source_id", "changed")).alias("details"))
    return made.unionByName(changed).select("seq", "event_type", F.lit(actor).alias("actor"), "details")


def blobs(artifacts: DataFrame, content: str, name: str) -> DataFrame:
    """(path, hash, size, copies): content-addressed files, one per distinct content: its SHA-256 and the name's ending in lower case, the
    smallest where copies differ in it. Null content gives none."""
    ending = F.lower(F.regexp_extract(F.col(name), r"\.([A-Za-z0-9]{1,8})$", 1))
    rows = artifacts.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content), 256).alias("hash"), F.length(content).alias("size"), F.coalesce(F.nullif(ending, F.lit("")), F.lit("bin")).alias("e"))
    return rows.groupBy("hash").agg(F.min("size").alias("size"), F.min("e").alias("e"), F.count("*").alias("copies")).select(F.concat_ws(".", "hash", "e").alias("path"), "hash", "size", "copies")


def first_of_each(waves: DataFrame, seq: str = "id") -> DataFrame:
    """Insert where absent: the first row of each key, and every row without one."""
    keyed = waves.filter("source_id IS NOT NULL").groupBy("source", "source_id").agg(F.min(seq).alias("artifact_id")).select("artifact_id")
    return keyed.unionByName(waves.filter("source_id IS NULL").select(F.col(seq).alias("artifact_id")))


def copies_by_hash(artifacts: DataFrame) -> DataFrame:
    """(content_hash, first_id, copies, occurred_at, place_label): byte-identical files in one row, with the first value of each field.
    Hashes are compared in their bare form; the hash of an empty file, and none, aren't copies of anything."""
    bare = F.regexp_extract(F.lower("content_hash"), "([0-9a-f]{64})$", 1)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    rows = artifacts.withColumn("hash", bare).filter((F.col("hash") != "") & (F.col("hash") != empty))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return rows.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), first("occurred_at"), first("place_label")).filter("copies > 1")
