"""vCard files, one row a card, taken apart with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mnemark.functions import scalars as S
from mnemark.operators import graph


def _unescape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([,;:\\])", "$1")


def _all(name: str) -> Column:
    return F.transform(F.regexp_extract_all("card", F.lit(rf"(?im)^(?:[\w-]+\.)?{name}(?:;[^:\n]*)?:(.*)$"), F.lit(1)), lambda x: F.trim(_unescape(x)))


def _addresses() -> Column:
    """Each ADR as its parts that aren't empty, in their order, joined by commas."""
    parts = lambda x: F.array_join(F.filter(F.transform(F.split(x, ";"), F.trim), lambda p: p != ""), ", ")
    return F.array_distinct(F.filter(F.transform(_all("ADR"), parts), lambda a: a != ""))


def _related() -> Column:
    """(name, label) of each relation: RELATED with its type, or a grouped name with the label of its group, bare of decoration."""
    found = F.regexp_extract_all("card", F.lit(r"(?im)^(?:RELATED;[^:\n]*TYPE=[^:\n]*:.*|[\w-]+\.X-ABRELATEDNAMES[^:\n]*:.*)$"), F.lit(0))

    def one(line: Column) -> Column:
        group = F.regexp_extract(line, r"^([\w-]+)\.", 1)
        label = F.try_element_at(F.regexp_extract_all("card", F.concat(F.lit(r"(?im)^\Q"), group, F.lit(r"\E\.X-ABLABEL:(?:_\$!<)?([^>\n]*)")), F.lit(1)), F.lit(1))
        return F.struct(F.trim(_unescape(F.regexp_replace(line, r"^[^:]*:", ""))).alias("name"), F.trim(F.when(group != "", label).otherwise(F.lower(F.regexp_extract(line, r"(?i)TYPE=\"?([\w-]+)", 1)))).alias("label"))

    return F.filter(F.transform(found, one), lambda r: (r["name"] != "") & (r["label"] != ""))


def unchanged(cards: DataFrame, known: DataFrame) -> DataFrame:
    """Cards whose text isn't among `known` (content_hash): the others were taken in before."""
    return cards.join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def relation_hints(cards: DataFrame, artifact_id: str = "artifact_id") -> DataFrame:
    """(artifact_id, name, label) of the cards' relations, for graph.staged_relations."""
    return cards.select(F.col(artifact_id).alias("artifact_id"), F.explode("related").alias("r")).select("artifact_id", "r.name", "r.label")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """(uid, fn, given, family, nicknames, emails, phones, org, kind, birthday, addresses, related (name, label), content_hash): files are split at the cards' ends by the reader, so a
    large address book is read in parts. Folded lines are joined; grouped and labelled properties count; cards without FN keep null."""
    text = spark.read.option("lineSep", "END:VCARD").text(path)
    cards = text.filter(F.col("value").rlike("(?i)BEGIN:VCARD")).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n[ \t]", "").alias("card"))
    first = lambda n: F.nullif(F.try_element_at(_all(n), F.lit(1)), F.lit(""))
    n = F.split(first("N"), ";")
    company = F.coalesce(F.lower(first("KIND")) == "org", F.lit(False)) | F.coalesce(F.upper(first("X-ABSHOWAS")) == "COMPANY", F.lit(False))
    return cards.select(first("UID").alias("uid"), first("FN").alias("fn"), F.try_element_at(n, F.lit(2)).alias("given"), F.try_element_at(n, F.lit(1)).alias("family"), F.split(first("NICKNAME"), ",").alias("nicknames"), F.array_distinct(_all("EMAIL")).alias("emails"), F.array_distinct(_all("TEL")).alias("phones"), F.split(first("ORG"), ";")[0].alias("org"), F.when(company, "org").otherwise("person").alias("kind"), first("BDAY").alias("birthday"), _addresses().alias("addresses"), _related().alias("related"), F.sha2("card", 256).alias("content_hash"))


def match(cards: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cards with entity_id: the entity of any of their emails, else of their whole name, never of a phone; smallest id; null for new."""
    c = cards.withColumn("_card", F.xxhash64(F.coalesce("uid", F.lit("")), F.coalesce("fn", F.lit("")), F.array_join("emails", ","), F.array_join("phones", ",")))
    a = graph.normal_aliases(aliases)
    by = lambda kind: a.filter(F.col("alias_type") == kind).select("alias", "entity_id")
    mails = c.select("_card", F.explode("emails").alias("e")).select("_card", S.norm_name(F.col("e")).alias("alias")).join(by("email"), "alias").groupBy("_card").agg(F.min("entity_id").alias("_by_mail"))
    names = c.select("_card", S.norm_name(F.col("fn")).alias("alias")).join(by("name"), "alias").groupBy("_card").agg(F.min("entity_id").alias("_by_name"))
    return c.join(mails, "_card", "left").join(names, "_card", "left").withColumn("entity_id", F.coalesce("_by_mail", "_by_name")).drop("_card", "_by_mail", "_by_name")
