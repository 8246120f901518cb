"""Names beside the handles that a text quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemark import model
from mnemark.functions import scalars as S
from mnemark.operators import graph

# An email: a run of name characters, an at-sign, and labels of letters, digits and hyphens, the last one of letters. A phone: a plus or
# none, and at least seven characters of digits with their points, hyphens and brackets between the first and the last digit.
_LABEL = "[A-Za-z0-9-]+"
EMAIL = rf"[\w.%+-]+@(?:{_LABEL}[.])+[A-Za-z]{{2,}}"
PHONE = r"[+]?[0-9][0-9().-]{5,}[0-9]"
HANDLE = f"(?:{EMAIL})|(?:{PHONE})"


def handle_key(token: Column) -> Column:
    digits = S.norm_phone(token)
    return F.when(token.contains("@"), F.concat(F.lit("email:"), S.norm_name(token))).when(F.length(digits) >= model.PHONE_DIGITS, F.concat(F.lit("phone:"), digits))


def annotated(artifacts: DataFrame, links: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(artifact_id, display_text) of the artifacts whose text gets a name: each handle of exactly one entity linked to the artifact reads
    "Name (handle)". Handles of several linked entities, or of none, stay as they are; the stored text is left alone."""
    text = artifacts.select(F.col("id").alias("artifact_id"), "text_repr", F.regexp_extract_all("text_repr", F.lit(HANDLE), F.lit(0)).alias("tokens")).filter(F.size("tokens") > 0)
    keys = text.select("artifact_id", F.explode(F.array_distinct("tokens")).alias("token")).withColumn("key", handle_key(F.col("token"))).filter("key IS NOT NULL")
    owner = graph.normal_aliases(aliases).filter("alias_type IN ('email', 'phone')").select(F.concat_ws(":", "alias_type", "alias").alias("key"), "entity_id")
    linked = links.select("artifact_id", "entity_id").distinct()
    names = entities.select(F.col("id").alias("entity_id"), "canonical_name")
    one = keys.join(owner, "key").join(linked, ["artifact_id", "entity_id"]).groupBy("artifact_id", "token").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("hi")).filter("entity_id = hi").join(names, "entity_id")
    known = one.groupBy("artifact_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "canonical_name"))).alias("names"))
    said = lambda t: F.when(F.col("names")[t].isNotNull(), F.concat(F.col("names")[t], F.lit(" ("), t, F.lit(")"))).otherwise(t)
    between = F.split("text_repr", HANDLE, -1)
    pieces = F.zip_with(between, F.transform("tokens", said), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return text.join(known, "artifact_id").select("artifact_id", F.array_join(pieces, "").alias("display_text"))
