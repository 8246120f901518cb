"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts with map-side combining."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mnemark.session import cut, join_hot

NOT_LETTERS = re.compile(r"[\W_]+")
BREAKS = re.compile(r'[;|\n]|(?<="),')
FIELD = re.compile(r'[\W_]*([^\W\d]\w*)["\s]*[:=](.*)', re.S)
LEAST_FIELDS = 3


def letters(text: str) -> str:
    """Letters and digits alone, in compatibility form and without case."""
    return NOT_LETTERS.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


def json_fields(text: str) -> list[str]:
    """Names and values of a text that is one JSON object of two fields or more; fields named twice count twice."""
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        return []
    try:
        pairs = json.loads(body, object_pairs_hook=list)
    except (ValueError, RecursionError):
        return []
    if not isinstance(pairs, list) or len(pairs) < 2:
        return []
    return [f"{letters(k)}\x1e{letters(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))}" for k, v in pairs]


def canonical(text: str) -> str:
    """Equal for texts that differ only in form. A record becomes its sorted fields: a JSON object of two fields or more, whatever their
    values, or three or more `name: value` parts and nothing else, divided by ; | or line ends. Any other text becomes its letters and
    digits in sequence."""
    if ":" in text or "=" in text:
        if fields := json_fields(text):
            return "\x1f".join(sorted(fields))
        body = text.strip().strip("{}")
        fields = []
        for part in BREAKS.split(body):
            if part.strip(' "\t,\xa0'):
                m = FIELD.fullmatch(part)
                if not m:
                    break
                fields.append(f"{letters(m[1])}\x1e{letters(m[2])}")
        else:
            if len(fields) >= LEAST_FIELDS:
                return "\x1f".join(sorted(fields))
    return letters(text)


def keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key): key = 128-bit hash of the canonical form and a 64-bit check (its length and checksum). Null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for t in b.column(1).to_pylist():
                c = canonical(t).encode("utf-8", "surrogatepass")
                keys.append(hashlib.blake2b(c, digest_size=16).digest() + len(c).to_bytes(4, "big", signed=False) + zlib.crc32(c).to_bytes(4, "big"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["id", "key"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(run, "id long, key binary")


def copy_groups(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, key; groups: key, first_id, copies, collisions).

    A row per distinct canonical form, with the smallest id and the number of rows. Groups are told apart by hash and check together,
    so two forms with one hash stay two groups; `collisions` counts the groups that share the hash. Empty texts, and texts of
    punctuation alone, are equal to each other. Repeated rows count as often as they stand.
    """
    rows = cut(keyed(df, id_col, text))
    groups = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return rows, groups


def collisions(groups: DataFrame) -> DataFrame:
    """Hashes that more than one canonical form has: expected to be none."""
    return groups.groupBy(F.substring("key", 1, 16).alias("hash")).agg(F.count("*").alias("forms")).filter("forms > 1")


def copy_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(first_id, copy_id): each group's smallest id with each other id of the group. Hot groups are spread over tasks."""
    rows, groups = copy_groups(df, id_col, text)
    some = groups.filter("copies > 1")
    return join_hot(rows.distinct(), some, "key", "copies", F.col("id"), rows.count()).filter("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
