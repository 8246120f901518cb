"""A chat database (SQLite) as a partitioned source: each partition reads a range of row numbers from the shared folder."""

from __future__ import annotations

import plistlib
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mnemark.functions import scalars as S

ROWS_A_PARTITION = 50_000


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, after: int) -> None:
        self.path, self.after = path, after

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Range]:
        with self._open() as c:
            last = c.execute("SELECT max(ROWID) FROM message").fetchone()[0] or 0
        return [_Range(a, min(a + ROWS_A_PARTITION, last)) for a in range(self.after, last, ROWS_A_PARTITION)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._open() as c:
            yield from c.execute("SELECT m.ROWID, m.guid, m.text, m.attributedBody, h.id, h.service, m.is_from_me, m.date FROM message m LEFT JOIN handle h ON h.ROWID = m.handle_id WHERE m.ROWID > ? AND m.ROWID <= ?", (partition.low, partition.high))


class ChatSource(DataSource):
    """format("chat_db"), options path and after (the last row number already taken)."""

    @classmethod
    def name(cls) -> str:
        return "chat_db"

    def schema(self) -> str:
        return "rowid long, guid string, text string, body binary, handle string, service string, is_from_me int, date long"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"], int(self.options.get("after", "0")))


def longest_text(blob: bytes | None) -> str | None:
    """The longest string with a letter or digit in a binary property list; null for anything else."""
    try:
        objects = plistlib.loads(blob) if blob else None
    except Exception:  # noqa: BLE001
        return None
    best, todo = None, [objects]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += [v for k, v in x.items() if k != "$classes"]
        elif isinstance(x, list | tuple):
            todo += x
        elif isinstance(x, str) and any(ch.isalnum() for ch in x) and not x.startswith(("NS", "$", "__k")) and len(x) > len(best or ""):
            best = x
    return best


def messages(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Artifact payloads of the messages after a row number; messages without any text are left out."""
    spark.dataSource.register(ChatSource)
    raw = spark.read.format("chat_db").option("path", path).option("after", str(after)).load()
    body = F.udf(longest_text, "string")
    text: Column = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.when(F.col("body").isNotNull(), body("body")))
    who = F.coalesce("handle", F.lit("group chat"))
    said = F.concat(F.when(F.col("is_from_me") == 1, "Message to ").otherwise("Message from "), who, F.lit(': "'), F.col("t"), F.lit('"'))
    out = raw.withColumn("t", text).filter("t IS NOT NULL")
    return out.select("rowid", F.lit("message").alias("type"), F.lit("imessage").alias("source"), F.concat(F.lit("chat.db:msg:"), "rowid").alias("source_id"), said.alias("text_repr"), F.timestamp_millis(S.apple_seconds(F.col("date").cast("double"))).alias("occurred"))
