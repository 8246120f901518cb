"""Waves of artifacts as a stream: an append-only log, written once a batch, and its fold."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemark.functions import scalars as S
from mnemark.operators import ingest, search

SCHEMA = "id long, type string, source string, source_id string, content_hash string, occurred_at string, latitude double, longitude double, place_label string, raw_path string, text_repr string, extra_json string"


def waves(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def keep(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Appends sound rows to the log and the others to log_rejected. Each batch has a folder of its own, which a batch that is run again
    writes anew, so every wave stands in the log once."""

    def write(batch: DataFrame, number: int) -> None:
        judged = ingest.validate(batch).withColumn("batch", F.lit(number)).persist(StorageLevel.MEMORY_AND_DISK)
        for rows, folder in ((F.size("errors") == 0, log), (F.size("errors") > 0, f"{log}_rejected")):
            judged.filter(rows).drop("errors").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        judged.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """The fold of all waves so far."""
    return ingest.fold(spark.read.parquet(log))


def digests_to_renew(spark: SparkSession, log: str, known: DataFrame, batches: list[int] | None = None) -> DataFrame:
    """Days whose digest inputs aren't those of `known` (day, input_hash): new days, and days that got rows late. With `batches`, only
    the days that these brought rows for are looked at."""
    rows = spark.read.parquet(log)
    if batches is not None:
        day = S.utc_date(F.col("occurred_at"))
        touched = rows.filter(F.col("batch").isin(batches)).select(day.alias("_day")).distinct()
        rows = rows.withColumn("_day", day).join(touched, "_day", "left_semi").drop("_day")
    return search.digest_inputs(rows).join(known, ["day", "input_hash"], "left_anti")
