"""Reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder named by spark.checkpoint.dir; only where that is unset, on one machine, in a folder of its own."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, with cut()'s fallback."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: over several machines lineage is cut in a folder that all of them share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_file(df: DataFrame, name: str, *order: str) -> str:
    """Writes df to the shared folder, for tasks that read it there with read_shared(): what every task needs is then neither copied by a
    shuffle nor sent by the driver. `order`: columns by which each file is sorted."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*order) if order else df).write.parquet(folder)
    return folder


def read_shared(folder: str, rows: int | None = None) -> Iterator[pa.Table]:
    """The files of shared_file(), one after another, whole or in pieces of at most so many rows."""
    files, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")
    for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
        with files.open_input_file(f) as source:
            if rows is None:
                yield pq.read_table(source)
            else:
                yield from (pa.Table.from_batches([b]) for b in pq.ParquetFile(source).iter_batches(rows))


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n keys (int) of which repartition(n, key) puts each into a partition of its own."""
    at = spark.range(30 * n + 100).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("at")).agg(F.min("v").alias("v"))
    return [r["v"] for r in at.orderBy("at").collect()]


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint where the counted rows are at most limit; otherwise the join stays with Spark."""
    return F.broadcast(df) if rows <= limit else df


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, total: int, how: str = "inner", piece: int = 50_000) -> DataFrame:
    """rows joined with groups (one row per key; `size` = rows of that key), without one task getting a hot key.

    Keys with more than max(piece, total/1000) rows are hot: at most 1000 of them exist, so their table may be
    broadcast. Rows of a hot key are spread over size/piece buckets by `spread`, and its group row is repeated for each.
    """
    hot = groups.filter(F.col(size) > max(piece, ceil(total / 1000))).select(F.col(key).alias("_k"), F.ceil(F.col(size) / piece).cast("int").alias("_s"))
    left = rows.join(F.broadcast(hot), rows[key].eqNullSafe(F.col("_k")), "left").withColumn("_b", F.when(F.col("_s").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_s")).cast("int"))).drop("_k", "_s")
    right = groups.join(F.broadcast(hot), groups[key].eqNullSafe(F.col("_k")), "left").withColumn("_b", F.explode(F.when(F.col("_s").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_s") - 1)))).drop("_k", "_s")
    return left.join(right, [key, "_b"], how).drop("_b")
