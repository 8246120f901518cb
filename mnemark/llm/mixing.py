"""Mixing sources to target shares of tokens, by systematic sampling within each source."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemark.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a source are laid out by size class (quarter powers of two), and each class over so many tasks; their counts, at most some
#: hundred times SPLITS rows a source, are prefix-summed first. Along the sizes a systematic sample takes its share of each.
SPLITS = 64


@lru_cache(2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, id_col: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens): size of each whole text in tokens of a public tokenizer; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["id", "source", "tokens"])

    return df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).mapInArrow(run, "id long, source string, tokens long")


def source_key(c: Column) -> Column:
    """A source's name as mix_targets writes it, whatever its case, spaces and hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, rate): expected copies of each document of a source.

    Without total_tokens the mixture is as large as it can be with every target that has documents met exactly: rates follow the
    shares, and the scarcest source reaches its max_repeats. With it, a source whose max_repeats doesn't reach its share gives all it
    may. Targets without documents get rate null; documents of other sources aren't mixed.
    """
    sums = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).filter("tokens > 0")
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    both = t.join(sums, "source", "left")
    total = F.lit(float(total_tokens)) if total_tokens else F.min(F.when(F.col("target_share") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).over(W.partitionBy(F.lit(1)))  # a row per target
    return both.withColumn("rate", F.when(F.col("tokens").isNotNull(), F.least(F.col("max_repeats").cast("double"), total * F.col("target_share") / F.col("tokens"))))


def mixture(sized: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """(id, source, tokens, copies): each source's documents stand in a fixed order by size and hash, their expected copies are prefix-summed, one
    random offset per source is added, and a document is taken once for each integer boundary that its stretch crosses. Documents
    that cross none are left out; none is taken more than max_repeats times."""
    order = F.xxhash64(F.lit(seed), F.col("id"))
    d = sized.join(F.broadcast(plan.filter("rate > 0").select("source", "rate")), "source").withColumn("_h", order).withColumn("_bucket", F.floor(F.log2("tokens") * 4).cast("long") * SPLITS + F.pmod("_h", F.lit(SPLITS)))
    per = d.groupBy("source", "_bucket").agg(F.count("*").alias("n"))
    before = per.withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("source", "_bucket", "_before")
    rank = F.row_number().over(W.partitionBy("source", "_bucket").orderBy("tokens", "_h", "id"))
    d = d.withColumn("_r", rank).join(F.broadcast(before), ["source", "_bucket"])  # bounded, see SPLITS
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    end = (F.col("_before") + F.col("_r")) * F.col("rate") + offset
    start = (F.col("_before") + F.col("_r") - 1) * F.col("rate") + offset
    return d.withColumn("copies", (F.floor(end) - F.floor(start)).cast("int")).filter("copies > 0").select("id", "source", "tokens", "copies")


def mixed(docs: DataFrame, targets: DataFrame, id_col: str, source: str, text: str, total_tokens: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture, and a report with a row per target: (source, target_share, reached_share, docs, tokens, rate, mixed_tokens,
    largest_repeat). A null source, and texts without tokens, aren't mixed."""
    sized = cut(with_tokens(docs.withColumn("_source", source_key(F.col(source))), id_col, "_source", text, tokenizer)).filter("tokens > 0 AND source IS NOT NULL")
    plan = cut(rates(sized, targets, total_tokens))
    mix = cut(mixture(sized, plan, seed))
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("largest_repeat"))
    report = plan.join(got, "source", "left").withColumn("reached_share", F.coalesce("mixed_tokens", F.lit(0)) / F.sum("mixed_tokens").over(W.partitionBy(F.lit(1))))
    return mix, report.select("source", "target_share", "reached_share", "docs", "tokens", "rate", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("largest_repeat", F.lit(0)).alias("largest_repeat"), "max_repeats")
