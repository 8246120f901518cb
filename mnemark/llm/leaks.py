"""Evaluation texts in training text: winnowed fingerprints of both sides, joined, and their hits extended."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from mnemark.session import broadcast_if_small, cut

K, WINDOW = 5, 2  # words per k-gram; k-grams per window: every shared span of K + WINDOW - 1 words has a shared fingerprint
LEAST_SHARE = 0.45  # of an item's words, half of them less the words that were changed at the edges
LEAST_OWN = 0.2  # of an item's words, found outside of stock instructions
STOCK_WORDS, STOCK_ITEMS = 30, 3  # a stock instruction has at most so many words, and stands in at least so many different items
RARE, LEAST_RARE = 3, 0.5  # fingerprints of instructions in more items than RARE find nothing, unless an item has fewer others than this share
PIECES_APART = 60  # words of the document between two pieces of one passage
INSIDE_GAP = 4  # words that may be changed, left out or added between two runs
BROADCAST_FINGERPRINTS = 500_000
TAG, BREAK, WORD = re.compile(r"</?[a-zA-Z][^<>]{0,200}>"), re.compile(r"(?<=\w)[-‐\xad]\s*\n\s*(?=\w)|\xad|[​-‍﻿]"), re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without markup, case and punctuation; words broken over lines are joined."""
    if "<" in text or "&" in text:
        text = TAG.sub(" ", html.unescape(text))
    if not text.isascii() or "\n" in text:
        text = BREAK.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.casefold())


def kgrams(w: list[str]) -> np.ndarray:
    grams = [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]
    return np.array([int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for g in grams], dtype=np.int64)


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the rightmost least hash of each window of WINDOW hashes."""
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.empty(0, dtype=np.int64)
    v = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(v)) + WINDOW - 1 - np.argmin(v, axis=1))


def fingerprints(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, hash) of each text's winnowed k-grams; null texts and texts under K words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pos, hashes = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = kgrams(words(t))
                p = winnow(h)
                ids.append(np.full(len(p), i, dtype=np.int64)), pos.append(p), hashes.append(h[p])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in ((ids, np.int64), (pos, np.int32), (hashes, np.int64))], names=["id", "pos", "hash"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "id long, pos int, hash long")


def extend(doc: list[str], item: list[str], at: list[int], own: np.ndarray) -> tuple[float, float]:
    """Largest share of the item's words, and of its own words among all, that the document has in order around one cluster of hits."""
    n, best = len(item), (0.0, 0.0)
    at = sorted(at)
    clusters, first = [], 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] - at[k - 1] > n + PIECES_APART:
            clusters.append((at[first], at[k - 1]))
            first = k
    for a, b in clusters:
        part = doc[max(0, a - n - PIECES_APART) : b + n + PIECES_APART + K]
        blocks = [m for m in SequenceMatcher(None, item, part, autojunk=False).get_matching_blocks() if m.size]
        there, last = np.zeros(n, dtype=bool), None
        for m in blocks:
            close = last is not None and m.a - (last.a + last.size) <= INSIDE_GAP and m.b - (last.b + last.size) <= INSIDE_GAP
            if m.size >= 3 or close:
                there[(last.a + last.size if close else m.a) : m.a + m.size] = True
                last = m
        best = max(best, (there.mean(), (there & own).mean()))
    return best


def leaked(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, share): documents with at least LEAST_SHARE of an item's words in order, as one passage or two pieces close
    together, of which LEAST_OWN aren't stock instructions: spans of at most STOCK_WORDS words in STOCK_ITEMS or more different items.

    Items of the same words are looked for once, and all of them are reported. Null and empty texts and null ids on either side have no
    leaks; texts are read whole; repeated rows of one id count as one. The items' fingerprints are counted, and sent to all executors
    only up to BROADCAST_FINGERPRINTS; the documents' never leave their tasks but for those that an item shares.
    """
    spark = docs.sparkSession
    members = cut(_classes(items, item_id, item_text))
    item_rows = members.filter("item = class").select("item", "item_text")
    stock = cut(_stock_positions(item_rows))
    mine = cut(fingerprints(item_rows, "item", "item_text").select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "hash"))
    shared = mine.groupBy("hash").agg(F.countDistinct("item").alias("n"))
    # An instruction alone is no case, and the items' other words find the passage, where there are enough of them.
    inside = F.coalesce(F.forall(F.sequence("item_pos", F.col("item_pos") + K - 1), lambda p: F.array_contains("stock_at", p)), F.lit(False))
    told = cut(mine.join(shared, "hash").join(stock, "item", "left").select("item", "hash", (inside & (F.col("n") > RARE)).alias("common")))
    few = told.groupBy("item").agg((F.avg((~F.col("common")).cast("double")) < LEAST_RARE).alias("few"))
    keys = cut(told.join(few, "item").filter(~F.col("common") | F.col("few")).select("hash", "item").distinct())
    hits = fingerprints(docs, doc_id, doc_text).join(broadcast_if_small(keys, keys.count(), BROADCAST_FINGERPRINTS), "hash")
    hits = cut(hits.groupBy("id", "item").agg(F.sort_array(F.collect_set("pos")).alias("at")))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).filter(F.col("text").isNotNull())
    wanted = hits.select("id").distinct()
    texts = texts.join(wanted, "id", "left_semi")
    pairs = hits.join(texts.dropDuplicates(["id"]), "id").join(item_rows, "item").join(stock, "item", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, i, at, t, x, c in b[["id", "item", "at", "text", "item_text", "stock_at"]].itertuples(index=False, name=None):
                w = words(x)
                own = np.ones(len(w), dtype=bool)
                if c is not None:
                    own[[p for p in c if p < len(w)]] = False
                share, mine_share = extend(words(t), w, list(at), own)
                if share >= LEAST_SHARE and mine_share >= LEAST_OWN:
                    out.append((d, i, share))
            yield pd.DataFrame(out, columns=["doc_id", "class", "share"]).astype({"doc_id": "int64", "class": "int64", "share": "float64"})

    found = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "item").mapInPandas(run, "doc_id long, class long, share double")
    return found.join(members.select("class", F.col("item").alias("item_id")), "class").select("doc_id", "item_id", "share")


def _classes(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, class, item_text): each item once, with the smallest id of the items that have the same words in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [hashlib.blake2b(" ".join(words(t)).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.string())], names=["item", "item_text", "same"])

    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("item_text")).filter("item IS NOT NULL AND item_text IS NOT NULL")
    rows = cut(rows.groupBy("item").agg(F.min("item_text").alias("item_text")).mapInArrow(run, "item long, item_text string, same string"))
    return rows.join(rows.groupBy("same").agg(F.min("item").alias("class")), "same").select("item", "class", "item_text")


def _stock_positions(items: DataFrame) -> DataFrame:
    """(item, stock_at): word positions of an item inside stock instructions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p, int(h)) for i, t in b.itertuples(index=False, name=None) for p, h in enumerate(kgrams(words(t)))]
            yield pd.DataFrame(rows, columns=["item", "pos", "hash"]).astype("int64")

    grams = items.select("item", F.col("item_text").alias("text")).mapInPandas(run, "item long, pos long, hash long")
    several = grams.groupBy("hash").agg(F.countDistinct("item").alias("n")).filter(F.col("n") >= STOCK_ITEMS).select("hash")
    at = grams.join(several, "hash").select("item", F.explode(F.sequence("pos", F.col("pos") + K - 1)).alias("p")).distinct()
    # Positions without a gap have one difference from their rank.
    at = at.withColumn("span", F.col("p") - F.row_number().over(W.partitionBy("item").orderBy("p")))
    short = at.groupBy("item", "span").agg(F.collect_list("p").alias("ps")).filter(F.size("ps") <= STOCK_WORDS)
    return short.groupBy("item").agg(F.sort_array(F.flatten(F.collect_list("ps"))).alias("stock_at"))
