"""Retrieval: candidates first, then vector and keyword ranking over the candidates, fused by reciprocal ranks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from mnemark import model
from mnemark.functions import scalars as S, states
from mnemark.operators import graph, spatial
from mnemark.session import broadcast_if_small, cut, read_shared, shared_file, spread_keys


def candidates(artifacts: DataFrame, types: list[str] | None = None, all_types: bool = False, start: str | None = None, end: str | None = None, place: list[str] | None = None, with_place: bool = False, linked_to: DataFrame | None = None) -> DataFrame:
    """Artifacts of the given types (else those searched by default), dates (UTC, both ends in), place patterns, and links.

    Only what is set becomes a predicate. linked_to has a column artifact_id. Null dates and places fail their predicates.
    """
    out = artifacts if all_types else artifacts.filter(F.col("type").isin(types or model.SEARCHABLE))
    if start or end:
        day = S.utc_date(F.col("occurred_at"))
        out = out.filter(day.between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))
    if place:
        hit = F.col("place_label").ilike(place[0])
        for p in place[1:]:
            hit |= F.col("place_label").ilike(p)
        out = out.filter(hit)
    if with_place:
        out = out.filter(F.col("place_label").isNotNull())
    return out if linked_to is None else out.join(linked_to.select(F.col("artifact_id").alias("id")).distinct(), "id", "left_semi")


def recent(cands: DataFrame, limit: int) -> DataFrame:
    """Newest by the text of occurred_at, nulls last, then largest id."""
    return cands.orderBy(F.col("occurred_at").desc_nulls_last(), F.col("id").desc()).limit(limit)


def usable_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(artifact_id, embedding): whole vectors without null or NaN; an artifact may have several rows."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    return vectors.filter((F.size("embedding") == dimensions) & finite).select("artifact_id", "embedding")


def knn(vectors: DataFrame, query: list[float], k: int, cands: DataFrame | None = None) -> DataFrame:
    """(artifact_id, distance): k nearest to one query vector by Euclidean distance, among candidates only, ties by id. An artifact with
    several vectors counts by its nearest. Vectors are filtered and measured where they lie; only ids and distances are shuffled."""
    v = usable_vectors(vectors, len(query))
    if cands is not None:
        v = v.join(cands.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")
    d = v.select("artifact_id", F.round(S.l2(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), 6).alias("distance"))
    return d.groupBy("artifact_id").agg(F.min("distance").alias("distance")).orderBy("distance", "artifact_id").limit(k)


def knn_set(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int, block: int = 1000, slice_rows: int = 50_000) -> DataFrame:
    """(query_id, artifact_id, distance, rank): the k nearest of every query (query_id, embedding), exactly, ties by id.

    Queries stand in blocks and vectors in slices; each block meets each slice in a task of its own, which returns k rows a query, so
    a task holds one block and one slice, whatever the tables' sizes, and of what it measured k rows a query. Null and unusable vectors on either side take no part.
    """
    v, q = usable_vectors(vectors, dimensions), queries.select(F.col("query_id").alias("artifact_id"), "embedding")
    q = usable_vectors(q, dimensions)
    blocks, slices = max(1, -(-q.count() // block)), max(LEAST_SLICES, -(-v.count() // slice_rows))
    part = lambda n: F.pmod(F.xxhash64("artifact_id"), F.lit(n)).cast("int")
    left = q.withColumn("b", part(blocks)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = v.withColumn("s", part(slices)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        if len(a) and len(b):
            b = b.sort_values("artifact_id")
            y = np.stack(b["embedding"]).astype(np.float64)
            ids, first = np.unique(b["artifact_id"].to_numpy(), return_index=True)
            for query, x in zip(a["artifact_id"], a["embedding"]):
                d = np.round(np.sqrt(((y - np.asarray(x, dtype=np.float64)) ** 2).sum(1)), 6)
                d = np.minimum.reduceat(d, first)
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                near = near[np.lexsort((ids[near], d[near]))[:k]]
                out.append((np.full(len(near), query), ids[near], d[near]))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pd.DataFrame({"query_id": cols[0], "artifact_id": cols[1], "distance": cols[2]})

    met = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(nearest, "query_id long, artifact_id long, distance double")
    w = W.partitionBy("query_id").orderBy("distance", "artifact_id")
    return met.groupBy("query_id", "artifact_id").agg(F.min("distance").alias("distance")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Folders into which an index spreads the terms; a query reads those of its terms.
TERM_PARTS = 32
#: Query terms that may be sent to all tasks.
BROADCAST_TERMS = 200_000


def term_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_PARTS)).cast("int")


def postings(artifacts: DataFrame) -> DataFrame:
    """(term, artifact_id, tf, dl): how often each text has each of its terms, and how many terms it has. Null texts aren't counted."""
    docs = artifacts.filter(F.col("text_repr").isNotNull()).select(F.col("id").alias("artifact_id"), S.search_terms(F.col("text_repr")).alias("w"))
    return docs.select("artifact_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "artifact_id", "dl").agg(F.count("*").alias("tf")).select("term", "artifact_id", "tf", "dl")


def index_texts(artifacts: DataFrame, folder: str, batch: int = 0) -> None:
    """Adds new or changed texts to the text index in a shared folder, as one batch, which replaces what earlier batches say of the
    same artifacts; a batch that is run again writes the same folders anew."""
    p = postings(artifacts).withColumn("part", term_part(F.col("term")))
    p.repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings/batch={batch}")
    docs = artifacts.filter(F.col("text_repr").isNotNull()).select(F.col("id").alias("artifact_id"), F.size(S.search_terms(F.col("text_repr"))).alias("dl"))
    docs.write.mode("overwrite").parquet(f"{folder}/docs/batch={batch}")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, docs) of an index: of each artifact the rows of its last batch."""
    p = spark.read.schema("term string, artifact_id long, tf long, dl int, batch int, part int").parquet(f"{folder}/postings")
    d = spark.read.schema("artifact_id long, dl int, batch int").parquet(f"{folder}/docs")
    if len({f.split("/batch=")[1].split("/")[0] for f in d.inputFiles()}) > 1:
        last = d.groupBy("artifact_id").agg(F.max("batch").alias("batch"), F.max_by("dl", "batch").alias("dl"))
        p, d = p.join(last.select("artifact_id", "batch"), ["artifact_id", "batch"], "left_semi"), last
    return p, d.select("artifact_id", "dl")


def live_index(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, docs) of a table without an index."""
    p = postings(artifacts).withColumn("part", term_part(F.col("term")))
    return p, artifacts.filter(F.col("text_repr").isNotNull()).select(F.col("id").alias("artifact_id"), F.size(S.search_terms(F.col("text_repr"))).alias("dl"))


def _weight(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (model.BM25_K1 + 1) / (tf + model.BM25_K1 * (1 - model.BM25_B + model.BM25_B * dl / avgdl))


def bm25(index: tuple[DataFrame, DataFrame], query: str, k: int, cands: DataFrame | None = None) -> DataFrame:
    """(artifact_id, score): best k by BM25 over an index (see read_index, live_index), of which only the query's terms are read. Counts
    are over all texts, candidates only filter. A repeated query term counts twice."""
    p, docs = index
    spark = docs.sparkSession
    said = spark.range(1).select(F.explode(S.search_terms(F.lit(query))).alias("t")).select("t", term_part(F.col("t")).alias("part")).collect()
    if not said:
        return docs.select("artifact_id", F.lit(0.0).alias("score")).limit(0)
    terms = [r["t"] for r in said]
    one, parts = sorted(set(terms)), sorted({r["part"] for r in said})
    hits = p.filter(F.col("part").isin(parts) & F.col("term").isin(one))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}  # a row per query term
    if not df:
        return docs.select("artifact_id", F.lit(0.0).alias("score")).limit(0)
    value = lambda f: F.element_at(F.create_map(*(F.lit(x) for t in df for x in (t, float(f(t))))), F.col("term"))
    if cands is not None:
        hits = hits.join(cands.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")
    score = value(terms.count) * _weight(F.lit(float(stats["n"])), value(df.get), F.col("tf"), F.col("dl"), F.lit(float(stats["avgdl"] or 1.0)))
    return hits.groupBy("artifact_id").agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), "artifact_id").limit(k)


class Postings:
    """The weighted postings of a slice of artifacts, by term, for whole query sets."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Rows of one artifact and term are added up."""
        self.ids, doc = np.unique(ids, return_inverse=True)
        order = np.lexsort((doc, terms))
        doc, terms, weights = doc[order], terms[order], weights[order]
        first = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        self.doc, terms, self.weight = doc[first], terms[first], np.add.reduceat(weights, first) if len(first) else weights
        self.terms, self.start = np.unique(terms, return_index=True)
        self.end = np.append(self.start[1:], len(terms))
        self.most = np.maximum.reduceat(self.weight, self.start) if len(terms) else self.weight
        self.sums = np.zeros(len(self.ids))

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for a query's distinct terms, exactly, ties by id.

        Terms are added in the order of the most that they can give. Once what is left can't lift an artifact over the k-th best so
        far, only those that may still reach it are followed through the other terms.
        """
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        at, times = at[known], times[known]
        if not len(at):
            return self.ids[:0], self.sums[:0]
        order = np.argsort(-times * self.most[at], kind="stable")
        at, times = at[order], times[order]
        left = np.append(np.cumsum((times * self.most[at])[::-1])[::-1][1:], 0.0)
        most = left[0] + times[0] * self.most[at[0]]
        sums, least, n = self.sums, 0.0, 0
        sums[:] = 0
        for n, (a, by, rest) in enumerate(zip(at.tolist(), times.tolist(), left.tolist()), 1):
            s, e = self.start[a], self.end[a]
            docs = self.doc[s:e]
            np.add.at(sums, docs, self.weight[s:e] * by)
            if 2 * rest < most and k <= e - s <= CHECKED:  # before, no sum can be more than what is left
                least = max(least, np.partition(sums[docs], e - s - k)[e - s - k])
            if rest < least - MARGIN:
                break
        rest = left[n - 1]
        docs = np.flatnonzero(sums > max(0.0, least - rest - MARGIN))
        score = np.zeros(len(docs))
        for a, by in zip(at[n:].tolist(), times[n:].tolist()):
            s, e = self.start[a], self.end[a]
            own = self.doc[s:e]
            if 30 * len(docs) > e - s:  # a search costs some thirty additions
                np.add.at(sums, own, self.weight[s:e] * by)
                continue
            i = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            score += np.where(own[i] == docs, self.weight[s + i] * by, 0.0)
        score += sums[docs]
        if len(docs) > k:
            near = score >= np.partition(score, len(docs) - k)[len(docs) - k] - MARGIN
            docs, score = docs[near], score[near]
        score = np.round(score, 6)
        top = np.lexsort((docs, -score))[:k]
        return self.ids[docs[top]], score[top]


#: Postings in a slice, and least number of slices.
SLICE_POSTINGS, LEAST_SLICES = 1_500_000, 12
#: Queries in a file of a query set.
FILE_QUERIES = 20_000
#: Longest postings from which Postings.best takes a bound, and more than rounding to six places may shift a score by.
CHECKED, MARGIN = 8192, 2e-6


def bm25_set(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, cands: DataFrame | None = None, salt: int = 16, slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """(query_id, artifact_id, score, rank): best k by BM25 of every query (query_id, text), ties by id; see bm25.

    The index's artifacts stand in slices of about slice_postings postings, each in a task of its own that walks the queries file by file
    and returns k rows a query; pairs of queries and artifacts aren't made. Query terms are counted and sent to all tasks up to
    BROADCAST_TERMS; beyond that the postings of a term are spread over `salt` tasks, so a word that a third of all texts have isn't
    one task's.
    """
    p, docs = index
    asked = cut(queries.select("query_id", F.explode(S.search_terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    said = asked.select("term").distinct()
    rows, key = said.count(), ["term"]
    terms = cut(p.join(broadcast_if_small(said, rows, BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).withColumn("t", F.monotonically_increasing_id()))
    numbered = asked.join(broadcast_if_small(terms, rows, BROADCAST_TERMS), "term").select("query_id", "t", F.col("times").cast("double").alias("times"))
    files = max(1, -(-queries.count() // FILE_QUERIES))
    folder = shared_file(numbered.repartition(files, "query_id"), "asked", "query_id")
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    slices = max(LEAST_SLICES, -(-(terms.agg(F.sum("df")).first()[0] or 0) // slice_postings))
    if rows > BROADCAST_TERMS:
        p = p.withColumn("salt", F.pmod(F.xxhash64("artifact_id"), F.lit(salt)).cast("int"))
        terms, key = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))), ["term", "salt"]
    weight = _weight(F.lit(float(stats["n"])), F.col("df"), F.col("tf"), F.col("dl"), F.lit(float(stats["avgdl"] or 1.0)))
    hits = p.join(broadcast_if_small(terms, rows, BROADCAST_TERMS), key).select("artifact_id", "t", weight.alias("w"))
    if cands is not None:  # told by a row without a term, so that no join has all postings
        hits = hits.unionByName(cands.select(F.col("id").alias("artifact_id"), F.lit(-1).cast("long").alias("t"), F.lit(0.0).alias("w")))
    filtered = cands is not None

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, t, w = g["artifact_id"].to_numpy(), g["t"].to_numpy(), g["w"].to_numpy()
        own = t >= 0
        if filtered:
            own &= np.isin(ids, ids[~own])
        found = Postings(ids[own], t[own], w[own])
        out: list[tuple] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for part in read_shared(folder):
            q, qt, times = (part.column(c).to_numpy() for c in ("query_id", "t", "times"))
            cuts = np.flatnonzero(np.diff(q, prepend=q[:1] - 1))
            for s, e in zip(cuts, [*cuts[1:], len(q)]):
                i, score = found.best(qt[s:e], times[s:e], k)
                out.append((np.full(len(i), q[s]), i, score))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pd.DataFrame({"query_id": cols[0], "artifact_id": cols[1], "score": cols[2]})

    sliced = hits.filter("artifact_id IS NOT NULL").withColumn("s", F.element_at(F.lit(spread_keys(docs.sparkSession, slices)), F.pmod(F.xxhash64("artifact_id"), F.lit(slices)).cast("int") + 1))
    found = sliced.repartition(slices, "s").groupBy("s").applyInPandas(run, "query_id long, artifact_id long, score double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "artifact_id"))).filter(F.col("rank") <= k)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int) -> DataFrame:
    """(artifact_id, score, vector_rank, keyword_rank): sum of 1 / (60 + rank) over the arms; ties as the vector arm, then the keyword
    arm, has them. Both arms are already cut to their k."""
    v = vector_hits.select("artifact_id", F.row_number().over(W.orderBy("distance", "artifact_id")).alias("vector_rank"))
    w = keyword_hits.select("artifact_id", F.row_number().over(W.orderBy(F.desc("score"), "artifact_id")).alias("keyword_rank"))
    part = lambda c: F.coalesce(1 / (model.RRF_K + F.col(c)), F.lit(0.0))
    both = v.join(w, "artifact_id", "full").withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 9))
    return both.orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank")).limit(limit)


def fuse_set(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int) -> DataFrame:
    """(query_id, artifact_id, score, rank): fuse() for each query of two ranked lists with query_id, artifact_id and rank."""
    v, w = vector_hits.select("query_id", "artifact_id", F.col("rank").alias("vr")), keyword_hits.select("query_id", "artifact_id", F.col("rank").alias("kr"))
    part = lambda c: F.coalesce(1 / (model.RRF_K + F.col(c)), F.lit(0.0))
    both = v.join(w, ["query_id", "artifact_id"], "full").withColumn("score", F.round(part("vr") + part("kr"), 9))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vr"), F.asc_nulls_last("kr"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "artifact_id", "score", "rank")


@dataclass
class Query:
    """A search: text, and filters that are used only where they are set. near is (latitude, longitude)."""

    text: str = ""
    limit: int = 3
    types: list[str] | None = None
    start: str | None = None
    end: str | None = None
    entities: list[str] | None = None
    place: str | None = None
    near: tuple[float, float] | None = None
    radius_km: float | None = None
    geo_required: bool = False
    sort: str = "relevance"


def named(query: Query, aliases: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """Entities (entity_id) of a query's terms, by a whole alias or else by a beginning that only one entity has; and the terms that
    name none. Without any entity there is no filter."""
    if not query.entities:
        return None, []
    terms = aliases.sparkSession.createDataFrame([(t,) for t in query.entities], "term string")
    whole = graph.resolve(terms, aliases)
    found = cut(whole.unionByName(graph.resolve_prefix(terms.join(whole.select("term").distinct(), "term", "left_anti"), aliases)))
    known = {r[0] for r in found.select("term").distinct().collect()}  # of the query's own terms
    return (found.select("entity_id").distinct() if known else None), [t for t in query.entities if t not in known]


def within_km(artifacts: DataFrame, near: tuple[float, float] | None, radius_km: float | None) -> DataFrame | None:
    """Ids of the artifacts around a centre, at 0 to MOST_RADIUS_KM; None, which is no filter, for a centre that isn't on earth. A box of
    coordinates, which the scan can skip by, goes before the distance; where it reaches a pole or the date line it has all longitudes."""
    if near is None or not (-90 <= near[0] <= 90 and -180 <= near[1] <= 180):
        return None
    km = min(max(model.RADIUS_KM if radius_km is None else radius_km, 0.0), model.MOST_RADIUS_KM)
    lat, lon = near
    high = km / spatial.KM_PER_DEGREE * 1.000001 + 1e-9
    box = F.col("latitude").between(lat - high, lat + high)
    if abs(lat) + high < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(high)) / math.cos(math.radians(lat))))) * 1.000001 + 1e-9
        if -180 < lon - wide and lon + wide < 180:
            box &= F.col("longitude").between(lon - wide, lon + wide)
    far = spatial.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(float(lat)), F.lit(float(lon)))
    return artifacts.filter(spatial.valid_position(F.col("latitude"), F.col("longitude")) & box).filter(far <= km).select("id")


def found(artifacts: DataFrame, links: DataFrame, aliases: DataFrame, query: Query) -> tuple[DataFrame, str, str]:
    """Candidates of a query, the text that they are ranked by, and the order.

    Terms that name no entity, and a place that no artifact has, become text. Without candidates the query is tried again with its
    types, dates, entities and need of a place alone; where it had none of these and no centre, these are the types searched by
    default, by relevance.
    """
    ids, unknown = named(query, aliases)
    places = states.place_patterns(query.place) if query.place else None
    lost = places is not None and candidates(artifacts, all_types=True, place=places).limit(1).count() == 0
    text = " ".join(t for t in (query.text, *unknown, query.place if lost else "") if t)
    linked = None if ids is None else links.join(ids, "entity_id", "left_semi")
    own = {"types": query.types, "start": query.start, "end": query.end, "with_place": query.geo_required}
    around = within_km(artifacts, query.near, query.radius_km)
    cands = candidates(artifacts, place=None if lost else places, linked_to=linked, **own)
    cands = cands if around is None else cands.join(around, "id", "left_semi")
    if cands.limit(1).count():
        return cands, text, query.sort
    filtered = any(own.values()) or linked is not None or around is not None
    return candidates(artifacts, linked_to=linked, **own), text, query.sort if filtered else "relevance"


def hybrid(artifacts: DataFrame, vectors: DataFrame, index: tuple[DataFrame, DataFrame], query: str, vector: list[float] | None, limit: int = 3, cands: DataFrame | None = None) -> DataFrame:
    """(artifact_id, score, vector_rank, keyword_rank): both arms over the candidates (else the types searched by default), fused. Without
    a query vector the keyword arm stands alone."""
    k = model.fetch_size(limit)
    cands = candidates(artifacts) if cands is None else cands
    words = bm25(index, query, k, cands)
    near = knn(vectors, vector, k, cands) if vector else words.select("artifact_id", F.lit(0.0).alias("distance")).limit(0)
    return fuse(near, words, limit)


def search(artifacts: DataFrame, vectors: DataFrame, links: DataFrame, aliases: DataFrame, index: tuple[DataFrame, DataFrame], query: Query, vector: list[float] | None = None) -> DataFrame:
    """(artifact_id, rank): a whole search. Recent ones come by the text of their time, without any ranking."""
    limit = min(max(query.limit, 1), 50)
    cands, text, order = found(artifacts, links, aliases, query)
    if order == "recent":
        top = recent(cands, limit)
        return top.select(F.col("id").alias("artifact_id"), F.row_number().over(W.orderBy(F.col("occurred_at").desc_nulls_last(), F.col("id").desc())).alias("rank"))
    h = hybrid(artifacts, vectors, index, text, vector, limit, cands)
    return h.select("artifact_id", F.row_number().over(W.orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"))).alias("rank"))


def timeline_page(artifacts: DataFrame, start: str, end: str, types: list[str] | None = None, limit: int = 50) -> DataFrame:
    """The oldest rows of a timeline, by the text of occurred_at, then id. Given types, no digest stands for anything."""
    rows = timeline(artifacts, start, end) if types is None else timeline(artifacts.filter(F.col("type").isin(types)), start, end, digests=False)
    return rows.orderBy(F.col("occurred_at").asc_nulls_first(), "id").limit(min(max(limit, 1), 500))


def timeline(artifacts: DataFrame, start: str, end: str, digests: bool = True) -> DataFrame:
    """Artifacts of the days from start to end. Over spans of 14 days or more, a day's digest stands for the rows that it replaces; the
    rows of days without one stay."""
    day = S.utc_date(F.col("occurred_at"))
    rows = artifacts.withColumn("day", day).filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    if not digests or days < model.DIGEST_SPAN_DAYS:
        return rows
    with_digest = rows.filter("type = 'digest'").select("day").distinct()
    kept = F.col("type").isin(model.DIGESTED)
    return rows.filter(~kept).unionByName(rows.filter(kept).join(with_digest, "day", "left_anti"), allowMissingColumns=True)


def linked_rows(links: DataFrame, artifacts: DataFrame, n: int = model.PREVIEW_ROWS) -> DataFrame:
    """(entity_id, artifact_id, role, rank): each entity's newest artifacts; an artifact under two roles stands twice. An entity with
    a tenth of all links is cut to n rows in every task before the shuffle."""
    l = links.select("entity_id", "artifact_id", "role").distinct().join(artifacts.select(F.col("id").alias("artifact_id"), "occurred_at"), "artifact_id")
    w = W.partitionBy("entity_id").orderBy(F.col("occurred_at").desc_nulls_last(), F.col("artifact_id").desc(), "role")
    return l.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("entity_id", "artifact_id", "role", "rank")


def digest_inputs(artifacts: DataFrame) -> DataFrame:
    """(day, lines, truncated, input_hash): each day's rows that a digest replaces, oldest first, at most 200 of them, and a hash over
    their lines. The cap is the digest's own."""
    rows = artifacts.filter(F.col("type").isin(model.DIGESTED)).withColumn("day", S.utc_date(F.col("occurred_at"))).filter("day IS NOT NULL")
    w = W.partitionBy("day").orderBy("occurred_at", "id")
    top = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= model.DIGEST_ROWS + 1)
    line = S.prompt_line(F.col("occurred_at"), F.col("type"), F.col("place_label"), F.col("text_repr"), model.DIGEST_CLIP)
    in_order = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= model.DIGEST_ROWS, F.struct("n", line.alias("line"))))), lambda x: x["line"])
    return top.groupBy("day").agg(F.least(F.count("*"), F.lit(model.DIGEST_ROWS)).alias("lines"), (F.count("*") > model.DIGEST_ROWS).alias("truncated"), F.sha2(F.array_join(in_order, "\n"), 256).alias("input_hash"))
