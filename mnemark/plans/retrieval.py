"""Registered searches, each beside its SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemark.operators import search
from mnemark.plans.archive import OCC, QUERIES, SEARCHABLE, SQL, TERMS, VALID, register, tables
from mnemark.session import shared_folder, table

WORDS = "invoice again after lunch and the spare guitar"
# Every row whose id is divisible by 50 is a query, against all rows.
ASKED, K = 50, 10

VEC_SQL = "v AS (SELECT artifact_id, embedding::DOUBLE[] AS e FROM vec_artifacts WHERE len(embedding) = 64 AND NOT isnan(list_sum(embedding::DOUBLE[]))), q AS (SELECT e FROM v WHERE list_sum(list_transform(e, lambda x: abs(x))) > 0 ORDER BY artifact_id, e LIMIT 1)"
KNN_SQL = "n AS (SELECT artifact_id, min(round(list_distance(v.e, q.e), 6)) AS distance FROM v, q {0} GROUP BY artifact_id ORDER BY distance, artifact_id LIMIT {1})"
OF_TYPES = f"WHERE artifact_id IN (SELECT id FROM artifacts WHERE type IN {SEARCHABLE})"


def text_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index of the artifacts' texts, kept in the shared folder for as long as the table's files stay as they are."""
    files = table(spark, d, "artifacts").select(F.concat_ws("|", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    state = files.agg(F.md5(F.array_join(F.sort_array(F.collect_list("f")), ";"))).first()[0]  # a row per file of one table
    folder = f"{shared_folder(spark)}/text-index-{state}"
    try:
        return search.read_index(spark, folder)
    except AnalysisException:
        search.index_texts(table(spark, d, "artifacts"), folder)
        return search.read_index(spark, folder)


def _query_vector(spark: SparkSession, d: str) -> list[float] | None:
    v = search.usable_vectors(table(spark, d, "vec_artifacts"), 64).filter(F.exists("embedding", lambda x: x != 0))
    row = v.orderBy("artifact_id", "embedding").limit(1).select("embedding").first()
    return list(row[0]) if row else None


@register(f"WITH {VEC_SQL}, {KNN_SQL.format('', 50)} SELECT * FROM n")
def knn_l2(spark, d):  # noqa: ANN001, ANN201
    return search.knn(table(spark, d, "vec_artifacts"), _query_vector(spark, d), 50)


@register(f"WITH {VEC_SQL}, {KNN_SQL.format(OF_TYPES, 50)} SELECT * FROM n")
def knn_filtered(spark, d):  # noqa: ANN001, ANN201
    return search.knn(table(spark, d, "vec_artifacts"), _query_vector(spark, d), 50, search.candidates(table(spark, d, "artifacts")))


def bm25_sql(queries: str, k: int) -> str:
    """queries: SQL of (query_id, text)."""
    return f"""qs AS ({queries}), qt AS (SELECT query_id, unnest({TERMS.format('text')}) AS t FROM qs), qc AS (SELECT query_id, t, count(*) AS times FROM qt GROUP BY ALL),
 w AS (SELECT id, {TERMS.format('text_repr')} AS w FROM artifacts WHERE text_repr IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
 tf AS (SELECT id, dl, t, count(*) AS f FROM (SELECT id, len(w) AS dl, unnest(w) AS t FROM w) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
 bs AS (SELECT query_id, id AS artifact_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (t) JOIN qc USING (t), st WHERE id IN (SELECT id FROM artifacts WHERE type IN {SEARCHABLE}) GROUP BY ALL),
 b AS (SELECT query_id, artifact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id) AS rank FROM bs QUALIFY rank <= {k})"""


@register(f"WITH {bm25_sql('SELECT 0 AS query_id, $$' + WORDS + '$$ AS text', 50)} SELECT artifact_id, score FROM b")
def bm25_rank(spark, d):  # noqa: ANN001, ANN201
    return search.bm25(text_index(spark, d), WORDS, 50, search.candidates(table(spark, d, "artifacts")))


@register(f"""WITH {VEC_SQL}, {KNN_SQL.format(OF_TYPES, 50)}, {bm25_sql('SELECT 0 AS query_id, $$' + WORDS + '$$ AS text', 50)},
 vr AS (SELECT artifact_id, row_number() OVER (ORDER BY distance, artifact_id) AS vector_rank FROM n), kr AS (SELECT artifact_id, rank AS keyword_rank FROM b)
 SELECT artifact_id, COALESCE(vector_rank, 0) AS vector_rank, COALESCE(keyword_rank, 0) AS keyword_rank, round(COALESCE(1.0::DOUBLE / (60 + vector_rank), 0) + COALESCE(1.0::DOUBLE / (60 + keyword_rank), 0), 9) AS score FROM vr FULL JOIN kr USING (artifact_id) ORDER BY score DESC, vr.vector_rank NULLS LAST, kr.keyword_rank NULLS LAST LIMIT 10""")
def search_hybrid(spark, d):  # noqa: ANN001, ANN201
    art, vec = tables(spark, d, "artifacts", "vec_artifacts")
    h = search.hybrid(art, vec, text_index(spark, d), WORDS, _query_vector(spark, d), limit=10)
    return h.select("artifact_id", F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"), F.coalesce("keyword_rank", F.lit(0)).alias("keyword_rank"), "score")


# The searches over the query set.
KNN_SET_SQL = f"""sv AS (SELECT artifact_id, embedding::DOUBLE[] AS e FROM vec_artifacts WHERE len(embedding) = 64 AND NOT isnan(list_sum(embedding::DOUBLE[]))), sq AS (SELECT DISTINCT artifact_id AS query_id, e FROM sv WHERE artifact_id % {ASKED} = 0),
 sd AS (SELECT query_id, artifact_id, min(round(list_distance(sv.e, sq.e), 6)) AS distance FROM sv, sq GROUP BY ALL), sn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, artifact_id) AS rank FROM sd QUALIFY rank <= {K})"""


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vec_artifacts").filter(F.col("artifact_id") % ASKED == 0).select(F.col("artifact_id").alias("query_id"), "embedding").distinct()


@register(f"WITH {KNN_SET_SQL} SELECT query_id, artifact_id, distance, rank FROM sn")
def knn_query_set(spark, d):  # noqa: ANN001, ANN201
    return search.knn_set(table(spark, d, "vec_artifacts"), _asked_vectors(spark, d), K, 64)


ASKED_TEXTS = f"SELECT id AS query_id, text_repr AS text FROM artifacts WHERE id % {ASKED} = 0"


def _bm25_set(spark: SparkSession, d: str) -> DataFrame:
    art = table(spark, d, "artifacts")
    return search.bm25_set(text_index(spark, d), art.filter(F.col("id") % ASKED == 0).select(F.col("id").alias("query_id"), F.col("text_repr").alias("text")), K, search.candidates(art))


@register(f"WITH {bm25_sql(ASKED_TEXTS, K)} SELECT query_id, artifact_id, score, rank FROM b")
def bm25_query_set(spark, d):  # noqa: ANN001, ANN201
    return _bm25_set(spark, d)


@register(f"""WITH {KNN_SET_SQL}, {bm25_sql(ASKED_TEXTS, K)}, h AS (SELECT query_id, artifact_id, sn.rank AS vr, b.rank AS kr, round(COALESCE(1.0::DOUBLE / (60 + sn.rank), 0) + COALESCE(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM sn FULL JOIN b USING (query_id, artifact_id))
 SELECT query_id, artifact_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST) AS rank FROM h QUALIFY rank <= {K}""")
def hybrid_query_set(spark, d):  # noqa: ANN001, ANN201
    return search.fuse_set(search.knn_set(table(spark, d, "vec_artifacts"), _asked_vectors(spark, d), K, 64), _bm25_set(spark, d), K)


# Options of a search.
NEAR = (-19.0, 7.5)
DISTANCE = f"2 * 6371.0 * asin(sqrt(pow(sin(radians(latitude - ({NEAR[0]})) / 2), 2) + cos(radians(latitude)) * cos(radians({NEAR[0]})) * pow(sin(radians(longitude - ({NEAR[1]})) / 2), 2)))"


def _search(spark: SparkSession, d: str, query: search.Query) -> DataFrame:
    art, vec, links, al = tables(spark, d, "artifacts", "vec_artifacts", "entity_links", "entity_aliases")
    return search.search(art, vec, links, al, text_index(spark, d), query)


@register(f"SELECT id AS artifact_id FROM artifacts WHERE type IN {SEARCHABLE} AND {VALID} AND {DISTANCE} <= 40")
def search_near(spark, d):  # noqa: ANN001, ANN201
    art, links, al = tables(spark, d, "artifacts", "entity_links", "entity_aliases")
    return search.found(art, links, al, search.Query("", near=NEAR, radius_km=40))[0].select(F.col("id").alias("artifact_id"))


@register(f"SELECT id AS artifact_id, row_number() OVER (ORDER BY occurred_at DESC NULLS LAST, id DESC) AS rank FROM artifacts WHERE type IN ('photo', 'visit') AND {OCC} BETWEEN DATE '2019-01-01' AND DATE '2026-12-31' AND place_label IS NOT NULL QUALIFY rank <= 25")
def search_recent(spark, d):  # noqa: ANN001, ANN201
    return _search(spark, d, search.Query("lunch", limit=25, types=["photo", "visit"], start="2019-01-01", end="2026-12-31", geo_required=True, sort="recent"))


@register(f"""WITH al AS (SELECT DISTINCT entity_id, lower(trim(alias)) AS a, alias_type FROM entity_aliases WHERE alias_type <> 'phone'), w AS (SELECT entity_id FROM al WHERE a = 'owner@home.example'),
 p AS (SELECT entity_id FROM al WHERE alias_type = 'name' AND starts_with(a, 'edith ')), o AS (SELECT min(entity_id) AS entity_id FROM p HAVING count(DISTINCT entity_id) = 1),
 e AS (SELECT entity_id FROM w UNION SELECT entity_id FROM o WHERE NOT EXISTS (SELECT 1 FROM al WHERE a = 'edith') UNION SELECT entity_id FROM al WHERE a = 'edith'),
 c AS (SELECT * FROM artifacts WHERE type IN {SEARCHABLE} AND ((SELECT count(*) FROM e) = 0 OR id IN (SELECT artifact_id FROM entity_links WHERE entity_id IN (SELECT entity_id FROM e))))
 SELECT id AS artifact_id, row_number() OVER (ORDER BY occurred_at DESC NULLS LAST, id DESC) AS rank FROM c QUALIFY rank <= 30""")
def search_entities(spark, d):  # noqa: ANN001, ANN201
    return _search(spark, d, search.Query("lunch", limit=30, entities=["Owner@home.example", "Edith", "nobody of this name"], sort="recent"))


@register(f"SELECT id AS artifact_id, row_number() OVER (ORDER BY occurred_at DESC NULLS LAST, id DESC) AS rank FROM artifacts WHERE type IN ('note', 'post') AND {OCC} BETWEEN DATE '2020-01-01' AND DATE '2024-12-31' QUALIFY rank <= 20")
def search_retry(spark, d):  # noqa: ANN001, ANN201
    """Nothing lies at sea off the centre, so the types and dates stand alone."""
    return _search(spark, d, search.Query("lunch", limit=20, types=["note", "post"], start="2020-01-01", end="2024-12-31", place="No such place", near=(89.9, 12.0), radius_km=1, sort="recent"))


@register(f"WITH {bm25_sql('SELECT 0 AS query_id, $$lunch Atlantis$$ AS text', 50)} SELECT artifact_id, rank FROM b WHERE rank <= 10")
def search_lost_place(spark, d):  # noqa: ANN001, ANN201
    """A place that no artifact has is searched as text."""
    return _search(spark, d, search.Query("lunch", limit=10, place="Atlantis"))


@register(f"WITH r AS (SELECT id, type, occurred_at, {OCC} AS day FROM artifacts) SELECT id AS artifact_id, type, occurred_at FROM r WHERE type IN ('note', 'visit') AND day BETWEEN DATE '2020-01-01' AND DATE '2025-12-31' ORDER BY occurred_at, id LIMIT 100")
def timeline_page(spark, d):  # noqa: ANN001, ANN201
    return search.timeline_page(table(spark, d, "artifacts"), "2020-01-01", "2025-12-31", ["note", "visit"], 100).select(F.col("id").alias("artifact_id"), "type", "occurred_at")


__all__ = ["QUERIES", "SQL"]
