"""Registered queries of ingest, places and time, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemark.functions import scalars as S
from mnemark.operators import ingest, places, spatial
from mnemark.plans.archive import GAZ, HAV, KM, OCC, QUERIES, SQL, TYPE_LIST, VALID, register, tables
from mnemark.session import table

GAP_DAYS = 10  # the archives are sparse
NOW_US = 1_798_761_600_000_000  # 2027-01-01
NEAREST = f"""p AS (SELECT id, latitude, longitude FROM artifacts WHERE {VALID}), nb AS (SELECT id, round({KM.format(HAV)}, 6) AS km, name FROM p, g WHERE {KM.format(HAV)} <= 300), nr AS (SELECT id, min(struct_pack(km := km, name := name)) AS b FROM nb GROUP BY id)"""


def _gazetteer(spark: SparkSession, d: str) -> DataFrame:
    ent = table(spark, d, "entities")
    return spatial.place_regions(ent).join(ent.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name")), "entity_id")


@register(f"""WITH {GAZ}, {NEAREST}, w AS (SELECT source, source_id, artifacts.id, nullif(trim(place_label), '') AS said, CASE WHEN b.km <= 50 THEN b.name ELSE 'near ' || b.name END AS geo FROM artifacts LEFT JOIN nr ON nr.id = artifacts.id)
 SELECT source, source_id, COALESCE(last(said ORDER BY id) FILTER (said IS NOT NULL), first(geo ORDER BY id) FILTER (geo IS NOT NULL)) AS label, count(said) > 0 AS explicit FROM w GROUP BY source, source_id, CASE WHEN source_id IS NULL THEN id END""")
def ingest_enrich_label(spark, d):  # noqa: ANN001, ANN201
    return ingest.labels(table(spark, d, "artifacts"), _gazetteer(spark, d))


@register(rf"""WITH j AS (SELECT id, source, source_id, COALESCE(trim(source), '') = '' OR NOT (type IN {TYPE_LIST} OR regexp_matches(type, '^x-[a-z0-9-]+$')) OR COALESCE(trim(text_repr), '') = '' OR COALESCE(NOT regexp_matches(content_hash, '^[0-9a-f]{{64}}$'), false) OR (extra_json IS NOT NULL AND NOT json_valid(extra_json)) AS bad FROM artifacts)
 SELECT id AS artifact_id, CASE WHEN bad THEN 'failed' WHEN source_id IS NULL OR id = min(id) FILTER (NOT bad) OVER (PARTITION BY source, source_id) THEN 'created' ELSE 'updated' END AS outcome FROM j""")
def ingest_batch(spark, d):  # noqa: ANN001, ANN201
    return ingest.outcomes(table(spark, d, "artifacts")).select(F.col("id").alias("artifact_id"), "outcome")


@register("SELECT 'gmail' AS source, source_id, min(id) AS first FROM artifacts WHERE source_id IN (SELECT source_id FROM artifacts WHERE source = 'gmail') GROUP BY source_id")
def exists_batch(spark, d):  # noqa: ANN001, ANN201
    art = table(spark, d, "artifacts")
    return ingest.existing(art.select(F.lit("gmail").alias("source"), "source_id", F.col("id").alias("seq")), art)


@register("SELECT sha256(text_repr) || '.' || min(CASE WHEN regexp_matches(raw_path, '\\.[A-Za-z0-9]{1,8}$') THEN lower(regexp_extract(raw_path, '\\.([A-Za-z0-9]{1,8})$', 1)) ELSE 'bin' END) AS path, sha256(text_repr) AS hash, min(length(text_repr)) AS size, count(*) AS copies FROM artifacts WHERE text_repr IS NOT NULL GROUP BY sha256(text_repr)".replace("\\\\", "\\"))
def content_blobs(spark, d):  # noqa: ANN001, ANN201
    return ingest.blobs(table(spark, d, "artifacts"), "text_repr", "raw_path")


@register("WITH v AS (SELECT DISTINCT vec_id FROM embeddings WHERE embedding IS NOT NULL) SELECT source, count(*) AS memories, count(vec_id) AS with_vector, count(*) - count(vec_id) AS without_vector FROM documents LEFT JOIN v ON vec_id = doc_id GROUP BY source")
def memories_migration(spark, d):  # noqa: ANN001, ANN201
    docs, emb = tables(spark, d, "documents", "embeddings")
    v = emb.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id")).distinct().withColumn("has", F.lit(1))
    return docs.select("doc_id", "source").join(v, "doc_id", "left").groupBy("source").agg(F.count("*").alias("memories"), F.count("has").alias("with_vector"), F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).alias("without_vector"))


# Places and time.
GAZETTEER_SQL = r"gt AS (SELECT id AS place_id, split_part(canonical_name, ' ', 1) AS city, nullif(regexp_extract(canonical_name, '^\S+ (?:(?:harbour|market)$)?(.*)$', 1), '') AS region, id AS ord FROM entities WHERE kind = 'place' AND merged_into IS NULL)"


@register(f"WITH {GAZETTEER_SQL}, lb AS (SELECT place_label, count(*) AS artifacts FROM artifacts WHERE place_label IS NOT NULL GROUP BY 1) SELECT place_label, first(place_id ORDER BY region IS NULL, ord, place_id) AS place_id, first(artifacts) AS artifacts FROM lb JOIN gt ON lower(city) = lower(trim(place_label)) WHERE NOT contains(place_label, ',') GROUP BY place_label")
def forward_geocode(spark, d):  # noqa: ANN001, ANN201
    art, ent = tables(spark, d, "artifacts", "entities")
    gaz = ent.filter("kind = 'place' AND merged_into IS NULL").select(F.col("id").alias("place_id"), F.split_part("canonical_name", F.lit(" "), F.lit(1)).alias("city"), F.nullif(F.regexp_extract("canonical_name", r"^\S+ (?:(?:harbour|market)$)?(.*)$", 1), F.lit("")).alias("region"), F.col("id").alias("ord"))
    labels = art.filter("place_label IS NOT NULL").groupBy("place_label").agg(F.count("*").alias("artifacts"))
    return labels.join(places.forward_geocode(labels.select(F.col("place_label").alias("label")), gaz).withColumnRenamed("label", "place_label"), "place_label").select("place_label", "place_id", "artifacts")


HOME_SQL = "hm AS (SELECT CAST(json_extract_string(attrs_json, '$.latitude') AS DOUBLE) AS lat, CAST(json_extract_string(attrs_json, '$.longitude') AS DOUBLE) AS lon, CAST(json_extract_string(attrs_json, '$.radius_km') AS DOUBLE) AS km FROM entities WHERE canonical_name = 'home' AND kind = 'place' AND json_valid(attrs_json))"
TRIPS_SQL = f"""{HOME_SQL}, la AS (SELECT id, latitude, longitude, {OCC} AS day FROM artifacts WHERE {VALID}), aw AS (SELECT * FROM la WHERE day IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hm WHERE {KM.format(HAV)} <= hm.km)),
 dd AS (SELECT day, count(*) AS n, sum(latitude) AS la, sum(longitude) AS lo FROM aw GROUP BY 1), df AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) > 10 THEN 1 ELSE 0 END AS nw FROM dd), dr AS (SELECT *, sum(nw) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM df),
 tr AS (SELECT min(day) AS s, max(day) AS e, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, round(sum(la) / sum(n), 6) AS latitude, round(sum(lo) / sum(n), 6) AS longitude FROM dr GROUP BY run HAVING sum(n) >= 5)"""


def _trips(spark: SparkSession, d: str) -> DataFrame:
    gaz = _gazetteer(spark, d)
    return places.trips(table(spark, d, "artifacts"), gaz.filter("name = 'home'"), gaz, GAP_DAYS)


@register(f"""WITH {GAZ}, {TRIPS_SQL}, nb AS (SELECT s, round({KM.format(HAV)}, 6) AS km, name FROM tr, g WHERE {KM.format(HAV)} <= 300), nr AS (SELECT s, min(struct_pack(km := km, name := name)) AS b FROM nb GROUP BY s)
 SELECT CAST(s AS VARCHAR) AS trip_start, CAST(e AS VARCHAR) AS trip_end, days, n, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, COALESCE(CASE WHEN b.km <= 50 THEN b.name ELSE 'near ' || b.name END, 'Away') || ' (' || CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE CAST(s AS VARCHAR) || '–' || CAST(e AS VARCHAR) END || ')' AS name FROM tr LEFT JOIN nr USING (s)""")
def event_clusters(spark, d):  # noqa: ANN001, ANN201
    t = _trips(spark, d)
    return t.select(F.col("trip_start").cast("string").alias("trip_start"), F.col("trip_end").cast("string").alias("trip_end"), "days", "n", F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"), "name")


@register(f"""WITH {TRIPS_SQL}, al AS (SELECT id, {OCC} AS day, latitude, longitude FROM artifacts), ev AS (SELECT CAST(s AS VARCHAR) AS event_id, s, e, latitude AS lat, longitude AS lon, 2000.0 AS km FROM tr)
 SELECT id AS artifact_id, event_id FROM al JOIN ev ON day BETWEEN s AND e WHERE {VALID} AND {KM.format(HAV)} <= km""")
def event_place_link(spark, d):  # noqa: ANN001, ANN201
    ev = _trips(spark, d).select(F.col("trip_start").cast("string").alias("event_id"), F.col("trip_start").alias("run_start"), F.col("trip_end").alias("run_end"), "latitude", "longitude", F.lit(2000.0).alias("radius_km"))
    return places.in_events(table(spark, d, "artifacts"), ev)


# Dates of documents. The zone of a session may be any; the SQL counts in UTC.
@register(rf"""WITH m AS (SELECT id, regexp_extract(occurred_at, '^D:(\d{{4}})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(?:Z|([+-])(\d\d)''?(\d\d)?''?)?$', ['y', 'm', 'd', 'h', 'i', 's', 'g', 'oh', 'om']) AS p FROM artifacts WHERE regexp_matches(occurred_at, '^D:\d{{14}}(Z|[+-]\d\d''?(\d\d)?''?)?$')),
 u AS (SELECT id, p.y AS y, epoch_us(TRY_CAST(p.y || '-' || p.m || '-' || p.d || ' ' || p.h || ':' || p.i || ':' || p.s AS TIMESTAMP)) - (CASE p.g WHEN '-' THEN -1 ELSE 1 END) * (COALESCE(TRY_CAST(p.oh AS BIGINT), 0) * 60 + COALESCE(TRY_CAST(p.om AS BIGINT), 0)) * 60000000 AS us FROM m)
 SELECT id AS artifact_id, us AS utc_us FROM u WHERE us <= {NOW_US} AND CAST(y AS INT) >= 1980""")
def pdf_dates(spark, d):  # noqa: ANN001, ANN201
    us = S.pdf_date(F.col("occurred_at"), F.lit(NOW_US))
    return table(spark, d, "artifacts").select(F.col("id").alias("artifact_id"), us.alias("utc_us")).filter("utc_us IS NOT NULL")


@register(r"""WITH m AS (SELECT id, occurred_at AS o FROM artifacts WHERE regexp_matches(occurred_at, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$') AND substr(occurred_at, 1, 4) >= '1990')
 SELECT id AS artifact_id, epoch_us(TRY_CAST(substr(o, 1, 10) || ' ' || substr(o, 12, 8) AS TIMESTAMP)) - CASE WHEN regexp_matches(o, '[+-]\d\d:\d\d$') THEN (CASE WHEN substr(right(o, 6), 1, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(right(o, 6), 2, 2) AS BIGINT) * 60 + CAST(right(o, 2) AS BIGINT)) * 60000000 ELSE 0 END AS utc_us FROM m WHERE TRY_CAST(substr(o, 1, 10) || ' ' || substr(o, 12, 8) AS TIMESTAMP) IS NOT NULL""")
def office_dates(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "artifacts").select(F.col("id").alias("artifact_id"), S.office_date(F.col("occurred_at")).alias("utc_us")).filter("utc_us IS NOT NULL")


__all__ = ["QUERIES", "SQL"]
