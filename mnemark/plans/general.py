"""Registered queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemark.operators import spatial, timestamps
from mnemark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    art = table(spark, sf_dir, "artifacts").select("id", "source", "occurred_at", F.coalesce(F.get_json_object("extra_json", "$.tz"), F.regexp_extract("extra_json", r'"tz"\s*:\s*"([^"]+)"', 1)).alias("tz"))
    profiles = table(spark, sf_dir, "source_profiles").dropDuplicates(["source"])  # a fixed table of 11 rows
    rows = art.join(F.broadcast(profiles), "source", "left")
    done = timestamps.utc_instants(rows, "occurred_at", "tz", "home_zone", "day_order", "counts_from")
    return done.filter(F.col("utc_us").isNotNull()).select(F.col("id").alias("artifact_id"), "utc_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    art = table(spark, sf_dir, "artifacts").select(F.col("id").alias("artifact_id"), "latitude", "longitude")
    return spatial.within(art, spatial.place_regions(table(spark, sf_dir, "entities")), "artifact_id", "entity_id").select("artifact_id", "entity_id").distinct()


P4_SQL = """
WITH p AS (SELECT id AS entity_id, attrs_json AS j,
    CASE WHEN json_valid(attrs_json) THEN json_extract_string(attrs_json, '$.geo') END AS g,
    CASE WHEN json_valid(attrs_json) THEN json_extract_string(attrs_json, '$.location') END AS l,
    CASE WHEN json_valid(attrs_json) THEN json_extract_string(attrs_json, '$.radius') END AS r
  FROM entities WHERE kind = 'place' AND merged_into IS NULL AND json_valid(attrs_json)),
q AS (SELECT entity_id,
    COALESCE(TRY_CAST(json_extract_string(j, '$.latitude') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo.lat') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo[0]') AS DOUBLE), TRY_CAST(split_part(l, ',', 1) AS DOUBLE)) AS lat,
    COALESCE(TRY_CAST(json_extract_string(j, '$.longitude') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo.lon') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo[1]') AS DOUBLE), TRY_CAST(trim(split_part(l, ',', 2)) AS DOUBLE)) AS lon,
    COALESCE(TRY_CAST(json_extract_string(j, '$.radius_km') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.radius_m') AS DOUBLE) / 1000,
      CASE WHEN r LIKE '% km' THEN TRY_CAST(replace(r, ' km', '') AS DOUBLE) WHEN r LIKE '% m' THEN TRY_CAST(replace(r, ' m', '') AS DOUBLE) / 1000 END) AS km FROM p),
a AS (SELECT id, latitude, longitude FROM artifacts WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude)),
m AS (SELECT a.id AS artifact_id, q.entity_id, q.km, pow(sin(radians(lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(lat)) * pow(sin(radians(lon - longitude) / 2), 2) AS h
  FROM a JOIN q ON q.km > 0 AND q.lat BETWEEN -90 AND 90 AND q.lon BETWEEN -180 AND 180)
SELECT DISTINCT artifact_id, entity_id FROM m WHERE 2 * 6371.0 * atan2(sqrt(h), sqrt(greatest(1 - h, 0))) <= km
"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found}
SQL = {"p4_found": P4_SQL}
