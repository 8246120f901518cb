"""Registered queries of the archive's own operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemark import model
from mnemark.functions import scalars as S
from mnemark.operators import annotate, graph, ingest, places, search, spatial
from mnemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Pieces of SQL that several queries share.
OCC = r"""(CASE WHEN regexp_matches(occurred_at, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$') THEN
 CAST(TRY_CAST(substr(occurred_at, 1, 10) AS DATE) + to_minutes(COALESCE(TRY_CAST(substr(occurred_at, 12, 2) AS INT), 0) * 60 + COALESCE(TRY_CAST(substr(occurred_at, 15, 2) AS INT), 0)
 - CASE WHEN regexp_matches(occurred_at, '\d{2}:\d{2}.*[+-]\d{2}:\d{2}$') THEN (CASE WHEN regexp_extract(occurred_at, '([+-])\d{2}:\d{2}$', 1) = '-' THEN -1 ELSE 1 END) * (CAST(regexp_extract(occurred_at, '[+-](\d{2}):(\d{2})$', 1) AS INT) * 60 + CAST(regexp_extract(occurred_at, '[+-](\d{2}):(\d{2})$', 2) AS INT)) ELSE 0 END) AS DATE) END)"""
NORM = r"lower(regexp_replace({0}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'))"
DIGITS = r"(CASE WHEN regexp_matches(regexp_replace({0}, '\D', '', 'g'), '^1\d{{10}}$') THEN substr(regexp_replace({0}, '\D', '', 'g'), 2, 10) ELSE regexp_replace({0}, '\D', '', 'g') END)"
ALIASES = f"al AS (SELECT DISTINCT entity_id, CASE WHEN alias_type = 'phone' THEN {DIGITS.format('alias')} ELSE {NORM.format('alias')} END AS alias, alias_type FROM entity_aliases), a AS (SELECT * FROM al WHERE alias <> '')"
VALID = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude)"
GAZ = """places AS (SELECT canonical_name AS name, attrs_json AS j, json_extract_string(attrs_json, '$.location') AS l FROM entities WHERE kind = 'place' AND merged_into IS NULL AND json_valid(attrs_json)),
 gz AS (SELECT DISTINCT name, COALESCE(TRY_CAST(json_extract_string(j, '$.latitude') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo.lat') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo[0]') AS DOUBLE), TRY_CAST(split_part(l, ',', 1) AS DOUBLE)) AS lat,
 COALESCE(TRY_CAST(json_extract_string(j, '$.longitude') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo.lon') AS DOUBLE), TRY_CAST(json_extract_string(j, '$.geo[1]') AS DOUBLE), TRY_CAST(trim(split_part(l, ',', 2)) AS DOUBLE)) AS lon FROM places),
 g AS (SELECT * FROM gz WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"""
KM = "2 * 6371.0 * atan2(sqrt({0}), sqrt(greatest(1 - ({0}), 0)))"
HAV = "pow(sin(radians(lat - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(lat)) * pow(sin(radians(lon - longitude) / 2), 2)"
SEARCHABLE = "(" + ", ".join(f"'{t}'" for t in model.SEARCHABLE) + ")"
DIGESTED = "(" + ", ".join(f"'{t}'" for t in model.DIGESTED) + ")"
TERMS = "list_filter(regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def register(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


# Retrieval.
@register(f"SELECT id AS artifact_id FROM artifacts WHERE type IN {SEARCHABLE} AND {OCC} BETWEEN DATE '2024-01-01' AND DATE '2025-06-30' AND place_label IS NOT NULL AND id IN (SELECT artifact_id FROM entity_links WHERE role = 'sender' OR role = 'pictured')")
def candidate_prefilter(spark, d):  # noqa: ANN001, ANN201
    art, links = tables(spark, d, "artifacts", "entity_links")
    return search.candidates(art, start="2024-01-01", end="2025-06-30", with_place=True, linked_to=links.filter("role IN ('sender', 'pictured')")).select(F.col("id").alias("artifact_id"))


@register(f"SELECT id AS artifact_id, place_label FROM artifacts WHERE type IN {SEARCHABLE} AND (place_label ILIKE '%norvale%' OR place_label ILIKE '%, nv')")
def place_filter(spark, d):  # noqa: ANN001, ANN201
    return search.candidates(table(spark, d, "artifacts"), place=["%norvale%", "%, nv"]).select(F.col("id").alias("artifact_id"), "place_label")


@register(f"SELECT id AS artifact_id, occurred_at FROM artifacts WHERE type IN {SEARCHABLE} ORDER BY occurred_at DESC NULLS LAST, id DESC LIMIT 50")
def recent_sort(spark, d):  # noqa: ANN001, ANN201
    return search.recent(search.candidates(table(spark, d, "artifacts")), 50).select(F.col("id").alias("artifact_id"), "occurred_at")


@register(f"WITH r AS (SELECT id, type, occurred_at, {OCC} AS day FROM artifacts), s AS (SELECT * FROM r WHERE day BETWEEN DATE '2023-01-01' AND DATE '2025-12-31') SELECT id AS artifact_id, type, occurred_at FROM s WHERE type NOT IN {DIGESTED} OR day NOT IN (SELECT day FROM s WHERE type = 'digest')")
def timeline_digest(spark, d):  # noqa: ANN001, ANN201
    return search.timeline(table(spark, d, "artifacts"), "2023-01-01", "2025-12-31").select(F.col("id").alias("artifact_id"), "type", "occurred_at")


@register(f"SELECT id AS artifact_id, occurred_at FROM artifacts WHERE {OCC} BETWEEN DATE '2025-03-01' AND DATE '2025-03-07'")
def timeline_range(spark, d):  # noqa: ANN001, ANN201
    return search.timeline(table(spark, d, "artifacts"), "2025-03-01", "2025-03-07").select(F.col("id").alias("artifact_id"), "occurred_at")


@register("SELECT entity_id, artifact_id, role, rank FROM (SELECT entity_id, artifact_id, role, row_number() OVER (PARTITION BY entity_id ORDER BY occurred_at DESC NULLS LAST, artifact_id DESC, role) AS rank FROM (SELECT DISTINCT entity_id, artifact_id, role FROM entity_links) JOIN artifacts ON id = artifact_id) WHERE rank <= 10")
def about_entity(spark, d):  # noqa: ANN001, ANN201
    return search.linked_rows(*tables(spark, d, "entity_links", "artifacts"))


@register("SELECT artifact_id, count(*) AS links, string_agg(entity_id || ':' || role, ',' ORDER BY entity_id, role) AS linked FROM (SELECT DISTINCT artifact_id, entity_id, role FROM entity_links) l JOIN entities e ON e.id = entity_id JOIN artifacts a ON a.id = artifact_id GROUP BY artifact_id")
def artifact_links(spark, d):  # noqa: ANN001, ANN201
    links, ent, art = tables(spark, d, "entity_links", "entities", "artifacts")
    l = links.select("artifact_id", "entity_id", "role").distinct().join(ent.select(F.col("id").alias("entity_id")), "entity_id").join(art.select(F.col("id").alias("artifact_id")), "artifact_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "role"))), lambda x: F.concat_ws(":", x["entity_id"], x["role"])), ",")
    return l.groupBy("artifact_id").agg(F.count("*").alias("links"), listed.alias("linked"))


@register("SELECT DISTINCT source, source_id FROM artifacts WHERE source_id IN (SELECT source_id FROM artifacts WHERE source_id IS NOT NULL GROUP BY source, source_id HAVING count(*) > 1)")
def exists_check(spark, d):  # noqa: ANN001, ANN201
    art = table(spark, d, "artifacts")
    again = art.filter("source_id IS NOT NULL").groupBy("source", "source_id").count().filter("count > 1").select("source_id").distinct()
    return art.select("source", "source_id").distinct().join(again, "source_id", "left_semi").select("source", "source_id")


@register("SELECT id AS artifact_id, COALESCE(occurred_at, strftime(ingested_at, '%Y-%m-%d %H:%M:%S')) AS created_at, substr(text_repr, 1, 200) AS snippet FROM artifacts")
def recall_projection(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "artifacts").select(F.col("id").alias("artifact_id"), F.coalesce("occurred_at", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"), F.substring("text_repr", 1, 200).alias("snippet"))


# Places and time.
@register(f"WITH {GAZ}, p AS (SELECT id, latitude, longitude FROM artifacts WHERE {VALID}) SELECT DISTINCT id AS artifact_id, name AS place, round({KM.format(HAV)}, 4) AS km FROM p, g WHERE {KM.format(HAV)} <= 25")
def geo_radius(spark, d):  # noqa: ANN001, ANN201
    art, ent = tables(spark, d, "artifacts", "entities")
    g = spatial.place_regions(ent).join(ent.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").select(F.struct("canonical_name", "latitude", "longitude").alias("place"), "latitude", "longitude").distinct()
    return spatial.near(art, g, model.RADIUS_KM, "id", "place").select(F.col("id").alias("artifact_id"), F.col("place.canonical_name").alias("place"), F.round("distance_km", 4).alias("km")).distinct()


@register(f"WITH {GAZ}, p AS (SELECT id, latitude, longitude FROM artifacts WHERE {VALID}), n AS (SELECT id, name, round({KM.format(HAV)}, 6) AS km FROM p, g WHERE {KM.format(HAV)} <= 300), b AS (SELECT id, min(struct_pack(km := km, name := name)) AS b FROM n GROUP BY id) SELECT id AS artifact_id, CASE WHEN b.km <= 50 THEN b.name ELSE 'near ' || b.name END AS label, round(b.km, 4) AS km FROM b")
def reverse_geocode(spark, d):  # noqa: ANN001, ANN201
    art, ent = tables(spark, d, "artifacts", "entities")
    g = spatial.place_regions(ent).join(ent.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name")), "entity_id")
    return places.reverse_geocode(art, g).withColumn("km", F.round("km", 4))


@register(f"SELECT CAST(floor(latitude * 100) AS BIGINT) AS cell_lat, CAST(floor(longitude * 100) AS BIGINT) AS cell_lon, count(*) AS n, round(avg(latitude), 4) AS latitude, round(avg(longitude), 4) AS longitude FROM artifacts WHERE {VALID} GROUP BY 1, 2 HAVING count(*) >= 5")
def place_clusters(spark, d):  # noqa: ANN001, ANN201
    c = places.clusters(table(spark, d, "artifacts"))
    return c.withColumn("latitude", F.round("latitude", 4)).withColumn("longitude", F.round("longitude", 4))


RUNS_SQL = f"""d AS (SELECT 'all' AS source, {OCC} AS day, count(*) AS n FROM artifacts GROUP BY 1, 2), f AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY source ORDER BY day) > 1 THEN 1 ELSE 0 END AS nw FROM d WHERE day IS NOT NULL),
 r AS (SELECT *, sum(nw) OVER (PARTITION BY source ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM f), u AS (SELECT source, min(day) AS run_start, max(day) AS run_end, count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY source, run HAVING sum(n) >= 5)"""


@register(f"WITH {RUNS_SQL} SELECT source, CAST(run_start AS VARCHAR) AS run_start, CAST(run_end AS VARCHAR) AS run_end, days, n FROM u")
def event_runs(spark, d):  # noqa: ANN001, ANN201
    return places.day_runs(table(spark, d, "artifacts")).select("source", F.col("run_start").cast("string").alias("run_start"), F.col("run_end").cast("string").alias("run_end"), "days", "n")


@register(f"WITH {RUNS_SQL} SELECT a.id AS artifact_id, CAST(u.run_start AS VARCHAR) AS run_start FROM (SELECT id, source, {OCC} AS day FROM artifacts) a JOIN u ON a.day BETWEEN u.run_start AND u.run_end")
def event_link(spark, d):  # noqa: ANN001, ANN201
    art = table(spark, d, "artifacts")
    return places.in_runs(art, places.day_runs(art)).select("artifact_id", F.col("run_start").cast("string").alias("run_start"))


@register("""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM f)
 SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark, d):  # noqa: ANN001, ANN201
    s = places.sessions(table(spark, d, "events"), "user_id", "ts")
    return s.select("user_id", "session", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "n")


# The entity graph.
@register(f"WITH {ALIASES}, t AS (SELECT DISTINCT canonical_name AS term FROM entities), k AS (SELECT term, {NORM.format('term')} AS alias FROM t UNION SELECT term, {DIGITS.format('term')} FROM t WHERE length({DIGITS.format('term')}) >= 7) SELECT DISTINCT term, entity_id FROM k JOIN a USING (alias)")
def resolve_alias(spark, d):  # noqa: ANN001, ANN201
    ent, al = tables(spark, d, "entities", "entity_aliases")
    return graph.resolve(ent.select(F.col("canonical_name").alias("term")), al)


@register(f"WITH {ALIASES}, t AS (SELECT DISTINCT split_part(trim(canonical_name), ' ', 1) AS term FROM entities WHERE kind = 'person') SELECT term, min(entity_id) AS entity_id FROM t JOIN a ON alias_type = 'name' AND starts_with(alias, {NORM.format('term')} || ' ') GROUP BY term HAVING count(DISTINCT entity_id) = 1")
def resolve_prefix(spark, d):  # noqa: ANN001, ANN201
    ent, al = tables(spark, d, "entities", "entity_aliases")
    return graph.resolve_prefix(ent.filter("kind = 'person'").select(F.split_part(F.trim("canonical_name"), F.lit(" "), F.lit(1)).alias("term")), al)


@register("WITH n AS (SELECT entity_id, count(*) AS aliases FROM (SELECT DISTINCT * FROM entity_aliases) GROUP BY 1), l AS (SELECT entity_id, count(DISTINCT artifact_id) AS artifacts FROM entity_links GROUP BY 1) SELECT id AS entity_id, kind, canonical_name, COALESCE(aliases, 0) AS aliases, COALESCE(artifacts, 0) AS artifacts FROM entities e LEFT JOIN n ON n.entity_id = id LEFT JOIN l ON l.entity_id = id WHERE merged_into IS NULL")
def entity_list(spark, d):  # noqa: ANN001, ANN201
    ent, al, links = tables(spark, d, "entities", "entity_aliases", "entity_links")
    n = al.distinct().groupBy("entity_id").agg(F.count("*").alias("aliases"))
    l = links.select("entity_id", "artifact_id").distinct().groupBy("entity_id").agg(F.count("*").alias("artifacts"))
    out = graph.live(ent).select(F.col("id").alias("entity_id"), "kind", "canonical_name").join(n, "entity_id", "left").join(l, "entity_id", "left")
    return out.select("entity_id", "kind", "canonical_name", F.coalesce("aliases", F.lit(0)).alias("aliases"), F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


@register(rf"WITH t AS (SELECT id, canonical_name AS c, regexp_split_to_array(regexp_replace(canonical_name, '^[\s]+|[\s]+$', '', 'g'), '\s+') AS t FROM entities WHERE kind = 'person') SELECT id AS entity_id, CASE WHEN len(t) = 3 THEN t[1] || ' ' || t[3] ELSE c END AS display_name, array_to_string(list_distinct_ordered, '|') AS variants FROM (SELECT id, c, t, CASE WHEN len(t) = 3 AND lower(t[1] || ' ' || t[3]) <> {NORM.format('c')} THEN [{NORM.format('c')}, lower(t[1] || ' ' || t[3])] ELSE [{NORM.format('c')}] END AS list_distinct_ordered FROM t)")
def name_variants(spark, d):  # noqa: ANN001, ANN201
    c = F.col("canonical_name")
    return table(spark, d, "entities").filter("kind = 'person'").select(F.col("id").alias("entity_id"), S.display_name(c).alias("display_name"), F.array_join(S.name_variants(c), "|").alias("variants"))


@register(f"SELECT alias, {DIGITS.format('alias')} AS phone, count(DISTINCT entity_id) AS entities FROM entity_aliases WHERE alias_type = 'phone' GROUP BY 1, 2")
def normalize_phone(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "entity_aliases").filter("alias_type = 'phone'").groupBy("alias", S.norm_phone(F.col("alias")).alias("phone")).agg(F.countDistinct("entity_id").alias("entities"))


HINTS_SQL = f"""h0 AS (SELECT artifact_id, role, confidence AS supplied, CASE WHEN json_type(attrs_json, '$.emails') = 'ARRAY' THEN CAST(json_extract_string(attrs_json, '$.emails[*]') AS VARCHAR[]) END AS e, canonical_name AS c FROM entity_links JOIN entities ON id = entity_id AND kind = 'person' AND json_valid(attrs_json)),
 h1 AS (SELECT artifact_id, role, supplied, unnest(e) AS alias, 'email' AS alias_type FROM h0 UNION ALL SELECT artifact_id, role, supplied, c, 'name' FROM h0), h AS (SELECT artifact_id, role, supplied, alias_type, {NORM.format('alias')} AS alias FROM h1 WHERE alias IS NOT NULL)"""


def _hints(spark: SparkSession, d: str) -> DataFrame:
    links, ent = tables(spark, d, "entity_links", "entities")
    emails = F.from_json(F.get_json_object("attrs_json", "$.emails"), "array<string>")
    said = F.concat(F.transform(F.coalesce(emails, F.array().cast("array<string>")), lambda e: F.struct(e.alias("alias"), F.lit("email").alias("alias_type"))), F.array(F.struct(F.col("canonical_name").alias("alias"), F.lit("name").alias("alias_type"))))
    p = ent.filter(F.col("kind") == "person").filter(F.try_parse_json("attrs_json").isNotNull()).select(F.col("id").alias("entity_id"), said.alias("said"))
    h = links.join(p, "entity_id").select("artifact_id", "role", F.col("confidence").alias("supplied"), F.explode("said").alias("x"))
    return h.select("artifact_id", "role", "supplied", "x.alias", "x.alias_type").filter("alias IS NOT NULL")


@register(f"WITH {ALIASES}, {HINTS_SQL} SELECT artifact_id, entity_id, role, round(max(CASE WHEN alias_type = 'email' THEN 1.0::DOUBLE ELSE least(COALESCE(supplied, 0.7), 0.9) END), 6) AS confidence FROM h JOIN a USING (alias, alias_type) GROUP BY ALL")
def hint_links(spark, d):  # noqa: ANN001, ANN201
    return graph.link_hints(_hints(spark, d), table(spark, d, "entity_aliases"))[0].withColumn("confidence", F.round("confidence", 6))


@register(f"WITH {ALIASES}, {HINTS_SQL} SELECT alias, alias_type, count(*) AS times, min(artifact_id) AS first_artifact FROM h WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.alias = h.alias AND a.alias_type = h.alias_type) GROUP BY ALL")
def staged_hints(spark, d):  # noqa: ANN001, ANN201
    return graph.link_hints(_hints(spark, d), table(spark, d, "entity_aliases"))[1].groupBy("alias", "alias_type").agg(F.count("*").alias("times"), F.min("artifact_id").alias("first_artifact"))


@register("""WITH RECURSIVE c AS (SELECT id, merged_into AS keep, 1 AS n FROM entities WHERE merged_into IS NOT NULL UNION ALL SELECT c.id, e.merged_into, n + 1 FROM c JOIN entities e ON e.id = c.keep WHERE e.merged_into IS NOT NULL AND n < 50), m AS (SELECT id, last(keep ORDER BY n) AS keep FROM c GROUP BY id),
 l AS (SELECT artifact_id, COALESCE(keep, entity_id) AS entity_id, role, confidence, keep IS NULL AS own FROM entity_links LEFT JOIN m ON m.id = entity_id)
 SELECT artifact_id, entity_id, role, first(confidence ORDER BY own DESC, COALESCE(confidence, -1) DESC) AS confidence FROM l GROUP BY 1, 2, 3""")
def merge_entities(spark, d):  # noqa: ANN001, ANN201
    return graph.merged_links(*tables(spark, d, "entity_links", "entities"))


@register(f"WITH {ALIASES}, s AS (SELECT entity_id, alias_type, alias FROM a JOIN entities ON id = entity_id AND kind = 'person' AND merged_into IS NULL WHERE alias_type = 'email' OR alias_type = 'phone' AND length(alias) >= 7) SELECT entity_id, alias_type, alias, class_id, members FROM (SELECT *, min(entity_id) OVER w AS class_id, count(*) OVER w AS members FROM s WINDOW w AS (PARTITION BY alias_type, alias)) WHERE members > 1")
def duplicate_contacts(spark, d):  # noqa: ANN001, ANN201
    return graph.contact_classes(*tables(spark, d, "entities", "entity_aliases"))


@register(f"WITH n AS (SELECT DISTINCT {NORM.format('canonical_name')} AS n FROM entities WHERE kind = 'person' AND merged_into IS NULL), p AS (SELECT a.n AS name_a, b.n AS name_b, 1 - levenshtein(a.n, b.n)::DOUBLE / greatest(length(a.n), length(b.n)) AS s FROM n a JOIN n b ON a.n < b.n AND abs(length(a.n) - length(b.n)) <= 8) SELECT name_a, name_b, round(s, 6) AS similarity FROM p WHERE s >= 0.8 - 1e-9")
def duplicate_names(spark, d):  # noqa: ANN001, ANN201
    return graph.similar_names(table(spark, d, "entities"))


@register(f"WITH {ALIASES}, c AS (SELECT DISTINCT {NORM.format('canonical_name')} AS name FROM entities WHERE kind = 'org') SELECT name, min(entity_id) AS existing_id FROM c LEFT JOIN a ON a.alias = c.name GROUP BY name")
def get_or_create(spark, d):  # noqa: ANN001, ANN201
    ent, al = tables(spark, d, "entities", "entity_aliases")
    c = ent.filter("kind = 'org'").select(S.norm_name(F.col("canonical_name")).alias("name")).distinct()
    return c.join(graph.normal_aliases(al).select(F.col("alias").alias("name"), "entity_id"), "name", "left").groupBy("name").agg(F.min("entity_id").alias("existing_id"))


@register(f"WITH {ALIASES}, o AS (SELECT id AS entity_id, unnest(CAST(json_extract_string(attrs_json, '$.emails[*]') AS VARCHAR[])) AS e FROM entities WHERE kind = 'person' AND json_valid(attrs_json)), n AS (SELECT DISTINCT entity_id, {NORM.format('e')} AS alias FROM o), m AS (SELECT entity_id, alias FROM a WHERE alias_type = 'email' AND entity_id IN (SELECT id FROM entities WHERE kind = 'person')) SELECT entity_id, alias, 'added' AS change FROM (SELECT entity_id, alias FROM n WHERE alias <> '' EXCEPT SELECT * FROM m) UNION ALL SELECT entity_id, alias, 'removed' FROM (SELECT * FROM m EXCEPT SELECT * FROM n)")
def alias_diff(spark, d):  # noqa: ANN001, ANN201
    ent, al = tables(spark, d, "entities", "entity_aliases")
    people = ent.filter("kind = 'person'")
    new = people.filter(F.try_parse_json("attrs_json").isNotNull()).select(F.col("id").alias("entity_id"), F.explode(F.from_json(F.get_json_object("attrs_json", "$.emails"), "array<string>")).alias("e")).select("entity_id", S.norm_name(F.col("e")).alias("alias")).filter("alias <> ''").distinct()
    old = graph.normal_aliases(al).filter("alias_type = 'email'").join(people.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "alias")
    return new.join(old, ["entity_id", "alias"], "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, ["entity_id", "alias"], "left_anti").withColumn("change", F.lit("removed")))


@register("SELECT 'link without entity' AS problem, count(*) AS rows FROM entity_links WHERE entity_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 'link without artifact', count(*) FROM entity_links WHERE artifact_id NOT IN (SELECT id FROM artifacts) UNION ALL SELECT 'alias without entity', count(*) FROM entity_aliases WHERE entity_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 'merge without entity', count(*) FROM entities WHERE merged_into IS NOT NULL AND merged_into NOT IN (SELECT id FROM entities)")
def fk_integrity(spark, d):  # noqa: ANN001, ANN201
    return graph.orphans(*tables(spark, d, "entity_links", "entity_aliases", "artifacts", "entities"))


@register("SELECT entity_id, last(raw_path ORDER BY artifact_id) AS raw_path, max(artifact_id) AS artifact_id FROM (SELECT DISTINCT entity_id, artifact_id, raw_path FROM entity_links JOIN artifacts ON id = artifact_id WHERE raw_path IS NOT NULL AND role IN ('self', 'pictured')) GROUP BY entity_id")
def contact_photo_latest(spark, d):  # noqa: ANN001, ANN201
    links, art = tables(spark, d, "entity_links", "artifacts")
    l = links.filter("role IN ('self', 'pictured')").select("entity_id", "artifact_id").distinct().join(art.filter("raw_path IS NOT NULL").select(F.col("id").alias("artifact_id"), "raw_path"), "artifact_id")
    return l.groupBy("entity_id").agg(F.max_by("raw_path", "artifact_id").alias("raw_path"), F.max("artifact_id").alias("artifact_id"))


@register("SELECT artifact_id, string_agg(canonical_name, '|' ORDER BY canonical_name) AS names FROM (SELECT DISTINCT artifact_id, canonical_name FROM entity_links JOIN entities ON id = entity_id WHERE role = 'pictured') GROUP BY artifact_id")
def pictured_names(spark, d):  # noqa: ANN001, ANN201
    links, ent = tables(spark, d, "entity_links", "entities")
    l = links.filter("role = 'pictured'").join(ent.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    return l.groupBy("artifact_id").agg(F.array_join(F.sort_array(F.collect_set("canonical_name")), "|").alias("names"))


# Ingest.
@register("""SELECT source, source_id, min(id) AS first_id, count(*) AS waves, last(type ORDER BY id) AS type, last(occurred_at ORDER BY id) FILTER (occurred_at IS NOT NULL) AS occurred_at, last(latitude ORDER BY id) FILTER (latitude IS NOT NULL) AS latitude, last(longitude ORDER BY id) FILTER (longitude IS NOT NULL) AS longitude,
 last(place_label ORDER BY id) FILTER (place_label IS NOT NULL) AS place_label, last(text_repr ORDER BY id) FILTER (text_repr IS NOT NULL) AS text_repr, last(extra_json ORDER BY id) FILTER (extra_json IS NOT NULL) AS extra_json, first(content_hash ORDER BY id) AS content_hash, first(raw_path ORDER BY id) AS raw_path FROM artifacts GROUP BY source, source_id, CASE WHEN source_id IS NULL THEN id END""")
def upsert_fold(spark, d):  # noqa: ANN001, ANN201
    return ingest.fold(table(spark, d, "artifacts"))


BEFORE = "OVER (PARTITION BY source, source_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
HISTORY_SQL = f"""hc AS (SELECT source, source_id, id, row_number() OVER (PARTITION BY source, source_id ORDER BY id) AS n, concat_ws(',', CASE WHEN type IS DISTINCT FROM last_value(type) {BEFORE} THEN 'type' END, CASE WHEN occurred_at IS NOT NULL AND occurred_at IS DISTINCT FROM last_value(occurred_at IGNORE NULLS) {BEFORE} THEN 'occurred_at' END,
 CASE WHEN latitude IS NOT NULL AND latitude IS DISTINCT FROM last_value(latitude IGNORE NULLS) {BEFORE} THEN 'latitude' END, CASE WHEN longitude IS NOT NULL AND longitude IS DISTINCT FROM last_value(longitude IGNORE NULLS) {BEFORE} THEN 'longitude' END, CASE WHEN place_label IS NOT NULL AND place_label IS DISTINCT FROM last_value(place_label IGNORE NULLS) {BEFORE} THEN 'place_label' END,
 CASE WHEN text_repr IS NOT NULL AND text_repr IS DISTINCT FROM last_value(text_repr IGNORE NULLS) {BEFORE} THEN 'text_repr' END, CASE WHEN extra_json IS NOT NULL AND extra_json IS DISTINCT FROM last_value(extra_json IGNORE NULLS) {BEFORE} THEN 'extra_json' END) AS changed FROM artifacts WHERE source_id IS NOT NULL)"""


@register(f"WITH {HISTORY_SQL} SELECT source, source_id, id AS seq, changed FROM hc WHERE n > 1 AND changed <> ''")
def upsert_history(spark, d):  # noqa: ANN001, ANN201
    return ingest.history(table(spark, d, "artifacts"))


@register(f"WITH {HISTORY_SQL} SELECT id AS seq, 'ingest_create' AS event_type, 'ingest' AS actor, CAST(json_object('source', source, 'source_id', source_id) AS VARCHAR) AS details FROM hc WHERE n = 1 UNION ALL SELECT id, 'ingest_update', 'ingest', CAST(json_object('source', source, 'source_id', source_id, 'changed', changed) AS VARCHAR) FROM hc WHERE n > 1 AND changed <> ''")
def audit_log(spark, d):  # noqa: ANN001, ANN201
    return ingest.audit(table(spark, d, "artifacts"))


@register("SELECT min(id) AS artifact_id FROM artifacts GROUP BY source, source_id, CASE WHEN source_id IS NULL THEN id END")
def insert_if_absent(spark, d):  # noqa: ANN001, ANN201
    return ingest.first_of_each(table(spark, d, "artifacts"))


TYPE_LIST = "(" + ", ".join(f"'{t}'" for t in model.TYPES) + ")"


@register(f"SELECT id AS artifact_id, concat_ws(',', CASE WHEN COALESCE(trim(source), '') = '' THEN 'source' END, CASE WHEN NOT (type IN {TYPE_LIST} OR regexp_matches(type, '^x-[a-z0-9-]+$')) THEN 'type' END, CASE WHEN COALESCE(trim(text_repr), '') = '' THEN 'text_repr' END, CASE WHEN NOT regexp_matches(content_hash, '^[0-9a-f]{{64}}$') THEN 'content_hash' END, CASE WHEN extra_json IS NOT NULL AND NOT json_valid(extra_json) THEN 'extra' END) AS errors FROM artifacts")
def ingest_validation(spark, d):  # noqa: ANN001, ANN201
    return ingest.validate(table(spark, d, "artifacts")).select(F.col("id").alias("artifact_id"), F.array_join("errors", ",").alias("errors"))


@register("WITH r AS (SELECT source, row_number() OVER (PARTITION BY source, source_id ORDER BY id) AS n, source_id IS NULL AS own FROM artifacts) SELECT source, count(*) FILTER (own OR n = 1) AS created, count(*) FILTER (NOT own AND n > 1) AS updated FROM r GROUP BY source")
def ingest_summary(spark, d):  # noqa: ANN001, ANN201
    f = ingest.fold(table(spark, d, "artifacts"))
    return f.groupBy("source").agg(F.count("*").alias("created"), F.sum(F.col("waves") - 1).alias("updated"))


@register("SELECT type, count(*) AS n FROM artifacts WHERE regexp_matches(type, '^x-[a-z0-9-]+$') GROUP BY type")
def extension_types(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "artifacts").filter(F.col("type").rlike("^x-[a-z0-9-]+$")).groupBy("type").agg(F.count("*").alias("n"))


@register(r"WITH h AS (SELECT *, regexp_extract(lower(content_hash), '([0-9a-f]{64})$', 1) AS hash FROM artifacts) SELECT hash, min(id) AS first_id, count(*) AS copies, first(occurred_at ORDER BY id) FILTER (occurred_at IS NOT NULL) AS occurred_at, first(place_label ORDER BY id) FILTER (place_label IS NOT NULL) AS place_label FROM h WHERE hash <> '' AND hash <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' GROUP BY hash HAVING count(*) > 1")
def copy_merge(spark, d):  # noqa: ANN001, ANN201
    return ingest.copies_by_hash(table(spark, d, "artifacts"))


@register("SELECT id AS artifact_id, raw_path FROM artifacts a WHERE raw_path IS NOT NULL AND content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM artifacts b WHERE b.raw_path = a.raw_path AND b.content_hash = a.content_hash AND b.id < a.id)")
def manifest_changed(spark, d):  # noqa: ANN001, ANN201
    f = table(spark, d, "artifacts").filter("raw_path IS NOT NULL AND content_hash IS NOT NULL")
    return f.groupBy("raw_path", "content_hash").agg(F.min("id").alias("artifact_id")).select("artifact_id", "raw_path")


@register(rf"""WITH r AS (SELECT *, {OCC} AS day FROM artifacts WHERE type IN {DIGESTED}), n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY occurred_at, id) AS n FROM r WHERE day IS NOT NULL)
 SELECT CAST(day AS VARCHAR) AS day, least(count(*), 200) AS lines, count(*) > 200 AS truncated, sha256(string_agg(concat_ws(' ', nullif(regexp_extract(occurred_at, '^\d{{4}}-\d{{2}}-\d{{2}}[T ](\d{{2}}:\d{{2}})', 1), ''), type, '@ ' || place_label, substr(text_repr, 1, 500)), chr(10) ORDER BY n) FILTER (n <= 200)) AS input_hash FROM n WHERE n <= 201 GROUP BY day""")
def daily_digest_inputs(spark, d):  # noqa: ANN001, ANN201
    return search.digest_inputs(table(spark, d, "artifacts")).withColumn("day", F.col("day").cast("string"))


@register(r"""WITH j AS (SELECT id, lower(text_repr) AS x FROM artifacts WHERE type = 'document' AND json_valid(text_repr)) SELECT id AS artifact_id, trim(json_extract_string(x, '$.vendor')) AS vendor, TRY_CAST(regexp_replace(json_extract_string(x, '$.amount'), '[^0-9.-]', '', 'g') AS DOUBLE) AS amount, CASE WHEN regexp_matches(json_extract_string(x, '$.currency'), '^[a-z]{3}$') THEN upper(json_extract_string(x, '$.currency')) END AS currency FROM j""")
def field_coercion(spark, d):  # noqa: ANN001, ANN201
    x = F.lower("text_repr")
    j = table(spark, d, "artifacts").filter((F.col("type") == "document") & F.try_parse_json("text_repr").isNotNull())
    get = lambda k: F.get_json_object(x, f"$.{k}")
    return j.select(F.col("id").alias("artifact_id"), F.trim(get("vendor")).alias("vendor"), F.regexp_replace(get("amount"), "[^0-9.-]", "").try_cast("double").alias("amount"), F.when(get("currency").rlike("^[a-z]{3}$"), F.upper(get("currency"))).alias("currency"))


@register("SELECT id AS artifact_id, 978307200000 + CAST(floor(CASE WHEN TRY_CAST(occurred_at AS DOUBLE) > 1e12 THEN TRY_CAST(occurred_at AS DOUBLE) / 1e6 ELSE TRY_CAST(occurred_at AS DOUBLE) * 1000 END) AS BIGINT) AS ms FROM artifacts WHERE source = 'imessage' AND regexp_matches(occurred_at, '^[0-9]{9}([0-9]{9})?$')")
def apple_time(spark, d):  # noqa: ANN001, ANN201
    m = table(spark, d, "artifacts").filter((F.col("source") == "imessage") & F.col("occurred_at").rlike("^[0-9]{9}([0-9]{9})?$"))
    return m.select(F.col("id").alias("artifact_id"), S.apple_seconds(F.col("occurred_at").cast("double")).alias("ms"))


@register(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\t\r\f\v \x{A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS collapsed FROM documents WHERE text IS NOT NULL")
def whitespace_collapse(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(S.collapse_space(F.col("text"))).alias("collapsed"))


@register("SELECT doc_id, length(text) AS chars, md5(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 800) || chr(10) || '[... ' || (length(text) - 1000) || ' chars omitted ...]' || chr(10) || right(text, 200) END) AS shown FROM documents WHERE text IS NOT NULL")
def head_tail_truncate(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length("text").alias("chars"), F.md5(S.head_tail(F.col("text"), 1000)).alias("shown"))


@register(r"WITH p AS (SELECT id, CAST(regexp_extract(text_repr, '(?i)\((?:pdf), *([0-9]+) pages\)', 1) AS VARCHAR) AS n, text_repr FROM artifacts WHERE type = 'document') SELECT id AS artifact_id, TRY_CAST(n AS INT) AS pages, length(regexp_replace(text_repr, '[ \n\r\t\f\v]', '', 'g')) < 25 * TRY_CAST(n AS INT) AS needs_ocr FROM p WHERE n <> ''")
def needs_ocr(spark, d):  # noqa: ANN001, ANN201
    n = F.regexp_extract("text_repr", r"(?i)\((?:pdf), *([0-9]+) pages\)", 1)
    p = table(spark, d, "artifacts").filter("type = 'document'").select(F.col("id").alias("artifact_id"), n.try_cast("int").alias("pages"), F.length(F.regexp_replace("text_repr", r"[ \n\r\t\f\x0B]", "")).alias("chars"))
    return p.filter("pages IS NOT NULL").select("artifact_id", "pages", (F.col("chars") < model.OCR_CHARS_A_PAGE * F.col("pages")).alias("needs_ocr"))


HANDLE_SQL = annotate.HANDLE.replace("'", "''")
KEY_SQL = f"CASE WHEN contains(token, '@') THEN 'email:' || {NORM.format('token')} WHEN length({DIGITS.format('token')}) >= 7 THEN 'phone:' || {DIGITS.format('token')} END"


@register(f"""WITH {ALIASES}, t AS (SELECT id, regexp_extract_all(text_repr, '{HANDLE_SQL}') AS toks, regexp_split_to_array(text_repr, '{HANDLE_SQL}') AS parts FROM artifacts),
 u AS (SELECT id, parts, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM t), k AS (SELECT id, token, i, parts, {KEY_SQL} AS key FROM u),
 o AS (SELECT DISTINCT k.id, k.token, l.entity_id FROM k JOIN a ON a.alias_type || ':' || a.alias = k.key AND a.alias_type IN ('email', 'phone') JOIN entity_links l ON l.artifact_id = k.id AND l.entity_id = a.entity_id),
 n AS (SELECT id, token, min(entity_id) AS entity_id FROM o GROUP BY id, token HAVING count(*) = 1), m AS (SELECT n.id, token, canonical_name FROM n JOIN entities e ON e.id = n.entity_id)
 SELECT k.id AS artifact_id, string_agg(parts[i] || COALESCE(canonical_name || ' (' || k.token || ')', k.token), '' ORDER BY i) || first(parts[len(parts)]) AS display_text FROM k LEFT JOIN m ON m.id = k.id AND m.token = k.token WHERE k.id IN (SELECT id FROM m) GROUP BY k.id""")
def handle_annotation(spark, d):  # noqa: ANN001, ANN201
    return annotate.annotated(*tables(spark, d, "artifacts", "entity_links", "entities", "entity_aliases"))


@register(f"WITH p AS (SELECT DISTINCT entity_id, alias, {DIGITS.format('alias')} AS phone FROM entity_aliases WHERE alias_type = 'phone'), b AS (SELECT DISTINCT entity_id, phone FROM p WHERE alias <> phone AND length(phone) >= 7 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.entity_id = p.entity_id AND q.alias = p.phone)) SELECT entity_id, phone, EXISTS (SELECT 1 FROM p q WHERE q.alias = b.phone AND q.entity_id <> b.entity_id) AS collides FROM b")
def backfill_phones(spark, d):  # noqa: ANN001, ANN201
    return graph.phones_to_add(table(spark, d, "entity_aliases"))


@register("SELECT type, count(*) AS artifacts, count(*) FILTER (id IN (SELECT artifact_id FROM vec_artifacts WHERE len(embedding) = 64)) AS with_vector FROM artifacts GROUP BY type")
def vector_coverage(spark, d):  # noqa: ANN001, ANN201
    art, vec = tables(spark, d, "artifacts", "vec_artifacts")
    v = vec.filter(F.size("embedding") == 64).select(F.col("artifact_id").alias("id")).distinct().withColumn("has", F.lit(1))
    return art.select("id", "type").join(v, "id", "left").groupBy("type").agg(F.count("*").alias("artifacts"), F.count("has").alias("with_vector"))


@register(f"WITH {ALIASES}, s AS (SELECT alias_type, alias, count(DISTINCT entity_id) AS n FROM a GROUP BY 1, 2) SELECT alias_type, count(*) AS aliases, count(*) FILTER (n > 1) AS conflicts, max(n) AS most FROM s GROUP BY 1")
def alias_conflicts(spark, d):  # noqa: ANN001, ANN201
    s = graph.normal_aliases(table(spark, d, "entity_aliases")).groupBy("alias_type", "alias").agg(F.count("*").alias("n"))
    return s.groupBy("alias_type").agg(F.count("*").alias("aliases"), F.count(F.when(F.col("n") > 1, 1)).alias("conflicts"), F.max("n").alias("most"))
