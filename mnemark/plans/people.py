"""Registered queries of the entity graph's changes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemark.functions import scalars as S
from mnemark.operators import graph
from mnemark.plans.archive import ALIASES, DIGITS, NORM, QUERIES, SQL, register, tables
from mnemark.session import table

# Employers as relations, made where they are missing.
ORG_SQL = f"""{ALIASES}, p AS (SELECT id AS f, {NORM.format("json_extract_string(attrs_json, '$.org')")} AS name FROM entities WHERE kind = 'person' AND merged_into IS NULL AND json_valid(attrs_json)),
 o AS (SELECT name, min(a.entity_id) AS t FROM (SELECT DISTINCT name FROM p WHERE name <> '') LEFT JOIN a ON a.alias = name GROUP BY name),
 w AS (SELECT name, COALESCE(t, (SELECT max(id) FROM entities) + CAST(row_number() OVER (PARTITION BY t IS NULL ORDER BY substr(name, 1, 2), name) AS BIGINT)) AS t, t IS NULL AS made FROM o),
 r AS (SELECT DISTINCT f, t, made FROM p JOIN w USING (name) WHERE f <> t)"""


@register(f"WITH {ORG_SQL} SELECT f AS from_entity_id, t AS to_entity_id, 'worksAt' AS relation_type, 'employer' AS raw_label, made FROM r")
def works_at(spark, d):  # noqa: ANN001, ANN201
    return graph.works_at(*tables(spark, d, "entities", "entity_aliases"))


# Relation hints: what the sender of a message calls its recipients.
LABELS = ["friend", "Manager", "wife", "brother", "colleague", "mom", "referred by"]
LABEL_SQL = "(CASE artifact_id % 7 WHEN 0 THEN 'friend' WHEN 1 THEN 'Manager' WHEN 2 THEN 'wife' WHEN 3 THEN 'brother' WHEN 4 THEN 'colleague' WHEN 5 THEN 'mom' ELSE 'referred by' END)"
TYPE_SQL = "(CASE label WHEN 'friend' THEN 'friend' WHEN 'Manager' THEN 'manager' WHEN 'wife' THEN 'spouse' WHEN 'brother' THEN 'brother' WHEN 'mom' THEN 'mother' WHEN 'referred by' THEN 'referredBy' ELSE 'custom' END)"
PARTS = r"regexp_split_to_array(trim(canonical_name), '\s+')"
STAGED_SQL = rf"""hn AS (SELECT DISTINCT artifact_id, canonical_name, {LABEL_SQL} AS label FROM entity_links JOIN entities ON id = entity_id AND kind = 'person' WHERE role = 'recipient'),
 sr AS (SELECT artifact_id, {NORM.format('canonical_name')} AS alias, label FROM hn UNION SELECT artifact_id, lower({PARTS}[1] || ' ' || {PARTS}[3]), label FROM hn WHERE len({PARTS}) = 3)"""
RELATIONS_SQL = f"""{ALIASES}, {STAGED_SQL}, ab AS (SELECT artifact_id, min(entity_id) AS f FROM entity_links WHERE role = 'sender' GROUP BY 1),
 rr AS (SELECT f, a.entity_id AS t, {TYPE_SQL} AS ty, min(label) AS label FROM sr JOIN ab USING (artifact_id) JOIN a ON a.alias = sr.alias AND a.alias_type = 'name' WHERE f <> a.entity_id GROUP BY ALL)"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    links, ent = tables(spark, d, "entity_links", "entities")
    people = ent.filter("kind = 'person'").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("artifact_id") % len(LABELS) + 1).cast("int"))
    return graph.staged_relations(links.filter("role = 'recipient'").join(people, "entity_id").select("artifact_id", "name", label.alias("label")))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    al, links = tables(spark, d, "entity_aliases", "entity_links")
    return graph.resolved_relations(_staged(spark, d), al, links, "sender")


@register(f"WITH {STAGED_SQL} SELECT alias, label, count(*) AS times FROM sr WHERE alias <> '' GROUP BY ALL")
def relation_staging(spark, d):  # noqa: ANN001, ANN201
    return _staged(spark, d).groupBy("alias", "label").agg(F.count("*").alias("times"))


@register(f"WITH {RELATIONS_SQL} SELECT f AS from_entity_id, t AS to_entity_id, ty AS relation_type, label AS raw_label FROM rr")
def relation_resolution(spark, d):  # noqa: ANN001, ANN201
    return _relations(spark, d)


@register(f"WITH {RELATIONS_SQL}, b AS (SELECT f AS entity_id, 'out' AS direction, ty, t AS other_id FROM rr UNION ALL SELECT t, 'in', ty, f FROM rr) SELECT entity_id, direction, ty AS relation_type, other_id, canonical_name AS other_name FROM b JOIN entities ON id = other_id")
def relations_in_out(spark, d):  # noqa: ANN001, ANN201
    return graph.relations_both_ways(_relations(spark, d), table(spark, d, "entities"))


@register(f"""WITH {RELATIONS_SQL}, lv AS (SELECT id FROM entities WHERE merged_into IS NULL), pa AS (SELECT DISTINCT l.entity_id AS f, m.entity_id AS t FROM entity_links l JOIN entity_links m USING (artifact_id) WHERE l.role = 'author' AND m.role = 'mentioned')
 SELECT pa.f AS from_entity_id, pa.t AS to_entity_id, 'manager' AS relation_type, 'manager' AS raw_label, CASE WHEN NOT EXISTS (SELECT 1 FROM lv WHERE id = pa.f) OR NOT EXISTS (SELECT 1 FROM lv WHERE id = pa.t) THEN 'not found' WHEN pa.f = pa.t THEN 'self' WHEN EXISTS (SELECT 1 FROM rr WHERE rr.f = pa.f AND rr.t = pa.t AND rr.ty = 'manager') THEN 'exists' ELSE 'added' END AS outcome FROM pa""")
def relation_adding(spark, d):  # noqa: ANN001, ANN201
    links, ent = tables(spark, d, "entity_links", "entities")
    side = lambda role, c: links.filter(F.col("role") == role).select("artifact_id", F.col("entity_id").alias(c)).distinct()
    wanted = side("author", "from_entity_id").join(side("mentioned", "to_entity_id"), "artifact_id").select("from_entity_id", "to_entity_id", F.lit(" ").alias("relation_type"), F.lit("manager").alias("raw_label"))
    return graph.added_relations(_relations(spark, d), wanted, ent)


MERGED_SQL = "mc AS (SELECT id, merged_into AS keep, 1 AS n FROM entities WHERE merged_into IS NOT NULL UNION ALL SELECT mc.id, e.merged_into, n + 1 FROM mc JOIN entities e ON e.id = mc.keep WHERE e.merged_into IS NOT NULL AND n < 50), mm AS (SELECT id, last(keep ORDER BY n) AS keep FROM mc GROUP BY id)"


@register(f"WITH RECURSIVE {MERGED_SQL} SELECT DISTINCT COALESCE(keep, entity_id) AS entity_id, alias, alias_type FROM entity_aliases LEFT JOIN mm ON id = entity_id")
def merged_aliases(spark, d):  # noqa: ANN001, ANN201
    return graph.merged_aliases(*tables(spark, d, "entity_aliases", "entities"))


@register(f"WITH RECURSIVE {MERGED_SQL}, {RELATIONS_SQL}, x AS (SELECT COALESCE(m1.keep, f) AS f, COALESCE(m2.keep, t) AS t, ty, label FROM rr LEFT JOIN mm m1 ON m1.id = f LEFT JOIN mm m2 ON m2.id = t) SELECT f AS from_entity_id, t AS to_entity_id, ty AS relation_type, min(label) AS raw_label FROM x WHERE f <> t GROUP BY ALL")
def merged_relations(spark, d):  # noqa: ANN001, ANN201
    return graph.merged_relations(_relations(spark, d), table(spark, d, "entities"))


@register(f"""WITH RECURSIVE {MERGED_SQL}, {RELATIONS_SQL}, k AS (SELECT keep, count(*) AS absorbed FROM mm GROUP BY 1), x AS (SELECT m1.keep AS k1, m2.keep AS k2, COALESCE(m1.keep, f) AS f, COALESCE(m2.keep, t) AS t FROM rr LEFT JOIN mm m1 ON m1.id = f LEFT JOIN mm m2 ON m2.id = t),
 y AS (SELECT k1 AS keep FROM x WHERE f <> t AND k1 IS NOT NULL UNION ALL SELECT k2 FROM x WHERE f <> t AND k2 IS NOT NULL)
 SELECT keep AS entity_id, absorbed, (SELECT count(*) FROM entity_aliases JOIN mm ON id = entity_id WHERE mm.keep = k.keep) AS aliases, (SELECT count(*) FROM entity_links JOIN mm ON id = entity_id WHERE mm.keep = k.keep) AS links, (SELECT count(*) FROM y WHERE y.keep = k.keep) AS relations FROM k""")
def merge_summary(spark, d):  # noqa: ANN001, ANN201
    ent, al, links = tables(spark, d, "entities", "entity_aliases", "entity_links")
    return graph.merge_summary(ent, al, links, _relations(spark, d))


DUPLICATES_SQL = f"""{ALIASES}, s AS (SELECT entity_id, alias_type, alias, min(entity_id) OVER (PARTITION BY alias_type, alias) AS c FROM a JOIN entities ON id = entity_id AND kind = 'person' AND merged_into IS NULL WHERE alias_type = 'email' OR alias_type = 'phone' AND length(alias) >= 7),
 n AS (SELECT {NORM.format('canonical_name')} AS n, id, min(id) OVER (PARTITION BY {NORM.format('canonical_name')}) AS c FROM entities WHERE kind = 'person' AND merged_into IS NULL), f AS (SELECT DISTINCT n, c FROM n WHERE n <> ''),
 e AS (SELECT c AS x, entity_id AS y, CASE alias_type WHEN 'phone' THEN 0.9 ELSE 0.95 END::DOUBLE AS s, CASE alias_type WHEN 'phone' THEN 1 ELSE 2 END AS o, 'same ' || alias_type AS reason FROM s WHERE entity_id <> c
  UNION ALL SELECT c, id, 1.0::DOUBLE, 3, 'similar name' FROM n WHERE id <> c AND n <> '' UNION ALL SELECT least(p.c, q.c), greatest(p.c, q.c), round(1 - levenshtein(p.n, q.n)::DOUBLE / greatest(length(p.n), length(q.n)), 6), 3, 'similar name' FROM f p JOIN f q ON p.n < q.n WHERE 1 - levenshtein(p.n, q.n)::DOUBLE / greatest(length(p.n), length(q.n)) >= 0.8 - 1e-9),
 u AS (SELECT x, y, o, reason, max(s) AS s FROM e GROUP BY ALL), dup AS (SELECT x, y, floor(max(s) * 100 + 0.5) / 100 AS score, string_agg(reason, ', ' ORDER BY o) AS reasons FROM u GROUP BY x, y)"""


@register(f"WITH {DUPLICATES_SQL}, vv AS (SELECT entity_id, first(embedding::DOUBLE[] ORDER BY artifact_id, embedding) AS e FROM vec_artifacts JOIN (SELECT DISTINCT artifact_id, entity_id FROM entity_links WHERE role = 'self') USING (artifact_id) GROUP BY 1) SELECT x AS entity_id_a, y AS entity_id_b, score, reasons, CAST(CASE WHEN len(v1.e) = len(v2.e) AND list_dot_product(v1.e, v1.e) > 0 AND list_dot_product(v2.e, v2.e) > 0 AND NOT isnan(list_sum(v1.e) + list_sum(v2.e)) THEN round(list_cosine_similarity(v1.e, v2.e) * 100) END AS INT) AS similarity FROM dup LEFT JOIN vv v1 ON v1.entity_id = x LEFT JOIN vv v2 ON v2.entity_id = y")
def duplicate_ranked(spark, d):  # noqa: ANN001, ANN201
    ent, al, links, vec = tables(spark, d, "entities", "entity_aliases", "entity_links", "vec_artifacts")
    pairs = graph.probable_duplicates(ent, al)
    return graph.with_text_similarity(pairs, links, vec).orderBy(F.desc("score"), "entity_id_a", "entity_id_b")


# Alias events: a user's events by their k, of which two kinds stand for derived aliases, one for a removal and the others for additions.
EVENT_SQL = "ae AS (SELECT event_id AS seq, user_id AS entity_id, json_extract_string(props, '$.k') AS alias, CASE WHEN event_type IN ('signup', 'view') THEN 'derived' WHEN event_type = 'error' THEN 'removed' ELSE 'added' END AS act FROM events), ls AS (SELECT entity_id, alias, last(act ORDER BY seq) FILTER (act <> 'derived') AS last FROM ae GROUP BY ALL)"


def _alias_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    act = F.when(kind.isin("signup", "view"), "derived").when(kind == "error", "removed").otherwise("added")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), F.get_json_object("props", "$.k").alias("alias"), F.lit("handle").alias("alias_type"), act.alias("action"))


@register(f"WITH {EVENT_SQL} SELECT entity_id, alias, CASE WHEN last = 'removed' THEN 'tombstone' ELSE 'alias' END AS state FROM ls")
def alias_fold(spark, d):  # noqa: ANN001, ANN201
    aliases, tombstones = graph.alias_state(_alias_events(spark, d))
    state = lambda df, x: df.select("entity_id", "alias", F.lit(x).alias("state"))
    return state(aliases, "alias").unionByName(state(tombstones, "tombstone"))


@register(f"""WITH {ALIASES}, p AS (SELECT id, CASE WHEN json_type(attrs_json, '$.emails') = 'ARRAY' THEN CAST(json_extract_string(attrs_json, '$.emails[*]') AS VARCHAR[]) END AS e, CASE WHEN json_type(attrs_json, '$.phones') = 'ARRAY' THEN CAST(json_extract_string(attrs_json, '$.phones[*]') AS VARCHAR[]) END AS ph FROM entities WHERE kind = 'person' AND json_valid(attrs_json)),
 w AS (SELECT id, 'email' AS ty, {NORM.format('x')} AS alias FROM (SELECT id, unnest(e) AS x FROM p) UNION SELECT id, 'phone', {DIGITS.format('x')} FROM (SELECT id, unnest(ph) AS x FROM p)), c AS (SELECT w.id, min(a.entity_id) AS conflict FROM w JOIN a ON a.alias = w.alias AND a.alias_type = w.ty GROUP BY 1) SELECT p.id AS key, conflict FROM p LEFT JOIN c ON c.id = p.id""")
def create_conflicts(spark, d):  # noqa: ANN001, ANN201
    ent, al = tables(spark, d, "entities", "entity_aliases")
    listed = lambda f: F.from_json(F.get_json_object("attrs_json", f"$.{f}"), "array<string>")
    wanted = ent.filter("kind = 'person'").filter(F.try_parse_json("attrs_json").isNotNull()).select(F.col("id").alias("key"), listed("emails").alias("emails"), listed("phones").alias("phones"))
    return graph.create_conflicts(wanted, al).select("key", "conflict")


@register(rf"WITH {ALIASES}, t AS (SELECT id, canonical_name, regexp_split_to_array(trim(canonical_name), '\s+') AS t FROM entities WHERE kind = 'person' AND merged_into IS NULL), r AS (SELECT id, canonical_name, t[1] || ' ' || t[3] AS reduced FROM t WHERE len(t) = 3) SELECT id AS entity_id, canonical_name AS name, reduced FROM r WHERE canonical_name <> reduced AND NOT EXISTS (SELECT 1 FROM a WHERE a.alias = lower(reduced) AND a.entity_id <> r.id)")
def reduce_display_name(spark, d):  # noqa: ANN001, ANN201
    return graph.names_to_reduce(*tables(spark, d, "entities", "entity_aliases"))


DIRECTORY_SQL = f"dr AS (SELECT alias_type AS handle_type, CASE WHEN alias_type = 'phone' THEN {DIGITS.format('alias')} ELSE {NORM.format('alias')} END AS handle, first(canonical_name ORDER BY id) AS name FROM entity_aliases JOIN entities ON id = entity_id WHERE kind = 'person' AND alias_type IN ('email', 'phone') GROUP BY 1, 2 HAVING handle <> '')"


def _directory(spark: SparkSession, d: str) -> DataFrame:
    ent, al = tables(spark, d, "entities", "entity_aliases")
    people = ent.filter("kind = 'person'").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"))
    return graph.directory(al.filter("alias_type IN ('email', 'phone')").join(people, "entity_id").select(F.col("entity_id").alias("seq"), "name", F.col("alias").alias("handle"), F.col("alias_type").alias("handle_type")))


@register(f"WITH {DIRECTORY_SQL} SELECT handle, handle_type, name FROM dr")
def directory_load(spark, d):  # noqa: ANN001, ANN201
    return _directory(spark, d)


@register(f"""WITH {ALIASES}, {DIRECTORY_SQL}, cu AS (SELECT alias, alias_type FROM a JOIN entities ON id = a.entity_id AND merged_into IS NOT NULL), st AS (SELECT artifact_id, CASE WHEN alias_type = 'phone' THEN {DIGITS.format('alias')} ELSE {NORM.format('alias')} END AS alias, alias_type FROM entity_links JOIN entity_aliases USING (entity_id) WHERE role = 'mentioned' AND alias_type IN ('email', 'phone'))
 SELECT st.alias, st.alias_type, name, count(*) AS times, min(artifact_id) AS first_artifact FROM st JOIN dr ON dr.handle = st.alias AND dr.handle_type = st.alias_type WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.alias = st.alias AND cu.alias_type = st.alias_type) GROUP BY ALL""")
def directory_proposals(spark, d):  # noqa: ANN001, ANN201
    """Handles of the persons mentioned, against the aliases of merged entities as the ones known by now."""
    ent, al, links = tables(spark, d, "entities", "entity_aliases", "entity_links")
    staged = links.filter("role = 'mentioned'").join(al.filter("alias_type IN ('email', 'phone')"), "entity_id")
    staged = staged.select("artifact_id", F.when(F.col("alias_type") == "phone", S.norm_phone(F.col("alias"))).otherwise(S.norm_name(F.col("alias"))).alias("alias"), "alias_type")
    known = al.join(ent.filter("merged_into IS NOT NULL").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return graph.directory_proposals(staged, _directory(spark, d), known)


@register(f"""WITH {RELATIONS_SQL}, n AS (SELECT entity_id, count(*) AS n FROM a GROUP BY 1), l AS (SELECT entity_id, count(*) AS n FROM (SELECT DISTINCT artifact_id, entity_id, role FROM entity_links) GROUP BY 1), o AS (SELECT f, count(*) AS n FROM rr GROUP BY 1), i AS (SELECT t, count(*) AS n FROM rr GROUP BY 1)
 SELECT id AS entity_id, kind, canonical_name, COALESCE(n.n, 0) AS aliases, COALESCE(l.n, 0) AS artifacts, COALESCE(o.n, 0) AS out_relations, COALESCE(i.n, 0) AS in_relations FROM entities LEFT JOIN n ON n.entity_id = id LEFT JOIN l ON l.entity_id = id LEFT JOIN o ON o.f = id LEFT JOIN i ON i.t = id WHERE merged_into IS NULL""")
def about_profile(spark, d):  # noqa: ANN001, ANN201
    ent, al, links = tables(spark, d, "entities", "entity_aliases", "entity_links")
    return graph.profiles(ent, al, links, _relations(spark, d))


@register("""WITH m AS (SELECT * FROM entities WHERE merged_into IS NULL AND kind = 'person' AND (contains(lower(canonical_name), 'an') OR id IN (SELECT entity_id FROM entity_aliases WHERE contains(lower(alias), 'an'))) ORDER BY lower(canonical_name), id LIMIT 50 OFFSET 20)
 SELECT id AS entity_id, kind, canonical_name, id IN (SELECT entity_id FROM entity_links JOIN artifacts ON artifacts.id = artifact_id WHERE role IN ('self', 'pictured') AND raw_path IS NOT NULL AND type = 'photo') AS has_photo FROM m""")
def entity_page(spark, d):  # noqa: ANN001, ANN201
    ent, al, links, art = tables(spark, d, "entities", "entity_aliases", "entity_links", "artifacts")
    return graph.listed(ent, al, links, art, "person", "AN", 50, 20)


__all__ = ["QUERIES", "SQL"]
