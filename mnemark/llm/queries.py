"""Registered queries of the operators for language-model training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemark.llm import copies, leaks, mixing, neighbours, personal, scans, subjects, survivors
from mnemark.session import table


def _lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "entities").filter("kind = 'person'")
    aliases = table(spark, sf_dir, "entity_aliases").filter("alias_type = 'name'").join(people.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return personal.name_table(people.select(F.col("canonical_name").alias("name")).unionByName(aliases.select(F.col("alias").alias("name"))), "name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal.found(table(spark, sf_dir, "artifacts"), "id", "text_repr", _lexicons(spark, sf_dir))
    return out.select(F.col("id").alias("artifact_id"), "pii_type", "pii_text")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(table(spark, sf_dir, "artifacts"), "id", "text_repr", _lexicons(spark, sf_dir))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(*(table(spark, sf_dir, t) for t in ("entities", "entity_aliases", "source_profiles")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.same_person_pairs(_people(spark, sf_dir))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_records(_people(spark, sf_dir))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "artifacts").filter((F.col("type") == "document") & F.col("text_repr").rlike(r"(?i)^\W*document\s*\("))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(_scanned(spark, sf_dir), "id", "text_repr").select(F.col("id").alias("artifact_id"), "noise_type", "noise_text")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(_scanned(spark, sf_dir), "id", "text_repr").select(F.col("id").alias("artifact_id"), "repaired")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.knn(table(spark, sf_dir, "vec_artifacts"), "artifact_id", "embedding")
    return neighbours.neighbour_pairs(near).select(F.col("a").alias("artifact_id_a"), F.col("b").alias("artifact_id_b"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_pairs(table(spark, sf_dir, "artifacts"), "id", "text_repr")


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(table(spark, sf_dir, "artifacts"), "id", "text_repr")[1].select("first_id", "copies")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(*(table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subject_list"))).distinct()


# Canonical form in SQL: letters and digits alone; a record's fields sorted.
CANON_SQL = """
WITH t AS (SELECT id, text_repr AS x, regexp_split_to_array(trim(regexp_replace(text_repr, '^[\\s{]+|[\\s}]+$', '', 'g')), '[;|\\n]|",') AS parts FROM artifacts WHERE text_repr IS NOT NULL),
u AS (SELECT id, x, list_filter(parts, lambda p: regexp_replace(p, '[\\s",]', '', 'g') <> '') AS parts FROM t),
f AS (SELECT id, x, parts, len(parts) >= 3 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^[^\\p{L}\\p{N}]*[\\p{L}_][\\p{L}\\p{N}_]*["\\s]*[:=]'))) = 0 AS is_record FROM u),
c AS (SELECT id, CASE WHEN is_record THEN list_aggregate(list_sort(list_transform(parts, lambda p: regexp_replace(replace(replace(replace(lower(p), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[^\\p{L}\\p{N}:]', '', 'g'))), 'string_agg', '|')
  ELSE regexp_replace(replace(replace(replace(lower(x), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[^\\p{L}\\p{N}]', '', 'g') END AS k FROM f)
"""
P7_FOUND_SQL = CANON_SQL + "SELECT first_id, id AS copy_id FROM (SELECT DISTINCT id, min(id) OVER (PARTITION BY k) AS first_id FROM c) WHERE id <> first_id"
P7_RECORDS_SQL = CANON_SQL + "SELECT min(id) AS first_id, count(*) AS copies FROM c GROUP BY k"

_USABLE = "lower(trim({0})) NOT IN ('', '-', '--', '?', 'n/a', 'na', 'none', 'null', 'unknown', 'tbd', 'unbekannt', 'inconnu', 'desconocido')"
_ATTR = "COALESCE(CASE WHEN json_valid(attrs_json) THEN json_extract_string(attrs_json, '$.{0}') END, nullif(regexp_extract(attrs_json, '\"{0}\": *\"([^\"]*)\"', 1), ''))"
_LIST = "regexp_extract_all(regexp_extract(attrs_json, '\"{0}\": *\\[([^\\]]*)\\]', 1), '\"([^\"]*)\"', 1)"
_MAIL = "regexp_replace(lower(trim({0})), '^<?\\s*(?:mailto:)?\\s*|\\s*>?\\s*$', '', 'g')"
_PHONE = "regexp_replace(regexp_replace({0}, '\\D', '', 'g'), '^1(\\d{{10}})$', '\\1')"
P3_FOUND_SQL = f"""
WITH RECURSIVE n AS (SELECT id, attrs_json, merged_into, strip_accents(lower(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g')))) AS nm FROM entities WHERE kind = 'person'),
p AS (SELECT id, attrs_json, merged_into, CASE WHEN contains(nm, ',') OR contains(nm, ' ') THEN regexp_extract(CASE WHEN contains(nm, ',') THEN trim(regexp_replace(nm, '^[^,]*,', '')) ELSE nm END, '^([\\p{{L}}''’-]+)', 1) END AS given FROM n),
raw AS (SELECT id, 'e' AS kind, {_MAIL.format('c')} AS k FROM (SELECT id, unnest({_LIST.format('emails')}) AS c FROM p) UNION SELECT id, 'p', {_PHONE.format('c')} FROM (SELECT id, unnest({_LIST.format('phones')}) AS c FROM p)
  UNION SELECT p.id, CASE WHEN alias_type = 'email' THEN 'e' ELSE 'p' END, CASE WHEN alias_type = 'email' THEN {_MAIL.format('alias')} ELSE {_PHONE.format('alias')} END FROM entity_aliases JOIN p ON p.id = entity_id WHERE alias_type IN ('email', 'phone')),
c AS (SELECT DISTINCT id, kind, k, given FROM raw JOIN p USING (id) WHERE (kind = 'e' AND regexp_matches(k, '^[^@\\s]+@[^@\\s]+$')) OR (kind = 'p' AND length(k) >= 7 AND NOT regexp_matches(k, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$'))),
f AS (SELECT *, CASE WHEN length(given) > 1 THEN given END AS full_name FROM c WHERE kind = 'p' AND given <> ''),
i AS (SELECT k, given[1] AS ini, min(full_name) AS lo, max(full_name) AS hi FROM f GROUP BY 1, 2),
m AS (SELECT id, 'e' || k AS key FROM c WHERE kind = 'e' UNION SELECT id, 'p' || f.k || '|' || COALESCE(full_name, CASE WHEN lo IS NULL THEN ini WHEN lo = hi THEN lo END) FROM f JOIN i ON i.k = f.k AND i.ini = f.given[1] WHERE COALESCE(full_name, CASE WHEN lo IS NULL THEN ini WHEN lo = hi THEN lo END) IS NOT NULL),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM m a JOIN m b USING (key) WHERE a.id <> b.id),
r AS (SELECT id, id AS other FROM p UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
g AS (SELECT id, min(other) AS grp FROM r GROUP BY id),
l AS (SELECT p.id, grp, TRY_CAST(replace({_ATTR.format('updated_at')}, 'Z', '') AS TIMESTAMP) AS changed, trust_rank,
  {' + '.join(f"CASE WHEN {_USABLE.format(_ATTR.format(x))} THEN 1 ELSE 0 END" for x in survivors.FIELDS)} + CASE WHEN len(list_filter(list_transform({_LIST.format('emails')}, lambda x: {_MAIL.format('x')}), lambda x: regexp_matches(x, '^[^@\\s]+@[^@\\s]+$'))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(list_transform({_LIST.format('phones')}, lambda x: {_PHONE.format('x')}), lambda x: length(x) >= 7)) > 0 THEN 1 ELSE 0 END AS filled
  FROM p JOIN g USING (id) LEFT JOIN source_profiles s ON s.source = {_ATTR.format('source')} WHERE merged_into IS NULL),
t AS (SELECT grp, first(id ORDER BY changed DESC NULLS LAST, filled DESC, trust_rank NULLS LAST, id) AS keep_id FROM l GROUP BY grp)
SELECT a.id AS entity_id_a, b.id AS entity_id_b, keep_id FROM l a JOIN l b ON a.grp = b.grp AND a.id < b.id JOIN t ON t.grp = a.grp
"""
QUERIES = {"p3_found": p3_found, "p3_records": p3_records, "p2_found": p2_found, "p2_redacted": p2_redacted, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p7_found": p7_found, "p7_records": p7_records, "p8_found": p8_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found}
SQL = {"p3_found": P3_FOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_records": P7_RECORDS_SQL}
