"""The entity graph: aliases, hints, links, relations and merges, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mnemark import model
from mnemark.functions import scalars as S
from mnemark.session import cut, join_hot


def live(entities: DataFrame) -> DataFrame:
    return entities.filter("merged_into IS NULL")


def normal_aliases(aliases: DataFrame) -> DataFrame:
    """(entity_id, alias, alias_type), distinct: phones as digits, the rest trimmed and lower-cased; empty ones left out."""
    a = F.when(F.col("alias_type") == "phone", S.norm_phone(F.col("alias"))).otherwise(S.norm_name(F.col("alias")))
    return aliases.select("entity_id", a.alias("alias"), "alias_type").filter("alias <> ''").distinct()


def resolve(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, entity_id): every alias of any type that equals the term, or a phone alias its digits if it has seven or more."""
    a = normal_aliases(aliases)
    t = terms.select("term").distinct()
    digits = S.norm_phone(F.col("term"))
    keys = t.select("term", S.norm_name(F.col("term")).alias("alias")).unionByName(t.filter(F.length(digits) >= model.PHONE_DIGITS).select("term", digits.alias("alias")))
    return keys.join(a.select("alias", "entity_id").distinct(), "alias").select("term", "entity_id").distinct()


def resolve_prefix(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, entity_id) for terms that begin, up to a space, the name aliases of exactly one entity. Names are exploded into their
    beginnings, so this is an equi-join."""
    names = normal_aliases(aliases).filter("alias_type = 'name'").select("entity_id", F.split("alias", " ").alias("t")).filter(F.size("t") > 1)
    starts = names.select("entity_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda n: F.array_join(F.slice("t", F.lit(1), n), " "))).alias("start"))
    one = starts.groupBy("start").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("hi")).filter("entity_id = hi")
    return terms.select("term", S.norm_name(F.col("term")).alias("start")).distinct().join(one, "start").select("term", "entity_id")


def link_hints(hints: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From hints (artifact_id, alias, alias_type, role, supplied): links (artifact_id, entity_id, role, confidence), one per key, the
    surest first; and the hints that no alias of their type has, to be staged."""
    a = normal_aliases(aliases)
    h = hints.withColumn("alias", F.when(F.col("alias_type") == "phone", S.norm_phone(F.col("alias"))).otherwise(S.norm_name(F.col("alias"))))
    # A name that a tenth of all hints bear has its hints in several tasks.
    h = cut(h.withColumn("k", F.concat_ws("|", "alias_type", "alias")))
    whose = a.groupBy(F.concat_ws("|", "alias_type", "alias").alias("k")).agg(F.collect_set("entity_id").alias("owners"))
    whose = h.groupBy("k").agg(F.count("*").alias("n")).join(whose, "k")
    hit = join_hot(h, whose, "k", "n", F.col("artifact_id"), h.count()).withColumn("entity_id", F.explode("owners")).withColumn("confidence", S.hint_confidence(F.col("alias_type"), F.col("supplied")))
    links = hit.groupBy("artifact_id", "entity_id", "role").agg(F.max("confidence").alias("confidence"))
    missed = h.select("k", "alias", "alias_type").distinct().join(a.select("alias", "alias_type"), ["alias", "alias_type"], "left_anti").select("k")
    sizes = h.groupBy("k").agg(F.count("*").alias("n")).join(missed, "k")
    return links, join_hot(h, sizes, "k", "n", F.col("artifact_id"), h.count()).drop("k", "n")


RELATION_KEY = ["from_entity_id", "to_entity_id", "relation_type"]


def ensured(names: DataFrame, aliases: DataFrame, next_id: int) -> DataFrame:
    """(name, entity_id, made): the entity that has each normalised name as an alias of any type, the smallest id, or else a new one.
    New ids follow the names' order from next_id on: names are counted by their first two letters before, so no task sorts all."""
    n = names.select(S.norm_name(F.col("name")).alias("name")).filter("name <> ''").distinct()
    known = normal_aliases(aliases).groupBy(F.col("alias").alias("name")).agg(F.min("entity_id").alias("entity_id"))
    both = cut(n.join(known, "name", "left").withColumn("p", F.substring("name", 1, 2)))
    new = both.filter("entity_id IS NULL").select("name", "p")
    before = new.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per pair of letters
    made = new.join(F.broadcast(before), "p").withColumn("entity_id", F.col("before") + F.row_number().over(W.partitionBy("p").orderBy("name")) - 1 + next_id)
    return both.filter("entity_id IS NOT NULL").select("name", "entity_id", F.lit(False).alias("made")).unionByName(made.select("name", "entity_id", F.lit(True).alias("made")))


def works_at(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(from_entity_id, to_entity_id, relation_type, raw_label, made): live persons' org as an edge to the entity of that name, which is
    made where there is none; no self edges. Null, broken or empty attributes give none."""
    people = live(entities).filter("kind = 'person'").select(F.col("id").alias("from_entity_id"), S.norm_name(F.get_json_object("attrs_json", "$.org")).alias("name")).filter("name <> ''")
    last = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    to = ensured(people.select("name"), aliases, last + 1).select("name", F.col("entity_id").alias("to_entity_id"), "made")
    return people.join(to, "name").filter("from_entity_id <> to_entity_id").select("from_entity_id", "to_entity_id", S.relation_type(F.lit("employer")).alias("relation_type"), F.lit("employer").alias("raw_label"), "made").distinct()


def staged_relations(hints: DataFrame) -> DataFrame:
    """From hints (artifact_id, name, label): (artifact_id, alias, label) of the normalised name and, where it has exactly three parts,
    of its first and last one too. Empty names and labels give none; repeated hints one."""
    return hints.filter("label IS NOT NULL").select("artifact_id", F.explode(S.name_variants(F.col("name"))).alias("alias"), "label").distinct()


def resolved_relations(staged: DataFrame, aliases: DataFrame, links: DataFrame, role: str = "self") -> DataFrame:
    """(from_entity_id, to_entity_id, relation_type, raw_label): staged relations whose name some entity has as a name alias, from the
    entity that the artifact is about (the smallest id linked in `role`); no self edges, one row per key. A second run gives the same."""
    names = normal_aliases(aliases).filter("alias_type = 'name'").select("alias", F.col("entity_id").alias("to_entity_id"))
    about = links.filter(F.col("role") == role).groupBy("artifact_id").agg(F.min("entity_id").alias("from_entity_id"))
    # Hints are brought to one row a name and artifact before they meet the names, so a name with a tenth of all hints is counted first.
    hit = staged.join(about, "artifact_id").groupBy("from_entity_id", "alias", "label").agg(F.count("*").alias("n")).join(names, "alias").filter("from_entity_id <> to_entity_id")
    return hit.groupBy("from_entity_id", "to_entity_id", S.relation_type(F.col("label")).alias("relation_type")).agg(F.min("label").alias("raw_label"))


def added_relations(relations: DataFrame, wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of `wanted` (from_name or from_entity_id resolved before, to_entity_id, relation_type, raw_label) with `outcome`: added,
    exists, self, or not found. A blank type is that of the label."""
    ids = live(entities).select("id")
    kind = F.coalesce(F.nullif(F.trim("relation_type"), F.lit("")), S.relation_type(F.col("raw_label")))
    w = wanted.withColumn("relation_type", kind).dropDuplicates(RELATION_KEY)
    w = w.join(ids.select(F.col("id").alias("from_entity_id"), F.lit(True).alias("_f")), "from_entity_id", "left").join(ids.select(F.col("id").alias("to_entity_id"), F.lit(True).alias("_t")), "to_entity_id", "left")
    w = w.join(relations.select(*RELATION_KEY, F.lit(True).alias("_e")).distinct(), RELATION_KEY, "left")
    out = F.when(F.col("_f").isNull() | F.col("_t").isNull(), "not found").when(F.col("from_entity_id") == F.col("to_entity_id"), "self").when(F.col("_e"), "exists").otherwise("added")
    return w.withColumn("outcome", out).select(*RELATION_KEY, "raw_label", "outcome")


def relations_both_ways(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, direction, relation_type, other_id, other_name)."""
    e = entities.select(F.col("id").alias("other_id"), F.col("canonical_name").alias("other_name"))
    way = lambda d, a, b: relations.select(F.col(a).alias("entity_id"), F.lit(d).alias("direction"), "relation_type", F.col(b).alias("other_id"))
    return way("out", "from_entity_id", "to_entity_id").unionByName(way("in", "to_entity_id", "from_entity_id")).join(e, "other_id").select("entity_id", "direction", "relation_type", "other_id", "other_name")


def final_ids(entities: DataFrame) -> DataFrame:
    """(id, keep): where each merged entity ends, following chains by doubling: as many rounds as the number of merged rows has binary
    digits reach the end of any chain. What hasn't ended then leads into a cycle, which ends at its smallest id."""
    m = cut(entities.filter("merged_into IS NOT NULL").groupBy("id").agg(F.min("merged_into").alias("keep")).withColumn("low", F.least("id", "keep")))
    going = m.select("id")
    for _ in range(m.count().bit_length() + 1):
        on = m.select(F.col("id").alias("keep"), F.col("keep").alias("next"), F.col("low").alias("next_low"))
        m = cut(m.join(on, "keep", "left").select("id", F.coalesce("next", "keep").alias("keep"), F.least("low", F.coalesce("next_low", "low")).alias("low")))
        going = m.join(m.select(F.col("id").alias("keep")), "keep", "left_semi")
        if not going.limit(1).count():
            return m.select("id", "keep")
    # All ids on a cycle have seen the whole of it, so the one that is reached knows its smallest.
    end = m.select(F.col("id").alias("keep"), F.col("low").alias("end"))
    return m.join(end, "keep", "left").select("id", F.coalesce("end", "keep").alias("keep"))


def merged_aliases(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, alias, alias_type), distinct, with merged entities' aliases at the kept one."""
    to = final_ids(entities)
    return aliases.join(to.select(F.col("id").alias("entity_id"), "keep"), "entity_id", "left").select(F.coalesce("keep", "entity_id").alias("entity_id"), "alias", "alias_type").distinct()


def merged_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with merged entities' ends at the kept ones; edges between entities that become one are dropped, and of edges that fall
    together the smallest label stays."""
    to = final_ids(entities)
    at = lambda end: to.select(F.col("id").alias(end), F.col("keep").alias(f"_{end}"))
    r = relations.join(at("from_entity_id"), "from_entity_id", "left").join(at("to_entity_id"), "to_entity_id", "left")
    r = r.select(F.coalesce("_from_entity_id", "from_entity_id").alias("from_entity_id"), F.coalesce("_to_entity_id", "to_entity_id").alias("to_entity_id"), "relation_type", "raw_label")
    return r.filter("from_entity_id <> to_entity_id").groupBy(*RELATION_KEY).agg(F.min("raw_label").alias("raw_label"))


def merge_summary(entities: DataFrame, aliases: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_id, absorbed, aliases, links, relations): what each kept entity got, counted before rows that fall together become one
    and without the edges between the entities that become one."""
    to = cut(final_ids(entities))
    moved = lambda df, end: df.join(to.select(F.col("id").alias(end), F.col("keep").alias("entity_id_")), end)
    count = lambda df, name: df.groupBy(F.col("entity_id_").alias("entity_id")).agg(F.count("*").alias(name))
    ends = to.select(F.col("id").alias("_i"), F.col("keep").alias("_k"))
    r = relations.join(ends.select(F.col("_i").alias("from_entity_id"), F.col("_k").alias("_fk")), "from_entity_id", "left").join(ends.select(F.col("_i").alias("to_entity_id"), F.col("_k").alias("_tk")), "to_entity_id", "left")
    r = r.filter(F.coalesce("_fk", "from_entity_id") != F.coalesce("_tk", "to_entity_id"))
    r = r.select(F.explode(F.array_compact(F.array("_fk", "_tk"))).alias("entity_id_"))
    out = to.groupBy(F.col("keep").alias("entity_id")).agg(F.count("*").alias("absorbed"))
    for df, name in ((moved(aliases, "entity_id"), "aliases"), (moved(links, "entity_id"), "links"), (r, "relations")):
        out = out.join(count(df, name), "entity_id", "left")
    return out.select("entity_id", "absorbed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("aliases", "links", "relations")))


def merged_links(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(artifact_id, entity_id, role, confidence) with merged entities' links at the kept one; of links that fall together the kept
    entity's own stays, then the surest. A hot entity's rows are combined before the shuffle."""
    to = final_ids(entities)
    moved = links.join(to.select(F.col("id").alias("entity_id"), "keep"), "entity_id", "left").withColumn("own", F.col("keep").isNull())
    order = F.struct("own", F.coalesce("confidence", F.lit(-1.0)))
    return moved.groupBy("artifact_id", F.coalesce("keep", "entity_id").alias("entity_id"), "role").agg(F.max_by("confidence", order).alias("confidence"))


def contact_classes(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, alias_type, alias, class_id, members): live persons who share an email or phone, with the smallest id of each shared
    one, rather than all their pairs."""
    p = live(entities).filter("kind = 'person'").select(F.col("id").alias("entity_id"))
    a = normal_aliases(aliases).filter("alias_type IN ('email', 'phone')").join(p, "entity_id", "left_semi").filter((F.col("alias_type") == "email") | (F.length("alias") >= model.PHONE_DIGITS))
    a = cut(a.withColumn("k", F.concat_ws("|", "alias_type", "alias")))
    g = a.groupBy("k").agg(F.min("entity_id").alias("class_id"), F.count("*").alias("members")).filter("members > 1")
    return join_hot(a, g, "k", "members", F.col("entity_id"), a.count()).select("entity_id", "alias_type", "alias", "class_id", "members")


def similar_names(entities: DataFrame, least: float = 0.8) -> DataFrame:
    """(name_a, name_b, similarity): distinct names of live persons with 1 - edits / longer length of at least `least`.

    Exact, without all pairs: the shorter name is cut into one more piece than edits are allowed, so one piece stands unchanged in the
    other, shifted by no more than the edits; pieces are joined by their text, place and the two lengths.
    """
    names = live(entities).filter("kind = 'person'").select(S.norm_name(F.col("canonical_name")).alias("n")).filter("n <> ''").distinct().withColumn("len", F.length("n"))
    most = F.floor(F.lit(1 - least + 1e-9) * F.col("long")).cast("int")
    short = names.select(F.col("n").alias("a"), F.col("len").alias("la")).withColumn("long", F.explode(F.sequence(F.col("la"), F.floor(F.col("la") / F.lit(least - 1e-9)).cast("int")))).withColumn("t", most)
    piece_at = lambda i: F.floor(F.col("la") * i / (F.col("t") + 1)).cast("int")
    short = short.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t")))).withColumn("p", F.substring("a", piece_at(F.col("i")) + 1, piece_at(F.col("i") + 1) - piece_at(F.col("i")))).filter((F.col("la") + F.col("t") >= F.col("long")))
    long = names.select(F.col("n").alias("b"), F.col("len").alias("long")).withColumn("t", most).withColumn("la", F.explode(F.sequence(F.greatest(F.lit(1), F.col("long") - F.col("t")), F.col("long"))))
    long = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("t")))).withColumn("d", F.explode(F.sequence(-F.col("t"), F.col("t")))).withColumn("at", piece_at(F.col("i")) + F.col("d")).withColumn("size", piece_at(F.col("i") + 1) - piece_at(F.col("i")))
    long = long.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("long"))).withColumn("p", F.substring("b", F.col("at") + 1, F.col("size"))).select("b", "long", "la", "i", "p").distinct()
    pairs = short.select("a", "la", "long", "i", "p").join(long, ["la", "long", "i", "p"]).filter((F.col("a") != F.col("b")) & ((F.col("la") < F.col("long")) | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    s = pairs.withColumn("similarity", 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))).filter(F.col("similarity") >= least - 1e-9)
    return s.select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"), F.round("similarity", 6).alias("similarity"))


def orphans(links: DataFrame, aliases: DataFrame, artifacts: DataFrame, entities: DataFrame) -> DataFrame:
    """(problem, rows): links and aliases that point to nothing, reported and not repaired."""
    e, a = entities.select(F.col("id").alias("entity_id")), artifacts.select(F.col("id").alias("artifact_id"))
    part = lambda name, df: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("problem"), "rows")
    m = entities.filter("merged_into IS NOT NULL").select(F.col("merged_into").alias("entity_id"))
    return part("link without entity", links.join(e, "entity_id", "left_anti")).unionByName(part("link without artifact", links.join(a, "artifact_id", "left_anti"))).unionByName(part("alias without entity", aliases.join(e, "entity_id", "left_anti"))).unionByName(part("merge without entity", m.join(e, "entity_id", "left_anti")))


def phones_to_add(aliases: DataFrame) -> DataFrame:
    """(entity_id, phone, collides): bare forms of phone aliases that the entity lacks, and whether another entity has them. Nothing is
    left to add once they are added."""
    p = aliases.filter("alias_type = 'phone'").select("entity_id", "alias", S.norm_phone(F.col("alias")).alias("phone")).distinct()
    have = p.select("entity_id", F.col("alias").alias("phone")).distinct()
    add = p.filter((F.col("alias") != F.col("phone")) & (F.length("phone") >= model.PHONE_DIGITS)).select("entity_id", "phone").distinct().join(have, ["entity_id", "phone"], "left_anti")
    owners = have.groupBy("phone").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    taken = (F.col("lo") != F.col("entity_id")) | (F.col("hi") != F.col("entity_id"))
    return add.join(owners, "phone", "left").select("entity_id", "phone", F.coalesce(taken, F.lit(False)).alias("collides"))


PHONE_SCORE, EMAIL_SCORE = 0.9, 0.95


def probable_duplicates(entities: DataFrame, aliases: DataFrame, least: float = 0.8) -> DataFrame:
    """(entity_id_a, entity_id_b, score, reasons): one list of live persons who may be one, by shared phone (0.9), shared email (0.95) or
    similar name (its similarity); the score is the best of them, the reasons stand in that order.

    Each member of a class of a phone, an email or a name is paired with the class's smallest id, so a number that a third of all
    persons share gives a row for each and not all pairs; similar names pair the smallest ids of either name.
    """
    c = contact_classes(entities, aliases).filter("entity_id <> class_id")
    score = F.when(F.col("alias_type") == "email", EMAIL_SCORE).otherwise(PHONE_SCORE)
    by_contact = c.select(F.col("class_id").alias("entity_id_a"), F.col("entity_id").alias("entity_id_b"), score.alias("score"), F.when(F.col("alias_type") == "email", 2).otherwise(1).alias("o"), F.concat(F.lit("same "), "alias_type").alias("reason"))
    people = live(entities).filter("kind = 'person'").select("id", S.norm_name(F.col("canonical_name")).alias("n")).filter("n <> ''")
    first = people.groupBy("n").agg(F.min("id").alias("first"))
    same = people.join(first, "n").filter("id <> first").select(F.col("first").alias("entity_id_a"), F.col("id").alias("entity_id_b"), F.lit(1.0).alias("score"))
    pairs = similar_names(entities, least).join(first.select(F.col("n").alias("name_a"), F.col("first").alias("x")), "name_a").join(first.select(F.col("n").alias("name_b"), F.col("first").alias("y")), "name_b")
    alike = pairs.select(F.least("x", "y").alias("entity_id_a"), F.greatest("x", "y").alias("entity_id_b"), F.col("similarity").alias("score"))
    by_name = same.unionByName(alike).withColumn("o", F.lit(3)).withColumn("reason", F.lit("similar name"))
    each = by_contact.unionByName(by_name).groupBy("entity_id_a", "entity_id_b", "o", "reason").agg(F.max("score").alias("score"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "reason"))), lambda x: x["reason"]), ", ")  # at most three
    return each.groupBy("entity_id_a", "entity_id_b").agg(F.floor(F.max("score") * 100 + 0.5).alias("s"), listed.alias("reasons")).select("entity_id_a", "entity_id_b", (F.col("s") / 100).alias("score"), "reasons")


def with_text_similarity(pairs: DataFrame, links: DataFrame, vectors: DataFrame, role: str = "self") -> DataFrame:
    """pairs with `similarity`: cosine similarity in per cent of what is said about either (the vector of the smallest artifact linked in
    `role`), null where one has none."""
    own = vectors.join(links.filter(F.col("role") == role).select("artifact_id", "entity_id").distinct(), "artifact_id").groupBy("entity_id").agg(F.min_by("embedding", F.struct("artifact_id", "embedding")).alias("e"))
    side = lambda c: own.select(F.col("entity_id").alias(f"entity_id_{c}"), F.col("e").alias(f"e{c}"))
    both = pairs.join(side("a"), "entity_id_a", "left").join(side("b"), "entity_id_b", "left")
    return both.withColumn("similarity", F.round((1 - S.cosine_distance(F.col("ea"), F.col("eb"))) * 100).cast("int")).drop("ea", "eb")


def alias_state(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From events (seq, entity_id, alias, alias_type, action: derived, added, removed) the aliases (entity_id, alias, alias_type) and the
    tombstones (same columns): the last explicit event of an alias counts, a removal keeps derived ones out, whenever they come."""
    norm = F.when(F.col("alias_type") == "phone", S.norm_phone(F.col("alias"))).otherwise(S.norm_name(F.col("alias")))
    e = events.withColumn("alias", norm).filter("alias <> ''")
    said = F.max_by("action", F.when(F.col("action") != "derived", F.col("seq")))
    last = e.groupBy("entity_id", "alias", "alias_type").agg(said.alias("last"))
    return last.filter("last IS NULL OR last = 'added'").drop("last"), last.filter("last = 'removed'").drop("last")


def create_conflicts(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities to be made (key, name, emails, phones) with `conflict`: the smallest entity that has one of their emails or phones, null
    where none has, so that they may be made."""
    side = lambda c, kind, norm: wanted.select("key", F.explode(c).alias("x")).select("key", F.lit(kind).alias("alias_type"), norm(F.col("x")).alias("alias"))
    want = side("emails", "email", S.norm_name).unionByName(side("phones", "phone", S.norm_phone)).filter("alias <> ''").distinct()
    owner = want.join(normal_aliases(aliases), ["alias", "alias_type"]).groupBy("key").agg(F.min("entity_id").alias("conflict"))
    return wanted.join(owner, "key", "left")


def names_to_reduce(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, name, reduced): live persons named in exactly three parts, whose first and last part names nobody else."""
    c = F.col("canonical_name")
    p = live(entities).filter("kind = 'person'").select(F.col("id").alias("entity_id"), c.alias("name"), S.display_name(c).alias("reduced")).filter("name <> reduced")
    own = normal_aliases(aliases).groupBy("alias").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    p = p.withColumn("alias", S.norm_name(F.col("reduced"))).join(own, "alias", "left")
    return p.filter(F.col("lo").isNull() | ((F.col("lo") == F.col("entity_id")) & (F.col("hi") == F.col("entity_id")))).select("entity_id", "name", "reduced")


def directory(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """From (seq, name, handle, handle_type) a directory (handle, handle_type, name): the first writer of each normalised handle."""
    norm = F.when(F.col("handle_type") == "phone", S.norm_phone(F.col("handle"))).otherwise(S.norm_name(F.col("handle")))
    return rows.withColumn("handle", norm).filter("handle <> '' AND name IS NOT NULL").groupBy("handle", "handle_type").agg(F.min_by("name", seq).alias("name"))


def directory_proposals(staged: DataFrame, listed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, alias_type, name, times, first_artifact): staged hints (artifact_id, alias, alias_type) that the directory knows, unless an
    entity has the alias by now; how often each was met, and where first."""
    n = staged.groupBy("alias", "alias_type").agg(F.count("*").alias("times"), F.min("artifact_id").alias("first_artifact"))
    known = listed.select(F.col("handle").alias("alias"), F.col("handle_type").alias("alias_type"), "name")
    return n.join(known, ["alias", "alias_type"]).join(normal_aliases(aliases).select("alias", "alias_type").distinct(), ["alias", "alias_type"], "left_anti").select("alias", "alias_type", "name", "times", "first_artifact")


def profiles(entities: DataFrame, aliases: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """(entity_id, kind, canonical_name, aliases, artifacts, out_relations, in_relations): what is known of each live entity, in counts;
    its newest artifacts are search.linked_rows, its relations relations_both_ways. Links are counted as they stand, one per role."""
    n = lambda df, key, name: df.groupBy(F.col(key).alias("entity_id")).agg(F.count("*").alias(name))
    out = live(entities).select(F.col("id").alias("entity_id"), "kind", "canonical_name")
    parts = [n(normal_aliases(aliases), "entity_id", "aliases"), n(links.select("artifact_id", "entity_id", "role").distinct(), "entity_id", "artifacts"), n(relations, "from_entity_id", "out_relations"), n(relations, "to_entity_id", "in_relations")]
    for p in parts:
        out = out.join(p, "entity_id", "left")
    return out.fillna(0, ["aliases", "artifacts", "out_relations", "in_relations"])


def listed(entities: DataFrame, aliases: DataFrame, links: DataFrame, artifacts: DataFrame, kind: str | None = None, part: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """(entity_id, kind, canonical_name, has_photo): a page of live entities, of a kind, with `part` in their name or an alias, whatever its
    case; by name without case, then id."""
    e = live(entities) if kind is None else live(entities).filter(F.col("kind") == kind)
    if part:
        sought = F.lit(part.lower())
        by_alias = aliases.filter(F.contains(F.lower("alias"), sought)).select(F.col("entity_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
        e = e.join(by_alias, "id", "left").filter(F.contains(F.lower("canonical_name"), sought) | F.col("_hit"))
    page = e.orderBy(F.lower("canonical_name"), "id").offset(offset).limit(min(max(limit, 1), 500))
    with_photo = links.filter("role IN ('self', 'pictured')").join(artifacts.filter("raw_path IS NOT NULL AND type = 'photo'").select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").select(F.col("entity_id").alias("id")).distinct().withColumn("_p", F.lit(True))
    return page.join(with_photo, "id", "left").select(F.col("id").alias("entity_id"), "kind", "canonical_name", F.coalesce("_p", F.lit(False)).alias("has_photo"))
