"""One record per person: groups over shared contact data, then the best record and the best value of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemark.session import cut, join_hot

# What people write into a field that has no value.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "none", "null", "unknown", "tbd", "unbekannt", "inconnu", "desconocido"]
FIELDS = ["nickname", "birthday", "address", "title", "org", "url", "note"]
MAX_ROUNDS = 50
PIECE = 50_000  # rows of one key that a task may get


def attr(name: str) -> Column:
    """A field of attrs_json as text; from JSON that was cut off, the fields before the cut."""
    return F.coalesce(F.get_json_object("attrs_json", f"$.{name}"), F.nullif(F.regexp_extract("attrs_json", rf'"{name}": *"([^"]*)"', 1), F.lit("")))


def attr_list(name: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object("attrs_json", f"$.{name}"), "array<string>"), F.regexp_extract_all(F.regexp_extract("attrs_json", rf'"{name}": *\[([^\]]*)\]', 1), F.lit('"([^"]*)"'), 1))


def usable(c: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(c)).isin(PLACEHOLDERS), F.lit(False))


def email_key(c: Column) -> Column:
    e = F.regexp_replace(F.lower(F.trim(c)), r"^<?\s*(?:mailto:)?\s*|\s*>?\s*$", "")
    return F.when(e.rlike(r"^[^@\s]+@[^@\s]+$"), e)


def phone_key(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    d = F.when(d.rlike(r"^1\d{10}$"), F.substring(d, 2, 10)).otherwise(d)
    return F.when((F.length(d) >= 7) & ~d.rlike(r"^(\d)\1*$"), d)


def given_name(c: Column) -> Column:
    """First given name, folded: one letter where only the initial stands there; null where there is none."""
    n = F.translate(F.lower(F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    first = F.regexp_extract(F.when(n.contains(","), F.trim(F.regexp_replace(n, r"^[^,]*,", ""))).otherwise(n), r"^([\p{L}'’-]+)", 1)
    return F.when(~n.isin(PLACEHOLDERS) & (F.length(first) > 0) & (n.contains(",") | n.contains(" ")), first)


def contacts(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, given, kind, contact): distinct normalised emails and phones of persons, from attrs_json and entity_aliases."""
    people = entities.filter("kind = 'person'").select("id", given_name(F.col("canonical_name")).alias("given"), "attrs_json")
    own = lambda field, key, kind: people.select("id", "given", F.lit(kind).alias("kind"), F.explode(attr_list(field)).alias("c")).select("id", "given", "kind", key(F.col("c")).alias("contact"))
    a = aliases.filter(F.col("alias_type").isin("email", "phone")).select(F.col("entity_id").alias("id"), F.col("alias_type").alias("kind"), F.when(F.col("alias_type") == "email", email_key(F.col("alias"))).otherwise(phone_key(F.col("alias"))).alias("contact"))
    a = a.join(people.select("id", "given"), "id").select("id", "given", "kind", "contact")
    return own("emails", email_key, "email").unionByName(own("phones", phone_key, "phone")).unionByName(a).filter(F.col("contact").isNotNull()).distinct()


def memberships(people_contacts: DataFrame) -> DataFrame:
    """(id, key): records with one key are one person. An email is a key; so is a phone number with one given name.

    On a phone number an initial counts as the one given name there that it can stand for. Where it could stand for several, or the
    record has no given name, the number alone doesn't tie the record to anyone. The contacts are read five times, so they are cut first.
    """
    c = cut(people_contacts).withColumn("initial", F.substring("given", 1, 1)).withColumn("full", F.when(F.length("given") > 1, F.col("given")))
    phones = c.filter("kind = 'phone' AND given IS NOT NULL")
    names = phones.groupBy("contact", "initial").agg(F.min("full").alias("lo"), F.max("full").alias("hi"), F.count("*").alias("n"))
    tied = join_hot(phones.withColumn("k", F.concat_ws("|", "contact", "initial")), names.select(F.concat_ws("|", "contact", "initial").alias("k"), "lo", "hi", "n"), "k", "n", F.col("id"), phones.count())
    whose = F.when(F.col("full").isNotNull(), F.col("full")).when(F.col("lo").isNull(), F.col("initial")).when(F.col("lo") == F.col("hi"), F.col("lo"))
    tied = tied.withColumn("whose", whose).filter("whose IS NOT NULL").select("id", F.concat_ws("|", F.lit("p"), "contact", "whose").alias("key"))
    return c.filter("kind = 'email'").select("id", F.concat_ws("|", F.lit("e"), "contact").alias("key")).unionByName(tied).distinct()


def components(members: DataFrame) -> DataFrame:
    """(id, person): the smallest id reachable through shared keys. Labels travel from records to keys and back, and jump to the label of
    their label; each round is cut, and so are the members, which are read four times before. The number of rounds follows the longest
    chain's logarithm. A key of more than PIECE rows has its rows in several pieces, fixed once, and its label goes to each of them."""
    members = cut(members)
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = join_hot(members, sizes, "key", "n", F.col("id"), members.count()).withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int"))
    state = cut(placed.select("id", "key", "pieces", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), F.col("id").alias("label")))
    for _ in range(MAX_ROUNDS):
        low = state.groupBy("key").agg(F.min("label").alias("low"), F.max("pieces").alias("pieces"))
        low = low.select("key", "low", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        to = state.select("id", "key", "piece").join(low, ["key", "piece"]).groupBy("id").agg(F.min("low").alias("to"))
        moved = cut(state.join(to, "id").select("id", "key", "pieces", "piece", "label", "to"))
        ends = moved.select(F.col("id").alias("to"), F.col("to").alias("further")).distinct()
        jumped = cut(moved.join(ends, "to", "left").select("id", "key", "pieces", "piece", F.least("to", F.coalesce("further", "to")).alias("label"), (F.col("to") < F.col("label")).alias("moved")))
        state = jumped.drop("moved")
        if not jumped.filter("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return state.groupBy("id").agg(F.min("label").alias("person"))


def ranked(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Live persons with what their rank is made of: (id, changed, usable_fields, trust_rank)."""
    filled = sum((usable(attr(f)).cast("int") for f in FIELDS), F.lit(0))
    lists = sum((F.coalesce(F.least(F.size(F.array_compact(F.transform(attr_list(f), key))), F.lit(1)), F.lit(0)) for f, key in (("emails", email_key), ("phones", phone_key))), F.lit(0))
    p = entities.filter("kind = 'person' AND merged_into IS NULL").select("id", "canonical_name", "attrs_json", F.try_to_timestamp(attr("updated_at")).alias("changed"), (filled + F.greatest(lists, F.lit(0))).alias("usable_fields"), attr("source").alias("source"))
    return p.join(F.broadcast(profiles.dropDuplicates(["source"]).select("source", "trust_rank")), "source", "left")  # a fixed table of 11 rows


def best_first() -> list[Column]:
    return [F.col("changed").desc_nulls_last(), F.col("usable_fields").desc(), F.col("trust_rank").asc_nulls_last(), F.col("id").asc()]


def survivors(entities: DataFrame, aliases: DataFrame, profiles: DataFrame) -> DataFrame:
    """Live persons as (id, person, keep_id, ...): `keep_id` is the group's record that was changed last, then has most usable fields,
    then the most trusted source, then the smallest id. Records already merged only carry ties. Persons without shared contact data
    are groups of one. Null or broken JSON counts as no fields beyond those before the cut; repeated alias rows count once.
    """
    tied = components(memberships(contacts(entities, aliases)))
    live = ranked(entities, profiles).join(tied, "id", "left").withColumn("person", F.coalesce("person", "id"))
    live = cut(live)
    top = live.withColumn("_n", F.row_number().over(W.partitionBy("person").orderBy(*best_first()))).filter("_n = 1").select("person", F.col("id").alias("keep_id"))
    return live.join(top, "person")


def same_person_pairs(people: DataFrame) -> DataFrame:
    a, b = people.select("person", "keep_id", F.col("id").alias("entity_id_a")), people.select("person", F.col("id").alias("entity_id_b"))
    return a.join(b, "person").filter("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b", "keep_id")


def best_records(people: DataFrame) -> DataFrame:
    """One record per person: keep_id, number of records, all emails and phones, and of each other field the first usable value in rank order."""
    order = F.struct(-F.coalesce(F.unix_micros("changed"), F.lit(-(2**62))), -F.col("usable_fields"), F.coalesce("trust_rank", F.lit(2**31 - 1)), F.col("id"))
    p = people.withColumn("_order", order)
    best = [F.min_by(F.trim(attr(f)), F.when(usable(attr(f)), F.col("_order"))).alias(f) for f in FIELDS]
    lists = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.transform(attr_list(f), key)))))), ", ").alias(f) for f, key in (("emails", email_key), ("phones", phone_key))]
    return p.groupBy("person", "keep_id").agg(F.count("*").alias("records"), F.min_by("canonical_name", "_order").alias("name"), *best, *lists).drop("person")
