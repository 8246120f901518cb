"""Places: nearest names, clusters of points, and runs of events in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mnemark import model
from mnemark.functions import scalars as S, states
from mnemark.operators import spatial
from mnemark.session import broadcast_if_small, cut


def reverse_geocode(artifacts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(artifact_id, label, km): the nearest gazetteer row (name, latitude, longitude) as its name up to 50 km, as "near ..." up to
    300 km; ties by name. Points share their answer: the join runs over distinct coordinates, so a home with a tenth of the rows is one
    point, and only spots without a place within 50 km are looked up within 300."""
    pts = artifacts.filter(spatial.valid_position(F.col("latitude"), F.col("longitude"))).select("id", "latitude", "longitude").withColumn("spot", F.concat_ws(",", "latitude", "longitude"))
    spots = cut(pts.select("latitude", "longitude", "spot").distinct())
    named = cut(gazetteer.dropDuplicates(["name", "latitude", "longitude"]).withColumn("place", F.struct("name", "latitude", "longitude")))
    nearest = lambda s, km: spatial.near(s, named, km, "spot", "place").groupBy("spot").agg(F.min(F.struct(F.round("distance_km", 6).alias("km"), F.col("place.name").alias("name"))).alias("b"))
    close = cut(nearest(spots, model.NEAR_KM))
    best = close.unionByName(nearest(spots.join(close, "spot", "left_anti"), model.FAR_KM))
    label = F.when(F.col("b.km") <= model.NEAR_KM, F.col("b.name")).otherwise(F.concat(F.lit("near "), F.col("b.name")))
    return pts.join(best, "spot").select(F.col("id").alias("artifact_id"), label.alias("label"), F.col("b.km").alias("km"))


def forward_geocode(labels: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(label, place_id): for "City" or "City, Region" the gazetteer row (place_id, city, region, ord) of that city and, if given, region
    (by name or by a state's code), whatever their case; rows with a region first, then in the gazetteer's order."""
    codes = F.create_map(*(F.lit(x) for n, c in states.STATES.items() for x in (c.lower(), n)))
    g = gazetteer.select("place_id", F.lower(F.trim("city")).alias("c"), F.lower(F.trim("region")).alias("r"), "ord")
    order = F.struct(F.col("r").isNull(), "ord", "place_id")
    best = lambda by: g.groupBy(*by).agg(F.min_by("place_id", order).alias("place_id"))
    parts = labels.select("label").distinct().withColumn("c", F.lower(F.trim(F.regexp_extract("label", r"^([^,]*)", 1)))).withColumn("w", F.nullif(F.lower(F.trim(F.regexp_extract("label", r",\s*(.*)$", 1))), F.lit("")))
    plain = parts.filter("w IS NULL").join(best(["c"]), "c")
    within = parts.filter("w IS NOT NULL").withColumn("r", F.coalesce(F.try_element_at(codes, F.col("w")), F.col("w"))).join(best(["c", "r"]), ["c", "r"])
    return plain.select("label", "place_id").unionByName(within.select("label", "place_id"))


def clusters(artifacts: DataFrame) -> DataFrame:
    """(cell_lat, cell_lon, n, latitude, longitude): cells of two decimals with five or more points, and their centres."""
    pts = artifacts.filter(spatial.valid_position(F.col("latitude"), F.col("longitude")))
    cell = lambda c: F.floor(F.col(c) * 10**model.CLUSTER_DECIMALS).cast("long")
    return pts.groupBy(cell("latitude").alias("cell_lat"), cell("longitude").alias("cell_lon")).agg(F.count("*").alias("n"), F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude")).filter(F.col("n") >= model.CLUSTER_LEAST)


def day_runs(artifacts: DataFrame, source: Column | None = None) -> DataFrame:
    """(source, run_start, run_end, days, n): runs of days with artifacts, of all or of each source, a new one after a gap over one day;
    runs of five artifacts or more. Rows are counted by day before the window, so it sees at most one row a day."""
    days = artifacts.withColumn("day", S.utc_date(F.col("occurred_at"))).filter("day IS NOT NULL").groupBy((F.lit("all") if source is None else source).alias("source"), "day").agg(F.count("*").alias("n"))
    w = W.partitionBy("source").orderBy("day")
    flagged = days.withColumn("new", F.coalesce((F.datediff("day", F.lag("day").over(w)) > model.RUN_GAP_DAYS).cast("int"), F.lit(0)))
    runs = flagged.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("source", "run").agg(F.min("day").alias("run_start"), F.max("day").alias("run_end"), F.count("*").alias("days"), F.sum("n").alias("n")).filter(F.col("n") >= model.RUN_LEAST).drop("run")


def in_runs(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """(artifact_id, run_start): artifacts inside a run, ends in; runs are exploded into days, so this is an equi-join, whose days are
    sent to all tasks while they are few, so that a day with a third of all rows is no single task's."""
    by_day = cut(runs.select("run_start", F.explode(F.sequence("run_start", "run_end")).alias("day")))
    rows = artifacts.withColumn("day", S.utc_date(F.col("occurred_at")))
    return rows.join(broadcast_if_small(by_day, by_day.count(), MOST_DAYS), "day").select(F.col("id").alias("artifact_id"), "run_start")


#: Days of runs that may be sent to all tasks: some five hundred years.
MOST_DAYS = 200_000


def trips(artifacts: DataFrame, homes: DataFrame, gazetteer: DataFrame, gap_days: int = model.RUN_GAP_DAYS) -> DataFrame:
    """(trip_start, trip_end, days, n, latitude, longitude, name): runs of days with located artifacts away from every home (latitude,
    longitude, radius_km), a new one after a gap over gap_days, of five artifacts or more; their centre, and the nearest place's name
    with the first and the last day. Rows are counted by day before the window."""
    at = artifacts.filter(spatial.valid_position(F.col("latitude"), F.col("longitude"))).withColumn("day", S.utc_date(F.col("occurred_at"))).filter("day IS NOT NULL")
    home = spatial.within(at.select("id", "latitude", "longitude"), homes.withColumn("_home", F.lit(0)), "id", "_home").select("id").distinct()
    days = at.join(home, "id", "left_anti").groupBy("day").agg(F.count("*").alias("n"), F.sum("latitude").alias("la"), F.sum("longitude").alias("lo"))
    w = W.partitionBy(F.lit(1)).orderBy("day")  # a row per day
    flagged = days.withColumn("new", F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap_days).cast("int"), F.lit(0)))
    runs = flagged.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("run").agg(F.min("day").alias("trip_start"), F.max("day").alias("trip_end"), F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("la").alias("la"), F.sum("lo").alias("lo"))
    runs = cut(runs.filter(F.col("n") >= model.RUN_LEAST).select("trip_start", "trip_end", "days", "n", F.round(F.col("la") / F.col("n"), 6).alias("latitude"), F.round(F.col("lo") / F.col("n"), 6).alias("longitude")).withColumn("id", F.col("trip_start")))
    named = runs.join(reverse_geocode(runs, gazetteer).select(F.col("artifact_id").alias("id"), "label"), "id", "left")
    span = F.when(F.col("trip_start") == F.col("trip_end"), F.col("trip_start").cast("string")).otherwise(F.concat_ws("–", F.col("trip_start").cast("string"), F.col("trip_end").cast("string")))
    return named.select("trip_start", "trip_end", "days", "n", "latitude", "longitude", F.concat(F.coalesce("label", F.lit("Away")), F.lit(" ("), span, F.lit(")")).alias("name"))


def in_events(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """(artifact_id, event_id): artifacts of the days of an event (event_id, run_start, run_end, latitude, longitude, radius_km), ends in,
    and, where it has a usable centre and radius, within it: rows without coordinates aren't, then. An event that ends before it begins
    has none."""
    e = cut(events.filter("run_end >= run_start"))
    anywhere = ~(spatial.valid_position(F.col("latitude"), F.col("longitude")) & F.coalesce(F.col("radius_km") > 0, F.lit(False)))
    by_time = _in_spans(artifacts, e.withColumn("anywhere", anywhere))
    near = spatial.within(artifacts.select(F.col("id").alias("artifact_id"), "latitude", "longitude"), e, "artifact_id", "event_id").select("artifact_id", "event_id")
    return by_time.filter("anywhere").select("artifact_id", "event_id").unionByName(by_time.filter("NOT anywhere").select("artifact_id", "event_id").join(near, ["artifact_id", "event_id"], "left_semi"))


def _in_spans(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    by_day = cut(events.select("event_id", "anywhere", F.explode(F.sequence("run_start", "run_end")).alias("day")))
    rows = artifacts.select(F.col("id").alias("artifact_id"), S.utc_date(F.col("occurred_at")).alias("day"))
    return rows.join(broadcast_if_small(by_day, by_day.count(), MOST_DAYS), "day")


def sessions(events: DataFrame, user: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session, started, ended, n): a new session after a gap over gap_minutes; ties by time are one moment.

    A user's events are cut into hours. Inside an hour the gaps are found by themselves; over the hours' first and last events, one
    row an hour, the gaps between hours, so a user with a third of all events is spread over as many tasks as there are hours. Null
    times make no session.
    """
    gap = gap_minutes * 60_000_000
    e = events.select(F.col(user).alias("user_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(ts).alias("ts")).filter("t IS NOT NULL").withColumn("h", F.floor(F.col("t") / 3_600_000_000))
    w = W.partitionBy("user_id", "h").orderBy("t")
    e = e.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(0))).withColumn("k", F.sum("new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    parts = e.groupBy("user_id", "h", "k").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    over = W.partitionBy("user_id").orderBy("a")  # a row per hour and gap inside it
    parts = parts.withColumn("new", F.coalesce((F.col("a") - F.lag("b").over(over) > gap).cast("int"), F.lit(0))).withColumn("session", F.sum("new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    return parts.groupBy("user_id", "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n"))
