"""Points near points and inside circular regions, over a grid whose cells follow the radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mnemark.session import broadcast_if_small, cut

EARTH_KM = 6371.0
KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180
FINEST_DEGREES = 0.005  # height of a cell of level 0; each level doubles it
LEVELS = 16  # level 15: 164 degrees
#: Regions may be sent to every executor while their cells, some 100 bytes each, are at most so many.
BROADCAST_CELLS = 200_000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def _height(level: Column) -> Column:
    return F.lit(FINEST_DEGREES) * F.pow(F.lit(2.0), level)


def _columns(row: Column, height: Column) -> Column:
    """Cells around the globe in a row of cells: as wide as high at the row's edge nearest the equator."""
    south = row * height - 90
    edge = F.when((south <= 0) & (south + height >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(south + height)))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * 360 / height)).cast("long")


def point_cell(lat: Column, lon: Column, level: Column) -> tuple[Column, Column]:
    height = _height(level)
    row = F.floor((lat + 90) / height)
    n = _columns(row, height)
    return row, F.pmod(F.floor((lon + 180) * n / 360), n)


def region_cells(regions: DataFrame, lat: str, lon: str, radius_km: str) -> DataFrame:
    """A row for each cell (_level, _row, _col) that the circle may touch: about nine a region."""
    r = F.col(radius_km) * 1.000001 / KM_PER_DEGREE
    out = regions.withColumn("_r", r).withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log2(F.col("_r") / FINEST_DEGREES)))).cast("int"))
    height = _height(F.col("_level"))
    low, high = F.greatest(F.col(lat) - F.col("_r"), F.lit(-90.0)), F.least(F.col(lat) + F.col("_r"), F.lit(90.0))
    out = out.withColumn("_row", F.explode(F.sequence(F.floor((low + 90) / height), F.floor((high + 90) / height))))
    n = _columns(F.col("_row"), height)
    # Half the circle's width in degrees of longitude; a circle that holds a pole has them all.
    half = F.when((low <= -90) | (high >= 90), 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.col("_r"))) / F.cos(F.radians(F.col(lat)))))) * 1.000001 + 1e-9)
    first, last = F.floor((F.col(lon) - half + 180) * n / 360), F.floor((F.col(lon) + half + 180) * n / 360)
    cells = F.when(last - first >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, n)))
    return out.withColumn("_col", F.explode(F.array_distinct(cells))).drop("_r")


def within(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, lat: str = "latitude", lon: str = "longitude", region_lat: str = "latitude", region_lon: str = "longitude", radius_km: str = "radius_km") -> DataFrame:
    """(point_id, region_id, distance_km): every point within every region's radius, rim included.

    Points with null, NaN or out-of-range coordinates and regions with an unusable centre or a radius that isn't above zero take no
    part. (0, 0) and the poles are places like others; circles may cross the antimeridian. Repeated points or regions come out as often
    as they stand. Only the named columns are read, so other columns may have any name. Empty tables give an empty result.

    The cells of the regions are counted; beyond BROADCAST_CELLS they are joined by shuffle, with points salted, so that a cell with
    a third of all points is spread over tasks.
    """
    p = points.select(F.col(point_id).alias("_pid"), F.col(lat).cast("double").alias("_plat"), F.col(lon).cast("double").alias("_plon")).filter(valid_position(F.col("_plat"), F.col("_plon")))
    r = regions.select(F.col(region_id).alias("_rid"), F.col(region_lat).cast("double").alias("_lat"), F.col(region_lon).cast("double").alias("_lon"), F.col(radius_km).cast("double").alias("_km"))
    r = r.filter(valid_position(F.col("_lat"), F.col("_lon")) & (F.col("_km") > 0) & ~F.isnan("_km"))
    cells = cut(region_cells(r, "_lat", "_lon", "_km"))
    by_level = [(x["_level"], x["count"]) for x in cells.groupBy("_level").count().collect()]  # at most LEVELS rows
    levels = sorted(x for x, _ in by_level) or [0]
    p = p.withColumn("_level", F.explode(F.array(*(F.lit(x) for x in levels))))
    row, col = point_cell(F.col("_plat"), F.col("_plon"), F.col("_level"))
    p = p.withColumn("_row", row).withColumn("_col", col)
    key, count = ["_level", "_row", "_col"], sum(n for _, n in by_level)
    if count > BROADCAST_CELLS:
        spread = 16
        p = p.withColumn("_salt", F.pmod(F.xxhash64("_pid"), F.lit(spread)))
        cells, key = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))), [*key, "_salt"]
    km = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_lat"), F.col("_lon"))
    return p.join(broadcast_if_small(cells, count, BROADCAST_CELLS), key).withColumn("_d", km).filter(F.col("_d") <= F.col("_km")).select(F.col("_pid").alias(point_id), F.col("_rid").alias(region_id), F.col("_d").alias("distance_km"))


NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?"


def place_regions(entities: DataFrame) -> DataFrame:
    """Live place entities as (entity_id, latitude, longitude, radius_km), with positions and radii in any of their spellings.

    Positions: latitude/longitude or lat/lon/lng, as numbers or text, at the top or under geo; geo or location as a list or as
    "lat, lon". Radii: radius_km, radius_m, or radius with a unit (km without one). Null or broken JSON and values that can't be
    read give null, which within() leaves out.
    """
    get = lambda *paths: F.coalesce(*(F.get_json_object("attrs_json", p) for p in paths))
    number = lambda c: F.when(F.trim(c).rlike(f"^{NUMBER}$"), F.trim(c).try_cast("double"))
    pair = F.regexp_extract(F.coalesce(get("$.location"), get("$.geo")), rf"^\s*[\[(]?\s*({NUMBER})\s*[,; ]\s*({NUMBER})\s*[\])]?\s*$", 1), F.regexp_extract(F.coalesce(get("$.location"), get("$.geo")), rf"^\s*[\[(]?\s*({NUMBER})\s*[,; ]\s*({NUMBER})\s*[\])]?\s*$", 2)
    lat = F.coalesce(number(get("$.latitude", "$.lat", "$.geo.lat", "$.geo.latitude", "$.location.lat", "$.location.latitude")), number(pair[0]))
    lon = F.coalesce(number(get("$.longitude", "$.lon", "$.lng", "$.geo.lon", "$.geo.lng", "$.geo.longitude", "$.location.lon", "$.location.lng", "$.location.longitude")), number(pair[1]))
    text = F.lower(get("$.radius"))
    value, unit = F.regexp_extract(text, rf"^\s*({NUMBER})\s*(km|m|mi)?\s*$", 1).try_cast("double"), F.regexp_extract(text, rf"^\s*({NUMBER})\s*(km|m|mi)?\s*$", 2)
    km = F.coalesce(number(get("$.radius_km")), number(get("$.radius_m")) / 1000, value * F.when(unit == "m", 0.001).when(unit == "mi", 1.609344).otherwise(1.0))
    return entities.filter((F.col("kind") == "place") & F.col("merged_into").isNull()).select(F.col("id").alias("entity_id"), lat.alias("latitude"), lon.alias("longitude"), km.alias("radius_km"))


def near(points: DataFrame, others: DataFrame, radius_km: float, point_id: str, other_id: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(point_id, other_id, distance_km): for each point of one table the points of another within a fixed distance; see within()."""
    return within(points, others.withColumn("_fixed_km", F.lit(float(radius_km))), point_id, other_id, lat, lon, lat, lon, "_fixed_km")
