"""Where a hole stands, from what is printed of it: which reading is used, which are only candidates, and what says so.

Holes are (hole_id, file, name, easting, northing, lat, lon, grid_x, grid_y, datum, zone, local_page), as printed. One projection of columns settles a
hole's status; the province's records come in by file and name, the file's sheets and other holes by file. A reading on the old datum is moved by a grid of
shifts, if there is one: without it such a hole is not placed by its print. Nothing is chosen between two datums: a hole without a datum keeps both candidates.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geo import geodesic
from lodestar.functions.text import name_key

# The ellipsoids (half axis, flattening), plausible plane coordinates, the zones that are tried, and the reaches.
ELLIPSOIDS = {"NAD27": (6378206.4, 1 / 294.978698214), "NAD83": (6378137.0, 1 / 298.257222101)}
EASTINGS, NORTHINGS, ZONES = (150_000, 850_000), (5_400_000, 6_700_000), (12, 13)
FILE_KM, SHEET_SLACK = 2.0, 0.05


def datum_of(c: Column) -> Column:
    """NAD27, NAD83 or WGS84 where a printed datum names one; else null."""
    t = F.replace(F.lower(F.regexp_replace(c, r"\s+", " ")), F.lit("."), F.lit(""))
    has = lambda *words: F.greatest(*(F.contains(t, F.lit(w)) for w in words), F.lit(False))
    nad = has("nad")
    named = F.when(has("nad27", "nad 27", "nad-27", "north american datum 1927"), "NAD27").when(has("nad83", "nad 83", "nad-83", "north american datum 1983"), "NAD83")
    return named.when(has("wgs84", "wgs 84"), "WGS84").when(nad & has("27"), "NAD27").when(nad & has("83"), "NAD83")


def zone_of(c: Column) -> Column:
    """The zone's number in a printed zone, from 1 to 60; the letter of its band is none."""
    z = F.nullif(F.regexp_extract(c.cast("string"), r"(\d{1,2})", 1), F.lit("")).cast("int")
    return F.when(z.between(1, 60), z)


def from_utm(easting: Column, northing: Column, zone: Column, datum: str) -> Column:
    """struct(lon, lat) of plane coordinates north of the equator, by the series in the third flattening."""
    a, f = ELLIPSOIDS[datum]
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi, eta = northing / (0.9996 * radius), (easting - 500_000.0) / (0.9996 * radius)
    x, y = xi, eta
    for k, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * chi)
    lon = zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x)))
    return F.when(easting.isNotNull() & northing.isNotNull() & zone.isNotNull(), F.struct(lon.alias("lon"), F.degrees(lat).alias("lat")))


def to_utm(lon: Column, lat: Column, zone: Column, datum: str) -> Column:
    """struct(easting, northing): the way back."""
    a, f = ELLIPSOIDS[datum]
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    turn = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = xi, eta
    for k, b in enumerate(alpha, 1):
        x = x + b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y + b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return F.struct((500_000 + 0.9996 * radius * y).alias("easting"), (0.9996 * radius * x).alias("northing"))


def shifted(points: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """`points` (id, lon, lat) moved by a grid of shifts (gx, gy, dlon, dlat): nodes at gx * step, gy * step degrees, in proportion between four of them.

    Points of which a corner is missing are outside the grid and left out.
    """
    gx, gy = F.floor(F.col("lon") / step), F.floor(F.col("lat") / step)
    fx, fy = F.col("lon") / step - gx, F.col("lat") / step - gy
    corners = [F.struct((gx + a).alias("gx"), (gy + b).alias("gy"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for a in (0, 1) for b in (0, 1)]
    met = points.select("id", "lon", "lat", F.explode(F.array(*corners)).alias("c")).select("id", "lon", "lat", "c.*").join(grid.select("gx", "gy", "dlon", "dlat"), ["gx", "gy"])
    moved = met.groupBy("id", "lon", "lat").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("dlon")).alias("x"), F.sum(F.col("w") * F.col("dlat")).alias("y")).where("n = 4")
    return moved.select("id", (F.col("lon") + F.col("x")).alias("lon"), (F.col("lat") + F.col("y")).alias("lat"))


def positions(holes: DataFrame, province: DataFrame, sheets: DataFrame, grid: DataFrame | None = None, step: float = 0.1) -> DataFrame:
    """(hole_id, status, source, lon, lat, datum, zone, zone_inferred, separation_m, shift_m, record, inside_sheet, file_km, inside_file).

    status: no_coordinates, not_transformable_local_grid, not_transformable_no_datum, transform_failed, transformed. Printed degrees, or plausible plane
    coordinates, go before a local grid. source: extracted_transformed, extracted_nad83, else the province's record of the same name in the file (the
    first source, then the first record), else none. A zone that is not printed is the one of 12 and 13 that lands in the file's sheets, if it is one only, else that of the
    sheets' middle. separation_m: how far the two readings of a hole without a datum lie apart; shift_m: how far the datum moves a hole.

    province: (file, name, source, record, lon, lat), source 1 before 2; sheets: (file, x0, y0, x1, y1).
    """
    h = holes.withColumns({"datum_": datum_of(F.col("datum")), "zone_": zone_of(F.col("zone"))})
    degrees = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    plane = F.col("easting").isNotNull() & F.col("northing").isNotNull()
    plausible = F.col("easting").between(*EASTINGS) & F.col("northing").between(*NORTHINGS)
    projected = degrees | (plane & plausible)
    local = ~projected & (F.coalesce("local_page", F.lit(False)) | F.col("grid_x").isNotNull() | F.col("grid_y").isNotNull() | (plane & ~plausible))
    nothing = ~projected & F.coalesce("easting", "northing", "lat", "lon").isNull()
    status = F.when(local, "not_transformable_local_grid").when(nothing, "no_coordinates").when(F.col("datum_").isNull(), "not_transformable_no_datum").otherwise("transformed")
    h = h.withColumn("status", status)
    # Sheets of a file are few; its middle and the zones that land in one are told by them.
    held = sheets.groupBy("file").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("sheets"), F.avg((F.col("x0") + F.col("x1")) / 2).alias("middle"))
    h = h.join(held, "file", "left")
    inside = lambda p: F.exists("sheets", lambda s: (p.lon >= s.x0 - SHEET_SLACK) & (p.lon <= s.x1 + SHEET_SLACK) & (p.lat >= s.y0 - SHEET_SLACK) & (p.lat <= s.y1 + SHEET_SLACK))
    e, n = F.col("easting"), F.col("northing")
    by_middle = (F.floor((F.col("middle") + 180) / 6) + 1).cast("int")
    printed = F.struct(F.when(F.col("lon") < 0, F.col("lon")).otherwise(-F.col("lon")).alias("lon"), F.col("lat").alias("lat"))
    for d in ("NAD27", "NAD83"):
        fits = F.filter(F.array(*(F.when(inside(from_utm(e, n, F.lit(z), d)), F.lit(z)) for z in ZONES)), lambda z: z.isNotNull())
        zone = F.coalesce("zone_", F.when(F.size(fits) == 1, F.get(fits, F.lit(0))), by_middle)
        usable = F.col("status").isin("transformed", "not_transformable_no_datum")
        h = h.withColumn(f"z_{d}", F.when(usable & ~degrees & plane, zone))
        h = h.withColumn(f"as_{d}", F.when(usable & degrees, printed).when(usable, from_utm(e, n, F.col(f"z_{d}"), d)))
    if grid is not None:
        old = h.where("as_NAD27 IS NOT NULL").select(F.col("hole_id").alias("id"), F.col("as_NAD27.lon").alias("lon"), F.col("as_NAD27.lat").alias("lat"))
        moved = shifted(old, grid, step).select(F.col("id").alias("hole_id"), F.struct("lon", "lat").alias("moved"))
        h = h.join(moved, "hole_id", "left")
    else:
        h = h.withColumn("moved", F.lit(None).cast("struct<lon:double,lat:double>"))
    named = province.where("lon IS NOT NULL AND lat IS NOT NULL").select("file", name_key(F.col("name")).alias("key"), F.struct("source", "record", "lon", "lat").alias("p"))
    named = named.groupBy("file", "key").agg(F.min("p").alias("p"))
    h = h.withColumn("key", name_key(F.col("name"))).join(named, ["file", "key"], "left")
    new, old = F.col("datum_").isin("NAD83", "WGS84"), F.col("datum_") == "NAD27"
    right = F.col("status") == "transformed"
    own = F.when(right & old, F.col("moved")).when(right & new, F.col("as_NAD83"))
    status = F.when(right & own.isNull(), "transform_failed").otherwise(F.col("status"))
    place = F.coalesce(own, F.when(F.col("p").isNotNull(), F.struct(F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))))
    source = F.when(own.isNotNull() & old, "extracted_transformed").when(own.isNotNull(), "extracted_nad83").when(F.col("p.source") == 1, "provincial_geods").when(F.col("p").isNotNull(), "provincial_compilation").otherwise("none")
    apart = lambda a, b: geodesic(F.col(a).lon, F.col(a).lat, F.col(b).lon, F.col(b).lat).metres
    z = F.when(right & old, F.col("z_NAD27")).otherwise(F.coalesce("z_NAD83", "z_NAD27"))
    h = h.select(
        "hole_id", "file", status.alias("status"), source.alias("source"), place.alias("at"), F.col("datum_").alias("datum"), z.alias("zone"), (z.isNotNull() & F.col("zone_").isNull()).alias("zone_inferred"),
        F.when(F.col("status") == "not_transformable_no_datum", F.round(apart("moved", "as_NAD83"), 1)).alias("separation_m"),
        F.when(own.isNotNull() & old, F.round(apart("as_NAD27", "moved"), 2)).when(own.isNotNull(), 0.0).alias("shift_m"),
        F.when(own.isNull(), F.col("p.record")).alias("record"), "sheets",
    )
    # The nearest of the file's holes in the province: pairs within a file only.
    known = province.where("lon IS NOT NULL AND lat IS NOT NULL").select("file", F.col("lon").alias("px"), F.col("lat").alias("py")).distinct()
    near = h.where("at IS NOT NULL").select("hole_id", "file", "at").join(known, "file").groupBy("hole_id").agg(F.round(F.min(geodesic(F.col("at.lon"), F.col("at.lat"), F.col("px"), F.col("py")).metres) / 1000, 3).alias("file_km"))
    h = h.join(near, "hole_id", "left")
    return h.select(
        "hole_id", "status", "source", F.round("at.lon", 6).alias("lon"), F.round("at.lat", 6).alias("lat"), "datum", "zone", "zone_inferred", "separation_m", "shift_m", "record",
        F.when(F.col("at").isNotNull() & F.col("sheets").isNotNull(), inside(F.col("at"))).alias("inside_sheet"), "file_km", (F.col("file_km") <= FILE_KM).alias("inside_file"),
    )
