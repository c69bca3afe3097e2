"""Angles, distances and bearings as columns. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
POINTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north of a plane step, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx.cast("double"), dy.cast("double"))), F.lit(360.0))


def angle_between(a: Column, b: Column, turn: float = 360.0) -> Column:
    """Smallest difference of two directions; turn 180 for axes."""
    d = F.pmod(a.cast("double") - b.cast("double"), F.lit(turn))
    return F.least(d, F.lit(turn) - d)


def compass(degrees: Column) -> Column:
    """The nearest of the eight compass points."""
    step = F.pmod(F.floor((degrees.cast("double") + 22.5) / 45), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, POINTS)), step + 1)


def axis(dx: Column, dy: Column) -> Column:
    """Direction of a line without sense, in [0, 180)."""
    return F.pmod(bearing(dx, dy), F.lit(180.0))


def mean_axis(angle: Column, weight: Column) -> Column:
    """Aggregate: weighted mean of axes, by doubled angles."""
    twice = F.radians(2 * angle.cast("double"))
    return F.pmod(F.degrees(F.atan2(F.sum(weight * F.sin(twice)), F.sum(weight * F.cos(twice)))) / 2, F.lit(180.0))


def utm_zone(lon: Column) -> Column:
    """UTM zone of a longitude; null outside [-180, 180]."""
    return F.when(lon.between(-180, 180), F.least(F.lit(60), (F.floor((lon + 180) / 6) + 1)).cast("int"))


#: The WGS 84 ellipsoid.
AXIS_M, FLAT = 6378137.0, 1 / 298.257223563


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 24) -> Column:
    """struct(metres, bearing) of the shortest line on the ellipsoid, by Vincenty's iteration with a fixed number of rounds.

    Within a millimetre; null where it has not settled (points that are nearly opposite), for unknown coordinates and those out of range. The
    bearing is that at the first point, clockwise from north; null for equal points, which are 0 apart.
    """
    b = AXIS_M * (1 - FLAT)
    u1, u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat1))), F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    s1, c1, s2, c2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
    wide = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)
    fixed = F.struct(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"), wide.alias("l"))

    def angles(f: Column, lam: Column) -> dict[str, Column]:
        sin_s = F.sqrt(F.pow(f.c2 * F.sin(lam), 2) + F.pow(f.c1 * f.s2 - f.s1 * f.c2 * F.cos(lam), 2))
        cos_s = f.s1 * f.s2 + f.c1 * f.c2 * F.cos(lam)
        sin_a = F.try_divide(f.c1 * f.c2 * F.sin(lam), sin_s)
        cos2_a = 1 - F.pow(sin_a, 2)
        mid = F.coalesce(cos_s - F.try_divide(2 * f.s1 * f.s2, cos2_a), F.lit(0.0))  # on the equator cos2_a is 0
        return {"sin_s": sin_s, "cos_s": cos_s, "s": F.atan2(sin_s, cos_s), "sin_a": sin_a, "cos2_a": cos2_a, "mid": mid}

    def step(state: Column, _: Column) -> Column:
        f, v = state.f, angles(state.f, state.lam)
        c = FLAT / 16 * v["cos2_a"] * (4 + FLAT * (4 - 3 * v["cos2_a"]))
        lam = f.l + (1 - c) * FLAT * v["sin_a"] * (v["s"] + c * v["sin_s"] * (v["mid"] + c * v["cos_s"] * (2 * F.pow(v["mid"], 2) - 1)))
        return F.struct(f.alias("f"), lam.alias("lam"), state.lam.alias("last"))

    def finish(state: Column) -> Column:
        f, v = state.f, angles(state.f, state.lam)
        u = v["cos2_a"] * (AXIS_M**2 - b**2) / b**2
        big_a, big_b = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        inner = v["cos_s"] * (2 * F.pow(v["mid"], 2) - 1) - big_b / 6 * v["mid"] * (4 * F.pow(v["sin_s"], 2) - 3) * (4 * F.pow(v["mid"], 2) - 3)
        metres = b * big_a * (v["s"] - big_b * v["sin_s"] * (v["mid"] + big_b / 4 * inner))
        turn = F.atan2(f.c2 * F.sin(state.lam), f.c1 * f.s2 - f.s1 * f.c2 * F.cos(state.lam))
        settled = (F.abs(state.lam - state.last) < 1e-11) & (F.abs(state.lam) <= 3.2)
        return F.when(settled, F.struct(metres.alias("metres"), F.pmod(F.degrees(turn), F.lit(360.0)).alias("bearing")))

    start = F.struct(fixed.alias("f"), wide.alias("lam"), F.lit(9.0).alias("last"))
    ok = lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.between(-360, 360) & lon2.between(-360, 360)
    same = (lat1 == lat2) & (F.abs(wide) < 1e-15)
    nothing = F.struct(F.lit(0.0).alias("metres"), F.lit(None).cast("double").alias("bearing"))
    return F.when(ok & same, nothing).when(ok, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, finish))
