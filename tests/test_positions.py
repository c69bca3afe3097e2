"""Statuses of printed positions, each reached by a hole; projections and shifts against published and plain values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar.operators import positions

HOLE = "hole_id string, file string, name string, easting double, northing double, lat double, lon double, grid_x double, grid_y double, datum string, zone string, local_page boolean"


def hole(i, easting=None, northing=None, lat=None, lon=None, gx=None, datum=None, zone=None, local=None, name=None, file="F"):
    return (i, file, name or i, easting, northing, lat, lon, gx, None, datum, zone, local)


def test_every_status_and_source_is_reached(spark):
    rows = [
        hole("none"), hole("none_named", name="R 78 027"), hole("grid", gx=3.0), hole("far", 1000.0, 2000.0), hole("page", local=True),
        hole("both", 500_000.0, 6_400_000.0, gx=4.0, datum="NAD83", zone="13"), hole("no_datum", 500_000.0, 6_400_000.0, zone="13"), hole("no_datum_named", 500_000.0, 6_400_000.0, datum="local", zone="13", name="KL005"),
        hole("old", 500_000.0, 6_400_000.0, datum="N.A.D. 1927 / nad27", zone="Zone 13V"), hole("old_outside", lat=80.0, lon=105.0, datum="NAD27"), hole("new", lat=57.7, lon=105.0, datum="WGS 84"),
        hole("zone", 450_000.0, 6_400_000.0, datum="NAD83"), hole("zone_middle", 500_000.0, 5_450_000.0, datum="NAD83"), hole("nowhere", 500_000.0, 6_400_000.0, datum="NAD83", file="G"),
    ]
    province = spark.createDataFrame([("F", "R-78-27", 2, "c1", -104.9, 57.6), ("F", "r78-027", 1, "g2", -104.8, 57.6), ("F", "KL-5", 2, "c3", -105.0, 57.71), ("F", "grid", 1, "g4", None, None), ("H", "none", 1, "g5", -1.0, 1.0)], "file string, name string, source int, record string, lon double, lat double")
    sheets = spark.createDataFrame([("F", -106.0, 57.0, -104.0, 58.0)], "file string, x0 double, y0 double, x1 double, y1 double")
    grid = spark.createDataFrame([(x, y, -0.0006, 0.0001) for x in range(-1062, -1038) for y in range(565, 590)], "gx long, gy long, dlon double, dlat double")
    got = {r.hole_id: r for r in positions.positions(spark.createDataFrame(rows, HOLE), province, sheets, grid).collect()}
    told = {k: (r.status, r.source) for k, r in got.items()}
    assert told == {
        "none": ("no_coordinates", "none"), "none_named": ("no_coordinates", "provincial_geods"), "grid": ("not_transformable_local_grid", "none"), "far": ("not_transformable_local_grid", "none"), "page": ("not_transformable_local_grid", "none"),
        "both": ("transformed", "extracted_nad83"), "no_datum": ("not_transformable_no_datum", "none"), "no_datum_named": ("not_transformable_no_datum", "provincial_compilation"), "old": ("transformed", "extracted_transformed"),
        "old_outside": ("transform_failed", "none"), "new": ("transformed", "extracted_nad83"), "zone": ("transformed", "extracted_nad83"), "zone_middle": ("transformed", "extracted_nad83"), "nowhere": ("transform_failed", "none"),
    }
    assert got["none_named"].record == "g2" and got["no_datum_named"].record == "c3" and got["both"].record is None
    assert 150 < got["no_datum"].separation_m < 260 and 30 < got["old"].shift_m < 45 and got["new"].shift_m == 0.0
    assert (got["zone"].zone, got["zone"].zone_inferred, got["zone_middle"].zone, got["both"].zone_inferred) == (13, True, 13, False)
    assert (got["new"].inside_sheet, got["zone_middle"].inside_sheet, got["none"].inside_sheet) == (True, False, None)
    assert got["no_datum_named"].file_km == 0.0 and got["no_datum_named"].inside_file and not got["zone_middle"].inside_file
    none = {r.hole_id: r.status for r in positions.positions(spark.createDataFrame(rows, HOLE), province, sheets).collect()}
    assert none["old"] == "transform_failed"


def test_datums_and_zones(spark):
    rows = [("NAD27", "NAD27"), ("N.A.D. 83 CSRS", "NAD83"), ("nad (1927 mean)", "NAD27"), ("WGS 84", "WGS84"), ("local", None), (None, None), ("1927", None)]
    got = spark.createDataFrame(rows, "t string, want string").select(positions.datum_of(F.col("t")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    zones = spark.createDataFrame([("13V",), ("Zone 12",), ("99",), ("",), (None,), ("0",)], "z string").select(positions.zone_of(F.col("z"))).collect()
    assert [r[0] for r in zones] == [13, 12, None, None, None, None]


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(-79.387139, 43.642567, 17), (-105.0, 58.0, 13), (-107.9, 57.2, 13), (-102.1, 59.9, 13)], "lon double, lat double, zone int")
    for datum in ("NAD83", "NAD27"):
        r = df.withColumn("u", positions.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), datum)).withColumn("g", positions.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("zone"), datum)).collect()
        assert all(abs(x.g.lon - x.lon) < 1e-9 and abs(x.g.lat - x.lat) < 1e-9 for x in r)
        if datum == "NAD83":
            assert r[0].u.easting == pytest.approx(630084, abs=1) and r[0].u.northing == pytest.approx(4833438, abs=1)
            assert r[1].u.easting == pytest.approx(500_000, abs=1e-6)


def test_shifts_are_taken_in_proportion(spark):
    grid = spark.createDataFrame([(x, y, 0.01 * x, 0.02 * y) for x in range(3) for y in range(3)], "gx long, gy long, dlon double, dlat double")
    points = spark.createDataFrame([(1, 0.15, 0.05), (2, 0.1, 0.1), (3, 0.95, 0.1)], "id long, lon double, lat double")
    got = {r.id: (r.lon, r.lat) for r in positions.shifted(points, grid, 0.1).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx((0.165, 0.06)) and got[2] == pytest.approx((0.11, 0.12))
