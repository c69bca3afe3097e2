"""Feature layers, dimension tables and flat sinks."""

from __future__ import annotations

import tomllib

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files as (type, coordinates, properties...); properties is a DDL list of what to keep.

    coordinates is JSON text, since its depth depends on the type; features without coordinates are dropped.
    """
    schema = f"features array<struct<geometry: struct<type: string, coordinates: string>, properties: struct<{properties}>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    out = f.select("f.geometry.type", "f.geometry.coordinates", "f.properties.*")
    return out.where("coordinates is not null and coordinates not in ('[]', 'null')")


def points_of(layer: DataFrame) -> DataFrame:
    """x and y of the point features of a layer."""
    xy = F.from_json("coordinates", "array<double>")
    return layer.where("type = 'Point'").withColumns({"x": xy[0], "y": xy[1]}).drop("type", "coordinates")


def lines_of(layer: DataFrame, id_: str) -> DataFrame:
    """(id, seq, x, y) of the vertices of the line features of a layer."""
    v = layer.where("type = 'LineString'").select(id_, F.posexplode(F.from_json("coordinates", "array<array<double>>")).alias("seq", "p"))
    return v.select(id_, "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def read_dimension(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """An array of tables of a TOML file; unknown keys are refused."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        rows = tomllib.loads(f.read().decode())[table]
    names = spark.createDataFrame([], schema).columns
    unknown = sorted({k for r in rows for k in r} - set(names))
    if unknown:
        raise ValueError(f"unknown keys in {table}: {unknown}")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def write_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV files in key order: the same rows give the same files."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("header", True).csv(path)


def write_geojson(df: DataFrame, path: str, x: str, y: str) -> None:
    """One feature to a line, coordinates rounded to five places."""
    rest = [c for c in df.columns if c not in (x, y)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.bround(x, 5), F.bround(y, 5)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties")))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)
