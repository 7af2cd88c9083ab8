"""Boundary features and alias maps from JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.text import clean_string, place_key

FEATURES = (
    "features array<struct<properties: struct<name: string, state: string, level: string, vintage: string, centroid: array<double>, bbox: array<double>>, geometry: struct<type: string, coordinates: string>>>"
)


def scan_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, level, state, name, vintage, centroid, bbox, geometry_type, coordinates; fails if features isn't a list."""
    raw = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    checked = raw.select(F.when(F.col("features").isNull(), F.raise_error(F.lit("features must be a list"))).otherwise(F.col("features")).alias("features"))
    each = checked.select(F.posexplode("features").alias("ordinal", "f"))
    return each.select("ordinal", "f.properties.level", "f.properties.state", "f.properties.name", "f.properties.vintage", "f.properties.centroid", "f.properties.bbox", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


ALIASES = "states map<string, string>, districts array<struct<`from`: string, `to`: string, state: string, note: string>>"


def present(spark: SparkSession, path: str) -> bool:
    """Whether anything can be read at a path, wherever it lies."""
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def scan_aliases(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State aliases (from_key, to, ordinal), district aliases (ordinal, from_key, to, state, note) and problems (level, ordinal, problem); no path or no such file, no rows."""
    raw = spark.read.schema(ALIASES).option("multiLine", True).json(path) if path and present(spark, path) else spark.createDataFrame([], ALIASES)
    s = raw.select(F.posexplode(F.map_entries("states")).alias("ordinal", "x")).select("ordinal", place_key("x.key").alias("from_key"), F.trim("x.value").alias("to"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("note"))
    d = raw.select(F.posexplode("districts").alias("ordinal", "x")).select("ordinal", place_key("x.from").alias("from_key"), F.trim("x.to").alias("to"), clean_string("x.state").alias("state"), "x.note")
    good = (F.coalesce("from_key", F.lit("")) != "") & (F.coalesce("to", F.lit("")) != "")
    lost = lambda df, level: df.where(~good).select(F.lit(level).alias("level"), "ordinal", F.when(F.coalesce("from_key", F.lit("")) == "", "no-from").otherwise("no-to").alias("problem"))
    return s.where(good).select("from_key", "to", "ordinal"), d.where(good).select("ordinal", "from_key", "to", "state", "note"), lost(s, "state").unionByName(lost(d, "district"))
