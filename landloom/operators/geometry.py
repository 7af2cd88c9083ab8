"""Geometry over exploded vertices (file, feature, polygon, ring, seq, lng, lat), without a geometry library.

Ring 0 of a polygon is its outer ring. Rings may or may not repeat their first vertex at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOUNDS = (6.0, 38.0, 68.0, 98.0)  # fixed values: lat from, to; lng from, to
RING = ["file", "feature", "polygon", "ring"]
#: Vertices of a task, so that its memory doesn't grow with the table.
DEALT = 1_000_000


def in_bounds(lat: Column, lng: Column, bounds: tuple = BOUNDS) -> Column:
    return lat.between(bounds[0], bounds[1]) & lng.between(bounds[2], bounds[3])


def swap_positions(vertices: DataFrame) -> DataFrame:
    return vertices.withColumns({"lng": F.col("lat"), "lat": F.col("lng")})


def filter_raw_boundaries(features: DataFrame, vintage: str) -> DataFrame:
    """Features with a district; names trimmed, the vintage carried."""
    return features.where(F.trim("district") != "").withColumn("district", F.trim("district")).withColumn("state", F.trim("state")).withColumn("vintage", F.lit(vintage))


def dissolve_parts(features: DataFrame, with_polygons: bool = False) -> DataFrame:
    """Districts as one feature a (state, district), then states as one a state: level, state, name, parts, vintage. features: ..., polygons.

    Shared borders are kept. ``with_polygons`` adds polygons, an array of a whole region; ``dissolved_polygons`` has them as rows.
    """
    gathered = [F.flatten(F.collect_list("polygons")).alias("polygons")] * with_polygons
    kept = ["parts", "vintage", *["polygons"] * with_polygons]
    sized = features.withColumn("parts", F.greatest(F.coalesce(F.size("polygons"), F.lit(0)), F.lit(0)))
    merged = sized.groupBy("state", "district").agg(F.sum("parts").alias("parts"), F.min("vintage").alias("vintage"), *gathered)
    districts = merged.select(F.lit("district").alias("level"), "state", F.col("district").alias("name"), *kept)
    states = merged.groupBy("state").agg(F.sum("parts").alias("parts"), F.min("vintage").alias("vintage"), *gathered)
    return districts.unionByName(states.select(F.lit("state").alias("level"), F.lit(None).cast("string").alias("state"), F.col("state").alias("name"), *kept))


def dissolved_polygons(features: DataFrame) -> DataFrame:
    """level, state, name, polygon: every polygon of each district and again of each state."""
    rows = features.select("state", "district", F.explode("polygons").alias("polygon"))
    districts = rows.select(F.lit("district").alias("level"), "state", F.col("district").alias("name"), "polygon")
    return districts.unionByName(rows.select(F.lit("state").alias("level"), F.lit(None).cast("string").alias("state"), F.col("state").alias("name"), "polygon"))


def feature_bbox(vertices: DataFrame, keys: tuple[str, ...] = ("file", "feature")) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return vertices.groupBy(*keys).agg(r(F.min("lng")).alias("west"), r(F.min("lat")).alias("south"), r(F.max("lng")).alias("east"), r(F.max("lat")).alias("north"))


def _dealt(vertices: DataFrame, *keys: str) -> DataFrame:
    """``vertices`` dealt by keys once, for windows and groups of these and further columns, to as many tasks as their number asks for."""
    least = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vertices.repartition(max(least, -(-vertices.count() // DEALT)), *keys)


def _edges(vertices: DataFrame) -> DataFrame:
    """Each vertex with the next of its ring; the last goes back to the first."""
    order = W.partitionBy(*RING).orderBy("seq")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return vertices.withColumn("lng2", nxt("lng")).withColumn("lat2", nxt("lat"))


def feature_centroid(vertices: DataFrame) -> DataFrame:
    """Area-weighted centroid over outer rings; the middle of the box where all have no area."""
    e = _edges(_dealt(vertices, "file", "feature")).withColumn("cross", F.col("lng") * F.col("lat2") - F.col("lng2") * F.col("lat"))
    box = [f(c).alias(f"{n}_{c}") for c in ("lng", "lat") for n, f in (("lo", F.min), ("hi", F.max))]
    rings = e.groupBy(*RING).agg((F.sum("cross") / 2).alias("a"), F.sum((F.col("lng") + F.col("lng2")) * F.col("cross")).alias("x"), F.sum((F.col("lat") + F.col("lat2")) * F.col("cross")).alias("y"), *box)
    outer = (F.col("ring") == 0) & (F.col("a") != 0)
    mean = lambda c: F.sum(F.when(outer, F.col(c) / (6 * F.col("a")) * F.abs("a"))) / F.sum(F.when(outer, F.abs("a")))
    middle = lambda c: (F.min(f"lo_{c}") + F.max(f"hi_{c}")) / 2
    return rings.groupBy("file", "feature").agg(F.coalesce(mean("x"), middle("lng")).alias("lng"), F.coalesce(mean("y"), middle("lat")).alias("lat"))


def representative_point(vertices: DataFrame) -> DataFrame:
    """A point inside each file's polygons: the middle of the widest inner stretch of a line at mid-height of the largest polygon.

    Where a file has points or lines alone, its first vertex. The line is put between vertices' heights, so
    that it crosses edges and never touches a vertex.
    """
    vertices = _dealt(vertices, "file")
    e = _edges(vertices)
    area = e.where("ring = 0").groupBy("file", "feature", "polygon").agg(F.abs(F.sum(F.col("lng") * F.col("lat2") - F.col("lng2") * F.col("lat"))).alias("a"))
    best = area.where("a > 0").groupBy("file").agg(F.max_by(F.struct("feature", "polygon"), F.struct("a", (-F.col("feature")).alias("f"), (-F.col("polygon")).alias("p"))).alias("b"))
    own = e.join(best, "file").where("feature = b.feature and polygon = b.polygon")
    mid = own.groupBy("file").agg(((F.min("lat") + F.max("lat")) / 2).alias("half"))
    near = own.join(mid, "file").groupBy("file").agg(F.max(F.when(F.col("lat") <= F.col("half"), F.col("lat"))).alias("below"), F.min(F.when(F.col("lat") > F.col("half"), F.col("lat"))).alias("above"))
    line = near.select("file", ((F.col("below") + F.col("above")) / 2).alias("y"))
    cuts = own.join(line, "file").where((F.least("lat", "lat2") < F.col("y")) & (F.greatest("lat", "lat2") > F.col("y")))
    cuts = cuts.select("file", "y", (F.col("lng") + (F.col("y") - F.col("lat")) / (F.col("lat2") - F.col("lat")) * (F.col("lng2") - F.col("lng"))).alias("x"))
    order = W.partitionBy("file").orderBy("x")
    spans = cuts.withColumn("n", F.row_number().over(order)).withColumn("x2", F.lead("x").over(order)).where("n % 2 = 1 and x2 is not null")
    inside = spans.groupBy("file").agg(F.max_by(F.struct(((F.col("x") + F.col("x2")) / 2).alias("lng"), F.col("y").alias("lat")), F.struct(F.col("x2") - F.col("x"), -F.col("x"))).alias("p"))
    first = vertices.groupBy("file").agg(F.min_by(F.struct("lng", "lat"), F.struct(*RING[1:], "seq")).alias("q"))
    return first.join(inside, "file", "left").select("file", F.coalesce("p", "q").alias("point")).select("file", "point.lng", "point.lat")


def coordinate_quality(vertices: DataFrame, bounds: tuple = BOUNDS) -> DataFrame:
    """file, positions, out_of_bounds, suspected_swap: whether all positions outside would be inside when transposed."""
    ok, swapped = in_bounds(F.col("lat"), F.col("lng"), bounds), in_bounds(F.col("lng"), F.col("lat"), bounds)
    out = vertices.groupBy("file").agg(F.count("*").alias("positions"), F.count_if(~ok).alias("out_of_bounds"), F.count_if(~ok & ~swapped).alias("lost"))
    return out.select("file", "positions", "out_of_bounds", ((F.col("out_of_bounds") > 0) & (F.col("lost") == 0)).alias("suspected_swap"))


def file_parse_status(files: DataFrame, vertices: DataFrame, swap: bool = False, bounds: tuple = BOUNDS) -> DataFrame:
    """file, parse_status, warnings of every file (file, warnings of its reading); positions outside make it unparseable unless the swap was asked for and helps."""
    q = coordinate_quality(swap_positions(vertices) if swap else vertices, bounds)
    joined = files.join(q, "file", "left")
    n = F.coalesce("positions", F.lit(0))
    codes = F.transform("warnings", lambda w: w["code"])
    bad = F.col("out_of_bounds") > 0
    extra = F.array_compact(F.array(
        F.when((n == 0) & ~F.array_contains(codes, "unreadable"), F.struct(F.lit("no-placemark-geometry").alias("code"), F.lit("No placemark has a geometry.").alias("message"))),
        F.when(bad, F.struct(F.lit("coordinates-out-of-range").alias("code"), F.when(F.col("suspected_swap"), "Positions lie outside; latitude and longitude may be swapped.").otherwise("Positions lie outside.").alias("message"))),
    ))
    return joined.select("file", F.when((n == 0) | F.coalesce(bad, F.lit(False)), "unparseable").otherwise("parsed").alias("parse_status"), F.concat("warnings", extra).alias("warnings"))


def boundary_manifest(dim: DataFrame, settings: dict[str, str]) -> DataFrame:
    out = dim.groupBy("level").agg(F.count("*").alias("features"), F.array_sort(F.collect_set("vintage")).alias("vintages"))
    return out.withColumns({k: F.lit(v) for k, v in settings.items()})


def write_manifest(dim: DataFrame, settings: dict[str, str], path: str) -> None:
    boundary_manifest(dim, settings).write.mode("overwrite").json(path)
