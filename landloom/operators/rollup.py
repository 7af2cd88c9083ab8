"""Rolling measures up per region, and keeping account of what could not be placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def record_value(numerators: list[str], denominator: str) -> Column:
    """Ratio of a record in per cent; null without a positive denominator or any numerator."""
    some = F.coalesce(*numerators).isNotNull() if numerators else F.lit(False)
    top = sum((F.coalesce(c, F.lit(0.0)) for c in numerators), F.lit(0.0))
    return F.when((F.col(denominator) > 0) & some, top / F.col(denominator) * 100)


def rollup_sum(value: str) -> Column:
    return F.sum(value)


def rollup_mean(value: str) -> Column:
    return F.avg(value)


def rollup_ratio(numerators: list[str], denominator: str) -> Column:
    """Ratio of sums in per cent over the records that have a ratio of their own."""
    valid = record_value(numerators, denominator).isNotNull()
    top = sum((F.coalesce(c, F.lit(0.0)) for c in numerators), F.lit(0.0))
    below = F.sum(F.when(valid, F.col(denominator)))
    return F.when(below > 0, F.sum(F.when(valid, top)) / below * 100)


def contributing_count(value: Column) -> Column:
    return F.count_if(value.isNotNull())


def region_counts(area: str = "area", with_ids: bool = False) -> list[Column]:
    """Records, distinct sites (a record without a site is its own) and area; the record ids only on demand, as they grow with the data."""
    out = [F.count("*").alias("records"), F.count_distinct(F.coalesce("site", "record_id")).alias("sites"), F.sum(F.coalesce(area, F.lit(0.0))).alias("area")]
    return out + [F.array_sort(F.collect_list("record_id")).alias("record_ids")] * with_ids


def rollup(resolved: DataFrame, level: str, *aggregates: Column) -> DataFrame:
    """One row per region that has records, keyed by (level, state, name): names that states share stay apart."""
    keys = {"state": [F.lit(None).cast("string").alias("state"), F.col("state_match").alias("name")], "district": [F.col("state_match").alias("state"), F.col("district_match").alias("name")]}[level]
    return resolved.where(F.col(f"{level}_match").isNotNull()).groupBy(F.lit(level).alias("level"), *keys).agg(*aggregates)


def rollup_levels(resolved: DataFrame, *aggregates: Column) -> DataFrame:
    """Both levels in one pass by grouping sets."""
    placed = resolved.where("state_match is not null").withColumns({"_s": F.col("state_match"), "_d": F.col("district_match")})
    grouped = placed.groupingSets([["_s"], ["_s", "_d"]], "_s", "_d").agg(F.grouping("_d").alias("_g"), *aggregates)
    grouped = grouped.where("_g = 1 or _d is not null")
    fine = F.col("_g") == 0
    return grouped.select(F.when(fine, "district").otherwise("state").alias("level"), F.when(fine, F.col("_s")).alias("state"), F.when(fine, F.col("_d")).otherwise(F.col("_s")).alias("name"), *[c for c in grouped.columns if c not in ("_s", "_d", "_g")])


def unmapped_records(resolved: DataFrame, level: str, value: Column) -> DataFrame:
    missing = F.col(f"{level}_match").isNull()
    return resolved.where(missing).select("record_id", "state", "district", "site", "area", value.alias("value"), F.coalesce("reason", F.lit(f"{level}_unmatched")).alias("reason"))


def mapped_totals(resolved: DataFrame, level: str, area: str = "area") -> DataFrame:
    """Area mapped, unmapped and in all, with the unmapped share in per cent (0 when empty)."""
    placed, a = F.col(f"{level}_match").isNotNull(), F.coalesce(area, F.lit(0.0))
    sums = resolved.agg(F.coalesce(F.sum(F.when(placed, a)), F.lit(0.0)).alias("area_mapped"), F.coalesce(F.sum(F.when(~placed, a)), F.lit(0.0)).alias("area_unmapped"), F.coalesce(F.sum(a), F.lit(0.0)).alias("area_total"), F.count_if(~placed).alias("records_unmapped"))
    return sums.withColumn("unmapped_share", F.when(F.col("area_total") > 0, F.col("area_unmapped") / F.col("area_total") * 100).otherwise(0.0))


def region_fill(boundaries: DataFrame, regions: DataFrame, edges: Column | None = None) -> DataFrame:
    """Every boundary with its region's value: class, zero, or no data (absent or null, told apart by reason)."""
    from landloom.functions.values import bin_index

    joined = boundaries.alias("b").join(regions.withColumn("_there", F.lit(True)).alias("r"), [F.col("b.level") == F.col("r.level"), F.col("b.state").eqNullSafe(F.col("r.state")), F.col("b.name") == F.col("r.name")], "left")
    v = F.col("r.value")
    fill = F.when(v.isNull(), "no data").when(v == 0, "zero").otherwise("class")
    reason = F.when(F.col("r._there").isNull(), "no records").when(v.isNull(), "no value")
    out = [F.col("b.level").alias("level"), F.col("b.state").alias("state"), F.col("b.name").alias("name"), v.alias("value"), fill.alias("fill"), reason.alias("reason")]
    return joined.select(*out, *([F.when(fill == "class", bin_index(v, edges)).alias("bin")] if edges is not None else []))


def legend_flags(filled: DataFrame) -> DataFrame:
    return filled.agg(F.coalesce(F.bool_or(F.col("fill") == "no data"), F.lit(False)).alias("any_no_data"), F.coalesce(F.bool_or(F.col("fill") == "zero"), F.lit(False)).alias("any_zero"), F.count_if(F.col("value").isNotNull()).alias("with_value"))


def region_badges(boundaries: DataFrame, regions: DataFrame, state: str | None = None) -> DataFrame:
    """Sites of each district that has some, with the district's centroid."""
    b = boundaries.where("level = 'district'").select("level", "state", "name", "centroid")
    out = b.join(regions.select("level", "state", "name", "sites"), ["level", "state", "name"])
    return out.where(F.col("state") == state) if state else out


def region_records(resolved: DataFrame, regions: DataFrame, level: str) -> DataFrame:
    """The records behind some regions (level, state, name)."""
    r = regions.where(F.col("level") == level).select(F.col("state").alias("_s"), F.col("name").alias("_n"))
    on = (F.col("state_match") == F.col("_n")) if level == "state" else (F.col("state_match") == F.col("_s")) & (F.col("district_match") == F.col("_n"))
    return resolved.join(r, on, "left_semi")


def region_site_list(records: DataFrame, value: Column) -> DataFrame:
    """Records of a region with area, value and the region's total area, by area, largest first."""
    total = records.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("total_area"))
    return records.select("record_id", "site", "area", value.alias("value")).crossJoin(F.broadcast(total)).orderBy(F.coalesce("area", F.lit(0.0)).desc(), "record_id")


def top_regions(regions: DataFrame, n: int = 15) -> DataFrame:
    """The n regions of the greatest value, and each value's share of the largest."""
    best = regions.where("value is not null").orderBy(F.desc("value"), "level", "state", "name").limit(n)
    return best.withColumn("share", F.when(F.max("value").over(W.partitionBy()) > 0, F.col("value") / F.max("value").over(W.partitionBy())))


def sort_records(records: DataFrame, column: str, descending: bool = False) -> DataFrame:
    c = F.col(column)
    return records.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "record_id")


def page(ordered: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of ordered rows; the number is clamped to the pages there are."""
    last = max(0, (ordered.count() - 1) // size)
    return ordered.offset(min(max(0, number), last) * size).limit(size)


def page_after(records: DataFrame, column: str, last: tuple | None, size: int = 50, descending: bool = False) -> DataFrame:
    """The page behind a row (its value of ``column`` and record_id; none for the first), in the order of ``sort_records``.

    It costs one filtered top-``size`` pass however deep the page is, and no row is counted or skipped.
    """
    if last is not None:
        value, at = last
        c, later = F.col(column), F.col("record_id") > F.lit(at)
        if value is None:
            records = records.where(c.isNull() & later)
        else:
            v = F.lit(value)
            records = records.where(c.isNull() | ((c < v) if descending else (c > v)) | ((c == v) & later))
    return sort_records(records, column, descending).limit(size)
