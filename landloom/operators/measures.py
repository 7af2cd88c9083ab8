"""The catalogue of measures: a sheet's own, and ratios derived from bound columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHEET = ["book", "sheet"]


def infer_aggregation(key: Column) -> Column:
    k = F.trim(F.lower(key))
    return F.when(k.endswith("%") | k.endswith("(%)") | k.contains("rate") | k.contains("percent"), "mean").otherwise("sum")


def infer_unit(key: Column) -> Column:
    k = F.lower(key)
    return (
        F.when(k.endswith("%") | k.endswith("(%)") | k.contains("percent"), "percent").when(F.regexp_like(k, F.lit("rate|value|cost|price")), "currency-inr").when(F.regexp_like(k, F.lit("acre|acer|area|land")), "acre").otherwise("number")
    )


def measure_catalogue(catalogue: DataFrame, bindings: DataFrame) -> DataFrame:
    """Sheet measures, then up to three ratios (utilisation, private tenure, government tenure) where their columns are bound."""
    sheet = catalogue.where("effective_role = 'measure'").select(
        *SHEET, F.concat(F.lit("sheet:"), "key").alias("id"), F.lit("sheet").alias("kind"), "label", F.array("key").alias("numerator_keys"), F.lit(None).cast("string").alias("denominator_key"),
        infer_aggregation(F.col("key")).alias("aggregation"), infer_unit(F.col("key")).alias("unit"), "is_empty", F.lit(None).cast("string").alias("superseded_by"), F.col("col_idx").alias("ordinal"), "key",
    )
    better = sheet.where(F.regexp_like(F.lower("key"), F.lit("utili[sz]ation")) & ~F.col("is_empty")).groupBy(*SHEET).agg(F.min_by("id", "ordinal").alias("better"))
    roles = bindings.groupBy(*SHEET).pivot("role", ["total", "used", "private-sale", "private-lease", "govt-revenue"]).agg(F.first("key")).where("total is not null").join(better, SHEET, "left")
    compact = lambda *c: F.array_compact(F.array(*(F.col(f"`{x}`") for x in c)))
    kinds = [("derived:utilisation", "Utilisation %", compact("used"), F.col("better"), 1), ("derived:private-tenure", "Private tenure %", compact("private-sale", "private-lease"), F.lit(None).cast("string"), 2), ("derived:govt-tenure", "Govt tenure %", compact("govt-revenue"), F.lit(None).cast("string"), 3)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(la).alias("label"), n.alias("numerator_keys"), s.alias("superseded_by"), F.lit(1_000_000 + o).alias("ordinal")) for i, la, n, s, o in kinds)))
    derived = roles.select(*SHEET, "total", each.alias("x")).where(F.size("x.numerator_keys") > 0)
    derived = derived.select(*SHEET, "x.id", F.lit("derived").alias("kind"), "x.label", "x.numerator_keys", F.col("total").alias("denominator_key"), F.lit("ratio").alias("aggregation"), F.lit("percent").alias("unit"), F.lit(False).alias("is_empty"), "x.superseded_by", "x.ordinal", F.lit(None).cast("string").alias("key"))
    return sheet.unionByName(derived)


def default_measure(measures: DataFrame) -> DataFrame:
    """One id a sheet: populated total area or land, then any populated, a derived one, any."""
    k, full = F.coalesce("key", F.lit("")), (F.col("kind") == "sheet") & ~F.col("is_empty")
    rank = F.when(full & k.contains("total") & (k.contains("area") | k.contains("land")), 0).when(full, 1).when(F.col("kind") == "derived", 2).otherwise(3)
    best = measures.withColumn("_r", F.row_number().over(W.partitionBy(*SHEET).orderBy(rank, "ordinal"))).where("_r = 1")
    return best.select(*SHEET, F.col("id").alias("default_id"))
