"""What changed in the columns between two loads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("role-changed", "removed", "added", "became-populated", "became-empty", "unchanged")


def diff_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, label, delta, role_before, role_after of all columns; a changed role outranks a changed population."""
    b = before.select("key", F.col("label").alias("l0"), F.col("role").alias("role_before"), F.col("is_empty").alias("e0"), F.lit(True).alias("in0"))
    a = after.select("key", F.col("label").alias("l1"), F.col("role").alias("role_after"), F.col("is_empty").alias("e1"), F.lit(True).alias("in1"))
    delta = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(F.col("role_before") != F.col("role_after"), "role-changed").when(F.col("e0") & ~F.col("e1"), "became-populated").when(~F.col("e0") & F.col("e1"), "became-empty").otherwise("unchanged")
    return b.join(a, "key", "full").select("key", F.coalesce("l1", "l0").alias("label"), delta.alias("delta"), "role_before", "role_after")


def _order() -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, ORDER)), F.col("delta")), F.col("label"), F.col("key")]


def drift_order(diff: DataFrame) -> DataFrame:
    return diff.orderBy(*_order())


def drift_positions(diff: DataFrame) -> DataFrame:
    """``diff`` with each column's place of ``drift_order`` from 1, numbered within its delta and moved by the deltas before it."""
    own = diff.withColumn("own", F.row_number().over(W.partitionBy("delta").orderBy("label", "key")))
    sizes = {d: F.count_if(F.col("delta") == d).alias(d) for d in ORDER}
    before = diff.agg(*sizes.values())  # one row
    earlier = F.coalesce(*(F.when(F.col("delta") == d, reduce(lambda a, b: a + b, (F.col(f"`{e}`") for e in ORDER[:i]), F.lit(0))) for i, d in enumerate(ORDER)))
    return own.crossJoin(F.broadcast(before)).withColumn("position", earlier + F.col("own")).select(*diff.columns, "position")


def drift_summary(diff: DataFrame) -> DataFrame:
    n = lambda d: F.count_if(F.col("delta") == d)
    return diff.agg(n("added").alias("added"), n("removed").alias("removed"), n("role-changed").alias("role_changed"), n("became-populated").alias("became_populated"), (F.count_if(F.col("delta") != "unchanged") == 0).alias("identical"))
