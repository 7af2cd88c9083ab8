"""Class intervals of region values: quantile, equal interval, natural breaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.values import bin_index
from landloom.operators.places import small
from landloom.sources.tables import written

CLASS_COUNTS = (3, 4, 5)


def scale_inputs(regions: DataFrame, state: str | None = None) -> DataFrame:
    """Values that a scale is made of: regions with a finite one, within a state if drilled into it."""
    out = regions.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return out.where(F.col("state") == state) if state else out


def quantile_breaks(value: str, k: int) -> Column:
    """Interior breaks by linear interpolation at i / k."""
    return F.percentile(value, F.array(*(F.lit(i / k) for i in range(1, k))))


def equal_breaks(lo: Column, hi: Column, k: Column) -> Column:
    """Interior breaks of k classes of one width."""
    return F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: lo + (hi - lo) / k * i)


def jenks(values: np.ndarray, k: int) -> list[float]:
    """First value of each later class of the partition of distinct sorted values with the least inner variance.

    The best last cut moves right as values are added, so each layer is solved by halves: n log n steps a class.
    """
    v = np.unique(values.astype(float))
    n = len(v)
    if n <= k:
        return v[1:].tolist()
    x = v - v.mean()
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = q - s * s / np.maximum(np.arange(n + 1), 1)  # of one class over the first i values
    froms = np.zeros((k + 1, n + 1), int)
    for c in range(2, k + 1):
        new = np.full(n + 1, np.inf)
        open_ = [(c, n, c - 1, n - 1)]  # ends from and to, and where their last class may start
        while open_:
            lo, hi, left, right = open_.pop()
            if lo > hi:
                continue
            i = (lo + hi) // 2
            j = np.arange(left, min(right, i - 1) + 1)
            total = cost[j] + (q[i] - q[j]) - (s[i] - s[j]) ** 2 / (i - j)
            best = int(total.argmin())
            new[i], froms[c, i] = total[best], j[best]
            open_ += [(lo, i - 1, left, int(j[best])), (i + 1, hi, int(j[best]), right)]
        cost = new
    out, i = [], n
    for c in range(k, 1, -1):
        i = froms[c, i]
        out.append(float(v[i]))
    return out[::-1]


def jenks_breaks(values: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys..., breaks of each group's distinct values (column ``value``); groups run in parallel, a group's region values in one task."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema if f.name in keys) + ", breaks array<double>"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, jenks(pdf["value"].to_numpy(), k)]], columns=[*keys, "breaks"])

    return values.select(*keys, "value").where("value is not null").distinct().groupBy(*keys).applyInPandas(run, schema)


def class_scale(values: DataFrame, keys: list[str], method: str, k: int) -> DataFrame:
    """keys..., edges, lo, hi, reduced_from of each group: an empty group has no row; one distinct value one class."""
    if k not in CLASS_COUNTS or method not in ("quantile", "equal", "jenks"):
        raise ValueError("unknown method or number of classes")
    v = scale_inputs(values)
    ends = v.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("value").alias("n"), *([F.array(*(quantile_breaks("value", j) for j in range(2, k + 1))).alias("q")] if method == "quantile" else []))
    if method == "jenks":
        ends = ends.join(jenks_breaks(v, keys, k).withColumnRenamed("breaks", "b"), keys)
    elif method == "quantile":
        ends = ends.withColumn("b", F.element_at("q", F.greatest(F.least(F.lit(k), F.col("n")).cast("int") - 1, F.lit(1))))
    else:
        ends = ends.withColumn("b", equal_breaks(F.col("lo"), F.col("hi"), F.least(F.lit(k), F.col("n"))))
    inner = F.array_sort(F.array_distinct(F.filter("b", lambda x: (x > F.col("lo")) & (x < F.col("hi")))))
    edges = F.concat(F.array("lo"), F.when(F.col("n") > 1, inner).otherwise(F.array().cast("array<double>")), F.array("hi"))
    return ends.select(*keys, edges.alias("edges"), "lo", "hi", F.when(F.size(edges) - 1 < k, F.lit(k)).alias("reduced_from"))


def bins(values: DataFrame, scale: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., bin_index, lo, hi, count of every class, empty ones too."""
    scale = written(scale, "scale")
    all_ = scale.select(*keys, "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin_index"))
    all_ = all_.select(*keys, "bin_index", F.get("edges", F.col("bin_index")).alias("lo"), F.get("edges", F.col("bin_index") + 1).alias("hi"))
    # values stay where they are: the edges of all groups are sent to them while they are few
    joined = values.join(small(scale.select(*keys, "edges")), keys) if keys else values.crossJoin(F.broadcast(scale.select("edges")))
    n = joined.select(*keys, bin_index("value", "edges").alias("bin_index")).where("bin_index >= 0").groupBy(*keys, "bin_index").agg(F.count("*").alias("count"))
    return all_.join(n, [*keys, "bin_index"], "left").fillna(0, ["count"])

