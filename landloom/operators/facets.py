"""Filtering by cascading facets, for many views at once.

Rows: record_id, business, state, district, site and measures. Selections: view_id, dimension, value. Ranges: view_id,
measure, lo, hi. An empty selection of a dimension means no constraint; null never matches a selection or a
range. The cascade has four fixed steps, so views are handled together, not by loops over views.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.operators.places import BROADCAST_ROWS, small
from landloom.sources.tables import written

DIMENSIONS = ("business", "state", "district", "site")
#: Ends of ranges that one call may have, over all measures and views.
MOST_ENDS = 100_000


def facet_rows(resolved: DataFrame, measures: list[str]) -> DataFrame:
    return resolved.select("record_id", "business", F.col("state_match").alias("state"), F.col("district_match").alias("district"), "site", *measures)


def in_selection(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(True)


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(m).between(lo, hi), F.lit(False)) for m, (lo, hi) in ranges.items()), F.lit(True))


def rows_matching(rows: DataFrame, selections: dict[str, list[str]], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows of one view: the given dimensions' selections and all ranges."""
    test = reduce(lambda a, b: a & b, (in_selection(F.col(d), v) for d, v in selections.items()), F.lit(True))
    return rows.where(test & in_ranges(ranges or {}))


def _range_sets(ranges: DataFrame, measures: list[str]) -> DataFrame:
    """view_id and its ranges as one sorted array; views without ranges have no row."""
    return ranges.where(F.col("measure").isin(*measures)).groupBy("view_id").agg(F.array_sort(F.collect_list(F.struct("measure", "lo", "hi"))).alias("range_set"))


def _holds(measures: list[str]) -> Column:
    """Whether a row's measures lie in every range of ``range_set``; null never does."""
    value = lambda x: F.coalesce(*(F.when(x["measure"] == m, F.col(m)) for m in measures), F.lit(None))
    return F.forall("range_set", lambda x: F.coalesce(value(x).between(x["lo"], x["hi"]), F.lit(False))) if measures else F.lit(True)


_NO_RANGES = "array<struct<measure:string,lo:double,hi:double>>"


def _ends(ranges: DataFrame, measures: list[str]) -> dict[str, list[float]]:
    """Sorted distinct ends of each measure's ranges; they are part of the question and counted first."""
    ends = ranges.where(F.col("measure").isin(*measures)).select("measure", F.explode(F.array("lo", "hi")).alias("end")).where("end is not null and not isnan(end)").distinct()
    found = ends.limit(MOST_ENDS + 1).collect()
    if len(found) > MOST_ENDS:
        raise ValueError(f"more than {MOST_ENDS} ends of ranges: ask in several calls")
    return {m: sorted(r["end"] for r in found if r["measure"] == m) for m in measures}


def interval(value: Column, ends: list[float]) -> Column:
    """The elementary interval of a value: twice the ends below it, and one more if it is an end itself; by binary search, null for null."""
    held = F.from_json(F.lit(json.dumps(list(map(repr, ends)))), "array<string>").cast("array<double>")  # one constant
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, len(ends).bit_length())))))
    n = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))
    return F.when(value.isNotNull() & ~F.isnan(value), 2 * n - F.coalesce(F.get(held, n - 1) == value, F.lit(False)).cast("int"))


def viewed(rows: DataFrame, views: DataFrame, ranges: DataFrame, measures: list[str]) -> DataFrame:
    """view_id, the four dimensions, rows and ranged_rows (those within the view's ranges): one row a view and combination of values.

    The ends of all ranges cut a measure into elementary intervals. Rows are read once and counted by their values and intervals, before and after the
    shuffle; these counts then meet the views, whose ranges are runs of intervals. All that follows reads this table, which is written and grows with the
    combinations alone.
    """
    measures = [m for m in measures if m in rows.columns]
    ends = _ends(ranges, measures)
    used = [m for m in measures if ends[m]]
    combined = rows.select(*DIMENSIONS, *(interval(F.col(m).cast("double"), ends[m]).alias(f"_at_{m}") for m in used)).groupBy(*DIMENSIONS, *(f"_at_{m}" for m in used)).agg(F.count("*").alias("n"))
    at = lambda c: F.coalesce(*(F.when(F.col("measure") == m, interval(F.col(c), ends[m])) for m in used), F.lit(None).cast("int"))
    asked = ranges.where(F.col("measure").isin(*measures))
    runs = asked.groupBy("view_id").agg(F.collect_list(F.struct("measure", at("lo").alias("lo"), at("hi").alias("hi"))).alias("runs"))
    none = F.array().cast("array<struct<measure:string,lo:int,hi:int>>")
    own = views.select("view_id").distinct().join(runs, "view_id", "left").select("view_id", F.coalesce("runs", none).alias("runs"))
    lies = lambda x: F.coalesce(*(F.when(x["measure"] == m, F.col(f"_at_{m}").between(x["lo"], x["hi"])) for m in used), F.lit(False))
    # every combination is asked by every view: the views are sent to the combinations
    each = combined.join(small(own), F.lit(True))
    return written(each.groupBy("view_id", *DIMENSIONS).agg(F.sum("n").alias("rows"), F.sum(F.when(F.forall("runs", lies), F.col("n")).otherwise(0)).alias("ranged_rows")), "combinations")


def _sent(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts tables that are no longer than ``df``, if that is short: one count for all of them."""
    return F.broadcast if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x


def _marked(by_view: DataFrame, values: DataFrame, dimensions: tuple[str, ...], send: Callable) -> DataFrame:
    """Adds hit_<dimension>: whether ``values`` (view_id, dimension, value) has the row's value."""
    for d in dimensions:
        own = values.where(F.col("dimension") == d).select("view_id", F.col("value").alias(d), F.lit(True).alias(f"hit_{d}"))
        by_view = by_view.join(send(own), ["view_id", d], "left").withColumn(f"hit_{d}", F.coalesce(f"hit_{d}", F.lit(False)))
    return by_view


def _flags(by_view: DataFrame, active: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, send: Callable | None = None) -> DataFrame:
    """Adds in_<dimension>: no active value in the view, or the row's value is active."""
    send = send or _sent(active)
    held = active.groupBy("view_id").pivot("dimension", list(DIMENSIONS)).agg(F.count("value"))
    out = by_view.join(send(held.withColumnsRenamed({d: f"_{d}" for d in DIMENSIONS})), "view_id", "left")
    out = _marked(out, active, dimensions, send).withColumns({f"in_{d}": F.col(f"_{d}").isNull() | F.col(f"hit_{d}") for d in dimensions})
    return out.drop(*(f"_{d}" for d in DIMENSIONS), *(f"hit_{d}" for d in dimensions))


def _all(dimensions) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"in_{d}") for d in dimensions), F.lit(True))


def _available(by_view: DataFrame, active: DataFrame, dimension: str, send: Callable) -> DataFrame:
    """view_id, value: distinct values under the active ones of all dimensions above and the ranges; the first ignores all."""
    above = DIMENSIONS[: DIMENSIONS.index(dimension)]
    rows = by_view.where(F.col(dimension).isNotNull())
    if above:
        rows = _flags(rows.where("ranged_rows > 0"), active, above, send).where(_all(above))
    return rows.select("view_id", F.col(dimension).alias("value")).distinct()


def compute_active(by_view: DataFrame, selections: DataFrame) -> DataFrame:
    """view_id, dimension, value: selected values that are available under the active ones above; written.

    Only selected values matter here, so the combinations are first summed by them (others are one): a table as small as the selections allow, on
    which the cascade's four steps are windows within a view.
    """
    chosen = selections.select("view_id", "dimension", "value").where("value is not null").distinct()
    marked = _marked(by_view, chosen, DIMENSIONS, _sent(chosen))
    own = [F.when(F.col(f"hit_{d}"), F.col(d)).alias(d) for d in DIMENSIONS]
    cube = marked.groupBy("view_id", *own).agg((F.sum("ranged_rows") > 0).alias("ranged")).withColumn("open", F.lit(True))
    view = W.partitionBy("view_id")
    for i, d in enumerate(DIMENSIONS):
        reached = F.max(F.col("open") & (F.col("ranged") | F.lit(i == 0))).over(W.partitionBy("view_id", d))
        cube = cube.withColumn(f"act_{d}", F.col(d).isNotNull() & reached)
        cube = cube.withColumn("open", F.col("open") & (F.col(f"act_{d}") | ~F.max(f"act_{d}").over(view)))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"act_{d}").alias("active")) for d in DIMENSIONS)))
    return written(cube.select("view_id", each.alias("x")).where("x.active").select("view_id", "x.dimension", "x.value").distinct(), "active")


def available_values(by_view: DataFrame, active: DataFrame) -> DataFrame:
    send = _sent(active)
    parts = [_available(by_view, active, d, send).select("view_id", F.lit(d).alias("dimension"), "value") for d in DIMENSIONS]
    return reduce(DataFrame.unionByName, parts)


def apply_filters(rows: DataFrame, by_view: DataFrame, active: DataFrame, views: DataFrame, ranges: DataFrame, measures: list[str]) -> DataFrame:
    """view_id and rows of the full result under active values and ranges: rows meet the combinations that pass, then their view's ranges."""
    passing = _flags(by_view.where("ranged_rows > 0"), active).where(_all(DIMENSIONS)).select("view_id", *(F.col(d).alias(f"_{d}") for d in DIMENSIONS))
    same = reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMENSIONS))
    met = rows.join(small(passing), same).drop(*(f"_{d}" for d in DIMENSIONS))
    met = met.join(small(_range_sets(ranges, measures)), "view_id", "left").withColumn("range_set", F.coalesce("range_set", F.array().cast(_NO_RANGES)))
    return met.where(_holds(measures)).select("view_id", *rows.columns)


def orphaned(selections: DataFrame, active: DataFrame) -> DataFrame:
    return selections.select("view_id", "dimension", "value").distinct().join(active, ["view_id", "dimension", "value"], "left_anti")


def facet_counts(by_view: DataFrame, active: DataFrame) -> DataFrame:
    """view_id, dimension, value, n: rows under every other dimension's active values and the ranges."""
    rows = _flags(by_view.where("ranged_rows > 0"), active)
    others = lambda d: _all(e for e in DIMENSIONS if e != d)
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.when(others(d), F.col("ranged_rows")).otherwise(F.lit(0)).alias("n")) for d in DIMENSIONS)))
    return rows.select("view_id", each.alias("x")).where("x.value is not null").groupBy("view_id", F.col("x.dimension").alias("dimension"), F.col("x.value").alias("value")).agg(F.sum("x.n").alias("n"))


def facet_view(by_view: DataFrame, selections: DataFrame, active: DataFrame) -> DataFrame:
    """Options with count, selected flag and state (available or orphaned), and their dimension's active_count and available_count; counts of zero are kept."""
    key = ["view_id", "dimension", "value"]
    chosen = selections.select(*key).distinct().withColumn("selected", F.lit(True))
    options = available_values(by_view, active).withColumn("available", F.lit(True)).unionByName(orphaned(selections, active).withColumn("available", F.lit(False)))
    options = written(options, "options")
    totals = options.groupBy("view_id", "dimension").agg(F.count_if("available").alias("available_count")).join(active.groupBy("view_id", "dimension").agg(F.count("*").alias("active_count")), ["view_id", "dimension"], "left")
    out = options.join(facet_counts(by_view, active), key, "left").join(chosen, key, "left").join(small(totals), ["view_id", "dimension"], "left")
    n = F.when(F.col("available"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n")
    return out.select(*key, "available", n, F.coalesce("selected", F.lit(False)).alias("selected"), F.coalesce("active_count", F.lit(0)).alias("active_count"), "available_count")


def option_order(view: DataFrame) -> DataFrame:
    """Options in the order of a reader's language."""
    return view.orderBy("view_id", "dimension", F.collate("value", "UNICODE"), "value")


def restore_plan(by_view: DataFrame, selections: DataFrame, active: DataFrame) -> DataFrame:
    """For each orphan and each dimension above that blocks it, the values to add, from all data; without any, the reason.

    view_id, dimension, value, blocked_by, add (sorted array), reason (range: no row lies in the view's ranges; else no-records).
    """
    key = ["view_id", "dimension", "value"]
    orphans = written(orphaned(selections, active), "orphans")
    rank = {d: i for i, d in enumerate(DIMENSIONS)}
    above = lambda d: F.array(*(F.struct(F.lit(u).alias("blocked_by"), F.col(u).alias("add")) for u in DIMENSIONS[: rank[d]]))
    none = F.array().cast("array<struct<blocked_by:string,add:string>>")
    long = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), (above(d) if rank[d] else none).alias("above")) for d in DIMENSIONS)))
    own = by_view.select("view_id", "ranged_rows", long.alias("x")).select("view_id", "ranged_rows", "x.*").join(small(orphans), key)
    own = written(own, "supporting")
    seen = own.groupBy(*key).agg(F.sum("ranged_rows").alias("ranged"))
    values = own.select(*key, F.explode("above").alias("u")).select(*key, "u.*").where("add is not null").distinct()
    hits = active.select("view_id", F.col("dimension").alias("blocked_by"), F.col("value").alias("add"), F.lit(True).alias("hit"))
    limited = active.select("view_id", F.col("dimension").alias("blocked_by")).distinct()
    send = _sent(active)
    judged = values.join(send(limited), ["view_id", "blocked_by"], "left_semi").join(send(hits), ["view_id", "blocked_by", "add"], "left")
    blocks = judged.groupBy(*key, "blocked_by").agg(F.count("hit").alias("hits"), F.array_sort(F.collect_list("add")).alias("add")).where("hits = 0").drop("hits")
    out = orphans.join(seen, key, "left").join(blocks, key, "left")
    reason = F.when(F.col("blocked_by").isNotNull(), F.lit(None).cast("string")).when(F.col("ranged") == 0, "range").otherwise("no-records")
    return out.select(*key, "blocked_by", "add", reason.alias("reason"))


def widen(selections: DataFrame, plan: DataFrame) -> DataFrame:
    """Selections with a plan's values added."""
    more = plan.where("blocked_by is not null").select("view_id", F.col("blocked_by").alias("dimension"), F.explode("add").alias("value"))
    return selections.select("view_id", "dimension", "value").union(more).distinct()


def measure_bounds(rows: DataFrame, measures: list[str]) -> DataFrame:
    """measure, lo, hi over the unfiltered rows' finite values; measures without one are left out."""
    finite = lambda m: F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m).cast("double"))
    row = rows.agg(*(f(finite(m)).alias(f"{n}_{i}") for i, m in enumerate(measures) for n, f in (("lo", F.min), ("hi", F.max))))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"lo_{i}").alias("lo"), F.col(f"hi_{i}").alias("hi")) for i, m in enumerate(measures))))
    return row.select(each.alias("x")).select("x.*").where("lo is not null")


def active_filter_count(selections: DataFrame, ranges: DataFrame, bounds: DataFrame) -> DataFrame:
    """view_id, n: selected values, and ranges that are tighter than the data."""
    r = ranges.join(bounds.withColumnsRenamed({"lo": "b_lo", "hi": "b_hi"}), "measure", "left").groupBy("view_id").agg(F.count_if((F.col("lo") > F.col("b_lo")) | (F.col("hi") < F.col("b_hi"))).alias("n"))
    return selections.groupBy("view_id").agg(F.count("*").alias("n")).union(r).groupBy("view_id").agg(F.sum("n").alias("n"))
