"""Arithmetic invariants with three outcomes: satisfied, violated, or indeterminate where an input is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.values import area_equals


#: Roles whose sum is the total.
COMPONENTS = ("private-sale", "private-lease", "govt-revenue", "forest")


def check_sum(parts: list[Column], total: Column) -> Column:
    """struct(status, observed, expected, delta, reason) of a sum against its total."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    reason = F.when(F.lit(not parts), "no-components").when(~finite(total), "null-total")
    for p in parts:
        reason = reason.when(~finite(p), "null-component")
    observed = sum(parts[1:], parts[0]) if parts else F.lit(None).cast("double")
    ran = reason.isNull()
    status = F.when(~ran, "indeterminate").when(area_equals(observed, total), "satisfied").otherwise("violated")
    keep = lambda c: F.when(ran, c)
    return F.struct(status.alias("status"), keep(observed).alias("observed"), keep(total).alias("expected"), keep(observed - total).alias("delta"), reason.alias("reason"))


def check_composition(components: list[str], total: str) -> Column:
    return check_sum([F.col(c) for c in components], F.col(total))


def check_utilization(used: str | None, unused: str | None, total: str) -> Column:
    """With one of the two unbound every row is indeterminate."""
    return check_sum([F.col(c) if c else F.lit(None).cast("double") for c in (used, unused)], F.col(total))


def unbound_invariants(bound: set[str], components: tuple[str, ...] = COMPONENTS) -> list[str]:
    out = []
    if "total" not in bound or not bound & set(components):
        out.append("composition")
    if "total" not in bound or not bound & {"used", "unused"}:
        out.append("utilization")
    return out


def violations(records: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """record_id, invariant, observed, expected, delta of every violated check."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("invariant"), c.alias("r")) for n, c in checks.items())))
    return records.select("record_id", each.alias("x")).select("record_id", "x.invariant", "x.r.*").where("status = 'violated'").select("record_id", "invariant", "observed", "expected", "delta")


def validation_summary(records: DataFrame, checks: dict[str, Column], unbound: list[str] = ()) -> DataFrame:
    """Checked, skipped and violated rows of each invariant; unbound ones never ran."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("invariant"), c["status"].alias("status")) for n, c in checks.items())))
    out = records.select(each.alias("x")).groupBy("x.invariant").agg(F.count_if(F.col("x.status") != "indeterminate").alias("checked"), F.count_if(F.col("x.status") == "indeterminate").alias("skipped"), F.count_if(F.col("x.status") == "violated").alias("violated")).withColumn("ran", F.lit(True))
    if unbound:
        never = records.sparkSession.createDataFrame([(u, 0, 0, 0, False) for u in unbound], "invariant string, checked long, skipped long, violated long, ran boolean")
        out = out.unionByName(never)
    return out


def sheet_checks(records: DataFrame) -> DataFrame:
    """book, sheet, record_id, invariant, status, observed, expected, delta of records on the fixed roles.

    records: book, sheet, record_id, a column a role, and ``bound``, an array of the roles that the sheet has columns for. An invariant
    without the roles it needs gives no row; a bound role without a value makes its row indeterminate.
    """
    has = lambda r: F.array_contains("bound", r)
    parts = [F.when(has(r), F.struct(F.col(f"`{r}`").alias("v"))) for r in COMPONENTS]
    given = F.array_compact(F.array(*parts))
    total = F.col("total")
    null_part = F.exists(given, lambda p: p["v"].isNull())
    observed = F.when(~null_part, F.aggregate(given, F.lit(0.0), lambda a, p: a + p["v"]))
    ran = {"composition": (has("total") & (F.size(given) > 0), observed), "utilization": (has("total") & (has("used") | has("unused")), F.col("used") + F.col("unused"))}
    each = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(n).alias("invariant"), o.alias("observed"))) for n, (on, o) in ran.items())))
    rows = records.select("book", "sheet", "record_id", total.alias("expected"), F.explode(each).alias("x")).select("book", "sheet", "record_id", "x.invariant", "x.observed", "expected")
    unclear = F.col("observed").isNull() | F.col("expected").isNull()
    status = F.when(unclear, "indeterminate").when(area_equals("observed", "expected"), "satisfied").otherwise("violated")
    return rows.withColumn("status", status).withColumn("delta", F.when(~unclear, F.col("observed") - F.col("expected")))


def sheet_unbound(bindings: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, sheet, invariant of the invariants that a sheet (book, sheet) has no columns for."""
    bound = sheets.select("book", "sheet").distinct().join(bindings.groupBy("book", "sheet").agg(F.collect_set("role").alias("b")), ["book", "sheet"], "left")
    b = F.coalesce("b", F.array().cast("array<string>"))
    no_total = ~F.array_contains(b, "total")
    missing = {"composition": no_total | ~F.arrays_overlap(b, F.array(*map(F.lit, COMPONENTS))), "utilization": no_total | ~F.arrays_overlap(b, F.array(F.lit("used"), F.lit("unused")))}
    return bound.select("book", "sheet", F.explode(F.array_compact(F.array(*(F.when(m, F.lit(n)) for n, m in missing.items())))).alias("invariant"))
