"""Extracts under the original headers, with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_columns(records: DataFrame, catalogue: list[tuple[str, str | None, str]]) -> DataFrame:
    """Records under their header text (key, name, label per column); unnamed columns go by their label; dates as ISO days; equal headers get the key added."""
    seen: set[str] = set()
    out = []
    for key, name, label in catalogue:
        head = name if name and name.strip() else label
        if head in seen:
            head = f"{head} ({key})"
        seen.add(head)
        kind = dict(records.dtypes)[key]
        c = F.date_format(key, "yyyy-MM-dd") if kind in ("timestamp", "date", "timestamp_ntz") else F.col(f"`{key}`")
        out.append(c.alias(head))
    return records.select(*out)


def write_extract(records: DataFrame, catalogue: list[tuple[str, str | None, str]], path: str) -> None:
    extract_columns(records, catalogue).write.mode("overwrite").csv(path, header=True)


def provenance(resolved: DataFrame, filtered: DataFrame, level: str, source: str, measure: str, formula: str, aggregation: str, filters: dict[str, list[str]], ranges: dict[str, tuple[float, float]], dropped: int, vintage: str, violated: int) -> DataFrame:
    """ordinal, section, label, value: what an extract was made from. Fuzzy names count stage 3; stage 4 is told apart."""
    before = resolved.agg(F.count("*").alias("rows_before"))
    after = filtered.agg(
        F.count("*").alias("rows_after"), F.count_if(F.col(f"{level}_match").isNull()).alias("unmapped_rows"), F.coalesce(F.sum(F.when(F.col(f"{level}_match").isNull(), F.coalesce("area", F.lit(0.0)))), F.lit(0.0)).alias("unmapped_area"),
        F.count_distinct(F.when(F.col("stage") == 3, F.struct("state", "district"))).alias("fuzzy_names"), F.count_distinct(F.when(F.col("stage") == 4, F.struct("state", "district"))).alias("unresolved_names"),
    )
    text = lambda v: F.lit(str(v))
    lines = [("source", "Source", text(source)), *(("filter", d, text(", ".join(sorted(v)) if v else "(all)")) for d, v in filters.items()), *(("range", m, text(f"{lo} to {hi}")) for m, (lo, hi) in ranges.items())]
    lines += [("measure", "Measure", text(measure)), ("measure", "Formula", text(formula)), ("measure", "Aggregation", text(aggregation))]
    lines += [("rows", n, F.col(c).cast("string")) for n, c in (("Rows before filters", "rows_before"), ("Rows in extract", "rows_after"), ("Unmapped rows", "unmapped_rows"))]
    lines += [("rows", "Unmapped area", F.round("unmapped_area", 2).cast("string")), ("rows", "Dropped rows", text(dropped)), ("quality", "Violations", text(violated))]
    lines += [("quality", n, F.col(c).cast("string")) for n, c in (("Fuzzy names", "fuzzy_names"), ("Unresolved names", "unresolved_names"))] + [("boundaries", "Vintage", text(vintage))]
    each = F.posexplode(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(la).alias("label"), v.alias("value")) for s, la, v in lines)))
    return before.crossJoin(after).select(each.alias("ordinal", "x")).select("ordinal", "x.*")
