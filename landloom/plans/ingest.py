"""From cells to records and their catalogue, for any number of books in one job.

The profile is taken twice: a first one finds the location column, rows without a location are dropped, and
the final one describes what is left; only sheets that lost rows are profiled again. Each step's result is written, so
later steps don't repeat it. Cells stay in their rows until values are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions.values import parse_measure
from landloom.operators import catalogue as c
from landloom.operators import quality
from landloom.sources.tables import written


@dataclass
class Ingested:
    sheets: DataFrame
    headers: DataFrame
    keys: DataFrame
    rows: DataFrame
    dropped: DataFrame
    catalogue: DataFrame
    bindings: DataFrame
    debris: DataFrame

    @property
    def records(self) -> DataFrame:
        """The kept rows as long records."""
        return c.records_of(self.rows, self.keys)

    def roles(self) -> DataFrame:
        return role_records(self.rows, self.catalogue, self.bindings)

    def checks(self) -> DataFrame:
        return quality.sheet_checks(self.roles())

    def stats(self) -> DataFrame:
        return c.ingest_stats(self.rows, self.dropped, self.catalogue, self.checks().where("status = 'violated'"))

    def warnings(self) -> DataFrame:
        unbound = quality.sheet_unbound(self.bindings, self.catalogue)
        return c.ingest_warnings(self.sheets, self.headers, self.catalogue, self.bindings, self.dropped, self.debris, self.checks().where("status = 'violated'"), unbound)


#: Roles of the one table that all books' records are turned into: texts, then figures.
TEXT_ROLES, NUMBER_ROLES = ("business", "state", "district", "site"), ("total", "private-sale", "private-lease", "govt-revenue", "forest", "used", "unused")


def role_records(rows: DataFrame, catalogue: DataFrame, bindings: DataFrame) -> DataFrame:
    """Rows of any number of books as one table: book, sheet, record_id, source_row_number, a column a fixed role, and the roles that are bound.

    Invariants, resolution and roll-ups read these columns, whatever the books call them. Rows may be long records.
    """
    words = [c.pick_word(catalogue, w).select(*c.SHEET, F.lit(w).alias("role"), "key") for w in ("business", "site")]
    bound = bindings.select(*c.SHEET, "role", "key").unionByName(words[0]).unionByName(words[1]).join(catalogue.select(*c.SHEET, "key", "col_idx"), [*c.SHEET, "key"])
    places = [F.max(F.when(F.col("role") == r, F.col("col_idx"))).alias(f"_{r}") for r in TEXT_ROLES + NUMBER_ROLES]
    held = bound.groupBy(*c.SHEET).agg(F.array_sort(F.collect_set("role")).alias("bound"), *places)  # a fixed list of roles at most
    rows = c.rows_of(rows, ("source_row_number", "record_id")).join(held, c.SHEET, "left")
    own = lambda r: F.array_max(F.filter("cells", lambda x: x["col_idx"] == F.col(f"`_{r}`")))["value"]
    wide = rows.select(*c.SHEET, "record_id", "source_row_number", "bound", *(own(r).alias(r) for r in TEXT_ROLES), *(own(r).alias(f"_{r}") for r in NUMBER_ROLES))
    numbers = [parse_measure(F.col(f"`_{r}`"), cleaned=True).alias(r) for r in NUMBER_ROLES]
    return wide.select(*c.SHEET, "record_id", "source_row_number", *TEXT_ROLES, *numbers, F.coalesce("bound", F.array().cast("array<string>")).alias("bound"))


def two_pass_profile(records: DataFrame, keys: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Kept rows and dropped records, the catalogue of the kept ones and its bindings. records: rows of ``body_of``, or long records."""
    body = c.rows_of(records, ("source_row_number", "record_id"))

    def described(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        long = rows.select(*c.SHEET, F.col("source_row_number").alias("row_idx"), F.inline("cells"))
        n = keys.select(*c.SHEET).distinct().join(rows.groupBy(*c.SHEET).agg(F.count("*").alias("n_rows")), c.SHEET, "left").fillna(0, ["n_rows"])
        profile = c.profile_columns(long, n, c.SHEET, keys.select(*c.SHEET, "col_idx")).join(keys.select(*c.SHEET, "col_idx", "key"), [*c.SHEET, "col_idx"])
        return written(c.describe_columns(keys, c.infer_role(profile), overrides), name)

    first = described(body, keys, "provisional")
    bindings = written(c.bind_columns(first), "provisional_bindings")
    location = bindings.where("role = 'state'").join(keys, [*c.SHEET, "key"]).select(*c.SHEET, "col_idx")
    kept, lost = c.split_unlocated(body, location)
    lost = written(lost, "lost")
    if lost.isEmpty():
        return body, c.dropped_records(lost, keys), first, bindings
    kept, dropped = written(kept, "kept"), written(c.dropped_records(lost, keys), "dropped")
    changed = lost.select(*c.SHEET).distinct()
    again = described(kept.join(changed, c.SHEET, "left_semi"), keys.join(changed, c.SHEET, "left_semi"), "again")
    final = first.join(changed, c.SHEET, "left_anti").unionByName(again)
    return kept, dropped, final, written(c.bind_columns(final), "bindings")


def ingest(cells: DataFrame, ordinals: DataFrame, sheet_overrides: DataFrame | None = None, header_overrides: DataFrame | None = None, role_overrides: DataFrame | None = None) -> Ingested:
    """The chosen sheet of every book, read into records. cells: long, or rows as the catalogue takes them. ordinals: book, sheet, ordinal."""
    rows = cells if "cells" in cells.columns else written(c.rows_of(cells), "rows")
    sheets = written(c.score_sheets(rows, ordinals, sheet_overrides), "sheets")
    chosen = sheets.where("chosen").select(*c.SHEET)
    headers = written(c.detect_header(rows, header_overrides).join(chosen, c.SHEET, "left_semi"), "headers")
    body = written(c.body_of(rows, headers), "body")
    keys = written(c.assign_keys(rows, headers, body), "keys")
    kept, dropped, catalogue, bindings = two_pass_profile(body, keys, role_overrides)
    return Ingested(sheets, headers, keys, kept, dropped, catalogue, bindings, c.debris_columns(rows, keys))
