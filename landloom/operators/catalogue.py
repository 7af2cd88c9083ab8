"""Discovering sheets, headers, keys, roles and bindings from long cells (book, sheet, row_idx, col_idx, value).

All of it is keyed by book and sheet, so one job handles any number of books. Cells may also come as rows (book, sheet,
row_idx, cells: an array of col_idx and value); long ones are gathered into rows first. What is asked of a row is then
answered within it, and only figures by sheet or column are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions.text import clean_cell, clean_string, has_text, header_key, positional_key, suffix_key
from landloom.functions.values import cell_type, distinct_key, parse_measure
from landloom.sources.tables import written

# Thresholds of discovery, words that tell roles, patterns that bind columns.
HEADER_DENSITY, HEADER_TYPES, HEADER_ROWS = 0.7, 2, 25
NUMERIC_RATIO, HIGH_CARDINALITY = 0.8, 0.4
MEASURE_WORDS = ("acre", "acer", "area", "rate", "value", "percentage", "percent", "amount", "cost", "price")
META_WORDS = ("date", "y/n", "yes/no", "doc", "file", "kmz", "remark", "comment", "status", "name", "number", "id")
ROLE_PATTERNS = (
    ("total", r"\btotal\b.*\b(land|area)\b|\b(land|area)\b.*\btotal\b"),
    ("unused", r"\bun[\s-]?used\b"),
    ("used", r"(?<!un)(?<!un[\s-])\bused\b"),
    ("private-sale", r"\bprivate\b.*\bsale\b|\bsale\b.*\bprivate\b"),
    ("private-lease", r"\bprivate\b.*\bleas"),
    ("govt-revenue", r"\bgovt\b|\bgovernment\b|\brevenue\b"),
    ("forest", r"\bforest\b"),
)
PLACE_PATTERNS = (("state", (r"^state$", r"^state[\s/_-]", r"\bstate\b")), ("district", (r"^district$", r"\bdistrict\b", r"\bdist\b")))
COORDINATE_PATTERNS = (
    ("paired", r"\b(lat[\s_/-]?long(itude)?|latlng|coordinates?|geo[\s_/-]?point|wkt|geometry)\b"),
    ("latitude", r"\blat(itude)?\b"),
    ("longitude", r"\blong(itude)?\b|\blng\b|\blon\b"),
    ("projected", r"\b(easting|northing|utm|epsg|mgrs)\b"),
)
SHEET = ["book", "sheet"]


def cells_of(wide: DataFrame, book: str, sheet: str, row_idx: str) -> DataFrame:
    """Long cells of a wide table of strings, in column order."""
    cols = [c for c in wide.columns if c != row_idx]
    long = wide.select(F.col(row_idx).alias("row_idx"), F.posexplode(F.array(*(F.col(c).cast("string") for c in cols))).alias("col_idx", "value"))
    return long.select(F.lit(book).alias("book"), F.lit(sheet).alias("sheet"), "row_idx", "col_idx", "value")


def clean_all(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean_cell(c) for c in columns})


def drop_blank_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.coalesce(*(F.col(c) for c in columns)).isNotNull())


def rows_of(cells: DataFrame, keys: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """Cells as rows, which they may already be."""
    if "cells" in cells.columns:
        return cells
    return cells.groupBy(*SHEET, *keys).agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("cells"))


def score_sheets(cells: DataFrame, ordinals: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Populated cells, rows and width per sheet, and the chosen sheet of each book.

    ordinals: book, sheet, ordinal. overrides: book, sheet. The densest wins, the earlier on a tie; an
    override wins if the sheet exists.
    """
    full = rows_of(cells).select(*SHEET, F.filter("cells", lambda c: has_text(c["value"]))["col_idx"].alias("full"))
    n = F.size("full")
    scored = full.groupBy(*SHEET).agg(F.sum(n.cast("long")).alias("populated"), F.count_if(n > 0).alias("rows"), F.coalesce(F.max(F.array_max("full") + 1), F.lit(0)).alias("width"))
    scored = scored.join(ordinals, SHEET)
    own = overrides.select(*SHEET, F.lit(True).alias("own")) if overrides is not None else None
    scored = scored.join(own, SHEET, "left") if own is not None else scored.withColumn("own", F.lit(None).cast("boolean"))
    best = W.partitionBy("book").orderBy(F.col("own").isNull(), F.desc("populated"), "ordinal")
    return scored.withColumn("chosen", (F.row_number().over(best) == 1) & ((F.col("populated") > 0) | F.col("own").isNotNull())).drop("own")


def detect_header(cells: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """book, sheet, header_row, used_fallback: the first dense text row whose next row shows several types."""
    kinds = F.transform(F.filter("cells", lambda c: has_text(c["value"])), lambda c: cell_type(clean_string(c["value"]), cleaned=True))
    told = F.struct("row_idx", F.size(F.filter("kinds", lambda t: t == "string")).alias("strings"), F.size(F.array_distinct("kinds")).alias("types"))
    rows = rows_of(cells).select(*SHEET, "row_idx", F.array_max("cells.col_idx").alias("last"), F.exists("cells", lambda c: has_text(c["value"])).alias("full"), F.when(F.col("row_idx") <= HEADER_ROWS, kinds).alias("kinds"))
    tops = F.collect_list(F.when(F.col("row_idx") <= HEADER_ROWS, told))  # 26 rows at most
    sheets = rows.groupBy(*SHEET).agg((F.max("last") + 1).alias("width"), F.min(F.when(F.col("full"), F.col("row_idx"))).alias("first_row"), F.array_sort(tops).alias("tops"))

    def good(row: Column, i: Column) -> Column:
        after = F.get("tops", i + 1)
        return (row["row_idx"] < HEADER_ROWS) & (row["strings"] / F.col("width") > HEADER_DENSITY) & (after["row_idx"] == row["row_idx"] + 1) & (after["types"] >= HEADER_TYPES)

    found = F.get(F.filter("tops", good), F.lit(0))["row_idx"]
    out = sheets.select(*SHEET, "first_row", found.alias("found")).select(*SHEET, F.coalesce("found", "first_row").alias("header_row"), F.col("found").isNull().alias("used_fallback"))
    if overrides is not None:
        own = overrides.select(*SHEET, F.col("header_row").alias("own"))
        out = out.join(own, SHEET, "left").select(*SHEET, F.coalesce("own", "header_row").alias("header_row"), (F.col("used_fallback") & F.col("own").isNull()).alias("used_fallback"))
    return out


def body_of(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header: book, sheet, source_row_number, record_id, cells (cleaned, populated ones alone); blank rows are gone."""
    below = rows_of(cells).join(headers.select(*SHEET, "header_row"), SHEET).where("row_idx > header_row")
    clean = F.filter(F.transform("cells", lambda c: F.struct(c["col_idx"].alias("col_idx"), clean_cell(c["value"]).alias("value"))), lambda c: c["value"].isNotNull())
    return below.select(*SHEET, F.col("row_idx").alias("source_row_number"), F.concat(F.lit("row-"), F.col("row_idx")).alias("record_id"), clean.alias("cells")).where(F.size("cells") > 0)


def assign_keys(cells: DataFrame, headers: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """book, sheet, col_idx, name, key, occurrence, has_data of every column that has a header or data. body: ``body_of`` the same cells."""
    rows, col = rows_of(cells), [*SHEET, "col_idx"]
    heads = rows.join(headers.select(*SHEET, "header_row"), SHEET).where("row_idx = header_row").select(*SHEET, F.inline("cells"))
    data = (body_of(rows, headers) if body is None else body).select(*SHEET, F.explode("cells.col_idx").alias("col_idx")).distinct().withColumn("has_data", F.lit(True))
    cols = heads.groupBy(*col).agg(F.max("value").alias("name")).join(data, col, "full").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
    cols = cols.withColumn("base", F.coalesce(header_key("name"), positional_key("col_idx"))).where(header_key("name").isNotNull() | F.col("has_data"))
    nth = F.row_number().over(W.partitionBy(*SHEET, "base").orderBy("col_idx"))
    cols = cols.withColumn("occurrence", nth)
    return cols.withColumn("key", F.when(F.col("occurrence") > 1, suffix_key("base", "occurrence")).otherwise(F.col("base"))).drop("base")


def records_of(body: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``body_of`` as long records: book, sheet, source_row_number, record_id, col_idx, key, value."""
    long = body.select(*SHEET, "source_row_number", "record_id", F.inline("cells"))
    return long.join(keys.select(*SHEET, "col_idx", "key"), [*SHEET, "col_idx"]).select(*SHEET, "source_row_number", "record_id", "col_idx", "key", "value")


def split_unlocated(body: DataFrame, location: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``body_of`` that have the location column (location: book, sheet, col_idx) and those that don't; a sheet without one drops nothing."""
    keyed = body.join(location.select(*SHEET, F.col("col_idx").alias("_at")), SHEET, "left")
    placed = F.col("_at").isNull() | F.array_contains("cells.col_idx", F.col("_at"))
    return keyed.where(placed).drop("_at"), keyed.where(~placed).drop("_at")


def dropped_records(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """book, sheet, record_id, source_row_number, raw (value by key), reason of rows without a location."""
    raw = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return records_of(rows, keys).groupBy(*SHEET, "record_id", "source_row_number").agg(raw.alias("raw")).withColumn("reason", F.lit("no location"))


def profile_columns(long: DataFrame, rows: DataFrame, keys: list[str], columns: DataFrame | None = None) -> DataFrame:
    """One row per column of long values (keys..., col_idx, row_idx, value). rows: keys..., n_rows. columns: keys..., col_idx, if known; values are then clean.

    Populated, null and distinct counts, numeric ratio, types, whether it is a serial index, and the first
    five distinct values in row order. Values are grouped first, so nothing unbounded is collected.
    """
    col = [*keys, "col_idx"]
    # types are read once a distinct text and not once a cell
    texts = long.groupBy(*col, (clean_cell("value") if columns is None else F.col("value")).alias("value")).agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row")).where("value is not null")
    typed = texts.withColumn("type", cell_type("value", cleaned=True)).withColumn("num", parse_measure("value", cleaned=True)).withColumn("dkey", distinct_key("value", cleaned=True, kind="type"))
    values = typed.groupBy(*col, "dkey").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"), F.min("value").alias("value"), F.min("type").alias("type"), F.min("num").alias("num"))
    values = written(values, "values")  # read twice below
    whole = (F.col("type") == "number") & (F.col("num") == F.floor("num")) & (F.col("num") >= 0)
    stats = values.groupBy(*col).agg(
        F.sum("n").alias("populated"), F.count("*").alias("distinct_count"), F.sum(F.when(F.col("num").isNotNull(), F.col("n")).otherwise(0)).alias("numeric"),
        F.array_sort(F.collect_set("type")).alias("types"), F.bool_and(whole).alias("all_whole"), F.min("num").alias("lo"), F.max("num").alias("hi"),
    )
    first = values.withColumn("_r", F.row_number().over(W.partitionBy(*col).orderBy("first_row", "dkey"))).where("_r <= 5")
    samples = first.groupBy(*col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]).alias("samples"))
    columns = long.select(*col).distinct() if columns is None else columns
    every = columns.join(rows, keys) if keys else columns.crossJoin(F.broadcast(rows))
    out = every.join(stats, col, "left").join(samples, col, "left")
    n = F.coalesce("populated", F.lit(0))
    serial = (n > 0) & (n == F.col("n_rows")) & (F.col("distinct_count") == n) & F.col("all_whole") & (F.col("hi") - F.col("lo") == n - 1)
    return out.select(*col, "n_rows", n.alias("populated"), (F.col("n_rows") - n).alias("null_count"), F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), F.when(n > 0, F.col("numeric") / n).otherwise(0.0).alias("numeric_ratio"), F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce(serial, F.lit(False)).alias("is_serial"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def role_from_header(key: Column) -> Column:
    has = lambda words: F.regexp_like(key, F.lit("|".join(words)))
    return F.when(has(META_WORDS), "meta").when(has(MEASURE_WORDS), "measure").otherwise("meta")


def infer_role(profile: DataFrame) -> DataFrame:
    """Adds role, from_name_only, is_empty and high_cardinality to a profile with ``key``."""
    n, types = F.col("populated"), F.col("types")
    is_string = F.array_contains(types, "string")
    role = (
        F.when(n == 0, role_from_header(F.col("key"))).when(F.col("is_serial"), "meta").when(F.col("numeric_ratio") > NUMERIC_RATIO, "measure").when(F.array_contains(types, "date"), "meta")
        .when(F.array_contains(types, "boolean") & ~is_string, "meta").when(is_string & (F.col("distinct_count") <= 2), "meta").when(is_string, "dimension").otherwise("meta")
    )
    high = F.coalesce(F.col("distinct_count") / F.nullif(n, F.lit(0)) >= HIGH_CARDINALITY, F.lit(False))
    return profile.withColumn("role", role).withColumn("from_name_only", n == 0).withColumn("is_empty", n == 0).withColumn("high_cardinality", (F.col("role") == "dimension") & high)


def describe_columns(keys: DataFrame, roles: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The column catalogue: keys joined with roles; labels fall back to the position; overrides (book, sheet, key, role_override) win."""
    cat = keys.join(roles.drop("key", "n_rows"), [*SHEET, "col_idx"], "left").withColumn("label", F.coalesce(clean_string("name"), F.concat(F.lit("Column "), F.col("col_idx") + 1)))
    cat = cat.join(overrides, [*SHEET, "key"], "left") if overrides is not None else cat.withColumn("role_override", F.lit(None).cast("string"))
    return cat.withColumn("effective_role", effective_role())


def effective_role() -> Column:
    return F.coalesce("role_override", "role")


def visible_columns(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(~F.col("is_empty"))


def _free(pattern: str):
    """A test of a key: it fits the pattern and no earlier role has claimed it."""
    return lambda k: F.regexp_like(k, F.lit(pattern)) & ~F.array_contains("claimed", k)


def bind_columns(catalogue: DataFrame) -> DataFrame:
    """book, sheet, role, key: measure roles in order, each column claimed once, then state and district.

    The claims of one sheet are made by a fold over the fixed list of roles, in one projection.
    """
    measures = catalogue.where("effective_role = 'measure'").groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "key"))), lambda x: x["key"]).alias("keys"))
    bound = measures.withColumn("claimed", F.array().cast("array<string>"))
    for role, pattern in ROLE_PATTERNS:
        bound = bound.withColumn(role, F.get(F.filter("keys", _free(pattern)), F.lit(0)))
        bound = bound.withColumn("claimed", F.when(F.col(f"`{role}`").isNotNull(), F.array_append("claimed", F.col(f"`{role}`"))).otherwise(F.col("claimed")))
    roles = bound.select(*SHEET, F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"`{r}`").alias("key")) for r, _ in ROLE_PATTERNS))).alias("x")).select(*SHEET, "x.role", "x.key").where("key is not null")
    others = catalogue.where("effective_role <> 'measure'")
    for role, patterns in PLACE_PATTERNS:
        rank = F.coalesce(*(F.when(F.regexp_like("key", F.lit(p)), i) for i, p in enumerate(patterns)))
        first = others.withColumn("_p", rank).where("_p is not null").withColumn("_r", F.row_number().over(W.partitionBy(*SHEET).orderBy("_p", "col_idx"))).where("_r = 1")
        roles = roles.unionByName(first.select(*SHEET, F.lit(role).alias("role"), "key"))
    return roles


def pick_word(catalogue: DataFrame, word: str) -> DataFrame:
    """The first column of each sheet whose key has a word (site, business)."""
    hits = catalogue.where(F.regexp_like("key", F.lit(f"\\b{word}\\b")))
    return hits.groupBy(*SHEET).agg(F.min_by("key", "col_idx").alias("key"))


def coordinate_columns(catalogue: DataFrame) -> DataFrame:
    kind = F.coalesce(*(F.when(F.regexp_like("key", F.lit(p)), k) for k, p in COORDINATE_PATTERNS))
    return catalogue.withColumn("kind", kind).where("kind is not null").select(*SHEET, "key", "label", "kind", F.coalesce("populated", F.lit(0)).alias("populated"))


def debris_columns(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """book, sheet, col_idx of the columns that have neither a header nor data and were left out."""
    every = rows_of(cells).select(*SHEET, F.explode("cells.col_idx").alias("col_idx")).distinct()
    return every.join(keys.select(*SHEET).distinct(), SHEET, "left_semi").join(keys.select(*SHEET, "col_idx"), [*SHEET, "col_idx"], "left_anti")


def ingest_stats(records: DataFrame, dropped: DataFrame, catalogue: DataFrame, violated: DataFrame | None = None) -> DataFrame:
    """Rows, kept, dropped, with violations (violated: book, sheet, record_id, ...), and columns by role, of each sheet."""
    kept = records.groupBy(*SHEET).agg(F.count_distinct("record_id").alias("kept"))
    lost = dropped.groupBy(*SHEET).agg(F.count("*").alias("dropped"))
    cols = catalogue.groupBy(*SHEET).agg(F.count("*").alias("columns"), *(F.count_if(F.col("effective_role") == r).alias(f"{r}s") for r in ("dimension", "measure", "meta")), F.count_if("is_empty").alias("empty_columns"), F.count_if("from_name_only").alias("from_name_only"))
    out = cols.join(kept, SHEET, "left").join(lost, SHEET, "left")
    if violated is not None:
        out = out.join(violated.groupBy(*SHEET).agg(F.count_distinct("record_id").alias("rows_with_violations")), SHEET, "left")
    else:
        out = out.withColumn("rows_with_violations", F.lit(0).cast("long"))
    return out.fillna(0, ["kept", "dropped", "rows_with_violations"]).withColumn("rows", F.col("kept") + F.col("dropped"))


def ingest_warnings(sheets: DataFrame, headers: DataFrame, catalogue: DataFrame, bindings: DataFrame, dropped: DataFrame, debris: DataFrame | None = None, violated: DataFrame | None = None, unbound: DataFrame | None = None) -> DataFrame:
    """book, sheet, code, n, columns: one row a warning that applies.

    Column warnings come from one pass over the catalogue. debris: book, sheet, col_idx. violated: book, sheet, record_id,
    invariant. unbound: book, sheet, invariant.
    """
    keys = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("key"))))
    none = F.array().cast("array<string>")
    unnamed = F.coalesce(F.trim("name"), F.lit("")) == ""
    by_column = {"duplicate-headers": F.col("occurrence") > 1, "unnamed-columns": unnamed, "empty-columns": F.col("is_empty"), "roles-from-names": F.col("from_name_only")}
    places = bindings.where("role in ('state', 'district')").groupBy(*SHEET).agg(F.collect_set("role").alias("placed"))
    cols = catalogue.groupBy(*SHEET).agg(*(keys(test).alias(code) for code, test in by_column.items()), F.count_if(F.col("effective_role") == "measure").alias("measures")).join(places, SHEET, "left")
    lacks = lambda test: F.when(test, F.lit(1).cast("long"))
    placed = F.coalesce("placed", none)
    parts = [(code, F.nullif(F.size(F.col(f"`{code}`")).cast("long"), F.lit(0)), F.col(f"`{code}`")) for code in by_column]
    parts += [(f"no-{r}-column", lacks(~F.array_contains(placed, r)), none) for r in ("state", "district")] + [("no-measure", lacks(F.col("measures") == 0), none)]
    out = cols.select(*SHEET, F.explode(F.array(*(F.struct(F.lit(code).alias("code"), n.alias("n"), c.alias("columns")) for code, n, c in parts))).alias("x")).select(*SHEET, "x.*").where("n is not null")

    def counted(df: DataFrame, code: str, n: Column) -> DataFrame:
        return df.groupBy(*SHEET).agg(n.cast("long").alias("n")).where("n > 0").select(*SHEET, F.lit(code).alias("code"), "n", none.alias("columns"))

    several = sheets.where("populated > 0").groupBy("book").agg((F.count("*") - 1).alias("n")).where("n > 0")
    several = sheets.where("chosen").join(several, "book").select(*SHEET, F.lit("several-sheets").alias("code"), "n", none.alias("columns"))
    more = [several, counted(headers.where("used_fallback"), "header-fallback", F.count("*")), counted(dropped, "rows-dropped", F.count("*"))]
    if debris is not None:
        more.append(counted(debris, "discarded-empty-columns", F.count("*")))
    if violated is not None:
        more.append(counted(violated, "invariant-violations", F.count_distinct("record_id")))
    if unbound is not None:
        own = unbound.groupBy(*SHEET).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("invariant")).alias("columns"))
        more.append(own.select(*SHEET, F.lit("unbound-invariant").alias("code"), "n", "columns"))
    return reduce(DataFrame.unionByName, more, out)


def cautions(warnings: DataFrame) -> DataFrame:
    """The warnings that a preview shows before a load is accepted."""
    return warnings.where(F.col("code").isin("header-fallback", "several-sheets", "no-state-column", "no-measure"))
