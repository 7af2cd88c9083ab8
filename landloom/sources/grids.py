"""Landed text grids: files triaged before they are read, then cells as they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions.text import clean_string
from landloom.sources.tables import listing

MOST_BYTES = 60 * 1024 * 1024
#: Bytes of a file up to which it is read as one row.
WHOLE_BYTES = 64 * 1024


# Text of a record: a quoted cell (a quote inside is doubled) with whatever stands behind it, or a cell that begins with another character.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
_CELL = f'(?:{_QUOTED}[^,]*+|[^",][^,]*+|)'


def _opens(line: Column) -> Column:
    """Whether a line that begins outside of quotes ends inside."""
    return F.regexp_replace(line, f"\\G{_CELL}(?:,|$)", "") != ""


def _stays_open(line: Column) -> Column:
    """Whether a line that begins inside of quotes ends inside."""
    closing = '^[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,|$)'
    return F.when(F.regexp_like(line, F.lit(closing)), _opens(F.regexp_replace(line, closing, ""))).otherwise(True)


def _through(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """``df`` with ``before`` and ``after``: whether quotes are open before and after each row, for a partition that begins outside (a) and inside (b).

    Columns a and b say so of each row alone. A row keeps the state, turns it, or sets it, whatever it was; so the state is what the last row that
    set it left, turned as often as rows have turned it since: two running sums, and no row needs to know another's state.
    """
    own, sets = W.partitionBy(*part).orderBy(order), F.col("a") == F.col("b")
    turned = df.withColumn("turns", F.sum((F.col("a") & ~F.col("b")).cast("int")).over(own))
    turned = turned.withColumn("anchor", F.last(F.when(sets, F.struct("a", "turns")), ignorenulls=True).over(own))
    odd = (F.col("turns") - F.coalesce("anchor.turns", F.lit(0))) % 2 == 1
    state = lambda start: F.coalesce("anchor.a", F.lit(start)) != odd
    out = turned.withColumn("after", F.struct(state(False).alias("a"), state(True).alias("b"))).drop("turns", "anchor")
    return out.withColumn("before", F.coalesce(F.lag("after").over(own), F.struct(F.lit(False).alias("a"), F.lit(True).alias("b"))))


def _records(lines: DataFrame) -> DataFrame:
    """file, row_idx and value of every record of lines (file, block, id: ascending within a block, value). A record goes on where a cell is open.

    Two levels: lines within their block, which is one split of a file, then blocks within their file. Blocks are read by any tasks; a block's summary
    is its state for both beginnings and the number of records for each.
    """
    block = ["file", "block"]
    own = _through(lines.withColumns({"a": _opens(F.col("value")), "b": _stays_open(F.col("value"))}), block, "id")
    running = W.partitionBy(*block).orderBy("id")
    own = own.withColumns({f"n_{x}": F.sum((~F.col(f"before.{x}")).cast("long")).over(running) for x in "ab"})
    sums = own.groupBy(*block).agg(F.max_by("after", "id").alias("all"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    starts = _through(sums.select(*block, F.col("all.a").alias("a"), F.col("all.b").alias("b"), "n_a", "n_b"), ["file"], "block").withColumn("open", F.col("before.a"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(*block, "open", F.coalesce(F.sum(F.when(F.col("open"), F.col("n_b")).otherwise(F.col("n_a"))).over(earlier), F.lit(0)).alias("rows"))
    own = own.join(starts, block)
    pick = lambda name: F.when(F.col("open"), F.col(f"{name}.b")).otherwise(F.col(f"{name}.a"))
    own = own.select(*block, "id", "value", (F.col("rows") + F.when(F.col("open"), F.col("n_b")).otherwise(F.col("n_a")) - 1).alias("row_idx"), (~pick("before") & ~pick("after")).alias("whole"))
    parts = own.where(~F.col("whole")).groupBy("file", "row_idx").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("v"))
    return own.where("whole").select("file", "row_idx", "value").unionByName(parts.select("file", "row_idx", F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("value")))


def _whole_records(files: DataFrame) -> DataFrame:
    """file, row_idx and value of every record of files (file, value: the whole text), as ``_records`` finds them, within the file's row.

    Where no line that begins outside of quotes ends inside, every line is a record; only other files are followed line by line.
    """
    text = F.regexp_replace("value", "(?:\\r\\n|\\n|\\r)\\z", "")  # the last line's end begins no line
    lines = F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.split(text, "\\r\\n|\\n|\\r", -1))
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("done"), F.lit("").alias("last"))

    def follow(at: Column, line: Column) -> Column:
        value = F.when(at["open"], F.concat(at["last"], F.lit("\n"), line)).otherwise(line)
        now = F.when(at["open"], _stays_open(line)).otherwise(_opens(line))
        return F.struct(now.alias("open"), F.when(now, at["done"]).otherwise(F.array_append(at["done"], value)).alias("done"), F.when(now, value).otherwise("").alias("last"))

    ended = lambda at: F.when(at["open"], F.array_append(at["done"], at["last"])).otherwise(at["done"])
    found = files.select("file", lines.alias("lines"))
    records = F.when(F.exists("lines", _opens), F.aggregate("lines", start, follow, ended)).otherwise(F.col("lines"))
    return found.select("file", F.posexplode(records).alias("row_idx", "value")).select("file", F.col("row_idx").cast("long").alias("row_idx"), "value")


def scan_grids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cells (book, sheet, row_idx, col_idx, value) of CSV exports; ``scan_rows`` in long form."""
    return scan_rows(spark, paths).select("book", "sheet", "row_idx", F.inline("cells"))


def scan_rows(spark: SparkSession, paths: str | list[str], folders: bool = False) -> DataFrame:
    """Rows (book, sheet, row_idx, cells: an array of col_idx and value) of CSV exports: each record's own cells, so a book is read as if alone.

    Blank rows are kept (one empty cell), so rows are numbered as in the file. Cells may hold line breaks (read as \\n). Small files are
    read as a row each; others are split as Spark splits text, and quotes are followed across the splits; a quote inside an unquoted cell is an ordinary character. Empty cells are null. Book is
    the folder's name and sheet the file's. ``folders``: paths hold the books' folders at any depth, which are listed by tasks, where a glob of
    them is met by the driver.
    """
    with listing(spark):
        read = spark.read.option("recursiveFileLookup", folders)
        split, whole = read.text(paths), read.text(paths, wholetext=True)
    file, size = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size")  # files of another size aren't opened
    lines = split.where(size > WHOLE_BYTES).select("value", file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    small = whole.where(size <= WHOLE_BYTES).select(file, "value").repartition("file")
    records = _records(lines).unionByName(_whole_records(small))
    records = records.withColumn("value", F.when(F.col("row_idx") == 0, F.regexp_replace("value", "^﻿{1,2}", "")).otherwise(F.col("value")))
    # a comma behind the last cell, so that every cell ends with one; a cell that is never closed takes the rest
    found = F.regexp_extract_all(F.concat("value", F.lit(",")), F.lit(f'\\G(?:{_CELL},|"[^"]*+(?:""[^"]*+)*+\\z)'), F.lit(0))
    quoted = lambda c: F.replace(F.regexp_extract(c, '(?s)^"(.*?)"?$', 1), F.lit('""'), F.lit('"'))
    is_quoted = lambda c: F.startswith(c, F.lit('"')) & (F.regexp_like(c, F.lit(f"^{_QUOTED}$")) | ~F.regexp_like(c, F.lit(f"^{_QUOTED}")))
    cell = lambda c, i: F.struct(i.alias("col_idx"), F.when(is_quoted(c), quoted(c)).otherwise(F.nullif(c, F.lit(""))).alias("value"))
    cells = F.transform(F.transform(found, lambda c: F.substring(c, F.lit(1), F.length(c) - 1)), cell)
    parts = F.split("file", "/")
    book = F.url_decode(F.regexp_replace(F.element_at(parts, -2), "^[A-Za-z_]+=", ""))  # a partition's folder is named key=value
    return records.select(book.alias("book"), F.regexp_replace(F.element_at(parts, -1), "\\.(csv|txt)$", "").alias("sheet"), "row_idx", cells.alias("cells"))


def any_case(extension: str) -> str:
    """A glob of the names that end so in any case, for ``pathGlobFilter``: Spark then opens no other file."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def triage_files(spark: SparkSession, path: str, extension: str = ".xlsx") -> DataFrame:
    """path, length, error_code of landed files: extension, size, then the archive's signature; content is read only of those that pass.

    Names pass by the glob and sizes by a filter that the reader takes, so a file of another kind, however large, is listed and not opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    with listing(spark):
        every, named = files.load(path), files.option("pathGlobFilter", any_case(extension)).load(path)
    listed, good = every.select("path", "length"), named.where(F.col("length") <= MOST_BYTES)
    signed = good.select("path", (F.hex(F.substring("content", 1, 4)) == "504B0304").alias("signed"))
    code = F.when(~F.lower("path").endswith(extension), "wrong-extension").when(F.col("length") > MOST_BYTES, "too-large").when(~F.col("signed"), "not-an-archive")
    return listed.join(signed, "path", "left").select("path", "length", code.alias("error_code"))


def intake_status(books: DataFrame, sheets: DataFrame, catalogue: DataFrame, kept: DataFrame) -> DataFrame:
    """book, error_code: no populated sheet, no columns, no rows left after cleaning."""
    full = sheets.groupBy("book").agg(F.sum("populated").alias("cells"))
    cols = catalogue.groupBy("book").agg(F.count("*").alias("columns"))
    rows = kept.groupBy("book").agg(F.count("*").alias("rows"))
    joined = books.select("book").distinct().join(full, "book", "left").join(cols, "book", "left").join(rows, "book", "left").fillna(0)
    return joined.select("book", F.when(F.col("cells") == 0, "no-populated-sheet").when(F.col("columns") == 0, "no-columns").when(F.col("rows") == 0, "no-rows").alias("error_code"))


def populated(cells: DataFrame) -> DataFrame:
    return cells.where(clean_string("value").isNotNull())
