"""Registered queries that read files back from the shared folder, and the reports around them, with DuckDB SQL for their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions import text, values
from landloom.operators import attachments, catalogue, drift, facets, geometry, measures, places, quality, rollup, sites
from landloom.plans import extract, ingest
from landloom.plans import queries as q
from landloom.plans import testbed as tb
from landloom.plans.queries import query
from landloom.sources import archives, boundaries, grids
from landloom.sources.tables import land_files, shared_dir, written


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/landloom/{uuid.uuid4().hex}/{name}"


def _texts(lines: DataFrame) -> DataFrame:
    """folder, content of files, one a book, from lines (book, i: place, value)."""
    gathered = F.array_sort(F.collect_list(F.struct("i", "value")))
    return lines.groupBy("book").agg(gathered.alias("v")).select(F.concat(F.lit("book="), F.col("book")).alias("folder"), F.concat(F.array_join(F.transform("v", lambda x: x["value"]), "\n"), F.lit("\n")).alias("content"))


# Books of 25 customers as CSV files: a title, a blank row, a header with a repeated, an empty and an unnamed column, rows without a state.
HEADER = ("State ", "District", "Site", "Total Land Area", "Private Sale", "Used Land", "Unused Land", "STATE", "", "Purchase Date", "")


def _landed(spark: SparkSession, sf: str) -> str:
    c = tb.spread(tb.table(spark, sf, "customer"), "c_custkey")
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    state = F.when(k % 25 == 24, "n/a").otherwise(F.col("c_mktsegment"))
    cells = [state, F.concat(F.lit("D"), "c_nationkey"), F.concat(F.lit('"'), "c_name", F.lit(', ""main"""')), F.concat((k * 10).cast("string"), F.lit(" acres")), (k * 10).cast("string"), (k * 4).cast("string"), (k * 6 + (k % 5 == 0).cast("int")).cast("string"), state, F.when(k % 2 == 1, s).otherwise(""), F.lit(""), F.lit("")]
    book = F.concat(F.lit("book-"), F.floor(k / 25))
    data = c.select(book.alias("book"), (k % 25 + 3).alias("i"), F.concat_ws(",", *cells).alias("value"))
    tops = F.array(F.lit("Land report 2024" + "," * 10), F.lit("," * 10), F.lit(",".join(HEADER)))
    heads = c.where(k % 25 == 0).select(book.alias("book"), F.posexplode(tops).alias("i", "value"))
    path = _folder(spark, "grids")
    land_files(_texts(data.unionByName(heads.withColumn("i", F.col("i").cast("long")))), path, "txt")
    return path


def _ingested(spark: SparkSession, sf: str) -> ingest.Ingested:
    rows = written(grids.scan_rows(spark, _landed(spark, sf), folders=True), "rows")
    return ingest.ingest(rows, rows.select("book", "sheet").distinct().withColumn("ordinal", F.lit(0)))


LANDED = """WITH k AS (SELECT 'book-' || (c_custkey // 25) AS book, c_custkey AS k, c_mktsegment AS state, 'D' || c_nationkey AS district, c_name AS site FROM customer), kept AS (SELECT * FROM k WHERE k % 25 <> 24),
 n AS (SELECT book, count(*) AS kept FROM kept GROUP BY book),
 cols AS (SELECT book, unnest(['state', 'district', 'site', 'total land area', 'private sale', 'used land', 'unused land', 'state__2', '__col_8', 'purchase date']) AS key, unnest([state, district, site, CAST(k * 10 AS VARCHAR), CAST(k * 10 AS VARCHAR), CAST(k * 4 AS VARCHAR), CAST(k * 6 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR), state, CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) END, NULL]) AS v, unnest([false, false, false, false, true, true, true, false, true, false]) AS typed FROM kept),
 prof AS (SELECT book, key, any_value(kept) AS kept, count(v) AS pop, count(DISTINCT v) AS dist, count(try_cast(v AS DOUBLE)) / nullif(count(v), 0) AS ratio, any_value(typed) AND count(DISTINCT v) = any_value(kept) AND max(try_cast(v AS DOUBLE)) - min(try_cast(v AS DOUBLE)) = count(v) - 1 AS serial FROM cols JOIN n USING (book) GROUP BY ALL),
 roles AS (SELECT *, CASE WHEN pop = 0 THEN 'meta' WHEN coalesce(serial, false) THEN 'meta' WHEN ratio > 0.8 OR key = 'total land area' THEN 'measure' WHEN dist > 2 THEN 'dimension' ELSE 'meta' END AS role FROM prof),
 r AS (SELECT book, count(*) AS columns, count(*) FILTER (WHERE role = 'dimension') AS dimensions, count(*) FILTER (WHERE role = 'measure') AS measures, count(*) FILTER (WHERE role = 'meta') AS metas, count(*) FILTER (WHERE pop = 0) AS empty_columns,
  bool_or(key = 'total land area' AND role = 'measure') AS total, bool_or(key = 'private sale' AND role = 'measure') AS sale, bool_or(key = 'used land' AND role = 'measure') AS used, bool_or(key = 'unused land' AND role = 'measure') AS unused FROM roles GROUP BY book),
 w AS (SELECT kept.book, count(*) FILTER (WHERE total AND used AND unused AND k % 5 = 0) AS bad, count(*) FILTER (WHERE true) AS kept FROM kept JOIN r USING (book) GROUP BY kept.book), lost AS (SELECT book, count(*) FILTER (WHERE k % 25 = 24) AS dropped, bool_or(true) AS any FROM k GROUP BY book)"""


@query(LANDED + " SELECT book, w.kept + dropped AS rows, w.kept, dropped, bad AS rows_with_violations, columns, dimensions, measures, metas, empty_columns FROM r JOIN w USING (book) JOIN lost USING (book)")
def ingest_files(spark, sf):
    """Landed CSV files to records: rows, columns by role and violations of every book."""
    return _ingested(spark, sf).stats().select("book", "rows", "kept", "dropped", "rows_with_violations", "columns", F.col("dimensions"), "measures", "metas", "empty_columns")


@query(LANDED + """, c AS (SELECT book, unnest(['duplicate-headers', 'unnamed-columns', 'empty-columns', 'roles-from-names', 'no-district-column', 'no-measure', 'rows-dropped', 'discarded-empty-columns', 'invariant-violations', 'unbound-invariant', 'header-fallback']) AS code,
 unnest([1, CASE WHEN m.u > 0 THEN 1 ELSE 0 END, empty_columns, empty_columns, CASE WHEN d.role = 'measure' THEN 1 ELSE 0 END, CASE WHEN measures = 0 THEN 1 ELSE 0 END, dropped, 1 + CASE WHEN m.u = 0 THEN 1 ELSE 0 END, bad, CASE WHEN total AND sale THEN 0 ELSE 1 END + CASE WHEN total AND (used OR unused) THEN 0 ELSE 1 END, 0]) AS n
 FROM r JOIN w USING (book) JOIN lost USING (book) JOIN (SELECT book, role FROM roles WHERE key = 'district') d USING (book) JOIN (SELECT book, count(*) FILTER (WHERE k % 2 = 1) AS u FROM k GROUP BY book) m USING (book)) SELECT book, code, CAST(n AS BIGINT) AS n, code IN ('header-fallback', 'no-measure') AS caution FROM c WHERE n > 0""")
def ingest_warnings(spark, sf):
    """Every warning of the landed books, and which of them are shown before a load."""
    found = _ingested(spark, sf).warnings().select("book", "code", "n")
    shown = catalogue.cautions(found).select("book", "code", F.lit(True).alias("caution"))
    return found.join(shown, ["book", "code"], "left").withColumn("caution", F.coalesce("caution", F.lit(False)))


@query(LANDED + " SELECT book, 'row-' || (k % 25 + 3) AS record_id, state, district, site || ', \"main\"' AS site, CAST(k * 10 AS DOUBLE) AS total FROM kept JOIN r USING (book) WHERE total")
def ingest_records(spark, sf):
    """The landed books' records on fixed roles: one table, whatever each book calls its columns."""
    rec = _ingested(spark, sf).roles().where(F.array_contains("bound", "total"))
    return rec.select("book", "record_id", "state", "district", "site", "total")


def _ragged(spark: SparkSession, sf: str) -> str:
    """Books of 25 customers: odd ones of three columns under a title, even ones of seven to twelve; a district's cell goes over two lines."""
    c = tb.spread(tb.table(spark, sf, "customer"), "c_custkey")
    k, book = F.col("c_custkey"), F.floor(F.col("c_custkey") / 25)
    district = F.concat(F.lit('"D'), "c_nationkey", F.lit('\neast"'))
    wide = (book % 6 + 7).cast("int")
    pad = F.repeat(F.lit(","), wide - 4)
    value = F.when(book % 2 == 1, F.concat_ws(",", F.col("c_mktsegment"), district, k * 10)).otherwise(F.concat(F.concat_ws(",", F.col("c_mktsegment"), district, F.lit("s"), k * 10), pad))
    header = F.when(book % 2 == 1, "State,District,Area").otherwise(F.concat(F.lit("State,District,Site,Area"), F.array_join(F.transform(F.sequence(F.lit(5), wide), lambda i: F.concat(F.lit(",c"), i.cast("string"))), "")))
    top = F.when(book % 2 == 1, "Report of land").otherwise(F.concat(F.lit("t"), F.repeat(F.lit(","), wide)))
    data = c.select(book.alias("book"), (k % 25 + 3).alias("i"), value.alias("value"))
    heads = c.where(k % 25 == 0).select(book.alias("book"), F.explode(F.array(F.struct(F.lit(1).alias("i"), top.alias("value")), F.struct(F.lit(2).alias("i"), header.alias("value")))).alias("h")).select("book", F.col("h.i").cast("long").alias("i"), "h.value")
    path = _folder(spark, "ragged")
    land_files(_texts(data.unionByName(heads)), path, "txt")
    return path


@query("""WITH c AS (SELECT c_custkey // 25 AS book, c_custkey AS k, 'D' || c_nationkey || ' east' AS district FROM customer), b AS (SELECT book, count(*) AS rows, min(district) AS first_district, CAST(sum(k * 10) AS DOUBLE) AS area, bool_or(k % 25 = 0) AS headed FROM c GROUP BY book)
 SELECT CAST(book AS VARCHAR) AS book, 1 AS header_row, false AS used_fallback, CASE WHEN book % 2 = 1 THEN 'state|district|area' ELSE 'state|district|site|area' || array_to_string(list_transform(range(5, book % 6 + 8), lambda i: '|c' || i), '') END AS keys, rows, first_district, area, CAST(CASE WHEN book % 2 = 1 THEN 0 ELSE 1 END AS BIGINT) AS debris FROM b WHERE headed""")
def ragged_books(spark, sf):
    """Books of unequal width in one read: header, keys, records and left-out columns of each, as if read alone."""
    read = written(grids.scan_rows(spark, _ragged(spark, sf), folders=True), "rows")
    done = ingest.ingest(read, read.select("book", "sheet").distinct().withColumn("ordinal", F.lit(0)))
    keys = done.keys.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "key"))), lambda x: x["key"]), "|").alias("keys"))
    one = lambda key: F.when(F.col("key") == key, F.col("value"))
    figures = done.records.groupBy("book").agg(F.min(one("district")).alias("first_district"), F.sum(one("area").cast("double")).alias("area"))
    rows = done.rows.groupBy("book").agg(F.count("*").alias("rows")).join(figures, "book")
    debris = done.debris.groupBy("book").agg(F.count("*").alias("debris"))
    out = done.headers.select("book", F.col("header_row").cast("int").alias("header_row"), "used_fallback").join(keys, "book").join(rows, "book").join(debris, "book", "left").fillna(0, ["debris"])
    return out.select("book", "header_row", "used_fallback", "keys", "rows", "first_district", "area", "debris")


@query("""SELECT 's' || s_suppkey || CASE WHEN s_suppkey % 5 = 4 THEN '.bin' ELSE '.kml' END AS file, CASE s_suppkey % 5 WHEN 4 THEN 'not a boundary file' WHEN 3 THEN 'unparseable' ELSE 'parsed' END AS status, CAST(CASE WHEN s_suppkey % 5 < 3 THEN 3 ELSE 0 END AS BIGINT) AS vertices, CASE WHEN s_suppkey % 5 < 3 THEN CAST(70 + s_suppkey % 20 AS DOUBLE) END AS west FROM supplier""")
def landed_boundaries(spark, sf):
    """Boundary files that lie in the shared folder, beside files of another kind that are never opened: listed, read and judged."""
    k = F.col("s_suppkey")
    x, y = 70 + k % 20, 8 + k % 17
    at = lambda dx, dy: F.concat((x + dx).cast("string"), F.lit(","), (y + dy).cast("string"))
    mark = F.concat(F.lit("<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>"), F.concat_ws(" ", at(0, 0), at(1, 0), at(1, 1)), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    value = F.when(k % 5 == 3, "broken").otherwise(F.concat(F.lit("<kml><Document>"), mark, F.lit("</Document></kml>")))
    path = _folder(spark, "boundaries")
    named = tb.table(spark, sf, "supplier").select(k.alias("n"), value.alias("value"), (k % 5 == 4).alias("other"))
    for other, extension in ((False, "kml"), (True, "bin")):
        tb.spread(named.where(F.col("other") == other).select("n", "value"), "n").write.options(extension=extension, sep="\x01", quote="").partitionBy("n").csv(f"{path}/{extension}")
    listed = archives.landed(spark, path).where(F.regexp_like("path", F.lit("/part-[^/]*$")))
    named = listed.select(F.concat(F.lit("s"), F.regexp_extract("path", "/n=(\\d+)/", 1), F.lit("."), F.element_at(F.split("path", "\\."), -1)).alias("path"), "content")
    files = written(archives.expand_archives(named), "files")
    vertices, read = archives.scan_placemarks(files)
    seen = vertices.groupBy("file").agg(F.count("*").alias("vertices"), F.min("lng").alias("west"))
    status = geometry.file_parse_status(read, vertices).select("file", F.col("parse_status").alias("status"))
    good = status.join(seen, "file", "left")
    bad = files.where("skip_reason is not null").select(F.col("filename").alias("file"), F.col("skip_reason").alias("status"), F.lit(None).cast("long").alias("vertices"), F.lit(None).cast("double").alias("west"))
    return good.unionByName(bad).withColumn("vertices", F.coalesce("vertices", F.lit(0)))


def _files(spark: SparkSession, sf: str) -> str:
    """A text and a JSON file of every book's customers; the text begins with an archive's signature, or with another."""
    k = F.col("c_custkey")
    c = tb.table(spark, sf, "customer").select(F.floor(k / 25).alias("book"), k, "c_name", F.row_number().over(W.partitionBy(F.floor(k / 25)).orderBy(k)).alias("i"))
    path = _folder(spark, "drop")
    signed = F.concat(F.when(F.col("i") > 1, "").when(F.col("book") % 2 == 0, "PK\x03\x04").otherwise("PKxx"), "c_name")
    land_files(_texts(c.select("book", "i", signed.alias("value"))), f"{path}/a", "txt")
    land_files(_texts(c.select("book", "i", F.to_json(F.struct("c_name")).alias("value"))), f"{path}/b", "json")
    return path


@query("WITH b AS (SELECT DISTINCT c_custkey // 25 AS book FROM customer) SELECT book, 'text' AS kind, CASE WHEN book % 2 = 1 THEN 'not-an-archive' END AS error_code FROM b UNION ALL SELECT book, 'json', 'wrong-extension' FROM b")
def triage(spark, sf):
    """Landed files by extension, size and signature."""
    out = grids.triage_files(spark, _files(spark, sf), ".txt").where(F.regexp_like("path", F.lit("/part-[^/]*$")))
    return out.select(F.regexp_extract("path", "book=(\\d+)", 1).cast("long").alias("book"), F.when(F.col("path").endswith(".txt"), "text").otherwise("json").alias("kind"), "error_code")


@query("WITH b AS (SELECT c_custkey // 25 AS i, count(*) FILTER (WHERE c_custkey % 25 <> 24) AS n FROM customer GROUP BY ALL) SELECT 'full-' || i AS book, NULL AS error_code FROM b UNION ALL SELECT 'bare-' || i, 'no-rows' FROM b UNION ALL SELECT 'blank-' || i, 'no-populated-sheet' FROM b")
def intake_status(spark, sf):
    """Books that hold rows, a header alone, or nothing."""
    full = q._cells(spark, sf).where("sheet = 'data'").withColumn("book", F.replace("book", F.lit("book"), F.lit("full")))
    bare = full.where("row_idx = 1").withColumn("book", F.replace("book", F.lit("full"), F.lit("bare")))
    blank = full.withColumn("book", F.replace("book", F.lit("full"), F.lit("blank"))).withColumn("value", F.when(F.col("row_idx") % 2 == 0, " "))
    rows = written(catalogue.rows_of(full.unionByName(bare).unionByName(blank)), "rows")
    done = ingest.ingest(rows, rows.select("book", "sheet").distinct().withColumn("ordinal", F.lit(0)))
    return grids.intake_status(rows.select("book").distinct(), done.sheets, done.catalogue, done.rows.select("book", "record_id"))


# A land register of every order, a book a state.
REGISTER = ("sr no", "business", "site", "state", "district", "private sale", "private lease", "govt/revenue", "total land area", "used land", "unused land", "latitude", "purchase date", "utilization percentage(%)")
REGISTER_SQL = f"""{q.MEASURED}, reg AS (SELECT state AS book, unnest({list(REGISTER)}) AS key, unnest([CAST(k AS VARCHAR), business, site, state, district, CAST(sale AS VARCHAR), CAST(lease AS VARCHAR), CAST(govt AS VARCHAR), CAST(total AS VARCHAR), CAST(used AS VARCHAR), CAST(unused AS VARCHAR), CAST(8.5 + k % 17 AS VARCHAR), NULL, NULL]) AS v FROM measured),
 p AS (SELECT book, key, count(*) AS n, count(v) AS pop, count(DISTINCT coalesce(CAST(try_cast(v AS DOUBLE) AS VARCHAR), v)) AS d, count(try_cast(v AS DOUBLE)) / nullif(count(v), 0) AS ratio, count(v) = count(*) AND count(DISTINCT try_cast(v AS DOUBLE)) = count(*) AND coalesce(bool_and(try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))), false) AND max(try_cast(v AS DOUBLE)) - min(try_cast(v AS DOUBLE)) = count(*) - 1 AS serial FROM reg GROUP BY ALL),
 cat AS (SELECT book, key, pop, CASE WHEN pop = 0 THEN CASE WHEN key LIKE '%date%' THEN 'meta' WHEN key LIKE '%percentage%' THEN 'measure' ELSE 'meta' END WHEN coalesce(serial, false) THEN 'meta' WHEN ratio > 0.8 THEN 'measure' WHEN d > 2 THEN 'dimension' ELSE 'meta' END AS role FROM p),
 eff AS (SELECT *, CASE WHEN key = 'sr no' THEN 'meta' ELSE role END AS effective_role FROM cat),
 bound AS (SELECT *, CASE WHEN effective_role = 'measure' THEN CASE key WHEN 'total land area' THEN 'total' WHEN 'unused land' THEN 'unused' WHEN 'used land' THEN 'used' WHEN 'private sale' THEN 'private-sale' WHEN 'private lease' THEN 'private-lease' WHEN 'govt/revenue' THEN 'govt-revenue' END WHEN key IN ('state', 'district') THEN key END AS bound_as FROM eff)"""


def _register(spark: SparkSession, sf: str) -> ingest.Ingested:
    m = tb.measured(spark, sf)
    k = F.col("source_row_number")
    own = [k, "business", "site", "state", "district", "sale", "lease", "govt", "total", "used", "unused", 8.5 + k % 17, F.lit(None), F.lit(None)]
    data = m.select(F.col("state").alias("book"), (k + 1).alias("row_idx"), F.array(*((F.col(c) if isinstance(c, str) else c).cast("string") for c in own)).alias("v"))
    heads = data.select("book").distinct().select("book", F.lit(0).cast("long").alias("row_idx"), F.array(*(F.lit(f" {h.title()}:") for h in REGISTER)).alias("v"))
    cells = F.transform("v", lambda x, i: F.struct(i.alias("col_idx"), x.alias("value")))
    rows = written(data.unionByName(heads).select("book", F.lit("register").alias("sheet"), "row_idx", cells.alias("cells")), "rows")
    sheets = rows.select("book", "sheet").distinct()
    roles = sheets.select("book", "sheet", F.lit("sr no").alias("key"), F.lit("meta").alias("role_override"))
    return ingest.ingest(rows, sheets.withColumn("ordinal", F.lit(0)), header_overrides=sheets.withColumn("header_row", F.lit(0).cast("long")), role_overrides=roles)


@query(f"WITH {REGISTER_SQL} SELECT book, key, role, effective_role, bound_as, pop > 0 AS visible, CASE WHEN key IN ('business', 'site') THEN key END AS picked, CASE WHEN key = 'latitude' THEN key END AS coordinate FROM bound")
def register_roles(spark, sf):
    """Roles from values and from names, overrides, bindings, picked columns and coordinates of every book's columns."""
    done = _register(spark, sf)
    cat, key = done.catalogue, ["book", "key"]
    seen = catalogue.visible_columns(cat).select(*key, F.lit(True).alias("visible"))
    words = catalogue.pick_word(cat, "business").withColumn("picked", F.lit("business")).unionByName(catalogue.pick_word(cat, "site").withColumn("picked", F.lit("site"))).drop("sheet")
    out = cat.select(*key, "role", "effective_role").join(done.bindings.select(*key, F.col("role").alias("bound_as")), key, "left").join(seen, key, "left").join(words, key, "left")
    out = out.join(catalogue.coordinate_columns(cat).select(*key, F.col("kind").alias("coordinate")), key, "left")
    return out.withColumn("visible", F.coalesce("visible", F.lit(False)))


@query(f"""WITH {REGISTER_SQL}, x AS (SELECT book, 'sheet:' || key AS id, 'sheet' AS kind, CASE WHEN key LIKE '%\\%)' ESCAPE '\\' OR key LIKE '%rate%' OR key LIKE '%percent%' THEN 'mean' ELSE 'sum' END AS aggregation, CASE WHEN key LIKE '%percent%' THEN 'percent' WHEN key LIKE '%rate%' OR key LIKE '%price%' OR key LIKE '%value%' OR key LIKE '%cost%' THEN 'currency-inr' WHEN key LIKE '%area%' OR key LIKE '%land%' THEN 'acre' ELSE 'number' END AS unit, CASE WHEN pop > 0 AND key = 'total land area' THEN 0 WHEN pop > 0 THEN 1 ELSE 3 END AS rank, list_position({list(REGISTER)}, key) AS ord FROM eff WHERE effective_role = 'measure'),
 h AS (SELECT book, bool_or(bound_as = 'total') AS t, bool_or(bound_as = 'used') AS u, bool_or(bound_as IN ('private-sale', 'private-lease')) AS p, bool_or(bound_as = 'govt-revenue') AS g FROM bound GROUP BY book),
 y AS (SELECT * FROM x UNION ALL SELECT book, 'derived:utilisation', 'derived', 'ratio', 'percent', 2, 1001 FROM h WHERE t AND u UNION ALL SELECT book, 'derived:private-tenure', 'derived', 'ratio', 'percent', 2, 1002 FROM h WHERE t AND p UNION ALL SELECT book, 'derived:govt-tenure', 'derived', 'ratio', 'percent', 2, 1003 FROM h WHERE t AND g)
 SELECT book, id, kind, aggregation, unit, row_number() OVER (PARTITION BY book ORDER BY rank, ord) = 1 AS is_default FROM y""")
def register_measures(spark, sf):
    """Measures of every book, its own and derived, and its default."""
    done = _register(spark, sf)
    m = measures.measure_catalogue(done.catalogue, done.bindings)
    best = measures.default_measure(m).select("book", F.col("default_id").alias("id"), F.lit(True).alias("is_default"))
    return m.select("book", "id", "kind", "aggregation", "unit").join(best, ["book", "id"], "left").withColumn("is_default", F.coalesce("is_default", F.lit(False)))


@query(f"WITH {q.MEASURED}, v AS (SELECT state AS book, 'composition' AS invariant, sale + lease + govt AS observed, total AS expected FROM measured UNION ALL SELECT state, 'utilization', used + unused, total FROM measured) SELECT book, invariant, count(observed) AS checked, count(*) - count(observed) AS skipped, count(*) FILTER (WHERE abs(observed - expected) > greatest(0.005, 1e-9 * greatest(abs(observed), abs(expected)))) AS violated FROM v GROUP BY ALL UNION ALL SELECT 'bare', unnest(['composition', 'utilization']), 0, 0, 0")
def register_invariants(spark, sf):
    """Invariants of every book on its bound roles, and those that a book without figures can't check."""
    done = _register(spark, sf)
    summary = done.checks().groupBy("book", "invariant").agg(F.count_if(F.col("status") != "indeterminate").alias("checked"), F.count_if(F.col("status") == "indeterminate").alias("skipped"), F.count_if(F.col("status") == "violated").alias("violated"))
    sheets = done.catalogue.select("book", "sheet").distinct()
    bare = sheets.limit(1).select(F.lit("bare").alias("book"), "sheet")
    never = quality.sheet_unbound(done.bindings, sheets.unionByName(bare))
    return summary.unionByName(never.select("book", "invariant", *(F.lit(0).cast("long").alias(c) for c in ("checked", "skipped", "violated"))))


@query(f"WITH {q.MEASURED} SELECT state, district AS name, count(*) AS records, round(sum(total), 2) AS value FROM measured GROUP BY ALL")
def register_rollup(spark, sf):
    """From books to regions: records on fixed roles, resolved and rolled up."""
    rec = _register(spark, sf).roles()
    resolved = places.resolve_records(rec, tb.nation_dim(spark, sf), *tb.no_aliases(spark))
    return rollup.rollup(resolved, "district", F.count("*").alias("records"), F.round(F.sum("total"), 2).alias("value")).drop("level")


@query(f"SELECT c_custkey AS k, {q.cs('c_name')} AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 6 <> 0")
def clean_rows(spark, sf):
    """Wide rows cleaned once, and rows without any value dropped."""
    k = F.col("c_custkey")
    c = tb.table(spark, sf, "customer").select(k.alias("k"), F.when(k % 6 == 0, " n/a ").otherwise(F.concat(F.lit("\t"), "c_name", F.lit(" "))).alias("name"), F.when(k % 3 == 0, "-").otherwise(F.col("c_mktsegment")).alias("segment"))
    return catalogue.drop_blank_rows(catalogue.clean_all(c, ["name", "segment"]), ["name", "segment"])


COUNTED = "n AS (SELECT view_id, 'business' AS dimension, business AS value, count(*) FILTER (WHERE i2 AND i3 AND i4) AS n FROM b4 WHERE ranged GROUP BY ALL UNION ALL SELECT view_id, 'state', state, count(*) FILTER (WHERE i1 AND i3 AND i4) FROM b4 WHERE ranged GROUP BY ALL UNION ALL SELECT view_id, 'district', district, count(*) FILTER (WHERE i1 AND i2 AND i4) FROM b4 WHERE ranged GROUP BY ALL UNION ALL SELECT view_id, 'site', site, count(*) FILTER (WHERE i1 AND i2 AND i3) FROM b4 WHERE ranged GROUP BY ALL)"
OFFERED = "av AS (SELECT DISTINCT view_id, 'business' AS dimension, business AS value FROM b4 UNION ALL SELECT DISTINCT view_id, 'state', state FROM b4 WHERE ranged AND i1 UNION ALL SELECT DISTINCT view_id, 'district', district FROM b4 WHERE ranged AND i1 AND i2 UNION ALL SELECT DISTINCT view_id, 'site', site FROM b4 WHERE ranged AND i1 AND i2 AND i3)"


@query(f"""{q.CASCADE}, {COUNTED}, {OFFERED}, o AS (SELECT *, true AS available FROM av UNION ALL (SELECT DISTINCT view_id, dimension, value, false FROM sel s WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.view_id = s.view_id AND act.dimension = s.dimension AND act.value = s.value)))
 SELECT o.view_id, o.dimension, o.value, available, CASE WHEN available THEN coalesce(n.n, 0) ELSE 0 END AS n, EXISTS (SELECT 1 FROM sel WHERE sel.view_id = o.view_id AND sel.dimension = o.dimension AND sel.value = o.value) AS selected, (SELECT count(*) FROM act WHERE act.view_id = o.view_id AND act.dimension = o.dimension) AS active_count, count(*) FILTER (WHERE available) OVER (PARTITION BY o.view_id, o.dimension) AS available_count FROM o LEFT JOIN n USING (view_id, dimension, value)""")
def facet_view(spark, sf):
    """Options of every view and dimension with counts, marks and totals."""
    return facets.facet_view(*q._views(spark, sf))


@query(f"{q.CASCADE}, {OFFERED} SELECT dimension, value FROM av WHERE view_id = 'a' AND dimension IN ('business', 'state', 'district') ORDER BY dimension, value LIMIT 7")
def facet_options(spark, sf):
    """The first options of one view in reading order."""
    by_view, sel, active = q._views(spark, sf)
    view = facets.facet_view(by_view, sel, active).where("view_id = 'a' and dimension <> 'site' and available")
    return facets.option_order(view).limit(7).select("dimension", "value")


@query(q.RESTORE + " SELECT DISTINCT view_id, dimension, value FROM sel UNION SELECT view_id, blocked_by, unnest(string_split(add, '|')) FROM blk")
def facet_widened(spark, sf):
    """Selections with the values that bring their orphans back."""
    by_view, sel, active = q._views(spark, sf)
    return facets.widen(sel, facets.restore_plan(by_view, sel, active))


@query(f"WITH {q.PLACED} SELECT record_id, state_match AS state, district_match AS district FROM placed WHERE business IN ('MACHINERY', 'FURNITURE') AND district_match IN ('NATION_1', 'NATION_2', 'NATION_3') AND area BETWEEN 1000 AND 100000")
def facet_rows(spark, sf):
    """The rows of one view by plain predicates."""
    rows = facets.facet_rows(tb.placed(spark, sf), ["area"])
    picked = facets.rows_matching(rows, {"business": ["MACHINERY", "FURNITURE"], "state": [], "district": ["NATION_1", "NATION_2", "NATION_3"]}, {"area": (1000.0, 100000.0)})
    return picked.select("record_id", "state", "district")


@query(f"WITH {q.REC}, {q.SEL}, b AS (SELECT min(area) AS lo, max(area) AS hi FROM rec) SELECT view_id, CAST(n + coalesce((SELECT count(*) FROM rng, b WHERE rng.view_id = s.view_id AND (rng.lo > b.lo OR rng.hi < b.hi)), 0) AS BIGINT) AS n FROM (SELECT view_id, count(*) AS n FROM sel GROUP BY view_id) s")
def facet_filter_count(spark, sf):
    sel = spark.createDataFrame(q.SELECTIONS, "view_id string, dimension string, value string")
    rng = spark.createDataFrame(q.RANGES, "view_id string, measure string, lo double, hi double")
    return facets.active_filter_count(sel, rng, facets.measure_bounds(tb.records(spark, sf), ["area"]))


OUTCOMES = "o AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, CASE WHEN page_id % 7 = 0 THEN 'missing-file' WHEN page_id % 7 = 1 THEN 'checksum-mismatch' WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'imported' END AS outcome FROM pages)"


@query(f"""WITH {OUTCOMES} SELECT unnest(['attachments', 'bytes', 'listed', 'imported', 'replaced', 'skipped', 'rejected', 'orphaned']) AS figure, unnest([(SELECT count(*) FROM o), (SELECT coalesce(sum(bytes), 0) FROM o), (SELECT count(*) FROM o WHERE page_id % 3 = 0), (SELECT count(*) FROM o WHERE outcome = 'imported'), 0, (SELECT count(*) FROM o WHERE outcome = 'skipped'), (SELECT count(*) FROM o WHERE outcome IN ('missing-file', 'checksum-mismatch')), (SELECT count(*) FROM o WHERE outcome = 'imported' AND page_id % 2 = 1)]::BIGINT[]) AS n""")
def store_report(spark, sf):
    """The store's size, a listing without contents, and what an import brought, with the sites that no record has."""
    st = q._store(spark, sf)
    k = F.col("seq")
    usage = attachments.storage_usage(st)
    listed = attachments.list_attachments(st, st.where(k % 3 == 0).select("site_key")).agg(F.count("*").alias("listed"))
    manifest = st.withColumn("path", F.concat(F.lit("files/"), "site_key")).select("site_key", "path", "sha256", "seq")
    files = st.where(k % 7 != 0).select(F.concat(F.lit("files/"), "site_key").alias("path"), F.when(k % 7 == 1, F.lit(b"other")).otherwise(F.col("content")).alias("content"))
    outcomes = written(attachments.import_bundle(manifest, files, st.where(k % 3 == 0)).select("site_key", "outcome"), "outcomes")
    lost = attachments.orphaned_imports(outcomes, st.where(k % 2 == 0)).agg(F.count("*").alias("orphaned"))
    one = usage.crossJoin(listed).crossJoin(attachments.import_summary(outcomes)).crossJoin(lost)  # one row each
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("long").alias("n")) for c in one.columns))).alias("x")).select("x.*")


@query("SELECT 'site-' || page_id AS site_key, sha256(coalesce(html, '')) AS sha256, 'imported' AS outcome, 2 AS format_version, (SELECT count(*) FROM pages) AS entries, CAST((SELECT sum(octet_length(encode(coalesce(html, '')))) FROM pages) AS BIGINT) AS total_bytes FROM pages")
def bundle_roundtrip(spark, sf):
    """A bundle written to the shared folder, read back and imported into an empty store."""
    st = q._store(spark, sf)
    path = _folder(spark, "bundle")
    attachments.write_bundle(st, path)
    files, manifest, head = attachments.read_bundle(spark, path)
    done = attachments.import_bundle(manifest, files, st.where("false"))
    return done.select("site_key", "sha256", "outcome").crossJoin(F.broadcast(head.select("format_version", "entries", "total_bytes")))  # one row


@query("SELECT unnest(['page_id', 'url', 'html', 'note']) AS key, unnest(['unchanged', 'role-changed', 'removed', 'added']) AS delta FROM (SELECT 1 FROM pages LIMIT 1) UNION ALL SELECT 'summary', 'added 1, role-changed 1, populated 0, identical false'")
def drift_summary(spark, sf):
    """What changed between two catalogues of the pages, in order, and its counts."""
    p = tb.spread(tb.table(spark, sf, "pages"), "page_id")
    long = p.select(F.col("page_id").alias("row_idx"), F.posexplode(F.array(F.col("page_id").cast("string"), F.concat(F.lit("u-"), F.col("page_id") % 9), F.col("html"))).alias("col_idx", "value"))
    cat = catalogue.profile_columns(long, p.agg(F.count("*").alias("n_rows")), []).withColumn("key", F.element_at(F.array(*map(F.lit, ("page_id", "url", "html"))), F.col("col_idx") + 1))
    cat = written(catalogue.infer_role(cat).select("key", F.col("key").alias("label"), "role", "is_empty"), "before")
    k = F.col("key")
    after = cat.where("key <> 'html'").withColumn("role", F.when(k == "url", "measure").otherwise(F.col("role")))
    after = after.unionByName(cat.where("key = 'page_id'").withColumns({"key": F.lit("note"), "label": F.lit("note")}))
    diff = written(drift.diff_columns(cat, after), "diff")
    said = drift.drift_summary(diff).select(F.lit("summary").alias("key"), F.format_string("added %d, role-changed %d, populated %d, identical %s", "added", "role_changed", "became_populated", F.col("identical").cast("string")).alias("delta"))
    return drift.drift_order(diff).limit(4).select("key", "delta").unionByName(said)


DRIFT = """p AS (SELECT p_partkey AS k, p_name AS key, p_size FROM part),
 b AS (SELECT key, CASE WHEN count(*) > 1 THEN 'dimension' ELSE 'meta' END AS role, min(p_size) > 25 AS e FROM p WHERE k % 3 <> 0 GROUP BY key), a AS (SELECT key, CASE WHEN count(*) > 1 THEN 'dimension' ELSE 'meta' END AS role, min(p_size) > 25 AS e FROM p WHERE k % 5 <> 0 GROUP BY key)"""


@query(f"""WITH {DRIFT}, d AS (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN a.role <> b.role THEN 'role-changed' WHEN b.e AND NOT a.e THEN 'became-populated' WHEN a.e AND NOT b.e THEN 'became-empty' ELSE 'unchanged' END AS delta FROM b FULL JOIN a ON a.key = b.key)
 SELECT key, delta, row_number() OVER (ORDER BY list_position(['role-changed', 'removed', 'added', 'became-populated', 'became-empty', 'unchanged'], delta), key) AS position FROM d""")
def drift_positions(spark, sf):
    """The order in which changed columns are told, for two catalogues that name a column for every part's name."""
    k = F.col("p_partkey")
    role = F.when(F.count("*") > 1, "dimension").otherwise("meta").alias("role")
    told = lambda p: p.groupBy(F.col("p_name").alias("key")).agg(role, (F.min("p_size") > 25).alias("is_empty")).withColumn("label", F.col("key"))
    p = tb.table(spark, sf, "part")
    return drift.drift_positions(drift.diff_columns(told(p.where(k % 3 != 0)), told(p.where(k % 5 != 0)))).select("key", "delta", F.col("position").cast("long").alias("position"))


def _import_sql(policy: str) -> str:
    """Sites 0 to n: a third stands in the store, and the bundle holds all but every fifth, with a name of its own."""
    taken = "false" if policy == "keep-existing" else "page_id % 5 <> 0"
    return f"""SELECT '{policy}' AS policy, 'site-' || page_id AS site_key, CASE WHEN page_id % 3 = 0 AND NOT ({taken}) THEN 'old' ELSE 'f' END || page_id || '.kmz' AS filename, sha256(coalesce(html, '')) AS sha256, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size_bytes,
 CASE WHEN page_id % 5 = 0 THEN 'kept' WHEN page_id % 3 <> 0 THEN 'imported' WHEN {taken} THEN 'replaced' ELSE 'skipped' END AS outcome, 2 AS version FROM pages WHERE page_id % 3 = 0 OR page_id % 5 <> 0"""


@query(" UNION ALL ".join(map(_import_sql, ("keep-existing", "replace"))))
def store_import(spark, sf):
    """A bundle imported into a versioned store under both policies, and the store as it is read back."""
    st = q._store(spark, sf)
    k = F.col("seq")
    bundle, out = _folder(spark, "bundle"), []
    attachments.write_bundle(st.where(k % 5 != 0), bundle)
    for policy in ("keep-existing", "replace"):
        store = attachments.VersionedStore(spark, _folder(spark, "store"), st.schema)
        store.put(st.where(k % 3 == 0).withColumn("filename", F.concat(F.lit("old"), k, F.lit(".kmz"))))
        done = store.load_bundle(bundle, policy).select("site_key", "outcome")
        now = store.read().where(text.content_hash("content") == F.col("sha256")).join(done, "site_key", "left")
        out.append(now.select(F.lit(policy).alias("policy"), "site_key", "filename", "sha256", F.octet_length("content").cast("long").alias("size_bytes"), F.coalesce("outcome", F.lit("kept")).alias("outcome"), F.lit(max(store.versions())).alias("version")))
    return out[0].unionByName(out[1])


@query(f"WITH {q.PLACED}, g AS (SELECT state_match AS state, district_match AS name, count(DISTINCT site) AS sites FROM placed WHERE district_match IS NOT NULL GROUP BY ALL) SELECT state, name, sites, CAST(70 + n_nationkey % 20 AS DOUBLE) AS lng, CAST(8 + n_nationkey % 17 AS DOUBLE) AS lat FROM g JOIN nation ON n_name = name WHERE state = 'ASIA'")
def region_badges(spark, sf):
    """Site counts of one state's districts at their centroids."""
    n = F.col("ordinal")
    dim = tb.nation_dim(spark, sf).withColumn("centroid", F.array((70 + n % 20).cast("double"), (8 + n % 17).cast("double")))
    regions = rollup.rollup(tb.placed(spark, sf), "district", *rollup.region_counts())
    return rollup.region_badges(dim, regions, "ASIA").select("state", "name", "sites", F.col("centroid")[0].alias("lng"), F.col("centroid")[1].alias("lat"))


@query(f"WITH {q.PLACED}, r AS (SELECT * FROM placed WHERE district_match = 'NATION_3') SELECT record_id, site, area, area AS value, round((SELECT sum(area) FROM r), 2) AS total_area FROM r ORDER BY area DESC, record_id LIMIT 40")
def region_site_list(spark, sf):
    """The largest records behind one region, with the region's total."""
    placed = tb.placed(spark, sf)
    region = rollup.rollup(placed, "district", F.count("*").alias("n")).where("name = 'NATION_3'")
    own = rollup.region_records(placed, region, "district")
    return rollup.region_site_list(own, F.col("area")).limit(40).withColumn("total_area", F.round("total_area", 2))


@query(f"WITH {q.PLACED}, f AS (SELECT DISTINCT state, district_match AS name FROM placed WHERE district_match IS NOT NULL AND district_match <> 'NATION_7') SELECT true AS any_no_data, (SELECT count(*) > 0 FROM f WHERE name = 'NATION_8') AS any_zero, (SELECT count(*) FROM f WHERE name <> 'NATION_9') AS with_value")
def legend(spark, sf):
    """What a map's legend must name."""
    rec = tb.placed(spark, sf).where("district <> 'NATION_7'")
    rec = rec.withColumn("area", F.when(F.col("district") == "NATION_8", 0.0).when(F.col("district") != "NATION_9", F.col("area")))
    dim = tb.nation_dim(spark, sf).where("level = 'district'")
    return rollup.legend_flags(rollup.region_fill(dim, rollup.rollup(rec, "district", F.sum("area").alias("value"))))


@query("SELECT 'row-' || o_orderkey AS record_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS area, page FROM (SELECT *, 2 AS page FROM (SELECT * FROM orders ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END DESC NULLS LAST, 'row-' || o_orderkey LIMIT 50 OFFSET 100) UNION ALL SELECT *, 3 FROM (SELECT * FROM orders ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END DESC NULLS LAST, 'row-' || o_orderkey LIMIT 50 OFFSET 150))")
def record_pages(spark, sf):
    """Two pages of sorted records: one by number, the next by its place behind the first's last row."""
    k = F.col("o_orderkey")
    rec = tb.table(spark, sf, "orders").select(F.concat(F.lit("row-"), k).alias("record_id"), F.when(k % 9 != 0, F.col("o_totalprice")).alias("area"))
    third = rollup.page(rollup.sort_records(rec, "area", descending=True), 2)
    last = third.collect()[-1]  # of one page's rows
    return third.withColumn("page", F.lit(2)).unionByName(rollup.page_after(rec, "area", (last["area"], last["record_id"]), descending=True).withColumn("page", F.lit(3)))


@query(f"""WITH {q.RESOLVED}, r AS (SELECT dirty.record_id, s.match AS sm, d.match AS dm, d.stage AS ds FROM dirty JOIN s USING (state) LEFT JOIN d ON d.in_state IS NOT DISTINCT FROM s.match AND d.district = dirty.district), rep AS (SELECT 'state' AS level, NULL AS parent, coalesce(nullif(s.key, ''), s.state) AS norm, min(s.stage) AS stage FROM dirty JOIN s USING (state) GROUP BY ALL UNION ALL SELECT 'district', d.in_state, coalesce(nullif(d.key, ''), d.district), min(d.stage) FROM dirty JOIN s USING (state) JOIN d ON d.in_state IS NOT DISTINCT FROM s.match AND d.district = dirty.district GROUP BY ALL)
 SELECT *, CAST(0 AS BIGINT) AS out_of_scope FROM (SELECT count(*) FILTER (WHERE stage = 1) AS names_stage_1, count(*) FILTER (WHERE stage = 2) AS names_stage_2, count(*) FILTER (WHERE stage = 3) AS names_stage_3, count(*) FILTER (WHERE stage = 4) AS names_stage_4 FROM rep), (SELECT count(dm) AS to_district, count(*) FILTER (WHERE sm IS NOT NULL AND dm IS NULL) AS to_state, count(*) FILTER (WHERE sm IS NULL) AS to_none FROM r)""")
def resolution_summary(spark, sf):
    """Names a stage, records by how far they were placed, and records placed outside their state (none)."""
    rec, dim, al = tb.dirty_records(spark, sf), tb.part_dim(spark, sf), tb.aliases(spark)
    resolved = written(places.resolve_records(rec, dim, *al), "resolved")
    out = places.resolution_summary(places.resolution_report(rec, dim, *al), resolved)
    return out.crossJoin(places.assert_scope(resolved, dim).agg(F.count("*").alias("out_of_scope")))  # one row each


@query(f"""WITH {q.RESOLVED}, r AS (SELECT 'state' AS level, NULL AS parent_state, coalesce(nullif(s.key, ''), s.state) AS norm, min(s.state) AS input, min(s.stage) AS stage, count(*) AS records FROM dirty JOIN s USING (state) GROUP BY ALL) SELECT input, stage, records FROM r ORDER BY stage DESC, records DESC, input LIMIT 6""")
def report_head(spark, sf):
    """The first rows of the resolution report of states, in its order."""
    rec = tb.dirty_records(spark, sf)
    report = places.resolution_report(rec, tb.part_dim(spark, sf), *tb.aliases(spark)).where("level = 'state'")
    return places.report_order(report).limit(6).select("input", "stage", "records")


@query("""WITH s AS (SELECT s_suppkey AS k, 'st|' || lower(n_name) || '|a' || s_suppkey AS site_key FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT site_key, CASE WHEN k % 4 = 1 AND k % 3 <> 0 THEN 'without-file' WHEN k % 5 = 0 THEN 'plottable' END AS state FROM s WHERE (k % 4 = 1 AND k % 3 <> 0) OR (NOT (k % 4 = 1 AND k % 3 <> 0) AND k % 5 = 0) UNION ALL SELECT 'hint', 'usable ' || (count(*) FILTER (WHERE s_suppkey % 10 = 5) > 0) || ' ' || count(*) FILTER (WHERE s_suppkey % 10 = 5) FROM supplier""")
def site_report(spark, sf):
    """Sites without a file in this batch or the store, sites that can be plotted, and what the column that names files holds."""
    rec = q._suppliers(spark, sf).withColumn("site", F.concat(F.lit("A"), "source_row_number"))
    index = written(sites.site_index(rec), "index")
    k = F.col("source_row_number")
    matches = sites.match_files(rec.where(k % 4 != 1).select(F.concat(F.lit("a"), k, F.lit(".kmz")).alias("filename")), index)
    held = sites.site_members(rec).where(k % 3 == 0).select("site_key")
    missing = written(sites.sites_without_file(index, matches, held).select("site_key", F.lit("without-file").alias("state")), "missing")
    store = sites.site_members(rec).where(k % 5 == 0).select("site_key", F.lit("parsed").alias("parse_status"), F.struct(F.lit(20.0).alias("lat"), F.lit(75.0).alias("lng")).alias("point"))
    store = store.unionByName(sites.site_members(rec).where(k % 5 == 1).select("site_key", F.lit("unparseable").alias("parse_status"), F.lit(None).cast("struct<lat:double,lng:double>").alias("point")))
    shown = sites.plottable_sites(index, store).join(missing.select("site_key"), "site_key", "left_anti").select("site_key", F.lit("plottable").alias("state"))
    hint = sites.hint_column_report(rec, "kmz_files").select(F.lit("hint").alias("site_key"), F.concat(F.lit("usable "), F.col("usable").cast("string"), F.lit(" "), "populated").alias("state"))
    return missing.unionByName(shown).unionByName(hint)


@query("SELECT 'Site [name]|Column 2|Loaded|Area|Area (more)' AS headers, o_orderkey AS k, c_name AS site, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS loaded, round(o_totalprice, 2) AS area, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS more FROM orders JOIN customer ON o_custkey = c_custkey")
def extract_written(spark, sf):
    """An extract under its original headers, written as CSV and read back."""
    o, c = tb.table(spark, sf, "orders"), tb.table(spark, sf, "customer")
    k = F.col("o_orderkey")
    rec = o.join(c, o.o_custkey == c.c_custkey).select(k.alias("k"), F.col("c_name").alias("site"), F.col("o_orderstatus").alias("__col_1"), F.col("o_orderdate").alias("loaded"), F.round("o_totalprice", 2).alias("area"), F.when(k % 5 != 0, F.round("o_totalprice", 2)).alias("more"))
    heads = [("k", "k", "k"), ("site", "Site [name]", "x"), ("__col_1", " ", "Column 2"), ("loaded", "Loaded", "x"), ("area", "Area", "x"), ("more", "Area", "x")]
    path = _folder(spark, "extract")
    extract.write_extract(rec, heads, path)
    back = spark.read.csv(path, header=True)
    headers = F.lit("|".join(back.columns[1:]))
    named = back.toDF("k", "site", "status", "loaded", "area", "more")
    return named.select(headers.alias("headers"), F.col("k").cast("long").alias("k"), "site", "status", "loaded", F.col("area").cast("double").alias("area"), F.col("more").cast("double").alias("more"))


def _boundary_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The parts' types and names as a feature collection, and an alias file, below the shared folder."""
    p = tb.table(spark, sf, "part")
    s = p.select(F.lit("state").alias("level"), F.lit(None).cast("string").alias("state"), F.col("p_type").alias("name")).distinct()
    d = p.select(F.lit("district").alias("level"), F.col("p_type").alias("state"), F.col("p_name").alias("name")).distinct()
    props = F.struct("name", "state", "level", F.when(F.col("level") == "state", "2011").otherwise("2024").alias("vintage"), F.array(F.lit(75.0), F.lit(20.0)).alias("centroid"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((75.0, 20.0), (76.0, 20.0), (76.0, 21.0))))).alias("coordinates"))
    features = s.unionByName(d).select(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry")).alias("f"))
    one = features.agg(F.to_json(F.struct(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["properties"]["name"] < b["properties"]["name"], -1).when(a["properties"]["name"] > b["properties"]["name"], 1).otherwise(0)).alias("features"))).alias("value"))  # a dimension of bounded size
    to, named = _folder(spark, "boundaries"), _folder(spark, "aliases")
    one.coalesce(1).write.text(to)
    al = d.where("name like 'red %'").agg(F.collect_list(F.struct(F.replace("name", F.lit("red "), F.lit("crimson ")).alias("from"), F.col("name").alias("to"), F.col("state"))).alias("districts"))
    more = al.select(F.create_map(F.lit("Std."), F.lit("STANDARD"), F.lit(" -- "), F.lit("x"), F.lit("Broken"), F.lit("ATLANTIS")).alias("states"), F.array_append("districts", F.struct(F.lit("lost").alias("from"), F.lit("").alias("to"), F.lit(None).cast("string").alias("state"))).alias("districts"))
    more.select(F.to_json(F.struct("states", "districts")).alias("value")).coalesce(1).write.text(named)
    return to, named


@query("""WITH s AS (SELECT DISTINCT p_type AS name FROM part), d AS (SELECT DISTINCT p_type AS state, p_name AS name FROM part) SELECT unnest(['level district', 'level state', 'vintage district', 'vintage state', 'unique_keys', 'parents', 'state_alias_targets', 'district_alias_targets', 'problem state no-from', 'problem district no-to', 'count_state']) AS figure,
 unnest([CAST((SELECT count(*) FROM d) AS VARCHAR), CAST((SELECT count(*) FROM s) AS VARCHAR), '2024', '2011', '0', '0', CAST(1 + CASE WHEN (SELECT count(*) FROM s WHERE name = 'STANDARD') = 0 THEN 1 ELSE 0 END AS VARCHAR), '0', '1', '1', '0']) AS value""")
def boundary_report(spark, sf):
    """Boundary and alias files read from disk: counts, vintages, the written manifest, checks and what was wrong with aliases."""
    to, named = _boundary_files(spark, sf)
    dim = written(places.boundary_dim(boundaries.scan_boundaries(spark, to)), "dim")
    sa, da, bad = boundaries.scan_aliases(spark, named)
    path = _folder(spark, "manifest")
    geometry.write_manifest(dim, {"tolerance": "1100"}, path)
    manifest = spark.read.schema("level string, features long, vintages array<string>, tolerance string").json(path)
    line = lambda df, name, value: df.select(name.alias("figure"), value.cast("string").alias("value"))
    out = line(manifest, F.concat(F.lit("level "), "level"), F.col("features")).unionByName(line(manifest, F.concat(F.lit("vintage "), "level"), F.array_join("vintages", ",")))
    n = dim.where("level = 'state'").count()
    out = out.unionByName(line(places.boundary_checks(dim, sa, da, {"state": n}), F.col("check"), F.col("problems")))
    return out.unionByName(line(bad.groupBy("level", "problem").agg(F.count("*").alias("n")), F.concat(F.lit("problem "), "level", F.lit(" "), "problem"), F.col("n")))


@query("""SELECT CASE WHEN k % 6 = 5 THEN 'z' || k ELSE 's' || k END || CASE WHEN k % 6 = 4 THEN '.kmz' ELSE '.kml' END AS file, CASE WHEN k % 6 = 5 THEN 'drop' || k || '.zip' END AS from_archive, CASE WHEN k % 6 IN (1, 2, 4) THEN 'unparseable' ELSE 'parsed' END AS parse_status, CASE k % 6 WHEN 1 THEN 'coordinates-out-of-range' WHEN 2 THEN 'no-placemark-geometry' WHEN 3 THEN 'network-link' WHEN 4 THEN 'not-a-zip,unreadable' ELSE '' END AS codes, CASE WHEN k % 6 IN (1, 2, 4) AND k % 6 <> 1 THEN 'unparseable' ELSE 'parsed' END AS swapped FROM (SELECT s_suppkey AS k FROM supplier) UNION ALL SELECT 'notes.txt', 'drop' || s_suppkey || '.zip', 'not a boundary file', '', '' FROM supplier WHERE s_suppkey % 6 = 5""")
def parse_status(spark, sf):
    """A drop of boundary files and archives, opened, read and judged; with the swap of positions asked for, too."""
    s = tb.spread(tb.table(spark, sf, "supplier"), "s_suppkey")
    k = F.col("s_suppkey")
    x, y = (70 + k % 20).cast("string"), (8 + k % 17).cast("string")
    at = lambda a, b: F.when(k % 6 == 1, F.concat(b, F.lit(","), a)).otherwise(F.concat(a, F.lit(","), b))
    plus = lambda c, n: (c.cast("int") + n).cast("string")
    ring = F.concat_ws(" ", at(x, y), at(plus(x, 1), y), at(plus(x, 1), plus(y, 1)))
    mark = F.when(k % 6 == 2, "").otherwise(F.concat(F.lit("<Placemark><name>p</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>")))
    kml = F.when(k % 6 == 4, "broken").otherwise(F.concat(F.lit("<kml><Document>"), F.when(k % 6 == 3, "<NetworkLink/>").otherwise(""), mark, F.lit("</Document></kml>")))
    plain = s.where(k % 6 != 5).select(F.concat(F.lit("in/s"), k, F.when(k % 6 == 4, ".kmz").otherwise(".kml")).alias("path"), kml.cast("binary").alias("content"))

    def zipped(batches):
        import io
        import zipfile

        for pdf in batches:
            made = []
            for n, content in zip(pdf["n"], pdf["content"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(f"deep/z{n}.kml", bytes(content))
                    z.writestr("notes.txt", "n")
                made.append(out.getvalue())
            yield pdf.assign(path=[f"in/drop{n}.zip" for n in pdf["n"]], content=made)[["path", "content"]]

    packed = s.where(k % 6 == 5).select(k.alias("n"), kml.cast("binary").alias("content")).mapInPandas(zipped, "path string, content binary")
    files = written(archives.expand_archives(plain.unionByName(packed)), "files")
    vertices, read = archives.scan_placemarks(files)
    read = written(read, "read")
    status = geometry.file_parse_status(read, vertices).select("file", "parse_status", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"))
    swapped = geometry.file_parse_status(read, _swap_odd(vertices)).select("file", F.col("parse_status").alias("swapped"))
    named = files.where("skip_reason is null").select(F.col("filename").alias("file"), "from_archive")
    out = named.join(status, "file").join(swapped, "file").select("file", "from_archive", "parse_status", "codes", "swapped")
    skipped = files.where("skip_reason is not null").select(F.col("filename").alias("file"), "from_archive", F.col("skip_reason").alias("parse_status"), F.lit("").alias("codes"), F.lit("").alias("swapped"))
    return out.unionByName(skipped)


def _swap_odd(vertices: DataFrame) -> DataFrame:
    """Vertices with the swap asked for in the files that are suspected of one."""
    odd = geometry.coordinate_quality(vertices).where("suspected_swap").select("file")
    return geometry.swap_positions(vertices.join(odd, "file", "left_semi")).select(*vertices.columns).unionByName(vertices.join(odd, "file", "left_anti"))


@query("""SELECT p_partkey AS k, round(p_retailprice * 0.40468564224, 6) AS hectares, round(p_retailprice * 4046.8564224, 4) AS square_metres, round(p_retailprice * 43560, 2) AS square_feet, round(p_retailprice * 40, 4) AS guntha, round(p_retailprice * 100, 4) AS cents, round(p_retailprice / 247.10538146716533, 9) AS square_kilometres, round(p_retailprice, 4) AS back,
 'a b ' || p_partkey || ' ' || p_name AS filename, CASE WHEN p_partkey % 2 = 0 THEN '.kml' ELSE '.kmz' END AS ext, '__col_' || p_partkey AS positional, p_name || '__' || (p_partkey % 4 + 2) AS suffixed, contains(' ' || p_name || ' ', ' gear ') AS has_gear FROM part""")
def unit_table(spark, sf):
    """Areas in other units and back, file names, column keys and whole phrases."""
    a = F.col("p_retailprice")
    to = {"hectares": ("hectare", 6), "square_metres": ("square_metre", 4), "square_feet": ("square_foot", 2), "guntha": ("guntha", 4), "cents": ("cent", 4), "square_kilometres": ("square_kilometre", 9)}
    k = F.col("p_partkey")
    return tb.table(spark, sf, "part").select(
        k.alias("k"), *(F.round(values.from_acres(a, u), n).alias(c) for c, (u, n) in to.items()), F.round(values.to_acres(values.from_acres(a, "hectare"), "hectare"), 4).alias("back"),
        text.safe_filename(F.concat(F.lit('a<b>: "'), k.cast("string"), F.lit('"  '), "p_name", F.lit(". . "))).alias("filename"), text.file_ext(F.concat("p_name", F.when(k % 2 == 0, ".KML").otherwise(".zip"))).alias("ext"),
        text.positional_key(k).alias("positional"), text.suffix_key("p_name", k % 4 + 2).alias("suffixed"), text.contains_phrase("p_name", F.lit("gear")).alias("has_gear"),
    )
