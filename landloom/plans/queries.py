"""The registered queries of the regional operators and DuckDB SQL for their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import text, values
from landloom.operators import attachments, catalogue, classes, drift, facets, geometry, places, quality, rollup, sites
from landloom.operators import measures as measure_ops
from landloom.plans import extract, ingest
from landloom.plans import testbed as tb
from landloom.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SP = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{200B}-\x{200D}"


def pk(x: str) -> str:
    """A place key in SQL."""
    return rf"""lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({x}, '[{SP}]', ' ', 'g'), '[\r\n\t]+', ' ', 'g'), '&', ' and '), '[.,;:''’`"“”()\[\]{{}}\\/|!?*#_-]', '', 'g'), '\s{{2,}}', ' ', 'g')))"""


def cs(x: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace(regexp_replace({x}, '[{SP}]', ' ', 'g'), '[\r\n\t]+', ' ', 'g'), '\s{{2,}}', ' ', 'g')), '')"


TOKENS = ", ".join(f"'{t}'" for t in text.NULL_TOKENS)
USABLE = lambda k: f"coalesce({k} <> '' AND {k} NOT IN ({', '.join(repr(x) for x in text.NO_PLACES)}), false)"

DIRTY = r"""dirty AS (SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_partkey AS k, p_brand AS site, p_retailprice AS area, p_type AS true_state, p_name AS true_district,
 CASE WHEN p_partkey % 13 = 0 AND p_type = 'STANDARD' THEN 'Std' WHEN p_partkey % 13 = 1 THEN 'Nowhere' WHEN p_partkey % 13 = 2 THEN lower(p_type) || chr(160) WHEN p_partkey % 13 = 3 THEN 'N/A' WHEN p_partkey % 13 = 4 THEN 'BROKEN' WHEN p_partkey % 13 = 5 THEN p_type || right(p_type, 1) ELSE p_type END AS state,
 CASE p_partkey % 11 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '  ') || chr(160) WHEN 2 THEN p_name || right(p_name, 1) WHEN 3 THEN 'x' || substr(p_name, 2) WHEN 4 THEN NULL WHEN 5 THEN 'tbd' WHEN 6 THEN replace(p_name, 'red ', 'crimson ') ELSE p_name END AS district FROM part)"""
RESOLVED = f"""{DIRTY},
sdim AS (SELECT DISTINCT p_type AS name, {pk('p_type')} AS key FROM part),
ddim AS (SELECT DISTINCT p_type AS state, p_name AS name, {pk('p_name')} AS key FROM part),
sal(from_key, target) AS (VALUES ('std', 'STANDARD'), ('broken', 'ATLANTIS')),
dal(ord, from_key, target, astate) AS (VALUES (0, 'crimson ring', 'red ring', NULL), (1, 'crimson bolt', 'red bolt', 'SMALL'), (2, 'crimson gear', 'purple gear', NULL), (3, 'crimson ring', 'red rod', 'LARGE')),
st AS (SELECT DISTINCT state, {pk('state')} AS key FROM dirty),
sf AS (SELECT st.key, count(*) FILTER (WHERE 1 - levenshtein(st.key, sdim.key) / greatest(length(st.key), length(sdim.key)) >= 0.88) AS clear, arg_min(sdim.name, (-(1 - levenshtein(st.key, sdim.key) / greatest(length(st.key), length(sdim.key))), sdim.name)) AS best, max(1 - levenshtein(st.key, sdim.key) / greatest(length(st.key), length(sdim.key))) AS best_score FROM (SELECT DISTINCT key FROM st) st, sdim GROUP BY st.key),
sres AS (SELECT state, key, CASE WHEN NOT {USABLE('key')} THEN 4 WHEN exact IS NOT NULL THEN 1 WHEN target IS NOT NULL THEN CASE WHEN hit IS NOT NULL THEN 2 ELSE 4 END WHEN clear = 1 THEN 3 ELSE 4 END AS stage, exact, target, hit, best, best_score, clear,
  CASE WHEN NOT {USABLE('key')} THEN 'no_name' WHEN exact IS NOT NULL THEN NULL WHEN target IS NOT NULL THEN CASE WHEN hit IS NULL THEN 'broken_alias' END WHEN clear > 1 THEN 'ambiguous' WHEN coalesce(clear, 0) = 0 THEN 'below_threshold' END AS reason
  FROM (SELECT st.state, st.key, e.name AS exact, sal.target, h.name AS hit, sf.clear, sf.best, sf.best_score FROM st LEFT JOIN sdim e ON e.key = st.key LEFT JOIN sal ON sal.from_key = st.key LEFT JOIN sdim h ON h.key = {pk('sal.target')} LEFT JOIN sf ON sf.key = st.key)),
s AS (SELECT state, key, stage, reason, CASE stage WHEN 1 THEN exact WHEN 2 THEN hit WHEN 3 THEN best END AS match, CASE WHEN stage <= 2 THEN 1.0 WHEN stage = 3 THEN round(best_score, 3) ELSE 0.0 END AS confidence FROM sres),
dn AS (SELECT DISTINCT s.match AS in_state, district, {pk('district')} AS key FROM dirty JOIN s USING (state) WHERE district IS NOT NULL),
df AS (SELECT dn.in_state, dn.key, count(*) FILTER (WHERE 1 - levenshtein(dn.key, ddim.key) / greatest(length(dn.key), length(ddim.key)) >= 0.88) AS clear, arg_min(ddim.name, (-(1 - levenshtein(dn.key, ddim.key) / greatest(length(dn.key), length(ddim.key))), ddim.name)) AS best, max(1 - levenshtein(dn.key, ddim.key) / greatest(length(dn.key), length(ddim.key))) AS best_score FROM (SELECT DISTINCT in_state, key FROM dn) dn JOIN ddim ON ddim.state = dn.in_state GROUP BY ALL),
dal1 AS (SELECT dn.in_state, dn.district, arg_min(dal.target, (dal.astate IS NULL, dal.ord)) AS target FROM dn JOIN dal ON dal.from_key = dn.key AND (dal.astate IS NULL OR dal.astate = dn.in_state) GROUP BY ALL),
dres AS (SELECT x.*, CASE WHEN NOT {USABLE('key')} OR in_state IS NULL THEN 4 WHEN exact IS NOT NULL THEN 1 WHEN target IS NOT NULL THEN CASE WHEN hit IS NOT NULL THEN 2 ELSE 4 END WHEN clear = 1 THEN 3 ELSE 4 END AS stage,
  CASE WHEN NOT {USABLE('key')} THEN 'no_name' WHEN in_state IS NULL THEN 'state_unmatched' WHEN exact IS NOT NULL THEN NULL WHEN target IS NOT NULL THEN CASE WHEN hit IS NULL THEN 'broken_alias' END WHEN clear > 1 THEN 'ambiguous' WHEN coalesce(clear, 0) = 0 THEN 'below_threshold' END AS reason
  FROM (SELECT dn.in_state, dn.district, dn.key, e.name AS exact, dal1.target, h.name AS hit, df.clear, df.best, df.best_score FROM dn LEFT JOIN ddim e ON e.state = dn.in_state AND e.key = dn.key LEFT JOIN dal1 ON dal1.in_state IS NOT DISTINCT FROM dn.in_state AND dal1.district = dn.district LEFT JOIN ddim h ON h.state = dn.in_state AND h.key = {pk('dal1.target')} LEFT JOIN df ON df.in_state = dn.in_state AND df.key = dn.key) x),
d AS (SELECT in_state, district, key, stage, reason, CASE stage WHEN 1 THEN exact WHEN 2 THEN hit WHEN 3 THEN best END AS match, CASE WHEN stage <= 2 THEN 1.0 WHEN stage = 3 THEN round(best_score, 3) ELSE 0.0 END AS confidence FROM dres)"""

REC = """rec AS (SELECT 'row-' || o_orderkey AS record_id, o_orderkey AS k, c_mktsegment AS business, r_name AS state, n_name AS district, c_name AS site, o_totalprice AS area FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PLACED = f"""{REC}, placed AS (SELECT *, state AS state_match, CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL ELSE district END AS district_match, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 'Lost ' || district ELSE district END AS raw_district FROM rec)"""
MEASURED = f"""{REC}, m AS (SELECT l_orderkey AS k, sum(l_extendedprice) + CASE WHEN l_orderkey % 7 = 0 THEN 5 ELSE 0 END AS total, CASE WHEN l_orderkey % 11 <> 0 THEN coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 0) END AS sale, coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 0) AS lease, coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0) AS govt,
 CASE WHEN l_orderkey % 13 <> 0 THEN coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0) END AS used, coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 0) AS unused FROM lineitem GROUP BY l_orderkey), measured AS (SELECT rec.*, total, sale, lease, govt, used, unused FROM rec JOIN m USING (k))"""


@query(f"""WITH {DIRTY} SELECT record_id, {cs('district')} AS cleaned, CASE WHEN lower({cs('district')}) NOT IN ({TOKENS}) THEN {cs('district')} END AS cell, {pk('district')} AS place_key, {USABLE(pk('district'))} AS is_place, lower({cs("district || ' :;'")}) = '' AS _never, nullif(regexp_replace(lower({cs("' ' || state || ' (Acres) :'")}), '[\\s:;,.\\-_/|*#]+$', '', 'g'), '') AS header FROM dirty""".replace(f"lower({cs(chr(100)+'istrict || '+chr(39)+' :;'+chr(39))}) = '' AS _never, ", ""))
def clean_names(spark, sf):
    d = tb.dirty_records(spark, sf)
    return d.select("record_id", text.clean_string("district").alias("cleaned"), text.clean_cell("district").alias("cell"), text.place_key("district").alias("place_key"), text.is_place_name("district").alias("is_place"), text.header_key(F.concat(F.lit(" "), "state", F.lit(" (Acres) :"))).alias("header"))


@query("""WITH c AS (SELECT c_custkey AS k, c_acctbal AS b FROM customer) SELECT k, CASE WHEN k % 8 = 5 THEN NULL WHEN k % 8 = 6 THEN NULL WHEN k % 8 = 1 THEN -round(abs(b), 2) WHEN k % 8 IN (0, 2, 3, 4, 7) THEN round(CASE WHEN k % 8 IN (0, 2) THEN abs(b) ELSE b END, 2) END AS parsed FROM c""")
def parse_measures(spark, sf):
    b = F.col("c_acctbal")
    two = lambda c: F.format_number(c, 2)
    m = F.col("c_custkey") % 8
    raw = F.when(m == 0, F.concat(F.lit("₹ "), two(F.abs(b)))).when(m == 1, F.concat(F.lit("("), two(F.abs(b)), F.lit(")"))).when(m == 2, F.concat(two(F.abs(b)), F.lit(" Sq. Ft."))).when(m == 3, F.concat(two(b), F.lit(" %"))).when(m == 4, F.concat(F.lit(" "), two(b), F.lit(" acres"))).when(m == 5, F.concat(two(b), F.lit("d"))).when(m == 6, "TBD").otherwise(two(b))
    return tb.spread(tb.table(spark, sf, "customer"), "c_custkey").select(F.col("c_custkey").alias("k"), values.parse_measure(raw).alias("parsed"))


def _long(spark, sf, name, columns):
    t = tb.spread(tb.table(spark, sf, name), columns[0]).select(*(F.col(c).cast("string").alias(c) for c in columns), F.col(columns[0]).cast("long").alias("row_idx"))
    return t.select("row_idx", F.posexplode(F.array(*columns)).alias("col_idx", "value"))


def _profile(spark, sf):
    keys = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    long = _long(spark, sf, "customer", keys)
    rows = tb.table(spark, sf, "customer").agg(F.count("*").alias("n_rows"))
    named = F.element_at(F.array(*map(F.lit, keys)), F.col("col_idx") + 1)
    return catalogue.profile_columns(long, rows, []).withColumn("key", named)


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PROFILED = f"""WITH c AS (SELECT c_custkey AS row, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) AS key, unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS v FROM customer),
 t AS (SELECT *, CASE WHEN regexp_matches(v, '{NUMBER}') THEN 'number' WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date' WHEN v IS NOT NULL THEN 'string' END AS type, CASE WHEN regexp_matches(v, '{NUMBER}') THEN CAST(v AS DOUBLE) END AS num FROM c),
 s AS (SELECT key, string_agg(v, ',' ORDER BY first_row) AS samples FROM (SELECT key, v, min(row) AS first_row, row_number() OVER (PARTITION BY key ORDER BY min(row)) AS r FROM c WHERE v IS NOT NULL GROUP BY key, v) WHERE r <= 5 GROUP BY key),
 p AS (SELECT key, count(*) AS n_rows, count(v) AS populated, count(*) - count(v) AS null_count, count(DISTINCT coalesce(CAST(num AS VARCHAR), v)) AS distinct_count, count(num) / count(v) AS numeric_ratio, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
  count(v) = count(*) AND count(DISTINCT v) = count(v) AND count(num) = count(v) AND coalesce(bool_and(num = floor(num) AND num >= 0), false) AND max(num) - min(num) = count(v) - 1 AS is_serial FROM t GROUP BY key)"""


@query(PROFILED + " SELECT key, n_rows, populated, null_count, distinct_count, numeric_ratio, types, coalesce(is_serial, false) AS is_serial, samples FROM p JOIN s USING (key)")
def column_profile(spark, sf):
    out = _profile(spark, sf)
    return out.select("key", "n_rows", "populated", "null_count", "distinct_count", "numeric_ratio", F.array_join("types", ",").alias("types"), "is_serial", F.array_join("samples", ",").alias("samples"))


@query(PROFILED + """, r AS (SELECT *, CASE WHEN is_serial THEN 'meta' WHEN numeric_ratio > 0.8 THEN 'measure' WHEN types LIKE '%date%' THEN 'meta' WHEN types LIKE '%boolean%' AND types NOT LIKE '%string%' THEN 'meta' WHEN types LIKE '%string%' AND distinct_count > 2 THEN 'dimension' ELSE 'meta' END AS role FROM p)
 SELECT key, role, role = 'dimension' AND distinct_count / populated >= 0.4 AS high_cardinality FROM r""")
def column_roles(spark, sf):
    return catalogue.infer_role(_profile(spark, sf)).select("key", "role", "high_cardinality")


def _cells(spark, sf):
    """A book of two sheets for every 25 customers: the customers below a title and a header, and some segments alone."""
    c = tb.spread(tb.table(spark, sf, "customer"), "c_custkey")
    k = F.col("c_custkey")
    book = F.concat(F.lit("book-"), F.floor(k / 25))
    rows = c.select(book.alias("book"), (k % 25 + 2).alias("row_idx"), F.array("c_name", F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("string")).alias("v"))
    title = F.when(F.col("i") == 0, F.array(F.lit("Land report"), F.lit(None), F.lit(None))).otherwise(F.array(F.lit("State "), F.lit("District"), F.lit("Area")))
    heads = c.where(k % 25 == 0).select(book.alias("book"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i")).select("book", F.col("i").cast("long").alias("row_idx"), title.alias("v"))
    data = rows.union(heads).select("book", F.lit("data").alias("sheet"), "row_idx", F.posexplode("v").alias("col_idx", "value"))
    side = c.where(k % 25 < 5).select(book.alias("book"), F.lit("summary").alias("sheet"), (k % 25).alias("row_idx"), F.lit(0).alias("col_idx"), F.col("c_mktsegment").alias("value"))
    return data.unionByName(side)


BOOKS = f"""WITH k AS (SELECT 'book-' || (c_custkey // 25) AS book, c_custkey % 25 AS i, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer),
 cells AS (SELECT book, 'data' AS sheet, i + 2 AS row_idx, unnest([0, 1, 2]) AS col_idx, unnest([c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR)]) AS v FROM k UNION ALL SELECT book, 'data', unnest([0, 0, 0, 1, 1, 1]), unnest([0, 1, 2, 0, 1, 2]), unnest(['Land report', NULL, NULL, 'State ', 'District', 'Area']) FROM k WHERE i = 0
  UNION ALL SELECT book, 'summary', i, 0, c_mktsegment FROM k WHERE i < 5),
 typed AS (SELECT *, CASE WHEN regexp_matches(trim(v), '{NUMBER}') THEN 'number' WHEN v IS NOT NULL THEN 'string' END AS type FROM cells)"""


@query(BOOKS + """, s AS (SELECT book, sheet, count(v) AS populated, count(DISTINCT row_idx) FILTER (WHERE v IS NOT NULL) AS rows FROM cells GROUP BY ALL)
 SELECT book, sheet, populated, rows, row_number() OVER (PARTITION BY book ORDER BY populated DESC, sheet DESC) = 1 AS chosen FROM s""")
def sheet_choice(spark, sf):
    cells = _cells(spark, sf)
    ordinals = cells.select("book", "sheet").distinct().withColumn("ordinal", (F.col("sheet") == "data").cast("int"))
    return catalogue.score_sheets(cells, ordinals).select("book", "sheet", "populated", "rows", "chosen")


@query(BOOKS + """, w AS (SELECT book, sheet, max(col_idx) + 1 AS width, min(row_idx) FILTER (WHERE v IS NOT NULL) AS first_row FROM cells GROUP BY ALL), r AS (SELECT book, sheet, row_idx, count(*) FILTER (WHERE type = 'string') AS strings, count(DISTINCT type) AS types FROM typed WHERE row_idx <= 25 GROUP BY ALL),
 n AS (SELECT *, lead(row_idx) OVER o AS next_row, lead(types) OVER o AS next_types FROM r WINDOW o AS (PARTITION BY book, sheet ORDER BY row_idx)), f AS (SELECT n.book, n.sheet, min(row_idx) FILTER (WHERE row_idx < 25 AND strings / width > 0.7 AND next_row = row_idx + 1 AND next_types >= 2) AS found FROM n JOIN w USING (book, sheet) GROUP BY ALL)
 SELECT book, sheet, coalesce(found, first_row) AS header_row, found IS NULL AS used_fallback FROM w JOIN f USING (book, sheet)""")
def header_row(spark, sf):
    return catalogue.detect_header(_cells(spark, sf))


@query(BOOKS + """, d AS (SELECT book, col_idx, v, CASE WHEN type = 'number' THEN CAST(v AS DOUBLE) END AS num FROM typed WHERE sheet = 'data' AND row_idx > 1), p AS (SELECT book, col_idx, count(*) AS n, count(DISTINCT v) AS d, count(num) / count(*) AS ratio, bool_and(num = floor(num) AND num >= 0) AND max(num) - min(num) = count(*) - 1 AND count(DISTINCT num) = count(*) AS serial FROM d GROUP BY ALL),
 r AS (SELECT book, col_idx, (['state', 'district', 'area'])[col_idx + 1] AS key, CASE WHEN coalesce(serial, false) THEN 'meta' WHEN ratio > 0.8 THEN 'measure' WHEN d > 2 THEN 'dimension' ELSE 'meta' END AS role FROM p)
 SELECT book, 'data' AS sheet, col_idx, key, role, CASE WHEN role <> 'measure' AND key IN ('state', 'district') THEN key END AS bound_as FROM r""")
def column_catalogue(spark, sf):
    """From cells to keys, profile, roles and bindings of every book's chosen sheet."""
    cells = written(catalogue.rows_of(_cells(spark, sf)), "rows")
    ordinals = cells.select("book", "sheet").distinct().withColumn("ordinal", (F.col("sheet") == "data").cast("int"))
    done = ingest.ingest(cells, ordinals)
    bound = done.bindings.withColumnRenamed("role", "bound_as")
    return done.catalogue.join(bound, ["book", "sheet", "key"], "left").select("book", "sheet", "col_idx", "key", "role", "bound_as")


def _checks():
    return {"composition": quality.check_composition(["sale", "lease", "govt"], "total"), "utilization": quality.check_utilization("used", "unused", "total")}


V = f"""WITH {MEASURED}, v AS (SELECT record_id, 'composition' AS invariant, sale + lease + govt AS observed, total AS expected FROM measured UNION ALL SELECT record_id, 'utilization', used + unused, total FROM measured)"""


@query(V + " SELECT record_id, invariant, round(observed, 2) AS observed, round(expected, 2) AS expected, round(observed - expected, 2) AS delta FROM v WHERE observed IS NOT NULL AND abs(observed - expected) > greatest(0.005, 1e-9 * greatest(abs(observed), abs(expected)))")
def invariant_violations(spark, sf):
    r = lambda c: F.round(c, 2).alias(c)
    return quality.violations(tb.measured(spark, sf), _checks()).select("record_id", "invariant", r("observed"), r("expected"), r("delta"))


@query(V + " SELECT invariant, count(observed) AS checked, count(*) - count(observed) AS skipped, count(*) FILTER (WHERE observed IS NOT NULL AND abs(observed - expected) > 0.005) AS violated FROM v GROUP BY invariant")
def invariant_summary(spark, sf):
    return quality.validation_summary(tb.measured(spark, sf), _checks()).drop("ran")


@query(f"WITH {RESOLVED} SELECT state, key, stage, match, confidence, reason FROM s")
def resolve_states(spark, sf):
    return places.resolve_states(tb.dirty_records(spark, sf), tb.part_dim(spark, sf), tb.aliases(spark)[0]).drop("detail", "candidates")


def _districts(spark, sf):
    dim, (sa, da) = tb.part_dim(spark, sf), tb.aliases(spark)
    rec = tb.dirty_records(spark, sf)
    s = places.resolve_states(rec, dim, sa).select("state", F.col("match").alias("in_state"))
    return places.resolve_districts(rec.join(s, "state"), dim, da)


@query(f"WITH {RESOLVED} SELECT in_state, district, stage, match, confidence, reason FROM d")
def resolve_districts(spark, sf):
    return _districts(spark, sf).drop("key", "detail", "candidates")


@query(f"""WITH {RESOLVED}, sc AS (SELECT d.in_state, d.district, ddim.name, 1 - levenshtein(d.key, ddim.key) / greatest(length(d.key), length(ddim.key)) AS score FROM dres d JOIN ddim ON ddim.state = d.in_state WHERE {USABLE('d.key')} AND d.exact IS NULL AND d.target IS NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY in_state, district ORDER BY score DESC, name) AS n FROM sc) SELECT in_state, district, CAST(n AS INTEGER) - 1 AS pos, name, round(score, 3) AS score FROM r WHERE n <= 5""")
def fuzzy_candidates(spark, sf):
    return _districts(spark, sf).select("in_state", "district", F.posexplode("candidates").alias("pos", "c")).select("in_state", "district", "pos", "c.name", "c.score")


@query(f"""WITH {RESOLVED} SELECT dirty.record_id, s.match AS state_match, s.stage AS state_stage, d.match AS district_match, d.stage AS district_stage, greatest(s.stage, d.stage) AS stage FROM dirty JOIN s USING (state) LEFT JOIN d ON d.in_state IS NOT DISTINCT FROM s.match AND d.district = dirty.district""")
def resolve_records(spark, sf):
    out = places.resolve_records(tb.dirty_records(spark, sf), tb.part_dim(spark, sf), *tb.aliases(spark))
    return out.select("record_id", "state_match", "state_stage", "district_match", "district_stage", "stage")


@query(f"""WITH {RESOLVED}, r AS (SELECT 'state' AS level, NULL AS parent_state, coalesce(nullif(s.key, ''), s.state) AS norm, s.stage, s.match FROM dirty JOIN s USING (state) UNION ALL SELECT 'district', d.in_state, coalesce(nullif(d.key, ''), d.district), d.stage, d.match FROM dirty JOIN s USING (state) JOIN d ON d.in_state IS NOT DISTINCT FROM s.match AND d.district = dirty.district)
 SELECT level, parent_state, norm, min(stage) AS stage, min(match) AS match, count(*) AS records, min(stage) >= 3 AS needs_review FROM r GROUP BY level, parent_state, norm""")
def resolution_report(spark, sf):
    out = places.resolution_report(tb.dirty_records(spark, sf), tb.part_dim(spark, sf), *tb.aliases(spark))
    return out.select("level", "parent_state", "norm", "stage", "match", "records", "needs_review")


@query(f"WITH {PLACED} SELECT 'district' AS level, state, district_match AS name, round(sum(area), 2) AS value, count(*) AS records, count(DISTINCT site) AS sites FROM placed WHERE district_match IS NOT NULL GROUP BY ALL")
def rollup_sum(spark, sf):
    out = rollup.rollup(tb.placed(spark, sf), "district", F.round(rollup.rollup_sum("area"), 2).alias("value"), *rollup.region_counts())
    return out.drop("area")


@query(f"WITH {PLACED} SELECT 'state' AS level, CAST(NULL AS VARCHAR) AS state, state_match AS name, round(avg(area), 4) AS value, count(area) AS contributing FROM placed GROUP BY ALL")
def rollup_mean(spark, sf):
    return rollup.rollup(tb.placed(spark, sf), "state", F.round(rollup.rollup_mean("area"), 4).alias("value"), rollup.contributing_count(F.col("area")).alias("contributing"))


@query(f"WITH {MEASURED} SELECT 'district' AS level, state, district AS name, round(100 * sum(coalesce(sale, 0) + lease) / sum(total), 6) AS value, count(*) AS contributing, round(avg(100 * (coalesce(sale, 0) + lease) / total), 6) AS mean_of_ratios FROM measured WHERE total > 0 GROUP BY ALL")
def rollup_ratio(spark, sf):
    m = tb.measured(spark, sf).withColumns({"state_match": F.col("state"), "district_match": F.col("district")})
    one = rollup.record_value(["sale", "lease"], "total")
    return rollup.rollup(m, "district", F.round(rollup.rollup_ratio(["sale", "lease"], "total"), 6).alias("value"), rollup.contributing_count(one).alias("contributing"), F.round(F.avg(one), 6).alias("mean_of_ratios"))


@query(f"WITH {PLACED} SELECT 'state' AS level, NULL AS state, state_match AS name, round(sum(area), 2) AS value, count(*) AS records FROM placed GROUP BY ALL UNION ALL SELECT 'district', state_match, district_match, round(sum(area), 2), count(*) FROM placed WHERE district_match IS NOT NULL GROUP BY ALL")
def rollup_levels(spark, sf):
    return rollup.rollup_levels(tb.placed(spark, sf), F.round(F.sum("area"), 2).alias("value"), F.count("*").alias("records"))


@query(f"WITH {PLACED} SELECT record_id, state, raw_district AS district, site, area, area AS value, 'district_unmatched' AS reason FROM placed WHERE district_match IS NULL")
def unmapped(spark, sf):
    return rollup.unmapped_records(tb.placed(spark, sf), "district", F.col("area"))


@query(f"WITH {PLACED} SELECT round(sum(area) FILTER (WHERE district_match IS NOT NULL), 2) AS area_mapped, round(sum(area) FILTER (WHERE district_match IS NULL), 2) AS area_unmapped, round(sum(area), 2) AS area_total, count(*) FILTER (WHERE district_match IS NULL) AS records_unmapped, round(100 * sum(area) FILTER (WHERE district_match IS NULL) / sum(area), 6) AS unmapped_share FROM placed")
def conservation(spark, sf):
    t = rollup.mapped_totals(tb.placed(spark, sf), "district")
    return t.select(*(F.round(c, 2).alias(c) for c in ("area_mapped", "area_unmapped", "area_total")), "records_unmapped", F.round("unmapped_share", 6).alias("unmapped_share"))


def _some_regions(spark, sf):
    rec = tb.placed(spark, sf).where("district <> 'NATION_7'")
    rec = rec.withColumn("area", F.when(F.col("district") == "NATION_8", 0.0).when(F.col("district") != "NATION_9", F.col("area")))
    return rollup.rollup(rec, "district", F.sum("area").alias("value"))


@query(f"""WITH {PLACED}, f AS (SELECT state, district_match AS name, CASE district_match WHEN 'NATION_8' THEN 0.0 WHEN 'NATION_9' THEN NULL ELSE area END AS a FROM placed WHERE district_match IS NOT NULL AND district_match <> 'NATION_7'), g AS (SELECT state, name, sum(a) AS value FROM f GROUP BY ALL)
 SELECT 'district' AS level, r_name AS state, n_name AS name, round(value, 2) AS value, CASE WHEN value IS NULL THEN 'no data' WHEN value = 0 THEN 'zero' ELSE 'class' END AS fill, CASE WHEN g.name IS NULL THEN 'no records' WHEN value IS NULL THEN 'no value' END AS reason FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN g ON g.state = r_name AND g.name = n_name""")
def region_fill(spark, sf):
    dim = tb.nation_dim(spark, sf).where("level = 'district'")
    return rollup.region_fill(dim, _some_regions(spark, sf)).withColumn("value", F.round("value", 2))


def _values(spark, sf):
    p = tb.table(spark, sf, "part")
    return p.groupBy(F.col("p_type").alias("scope"), F.col("p_name").alias("name")).agg(F.round(F.sum("p_retailprice"), 2).alias("value")).withColumn("state", F.col("scope"))


VAL = "v AS (SELECT p_type AS scope, p_name AS name, round(sum(p_retailprice), 2) AS value FROM part GROUP BY ALL)"
BINS = """, e AS (SELECT scope, list_distinct(list_concat([min(value)], {b}, [max(value)])) AS raw, min(value) AS lo, max(value) AS hi FROM v GROUP BY scope), e2 AS (SELECT scope, list_sort(raw) AS edges FROM e),
 b AS (SELECT scope, edges, unnest(range(0, len(edges) - 1)) AS i FROM e2) SELECT b.scope, CAST(i AS INTEGER) AS bin_index, round(edges[i + 1], 4) AS lo, round(edges[i + 2], 4) AS hi, count(v.value) AS count FROM b LEFT JOIN v ON v.scope = b.scope AND value >= edges[i + 1] AND (value < edges[i + 2] OR i = len(edges) - 2 AND value <= edges[i + 2]) GROUP BY ALL"""


def _bins(spark, sf, method):
    v = _values(spark, sf)
    out = classes.bins(v, classes.class_scale(v, ["scope"], method, 5), ["scope"])
    return out.select("scope", "bin_index", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "count")


@query("WITH " + VAL + BINS.format(b="quantile_cont(value, [0.2, 0.4, 0.6, 0.8])"))
def quantile_classes(spark, sf):
    return _bins(spark, sf, "quantile")


@query("WITH " + VAL + BINS.format(b="[min(value) + (max(value) - min(value)) / 5 * 1, min(value) + (max(value) - min(value)) / 5 * 2, min(value) + (max(value) - min(value)) / 5 * 3, min(value) + (max(value) - min(value)) / 5 * 4]"))
def equal_classes(spark, sf):
    return _bins(spark, sf, "equal")


JENKS = """WITH """ + VAL + """, o AS (SELECT scope, value, row_number() OVER (PARTITION BY scope ORDER BY value) AS i FROM (SELECT DISTINCT scope, value FROM v)), z AS (SELECT scope, i, value, avg(value) OVER (PARTITION BY scope) AS m FROM o),
 s AS (SELECT scope, i, value, sum(value - m) OVER w AS s, sum((value - m) ** 2) OVER w AS q, count(*) OVER (PARTITION BY scope) AS n FROM z WINDOW w AS (PARTITION BY scope ORDER BY i)), c1 AS (SELECT scope, i, n, q - s * s / i AS cost, CAST([] AS DOUBLE[]) AS b FROM s),
 w AS (SELECT a.scope, a.i AS j, b.i, d.value AS start, (b.q - a.q) - (b.s - a.s) ** 2 / (b.i - a.i) AS cost FROM s a JOIN s b ON a.scope = b.scope AND a.i < b.i JOIN s d ON d.scope = a.scope AND d.i = a.i + 1),
""" + ",\n".join(f" c{k} AS (SELECT w.scope, w.i, any_value(c.n) AS n, min(c.cost + w.cost) AS cost, arg_min(list_append(c.b, w.start), c.cost + w.cost) AS b FROM c{k - 1} c JOIN w ON w.scope = c.scope AND w.j = c.i WHERE c.i >= {k - 1} GROUP BY w.scope, w.i)" for k in range(2, 6)) + """,
 g AS (SELECT scope, b FROM c5 WHERE i = n UNION ALL SELECT scope, list(value ORDER BY value) FILTER (WHERE i > 1) FROM s WHERE n <= 5 GROUP BY scope HAVING count(*) < 5)
"""


@query(JENKS + BINS.format(b="any_value(g.b)").replace("FROM v GROUP BY scope)", "FROM v JOIN g USING (scope) GROUP BY scope)", 1))
def jenks_classes(spark, sf):
    return _bins(spark, sf, "jenks")


SELECTIONS = [("a", "business", "MACHINERY"), ("a", "state", "ASIA"), ("a", "district", "NATION_2"), ("a", "district", "NATION_1"), ("b", "state", "EUROPE"), ("b", "state", "NOWHERE"), ("b", "site", "Customer#000000002"), ("c", "district", "NATION_3")]
RANGES = [("b", "area", 1000.0, 200000.0), ("c", "area", -2.0, -1.0)]
SEL = "sel(view_id, dimension, value) AS (VALUES " + ", ".join(map(str, SELECTIONS)) + "), rng(view_id, lo, hi) AS (VALUES ('b', 1000.0, 200000.0), ('c', -2.0, -1.0))"


def _views(spark, sf):
    sel = spark.createDataFrame(SELECTIONS, "view_id string, dimension string, value string")
    rng = spark.createDataFrame(RANGES, "view_id string, measure string, lo double, hi double")
    rows = tb.records(spark, sf).select("record_id", *facets.DIMENSIONS, "area")
    by_view = facets.viewed(rows, sel.select("view_id").distinct(), rng, ["area"])
    return by_view, sel, facets.compute_active(by_view, sel)


CASCADE = f"""WITH {REC}, {SEL}, bv AS (SELECT rec.*, v.view_id, coalesce(area BETWEEN rng.lo AND rng.hi, rng.lo IS NULL) AS ranged FROM rec CROSS JOIN (SELECT DISTINCT view_id FROM sel) v LEFT JOIN rng ON rng.view_id = v.view_id),
 a1 AS (SELECT DISTINCT s.* FROM sel s JOIN bv ON bv.view_id = s.view_id AND bv.business = s.value WHERE dimension = 'business'),
 b1 AS (SELECT bv.*, (NOT EXISTS (SELECT 1 FROM a1 WHERE a1.view_id = bv.view_id) OR EXISTS (SELECT 1 FROM a1 WHERE a1.view_id = bv.view_id AND a1.value = bv.business)) AS i1 FROM bv),
 a2 AS (SELECT DISTINCT s.* FROM sel s JOIN b1 ON b1.view_id = s.view_id AND b1.state = s.value AND i1 AND ranged WHERE dimension = 'state'),
 b2 AS (SELECT b1.*, (NOT EXISTS (SELECT 1 FROM a2 WHERE a2.view_id = b1.view_id) OR EXISTS (SELECT 1 FROM a2 WHERE a2.view_id = b1.view_id AND a2.value = b1.state)) AS i2 FROM b1),
 a3 AS (SELECT DISTINCT s.* FROM sel s JOIN b2 ON b2.view_id = s.view_id AND b2.district = s.value AND i1 AND i2 AND ranged WHERE dimension = 'district'),
 b3 AS (SELECT b2.*, (NOT EXISTS (SELECT 1 FROM a3 WHERE a3.view_id = b2.view_id) OR EXISTS (SELECT 1 FROM a3 WHERE a3.view_id = b2.view_id AND a3.value = b2.district)) AS i3 FROM b2),
 a4 AS (SELECT DISTINCT s.* FROM sel s JOIN b3 ON b3.view_id = s.view_id AND b3.site = s.value AND i1 AND i2 AND i3 AND ranged WHERE dimension = 'site'),
 b4 AS (SELECT b3.*, (NOT EXISTS (SELECT 1 FROM a4 WHERE a4.view_id = b3.view_id) OR EXISTS (SELECT 1 FROM a4 WHERE a4.view_id = b3.view_id AND a4.value = b3.site)) AS i4 FROM b3),
 act AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4)"""


@query(CASCADE + " SELECT view_id, dimension, value FROM act")
def facet_active(spark, sf):
    return _views(spark, sf)[2]


@query(CASCADE + " SELECT DISTINCT view_id, dimension, value FROM sel EXCEPT SELECT view_id, dimension, value FROM act")
def facet_orphans(spark, sf):
    _, sel, active = _views(spark, sf)
    return facets.orphaned(sel, active)


@query(CASCADE + " SELECT view_id, 'business' AS dimension, business AS value, count(*) FILTER (WHERE i2 AND i3 AND i4) AS n FROM b4 WHERE ranged GROUP BY ALL UNION ALL SELECT view_id, 'state', state, count(*) FILTER (WHERE i1 AND i3 AND i4) FROM b4 WHERE ranged GROUP BY ALL UNION ALL SELECT view_id, 'district', district, count(*) FILTER (WHERE i1 AND i2 AND i4) FROM b4 WHERE ranged GROUP BY ALL UNION ALL SELECT view_id, 'site', site, count(*) FILTER (WHERE i1 AND i2 AND i3) FROM b4 WHERE ranged GROUP BY ALL")
def facet_counts(spark, sf):
    by_view, _, active = _views(spark, sf)
    return facets.facet_counts(by_view, active)


@query(CASCADE + " SELECT view_id, record_id FROM b4 WHERE ranged AND i1 AND i2 AND i3 AND i4")
def facet_filtered(spark, sf):
    by_view, sel, active = _views(spark, sf)
    rows = tb.records(spark, sf).select("record_id", *facets.DIMENSIONS, "area")
    rng = spark.createDataFrame(RANGES, "view_id string, measure string, lo double, hi double")
    return facets.apply_filters(rows, by_view, active, sel, rng, ["area"]).select("view_id", "record_id")


RESTORE = CASCADE + """, orph AS (SELECT DISTINCT view_id, dimension, value FROM sel EXCEPT SELECT view_id, dimension, value FROM act),
 long AS (SELECT view_id, ranged, business, state, district, site, unnest(['business', 'state', 'district', 'site']) AS dimension, unnest([business, state, district, site]) AS value FROM bv), sup AS (SELECT o.*, l.ranged, l.business, l.state, l.district FROM orph o JOIN long l USING (view_id, dimension, value)),
 up AS (SELECT DISTINCT view_id, dimension, value, u, a FROM (SELECT view_id, dimension, value, unnest(['business', 'state', 'district']) AS u, unnest([business, state, district]) AS a FROM sup) WHERE list_position(['business', 'state', 'district', 'site'], u) < list_position(['business', 'state', 'district', 'site'], dimension)),
 blk AS (SELECT up.view_id, up.dimension, up.value, u AS blocked_by, string_agg(a, '|' ORDER BY a) AS add FROM up WHERE EXISTS (SELECT 1 FROM act WHERE act.view_id = up.view_id AND act.dimension = u) GROUP BY ALL HAVING count(*) FILTER (WHERE EXISTS (SELECT 1 FROM act WHERE act.view_id = up.view_id AND act.dimension = u AND act.value = a)) = 0)"""


@query(RESTORE + """ SELECT o.view_id, o.dimension, o.value, blk.blocked_by, blk.add, CASE WHEN blk.blocked_by IS NULL THEN CASE WHEN s.n > 0 AND s.r = 0 THEN 'range' ELSE 'no-records' END END AS reason FROM orph o LEFT JOIN (SELECT view_id, dimension, value, count(*) AS n, count(*) FILTER (WHERE ranged) AS r FROM sup GROUP BY ALL) s USING (view_id, dimension, value) LEFT JOIN blk USING (view_id, dimension, value)""")
def facet_restore(spark, sf):
    by_view, sel, active = _views(spark, sf)
    return facets.restore_plan(by_view, sel, active).withColumn("add", F.array_join("add", "|"))


@query("SELECT 'o_totalprice' AS measure, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey) FROM orders")
def measure_bounds(spark, sf):
    o = tb.table(spark, sf, "orders").select("o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return facets.measure_bounds(o.withColumn("none", F.lit(None).cast("double")), ["o_totalprice", "o_custkey", "none"])


SITES = f"""WITH {REC}, si AS (SELECT lower(state) || '|' || lower(district) || '|' || lower(site) AS site_key, site AS label, count(*) AS records, min(k) AS first_row FROM rec GROUP BY ALL)"""


@query(SITES + " SELECT site_key, label, records, first_row FROM si")
def site_index(spark, sf):
    return sites.site_index(tb.records(spark, sf)).select("site_key", "label", "records", "first_row")


@query(SITES + " SELECT site_key, records FROM si WHERE records > 1")
def site_collisions(spark, sf):
    return sites.site_collisions(sites.site_index(tb.records(spark, sf))).select("site_key", "records")


def _suppliers(spark, sf):
    s, n = tb.table(spark, sf, "supplier"), tb.table(spark, sf, "nation")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    k = F.col("s_suppkey")
    return j.select(F.concat(F.lit("row-"), k).alias("record_id"), k.alias("source_row_number"), F.lit("st").alias("state"), F.col("n_name").alias("district"), F.when(k % 10 == 9, F.lit("Shared Plot")).otherwise(F.concat(F.lit("Plot "), F.hex(F.crc32(F.col("s_name").cast("binary"))))).alias("site"), F.when(k % 10 == 5, F.concat(F.lit("survey "), k.cast("string"), F.lit(".kmz; other.kml"))).alias("kmz_files"))


SUP = """sup AS (SELECT s_suppkey AS k, 'st' AS state, n_name AS district, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("""WITH s AS (SELECT s_suppkey AS k, 'st|' || lower(n_name) AS place, CASE WHEN s_suppkey % 10 = 9 THEN 'Shared Plot' ELSE 'Plot ' || replace(s_name, '#', ' ') END AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey), i AS (SELECT place || '|' || lower(replace(site, '#', ' ')) AS site_key, lower(replace(site, '#', ' ')) AS lkey, min(k) AS k FROM s GROUP BY ALL),
 f AS (SELECT DISTINCT CASE WHEN k % 10 = 5 THEN 'drop/Survey ' || k || '.KMZ' WHEN k % 2 = 0 THEN replace(site, '#', ' ') || '.kmz' WHEN k % 3 = 0 THEN 'Village - ' || replace(site, '#', ' ') || ' final.kml' ELSE 'noise' || k || '.kmz' END AS filename FROM s), g AS (SELECT filename, lower(regexp_replace(regexp_replace(filename, '^.*/', ''), '(?i)\\.(kmz|kml)$', '')) AS stem FROM f),
 h AS (SELECT filename, 1 AS tier, site_key FROM g JOIN i ON stem = lkey UNION SELECT filename, 2, site_key FROM g JOIN i ON contains(' ' || stem || ' ', ' ' || lkey || ' ') UNION SELECT filename, 3, i.site_key FROM g JOIN s ON s.k % 10 = 5 AND (stem = 'survey ' || s.k OR stem = 'other') JOIN i ON i.site_key = place || '|' || lower(replace(site, '#', ' '))),
 m AS (SELECT filename, min(tier) AS tier FROM h GROUP BY ALL), n AS (SELECT h.filename, h.tier, count(DISTINCT site_key) AS n, min(site_key) AS one FROM h JOIN m USING (filename, tier) GROUP BY ALL)
 SELECT filename, CASE WHEN n = 1 THEN one END AS site_key, CASE WHEN n = 1 THEN (['filename', 'filename-contains', 'sheet-column'])[tier] END AS strategy, coalesce(n, 0) AS candidates, coalesce(n > 1, false) AS ambiguous FROM g LEFT JOIN n USING (filename)""")
def match_files(spark, sf):
    name = F.concat(F.lit("Plot "), F.replace("s_name", F.lit("#"), F.lit(" ")))
    rec = _suppliers(spark, sf).drop("site").join(tb.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_row_number"), F.when(F.col("s_suppkey") % 10 == 9, "Shared Plot").otherwise(name).alias("site")), "source_row_number")
    k, plot = F.col("source_row_number"), F.col("site")
    name = F.when(k % 10 == 5, F.concat(F.lit("drop/Survey "), k.cast("string"), F.lit(".KMZ"))).when(k % 2 == 0, F.concat(plot, F.lit(".kmz"))).when(k % 3 == 0, F.concat(F.lit("Village - "), plot, F.lit(" final.kml"))).otherwise(F.concat(F.lit("noise"), k.cast("string"), F.lit(".kmz")))
    return sites.match_files(rec.select(name.alias("filename")), sites.site_index(rec), rec, "kmz_files").drop("label")


@query(f"""WITH {SUP}, f AS (SELECT k, 'a' || k || '.kmz' AS filename FROM sup WHERE k % 4 <> 1) SELECT f.filename, 'st|' || lower(district) || '|a' || sup.k AS site_key, 'filename' AS strategy FROM f JOIN sup USING (k) UNION ALL SELECT 'zz' || k || '.kmz', NULL, NULL FROM sup WHERE k % 4 = 1""")
def match_files_exact(spark, sf):
    rec = _suppliers(spark, sf).withColumn("site", F.concat(F.lit("A"), "source_row_number"))
    k = F.col("source_row_number")
    files = rec.select(F.concat(F.when(k % 4 != 1, "a").otherwise("zz"), k, F.lit(".kmz")).alias("filename"))
    return sites.match_files(files, sites.site_index(rec)).select("filename", "site_key", "strategy")


def _store(spark, sf):
    p = tb.table(spark, sf, "pages")
    k = F.col("page_id")
    return p.select(F.concat(F.lit("site-"), k).alias("site_key"), F.concat(F.lit("f"), k, F.lit(".kmz")).alias("filename"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size_bytes"), text.content_hash(F.coalesce("html", F.lit(""))).alias("sha256"), F.timestamp_seconds(k).alias("uploaded_at"), k.alias("seq"), F.when(k % 5 == 0, "unparseable").otherwise("parsed").alias("parse_status"), F.when(k % 5 != 0, F.struct(F.lit(20.0).alias("lat"), F.lit(75.0).alias("lng"))).alias("point"))


@query("SELECT count(*) * 2 AS sites, count(*) AS with_file, count(*) FILTER (WHERE page_id % 5 = 0) AS unreadable, count(*) FILTER (WHERE page_id % 5 <> 0) AS plottable, 50.0 AS percent FROM pages")
def site_coverage(spark, sf):
    st = _store(spark, sf)
    index = st.select("site_key").union(st.select(F.concat(F.lit("bare-"), "site_key")))
    return sites.site_coverage(index, st)


@query("""SELECT 'site-' || page_id AS site_key, sha256(coalesce(html, '')) AS sha256, CASE WHEN page_id % 7 = 0 THEN 'missing-file' WHEN page_id % 7 = 1 THEN 'checksum-mismatch' WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'imported' END AS outcome FROM pages""")
def bundle_import(spark, sf):
    st = _store(spark, sf)
    k = F.col("seq")
    manifest = st.withColumn("path", F.concat(F.lit("files/"), "site_key")).select("site_key", "path", "filename", "size_bytes", "sha256", "seq")
    files = st.where(k % 7 != 0).select(F.concat(F.lit("files/"), "site_key").alias("path"), F.when(k % 7 == 1, F.lit(b"other")).otherwise(F.col("content")).alias("content"))
    return attachments.import_bundle(manifest, files, st.where(k % 3 == 0)).select("site_key", "sha256", "outcome")


@query("""SELECT 'site-' || page_id AS site_key, CASE WHEN page_id % 4 = 0 THEN 'new.kmz' ELSE 'f' || page_id || '.kmz' END AS filename FROM pages""")
def attachment_upsert(spark, sf):
    st = _store(spark, sf)
    later = st.where("seq % 4 = 0").withColumn("filename", F.lit("new.kmz")).withColumn("uploaded_at", F.timestamp_seconds(F.col("seq") + 10))
    older = st.where("seq % 4 = 1").withColumn("filename", F.lit("old.kmz")).withColumn("uploaded_at", F.timestamp_seconds(F.col("seq") - 10))
    return attachments.upsert_attachments(st, later.union(older)).select("site_key", "filename")


@query("SELECT * FROM (VALUES ('c_custkey', 'unchanged'), ('c_name', 'role-changed'), ('c_nationkey', 'removed'), ('c_mktsegment', 'became-empty'), ('c_segment', 'added')) t(key, delta) WHERE (SELECT count(*) FROM customer) > 0")
def column_drift(spark, sf):
    cat = catalogue.infer_role(_profile(spark, sf)).select("key", F.col("key").alias("label"), "role", "is_empty")
    k = F.col("key")
    after = cat.where("key <> 'c_nationkey'").withColumn("role", F.when(k == "c_name", "meta").otherwise(F.col("role"))).withColumn("is_empty", F.col("is_empty") | (k == "c_mktsegment"))
    added = cat.where("key = 'c_name'").select(F.lit("c_segment").alias("key"), F.lit("Segment").alias("label"), "role", "is_empty")
    return drift.diff_columns(cat, after.union(added)).select("key", "delta")


@query(f"WITH {PLACED}, g AS (SELECT state_match AS state, district_match AS name, sum(area) AS v FROM placed WHERE district_match IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM g ORDER BY v DESC, state, name LIMIT 15) SELECT state, name, round(v, 2) AS value, round(v / max(v) OVER (), 6) AS share FROM t")
def top_regions(spark, sf):
    r = rollup.rollup(tb.placed(spark, sf), "district", F.sum("area").alias("value"))
    return rollup.top_regions(r).select("state", "name", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"))


def _polygons(spark, sf):
    """An L-shaped polygon an order, moved and sized by its key."""
    o = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    x, y, s = 70 + F.col("k") % 20, 8 + F.col("k") % 17, 1 + F.col("k") % 3
    pts = F.array(*(F.struct((x + s * a).cast("double").alias("lng"), (y + s * b).cast("double").alias("lat")) for a, b in ((0, 0), (2, 0), (2, 1), (1, 1), (1, 3), (0, 3))))
    feature = F.coalesce(F.col("k") % 1, F.lit(0)).cast("int")  # a literal would be dropped from windows' keys, and vertices be dealt a second time
    return o.select(F.col("k").cast("string").alias("file"), feature.alias("feature"), F.lit(0).alias("polygon"), F.lit(0).alias("ring"), F.posexplode(pts).alias("seq", "p")).select("file", "feature", "polygon", "ring", "seq", "p.lng", "p.lat")


POLY = "p AS (SELECT CAST(o_orderkey AS VARCHAR) AS file, 70 + o_orderkey % 20 AS x, 8 + o_orderkey % 17 AS y, 1 + o_orderkey % 3 AS s FROM orders)"


@query(f"WITH {POLY} SELECT file, CAST(0 AS INTEGER) AS feature, CAST(x AS DOUBLE) AS west, CAST(y AS DOUBLE) AS south, CAST(x + 2 * s AS DOUBLE) AS east, CAST(y + 3 * s AS DOUBLE) AS north FROM p")
def feature_bbox(spark, sf):
    return geometry.feature_bbox(_polygons(spark, sf))


@query(f"WITH {POLY} SELECT file, CAST(0 AS INTEGER) AS feature, round(x + 0.75 * s, 6) AS lng, round(y + 1.25 * s, 6) AS lat FROM p")
def ring_centroid(spark, sf):
    return geometry.feature_centroid(_polygons(spark, sf)).select("file", "feature", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query(f"WITH {POLY} SELECT file, round(x + 0.5 * s, 6) AS lng, round(y + 2.0 * s, 6) AS lat FROM p")
def interior_point(spark, sf):
    return geometry.representative_point(_polygons(spark, sf)).select("file", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query(f"WITH {POLY} SELECT file, 6 AS positions, CASE WHEN CAST(file AS BIGINT) % 2 = 1 THEN 6 ELSE 0 END AS out_of_bounds, CAST(file AS BIGINT) % 2 = 1 AS suspected_swap FROM p")
def coordinate_quality(spark, sf):
    v = _polygons(spark, sf)
    odd = F.col("file").cast("long") % 2 == 1
    v = v.withColumns({"lng": F.when(odd, F.col("lat")).otherwise(F.col("lng")), "lat": F.when(odd, F.col("lng")).otherwise(F.col("lat"))})
    return geometry.coordinate_quality(v)


@query("SELECT p_type AS state, p_name AS district, count(*) AS parts FROM part GROUP BY ALL UNION ALL SELECT NULL, p_type, count(*) FROM part GROUP BY ALL")
def dissolved(spark, sf):
    f = tb.table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name").alias("district"), F.col("p_type").alias("state"), F.array(F.concat(F.lit("poly"), "p_partkey")).alias("polygons"))
    f = f.union(f.where("length(district) > 9").withColumn("district", F.lit(" ")))
    return geometry.dissolve_parts(geometry.filter_raw_boundaries(f, "2024")).select("state", F.col("name").alias("district"), "parts")


@query(f"WITH {PLACED}, f AS (SELECT * FROM placed WHERE business = 'MACHINERY') SELECT CAST(i - 1 AS INTEGER) AS ordinal, label, value FROM (SELECT unnest(range(1, 16)) AS i, unnest(['Source', 'business', 'state', 'area', 'Measure', 'Formula', 'Aggregation', 'Rows before filters', 'Rows in extract', 'Unmapped rows', 'Dropped rows', 'Violations', 'Fuzzy names', 'Unresolved names', 'Vintage']) AS label, unnest(['orders', 'MACHINERY', '(all)', '0 to 1000000', 'area', 'area', 'sum', (SELECT CAST(count(*) AS VARCHAR) FROM placed), (SELECT CAST(count(*) AS VARCHAR) FROM f), (SELECT CAST(count(*) AS VARCHAR) FROM f WHERE district_match IS NULL), '0', '0', '0', '0', '2024']) AS value)")
def extract_provenance(spark, sf):
    rec = tb.placed(spark, sf).withColumn("stage", F.lit(1))
    out = extract.provenance(rec, rec.where("business = 'MACHINERY'"), "district", "orders", "area", "area", "sum", {"business": ["MACHINERY"], "state": []}, {"area": (0, 1000000)}, 0, "2024", 0)
    out = out.where("label <> 'Unmapped area'")
    return out.select(F.when(F.col("ordinal") > 9, F.col("ordinal") - 1).otherwise(F.col("ordinal")).alias("ordinal"), "label", "value")


@query("SELECT k AS key, CASE WHEN k LIKE '%rate%' OR k LIKE '%percent%' OR k LIKE '%(\\%)' ESCAPE '\\' THEN 'mean' ELSE 'sum' END AS aggregation, CASE WHEN k LIKE '%percent%' OR k LIKE '%(\\%)' ESCAPE '\\' THEN 'percent' WHEN k LIKE '%rate%' OR k LIKE '%price%' THEN 'currency-inr' WHEN k LIKE '%area%' THEN 'acre' ELSE 'number' END AS unit FROM (SELECT lower(p_name) || CASE p_partkey % 5 WHEN 0 THEN ' rate' WHEN 1 THEN ' area' WHEN 2 THEN ' (%)' WHEN 3 THEN ' price' ELSE ' count' END AS k FROM part)")
def measure_kinds(spark, sf):
    m = F.col("p_partkey") % 5
    k = F.concat(F.lower("p_name"), F.when(m == 0, " rate").when(m == 1, " area").when(m == 2, " (%)").when(m == 3, " price").otherwise(" count"))
    return tb.table(spark, sf, "part").select(k.alias("key")).select("key", measure_ops.infer_aggregation(F.col("key")).alias("aggregation"), measure_ops.infer_unit(F.col("key")).alias("unit"))


@query(f"WITH {PLACED} SELECT level, state, name, round(value, 2) AS value, records, sites, round(area, 2) AS area, round(u, 2) AS area_unmapped, round(100 * u / t, 6) AS unmapped_share, true AS conserved FROM (SELECT 'state' AS level, NULL AS state, state_match AS name, sum(area) AS value, count(*) AS records, count(DISTINCT site) AS sites, sum(area) AS area FROM placed GROUP BY state_match UNION ALL SELECT 'district', state_match, district_match, sum(area), count(*), count(DISTINCT site), sum(area) FROM placed WHERE district_match IS NOT NULL GROUP BY state_match, district_match), (SELECT sum(area) FILTER (WHERE district_match IS NULL) AS u, sum(area) AS t FROM placed)")
def flagship(spark, sf):
    out = tb.flagship(spark, sf)
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("level", "state", "name", r("value", 2), "records", "sites", r("area", 2), r("area_unmapped", 2), r("unmapped_share", 6), "conserved")
