import datetime
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import attachments, catalogue, classes, drift, facets, geometry, measures, places, quality, rollup, sites
from landloom.plans import ingest


@pytest.fixture(scope="module")
def dim(spark):
    rows = [("state", None, s) for s in ("Maharashtra", "Chhattisgarh", "Uttar Pradesh", "Assam", "Punjab", "Goa", "Testland")]
    rows += [("district", "Maharashtra", "Raigad"), ("district", "Chhattisgarh", "Raigarh"), ("district", "Chhattisgarh", "Balrampur"), ("district", "Uttar Pradesh", "Balrampur"), ("district", "Uttar Pradesh", "Shrawasti"), ("district", "Punjab", "Ludhiana"), ("district", "Testland", "Sitapuran"), ("district", "Testland", "Sitapurar"), ("district", "Punjab", "LUDHIANA ")]
    return places.boundary_dim(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, level string, state string, name string"))


def test_resolver(spark, dim):
    assert dim.where("state = 'Punjab'").count() == 1
    sa = spark.createDataFrame([("up", "Uttar Pradesh"), ("old", "Nowhere")], "from_key string, to string")
    da = spark.createDataFrame([(0, "raigarh", "Raigad", "Maharashtra"), (1, "ludh", "Gone", None)], "ordinal int, from_key string, to string, state string")
    rec = [("1", "Maharashtra", "Raigarh"), ("2", "Chhattisgarh", "Raigarh"), ("3", "Uttar Pradesh", "Shravasti"), ("4", "Testland", "Sitapuram"), ("5", "Atlantis", "Raigad"), ("6", "UP", "Balrampur"), ("7", "Punjab", "ludh"), ("8", "old", "x"), ("9", None, "Raigad"), ("10", "Punjabb", None), ("11", "Goa", "n/a"), ("12", " punjab ", "Ludhiyana")]
    df = spark.createDataFrame(rec, "record_id string, state string, district string")
    got = {r.record_id: r for r in places.resolve_records(df, dim, sa, da).collect()}
    assert {k: (r.state_match, r.district_match, r.state_stage, r.district_stage) for k, r in got.items()} == {
        "1": ("Maharashtra", "Raigad", 1, 2), "2": ("Chhattisgarh", "Raigarh", 1, 1), "3": ("Uttar Pradesh", "Shrawasti", 1, 3), "4": ("Testland", None, 1, 4), "5": (None, None, 4, 4), "6": ("Uttar Pradesh", "Balrampur", 2, 1),
        "7": ("Punjab", None, 1, 4), "8": (None, None, 4, 4), "9": (None, None, 4, 4), "10": (None, None, 4, None), "11": ("Goa", None, 1, 4), "12": ("Punjab", "Ludhiana", 1, 3),
    }
    assert {k: got[k].reason for k in ("4", "5", "7", "8", "9", "1")} == {"4": "ambiguous", "5": "state_unmatched", "7": "broken_alias", "8": "broken_alias", "9": "no_state", "1": None}
    resolved = places.resolve_records(df, dim, sa, da)
    assert places.assert_scope(resolved, dim).count() == 0
    report = places.resolution_report(df, dim, sa, da)
    four = report.where("norm = 'sitapuram'").first()
    assert four.needs_review and [c.name for c in four.candidates][:2] == ["Sitapuran", "Sitapurar"] and four.stage == 4
    summary = places.resolution_summary(report, resolved).first()
    assert (summary.to_district, summary.to_state, summary.to_none) == (5, 3, 4)
    assert places.report_order(report).first().stage == 4
    checks = {r.check: r.problems for r in places.boundary_checks(dim, sa, da, {"state": 7, "district": 99}).collect()}
    assert checks == {"unique_keys": 0, "parents": 0, "state_alias_targets": 1, "district_alias_targets": 1, "count_state": 0, "count_district": 91}


def test_rollup_ratio_is_of_sums_and_area_is_conserved(spark):
    df = spark.createDataFrame([("a", 600.0, 3000.0), ("b", 9.0, 10.0), ("c", None, 5.0), ("d", 5.0, 0.0), ("e", 5.0, None)], "record_id string, used double, total double").withColumns({"state_match": F.lit("S"), "district_match": F.when(F.col("record_id") != "b", "D"), "site": F.lit(None).cast("string"), "area": F.col("total"), "state": F.lit("s"), "district": F.lit("d"), "reason": F.lit(None).cast("string")})
    one = rollup.record_value(["used"], "total")
    assert [r[0] for r in df.orderBy("record_id").select(one).collect()] == [20.0, pytest.approx(90.0), None, None, None]
    r = rollup.rollup(df, "state", rollup.rollup_ratio(["used"], "total").alias("value"), rollup.contributing_count(one).alias("n"), *rollup.region_counts(with_ids=True)).first()
    assert (round(r.value, 2), r.n, r.records, r.sites, r.record_ids) == (20.23, 2, 5, 5, list("abcde"))
    t = rollup.mapped_totals(df, "district").first()
    assert t.area_mapped + t.area_unmapped == t.area_total == 3015 and t.records_unmapped == 1
    assert rollup.mapped_totals(df.where("false"), "state").first().unmapped_share == 0
    assert rollup.unmapped_records(df, "district", one).first().record_id == "b"
    levels = {(x.level, x.name): x.n for x in rollup.rollup_levels(df, F.count("*").alias("n")).collect()}
    assert levels == {("state", "S"): 5, ("district", "D"): 4}
    assert rollup.page(df.orderBy("record_id"), 9, 2).first().record_id == "e"
    assert [x.record_id for x in rollup.sort_records(df, "used", True).collect()] == ["a", "b", "d", "e", "c"][:1] + [x.record_id for x in rollup.sort_records(df, "used", True).collect()][1:] and rollup.sort_records(df, "used", True).collect()[-1].record_id == "c"


def test_fill_tells_zero_from_no_data(spark):
    b = spark.createDataFrame([("state", None, n) for n in "ABCD"], "level string, state string, name string")
    r = spark.createDataFrame([("state", None, "A", 5.0), ("state", None, "B", 0.0), ("state", None, "C", None)], "level string, state string, name string, value double")
    out = rollup.region_fill(b, r, F.array(F.lit(0.0), F.lit(3.0), F.lit(6.0)))
    assert {x.name: (x.fill, x.reason, x.bin) for x in out.collect()} == {"A": ("class", None, 1), "B": ("zero", None, None), "C": ("no data", "no value", None), "D": ("no data", "no records", None)}
    assert rollup.legend_flags(out).first()[:] == (True, True, 2)


def brute_jenks(v, k):
    v = sorted(set(v))
    if len(v) <= k:
        return v[1:]
    cost = lambda x: sum((y - sum(x) / len(x)) ** 2 for y in x)
    return [v[i] for i in min(itertools.combinations(range(1, len(v)), k - 1), key=lambda c: sum(cost(v[a:b]) for a, b in zip((0, *c), (*c, len(v)), strict=True)))]


def test_classes(spark):
    rng = np.random.default_rng(1)
    for n in (3, 5, 8, 12):
        v = np.round(rng.gamma(1, 100, n), 2)
        assert classes.jenks(v, 4) == pytest.approx(brute_jenks(v.tolist(), 4))
    skew = [*range(100, 200, 5), 600, 700, 850, 3775]
    frame = lambda xs: spark.createDataFrame([("g", float(x)) for x in xs] or [], "scope string, value double").withColumn("state", F.lit("s"))
    for xs, method, k in ((skew, "jenks", 5), (skew, "equal", 5), (skew, "quantile", 5), ([0] * 8 + [5, 900], "equal", 5), ([500] * 4, "quantile", 5), ([1, 2, 3], "jenks", 5), ([1, 2, 3], "quantile", 5)):
        df = frame(xs)
        scale = classes.class_scale(df, ["scope"], method, k)
        s, bins = scale.first(), classes.bins(df, scale, ["scope"]).orderBy("bin_index").collect()
        assert sum(b["count"] for b in bins) == len(xs)
        assert len(set(xs)) == 1 or all(b.lo < b.hi for b in bins)
        if method != "equal":
            assert all(b["count"] for b in bins)
        if xs is skew and method == "jenks":
            assert bins[-1]["count"] <= 2
        if xs is skew and method == "equal":
            assert bins[0]["count"] > 0.8 * len(xs)
        if len(xs) == 3:
            assert len(bins) <= 3 and s.reduced_from == 5
        if xs == [500] * 4:
            assert len(bins) == 1
    assert classes.class_scale(frame([]), ["scope"], "equal", 5).count() == 0
    with pytest.raises(ValueError):
        classes.class_scale(frame([1]), ["scope"], "equal", 9)


def test_quality(spark):
    df = spark.createDataFrame([("1", 10.0, 20.0, 30.0), ("2", 10.0, 20.0, 31.0), ("3", None, 20.0, 30.0), ("4", 1.0, 2.0, None)], "record_id string, a double, b double, total double")
    checks = {"c": quality.check_composition(["a", "b"], "total"), "u": quality.check_utilization("a", None, "total")}
    assert [tuple(r) for r in quality.violations(df, checks).collect()] == [("2", "c", 30.0, 31.0, -1.0)]
    got = {r.invariant: (r.checked, r.skipped, r.violated, r.ran) for r in quality.validation_summary(df, checks, ["x"]).collect()}
    assert got == {"c": (2, 2, 1, True), "u": (0, 4, 0, True), "x": (0, 0, 0, False)}
    assert quality.unbound_invariants({"total", "used"}) == ["composition"] and quality.unbound_invariants({"forest"}) == ["composition", "utilization"]
    assert df.where("record_id = '3'").select(checks["c"]["reason"]).first()[0] == "null-component"


def grid(spark, *rows, book="b", sheet="s"):
    width = max(map(len, rows))
    cells = [(book, sheet, i, j, (r[j] if j < len(r) else None)) for i, r in enumerate(rows) for j in range(width)]
    return spark.createDataFrame(cells, "book string, sheet string, row_idx long, col_idx int, value string")


@pytest.mark.parametrize(("rows", "at", "fallback"), [
    ([["Land Holdings Report 2024", None, None], ["State", "District", "Area"], ["Punjab", "Ludhiana", "500"], ["Gujarat", "Kutch", "800"]], 1, False),
    ([["Section A", "Section A", "Section B"], ["State", "District", "Area"], ["Punjab", "Ludhiana", "500"]], 1, False),
    ([["Punjab", "Ludhiana", "Chawapail"]], 0, True),
    ([["a", "b"] + [None] * 8, ["1"] + ["x"] * 9], 0, True),
])
def test_headers(spark, rows, at, fallback):
    r = catalogue.detect_header(grid(spark, *rows)).first()
    assert (r.header_row, r.used_fallback) == (at, fallback)


def test_catalogue_from_cells(spark):
    head = ["State ", "Business", "Site", "Total Land Area", "Used Land", "Unused Land", "Private Sale", "State", "", "Purchase date", "Sr No", "Circle rate", None]
    body = [[s, b, f"p{i}", str(10 + i * 3), str(3 * i), "10", "-", "x", f"n{i % 3}", f"2024-01-0{i + 1}", str(i + 1), None, None] for i, (s, b) in enumerate([("Goa", "A"), ("Punjab", "B"), (None, "C"), ("Assam", "D"), ("Goa", "E"), ("Bihar", "F")])]
    cells = grid(spark, ["Report"], head, *body, [None] * 13).unionByName(grid(spark, ["x"], sheet="t"))
    sheets = catalogue.score_sheets(cells, spark.createDataFrame([("b", "s", 1), ("b", "t", 0)], "book string, sheet string, ordinal int"))
    assert {r.sheet: r.chosen for r in sheets.collect()} == {"s": True, "t": False}
    assert catalogue.score_sheets(cells, spark.createDataFrame([("b", "s", 1), ("b", "t", 0)], "book string, sheet string, ordinal int"), spark.createDataFrame([("b", "t")], "book string, sheet string")).where("chosen").first().sheet == "t"
    done = ingest.ingest(cells, spark.createDataFrame([("b", "s", 1), ("b", "t", 0)], "book string, sheet string, ordinal int"))
    keys = {r.col_idx: r.key for r in done.keys.collect()}
    assert keys[7] == "state__2" and keys[8] == "__col_8" and 12 not in keys
    assert [r.record_id for r in done.dropped.collect()] == ["row-4"] and done.records.select("record_id").distinct().count() == 5
    roles = {r.key: r.role for r in done.catalogue.collect()}
    assert roles == {"state": "dimension", "business": "dimension", "site": "dimension", "total land area": "measure", "used land": "measure", "unused land": "measure", "private sale": "meta", "state__2": "meta", "__col_8": "dimension", "purchase date": "meta", "sr no": "measure", "circle rate": "measure"}
    assert done.catalogue.where("key = 'state'").first().samples == ["Goa", "Punjab", "Assam", "Bihar"]
    assert {r.role: r.key for r in done.bindings.collect()} == {"total": "total land area", "used": "used land", "unused": "unused land", "state": "state"}
    m = measures.measure_catalogue(done.catalogue, done.bindings)
    assert {r.id for r in m.where("kind = 'derived'").collect()} == {"derived:utilisation"}
    assert measures.default_measure(m).first().default_id == "sheet:total land area"
    stats = done.stats().first()
    assert (stats.rows, stats.kept, stats.dropped) == (6, 5, 1)
    codes = {r.code: r.n for r in done.warnings().collect()}
    assert codes == {"several-sheets": 1, "unnamed-columns": 1, "empty-columns": 2, "roles-from-names": 2, "rows-dropped": 1, "no-district-column": 1, "duplicate-headers": 1, "discarded-empty-columns": 1, "unbound-invariant": 1}
    assert {r.code for r in catalogue.cautions(done.warnings()).collect()} == {"several-sheets"}
    assert catalogue.pick_word(done.catalogue, "site").first().key == "site" and catalogue.coordinate_columns(done.catalogue).count() == 0
    assert catalogue.visible_columns(done.catalogue).count() == len(roles) - 2
    over = spark.createDataFrame([("b", "s", "__col_8", "meta")], "book string, sheet string, key string, role_override string")
    again = ingest.two_pass_profile(done.records, done.keys, over)[2]
    assert again.where("key = '__col_8'").first().effective_role == "meta"


def test_serial_columns(spark):
    for xs, want in ((range(1, 51), True), (range(20), True), ([1, 2, 5, 6, 9], False), ([739, 843, 381, 1729, 80], False), ([1, 2, None], False), ([1.5, 2.5], False)):
        df = spark.createDataFrame([(0, i, None if x is None else str(x)) for i, x in enumerate(xs)], "col_idx int, row_idx long, value string")
        assert catalogue.profile_columns(df, df.agg(F.count("*").alias("n_rows")), []).first().is_serial is want


def test_facets(spark):
    rows = [("1", "A", "S1", "D1", "p", 10.0), ("2", "A", "S1", "D2", "q", 20.0), ("3", "B", "S2", "D3", "p", 30.0), ("4", "B", "S2", "D1", "r", None), ("5", "B", None, None, "t", 5.0)]
    df = spark.createDataFrame(rows, "record_id string, business string, state string, district string, site string, area double")
    sel = spark.createDataFrame([("v", "business", "A"), ("v", "state", "S2"), ("v", "district", "D2"), ("w", "district", "D1")], "view_id string, dimension string, value string")
    rng = spark.createDataFrame([("w", "area", 0.0, 15.0)], "view_id string, measure string, lo double, hi double")
    bv = facets.viewed(df, sel.select("view_id").distinct(), rng, ["area"])
    act = facets.compute_active(bv, sel).cache()
    assert {tuple(r) for r in act.collect()} == {("v", "business", "A"), ("v", "district", "D2"), ("w", "district", "D1")}
    assert {tuple(r) for r in facets.orphaned(sel, act).collect()} == {("v", "state", "S2")}
    got = facets.apply_filters(df, bv, act, sel, rng, ["area"]).select("view_id", "record_id").collect()
    assert {tuple(r) for r in got} == {("v", "2"), ("w", "1")}
    plan = facets.restore_plan(bv, sel, act)
    assert [(r.value, r.blocked_by, r["add"], r.reason) for r in plan.collect()] == [("S2", "business", ["B"], None)]
    more = facets.widen(sel, plan)
    assert ("v", "business", "B") in {tuple(r) for r in more.collect()}
    view = {(r.view_id, r.dimension, r.value): (r.available, r.n, r.selected) for r in facets.facet_view(bv, sel, act).collect()}
    assert {(r.view_id, r.active_count, r.available_count) for r in facets.facet_view(bv, sel, act).where("dimension = 'business'").collect()} == {("v", 1, 2), ("w", 0, 2)}
    assert view["v", "business", "B"] == (True, 0, False) and view["v", "state", "S2"] == (False, 0, True) and view["v", "business", "A"] == (True, 1, True)
    assert [r.record_id for r in facets.rows_matching(df, {"business": ["B"], "state": []}, {"area": (0, 40)}).orderBy("record_id").collect()] == ["3", "5"]
    bounds = facets.measure_bounds(df, ["area"])
    assert bounds.first()[:] == ("area", 5.0, 30.0)
    assert {r.view_id: r.n for r in facets.active_filter_count(sel, rng, bounds).collect()} == {"v": 3, "w": 2}
    assert facets.option_order(facets.facet_view(bv, sel, act)).count() == len(view)


@pytest.mark.parametrize("ends", [[], [3.0], [-1.5, 0.0, 0.1, 7.0, 1e300], [float(i) for i in range(37)], [float("-inf"), 2.0, float("inf")]])
def test_elementary_intervals(spark, ends):
    """A value lies in a range of two ends exactly if its interval lies between theirs."""
    values = [None, float("nan"), *ends, *(e + 0.05 for e in ends if abs(e) < 1e9), -1e9, 1e9, 0.05, float("inf"), float("-inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = {r.i: r.at for r in df.select("i", facets.interval(F.col("v"), ends).alias("at")).collect()}
    place = {e: got[2 + i] for i, e in enumerate(ends)}
    for i, v in enumerate(values):
        assert (got[i] is None) == (v is None or v != v)
        for lo in ends:
            for hi in ends:
                if got[i] is not None:
                    assert (lo <= v <= hi) == (place[lo] <= got[i] <= place[hi])


def test_cascade_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(str(i), *(rng.choice([f"{d[0]}{k}" for k in range(4)] + [None]) for d in facets.DIMENSIONS), rng.choice([None, *map(float, range(20))])) for i in range(150)]
    views = [f"v{i}" for i in range(12)]
    sel = [(v, d, rng.choice([f"{d[0]}{k}" for k in range(6)])) for v in views for d in facets.DIMENSIONS for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    rng_ = [(v, "area", *sorted((float(rng.randrange(20)), float(rng.randrange(20))))) for v in views if rng.random() < 0.6]
    want_active, want_rows = set(), set()
    for v in views:
        inside = lambda r: all(r[5] is not None and lo <= r[5] <= hi for w, _, lo, hi in rng_ if w == v)  # noqa: B023, E731
        active = {}
        for i, d in enumerate(facets.DIMENSIONS):
            scope = [r for r in rows if i == 0 or inside(r) and all(not active[e] or r[1 + j] in active[e] for j, e in enumerate(facets.DIMENSIONS[:i]))]
            active[d] = {x for w, e, x in sel if (w, e) == (v, d)} & {r[1 + i] for r in scope}
            want_active |= {(v, d, x) for x in active[d]}
        want_rows |= {(v, r[0]) for r in rows if inside(r) and all(not active[d] or r[1 + i] in active[d] for i, d in enumerate(facets.DIMENSIONS))}
    df = spark.createDataFrame(rows, "record_id string, business string, state string, district string, site string, area double")
    selections, ranges = spark.createDataFrame(sel, "view_id string, dimension string, value string"), spark.createDataFrame(rng_, "view_id string, measure string, lo double, hi double")
    asked = spark.createDataFrame([(v,) for v in views], "view_id string")
    bv = facets.viewed(df, asked, ranges, ["area"])
    act = facets.compute_active(bv, selections)
    assert {tuple(r) for r in act.collect()} == want_active
    got = facets.apply_filters(df, bv, act, asked, ranges, ["area"]).select("view_id", "record_id").collect()
    assert {tuple(r) for r in got} == want_rows and len(got) == len(want_rows)


def test_labels_that_share_a_word(spark):
    """A thousand labels begin alike: files meet only the labels that they hold whole, at word boundaries."""
    rec = spark.createDataFrame([(f"r{i}", i, "s", "d", f"Plot {i}") for i in range(1000)] + [("x", 2000, "s", "d", "a+b"), ("y", 2001, "s", "d", "(odd)"), ("z", 2002, "s", "e", "Plot 7"), ("w", 2003, "s", "e", "plot")], "record_id string, source_row_number int, state string, district string, site string")
    index = sites.site_index(rec)
    names = ["old Plot 12 map.kmz", "Plot 7.kmz", "xPlot 12.kmz", "Plot 123-4.kml", "map a+b c.kml", "n (odd) m.kmz", "x(odd)y.kmz", "plots.kmz", "-Plot 999-.kmz", ".kmz"]
    got = {r.filename: (r.site_key, r.candidates) for r in sites.match_files(spark.createDataFrame([(n,) for n in names], "filename string"), index).collect()}
    from landloom.functions import text

    labels = index.select("site_key", text.match_key("label").alias("lkey"))
    stems = spark.createDataFrame([(n,) for n in names], "filename string").withColumn("stem", text.match_key(text.filename_stem("filename")))
    pairs = stems.crossJoin(labels).select("filename", "site_key", (F.col("stem") == F.col("lkey")).alias("exact"), text.contains_phrase("stem", "lkey").alias("near")).where("lkey <> '' and (exact or near)").collect()
    for n in names:
        exact, near = ([p.site_key for p in pairs if p.filename == n and p[kind]] for kind in ("exact", "near"))
        hits = sorted(exact or near)
        assert got[n] == (hits[0] if len(hits) == 1 else None, len(hits))


def test_pools_in_blocks_rank_as_one(spark, monkeypatch):
    """Names scored against arrays of a few names each have the candidates of one pool."""
    names = [f"{a}{b}{c}" for a in ("kar", "mar", "sar") for b in ("na", "ni", "ta", "") for c in ("l", "pur", "gaon", "bad")]
    pool = spark.createDataFrame([("s1" if i % 3 else "s2", n, n.title()) for i, n in enumerate(names)], "state string, key string, name string")
    asked = spark.createDataFrame([(s, n) for s in ("s1", "s2") for n in ("karnall", "marpur", "sartagaon", "zzz")], "state string, key string")
    told = lambda: [sorted(map(tuple, places._fuzzy(asked if on else asked.select("key").distinct(), pool, on, 0.8).collect()), key=str) for on in (["state"], [])]
    whole = told()
    monkeypatch.setattr(places, "POOL", 7)
    assert told() == whole


def test_versions_of_a_store(spark, tmp_path):
    schema = "site_key string, filename string, content binary, size_bytes long, sha256 string, uploaded_at timestamp, seq long, parse_status string"
    made = lambda rows: spark.createDataFrame([(k, f, c, len(c), hashlib.sha256(c).hexdigest(), datetime.datetime(2024, 1, n + 1), n, None) for n, (k, f, c) in enumerate(rows)], schema)
    store = attachments.VersionedStore(spark, str(tmp_path / "store"), made([]).schema)
    read = lambda v=None: {(r.site_key, r.filename) for r in store.read(v).collect()}
    assert store.versions() == {} and read() == set()
    assert store.put(made([("a", "1", b"x"), ("b", "2", b"y"), ("a", "3", b"z")])) == 1 and read() == {("a", "3"), ("b", "2")}
    attachments.write_bundle(made([("a", "new", b"n"), ("c", "4", b"w")]), str(tmp_path / "bundle"))
    done = {r.site_key: r.outcome for r in store.load_bundle(str(tmp_path / "bundle")).collect()}
    assert done == {"a": "skipped", "c": "imported"} and read() == {("a", "3"), ("b", "2"), ("c", "4")} and store.read().where("parse_status = 'unparsed'").count() == 3
    assert {r.outcome for r in store.load_bundle(str(tmp_path / "bundle"), "replace").collect()} == {"replaced"} and read() == {("a", "new"), ("b", "2"), ("c", "4")}
    assert store.remove(spark.createDataFrame([("b",)], "site_key string")) == 4 and read() == {("a", "new"), ("c", "4")}
    assert store.clear() == 5 and read() == set() and read(1) == {("a", "3"), ("b", "2")}
    (tmp_path / "store" / "data" / "half").mkdir()  # a writer that died before its commit
    assert max(store.versions()) == 5
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):  # two writers of one number
        spark.range(1).write.mode("errorifexists").json(str(tmp_path / "store" / "commits" / "n=5"))


def test_files_to_sites(spark):
    rec = spark.createDataFrame([("r2", 2, "Gujarat", "Kutch", "Plot 42", None), ("r3", 3, "Gujarat", "Kutch", "Riverside", "a/Old survey.KMZ; other"), ("r4", 4, "Maharashtra", "Nagpur", "Plot 42", None), ("r5", 5, "Haryana", "Karnal", "Mardan Heri", None), ("r6", 6, "Haryana", "Karnal", None, None)], "record_id string, source_row_number int, state string, district string, site string, kmz_files string")
    index = sites.site_index(rec)
    files = spark.createDataFrame([("Plot 42.kmz",), ("Riverside.kmz",), ("Assandh, Karnal - Village Mardan Heri.kmz",), ("old SURVEY.kml",), ("none.kmz",)], "filename string")
    m = sites.match_files(files, index, rec, "kmz_files")
    got = {r.filename: (r.site_key, r.strategy, r.ambiguous) for r in m.collect()}
    assert got == {"Plot 42.kmz": (None, None, True), "Riverside.kmz": ("gujarat|kutch|riverside", "filename", False), "Assandh, Karnal - Village Mardan Heri.kmz": ("haryana|karnal|mardan heri", "filename-contains", False), "old SURVEY.kml": ("gujarat|kutch|riverside", "sheet-column", False), "none.kmz": (None, None, False)}
    assert sites.sites_without_file(index, m).count() == 2 and sites.site_collisions(index).count() == 0 and sites.unsited(rec).first().records == 1
    note = sites.hint_column_report(rec, "kmz_files").first()
    assert note.present and note.populated == 1 and note.usable
    assert not sites.hint_column_report(rec, None).first().present


def test_sites_and_regions_without_arrays(spark):
    rec = spark.createDataFrame([("r3", 3, "Goa", "North", "Plot  1"), ("r2", 2, "Goa", "North", "plot 1"), ("r4", 4, "Goa", "North", None)], "record_id string, source_row_number int, state string, district string, site string")
    index = sites.site_index(rec)
    assert not [c for c, t in index.dtypes if t.startswith("array")]
    assert [tuple(r) for r in index.collect()] == [("goa|north|plot 1", "plot 1", 2, 2)]
    assert sorted(tuple(r) for r in sites.site_members(rec).collect()) == [("goa|north|plot 1", "r2", 2), ("goa|north|plot 1", "r3", 3)]
    assert sites.site_index(rec, with_members=True).select("record_ids", "source_rows").first()[:] == (["r2", "r3"], [2, 3])
    f = spark.createDataFrame([("Goa", "North", ["a", "b"], "2024"), ("Goa", "North", ["c"], "2023"), ("Goa", "South", ["d"], "2024"), ("Goa", "East", None, "2024")], "state string, district string, polygons array<string>, vintage string")
    parts = geometry.dissolve_parts(f)
    assert not [c for c, t in parts.dtypes if t.startswith("array")]
    want = {("district", "Goa", "North"): ("2023", list("abc")), ("district", "Goa", "South"): ("2024", ["d"]), ("district", "Goa", "East"): ("2024", []), ("state", None, "Goa"): ("2023", list("abcd"))}
    assert {(r.level, r.state, r.name): (r.parts, r.vintage) for r in parts.collect()} == {k: (len(p), v) for k, (v, p) in want.items()}
    assert {(r.level, r.state, r.name): (r.vintage, sorted(r.polygons)) for r in geometry.dissolve_parts(f, with_polygons=True).collect()} == want
    assert sorted((r.level, r.name, r.polygon) for r in geometry.dissolved_polygons(f).collect()) == sorted((k[0], k[2], x) for k, (_, p) in want.items() for x in p)


def test_store(spark):
    st = spark.createDataFrame([("a", "f1", b"1", 1, 5), ("b", "f2", b"22", 2, 6)], "site_key string, filename string, content binary, size_bytes long, t long").select("*", F.timestamp_seconds("t").alias("uploaded_at"), F.col("t").alias("seq"), F.sha2("content", 256).alias("sha256"), F.lit("parsed").alias("parse_status")).drop("t")
    new = st.where("site_key = 'a'").withColumns({"filename": F.lit("f3"), "parse_status": F.lit(None).cast("string")})
    assert {r.site_key: (r.filename, r.parse_status) for r in attachments.upsert_attachments(st, new).collect()} == {"a": ("f3", "unparsed"), "b": ("f2", "parsed")}
    files, manifest, head = attachments.export_bundle(st)
    assert head.first()[:] == (2, 2, 3, True) and files.count() == 2
    out = attachments.import_bundle(manifest, files, st.where("site_key = 'a'"))
    assert {r.site_key: r.outcome for r in out.collect()} == {"a": "skipped", "b": "imported"}
    assert attachments.import_summary(attachments.import_bundle(manifest, files, st, "replace")).first()[:] == (0, 2, 0, 0)
    assert attachments.orphaned_imports(out, st.where("site_key = 'a'")).first().site_key == "b"
    assert "content" not in attachments.list_attachments(st, st.where("site_key = 'b'")).columns and attachments.storage_usage(st).first()[:] == (2, 3)
    assert attachments.remove_attachments(st, st.where("site_key = 'b'")).count() == 1
    with pytest.raises(ValueError):
        attachments.import_bundle(manifest, files, st, version=1)


def test_drift(spark):
    cat = lambda rows: spark.createDataFrame(rows, "key string, label string, role string, is_empty boolean")
    b, a = cat([("x", "X", "measure", True), ("y", "Y", "meta", False), ("z", "Z", "meta", False), ("r", "R", "meta", False)]), cat([("x", "X", "measure", False), ("y", "Y", "meta", True), ("n", "N", "meta", False), ("r", "R", "measure", True)])
    diff = drift.diff_columns(b, a)
    assert [(r.key, r.delta) for r in drift.drift_order(diff).collect()] == [("r", "role-changed"), ("z", "removed"), ("n", "added"), ("x", "became-populated"), ("y", "became-empty")]
    assert drift.drift_summary(diff).first()[:] == (1, 1, 1, 1, False) and drift.drift_summary(drift.diff_columns(b, b)).first().identical


def ring(pts, file="f", feature=0, polygon=0, ring=0):
    return [(file, feature, polygon, ring, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]


def inside(pts, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def test_geometry(spark):
    c = [(72, 18), (78, 18), (78, 20), (74, 20), (74, 22), (78, 22), (78, 24), (72, 24)]
    shapes = {"c": c, "square": [(75, 20), (76, 20), (76, 21), (75, 21), (75, 20)], "l": [(70, 10), (74, 10), (74, 11), (71, 11), (71, 15), (70, 15)], "tri": [(70, 10), (80, 10), (75, 30)]}
    rows = [r for n, p in shapes.items() for r in ring(p, n)] + ring([(70, 10), (71, 10)], "line") + ring([(90, 30), (91, 30), (91, 31), (90, 31)], "two", 0, 1) + ring([(70, 10), (74, 10), (74, 14), (70, 14)], "two")
    schema = "file string, feature int, polygon int, ring int, seq int, lng double, lat double"
    v = spark.createDataFrame(rows, schema)
    for r in geometry.representative_point(v).collect():
        if r.file in shapes:
            assert inside(shapes[r.file], r.lng, r.lat), r
    cen = {r.file: (r.lng, r.lat) for r in geometry.feature_centroid(v).collect()}
    assert cen["square"] == pytest.approx((75.5, 20.5)) and cen["line"] == pytest.approx((70.5, 10)) and cen["two"] == pytest.approx(((72 * 16 + 90.5) / 17, (12 * 16 + 30.5) / 17))
    assert not inside(c, (72 * 24 + 78 * 0) / 24 + 3.1, 21)
    box = {r.file: r[2:] for r in geometry.feature_bbox(v).collect()}
    assert box["c"] == (72.0, 18.0, 78.0, 24.0)
    swapped = geometry.swap_positions(v.where("file = 'square'")).unionByName(spark.createDataFrame(ring([(-47, -15), (-46, -15), (-46, -14)], "foreign"), schema))
    q = {r.file: (r.out_of_bounds, r.suspected_swap) for r in geometry.coordinate_quality(swapped).collect()}
    assert q == {"square": (5, True), "foreign": (3, False)}
    files = spark.createDataFrame([("square", []), ("foreign", []), ("empty", [])], "file string, warnings array<struct<code:string,message:string>>")
    status = {r.file: (r.parse_status, [w.code for w in r.warnings]) for r in geometry.file_parse_status(files, swapped).collect()}
    assert status == {"square": ("unparseable", ["coordinates-out-of-range"]), "foreign": ("unparseable", ["coordinates-out-of-range"]), "empty": ("unparseable", ["no-placemark-geometry"])}
    assert geometry.file_parse_status(files, swapped, swap=True).where("file = 'square'").first().parse_status == "parsed"
    dim = spark.createDataFrame([("state", "2024")], "level string, vintage string")
    assert geometry.boundary_manifest(dim, {"tolerance": "1100"}).first()[:] == ("state", 1, ["2024"], "1100")


def test_rows_of_a_small_file_go_to_all_tasks(spark):
    from landloom.plans import testbed

    df = testbed.spread(testbed.table(spark, "/root/testdata/sf0.001", "customer"), "c_custkey")
    assert df.count() == testbed.table(spark, "/root/testdata/sf0.001", "customer").count()
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString() and df.rdd.getNumPartitions() == 4
