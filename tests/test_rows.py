"""Ingest over rows of cells, files landed by tasks, and figures of rings from one dealing."""

import os
import re

from landloom.operators import catalogue, geometry
from landloom.plans import ingest
from landloom.sources import grids
from landloom.sources.tables import land_files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def book(name, lost):
    body = [["Goa" if i != lost else None, f"D{i}", str(i * 2)] for i in range(4)]
    rows = [["State", "District", "Total Area"], *body]
    return [(name, "s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]


def ingested(spark, as_rows=False):
    cells = spark.createDataFrame(book("whole", None) + book("lossy", 2), "book string, sheet string, row_idx long, col_idx int, value string")
    ordinals = spark.createDataFrame([("whole", "s", 0), ("lossy", "s", 0)], "book string, sheet string, ordinal int")
    return ingest.ingest(catalogue.rows_of(cells) if as_rows else cells, ordinals)


def test_only_sheets_that_lost_rows_are_profiled_again(spark, monkeypatch):
    seen, write = {}, ingest.written
    monkeypatch.setattr(ingest, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    done = ingested(spark)
    assert {r.book for r in seen["again"].select("book").collect()} == {"lossy"}
    assert {r.book: r.populated for r in done.catalogue.where("col_idx = 1").collect()} == {"whole": 4, "lossy": 3}
    assert [(r.book, r.record_id, r.raw) for r in done.dropped.collect()] == [("lossy", "row-3", {"district": "D2", "total area": "4"})]


def test_rows_and_long_cells_give_the_same_and_roles_need_no_shuffle_of_cells(spark):
    told = lambda d: sorted(map(tuple, d.roles().select("book", "record_id", "state", "district", "total", "bound").collect()), key=str)
    a, b = ingested(spark), ingested(spark, as_rows=True)
    assert told(a) == told(b) and len(told(a)) == 7
    long = ingest.role_records(a.records, a.catalogue, a.bindings).select("book", "record_id", "state", "district", "total", "bound")
    assert sorted(map(tuple, long.collect()), key=str) == told(a)
    assert not re.search(r"hashpartitioning\([^)]*record_id", plan_of(a.roles()))


def test_files_are_landed_whole(spark, tmp_path):
    texts = {"book=a": 'State,Area\n"x\ny",1\n', "book=b c": "State\n", "book=é": "ü,2"}
    df = spark.createDataFrame(list(texts.items()), "folder string, content string")
    land_files(df, str(tmp_path / "in"), "txt")
    land_files(df, f"file://{tmp_path}/in", "txt")  # as a task that runs again
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "in"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(tmp_path / "in") for f in fs}
    assert found == {f"{k}/part-0.txt": v for k, v in texts.items()}
    rows = grids.scan_rows(spark, str(tmp_path / "in"), folders=True).collect()
    assert {(r.book, r.row_idx): [tuple(c) for c in r.cells] for r in rows} == {
        ("a", 0): [(0, "State"), (1, "Area")], ("a", 1): [(0, "x\ny"), (1, "1")], ("b c", 0): [(0, "State")], ("é", 0): [(0, "ü"), (1, "2")],
    }


def test_centroid_deals_vertices_once(spark):
    """An outer ring with a hole, a feature without area, and a file of two polygons; one shuffle by the keys and no join."""
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = [("a", 0, 0, 0, square(0, 0, 4)), ("a", 0, 0, 1, square(1, 1, 1)), ("b", 0, 0, 0, [(1, 1), (3, 5)]), ("c", 1, 0, 0, square(0, 0, 2)), ("c", 1, 1, 0, square(10, 0, 4))]
    rows = [(*r[:4], i, float(x), float(y)) for r in rings for i, (x, y) in enumerate(r[4])]
    v = spark.createDataFrame(rows, "file string, feature int, polygon int, ring int, seq int, lng double, lat double")
    got = geometry.feature_centroid(v)
    assert {r.file: (r.lng, r.lat) for r in got.collect()} == {"a": (2.0, 2.0), "b": (2.0, 3.0), "c": ((4 * 1 + 16 * 12) / 20, (4 * 1 + 16 * 2) / 20)}
    got = plan_of(geometry.feature_centroid(v))
    assert "Join" not in got and got.count("Exchange") == 1


def test_pages_are_dealt_to_all_tasks_before_they_are_cleaned(spark, monkeypatch):
    from landloom.plans import reports

    dealt, profile = [], catalogue.profile_columns
    monkeypatch.setattr(catalogue, "profile_columns", lambda long, *a: dealt.append(long.rdd.getNumPartitions()) or profile(long, *a))
    assert reports.drift_summary(spark, "/root/testdata/sf0.001").count() == 5
    assert dealt == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
