import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from landloom.operators import catalogue, geometry
from landloom.plans import extract
from landloom.sources import archives, boundaries, grids
from landloom.streaming import stateless

KML = "<kml><Document>{}</Document></kml>"
SQUARE = "<Placemark><name>sq</name><Polygon><outerBoundaryIs><LinearRing><coordinates>75,20,0 76,20 76,21 75,21</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
FOREIGN = SQUARE.replace("75,", "-47,").replace("76,", "-46,")


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), content)
    return out.getvalue()


def test_archives_and_placemarks(spark, tmp_path):
    files = {
        "square.kml": KML.format(SQUARE).encode(), "decoy.kmz": zipped(files__doc_dot_kml=KML.format(FOREIGN), parcels_dot_KML=KML.format(SQUARE)), "empty.kml": KML.format("").encode(), "corrupt.kmz": b"broken",
        "link.kml": KML.format("<NetworkLink/>" + SQUARE).encode(), "two.kmz": zipped(a_dot_kml=KML.format(SQUARE), b_dot_kml=KML.format(FOREIGN)), "none.kmz": zipped(x_dot_txt="x"),
    }
    inner = zipped(deep__square_dot_kml=files["square.kml"], notes_dot_txt="n")
    for name, content in {**files, "batch.zip": zipped(nested__inner_dot_zip=inner, readme_dot_txt="r"), "broken.zip": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    out = archives.expand_archives(archives.landed(spark, str(tmp_path))).cache()
    got = {(r.filename, r.from_archive): r.skip_reason for r in out.collect()}
    deep = files["square.kml"]
    for i in range(40):
        deep = zipped(**{(f"{i}_dot_zip" if i else "deep_dot_kml"): deep})
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "deep.zip").write_bytes(deep)
    assert [(r.filename, r.skip_reason) for r in archives.expand_archives(archives.landed(spark, str(tmp_path / "deep"))).collect()] == [("deep.kml", None)]
    assert got["square.kml", "inner.zip"] is None and got["notes.txt", "inner.zip"] == got["readme.txt", "batch.zip"] == "not a boundary file" and got["broken.zip", None] == "unreadable archive"
    vertices, read = archives.scan_placemarks(out.where("from_archive is null"))
    codes = {r.file: [w.code for w in r.warnings] for r in read.collect()}
    assert codes == {"square.kml": [], "decoy.kmz": [], "empty.kml": [], "corrupt.kmz": ["not-a-zip", "unreadable"], "link.kml": ["network-link"], "two.kmz": ["multiple-kml-entries"], "none.kmz": ["no-kml-entry"]}
    status = {r.file: r.parse_status for r in geometry.file_parse_status(read, vertices).collect()}
    assert status == {"square.kml": "parsed", "decoy.kmz": "parsed", "empty.kml": "unparseable", "corrupt.kmz": "unparseable", "link.kml": "parsed", "two.kmz": "parsed", "none.kmz": "unparseable"}
    assert {(r.lng, r.lat) for r in vertices.where("file = 'decoy.kmz'").collect()} == {(75.0, 20.0), (76.0, 20.0), (76.0, 21.0), (75.0, 21.0)}


def test_documents_are_read_by_events():
    """Many placemarks and vertices in bounded memory, with the rows of a whole tree; a document that breaks off has none."""
    import tracemalloc

    ring = " ".join(f"{70 + i / 1e4},{8 + i / 1e4}" for i in range(200))
    mark = f"<Folder><Placemark><name>p</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>3,4 5,6 x,7</coordinates></LinearRing></innerBoundaryIs></Polygon></MultiGeometry></Placemark></Folder>"
    document = KML.format(mark * 4000).encode()
    tracemalloc.start()
    n = sum(1 for _ in archives._rows("a.kml", document))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 * 203 and peak < 3 * len(document)
    first = list(archives._rows("a.kml", KML.format(mark * 2).encode()))
    assert {(r[1], r[3], r[4], r[5]) for r in first} == {(f, *k) for f in (0, 1) for k in (("Point", 0, 0), ("Polygon", 1, 0), ("Polygon", 1, 1))}
    assert [r[9] for r in archives._rows("a.kml", document[:-20])] == ["unreadable"]
    broken = zipped(a_dot_kml="x" * 100, b_dot_kml="y")
    at = broken.index(b"x" * 100)
    assert [r[3] for r in archives._flatten("in/z.zip", broken[:at] + b"?" + broken[at + 1 :])] == ["unreadable archive"]


def test_boundaries_and_aliases(spark, tmp_path):
    feature = lambda n, s, kind, c: {"properties": {"name": n, "state": s, "level": "district", "vintage": "v1", "centroid": [1, 2], "bbox": [0, 0, 1, 1]}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("A", "S", "Polygon", [[[0, 0], [1, 0], [1, 1]]]), feature("B", "S", "MultiPolygon", [[[[0, 0], [1, 0], [1, 1]]]])]}))
    rows = boundaries.scan_boundaries(spark, str(tmp_path / "b.json")).collect()
    assert [(r.ordinal, r.name, r.geometry_type) for r in rows] == [(0, "A", "Polygon"), (1, "B", "MultiPolygon")] and json.loads(rows[1].coordinates)[0][0][1] == [1, 0]
    (tmp_path / "bad.json").write_text('{"type": "x"}')
    with pytest.raises(Exception, match="features must be a list"):
        boundaries.scan_boundaries(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "a.json").write_text(json.dumps({"states": {"Orissa & ": " Odisha ", "--": "x"}, "districts": [{"from": "Raigarh", "to": "Raigad", "state": "Maharashtra"}, {"from": "x", "to": ""}]}))
    s, d, bad = boundaries.scan_aliases(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in s.collect()] == [("orissa and", "Odisha", 0)] and [tuple(r)[:4] for r in d.collect()] == [(0, "raigarh", "Raigad", "Maharashtra")]
    assert {tuple(r) for r in bad.collect()} == {("state", 1, "no-from"), ("district", 1, "no-to")}
    assert all(x.count() == 0 for p in (None, str(tmp_path / "absent.json")) for x in boundaries.scan_aliases(spark, p))


def test_grids(spark, tmp_path):
    (tmp_path / "book1").mkdir()
    (tmp_path / "book1" / "data.csv").write_text("Report\n,,\nState,District,Area\nPunjab,Ludhiana,500\n")
    cells = grids.scan_grids(spark, str(tmp_path / "book1"))
    got = {(r.row_idx, r.col_idx): r.value for r in cells.where("book = 'book1' and sheet = 'data'").collect()}
    assert got[0, 0] == "Report" and got[3, 2] == "500" and got[2, 0] == "State" and got[1, 0] is None
    assert catalogue.detect_header(cells).first().header_row == 2
    assert grids.scan_grids(spark, str(tmp_path / "book1")).where("value is not null").count() == 7
    for name, content in {"a.xlsx": b"PK\x03\x04rest", "b.xlsx": b"nope", "c.txt": b"PK\x03\x04"}.items():
        (tmp_path / name).write_bytes(content)
    codes = {r.path.rsplit("/", 1)[1]: r.error_code for r in grids.triage_files(spark, str(tmp_path)).collect()}
    assert codes == {"a.xlsx": None, "b.xlsx": "not-an-archive", "c.txt": "wrong-extension", "data.csv": "wrong-extension"}
    none = cells.where("false")
    books = spark.createDataFrame([("book1",), ("book2",)], "book string")
    sheets = catalogue.score_sheets(cells, cells.select("book", "sheet").distinct().withColumn("ordinal", F.lit(0)))
    out = {r.book: r.error_code for r in grids.intake_status(books, sheets, cells, none).collect()}
    assert out == {"book1": "no-rows", "book2": "no-populated-sheet"}
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "w.csv").write_text('a,"b,\nc",,\n1,2,3,,5\n')
    assert {(r.row_idx, r.col_idx, r.value) for r in grids.scan_grids(spark, str(tmp_path / "wide")).where("value is not null").collect()} == {(0, 0, "a"), (0, 1, "b,\nc"), (1, 0, "1"), (1, 1, "2"), (1, 2, "3"), (1, 4, "5")}


GRIDS = {
    "narrow": "Report of land\nState,District,Area\nX,Y,10\nX,Z,20\n",
    "wide": "t,,,,,,,,,,,\n\nState,District,Site,Total Area,e,f,g,h,i,j,k,l\nX,Y,s1,5,1,2,3,4,5,6,7,8\nX,Z,s2,6,1,2,3,4,5,6,7,9\n",
    "breaks": 'State,District,Note,Area\nX,"a ""b""\n\nc,\nd",5" pipe,7\nY,"",,8\n"Z","q"tail,"open, and\nnever closed\n',
    "plain": "\ufeffa,b\r\n1,\r\n\r\n,2\r\n",
}


def by_hand(text):
    """Records of a grid, a character at a time."""
    rows, cells, cell, open_, quoted, k = [], [], "", False, False, 0
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").removesuffix("\n")
    while k < len(text):
        c = text[k]
        if open_:
            if c == '"' and text[k + 1 : k + 2] == '"':
                cell, k = cell + '"', k + 1
            elif c == '"':
                open_ = False
                if text[k + 1 : k + 2] not in ("", ",", "\n"):  # text behind the quote: the cell stands as it is
                    cell, quoted = '"' + cell + '"', False
            else:
                cell += c
        elif c == '"' and not cell:
            open_ = quoted = True
        elif c in ",\n":
            cells.append(cell if cell or quoted else None)
            cell, quoted = "", False
            if c == "\n":
                rows.append(cells)
                cells = []
        else:
            cell += c
        k += 1
    return rows + [cells + [cell if cell or quoted else None]]


@pytest.mark.parametrize("split", ["128m", "16", "7", "1"])
def test_books_of_unequal_width_split_anywhere(spark, tmp_path, split):
    for name, content in GRIDS.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.csv").write_bytes(content.encode())
    keys = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        cells = grids.scan_grids(spark, [str(tmp_path / n) for n in GRIDS])
        if split == "7":
            assert spark.read.text(str(tmp_path / "wide")).rdd.getNumPartitions() > 10
        got = {}
        for r in cells.collect():
            got.setdefault(r.book, {})[r.row_idx, r.col_idx] = r.value
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {n: {(i, j): v for i, row in enumerate(by_hand(t)) for j, v in enumerate(row)} for n, t in GRIDS.items()}
    assert got == want
    assert want["breaks"][1, 1] == 'a "b"\n\nc,\nd' and want["breaks"][1, 2] == '5" pipe' and want["breaks"][3, 2] == "open, and\nnever closed"


def test_a_book_is_read_as_if_alone(spark, tmp_path):
    from landloom.plans import ingest

    def told(names):
        cells = grids.scan_grids(spark, [str(tmp_path / n) for n in names])
        done = ingest.ingest(cells, cells.select("book", "sheet").distinct().withColumn("ordinal", F.lit(0)))
        heads = {r.book: (r.header_row, r.used_fallback) for r in done.headers.collect()}
        keys = {}
        for r in done.keys.orderBy("col_idx").collect():
            keys.setdefault(r.book, []).append(r.key)
        said = {}
        for r in done.warnings().collect():
            said.setdefault(r.book, set()).add((r.code, r.n))
        return {n: (heads[n], keys[n], said[n]) for n in names}

    for name in ("narrow", "wide"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.csv").write_text(GRIDS[name])
    both = told(["narrow", "wide"])
    assert both == {**told(["narrow"]), **told(["wide"])}
    assert both["narrow"][:2] == ((1, False), ["state", "district", "area"]) and both["wide"][0] == (2, False)
    assert "discarded-empty-columns" not in {c for c, _ in both["narrow"][2]}


def test_only_files_that_pass_are_opened(spark, tmp_path):
    """A file of another kind that is longer than Spark may read."""
    (tmp_path / "a.XLSX").write_bytes(b"PK\x03\x04")
    (tmp_path / "m.kml").write_bytes(KML.format(SQUARE).encode())
    (tmp_path / "long.bin").write_bytes(b"x" * 5000)
    key = "spark.sql.sources.binaryFile.maxLength"
    old = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        codes = {r.path.rsplit("/", 1)[1]: r.error_code for r in grids.triage_files(spark, str(tmp_path)).collect()}
        files = {r.filename: r.skip_reason for r in archives.expand_archives(archives.landed(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.set(key, old)
    assert codes == {"a.XLSX": None, "m.kml": "wrong-extension", "long.bin": "wrong-extension"}
    assert files == {"m.kml": None, "a.XLSX": "not a boundary file", "long.bin": "not a boundary file"}


def test_extract(spark, tmp_path):
    df = spark.sql("select '1' as a, timestamp'2024-02-03 10:00:00' as b, 2.5 as c, 'x' as d")
    out = extract.extract_columns(df, [("a", "Sr No\r\n(x)", "l"), ("b", " ", "Column 2"), ("c", "Area", "l"), ("d", "Area", "l")])
    assert out.columns == ["Sr No\r\n(x)", "Column 2", "Area", "Area (d)"] and out.first()[:2] == ("1", "2024-02-03")
    extract.write_extract(df, [("a", "A", "l")], str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x"), header=True).columns == ["A"]


def test_stream_is_the_batch(spark, tmp_path):
    rows = [("1", " Goa", "North", "₹ 5"), ("2", "goa", "n/a", "tbd"), ("3", "X", "North", "(7)")]
    df = spark.createDataFrame(rows, "record_id string, state string, district string, amount string")
    dim = spark.createDataFrame([("state", None, "Goa", "goa"), ("district", "Goa", "North", "north")], "level string, state string, name string, key string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateless.clean_and_place(stream, dim).writeStream.format("memory").queryName("placed_rows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in stateless.clean_and_place(df, dim).collect()}
    assert {tuple(r) for r in spark.sql("select * from placed_rows").collect()} == want == {("1", "Goa", "North", 5.0), ("2", "Goa", None, None), ("3", None, None, -7.0)}


def test_folders_are_listed_by_few_tasks(spark):
    from landloom.sources.tables import listing

    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with listing(spark):
        assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == before


def test_small_files_are_read_once_and_together(spark):
    kml = "<kml><Document><Placemark><Point><coordinates>%d,2</coordinates></Point></Placemark></Document></kml>"
    files = spark.createDataFrame([(f"f{i}.kml", (kml % i).encode() if i % 5 else b"broken") for i in range(40)], "filename string, content binary")
    vertices, read = archives.scan_placemarks(files)
    assert "MapInPandas" not in vertices._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.file, r.lng) for r in vertices.collect()) == sorted((f"f{i}.kml", float(i)) for i in range(40) if i % 5)
    assert sorted(r.file for r in read.where("size(warnings) > 0").collect()) == sorted(f"f{i}.kml" for i in range(0, 40, 5))


def test_small_files_are_read_whole(spark, tmp_path, monkeypatch):
    """Small files are a row each, with the records that are found line by line in files that Spark may split."""
    import random

    rng = random.Random(7)
    files = {f"f{i}": "".join(rng.choice(['"', '""', ",", "a", "\n", "\r\n", "\r", "é", " ", '",', ',"', "b\n"]) for _ in range(rng.randrange(60))) for i in range(60)}
    files |= {"none": "", "line": "\n", "two": "a\n\n", "mark": "﻿x,y\n", "open": 'a,"b\nc\n'}
    for name, content in files.items():
        (tmp_path / f"book={name}").mkdir()
        (tmp_path / f"book={name}" / "part-0.csv").write_bytes(content.encode())
    read = lambda: sorted((r.book, r.row_idx, [tuple(c) for c in r.cells]) for r in grids.scan_rows(spark, str(tmp_path), folders=True).collect())
    got = read()
    monkeypatch.setattr(grids, "WHOLE_BYTES", 0)
    assert got == read() and len(got) > 100
    monkeypatch.setattr(grids, "WHOLE_BYTES", 64 * 1024)
    monkeypatch.setattr(grids, "_records", lambda lines: lines.selectExpr("file", "0L AS row_idx", "assert_true(false) || value AS value"))
    assert got == read()  # no line of a small file is read by itself
