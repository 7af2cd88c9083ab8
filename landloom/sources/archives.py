"""Archives of boundary files: drops flattened, placemarks read. The archive and XML decoding runs per file inside tasks."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.sources.grids import any_case
from landloom.sources.tables import listing, written

ENTRIES = "filename string, content binary, from_archive string, skip_reason string"
PLACEMARKS = "file string, feature int, name string, geometry_type string, polygon int, ring int, seq int, lng double, lat double, code string, message string"


NAMES = ("kmz", "kml", "zip")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """path and content of landed files. Only archives and boundary files are opened (their names reach the reader as a glob); others are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    with listing(spark):
        every, ours = files.load(path), files.option("pathGlobFilter", "{" + ",".join(any_case(f".{n}") for n in NAMES) + "}").load(path)
    listed = every.where(~F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1)).isin(*NAMES)).select("path", F.lit(None).cast("binary").alias("content"))
    return ours.select("path", "content").unionByName(listed)


#: Vertices, and bytes of contents, that go to Spark at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 20_000, 8 << 20

_BROKEN = (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, EOFError)


def _flatten(name: str, content: bytes | None, archive: str | None = None) -> Iterator[tuple]:
    """A file, or all files of an archive at any depth: one entry is unpacked at a time, after all of its archive were tested."""
    open_ = [iter([(name, lambda: content, archive)])]
    while open_:
        entry = next(open_[-1], None)
        if entry is None:
            open_.pop()
            continue
        name, read, archive = entry
        base = name.rsplit("/", 1)[-1]
        low = base.lower()
        if low.endswith((".kmz", ".kml")):
            yield base, read(), archive, None
        elif low.endswith(".zip") and (packed := read()) is not None:
            try:
                z = zipfile.ZipFile(io.BytesIO(packed))
                bad = z.testzip()
            except _BROKEN:
                bad = base
            if bad is not None:
                yield base, None, archive, "unreadable archive"
            else:
                open_.append(iter([(e.filename, partial(z.read, e), base) for e in z.infolist() if not e.is_dir()]))
        else:
            yield base, None, archive, "not a boundary file"


def expand_archives(files: DataFrame) -> DataFrame:
    """filename, content, from_archive, skip_reason of every file of a drop (path, content), archives opened at any depth.

    A batch between Spark and Python is bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``; a task holds the archives that lie in each other
    and some entries of the innermost.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols, held, size = ["filename", "content", "from_archive", "skip_reason"], [], 0  # small files go on together
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for row in _flatten(path, None if content is None else bytes(content)):
                    held.append(row)
                    size += len(row[1] or b"")
                    if size >= BYTES_AT_ONCE or len(held) >= ROWS_AT_ONCE:
                        yield pd.DataFrame(held, columns=cols)
                        held, size = [], 0
        yield pd.DataFrame(held, columns=cols)

    return files.select("path", "content").mapInPandas(run, ENTRIES)


def _document(name: str, content: bytes) -> tuple[bytes | None, list[tuple[str, str]]]:
    if not name.lower().endswith(".kmz"):
        return content, []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            roots = [e for e in z.namelist() if "/" not in e and e.lower().endswith(".kml")]
            if not roots:
                return None, [("no-kml-entry", "The archive has no document at its root.")]
            return z.read(roots[0]), [("multiple-kml-entries", "The first document at the root is read.")] * (len(roots) > 1)
    except zipfile.BadZipFile:
        return content, [("not-a-zip", "The file is no archive and is read as a plain document.")]


def _positions(text: str | None) -> list[tuple[float, float]]:
    out = []
    for piece in (text or "").split():
        parts = piece.split(",")
        try:
            out.append((float(parts[0]), float(parts[1])))
        except (ValueError, IndexError):
            continue
    return out


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _placemarks(document: bytes) -> Iterator[ET.Element | None]:
    """Placemarks as they end, and None for each link to another document; what was read is let go."""
    path = []
    for event, e in ET.iterparse(io.BytesIO(document), ("start", "end")):
        if event == "start":
            path.append(e)
            continue
        path.pop()
        kind = _local(e)
        if kind == "NetworkLink":
            yield None
        inside = any(_local(p) == "Placemark" for p in path)
        if kind == "Placemark" and not inside:
            yield e
        if not inside and path:
            path[-1].remove(e)


def _vertices(file: str, feature: int, mark: ET.Element) -> Iterator[tuple]:
    name = next((e.text for e in mark if _local(e) == "name"), None)
    polygon = -1
    for g in mark.iter():
        kind = _local(g)
        if kind in ("Point", "LineString"):
            polygon += 1
            for seq, (x, y) in enumerate(p for c in g.iter() if _local(c) == "coordinates" for p in _positions(c.text)):
                yield file, feature, name, kind, polygon, 0, seq, x, y, None, None
        elif kind == "Polygon":
            polygon += 1
            bounds = [[c for e in g if _local(e) == side for c in e.iter() if _local(c) == "coordinates"] for side in ("outerBoundaryIs", "innerBoundaryIs")]
            for ring, c in enumerate(bounds[0] + bounds[1]):
                for seq, (x, y) in enumerate(_positions(c.text)):
                    yield file, feature, name, kind, polygon, ring, seq, x, y, None, None


def _rows(file: str, content: bytes) -> Iterator[tuple]:
    """Vertices and warnings of a file. The document is read twice by events, first to see that it can be read: a placemark is held, never the tree."""
    document, warnings = _document(file, content)
    linked = False
    if document is not None:
        try:
            for mark in _placemarks(document):
                linked |= mark is None
        except ET.ParseError:
            document, linked, warnings = None, False, [*warnings, ("unreadable", "The document can't be read.")]
    if linked:
        warnings = [*warnings, ("network-link", "A link to another document is not followed.")]
    if document is not None:
        for feature, mark in enumerate(m for m in _placemarks(document) if m is not None):
            yield from _vertices(file, feature, mark)
    for code, message in warnings:
        yield file, *(None,) * 8, code, message


def scan_placemarks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (file, feature, name, geometry_type, polygon, ring, seq, lng, lat) and files (file, warnings) of boundary files (filename, content)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in PLACEMARKS.split(", ")]
        rows = chain.from_iterable(_rows(name, bytes(content)) for pdf in batches for name, content in zip(pdf["filename"], pdf["content"], strict=True))
        while held := list(islice(rows, ROWS_AT_ONCE)):  # of one file or of many small ones
            yield pd.DataFrame(held, columns=cols).astype({c: "Int32" for c in ("feature", "polygon", "ring", "seq")})

    rows = written(files.where("content is not null").select("filename", "content").mapInPandas(run, PLACEMARKS), "placemarks")  # files are read once for both results
    vertices = rows.where("code is null").drop("code", "message")
    said = rows.where("code is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("code", "message"))).alias("warnings"))
    none = F.array().cast("array<struct<code:string,message:string>>")
    return vertices, files.where("content is not null").select(F.col("filename").alias("file")).distinct().join(said, "file", "left").withColumn("warnings", F.coalesce("warnings", none))
