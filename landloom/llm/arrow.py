"""Helpers for functions over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes of text that a task holds as Python objects at once; one text is never cut here.
SLICE_ROWS, SLICE_BYTES = 2_000, 8 << 20
#: Rows of a batch between the JVM and Python, where the session has not set its own number.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch from Spark's default: whole texts are long, and two batches are held at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of bounded size."""
    for batch in batches:
        n = batch.num_rows
        step = SLICE_ROWS
        if n:
            mean = batch.column(batch.schema.get_field_index(column)).nbytes / n
            step = max(1, min(SLICE_ROWS, int(most / max(1.0, mean))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # workers wait for their next task


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about a slice each, however small they come."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= SLICE_ROWS or size >= SLICE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return [x or b"" for x in values.to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of the schema's types."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def split_words(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words (runs of other than ASCII white space) of texts: where each text's begin (and the last's end), their
    codes, and the distinct words by code. ``lower``: A-Z only. Null counts as empty."""
    values = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(values) if lower else values)
    coded = lists.flatten().dictionary_encode()
    distinct, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
    if b"" in distinct:  # around leading and trailing white space
        kept = codes != distinct.index(b"")
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        codes = codes[kept]
    return np.concatenate([[0], ends]).astype(np.int64), codes, distinct


def _narrow(a: np.ndarray) -> tuple[int, bytes]:
    """Unsigned integers as planes of as many bytes as the largest needs."""
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    return width, np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned integers, each narrowed to its planes, compressed together."""
    parts = [_narrow(c) for c in columns]
    head = np.array([len(c) for c in columns] + [w for w, _ in parts], "<u4").tobytes()
    body = b"".join([head, *(p for _, p in parts)])
    return len(body).to_bytes(4, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack(payload: bytes, columns: int) -> list[np.ndarray]:
    body = pa.decompress(payload[4:], int.from_bytes(payload[:4], "little"), "zstd", asbytes=True)
    head = np.frombuffer(body, "<u4", 2 * columns).tolist()
    at, out = 8 * columns, []
    for n, width in zip(head[:columns], head[columns:], strict=True):
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        out.append(a.view("<u8").ravel())
        at += n * width
    return out
