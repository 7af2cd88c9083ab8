"""Byte-level BPE by overlapping chunks.

Texts longer than a chunk are cut into chunks that overlap. Each chunk is pre-tokenised by itself; in the
overlap with the next chunk, the first boundary that both see, after a character that is no white space, is
where the two resynchronise (from a common boundary on, the pattern sees the same text). Cut there, a text
becomes segments that encode independently and whose ids, in order, are those of the whole text. Where an
overlap holds no such boundary (a run of one kind that is longer than it), the two chunks stay one segment.
Decoding concatenates the raw bytes of the ids.

Null and empty texts have no ids. Repeated rows each get their own result. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, slices, utf8
from landloom.llm.staging import stage, texts

CHUNK, OVERLAP = 32_768, 2_048
#: Text, or ids, that a task holds as Python objects at once.
SLICE = 2 << 20


@lru_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("landloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> list[bytes]:
    enc = encoding(path, pattern)
    table = [b""] * (enc.max_token_value + 1)
    for token in range(enc.max_token_value + 1):
        try:
            table[token] = enc.decode_single_token_bytes(token)
        except KeyError:
            continue
    return table


def decode(ids: bytes, path: str, pattern: str) -> bytes:
    """Raw bytes of ids given as little-endian unsigned 32-bit integers."""
    return b"".join(map(vocabulary(path, pattern).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of a text."""
    return [m.end() for m in regex.compile(pattern).finditer(text)]


def _ends(left: str, right_from: int, pattern: str) -> tuple[list[int], list[int]]:
    """Boundaries in the overlap at a chunk's end: as the chunk itself sees them, and as the next one will.

    The last pre-token may be cut by the chunk's end, so a boundary there doesn't count.
    """
    own = [x for x in boundaries(left, pattern) if right_from <= x < len(left)]
    other = [right_from + x for x in boundaries(left[right_from:], pattern) if right_from + x < len(left)]
    return own, other


def resync(left: str, right_from: int, pattern: str) -> int:
    """Where a chunk and the next, which starts at ``right_from`` of it, agree; -1 if nowhere."""
    own, other = _ends(left, right_from, pattern)
    both = set(own) & set(other)
    return next((x for x in sorted(both) if x > right_from and not left[x - 1].isspace()), -1)


def segments(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """doc (key), seg and text of the independent segments of long texts (columns doc, text).

    A text is cut into chunks in one pass; each meets the next one's begin, and what lies before and behind the places where
    they resynchronise is put together by segment. The work is linear in a text's length.
    """
    bases = stage(long.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{chunk}}})"), F.lit(1))).alias("k", "base")), "chunks")
    order = W.partitionBy("doc").orderBy("k")
    pairs = bases.withColumn("next", F.substring(F.lead("base").over(order), 1, overlap)).where("next is not null").select("doc", "k", F.concat("base", "next").alias("text"))
    schema = pa.schema([("doc", pa.string()), ("k", pa.int32()), ("cut", pa.int32())])

    def cuts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            found = [resync(t, chunk, pattern) for t in b.column("text").to_pylist()]
            yield batch_of(schema, b.column("doc"), [k + 1 for k in b.column("k").to_pylist()], [x - chunk for x in found])

    at = pairs.repartition("doc", "k").mapInArrow(cuts, "doc string, k int, cut int").where("cut > 0")
    cut = F.col("cut")
    placed = bases.join(at, ["doc", "k"], "left").withColumn("seg", F.count("cut").over(order))
    head, tail = F.struct((F.col("seg") - 1).alias("seg"), (2 * F.col("k")).alias("n"), F.substring("base", F.lit(1), cut).alias("text")), F.struct(F.col("seg"), (2 * F.col("k") + 1).alias("n"), F.substring("base", cut + 1, F.lit(chunk)).alias("text"))
    pieces = placed.select("doc", F.explode(F.when(cut.isNull(), F.array(F.struct("seg", (2 * F.col("k")).alias("n"), F.col("base").alias("text")))).otherwise(F.array(head, tail))).alias("p")).select("doc", "p.*")
    return pieces.groupBy("doc", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))


def _encoder(path: str, pattern: str, keys: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in slices(batches, most=SLICE):
            ids = [np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(ids, pa.binary())], names=[*keys, "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row's whole text."""
    rows = texts(docs)
    short = rows.where(F.char_length("text") <= chunk).mapInArrow(_encoder(path, pattern, ["doc_id"]), "doc_id long, ids binary")
    return short.unionByName(_encode_long(rows, path, pattern, chunk, overlap))


def _encode_long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts over a chunk, by independent segments that any executor encodes."""
    long = rows.where(F.char_length("text") > chunk).withColumn("doc", F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.col("text").cast("binary"), 256)))
    long = stage(long.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies")), "long")
    coded = segments(long.select("doc", "text"), pattern, chunk, overlap).repartition("doc", "seg").mapInArrow(_encoder(path, pattern, ["doc", "seg"]), "doc string, seg long, ids binary")
    whole = coded.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("seg", "ids"))).alias("parts"))
    whole = whole.select("doc", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    return long.select("doc", "doc_id", "copies").join(whole, "doc").select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("doc_id", "ids")


def _digester(path: str, pattern: str, with_ids: bool, encode_text: bool) -> Callable:
    """Over rows of doc_id and text (to be encoded first) or ids."""
    import hashlib

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.binary())] * with_ids)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        words = list(map(str, range(len(vocabulary(path, pattern)))))
        for b in slices(batches, "text" if encode_text else "ids", SLICE):
            ids = [np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for t in b.column("text").to_pylist()] if encode_text else utf8(b, "ids")
            joined = [hashlib.sha256(",".join(map(words.__getitem__, np.frombuffer(x, "<u4").tolist())).encode()).hexdigest() for x in ids]
            yield batch_of(schema, b.column("doc_id"), [len(x) // 4 for x in ids], joined, [hashlib.sha256(decode(x, path, pattern)).hexdigest() for x in ids], *([ids] * with_ids))

    return run


def encode_digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes of the decoded ids), perhaps ids, of every row's whole text."""
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    rows = texts(docs)
    short = rows.where(F.char_length("text") <= chunk).mapInArrow(_digester(path, pattern, with_ids, True), columns)
    return short.unionByName(_encode_long(rows, path, pattern, chunk, overlap).mapInArrow(_digester(path, pattern, with_ids, False), columns))
