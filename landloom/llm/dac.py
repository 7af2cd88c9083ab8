"""Token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the low 8 bits of every id and a bitmap that
tells which ids go on; level 1 has the next 8 bits of those, and so on. A rank directory counts the ones of
each bitmap before every 512th bit, so that any id is found by one look-up a level, without decoding others.
Segments are rows of a Parquet table in ascending doc_id order, written by one task per range of ids.

Null and empty texts hold the end id alone. Rows with a null doc_id come first, repeated ids stand next to
each other (in the order of their texts). An empty table writes a table of no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, gathered, slices, split_words
from landloom.llm.staging import shared_dir, stage, texts

#: Bits between two entries of a rank directory.
RANK_BITS = 512
#: Ids after which a segment is closed (a document is never split over two).
SEGMENT_IDS = 1 << 20
#: Distinct words whose codes a worker keeps at most; then it starts anew.
CACHE_WORDS = 400_000

SEGMENTS = "part int, seg int, n_ids long, doc_ids array<bigint>, doc_ends array<bigint>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"
_ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned ids."""
    levels, bitmaps, ranks, rest = [], [], [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.int64)
        levels.append((rest & 255).astype(np.uint8).tobytes())
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4").tobytes() if len(ones) else b"")
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more] >> 8


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    low = None
    for level, bitmap in zip(reversed(levels), reversed(bitmaps), strict=True):
        own = np.frombuffer(level, np.uint8).astype(np.uint32)
        if low is not None:
            own[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(own), bitorder="little").astype(bool)] |= low << np.uint32(8)
        low = own
    return low if low is not None else np.zeros(0, np.uint32)


def tokens_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: np.ndarray) -> np.ndarray:
    """The ids at some positions of a segment: one byte, one bit and one rank a level and id; nothing else is decoded."""
    out, who, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
    i = np.asarray(at, np.int64)
    for level, bitmap, rank in zip(levels, bitmaps, ranks, strict=True):
        out[who] |= np.frombuffer(level, np.uint8)[i].astype(np.uint32) << np.uint32(shift)
        bits = np.frombuffer(bitmap, np.uint8)
        more = (bits[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)
        if not more.any():
            break
        i, who, shift = i[more], who[more], shift + 8
        # ones before the position: the directory's count, and those of its block's bytes up to it
        first = i // RANK_BITS * (RANK_BITS // 8)
        places = first[:, None] + np.arange(RANK_BITS // 8)
        own = bits[np.minimum(places, len(bits) - 1)]
        own = np.where(places < (i >> 3)[:, None], own, np.where(places == (i >> 3)[:, None], own & ((1 << (i & 7)) - 1).astype(np.uint8)[:, None], 0))
        i = np.frombuffer(rank, "<u4")[i // RANK_BITS].astype(np.int64) + np.bitwise_count(own).sum(1, dtype=np.int64)
    return out


#: Pieces the tokenizer's own splitter makes of a word of ASCII and Latin-1 letters.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7EÀ-ÿ]+")
#: Pieces that are handed to the library at once, with a space between.
_TOGETHER = 2_000


class WordCodes:
    """Ids of words (bytes without ASCII white space) by the tokenizers library, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and splits words into pieces, so a text's ids are those of its words,
    and a plain word's are those of its pieces; the library encodes each distinct piece of a slice of texts
    once. Words of other letters are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.pieces = Tokenizer.from_file(path), {}, {}
        # words are cut apart here as this kind of tokenizer does; another kind must not be read so
        if _PIECES.pattern not in str(self.tokenizer.pre_tokenizer) or "Lowercase()" not in str(self.tokenizer.normalizer):
            raise ValueError("the tokenizer's file has another splitter than words are cut by")

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_pieces(self, new: list[str]) -> None:
        for at in range(0, len(new), _TOGETHER):
            some = new[at : at + _TOGETHER]
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, of = np.array(coded.ids, "<u4"), np.array(coded.word_ids)
            ends = np.searchsorted(of, np.arange(len(some)), side="right")
            for piece, a, z in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                self.pieces[piece] = ids[a:z].tobytes()

    def learn(self, new: list[bytes]) -> None:
        if len(self.pieces) > 2 * CACHE_WORDS:
            self.pieces.clear()
        split = {}
        for word in new:
            text = word.decode()
            if not word.isascii() and not _PLAIN.fullmatch(text):
                self.words[word] = self.ids(text)
                continue
            low = text.lower()
            if low.isalpha():
                split[word] = (low,)
            elif low[:-1].isalpha() and low[-1] in ".,!|":
                split[word] = (low[:-1], low[-1])
            elif "<|" in low or not low.isprintable():
                self.words[word] = self.ids(text)
            else:
                split[word] = _PIECES.findall(low)
        self.learn_pieces(list({p for x in split.values() for p in x}.difference(self.pieces)))
        for word, own in split.items():
            self.words[word] = self.pieces[own[0]] if len(own) == 1 else b"".join(map(self.pieces.__getitem__, own))

    def encode(self, texts: pa.RecordBatch) -> list[np.ndarray]:
        """Ids of whole texts."""
        starts, codes, words = split_words(texts)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        self.learn([w for w in words if w and w not in self.words])
        own = [self.words.get(w, b"") for w in words]
        pool = np.frombuffer(b"".join(own), "<u4")
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        first = np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = pool[np.repeat(first[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        at = np.concatenate([[0], ends])[starts]
        return [ids[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(1)
def word_codes(path: str) -> WordCodes:
    return WordCodes(path)


def write(docs: DataFrame, path: str, end_id: int, to: str, doc_bytes: int = 32 << 20) -> None:
    """Encode every whole text, append the end id to each and write segments to folder ``to``.

    Ranges of doc_id of about ``doc_bytes`` of text each are dealt to tasks; texts are shuffled once and encoded
    once, after the shuffle.
    """
    rows = texts(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-total // doc_bytes))
    order = ("doc_id", F.xxhash64("text"))  # rows of one id can be dealt to several tasks
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, end = word_codes(path), np.array([end_id], "<u4")
        part, seg, held, ids, ends = None, 0, 0, [], []

        def close() -> pa.RecordBatch:
            levels, bitmaps, ranks = pack(np.concatenate(held_ids))
            return batch_of(_ARROW, [part], [seg], [held], [ids], [ends], [levels], [bitmaps], [ranks])

        held_ids: list[np.ndarray] = []
        for b in slices(gathered(batches)):
            for p, doc, coded in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), codes.encode(b), strict=True):
                if ids and (p != part or held >= SEGMENT_IDS):
                    yield close()
                    seg, held, ids, ends, held_ids = (seg + 1 if p == part else 0), 0, [], [], []
                part = p
                held += len(coded) + 1
                held_ids += [coded, end]
                ids.append(doc)
                ends.append(held)
        if ids:
            yield close()

    dealt.mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(to)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the segments, from the files alone."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # offsets in two levels, so that no task holds the sizes of all parts
    blocks = sizes.groupBy(F.floor(F.col("part") / 1024).alias("block")).agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("block_start"))
    parts = sizes.withColumn("block", F.floor(F.col("part") / 1024)).join(blocks, "block").select("part", (F.col("block_start") + F.sum("n").over(W.partitionBy("block").orderBy("part")) - F.col("n")).alias("part_start"))
    starts = files.select("part", "seg", "n_ids").join(parts, "part").select("part", "seg", (F.col("part_start") + F.sum("n_ids").over(W.partitionBy("part").orderBy("seg")) - F.col("n_ids")).alias("seg_start"))
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids, ends = unpack(row["levels"], row["bitmaps"]).astype("<u4"), row["doc_ends"]
                # each document's first and last id once more, by random access
                some = np.unique(np.concatenate([np.array([0, *ends[:-1]]), np.array(ends) - 1]))
                for at in range(0, len(some), _TOGETHER):
                    to = some[at : at + _TOGETHER]
                    if not np.array_equal(tokens_at(row["levels"], row["bitmaps"], row["ranks"], to), ids[to]):
                        raise ValueError(f"segment {row['part']}, {row['seg']}: the rank directory and the levels differ")
                spans = list(zip([0, *ends[:-1]], ends, strict=True))
                n = len(ends)
                yield batch_of(schema, row["doc_ids"], [row["part"]] * n, [row["seg"]] * n, [a for a, _ in spans], [z - a for a, z in spans], [zlib.crc32(ids[a:z].tobytes()) for a, z in spans])

    read = files.select("part", "seg", "doc_ids", "doc_ends", "levels", "bitmaps", "ranks").mapInArrow(run, "doc_id long, part int, seg int, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seg"]).select("doc_id", (F.col("seg_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(wanted: DataFrame, path: str) -> DataFrame:
    """doc_id, position and id of wanted tokens (doc_id, position: counted from 0 in a document), read from the segments by random access.

    Positions outside of a document, and documents that aren't there, have a null id. Where an id stands on several
    documents, each answers. Segments are read whole by those tasks alone that hold a wanted token of theirs.
    """
    files = wanted.sparkSession.read.schema(SEGMENTS).parquet(path)
    ends = F.col("doc_ends")
    spans = files.select("part", "seg", F.posexplode("doc_ids").alias("i", "doc_id"), ends)
    spans = spans.select("part", "seg", "doc_id", F.when(F.col("i") > 0, F.get("doc_ends", F.col("i") - 1)).otherwise(F.lit(0)).alias("a"), F.get("doc_ends", "i").alias("z"))
    asked = wanted.select("doc_id", F.col("position").cast("long").alias("position")).join(spans, "doc_id", "left")
    inside = F.col("position").between(0, F.col("z") - F.col("a") - 1)
    asked = stage(asked.select("doc_id", "position", "part", "seg", F.when(inside, F.col("a") + F.col("position")).alias("at")), "asked")
    schema = "doc_id long, position long, id long"

    def run(key: tuple, rows: pa.Table, segment: pa.Table) -> pa.Table:
        held = segment.to_pylist()[0]
        ids = tokens_at(held["levels"], held["bitmaps"], held["ranks"], rows.column("at").to_numpy())
        return pa.table({"doc_id": rows.column("doc_id"), "position": rows.column("position"), "id": pa.array(ids.astype(np.int64))})

    hits = asked.where("at is not null")
    needed = files.join(hits.select("part", "seg").distinct(), ["part", "seg"], "left_semi").select("part", "seg", "levels", "bitmaps", "ranks")
    found = hits.groupBy("part", "seg").cogroup(needed.groupBy("part", "seg")).applyInArrow(run, schema)
    return found.unionByName(asked.where("at is null").select("doc_id", "position", F.lit(None).cast("long").alias("id")))


def write_and_read(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the segments to a new folder of the shared directory and read the documents back from it."""
    import uuid

    to = f"{shared_dir(docs.sparkSession)}/landloom/{uuid.uuid4().hex}/tokens"
    write(docs, path, end_id, to)
    return read(docs.sparkSession, to)
