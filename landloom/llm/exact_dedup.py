"""Exact duplicates of normalised text.

A snapshot is immutable: its distinct digests are split into hash buckets of bounded size and each bucket
gets one static binary-fuse filter. Digests of an incoming batch are first grouped among themselves, then
screened by the filter of their bucket; only positives join the snapshot's exact rows. All members of a
group of two or more rows are byte-checked by comparing whole normalised texts (the least and the greatest
of a group must be the same, which combines before the shuffle, so a hot group costs one row a task).

Nulls and empty texts are texts of no characters and equal each other. An empty table gives no rows.
Repeated rows are members of their group like any others and share ``kept``; ties go to the smaller doc_id,
null ids last.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.staging import shared_dir, sized_broadcast, split_join, stage

#: Distinct digests a filter is built over, on average; memory of a task is about 60 bytes a digest.
BUCKET_KEYS = 50_000
#: Digests of groups (64 bytes each) that are broadcast at most: some 60 MB. More go by a shuffle join.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """Text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints: no false negatives, 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots a key, in three neighbouring segments."""
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        parts = [h & mask, (h >> np.uint64(18)) & mask, _mix(h, 7) & mask]
        return np.stack([(first + np.uint64(i)) * np.uint64(segment) + p for i, p in enumerate(parts)]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Build over unsigned 64-bit keys by peeling rounds: in each, all keys alone in some slot are removed."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(1, len(keys))
        segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
        size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
        segments = max(1, -(-size // segment))
        for seed in range(1, 200):
            h = _mix(keys, seed)
            slots = cls._slots(h, segment, segments)
            width = (segments + 2) * segment
            alive, order = np.ones(len(keys), bool), []
            count = np.bincount(slots.ravel(), minlength=width)
            owner = np.zeros(width, np.int64)
            for row in slots:
                np.bitwise_xor.at(owner, row, np.arange(len(keys)))
            while True:
                single = np.flatnonzero(count == 1)
                if not len(single):
                    break
                who, at = np.unique(owner[single], return_index=True)
                order.append((who, single[at]))
                alive[who] = False
                for row in slots[:, who]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(owner, row, who)
            if not alive.any():
                table = np.zeros(width, np.uint8)
                for who, at in reversed(order):
                    own = slots[:, who]
                    table[at] = 0
                    table[at] = cls._print(h[who]) ^ table[own[0]] ^ table[own[1]] ^ table[own[2]]
                return cls(seed, segment, segments, table)
        raise ValueError("no seed peels these keys")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        a, b, c = self._slots(h, self.segment, self.segments)
        return self._print(h) == self.table[a] ^ self.table[b] ^ self.table[c]


FILTERS = "bucket long, seed long, segment long, segments long, cells binary"


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    f = FuseFilter.build(rows.column("fp").to_numpy().view(np.uint64))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([f.seed], pa.int64()), "segment": pa.array([f.segment], pa.int64()), "segments": pa.array([f.segments], pa.int64()), "cells": pa.array([f.table.tobytes()], pa.binary())})


def _screen(key: tuple, batch: pa.Table, filters: pa.Table) -> pa.Table:
    if not batch.num_rows or not filters.num_rows:
        return batch.slice(0, 0)
    f = filters.to_pylist()[0]
    held = FuseFilter(f["seed"], f["segment"], f["segments"], np.frombuffer(f["cells"], np.uint8))
    return batch.filter(pa.array(held.may_hold(batch.column("fp").to_numpy().view(np.uint64))))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, chars (code points of the original), sha (hex), norm_bytes and fp (64 bits) of each row."""
    norm = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "chars", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.octet_length("norm").cast("long").alias("norm_bytes")).withColumn("fp", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long"))


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter row a bucket of the snapshot's distinct digests (column ``fp``)."""
    return snapshot.select(F.pmod("fp", F.lit(buckets)).alias("bucket"), "fp").groupBy("bucket").applyInArrow(_build, FILTERS)


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Rows of a batch of distinct digests that a snapshot's filters may hold: all true ones and 1 in 256 others."""
    keyed = batch.withColumn("bucket", F.pmod("fp", F.lit(buckets)))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, keyed.schema).drop("bucket")


def write_snapshot(sides: DataFrame, path: str) -> None:
    """An immutable snapshot below a folder: its distinct digests (sha, norm_bytes, fp, n, best) and their static filters, built once."""
    buckets = max(1, -(-sides.count() // BUCKET_KEYS))
    sides.write.parquet(f"{path}/digests")
    build_filters(sides, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Digests, filters and the number of buckets of a written snapshot."""
    filters = spark.read.schema(FILTERS + ", buckets int").parquet(f"{path}/filters")
    row = filters.select("buckets").first()
    return spark.read.parquet(f"{path}/digests"), filters.drop("buckets"), row["buckets"] if row else 1


def distinct_digests(rows: DataFrame) -> DataFrame:
    """sha, norm_bytes, fp, n and best (most code points, then least id, null last) of each digest of ``rows`` (see ``digests``)."""
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("minus_id"))).alias("best")
    return rows.groupBy("sha", "norm_bytes", "fp").agg(F.count("*").alias("n"), best)


def dedup(docs: DataFrame, in_snapshot: Column, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and matched_snapshot.

    ``in_snapshot`` (over doc_id) tells the rows of the immutable snapshot, which is written to ``path`` (else to a new
    shared folder) and loaded from there, from those of the new batch. The row that stays has the most code points, then the smallest doc_id.
    """
    spark = docs.sparkSession
    rows = stage(digests(docs).withColumn("old", F.coalesce(in_snapshot, F.lit(False))), "digests")
    path = path or f"{shared_dir(spark)}/landloom/{uuid.uuid4().hex}/snapshot"
    write_snapshot(distinct_digests(rows.where("old")), path)
    old, filters, buckets = read_snapshot(spark, path)
    new = stage(distinct_digests(rows.where(~F.col("old"))), "batch")
    positives = screen(new, filters, buckets)
    met = positives.select("sha", "norm_bytes").join(old.select("sha", "norm_bytes"), ["sha", "norm_bytes"], "left_semi").withColumn("met", F.lit(True))
    sides = old.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    groups = sides.join(met, ["sha", "norm_bytes"], "left").groupBy("sha", "norm_bytes", F.when(F.col("met"), F.lit(None)).otherwise(F.col("old")).alias("side"))
    groups = stage(groups.agg(F.sum("n").alias("group_size"), F.max("best").alias("best"), F.first("met").alias("met")), "groups")
    several = groups.where("group_size > 1")
    check_bytes(docs, several.select("sha").distinct())
    # a text that stands once needs no look-up; a group of much of all rows is met where its rows are
    both = several.withColumn("side", F.explode(F.when(F.col("side").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array("side"))))
    unit = lambda: F.concat_ws("/", "sha", F.col("norm_bytes").cast("string"), F.col("side").cast("string"))
    found = both.select(unit().alias("unit"), F.col("group_size").alias("members"), F.col("best").alias("top"), F.coalesce("met", F.lit(False)).alias("met"))
    keyed = rows.select("doc_id", F.concat_ws("/", "sha", F.col("norm_bytes").cast("string"), F.col("old").cast("string")).alias("unit"))
    members = split_join(keyed, stage(found, "several"), "unit", "members", rows.count(), how="left")
    stays = F.when(F.col("members").isNotNull(), F.bitwise_not("top.minus_id")).otherwise(F.col("doc_id"))
    return members.select("doc_id", stays.alias("keep_id"), F.coalesce("members", F.lit(1)).cast("long").alias("group_size"), stays.eqNullSafe(F.col("doc_id")).alias("kept"), F.substring("unit", 1, 64).alias("text_sha256"), F.coalesce("met", F.lit(False)).alias("matched_snapshot"))


def check_bytes(docs: DataFrame, shas: DataFrame) -> None:
    """Compare the whole normalised texts within every group of two or more rows; raise if a digest lied.

    Texts are met with the groups' digests, so rows without an id are compared, too, and only texts of groups move.
    """
    shas = stage(shas, "several_shas")
    norm = docs.select(normalised(F.col("text")).alias("norm")).select("norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    texts = norm.join(sized_broadcast(shas, shas.count(), BROADCAST_ROWS), "sha", "left_semi")
    wrong = texts.groupBy("sha").agg(F.min("norm").alias("a"), F.max("norm").alias("z")).where("a <> z").limit(1).count()
    if wrong:
        raise ValueError("texts of one digest differ")
