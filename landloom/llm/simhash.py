"""SimHash near duplicates by pigeonhole blocks.

A fingerprint's 64 bits are split into blocks. Two fingerprints that differ in at most ``k`` bits agree in
all but ``k`` of the blocks at least, so for some choice of the other blocks they share them all: distinct
fingerprints are joined on every such choice and verified by Hamming distance. More blocks make longer keys;
their number is the least for which chance meetings stay below one a fingerprint, and any number is exact.

Within a shared key, links are found by breadth-first search, so a family of copies gives a spanning forest
and not all pairs. A link is written only under the first choice that the pair shares: a link under a later
choice joins two fingerprints that earlier choices have already connected. Keys with more than ``RUN``
fingerprints are dealt anew in pairs of chunks, which keeps every comparison and bounds a task's memory.

``similar_links`` finds texts whose shingles are alike beyond what few bits of one fingerprint tell. Each text has several
fingerprints of its set of words, which a changed word moves little; texts that meet in blocks of any of them are
candidates, a longer fingerprint of the shingles ranks them (within a key its least spanning tree is kept, which holds
what is connected at any threshold), and the tree's links are verified by the sets of shingles themselves.

Null and empty texts and texts of white space alone have the fingerprint zero and link like any other.
Repeated rows share a fingerprint. Null ids never name a component unless it has no other. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, slices, utf8
from landloom.llm.components import components
from landloom.llm.staging import passing, sized_broadcast, split_join, stage, texts

#: Distinct fingerprints of one key that a task compares at once.
RUN = 4096
#: Ids of texts in links (8 bytes each) that are broadcast at most, and links after which a text is dealt in a further part.
NODES, HUB = 2_000_000, 2_000
SEED = 42
#: Shingles whose bits are counted at once.
_COUNTED = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """The unsigned fingerprint of a UTF-8 text: bit set if set in over half of its shingles' hashes."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _COUNTED):
        ones += np.unpackbits(hashes[at : at + _COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (64 bits as a long) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield batch_of(schema, b.column("doc_id"), pa.array(np.array([fingerprint(t, words) for t in utf8(b)], np.uint64).view(np.int64)))

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, k: int) -> list[int]:
    """The bits that each choice of ``blocks - k`` blocks keeps."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - k)]


def blocks_for(n: int, k: int) -> int:
    """The least number of blocks, ``k + 2`` or more, for which chance meetings are at most one a fingerprint."""
    for b in range(k + 2, 17):
        if comb(b, k) * n / 2 <= 2 ** (64 * (b - k) / b):
            return b
    return 16


def forest(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that a breadth-first search over all links within ``k`` bits follows."""
    left, right, open_ = [], [], fps
    while len(open_) > 1:
        frontier, open_ = [open_[0]], open_[1:]
        while frontier and len(open_):
            x = frontier.pop()
            near = np.bitwise_count(open_ ^ x) <= k
            if near.any():
                hits, open_ = open_[near], open_[~near]
                left.append(np.full(len(hits), x, np.uint64))
                right.append(hits)
                frontier.extend(hits)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("choice", pa.int32()), ("key", pa.int64())])


def _links(keep: list[int], k: int, run: int | None):
    """Over rows sorted by (choice, key, sub): links; rows of keys over ``run`` come back with their choice and key."""
    bits = np.array(keep, np.uint64)

    def first(choice: np.ndarray, diff: np.ndarray) -> np.ndarray:
        earlier = np.zeros(len(diff), bool)
        for j, mask in enumerate(bits[: choice.max(initial=0)]):
            earlier |= (choice > j) & (diff & mask == 0)
        return ~earlier

    def emit(choice: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        new = first(choice, x ^ y)
        n = int(new.sum())
        return batch_of(_LINKS, pa.array(x[new].view(np.int64)), pa.array(y[new].view(np.int64)), [-1] * n, [0] * n)

    def work(c: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs only. Short ones by offsets, all at once; longer ones by search."""
        starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(np.concatenate([starts, [len(fp)]]))
        small = np.repeat(np.where(size <= 8, np.arange(len(size)), -1 - np.arange(len(size))), size)
        for d in range(1, min(8, int(size.max()))):
            at = np.flatnonzero((small[d:] == small[:-d]) & (small[d:] >= 0))
            at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= k]
            if len(at):
                yield emit(c[at], fp[at], fp[at + d])
        for s, n in zip(starts[size > 8], size[size > 8], strict=True):
            if run is not None and n > run:
                yield batch_of(_LINKS, pa.array(fp[s : s + n].view(np.int64)), [0] * n, pa.array(c[s : s + n]), pa.array(key[s : s + n]))
            else:
                x, y = forest(fp[s : s + n], k)
                if len(x):
                    yield emit(np.full(len(x), c[s]), x, y)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        long_key = None  # rows of this key are passed on as they come
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column("choice").to_numpy(), b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)]
            if long_key is not None:
                own = int(np.argmin(np.append((new[0] == long_key[0]) & (new[1] == long_key[1]), False)))
                if own:
                    yield batch_of(_LINKS, pa.array(new[2][:own].view(np.int64)), [0] * own, pa.array(new[0][:own]), pa.array(new[1][:own]))
                if own == len(new[0]):
                    continue
                new, long_key = [x[own:] for x in new], None
            c, key, fp = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
            last = len(c) - int(np.argmin(np.append(((c == c[-1]) & (key == key[-1]))[::-1], False)))
            if last:
                yield from work(c[:last], key[:last], fp[:last])
            held = [c[last:], key[last:], fp[last:]]
            if run is not None and len(held[0]) > run:
                n, long_key = len(held[0]), (held[0][0], held[1][0])
                yield batch_of(_LINKS, pa.array(held[2].view(np.int64)), [0] * n, pa.array(held[0]), pa.array(held[1]))
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from work(*held)

    return over


def links(distinct: DataFrame, n: int, k: int = 4, blocks: int | None = None, run: int = RUN) -> DataFrame:
    """Links (a, b) that connect what is connected among distinct fingerprints (column ``fp``), each at most ``k`` bits apart."""
    keep = masks(blocks or blocks_for(n, k), k)
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for i, m in enumerate(keep)])
    keyed = distinct.select("fp", F.explode(choices).alias("c")).select(F.col("c.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("key"), "fp")
    schema = "a long, b long, choice int, key long"
    found = stage(keyed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_links(keep, k, run), schema), "links")
    short, long = found.where("choice < 0").select("a", "b"), found.where("choice >= 0").select("choice", F.col("key").alias("block"), F.col("a").alias("fp"))
    # keys over the bound: chunks of their fingerprints meet in pairs, each pair under a key of its own
    sizes = long.groupBy("choice", "block").agg(F.ceil(F.count("*") / run).alias("chunks"))
    own = long.join(sizes, ["choice", "block"]).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks"))
    paired = own.select("choice", "block", "fp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    paired = paired.select("choice", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    return short.union(paired.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_links(keep, k, None), schema).select("a", "b"))


#: Words of 64 bits of the long fingerprint, fingerprints of the set of words, and bits in which blocks of these may differ.
WIDE, TABLES, TABLE_BITS = 4, 4, 3


def _bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of ``words`` times 64 bits over 64-bit hashes, each mixed anew for every word of bits."""
    out = np.zeros(words, np.uint64)
    for i in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _COUNTED):
            h = hashes[at : at + _COUNTED] * np.uint64(2 * 0x9E3779B97F4A7C15 * (i + 1) + 1 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            ones += np.unpackbits((h ^ (h >> np.uint64(32))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _shingles(text: bytes, words: int) -> tuple[np.ndarray, list[bytes]]:
    """Distinct hashes of a text's shingles (of all of it, if it is shorter), and its words."""
    w = text.lower().split()
    some = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), np.uint64)), w


def similarity(a: bytes, b: bytes, words: int) -> float:
    """Jaccard similarity of two texts' sets of shingles."""
    x, y = _shingles(a, words)[0], _shingles(b, words)[0]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tables (fingerprints of the set of words) and wide (the long fingerprint of the shingles) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("tables", pa.list_(pa.int64())), ("wide", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            tables, wide = [], []
            for t in utf8(b):
                hashes, w = _shingles(t, words)
                kinds = np.fromiter(map(xxhash.xxh64_intdigest, set(w) or [b""], repeat(SEED)), np.uint64)
                tables.append(_bits(kinds, TABLES).view(np.int64).tolist())
                wide.append(_bits(hashes, WIDE).tobytes())
            yield batch_of(schema, b.column("doc_id"), tables, wide)

    return texts(docs).mapInArrow(run, "doc_id long, tables array<bigint>, wide binary")


def tree(wide: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a least spanning forest over long fingerprints (rows) that are at most ``most`` bits apart, by nearest node first."""
    n = len(wide)
    left, right = [], []
    best, near = np.full(n, 1 << 30), np.zeros(n, np.int64)
    open_ = np.arange(1, n)
    at = 0
    while len(open_):
        far = np.bitwise_count(wide[open_] ^ wide[at]).sum(1, dtype=np.int64)
        closer = far < best[open_]
        best[open_[closer]], near[open_[closer]] = far[closer], at
        pick = int(best[open_].argmin())
        at = int(open_[pick])
        if best[at] <= most:
            left.append(near[at])
            right.append(at)
        open_ = np.delete(open_, pick)
    return np.array(left, np.int64), np.array(right, np.int64)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("choice", pa.int32()), ("key", pa.int64()), ("wide", pa.binary())])


def _trees(most: int, run: int | None):
    """Over rows sorted by (choice, key): links of each key's tree; rows of keys over ``run`` come back with their choice and key."""

    def settle(c: int, k: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([h.column("doc_id").to_numpy() for h in held])
        wide = np.frombuffer(b"".join(w for h in held for w in h.column("wide").to_pylist()), "<u8").reshape(-1, WIDE)
        a, b = tree(wide, most)
        if len(a):
            yield batch_of(_PAIRS, pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b])), [-1] * len(a), [0] * len(a), pa.nulls(len(a), pa.binary()))

    def passed(c: int, k: int, own: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(_PAIRS, own.column("doc_id"), [0] * own.num_rows, [c] * own.num_rows, [k] * own.num_rows, own.column("wide"))

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0
        for b in batches:
            c, k = b.column("choice").to_numpy(), b.column("key").to_numpy()
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0)) + 1
            starts = np.append(0, cuts) if len(c) else cuts
            ends = np.append(cuts, len(c)) if len(c) else cuts
            alone = ends - starts == 1  # keys of one row, but for those that touch a batch's ends
            for i in np.flatnonzero(~alone | (starts == 0) | (ends == len(c))).tolist():
                own, key = b.slice(int(starts[i]), int(ends[i] - starts[i])), (int(c[starts[i]]), int(k[starts[i]]))
                if key != now:
                    if held and n > 1:
                        yield from settle(*now, held)
                    now, held, n = key, [], 0
                n += own.num_rows
                if run is not None and n > run:
                    for h in held:
                        yield passed(*now, h)
                    held = []
                    yield passed(*now, own)
                else:
                    held.append(own)
        if held and n > 1:
            yield from settle(*now, held)

    return over


def similar_links(docs: DataFrame, words: int = 5, least: float = 0.8, run: int = RUN, exact: bool = False) -> DataFrame:
    """Verified links (a, b) between ids (distinct, not null) of texts whose shingles' similarity is ``least`` or more.

    They connect what is connected among all candidates, but for pairs that no block brings together and those whose long fingerprints rank
    otherwise than their shingles do. With ``exact`` the prefix join adds what they lack (``least`` in hundredths), so that all is connected
    that a comparison of all pairs would connect.
    """
    if exact:
        from landloom.llm.jaccard import near_duplicates as joined

        with passing(docs.sparkSession):  # its tables are gone before those of the fingerprints come
            rest = joined(docs.select("doc_id", "text"), words, round(100 * least)).where("component_id <> doc_id")
            rest = stage(rest.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "exact_links", lasting=True)
        return similar_links(docs, words, least, run).unionByName(rest)
    every = stage(sketches(docs, words).withColumn("same", F.xxhash64("tables", "wide")), "sketches")
    # texts with the same fingerprints throughout are one row here, and linked to its least id
    rows = stage(every.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.any_value("tables").alias("tables"), F.any_value("wide").alias("wide")), "distinct")
    total = rows.count()
    first = rows.where("n > 1").select("same", "n", F.col("doc_id").alias("a"))
    stars = split_join(every.select("same", F.col("doc_id").alias("b")), stage(first, "first"), "same", "n", total).where("a < b").select("a", "b")
    keep = masks(blocks_for(total, TABLE_BITS), TABLE_BITS)
    signed = [m - (1 << 64) if m >> 63 else m for m in keep]
    keyed = rows.select("doc_id", "wide", F.explode(F.arrays_zip(F.array(*(F.lit(t * len(keep) + i) for t in range(TABLES) for i in range(len(keep)))).alias("choice"), F.flatten(F.transform("tables", lambda t: F.array(*(t.bitwiseAND(F.lit(m).cast("long")) for m in signed)))).alias("key"))).alias("c"))
    keyed = keyed.select(F.col("c.choice").cast("int").alias("choice"), F.col("c.key").alias("key"), "doc_id", "wide")
    turn = float(np.arccos(2 * least / (1 + least)) / np.pi)  # of the long fingerprint's bits, on average, at the least similarity
    most = round(64 * WIDE * turn + 2 * (64 * WIDE * turn * (1 - turn)) ** 0.5)
    schema = "a long, b long, choice int, key long, wide binary"
    found = stage(keyed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_trees(most, run), schema), "trees")
    short, long = found.where("choice < 0").select("a", "b"), found.where("choice >= 0").select("choice", F.col("key").alias("block"), F.col("a").alias("doc_id"), "wide")
    # keys over the bound: chunks of their rows meet in pairs, each pair under a key of its own
    sizes = long.groupBy("choice", "block").agg(F.ceil(F.count("*") / run).alias("chunks"))
    own = long.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, ["choice", "block"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), "chunks"))
    paired = own.select("choice", "block", "doc_id", "wide", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    paired = paired.select("choice", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "doc_id", "wide")
    more = paired.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_trees(most, None), schema).select("a", "b")
    return verified(docs, stage(short.unionByName(more).unionByName(stars).distinct(), "candidates"), words, least)


def verified(docs: DataFrame, links: DataFrame, words: int, least: float) -> DataFrame:
    """The links (a, b) whose whole texts' sets of shingles are that similar. Only texts that stand in a link move."""
    nodes = stage(links.select(F.col("a").alias("doc_id")).union(links.select("b")).groupBy("doc_id").agg(F.count("*").alias("n")), "nodes")
    known = stage(texts(docs).join(sized_broadcast(nodes, nodes.count(), NODES), "doc_id"), "texts")
    right = links.join(known.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    # a family's first text may stand in much of all links: it is broadcast in pieces of its own, others are shuffled
    first = links.select(F.col("a").alias("doc_id")).distinct()
    firsts = known.join(sized_broadcast(first, links.count(), NODES), "doc_id", "left_semi")
    parts = firsts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / HUB))).alias("part"), F.floor(F.col("n") / HUB).alias("last"))
    hubs = nodes.select(F.col("doc_id").alias("a"), F.floor(F.col("n") / HUB).alias("parts")).where("parts > 0")  # at most one in HUB links
    right = right.join(sized_broadcast(hubs, hubs.count(), NODES), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(0)) + 1))
    pairs = right.join(parts.drop("last"), ["a", "part"]).select("a", "b", "ta", "tb")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], "tb"):
                good = [similarity(x, y, words) >= least for x, y in zip(utf8(b, "ta"), utf8(b, "tb"), strict=True)]
                yield b.select(["a", "b"]).cast(schema).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, k: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links of at most ``k`` bits) of every row."""
    rows = stage(fingerprints(docs, words), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    n = distinct.count()
    roots = components(links(distinct.select("fp"), n, k))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "roots")
    # a component may hold much of all fingerprints, and a fingerprint much of all rows
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members"))
    named = stage(split_join(named, stage(least, "least"), "root", "members", n).select("fp", "n", "component_id"), "named")
    return split_join(rows, named, "fp", "n", n).select("doc_id", "fp", "component_id")
