"""Exact join of texts by the Jaccard similarity of their sets of word shingles: a grouped prefix join.

Sets. A text's set holds 64-bit hashes of its distinct shingles; texts with equal sets (told apart by 128 bits) are one set
from then on. Two sets of similarity t or more share one of their first n - ceil(t n) + 1 elements (their prefix) in any
order that all sets keep.

Order. Rare elements come first, so that passages that many texts share stay out of prefixes. How rare an element is, is read
off a table of ``SLOTS`` counters, which is summed over all sets, sent to tasks as one byte a counter (the logarithm), and has this size
for any corpus. Elements of one slot look equally frequent and are ordered by hash; only time depends on the table, never a result.

Groups. Sets of one size and one prefix form a group, and a prefix element brings groups together (a list). Lists are cut where
the next larger size is too large for any pair; lists of one group are dropped, and lists of the same groups (copies share much of
their prefixes) are one; what is left is expanded to the groups' members, and each group of several members is a list of its own.

Positions. All common elements of two sets stand at or behind their first common one, so a pair is looked for only in lists where enough
elements are left in both sets from the list's element on. A set whose place leaves room for smaller sets alone (tight) never pairs with
another such set: a list without a loose member is dropped, and all pairs of a list means loose members with all.

Marks. A set also has a bitmap of ``BITS`` bits, each the parity of its elements that fall there. Bits in which two sets differ are at most as many as
elements that only one of them has, so a pair that differs in too many can't be similar: such pairs are never formed, and no text moves for them.

Links. Where few pairs of a list (``OPEN`` a member) are possible by sizes, places and bitmaps, whole texts of all of them are compared. Else of those that
span what they connect, found in the list's task by breadth-first search (a list of more than ``RUN`` members is dealt in chunks), so a family of copies gives
about a pair a member. A pair that is possible is mostly similar, but need not be: such a list is looked at again, in another order, with what is connected by then
taken as one, and after ``ROUNDS`` every pair of it that is possible and not yet connected is compared. So components are exact. Components are found by alternating stars.

Null and empty texts and texts without words have no set (size 0) and link with nothing. Texts of fewer words than a shingle have
one element, the whole sequence. Repeated rows share a component; null ids name one only if it has no other. An empty table gives no
rows. Ties of order go by hash. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, pack, slices, small_batches, split_words, unpack
from landloom.llm.components import components
from landloom.llm.staging import sized_broadcast, split_join, stage, texts

#: Counters of the table that orders elements, and of one of its segments.
SLOTS, SEGMENT = 1 << 24, 1 << 16
#: Rounds of spanning pairs at most, possible pairs for each member of a list up to which all are compared, and members of a list that a task holds.
ROUNDS, OPEN, RUN = 3, 2, 2_048
#: Bits of a set's bitmap.
BITS = 1_024
#: Groups of a list up to which it is told by its groups and not by its element.
TOLD = 4_096
#: What a task remembers of lists.
TOLD_BYTES = 100_000_000
#: Ids and digests of sets (some 60 bytes each) that are broadcast at most, and links of a set from which its text is dealt in parts.
BROADCAST_SETS, HUB = 500_000, 2_000
SEED = 42
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sets_of(batch: pa.RecordBatch, column: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's set begins (and the last's end), and the sets' elements, sorted within a set."""
    starts, codes, distinct = split_words(batch, column, lower=True)
    keys = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct))[codes]
    n = np.diff(starts)
    sizes = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), sizes)
    at = starts[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.minimum(n[text], words)  # words of the shingle
    h = left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.append(keys, np.zeros(words, np.uint64))
    for i in range(words):
        h = np.where(i < left, (h + padded[at + i]) * _BASE, h)
        h ^= h >> np.uint64(32)
    h = _mixed(h)
    by = np.lexsort((h, text))
    h, text = h[by], text[by]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=len(n)))]).astype(np.int64), h[first]


def _digests(starts: np.ndarray, elements: np.ndarray) -> list[bytes | None]:
    raw = elements.astype("<u8").tobytes()
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * z]) if z > a else None for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _fresh(digests: list[bytes | None], seen: set, most: int = 200_000) -> np.ndarray:
    """Which digests are new to a task (as far as it remembers)."""
    new = np.zeros(len(digests), bool)
    for i, d in enumerate(digests):
        if d is not None and d not in seen:
            new[i] = True
            if len(seen) < most:
                seen.add(d)
    return new


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("segment", pa.int32()), ("payload", pa.binary())])


def _sketcher(words: int):
    """Size and digest of each text's set; at a task's end, its part of the counters by segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros(SLOTS, np.uint16), set()
        for b in slices(batches):
            if not b.num_rows:
                continue
            starts, h = sets_of(b, "text", words)
            digests, size = _digests(starts, h), np.diff(starts)
            own = np.repeat(_fresh(digests, seen), size)
            slot, n = np.unique(h[own] & np.uint64(SLOTS - 1), return_counts=True)
            slot = slot.astype(np.int64)
            counters[slot] = np.minimum(counters[slot] + n, 65_535)  # of a task; more would say no more of an order
            yield batch_of(_SETS, b.column("doc_id"), pa.array(size), digests, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary()))
        for i in range(SLOTS // SEGMENT):
            part = counters[i * SEGMENT : (i + 1) * SEGMENT]
            at = np.flatnonzero(part)
            if len(at):
                yield batch_of(_SETS, [None], [None], [None], [i], [pack([np.diff(at, prepend=0), part[at]])])

    return run


_CLASSES = pa.schema([("segment", pa.int32()), ("classes", pa.binary())])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of segments, added as they come; the whole table's size bounds what a task holds."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for i, p in zip(b.column("segment").to_pylist(), b.column("payload").to_pylist(), strict=True):
            step, n = unpack(p, 2)
            held.setdefault(i, np.zeros(SEGMENT, np.uint64))[np.cumsum(step).astype(np.int64)] += n
    for i, n in held.items():
        yield batch_of(_CLASSES, [i], [np.ceil(4 * np.log2(n + 1.0)).astype(np.uint8).tobytes()])


def rareness(parts: DataFrame) -> np.ndarray:
    """Of each counter, four times the logarithm of how many sets it has met: ``SLOTS`` bytes, on the driver, at any size of the corpus."""
    found = parts.where("segment is not null").select("segment", "payload").repartition("segment").mapInArrow(_summed, "segment int, classes binary").toArrow()
    out = np.zeros(SLOTS, np.uint8)
    for i, c in zip(found.column("segment").to_pylist(), found.column("classes").to_pylist(), strict=True):
        out[i * SEGMENT : (i + 1) * SEGMENT] = np.frombuffer(c, np.uint8)
    return out


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(t n) + 1."""
    return n - (percent * n + 99) // 100 + 1


_POSTS = pa.schema([("element", pa.int64()), ("g", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("sig", pa.binary()), ("odd", pa.list_(pa.int64()))])


def _parities(starts: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` / 64 longs for each set."""
    n = len(starts) - 1
    text = np.repeat(np.arange(n), np.diff(starts))
    count = np.bincount(text * BITS + (elements >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=n * BITS).reshape(n, BITS)
    return np.packbits((count & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _poster(sent, words: int, percent: int):
    """Of each set new to the task, a row for each element of its prefix; the first also carries the digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = sent.value, set()
        for b in slices(batches):
            if not b.num_rows:
                continue
            starts, h = sets_of(b, "text", words)
            digests, size = _digests(starts, h), np.diff(starts)
            fresh = _fresh(digests, seen)
            odd = _parities(starts, h)
            text = np.repeat(np.arange(b.num_rows), size)
            own = fresh[text]
            h, text = h[own], text[own]
            by = np.lexsort((h, classes[(h & np.uint64(SLOTS - 1)).astype(np.int64)], text))
            h = h[by]
            some = np.flatnonzero(fresh)
            n, begin = size[some], np.cumsum(size[some]) - size[some]
            length = prefix_size(n, percent)
            of = np.repeat(np.arange(len(some)), length)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
            element = h[begin[of] + pos]
            raw, cuts = element.astype("<u8").tobytes(), np.append(0, np.cumsum(length)).tolist()
            group = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * z], k) for a, z, k in zip(cuts[:-1], cuts[1:], n.tolist(), strict=True)], np.uint64)
            sig, marks = [None] * len(of), [None] * len(of)
            for k, i in zip(cuts[:-1], some.tolist(), strict=True):
                sig[k], marks[k] = digests[i], odd[i]
            yield batch_of(_POSTS, pa.array(element.view(np.int64)), pa.array(group[of].view(np.int64)), pa.array(n[of].astype(np.int32)), pa.array(pos.astype(np.int32)), sig, marks)

    return run


_LISTS = pa.schema([("list", pa.int64()), ("g", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("sig", pa.binary()), ("odd", pa.list_(pa.int64()))])


def _lister(percent: int):
    """Over rows sorted by (element, n, g): runs of groups that sizes allow, with a loose one among them, each a list; and, list 0, every (g, sig) that was sent.

    A list is told by a hash of its groups, again only if a place is less than before. One of more than ``TOLD`` groups is told by its element and first size, and passed on as it comes.
    """

    def listed(name: int | np.ndarray, g: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        names = pa.array(np.broadcast_to(np.int64(name), len(g)).copy())
        return batch_of(_LISTS, names, pa.array(g), pa.array(n), pa.array(pos), pa.nulls(len(g), pa.binary()), pa.nulls(len(g), _LISTS.field("odd").type))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        held, long_name, seen, room = none, None, {}, TOLD_BYTES  # an open run's rows; its name once it is long; least places of lists told in this task
        for b in batches:
            if not b.num_rows:
                continue
            sent = b.filter(b.column("sig").is_valid())
            yield batch_of(_LISTS, [0] * sent.num_rows, sent.column("g"), sent.column("n"), [0] * sent.num_rows, sent.column("sig"), sent.column("odd"))
            new = [b.column(c).to_numpy() for c in ("element", "g", "n", "pos")]
            element, g, n, pos = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
            twice = np.zeros(len(g), bool)
            twice[1:] = (element[1:] == element[:-1]) & (g[1:] == g[:-1])
            element, g, n, pos = element[~twice], g[~twice], n[~twice], pos[~twice]
            joins = np.zeros(len(g), bool)  # to the row before
            joins[1:] = (element[1:] == element[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            starts = np.flatnonzero(~joins)
            size = np.diff(np.append(starts, len(g)))
            loose = np.logical_or.reduceat((100 + percent) * (n - pos).astype(np.int64) >= 2 * percent * n.astype(np.int64), starts)
            out = []
            for k in np.flatnonzero(size[:-1] > 1).tolist():  # whole runs of two or more; the last one may go on
                a, z = starts[k], starts[k] + size[k]
                if k == 0 and long_name is not None:
                    yield listed(long_name, g[a + 1 : z], n[a + 1 : z], pos[a + 1 : z])
                    continue
                if not loose[k]:
                    continue
                by = np.argsort(g[a:z])
                name, places = xxhash.xxh64_intdigest(g[a:z][by].tobytes()), pos[a:z][by]
                before = np.frombuffer(seen[name], np.int32) if name in seen else None
                if before is None or (places < before).any():
                    if before is not None:
                        seen[name] = np.minimum(places, before).tobytes()
                    elif room > 0:
                        seen[name] = places.tobytes()
                        room -= 200 + 4 * len(places)
                    out.append((name - (1 << 64) if name >> 63 else name, a, z))
            if out:
                at = np.concatenate([np.arange(a, z) for _, a, z in out])
                names = np.repeat(np.array([x for x, _, _ in out], np.int64), [z - a for _, a, z in out])
                yield listed(names, g[at], n[at], pos[at])
            last = starts[-1]
            if len(starts) > 1:
                long_name = None
            held = element[last:], g[last:], n[last:], pos[last:]
            if len(held[0]) > TOLD or long_name is not None:
                first = long_name is None
                if first:
                    long_name = xxhash.xxh64_intdigest(b"long" + element[last:][:1].tobytes() + n[last:][:1].tobytes()) >> 1
                yield listed(long_name, *(x[last + (0 if first else 1) :] for x in (g, n, pos)))
                held = element[-1:], g[-1:], n[-1:], pos[-1:]  # the next rows are held against it
        if len(held[0]) > 1:
            own = xxhash.xxh64_intdigest(np.sort(held[1]).tobytes())
            yield listed(own - (1 << 64) if own >> 63 else own, *held[1:])

    return run


def _possible(percent: int) -> Column:
    """Whether two sets' sizes (n, m), places in a list (pos, other_pos) and bitmaps (odd, other_odd) leave room for enough common elements."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("other_odd", F.lit(i)))) for i in range(BITS // 64)))
    sizes = 100 * F.least("n", "m").cast("long") >= percent * F.greatest("n", "m").cast("long")
    left = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("other_pos")).cast("long")
    return sizes & (left >= percent * (F.col("n") + F.col("m")).cast("long")) & ((100 + percent) * differ.cast("long") <= (100 - percent) * (F.col("n") + F.col("m")).cast("long"))


_SPANS = pa.schema([("list", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _spanner(percent: int, most: int, step: int):
    """Over rows sorted by (list, chunk): a list's possible pairs of sets that aren't connected, if they are at most ``most`` a member, else those that span
    what they connect and a row without pair, as for chunks of a list: it has to be looked at again."""

    def settle(name: int, whole: bool, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, pos, own = (np.concatenate([b.column(c).to_numpy() for b in rows]).astype(np.int64) for c in ("id", "n", "pos", "own"))
        odd = np.concatenate([b.column("odd").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64) for b in rows])
        by = np.argsort(_mixed(ids.view(np.uint64) + np.uint64(step) * _BASE))
        ids, n, left, odd = ids[by], n[by], (n - pos)[by], odd[by]
        kinds, own = np.unique(own[by], return_inverse=True)
        loose = (100 + percent) * left >= 2 * percent * n

        def possible(x: int, others: np.ndarray) -> np.ndarray:
            """Which of ``others`` (places) may be similar to ``x``."""
            m = n[others]
            ok = (own[others] != own[x]) & (100 * np.minimum(m, n[x]) >= percent * np.maximum(m, n[x])) & ((100 + percent) * np.minimum(left[others], left[x]) >= percent * (m + n[x]))
            others = others[ok & (loose[others] | loose[x])]
            differ = np.bitwise_count(odd[others] ^ odd[x]).sum(1, dtype=np.int64)
            return others[(100 + percent) * differ <= (100 - percent) * (n[others] + n[x])]

        def emit(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            a, b = np.repeat([x for x, _ in found], [len(y) for _, y in found]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(y for _, y in found)])
            return batch_of(_SPANS, [name] * len(a), pa.array(ids[a]), pa.array(ids[b]))

        found, room = [], most * len(ids)
        for x in range(len(ids) - 1 if len(kinds) > 1 else 0):
            near = possible(x, np.arange(x + 1, len(ids)))
            room -= len(near)
            if room < 0:
                break
            if len(near):
                found.append((x, near))
        if room < 0:
            found, open_ = [], np.arange(len(ids))
            while len(open_):
                frontier = np.flatnonzero(own == own[open_[0]]).tolist()
                open_ = open_[own[open_] != own[open_[0]]]
                while frontier and len(open_):
                    x = frontier.pop(0)
                    near = possible(x, open_)
                    if len(near):
                        kind, first = np.unique(own[near], return_index=True)
                        found.append((x, near[first]))
                        frontier.extend(np.flatnonzero(np.isin(own, kind)).tolist())
                        open_ = open_[~np.isin(own[open_], kind)]
        if found:
            yield emit(found)
        if room < 0 or not whole:
            yield batch_of(_SPANS, [name], [None], [None])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            name, chunk, chunks = (b.column(c).to_numpy() for c in ("list", "chunk", "chunks"))
            cuts = (np.flatnonzero((np.diff(name) != 0) | (np.diff(chunk) != 0)) + 1).tolist()
            for a, z in zip([0, *cuts], [*cuts, len(name)], strict=True):
                if z > a:
                    key = int(name[a]), int(chunk[a]), int(chunks[a])
                    if key != now and held:
                        yield from settle(now[0], now[2] == 1, held)
                        held = []
                    now = key
                    held.append(b.slice(a, z - a))
        if held:
            yield from settle(now[0], now[2] == 1, held)

    return run


def compared(known: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts (``known``: id, text) are similar. A hub's text is sent in parts; others are shuffled. Texts outside of the pairs stay where they are."""
    n = pairs.count()
    text_of = lambda c: known.join(sized_broadcast(pairs.select(F.col(c).alias("id")).distinct(), n, BROADCAST_SETS), "id", "left_semi").select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    hubs = stage(pairs.groupBy("a").agg(F.floor(F.count("*") / HUB).alias("parts")).where("parts > 0"), "hubs")  # at most one in HUB pairs
    sent = sized_broadcast(hubs, hubs.count(), BROADCAST_SETS)
    right = pairs.join(text_of("b"), "b")
    right = right.join(sent, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(0)) + 1)).drop("parts")
    left = text_of("a").join(sent, "a", "left").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(0)))).alias("part"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices([batch], "tb"):
                (s, x), (t, y) = sets_of(b, "ta", words), sets_of(b, "tb", words)
                row = [np.repeat(np.arange(b.num_rows), np.diff(k)) for k in (s, t)]
                both = np.concatenate([x, y])
                of = np.concatenate(row)
                by = np.lexsort((both, of))
                both, of = both[by], of[by]
                common = np.bincount(of[1:][(both[1:] == both[:-1]) & (of[1:] == of[:-1])], minlength=b.num_rows)
                good = 100 * common >= percent * (np.diff(s) + np.diff(t) - common)
                yield b.select(["a", "b"]).cast(schema).filter(pa.array(good))

    return left.join(right, ["a", "part"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """id and text of the sets in ``nodes`` (id, sig, doc_id): rows with that id whose text has that digest."""
    near = docs.withColumn("none", F.col("doc_id").isNull()).fillna(0, ["doc_id"])
    wanted = nodes.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none")).distinct()
    schema = pa.schema([("sig", pa.binary()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield batch_of(schema, _digests(*sets_of(b, "text", words)), b.column("text"))

    found = near.join(sized_broadcast(wanted, wanted.count(), BROADCAST_SETS), ["doc_id", "none"], "left_semi").select("text").mapInArrow(run, "sig binary, text string")
    ids = nodes.select("id", "sig")
    return found.join(sized_broadcast(ids, ids.count(), BROADCAST_SETS), "sig").groupBy("id").agg(F.first("text").alias("text"))


def distinct_sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rows (doc_id, n, sig) of ``docs`` (doc_id, text), distinct sets (id, sig, doc_id: the least, rows), and the counters' logarithms."""
    parts = stage(docs.mapInArrow(_sketcher(words), "doc_id long, n long, sig binary, segment int, payload binary"), "sets")
    rows = parts.where("segment is null").select("doc_id", "n", "sig")
    some = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    return rows, stage(some.withColumn("id", F.monotonically_increasing_id()), "distinct"), rareness(parts)


def candidate_lists(docs: DataFrame, sets: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """list, id, n, pos (of the list's element in the set) and odd: sets that share a prefix element, or a whole prefix, as members of the list's groups."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    posts = docs.mapInArrow(_poster(sent, words, percent), "element long, g long, n int, pos int, sig binary, odd array<bigint>")
    schema = "list long, g long, n int, pos int, sig binary, odd array<bigint>"
    found = stage(posts.repartition("element").sortWithinPartitions("element", "n", "g").mapInArrow(_lister(percent), schema), "lists")
    members = found.where("sig is not null").select("g", "n", "sig", "odd").dropDuplicates(["sig"]).join(sets.select("sig", "id"), "sig").select("g", "n", "id", "odd")
    members = stage(members, "members")
    alone = members.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    own = members.join(sized_broadcast(alone, alone.count(), BROADCAST_SETS), "g", "left_semi").select(F.xxhash64("g", F.lit("group")).alias("list"), "id", "n", F.lit(0).alias("pos"), "odd")
    shared = found.where("sig is null").groupBy("list", "g", "n").agg(F.min("pos").alias("pos"))
    groups = shared.select("g").distinct()
    inside = members.select("g", "id", "odd").join(sized_broadcast(groups, groups.count(), BROADCAST_SETS), "g", "left_semi")
    lists = shared.join(sized_broadcast(inside, inside.count(), BROADCAST_SETS), "g").select("list", "id", "n", "pos", "odd")
    return stage(lists.unionByName(own), "entries")


def similar_pairs(docs: DataFrame, words: int = 5, percent: int = 80, rounds: int = ROUNDS, open_pairs: int = OPEN) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, n, sig) of ``docs`` (doc_id, text), distinct sets (id, sig, doc_id, rows), and verified links (a, b) between sets that
    connect exactly what is connected at ``percent`` hundredths of similarity or more (None without candidates)."""
    rows, sets, classes = distinct_sets(docs, words)
    entries = candidate_lists(docs, sets, classes, words, percent)
    nodes = stage(entries.select("id").distinct().join(sets.select("id", "sig", "doc_id"), "id"), "nodes")
    if not nodes.count():
        return rows, sets, None
    known = stage(_texts_of(docs, nodes, words), "texts")
    links, tested, named = None, None, entries.withColumn("own", F.col("id"))
    loose = (100 + percent) * (F.col("n") - F.col("pos")).cast("long") >= 2 * percent * F.col("n").cast("long")
    for step in range(rounds + 1):
        lists = named.groupBy("list").agg(F.count("*").alias("size"), F.min("own").alias("least"), F.max("own").alias("most"), F.count_if(loose).alias("loose"))
        lists = stage(lists.where("least < most and loose > 0").select("list", "size"), "open")
        left = lists.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
        if not left["n"]:
            break
        mixed = named.join(F.broadcast(lists), "list") if left["n"] <= BROADCAST_SETS else split_join(named, lists, "list", "size", int(left["size"]))
        every = step == rounds
        if every:
            mixed = stage(mixed.drop("size"), "mixed")
            renamed = {"id": "b", "n": "m", "pos": "other_pos", "odd": "other_odd", "own": "other"}
            other = mixed.where(loose).select("list", *(F.col(c).alias(d) for c, d in renamed.items()))
            pairs = mixed.withColumn("tight", ~loose).withColumnRenamed("id", "a").join(other, "list")
            pairs = pairs.where((F.col("own") != F.col("other")) & (F.col("tight") | (F.col("a") < F.col("b")))).where(_possible(percent))
        else:
            dealt = mixed.withColumn("chunks", F.ceil(F.col("size") / RUN)).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(step)), "chunks")).drop("size")
            spans = dealt.repartition("list", "chunk").sortWithinPartitions("list", "chunk").mapInArrow(_spanner(percent, open_pairs, step), "list long, a long, b long")
            spans = stage(spans, "spans")
            pairs, again = spans.where("a is not null"), stage(spans.where("a is null").select("list").distinct(), "again")
        pairs = pairs.select("a", "b").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"])
        pairs = stage(pairs, "pairs")  # written before the anti join, which would else be moved to where a pair stands once a list
        pairs = pairs if tested is None else stage(pairs.join(tested, ["lo", "hi"], "left_anti"), "new_pairs")
        new = stage(compared(known, pairs.select("a", "b"), words, percent), "links")
        links = new if links is None else links.unionByName(new)
        if every or not (n := again.count()):
            break
        tested = pairs.select("lo", "hi") if tested is None else tested.unionByName(pairs.select("lo", "hi"))
        found = stage(components(links), "found")
        named = entries.join(sized_broadcast(again, n, BROADCAST_SETS), "list", "left_semi")
        named = named.join(sized_broadcast(found, found.count(), BROADCAST_SETS), named.id == found.node, "left").select(*entries.columns, F.coalesce("root", "id").alias("own"))
    return rows, sets, links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    small_batches(docs.sparkSession)
    rows, sets, links = similar_pairs(texts(docs), words, percent)
    named = sets.select("sig", "rows", "doc_id", F.col("id").alias("root"))
    if links is not None:
        roots = components(links)
        named = sets.join(roots, sets.id == roots.node, "left").select("sig", "rows", "doc_id", F.coalesce("root", "id").alias("root"))
    named = stage(named, "roots")
    n = named.count()
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    named = stage(split_join(named.drop("doc_id"), stage(least, "least"), "root", "members", n).select("sig", F.col("rows").alias("copies"), "component_id"), "named")
    met = split_join(rows, named, "sig", "copies", n, how="left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
