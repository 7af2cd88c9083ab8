"""Alignment of two tokenizers' ids over the same bytes.

A is a byte-level BPE (tokenizers library, over a space and the text), B a sentencepiece BPE (which adds the space). The
cumulative byte ends of both id lists are put into dictionaries from end to index; the ends found in both, sorted, cut
the lists into groups; within a group every two tokens whose bytes overlap are linked (a slice's distinct units stand behind each other in one such run). An id pair's count is the number of
links that hold it in the whole corpus.

Units. A space that follows a character other than white space begins a new token in A (its pattern takes spaces in front
only) and in B (no piece has a space behind another character, which is checked), so texts are cut there, but for a space at a text's end, and
each distinct unit of a slice is encoded and aligned once; groups and links of a text are those of its units in order.

Corpus counts. Each slice of texts is written with its units and its distinct pairs. Pairs are summed over the corpus (at most
the product of the vocabularies, and few in fact; broadcast only behind a count) and answered to their slices, which then
sum them over units and texts. Nothing of the corpus is held by one task.

Null and empty texts, and texts whose ids don't give back the same bytes (B reads U+2581 as a space), have no tokens: zeros and
an empty digest. Repeated rows count and are answered each. Ties for an id's highest count are all best. An empty table gives no
rows. Other columns aren't read. A task holds one slice; a text without spaces is one unit, in memory that follows its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, pack, slices, unpack
from landloom.llm.staging import sized_broadcast, stage, texts

#: Distinct id pairs (some 60 bytes each) that are broadcast at most; more go by a shuffle join.
BROADCAST_PAIRS = 1_000_000
#: Text of a slice, and distinct units that are aligned at once.
SLICE, PART = 8 << 20, 32_768


class Vocabulary:
    """Both tokenizers and the bytes of each of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        # the printable stand-ins of byte-level vocabularies: printable characters stand for themselves, other bytes for 256 upwards
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {c: c for c in own} | {256 + i: b for i, b in enumerate(b for b in range(256) if b not in set(own))}
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[ord(c)] for c in piece) if all(ord(c) in byte_of for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.name = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.a_size, self.b_size = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece has a space behind another character: texts can't be cut at spaces")

    def encode(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers for each unit (text that begins with a space)."""
        return list(zip((e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)), self.b.encode([u[1:] for u in units], num_threads=1), strict=True))


@lru_cache(2)
def vocabulary(a_path: str, b_path: str) -> Vocabulary:
    return Vocabulary(a_path, b_path)


def ends(sizes: np.ndarray) -> dict[int, int]:
    """From each cumulative end to the index behind its token."""
    return dict(zip(np.cumsum(sizes).tolist(), range(1, len(sizes) + 1), strict=True))


def align(a: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of two lists of token sizes over the same bytes: groups (from and to in a, from and to in b), and links (indices of tokens that overlap), by group."""
    of_a, of_b = ends(a), ends(b)
    common = sorted(of_a.keys() & of_b.keys())
    to_a, to_b = (np.fromiter(map(of.__getitem__, common), np.int64, len(common)) for of in (of_a, of_b))
    from_a, from_b = (np.append(0, to[:-1]) if len(to) else to for to in (to_a, to_b))
    n_a, n_b = to_a - from_a, to_b - from_b
    # every end in a group closes one overlap: of m and n tokens there are m + n - 1, as only the last ends are common
    n = n_a + n_b - 1
    group = np.repeat(np.arange(len(common)), n)
    place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    x, y = from_a[group] + np.where(n_b[group] == 1, place, 0), from_b[group] + np.where(n_a[group] == 1, place, 0)
    several = np.flatnonzero((n_a > 1) & (n_b > 1))
    if len(several):
        end_a, end_b, own = np.cumsum(a), np.cumsum(b), np.isin(group, several)
        inside = lambda start, size: np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        closed = np.sort(np.concatenate([end_a[inside(from_a[several], n_a[several])], end_b[inside(from_b[several], n_b[several] - 1)]]))
        x[own], y[own] = np.searchsorted(end_a, closed), np.searchsorted(end_b, closed)
    return [from_a, to_a, from_b, to_b], (x, y)


class Aligned:
    """Distinct units (each begins with a space): whether both tokenizers give their bytes (``good``), numbers of ids and groups, groups as text, and links
    (A's id times 2**32 plus B's) with their number by unit. ``PART`` units at once are aligned as one run of bytes: each ends where both tokenizers end."""

    def __init__(self, units: list[str], v: Vocabulary):
        parts = [self._part(units[at : at + PART], v) for at in range(0, len(units), PART)]
        none = np.zeros(0, np.int64)
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.links = (np.concatenate([none.astype(bool) if k == 0 else none, *(p[k] for p in parts)]) for k in range(6))
        self.groups = [g for p in parts for g in p[6]]

    @staticmethod
    def _part(units: list[str], v: Vocabulary) -> tuple:
        ids = v.encode(units)
        raw = [u.encode() for u in units]
        good = np.ones(len(units), bool)
        if b"".join([v.a_bytes[i] for a, _ in ids for i in a]) != b"".join(raw) or b"".join([v.b_bytes[i] for _, b in ids for i in b]) != b"".join(raw):
            good[:] = [b"".join([v.a_bytes[i] for i in a]) == r == b"".join([v.b_bytes[i] for i in b]) for (a, b), r in zip(ids, raw, strict=True)]
        some = np.flatnonzero(good)
        kept = [ids[k] for k in some.tolist()]
        a, b = (np.fromiter((i for x in kept for i in x[side]), np.int64) for side in (0, 1))
        (from_a, to_a, from_b, to_b), (x, y) = align(v.a_size[a], v.b_size[b])
        last = np.cumsum([len(p) for p, _ in kept], dtype=np.int64)  # of each unit's ids in a
        n_a, n_b, n_groups, n_links = (np.zeros(len(units), np.int64) for _ in range(4))
        n_a[some], n_b[some] = [len(p) for p, _ in kept], [len(q) for _, q in kept]
        n_groups[some] = np.bincount(np.searchsorted(last, to_a), minlength=len(some))
        n_links[some] = np.bincount(np.searchsorted(last, x, "right"), minlength=len(some))
        name_a, name_b = [v.name[i] for i in a.tolist()], [v.name[i] for i in b.tolist()]
        texts = [",".join(name_a[i:k]) + "|" + ",".join(name_b[j:m]) for i, k, j, m in zip(*(g.tolist() for g in (from_a, to_a, from_b, to_b)), strict=True)]
        cuts = np.append(0, np.cumsum(n_groups)).tolist()
        return good, n_a, n_b, n_groups, n_links, (a[x] << 32) + b[y], [";".join(texts[i:k]).encode() for i, k in zip(cuts[:-1], cuts[1:], strict=True)]


def units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's units begin (and the last's end), the units' codes, and the distinct units. Empty texts have none."""
    values = pc.fill_null(batch.column("text"), "")
    lists = pc.split_pattern(values, " ")
    sizes = np.where(pc.binary_length(values).to_numpy() > 0, pc.list_value_length(lists).to_numpy(), 0).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    if len(codes) > sizes.sum():  # an empty text is one empty part
        codes = codes[np.repeat(sizes > 0, pc.list_value_length(lists).to_numpy())]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    goes_on = np.fromiter((not p or p[-1].isspace() for p in parts), bool, len(parts))
    begins = np.ones(len(codes), bool)
    begins[1:] = ~goes_on[codes[:-1]]
    last = starts[1:][sizes > 0] - 1
    begins[last[np.fromiter((not p for p in parts), bool, len(parts))[codes[last]]]] = False  # a space at a text's end stays with what stands before it: alone, B would read an empty text
    begins[starts[:-1][sizes > 0]] = True
    at = np.append(np.flatnonzero(begins), len(codes))
    own = codes[at[:-1]]
    distinct = [f" {p}" for p in parts]
    known: dict[tuple, int] = {}
    for k in np.flatnonzero(np.diff(at) > 1).tolist():  # several parts with runs of white space between
        key = tuple(codes[at[k] : at[k + 1]].tolist())
        if key not in known:
            known[key] = len(distinct)
            distinct.append(" " + " ".join(parts[c] for c in key))
        own[k] = known[key]
    used, own = np.unique(own, return_inverse=True)
    return np.concatenate([[0], np.cumsum(begins)])[starts], own, [distinct[i] for i in used.tolist()]


_OUT = pa.schema([("slice", pa.int64()), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])
_ROWS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _aligner(a_path: str, b_path: str):
    """Of each slice: a packed row of its texts (place -1), and a row for each distinct pair with its links in the slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, number = vocabulary(a_path, b_path), TaskContext.get().partitionId() << 32
        for b in slices(batches, most=SLICE):
            if not b.num_rows:
                continue
            starts, codes, distinct = units(b)
            found = Aligned(distinct, v)
            size, n = np.diff(starts), b.num_rows
            text = np.repeat(np.arange(n), size)
            bad = np.zeros(n, bool)
            bad[text[~found.good[codes]]] = True
            live = ~bad[text]
            totals = [np.bincount(text[live], x[codes[live]], n).astype(np.int64) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            said = found.groups
            digests = ["" if bad[i] or a == z else hashlib.sha256(b";".join(map(said.__getitem__, codes[a:z].tolist()))).hexdigest() for i, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))]
            rows = pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, totals), pa.array(digests, pa.string())], names=list(_ROWS))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            head = sink.getvalue().to_pybytes()
            # links of each distinct unit by their place among the slice's distinct pairs; then units by text, with their number
            pairs, place = np.unique(found.links, return_inverse=True)
            per_unit = found.n_links
            used = np.bincount(codes[live], minlength=len(distinct))
            key, times = np.unique(text[live] * max(1, len(distinct)) + codes[live], return_counts=True)
            body = pack([per_unit, place, np.diff(key, prepend=0), times])
            sums = np.bincount(place, np.repeat(used, per_unit), len(pairs)).astype(np.int64)
            yield batch_of(_OUT, [number], [-1], [None], [None], [len(head).to_bytes(4, "little") + head + body])
            yield batch_of(_OUT, pa.array(np.full(len(pairs), number)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(sums), pa.nulls(len(pairs), pa.binary()))
            number += 1

    return run


_DONE = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers by ``of`` (sorted)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[np.searchsorted(of, np.arange(n), "right")] - total[np.searchsorted(of, np.arange(n))]


def _answer(rows: pa.Table) -> pa.Table:
    """A slice's texts with their links' counts summed."""
    place = rows.column("place").to_numpy()
    payload = rows.column("payload")[int(np.flatnonzero(place < 0)[0])].as_py()
    size = int.from_bytes(payload[:4], "little")
    docs = pa.ipc.open_stream(payload[4 : 4 + size]).read_next_batch()
    per_unit, of_link, steps, times = (x.astype(np.int64) for x in unpack(payload[4 + size :], 4))
    own = np.flatnonzero(place >= 0)
    own = own[np.argsort(place[own])]
    unit = np.repeat(np.arange(len(per_unit)), per_unit)
    kinds = max(1, len(per_unit))
    key = np.cumsum(steps)
    out = []
    for name in ("best", "count"):
        value = rows.column(name).to_numpy()[own].astype(np.int64)
        by_unit = _sums(unit, value[of_link], len(per_unit))
        out.append(pa.array(_sums(key // kinds, by_unit[key % kinds] * times, docs.num_rows)))
    return pa.Table.from_batches([batch_of(_DONE, *(docs.column(c) for c in _ROWS[:5]), *out, docs.column("groups_sha256"))])


def align_corpus(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all texts, and the corpus's pairs
    (pair: A's id times 2^32 plus B's, count, best: 1 if no other A id is linked to the B id more often)."""
    schema = "slice long, place int, pair long, n long, payload binary"
    done = stage(texts(docs).mapInArrow(_aligner(a_path, b_path), schema), "slices")
    linked = done.where("place >= 0").select("slice", "place", "pair", "n")
    counts = linked.groupBy("pair").agg(F.sum("n").alias("count")).where("count > 0")
    highest = F.max("count").over(W.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    pairs = stage(counts.withColumn("best", (F.col("count") == highest).cast("int")), "pairs")
    met = linked.join(sized_broadcast(pairs, pairs.count(), broadcast_pairs), "pair", "left").select("slice", "place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(0)).alias("best"), F.lit(None).cast("binary").alias("payload"))
    heads = done.where("place < 0").select("slice", "place", F.lit(0).cast("long").alias("count"), F.lit(0).alias("best"), "payload")
    rows = heads.unionByName(met).groupBy("slice").applyInArrow(_answer, ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in _DONE))
    return rows, pairs
