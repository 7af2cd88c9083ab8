"""Language-model scores by a weighted backoff automaton.

Model. States are the contexts of ``order`` - 1 words (a text begins with as many begin marks) and the state of no
words. A training text's n-gram (h, w) is an arc of state h with the weight (c(hw) - D) / c(h); every state h has a
failure arc to the state of no words, whose arcs are the single words, p1(w) = (c + 0.5) / (N + 0.5 (V + 1)). D is
0.95, 0.8 and 0.8 for n-grams seen once, twice and more often, and the failure arc's weight g(h) is what the
discounts leave, so p(w | h) = (c(hw) - D) / c(h) + g(h) p1(w) sums to one in every state. A state that training has
not seen fails at once. No n-gram is left out at any size of the corpus: the model is all that the texts hold.

Steps. One left-to-right pass over a text makes a step (state, word) a token; its score is the sum of its steps'
log10 p. Steps aren't looked up in a model that every task holds, but meet it: they go, sorted, packed and compressed
by a slice of texts, to the bucket of their state's hash. A bucket counts the steps of training texts, which is its
part of the automaton, weighs all steps and answers each slice with sums by text. The number of buckets follows the
number of tokens (``BUCKET``), so a task's memory doesn't.

Hot states. States that would fill a good part of a bucket are found from a sample of steps; their steps are dealt
by (state, word), and their totals are counted beforehand. This only spreads the load: scores don't depend on it.

Words. The most frequent words (at most ``SENT``, bounded) are sent to every task; steps on other words are answered
with their arc's weights, and meet the table of word counts in a shuffle join. States are told apart by their hashes'
leading bits, 24 more than the logarithm of the number of tokens, up to 64; words by 64 bits.

Null and empty texts are one end token. Without training texts p1 is 1 and every score 0. Repeated rows each count
and are scored. Null ids are hashed as the empty text. An empty table gives no rows. Slices are numbered by place, so
a task that is run again must read its texts in the same order, as tables read from files are. Sums travel as 32-bit
floats: a score is right to some 1e-7 of its size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, pack, slices, split_words, unpack
from landloom.llm.staging import crc_bucket, stage

#: Text of a slice, distinct words that a task counts before it passes them on, steps of a bucket, words sent to every task.
SLICE, COUNTED, BUCKET, SENT = 4 << 20, 400_000, 1_000_000, 500_000
#: One step of 2**SAMPLE is looked at for hot states; a state is hot from so many hits (some 2**18 steps); at most so many are hot.
SAMPLE, HOT, MOST_HOT = 13, 32, 500_000
DISCOUNTS = (0.95, 0.8, 0.8)
#: Seed of Spark's xxhash64, the keys of begin and end (no word holds a space), and the base of the states' polynomial.
SEED = 42
BEGIN, END = (xxhash.xxh64_intdigest(x, SEED) for x in (b" begin", b" end"))
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """What is sent to every task: keys of the frequent words (sorted) and their ranks, and their training counts by rank."""

    keys: np.ndarray
    ranks: np.ndarray
    n: np.ndarray
    total: int
    distinct: int

    def p1(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Rank of each key, -1 of a word that wasn't sent."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@dataclass
class Hot:
    """States that are dealt by (state, word): sorted hashes, and c(h) and g(h) of each."""

    states: np.ndarray
    n: np.ndarray
    fail: np.ndarray

    def find(self, state: np.ndarray) -> np.ndarray:
        if not len(self.states):
            return np.full(len(state), -1, np.int64)
        at = np.minimum(np.searchsorted(self.states, state), len(self.states) - 1)
        return np.where(self.states[at] == state, at, -1)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys, np.uint64).view(np.int64))


@dataclass
class Steps:
    """All steps of a slice of texts: state, index of the word among the slice's distinct ones (``keys``), and text."""

    states: np.ndarray
    words: np.ndarray
    texts: np.ndarray
    keys: np.ndarray
    distinct: list[bytes]


def steps(batch: pa.RecordBatch, order: int) -> Steps:
    starts, codes, distinct = split_words(batch, lower=True)
    keys = np.append(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct)), np.uint64(END))
    n, pad = len(starts) - 1, order - 1
    begins = starts[:-1] + (pad + 1) * np.arange(n)
    ends = starts[1:] + (pad + 1) * np.arange(n) + pad
    flat = np.empty(len(codes) + n * (pad + 1), np.uint64)
    step = np.ones(len(flat), bool)
    for i in range(pad):
        step[begins + i] = False
    word = np.full(len(flat), len(distinct), np.int64)
    inner = step.copy()
    inner[ends] = False
    word[inner] = codes
    flat[step], flat[~step] = keys[word[step]], BEGIN
    state = np.zeros(len(flat), np.uint64)
    for i in range(pad, 0, -1):
        state[i:] = state[i:] * BASE + flat[:-i]
    return Steps(state[step], word[step], np.repeat(np.arange(n), np.diff(starts) + 1), keys, distinct)


_COUNTS = pa.schema([("word", pa.string()), ("state", pa.int64()), ("train", pa.int64()), ("n", pa.int64())])


def _counter(order: int, sample: int):
    """Words with their training and whole counts, and a sample of the steps' states."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def passed() -> pa.RecordBatch:
            return batch_of(_COUNTS, [w.decode() for w in seen], pa.nulls(len(seen), pa.int64()), [t for t, _ in seen.values()], [n for _, n in seen.values()])

        for b in slices(batches, most=SLICE):
            if not b.num_rows:
                continue
            s = steps(b, order)
            trained = ~b.column("held_out").to_numpy(zero_copy_only=False)[s.texts]
            kinds = len(s.keys)
            for w, t, n in zip(s.distinct, np.bincount(s.words[trained], minlength=kinds).tolist(), np.bincount(s.words, minlength=kinds).tolist(), strict=False):
                own = seen.setdefault(w, [0, 0])
                own[0] += t
                own[1] += n
            if len(seen) >= COUNTED:
                yield passed()
                seen = {}
            at = np.arange(len(s.states), dtype=np.uint64) * BASE >> np.uint64(64 - sample) == 0 if sample else slice(None)
            state, n = np.unique(s.states[at], return_counts=True)
            yield batch_of(_COUNTS, pa.nulls(len(state), pa.string()), _signed(state), [0] * len(state), pa.array(n))
        yield passed()

    return run


def _hot_counter(order: int, states: np.ndarray):
    schema = pa.schema([("hot", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])
    find = Hot(states, states, states).find

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            if b.num_rows:
                s = steps(b, order)
                hot = find(s.states)
                pair, n = np.unique(hot[hot >= 0] * len(s.keys) + s.words[hot >= 0], return_counts=True)
                yield batch_of(schema, pa.array(pair // len(s.keys)), _signed(s.keys[pair % len(s.keys)]), pa.array(n))

    return run


_PACKED = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_DOCS, _COLD, _HOT, _SUMS, _RARE = range(5)


def _stepper(sent, hot, order: int, placed, bits: int):
    """By slice of texts: its rows, and its steps packed by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hots, places, number = sent.value, hot.value, placed.value, TaskContext.get().partitionId() << 32
        n_sent, buckets = len(words.keys), len(places)
        for b in slices(batches, most=SLICE):
            if not b.num_rows:
                continue
            s = steps(b, order)
            rank = words.find(s.keys)
            p1 = words.p1(np.where(rank >= 0, words.n[rank], 0))
            base, known = np.where(rank >= 0, np.log10(p1), 0.0)[s.words], ((rank >= 0) & (words.n[rank] > 0))[s.words]
            texts = b.num_rows
            rows = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(np.bincount(s.texts, minlength=texts)), pa.array(np.bincount(s.texts, known, texts).astype(np.int64)), pa.array(np.bincount(s.texts, base, texts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            made = [(int(places[(number * int(BASE) >> 32) % buckets]), _DOCS, sink.getvalue().to_pybytes())]
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            # a word is its rank, or if it wasn't sent, its place among the slice's other words behind them
            other = np.flatnonzero(rank < 0)
            code = rank.copy()
            code[other] = n_sent + np.arange(len(other))
            where = hots.find(s.states)
            for kind, own in ((_COLD, np.flatnonzero(where < 0)), (_HOT, np.flatnonzero(where >= 0))):
                key = s.states[own] >> np.uint64(64 - bits)
                route = s.states[own] if kind == _COLD else (s.states[own] ^ s.keys[s.words[own]]) * BASE
                bucket = ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                by = np.lexsort((key, bucket))
                key, bucket, own = (key if kind == _COLD else where[own].astype(np.uint64))[by], bucket[by], own[by]
                if kind == _HOT:
                    by = np.lexsort((key, bucket))
                    key, bucket, own = key[by], bucket[by], own[by]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                    if z > a:
                        word, text = code[s.words[own[a:z]]], s.texts[own[a:z]]
                        rare, at = np.unique(word[word >= n_sent], return_inverse=True)
                        word[word >= n_sent] = n_sent + at
                        made.append((int(places[bucket[a]]), kind, pack([np.diff(key[a:z], prepend=np.uint64(0)), word, 2 * text + held[text], s.keys[other[rare - n_sent]]])))
            yield batch_of(_PACKED, [number] * len(made), *(list(c) for c in zip(*made, strict=True)))
            number += 1

    return run


def own_partitions(spark: SparkSession, parts: int) -> np.ndarray:
    """A number for each of ``parts`` partitions that Spark's hash deals there, so that each bucket has a partition of its own."""
    tried = spark.range(parts * (12 + parts.bit_length())).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part"))
    found = tried.groupBy("part").agg(F.min("id").alias("id")).toArrow()  # a row a partition
    out = -1 - np.arange(parts)  # any other number for partitions that none was found for
    out[found.column("part").to_numpy()] = found.column("id").to_numpy()
    return out


_ANSWERS = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("row", pa.int64()), ("key", pa.int64()), ("arc", pa.float64()), ("fail", pa.float64())])


def _answers(kind: int, slices_: list, payloads: list | None = None, rows: list | None = None) -> pa.RecordBatch:
    n = len(slices_)
    row, key, arc, fail = rows or [pa.nulls(n, f.type) for f in list(_ANSWERS)[3:]]
    return batch_of(_ANSWERS, pa.array(slices_, pa.int64()), pa.array(np.full(n, kind, np.int32)), payloads or pa.nulls(n, pa.binary()), row, key, arc, fail)


def _weigh(state: np.ndarray, word: np.ndarray, trained: np.ndarray, hot: Hot | None, discounts: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Of each step: its arc's weight over its state's failure weight, and the failure weight (0 and 1 if training has not seen the state)."""
    by = np.lexsort((word, state))
    s, w, t = state[by], word[by], trained[by]
    new_state = np.append(True, s[1:] != s[:-1])
    new_arc = new_state | np.append(True, w[1:] != w[:-1])
    arc, own = np.cumsum(new_arc) - 1, (np.cumsum(new_state) - 1)
    n = np.bincount(arc, t).astype(np.int64)  # training steps an arc
    less = np.where(n > 0, np.array([0.0, *discounts])[np.minimum(n, 3)], 0.0)
    of = own[np.flatnonzero(new_arc)]  # state of each arc
    if hot is None:
        total = np.bincount(of, n)
        fail = np.divide(np.bincount(of, less), total, out=np.ones(len(total)), where=total > 0)
    else:
        total, fail = (x[s[np.flatnonzero(new_state)].astype(np.int64)] for x in (hot.n, hot.fail))
    weight = np.divide(n - less, (total * fail)[of], out=np.zeros(len(n)), where=n > 0)
    arcs, fails = np.empty(len(state)), np.empty(len(state))
    arcs[by], fails[by] = weight[arc], fail[own]
    return arcs, fails


def _weigher(sent, hot, discounts: tuple[float, float, float]):
    """Over packed steps sorted by bucket: sums by text for every slice, and steps on words that weren't sent."""

    def settle(words: Words, hots: Hot, kind: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        n_sent = len(words.keys)
        parts = [unpack(p, 4) for _, p in held]
        state = np.concatenate([np.cumsum(d) for d, *_ in parts])
        text = np.concatenate([t for _, _, t, _ in parts]).astype(np.int64)
        rare, at = np.unique(np.concatenate([r for *_, r in parts]), return_inverse=True)
        firsts = np.cumsum([0, *(len(r) for *_, r in parts)])
        word = np.concatenate([w for _, w, _, _ in parts]).astype(np.int64)
        other = np.flatnonzero(word >= n_sent)  # their places among a payload's other words become places in ``rare``
        word[other] = n_sent + at[word[other] - n_sent + np.repeat(firsts[:-1], [len(d) for d, *_ in parts])[other]]
        arc, fail = _weigh(state, word, text % 2 == 0, hots if kind == _HOT else None, discounts)
        of = np.repeat(np.arange(len(parts)), [len(d) for d, *_ in parts])
        text >>= 1
        known = word < n_sent
        if known.any():
            value = np.log10(fail[known]) + np.log10(words.p1(words.n[word[known]]) + arc[known])
            wide = int(text.max()) + 1
            place, back = np.unique(of[known] * wide + text[known], return_inverse=True)
            sums = np.bincount(back, value).astype("<f4").view("<u4")
            cuts = np.searchsorted(place, np.arange(len(parts) + 1) * wide)
            some = [(held[i][0], pack([place[a:z] - i * wide, sums[a:z]])) for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if z > a]
            yield _answers(_SUMS, [i for i, _ in some], [p for _, p in some])
        if not known.all():
            own = np.flatnonzero(~known)
            ids = np.array([i for i, _ in held], np.int64)[of[own]]
            yield _answers(_RARE, ids, None, [pa.array(text[own]), _signed(rare[word[own] - n_sent]), pa.array(arc[own]), pa.array(fail[own])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hots, now, held = sent.value, hot.value, None, []
        for b in batches:
            for number, bucket, kind, payload in zip(*(b.column(c).to_pylist() for c in ("slice", "bucket", "kind", "payload")), strict=True):
                if kind == _DOCS:
                    yield _answers(_DOCS, [number], [payload])
                    continue
                if now != (bucket, kind) and held:
                    yield from settle(words, hots, now[1], held)
                    held = []
                now = (bucket, kind)
                held.append((number, payload))
        if held:
            yield from settle(words, hots, now[1], held)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over answers sorted by slice and kind: a row a text."""
    now = rows = known = base = score = None

    def done() -> pa.RecordBatch:
        return batch_of(_SCORED, rows.column("doc_id"), rows.column("held_out"), rows.column("n_tokens"), pa.array(known), pa.array(base), pa.array(score))

    for b in batches:
        number, kind = b.column("slice").to_numpy(), b.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
            if z == a:
                continue
            own = b.slice(a, z - a)
            if number[a] != now:
                if now is not None:
                    yield done()
                now = number[a]
                rows = pa.ipc.open_stream(own.column("payload")[0].as_py()).read_next_batch()
                known, base = (rows.column(c).to_numpy(zero_copy_only=False).copy() for c in ("n_known", "base"))
                score = np.zeros(len(base))
            elif kind[a] == _SUMS:
                for p in own.column("payload").to_pylist():
                    place, value = unpack(p, 2)
                    score[place.astype(np.int64)] += value.astype("<u4").view("<f4")
            if kind[a] == _RARE:
                at = own.column("row").to_numpy()
                np.add.at(known, at, own.column("known").to_numpy())
                np.add.at(base, at, own.column("base").to_numpy())
                np.add.at(score, at, own.column("value").to_numpy())
    if now is not None:
        yield done()


def train_and_score(docs: DataFrame, held_out: int = 1, order: int = 3, discounts: tuple[float, float, float] = DISCOUNTS, sent_words: int = SENT, bucket: int = BUCKET, sample: int = SAMPLE, hot_from: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows whose crc32(doc_id) mod 5 isn't ``held_out`` are learnt from.

    ``sent_words``, ``bucket``, ``sample`` and ``hot_from`` only say how the work is dealt.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (crc_bucket() == held_out).alias("held_out"))
    counts = rows.select("text", "held_out").mapInArrow(_counter(order, sample), "word string, state long, train long, n long")
    counts = stage(counts.groupBy("word", "state").agg(F.sum("train").alias("train"), F.sum("n").alias("n")), "counts")
    table = counts.where("word is not null").select(F.xxhash64("word").alias("key"), "train", "n")
    facts = table.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    texts = rows.agg(F.count_if(~F.col("held_out")).alias("train"), F.count("*").alias("n")).first()
    frequent = table.orderBy(F.desc("n"), "key").limit(sent_words).toArrow()  # at most sent_words rows
    keys = np.append(frequent.column("key").to_numpy().astype(np.int64).view(np.uint64), np.uint64(END))
    by = np.argsort(keys)
    words = Words(keys[by], by, np.append(frequent.column("train").to_numpy(), texts["train"]), facts["n"] + texts["train"], facts["v"] + (texts["train"] > 0))
    found = counts.where("state is not null").where(F.col("n") >= hot_from).orderBy(F.desc("n"), "state").limit(MOST_HOT).select("state").toArrow()
    states = np.sort(found.column("state").to_numpy().astype(np.int64).view(np.uint64))
    hot = Hot(states, np.zeros(len(states)), np.ones(len(states)))
    if len(states):
        arcs = rows.where(~F.col("held_out")).select("text").mapInArrow(_hot_counter(order, states), "hot long, word long, n long").groupBy("hot", "word").agg(F.sum("n").alias("n"))
        less = F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])
        sums = arcs.groupBy("hot").agg(F.sum("n").cast("double").alias("n"), F.sum(less).alias("less")).toArrow()  # at most MOST_HOT rows
        at, n = sums.column("hot").to_numpy(), sums.column("n").to_numpy()
        hot.n[at], hot.fail[at] = n, sums.column("less").to_numpy() / n
    tokens = facts["all"] + texts["n"]
    buckets, bits = max(1, -(-tokens // bucket)), min(64, 24 + max(1, tokens).bit_length())
    sent, hots = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(hot)
    placed = spark.sparkContext.broadcast(own_partitions(spark, buckets))
    packed = rows.mapInArrow(_stepper(sent, hots, order, placed, bits), "slice long, bucket long, kind int, payload binary")
    answers = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_weigher(sent, hots, discounts), "slice long, kind int, payload binary, row long, key long, arc double, fail double")
    answers = stage(answers, "answers")
    other = table.where("train > 0").select("key", F.col("train").alias("c"))
    rare = answers.where(F.col("kind") == _RARE).join(other, "key", "left")
    p1 = (F.coalesce("c", F.lit(0)) + 0.5) / F.lit(words.total + 0.5 * (words.distinct + 1))
    rare = rare.select("slice", "kind", "payload", "row", F.col("c").isNotNull().cast("long").alias("known"), F.log10(p1).alias("base"), (F.log10("fail") + F.log10(p1 + F.col("arc"))).alias("value"))
    rest = answers.where(F.col("kind") != _RARE).select("slice", "kind", "payload", "row", F.lit(None).cast("long").alias("known"), F.lit(None).cast("double").alias("base"), F.lit(None).cast("double").alias("value"))
    scored = rest.unionByName(rare).repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(_assemble, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
