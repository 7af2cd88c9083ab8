"""How far sources of one language differ in their words, over three-dimensional cells.

Terms are runs of letters (ASCII letters and all characters beyond ASCII; A-Z lower-cased). A language keeps the terms
in at least ``LEAST_DOCS`` of its documents. Every (language, source) group and every language gives each kept term the
smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by f = floor((p - q)^2 / (p + q)). All
arithmetic is on integers.

Cells. The cube of a language has two axes of blocks of groups and one of blocks of terms. A task owns cells
(group block, group block, term block): it gets the slices of both group blocks, replicated once for each block that they
meet, and sums f for all pairs of its groups over the terms that it sees. What a pair gets from terms that neither group has
is known beforehand (V times f of their shares at count 0), so a cell sums differences from it, and cells without rows need no
task. Partial sums are then added along the term axis. A cell holds at most 2 ``GROUPS`` times some ``TERMS`` numbers.

Nulls in text, lang and source count as empty; an empty language or source is a value like any other. Repeated rows are
documents of their own. Groups without terms have a row for each other source of their language. An empty table gives no
rows. Ties rank by the item's UTF-8 bytes. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.arrow import batch_of, slices, small_batches, split_words
from landloom.llm.staging import split_join, stage

#: Documents of a language that a kept term is in at least, and ranks that part ``term`` lists.
LEAST_DOCS, RANKS = 10, 10
#: Groups and (on average) terms of a block.
GROUPS, TERMS = 64, 2_048
#: Groups (some 100 bytes each) that are broadcast at most; more are met by shuffle joins.
BROADCAST_GROUPS = 100_000

#: ASCII other than letters becomes a space, A-Z become a-z.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _letters(values: pa.Array) -> pa.Array:
    """Texts (null: empty) with their terms apart by spaces: one pass over the whole column's bytes."""
    values = pc.fill_null(values.cast(pa.string()), "")
    _, offsets, data = values.buffers()
    return pa.StringArray.from_buffers(len(values), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_LETTERS)), offset=values.offset)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice: occurrences and documents by (lang, source, term), and a row without a term for each group."""
    for whole in batches:
        if not whole.num_rows:
            continue
        named = pa.RecordBatch.from_arrays([_letters(whole.column("text")), whole.column("lang"), whole.column("source")], names=["text", "lang", "source"])
        for b in slices([named]):
            starts, codes, distinct = split_words(b)
            pairs = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
            known = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
            group, kinds = np.fromiter(map(known.__getitem__, pairs), np.int64, len(pairs)), max(1, len(distinct))
            text = np.repeat(np.arange(len(pairs)), np.diff(starts))
            key, n = np.unique(group[text] * kinds + codes, return_counts=True)
            once = np.unique(text * kinds + codes)  # a row a document and term
            _, df = np.unique(group[once // kinds] * kinds + once % kinds, return_counts=True)
            langs, sources = (pa.array([p[i] for p in known], pa.string()) for i in (0, 1))
            of = pa.array(key // kinds)
            yield batch_of(_COUNTS, langs.take(of), sources.take(of), pa.array(distinct, pa.binary()).cast(pa.string()).take(pa.array(key % kinds)), pa.array(n), pa.array(df))
            yield batch_of(_COUNTS, langs, sources, pa.nulls(len(known), pa.string()), [0] * len(known), [0] * len(known))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and df (documents) of whole texts; each group also has a row whose term is null."""
    small_batches(docs.sparkSession)
    named = docs.select("text", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    found = named.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: str, total: str, kinds: str) -> Column:
    """p of a count among ``total`` over ``kinds`` terms; decimals hold the product for counts of any table."""
    return F.expr(f"cast(1 + (cast({count} + 2 as decimal(20,0)) * cast(1000000000 as decimal(10,0))) div cast({total} + 2 * {kinds} as decimal(20,0)) as bigint)")


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _by_group(rows: DataFrame, groups: DataFrame, few: bool, total: int) -> DataFrame:
    """``rows`` with their group's columns; a group may hold much of all rows."""
    if few:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    unit = F.struct("lang", "source")
    return split_join(rows.withColumn("unit", unit), groups.withColumn("unit", unit).drop("lang", "source"), "unit", "terms", total).drop("unit")


_PARTS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64())])


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _cell(size: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Partial sums of one cell for the pairs of its groups (a before b); blocks hold ``size`` groups. Rows without a term name the cell's groups."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, i, j, part = (k.as_py() for k in key)
        idx, p, term = rows.column("idx").to_numpy(), rows.column("p").to_numpy(), rows.column("term").combine_chunks().dictionary_encode()
        named = np.flatnonzero(rows.column("term").is_null().to_numpy())
        named = named[np.argsort(idx[named])]
        ids, rest, kinds = idx[named], p[named], rows.column("kinds").to_numpy()[named]
        seen = np.flatnonzero(rows.column("term").is_valid().to_numpy())
        shares = np.repeat(rest[:, None], len(term.dictionary), axis=1)
        shares[np.searchsorted(ids, idx[seen]), term.indices.take(pa.array(seen)).to_numpy()] = p[seen]
        out = []
        left, right = np.flatnonzero(ids // size == i), np.flatnonzero(ids // size == j)
        for a in left.tolist():
            others = right[right > a]
            absent = _gaps(rest[a], rest[others])
            sums = _gaps(shares[a], shares[others]).sum(1) - len(term.dictionary) * absent
            out.append((np.full(len(others), ids[a]), ids[others], sums + (kinds[a] * absent if part == 0 else 0)))
        a, b, sums = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.Table.from_batches([batch_of(_PARTS, [lang] * len(a), pa.array(a), pa.array(b), pa.array(sums))])

    return run


def pair_sums(kept: DataFrame, groups: DataFrame, size: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """lang, a, b (groups' numbers, a < b) and value of every pair of groups of one language. ``kept``: lang, source, term, idx, p and
    what ``groups`` has (lang, source, idx, in_lang, kinds, none: p of count 0)."""
    blocks, parts = F.ceil(F.col("in_lang") / size).cast("long"), F.ceil(F.greatest("kinds", F.lit(1)) / terms).cast("long")
    own = F.floor(F.col("idx") / size)
    named = groups.where("in_lang > 1").withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    named = named.select("lang", "idx", F.lit(None).cast("string").alias("term"), F.coalesce("none", F.lit(0)).alias("p"), "kinds", "tb", blocks.alias("blocks"))
    slices_ = kept.where("in_lang > 1").select("lang", "idx", "term", "p", "kinds", F.pmod(F.xxhash64("term"), parts).alias("tb"), blocks.alias("blocks"))
    dealt = slices_.unionByName(named).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "tb", "idx", "term", "p", "kinds")
    cells = dealt.groupBy("lang", "i", "j", "tb").applyInArrow(_cell(size), "lang string, a long, b long, part long")
    return cells.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, size: int = GROUPS, terms_of: int = TERMS, sent_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """lang, source, part, item, value and rank: each group's distances to the other sources of its language (part ``pair``), and the
    terms in which it most exceeds its language (part ``term``, ``RANKS`` of them). ``size`` groups and some ``terms_of`` terms are a block."""
    counts = stage(term_counts(docs), "counts")
    of_term = W.partitionBy("lang", "term")  # at most a row a source
    kept = counts.where("term is not null").withColumn("at", F.row_number().over(of_term.orderBy("source")))
    kept = kept.withColumns({"docs": F.sum("df").over(of_term), "all_n": F.sum("n").over(of_term)}).where(F.col("docs") >= least_docs)
    kept = stage(kept.select("lang", "source", "term", "n", "all_n", (F.col("at") == 1).alias("first")), "kept")
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("kinds"), F.sum("n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = counts.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["kinds", "lang_total", "total", "terms"])
    groups = groups.withColumns({"idx": (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long"), "in_lang": F.count("*").over(W.partitionBy("lang"))})
    groups = stage(groups.withColumn("none", F.when(F.col("kinds") > 0, share("0", "total", "kinds"))), "groups")
    few, total = groups.count() <= sent_groups, kept.count()
    told = stage(_by_group(kept, groups, few, total).withColumns({"p": share("n", "total", "kinds"), "q": share("all_n", "lang_total", "kinds")}), "shares")
    own = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = told.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= RANKS)
    both = pair_sums(told, groups, size, terms_of).select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h")), F.struct(F.col("b").alias("g"), F.col("a").alias("h")))).alias("x"))
    names = groups.select("lang", "idx", "source")
    sent = F.broadcast(names) if few else names
    pairs = both.select("lang", "value", F.col("x.g").alias("g"), F.col("x.h").alias("h")).join(sent.withColumnsRenamed({"idx": "g"}), ["lang", "g"]).join(sent.withColumnsRenamed({"idx": "h", "source": "item"}), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    return pairs.unionByName(terms)
