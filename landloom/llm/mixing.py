"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cells of (source, language, topic). Each sweep scales the cells to the target shares of
one dimension after the other, until all marginals fit; a cell's probability is what its tokens must be scaled by, at most 1, and
the bound stands inside the sweeps: what a cell at its bound can't give, others of its value give. So it is the expected sample
that fits the targets. Documents are then drawn by a hash of their id.

``rate`` is the share of all tokens to sample, and a ceiling: where a value has too few tokens for its target at that rate, the rate is
lowered, down to ``least_rate``. Values that still have too few are sampled whole, the others of their dimension scaled up alike.
``misfit`` is the largest difference between a value's target share and its share of the expected sample, and ``unmet``
names a row's dimensions whose value is more than ``MET`` off (because of its tokens, or because targets contradict each other).

Topics are clusters of texts: each text's words are hashed into ``DIM`` places, counted, and the counts' square roots
scaled to length one; spherical k-means over all texts, less their mean, finds ``TOPICS`` centres. Sums of a round are
made by tasks; TOPICS times DIM numbers reach the driver.

Null values of a dimension are a value of their own. Values without a target, or with target zero, get weight
zero; targets of values that no document has are left out and the others scaled up. Null and empty texts have
no tokens and are of the topic "empty", which has no share: they are not sampled. Repeated rows share one fate, and so do
rows without an id. An empty table gives no rows. Ties between centres go to the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.llm.arrow import batch_of, slices, split_words
from landloom.llm.staging import free_name, sized_broadcast, stage

DIMS = ("source", "lang", "topic")
#: Cells that are collected or broadcast to the documents at most; more go by joins.
BROADCAST_CELLS = 100_000
#: Share by which a target may be missed and still count as met, shares' error at which sweeps end, sweeps, and rates tried.
MET, ERROR, SWEEPS, TRIES = 1e-3, 1e-6, 300, 6
#: Places that words are hashed into, clusters, rounds, and texts that the first centres are picked from.
DIM, TOPICS, ROUNDS, SEEDS = 128, 8, 6, 256


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and hashed vector (length one, or zero) of each text."""
    starts, codes, distinct = split_words(batch, lower=True)
    place = np.fromiter((xxhash.xxh32_intdigest(w) % DIM for w in distinct), np.int64, len(distinct))
    n = len(starts) - 1
    text = np.repeat(np.arange(n), np.diff(starts))
    x = np.sqrt(np.bincount(text * DIM + place[codes], minlength=n * DIM).reshape(n, DIM))
    return np.diff(starts), (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("vector", pa.binary())])
    for b in slices(batches):
        if b.num_rows:
            n, x = vectors(b)
            yield batch_of(schema, b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(n), [v.tobytes() for v in x.astype(np.float16)])


class Topics:
    """The mean of all vectors and the clusters' centres."""

    def __init__(self, mean: np.ndarray, centres: np.ndarray):
        self.mean, self.centres = mean, centres

    def nearest(self, x: np.ndarray) -> np.ndarray:
        # sums along a row's own numbers: the same for a text in any batch
        return ((x - self.mean)[:, None, :] * self.centres).sum(-1).argmax(1)


def _vectors_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)


def _sums(rows: DataFrame, topics: Topics | None) -> np.ndarray:
    """Sums of the vectors (less the mean, scaled to one) of each cluster; of all as they are without topics."""
    sent = rows.sparkSession.sparkContext.broadcast(topics)
    schema = pa.schema([("cluster", pa.int64()), ("place", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, out = sent.value, np.zeros((TOPICS, DIM + 1))
        for b in batches:
            if b.num_rows:
                x = _vectors_of(b.column("vector"))
                own = np.zeros(len(x), np.int64)
                if t is not None:
                    own = t.nearest(x)
                    x = x - t.mean
                    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                x = np.hstack([x, np.ones((len(x), 1), np.float32)])
                for c in range(TOPICS):
                    out[c] += x[own == c].sum(0, dtype=np.float64)
        at = np.flatnonzero(out)
        yield batch_of(schema, pa.array(at // (DIM + 1)), pa.array(at % (DIM + 1)), pa.array(out.ravel()[at]))

    found = rows.where("n_tokens > 0").select("vector").mapInArrow(run, "cluster long, place long, value double").groupBy("cluster", "place").agg(F.sum("value").alias("v")).toArrow()
    out = np.zeros((TOPICS, DIM + 1))
    out[found.column("cluster").to_numpy(), found.column("place").to_numpy()] = found.column("v").to_numpy()
    return out


def fit_topics(rows: DataFrame, rounds: int = ROUNDS) -> Topics:
    """k-means over all vectors; the first centres are the farthest from each other among ``SEEDS`` texts picked by a hash."""
    whole = _sums(rows, None)[0]
    mean = (whole[:-1] / max(whole[-1], 1)).astype(np.float32)
    seeds = rows.where("n_tokens > 0").select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SEEDS).toArrow()
    x = _vectors_of(seeds.column("vector").combine_chunks()) - mean if seeds.num_rows else np.zeros((1, DIM), np.float32)
    x = np.unique(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12), axis=0)
    picked = [0]
    while len(picked) < min(TOPICS, len(x)):
        picked.append(int((x @ x[picked].T).max(1).argmin()))
    topics = Topics(mean, x[picked])
    for _ in range(rounds if whole[-1] else 0):
        sums = _sums(rows, topics)
        centres = sums[: len(topics.centres), :-1]
        norm = np.sqrt((centres * centres).sum(1, keepdims=True))
        topics = Topics(mean, np.where(norm > 1e-9, centres / np.maximum(norm, 1e-12), topics.centres).astype(np.float32))
    return topics


def _named(topics: Topics, n: np.ndarray, x: np.ndarray) -> list[str]:
    return [f"t{c}" if m else "empty" for c, m in zip(topics.nearest(x).tolist(), n.tolist(), strict=True)]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, n_tokens and vector of every row, written."""
    return stage(docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(_featured, "doc_id long, source string, lang string, n_tokens long, vector binary"), "features")


def with_topics(rows: DataFrame, topics: Topics) -> DataFrame:
    """Featured rows with ``topic`` instead of the vector."""
    sent = rows.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                named = _named(sent.value, b.column("n_tokens").to_numpy(), _vectors_of(b.column("vector")))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang", "n_tokens")), pa.array(named)], names=["doc_id", "source", "lang", "n_tokens", "topic"])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, topic string")


def cells_of(rows: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    return rows.groupBy(*dims).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("docs"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares (value, share): the present ones to a power, scaled to one."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("p").alias("all")))).select("value", (F.col("p") / F.greatest("all", F.lit(1e-300))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rate: float | None = None, sweeps: int = SWEEPS, error: float = ERROR, collected: int = BROADCAST_CELLS) -> DataFrame:
    """``cells`` with ``weight``: token weights that sum to ``rate`` of all tokens and fit every target's shares, at most a cell's tokens.
    Without a rate, weights sum to all tokens and have no bound.

    Up to ``collected`` cells (and target values) are fitted in arrays on the driver, more by joins: the same sweeps.
    """
    fit = (_Arrays if max(df.limit(collected + 1).count() for df in (cells, *targets.values())) <= collected else _Joins)(cells, targets)
    weight, off = fit.fitted(1.0 if rate is None else rate, rate is not None, sweeps, error)
    return fit.frame(weight).withColumn("misfit", F.lit(off))


def _filled(scale, reached, want: float) -> float:
    """The factor at which ``reached`` of it is ``want``: water-filling by fixed-point steps."""
    for _ in range(60):
        now = reached(scale)
        if now <= 0 or abs(now / want - 1) < 1e-9:
            break
        scale *= want / now
    return scale


class _Arrays:
    """Cells and targets as arrays on the driver."""

    def __init__(self, cells: DataFrame, targets: dict[str, DataFrame] | dict[str, dict]):
        self.cells, self.table = cells, cells.toArrow()
        self.tokens = self.table.column("tokens").to_numpy().astype(float)
        self.total, self.dims = self.tokens.sum(), {}
        for dim, target in targets.items():
            wanted = target if isinstance(target, dict) else {r.value: r.share for r in target.collect()}
            known: dict = {}
            codes = np.array([known.setdefault(v, len(known)) for v in self.table.column(dim).to_pylist()], np.int64)
            held = np.bincount(codes, self.tokens, len(known))
            share = np.where(held > 0, np.array([wanted.get(v) or 0.0 for v in known]), 0.0)
            self.dims[dim] = codes, held, share / max(share.sum(), 1e-300)

    def most(self) -> float:
        """The largest rate at which every value has tokens for its share."""
        return min((float((held[share > 0] / (share[share > 0] * self.total)).min()) for _, held, share in self.dims.values() if (share > 0).any()), default=1.0)

    def goals(self, rate: float, bounded: bool) -> dict[str, np.ndarray]:
        out = {}
        for dim, (_, held, share) in self.dims.items():
            bound = held if bounded else np.full(len(held), np.inf)
            want = rate * self.total
            scale = _filled(1.0, lambda x: np.minimum(bound, x * share * want).sum(), min(want, bound[share > 0].sum())) if want and share.any() else 0.0  # noqa: B023
            out[dim] = np.minimum(bound, scale * share * want)
        return out

    def fitted(self, rate: float, bounded: bool, sweeps: int, error: float) -> tuple[np.ndarray, float]:
        goals, factor = self.goals(rate, bounded), np.ones(len(self.tokens))
        give = lambda: self.tokens * (np.minimum(1, factor) if bounded else factor)
        for _ in range(sweeps if self.total else 0):
            worst = 0.0
            for dim, (codes, held, _) in self.dims.items():
                now = np.bincount(codes, give(), len(held))
                worst = max(worst, float(np.abs(now - goals[dim]).max(initial=0)) / max(rate * self.total, 1e-300))
                by = np.divide(goals[dim], now, out=np.zeros(len(held)), where=now > 0)
                factor = np.minimum(factor * by[codes], 1e30)
            if worst <= error:
                break
        return give(), self.off(give())

    def shares(self, weight: np.ndarray) -> dict[str, np.ndarray]:
        """By dimension, each value's share of the weights less its target."""
        return {dim: np.bincount(codes, weight, len(held)) / max(weight.sum(), 1e-300) - share for dim, (codes, held, share) in self.dims.items()}

    def off(self, weight: np.ndarray) -> float:
        return max((float(np.abs(x).max(initial=0)) for x in self.shares(weight).values()), default=0.0) if self.total else 0.0

    def unmet(self, weight: np.ndarray) -> pa.Array:
        far = {dim: np.abs(x)[self.dims[dim][0]] > MET for dim, x in self.shares(weight).items()}
        return pa.array([",".join(d for d in far if far[d][i]) for i in range(len(weight))], pa.string())

    def frame(self, weight: np.ndarray) -> DataFrame:
        return _frame(self.cells, self.table, {"weight": weight})

    def told(self, weight: np.ndarray) -> DataFrame:
        """Cells with their weight and ``unmet``."""
        return _frame(self.cells, self.table, {"weight": weight, "unmet": self.unmet(weight)})


class _Joins:
    """The same for any number of cells and values, by joins of written tables."""

    def __init__(self, cells: DataFrame, targets: dict[str, DataFrame]):
        self.cells = stage(cells, "cells")
        self.total = self.cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("t")).first()["t"]
        self.dims = {}
        for dim, target in targets.items():
            held = self.cells.groupBy(F.col(dim).alias("v")).agg(F.sum("tokens").alias("held"))
            goal = held.join(target, F.col("v").eqNullSafe(F.col("value")), "left").select("v", "held", F.when(F.col("held") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
            self.dims[dim] = stage(goal.crossJoin(F.broadcast(goal.agg(F.greatest(F.sum("share"), F.lit(1e-300)).alias("of")))).select("v", "held", (F.col("share") / F.col("of")).alias("share")), f"target_{dim}")

    def most(self) -> float:
        least = [g.where("share > 0").agg(F.min(F.col("held") / (F.col("share") * F.lit(self.total)))).first()[0] for g in self.dims.values()]
        return min((x for x in least if x is not None), default=1.0)

    def goals(self, rate: float, bounded: bool) -> dict[str, DataFrame]:
        out, want = {}, rate * self.total
        for dim, g in self.dims.items():
            goal = lambda x: F.least("held", F.col("share") * F.lit(x * want)) if bounded else F.col("share") * F.lit(x * want)  # noqa: E731, B023
            all_ = g.where("share > 0").agg(F.coalesce(F.sum("held"), F.lit(0.0))).first()[0]
            scale = _filled(1.0, lambda x: g.agg(F.coalesce(F.sum(goal(x)), F.lit(0.0))).first()[0], min(want, all_) if bounded else want) if want and all_ else 0.0  # noqa: B023
            out[dim] = g.select("v", goal(scale).alias("goal"))
        return out

    def fitted(self, rate: float, bounded: bool, sweeps: int, error: float) -> tuple[DataFrame, float]:
        give = F.col("tokens") * (F.least(F.lit(1.0), "factor") if bounded else F.col("factor"))
        goals, now = self.goals(rate, bounded), self.cells.withColumn("factor", F.lit(1.0))
        for _ in range(sweeps if self.total else 0):
            offs = []
            for dim, goal in goals.items():
                sums = now.groupBy(F.col(dim).alias("v")).agg(F.sum(give).alias("now"))
                by = sums.join(goal.withColumnRenamed("v", "w"), F.col("v").eqNullSafe(F.col("w"))).select("v", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("by"), F.abs(F.col("now") - F.col("goal")).alias(f"off_{dim}"))
                now = now.join(by, F.col(dim).eqNullSafe(F.col("v"))).withColumn("factor", F.least(F.col("factor") * F.col("by"), F.lit(1e30))).drop("v", "by")
                offs.append(f"off_{dim}")
            now = stage(now, "fitted")
            worst = now.agg(*(F.max(c) for c in offs)).first()
            now = now.drop(*offs)
            if max(x or 0.0 for x in worst) <= error * rate * self.total:
                break
        weight = stage(now.withColumn("weight", give).drop("factor"), "weights")
        return weight, self.off(weight)

    def shares(self, weight: DataFrame, dim: str) -> DataFrame:
        total = weight.agg(F.greatest(F.sum("weight"), F.lit(1e-300)).alias("all"))
        sums = weight.groupBy(F.col(dim).alias("w")).agg(F.sum("weight").alias("now")).crossJoin(F.broadcast(total))
        return self.dims[dim].join(sums, F.col("v").eqNullSafe(F.col("w"))).select(F.col("v").alias(f"v_{dim}"), F.abs(F.col("now") / F.col("all") - F.col("share")).alias("off"))

    def off(self, weight: DataFrame) -> float:
        return max(float(self.shares(weight, d).agg(F.max("off")).first()[0] or 0.0) for d in self.dims) if self.total else 0.0

    def frame(self, weight: DataFrame) -> DataFrame:
        return weight

    def told(self, weight: DataFrame) -> DataFrame:
        for dim in self.dims:
            weight = weight.join(self.shares(weight, dim).withColumnRenamed("off", f"off_{dim}"), F.col(dim).eqNullSafe(F.col(f"v_{dim}"))).drop(f"v_{dim}")
        named = F.concat_ws(",", *(F.when(F.col(f"off_{d}") > MET, F.lit(d)) for d in self.dims))
        return weight.withColumn("unmet", named).drop(*(f"off_{d}" for d in self.dims))


def calibrated(cells: DataFrame, targets: dict, rate: float, least_rate: float, collected: int = BROADCAST_CELLS) -> DataFrame:
    """``cells`` with multiplier, prob, misfit and unmet: the highest rate up to ``rate`` (not below ``least_rate``) at which all targets fit."""
    few = not any(isinstance(t, DataFrame) and t.limit(collected + 1).count() > collected for t in (cells, *targets.values()))
    fit = (_Arrays if few else _Joins)(cells, targets)
    least = min(rate, least_rate)
    high = max(least, min(rate, fit.most()))
    tried = [(high, *fit.fitted(high, True, SWEEPS, ERROR))]
    low = least
    while tried[-1][2] > MET / 2 and len(tried) < TRIES and high > least:  # bounds of several dimensions meet in a cell: a lower rate may fit
        at = low if len(tried) == 1 else (low + high) / 2
        tried.append((at, *fit.fitted(at, True, SWEEPS, ERROR)))
        if tried[-1][2] > MET / 2:
            if at == least:
                break  # no rate fits
            low = at
        else:
            high = at
    best = min(off for *_, off in tried)
    at, weight, off = max((x for x in tried if x[2] <= max(MET / 2, 1.05 * best)), key=lambda x: x[0])
    told = fit.told(weight).withColumn("prob", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("tokens"))).otherwise(F.lit(0.0)))
    return told.withColumn("multiplier", F.col("prob") / F.lit(at or 1.0)).withColumn("misfit", F.lit(off))


def _frame(cells: DataFrame, table: pa.Table, more: dict) -> DataFrame:
    """Collected cells with further columns."""
    kinds = {c: T.StringType() if isinstance(v, pa.Array) else T.DoubleType() for c, v in more.items()}
    if not table.num_rows:
        return cells.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    for c, v in more.items():
        table = table.append_column(c, pa.array(v))
    return cells.sparkSession.createDataFrame(table, schema=T.StructType([*cells.schema.fields, *(T.StructField(c, k) for c, k in kinds.items())]))


def keep(docs: DataFrame, rate: float = 0.8, power: float = 0.7, targets: dict[str, DataFrame] | None = None, seed: int = 5, least_rate: float = 0.1) -> DataFrame:
    """The sampled rows of ``docs``, with their columns; texts aren't shuffled while the cells are few."""
    features = featured(docs)
    topics = fit_topics(features)
    fitted = _fitted(stage(cells_of(with_topics(features, topics)), "cells"), rate, power, targets, least_rate)
    sent, topic, cell = docs.sparkSession.sparkContext.broadcast(topics), free_name(docs, "topic"), free_name(docs, "cell")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_named(sent.value, *_rounded(b)))], names=[*b.schema.names, topic])

    keyed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(topic, T.StringType())]))
    keyed = keyed.withColumn(topic, F.struct(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(topic).alias("topic")))
    cells = fitted.select(F.struct(*(F.col(f"_{d}").alias(d) for d in DIMS)).alias(cell), F.struct("prob").alias(f"{cell}_prob"))
    joined = keyed.join(sized_broadcast(cells, cells.count(), BROADCAST_CELLS), F.col(topic).eqNullSafe(F.col(cell)), "left")
    prob = F.coalesce(F.col(f"{cell}_prob.prob"), F.raise_error(F.lit("a text's cell was not counted: the documents changed between two reads")).cast("double"))
    return joined.where(_draw(seed) < prob).select(*docs.columns)


def _rounded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """As ``vectors``, rounded as the written ones are."""
    n, x = vectors(batch)
    return n, x.astype(np.float16).astype(np.float32)


def sample(docs: DataFrame, rate: float = 0.8, power: float = 0.7, targets: dict[str, DataFrame] | None = None, seed: int = 5, least_rate: float = 0.1) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, multiplier, prob, sampled, misfit and unmet of every row.

    Without ``targets`` the shares are the present ones to the given power, which lifts small sources,
    languages and topics.
    """
    features = featured(docs)
    rows = stage(with_topics(features, fit_topics(features)), "rows")
    fitted = _fitted(stage(cells_of(rows), "cells"), rate, power, targets, least_rate)
    joined = rows.join(sized_broadcast(fitted, fitted.count(), BROADCAST_CELLS), _same())
    return joined.select("doc_id", *DIMS, "n_tokens", "multiplier", "prob", (_draw(seed) < F.col("prob")).alias("sampled"), "misfit", "unmet")


def _fitted(cells: DataFrame, rate: float, power: float, targets: dict[str, DataFrame] | None, least_rate: float) -> DataFrame:
    """_source, _lang, _topic, multiplier, prob, misfit and unmet of each cell."""
    fitted = calibrated(cells, targets or {d: tempered(cells, d, power) for d in DIMS}, rate, least_rate)
    return stage(fitted.select(*(F.col(d).alias(f"_{d}") for d in DIMS), "multiplier", "prob", "misfit", "unmet"), "prob")


def _same() -> Column:
    return reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.col(f"_{d}")) for d in DIMS))


def _draw(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
