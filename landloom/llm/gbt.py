"""Histogram gradient-boosted trees for one yes/no label, flattened into node arrays.

Inputs are cut into at most ``bins`` quantile bins. Trees grow level by level; each level's gradient sums are
one histogram an input. An input can be held monotonic: a split that would break the direction is refused,
and both sides' later values are bounded by the middle of the two, so the whole score is monotonic.
A tree is a complete binary tree in arrays (input, threshold, value), so scoring is ``depth`` vectorised
steps a tree: node = 2 node + 1 + (x[input] > threshold).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit takes at most; above it a share of them is taken by a hash of the id.
FIT_ROWS = 40_000


@dataclass
class Trees:
    base: float
    depth: int
    inputs: np.ndarray  # trees x inner nodes: index of an input
    thresholds: np.ndarray  # trees x inner nodes; infinite where a node isn't split
    values: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), (1 << self.depth) - 1
        for which, threshold, value in zip(self.inputs, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, which[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 1.0, least: float = 1.0, directions: dict[int, int] | None = None) -> Trees:
    """Fit to rows ``x`` and labels ``y`` (0 or 1). ``directions``: +1 or -1 by input. No rows, or one label alone, give a constant."""
    inner, n_inputs = (1 << depth) - 1, x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))), depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(y) or y.min() == y.max():
        return Trees(model.base, depth, model.inputs[:0], model.thresholds[:0], model.values[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_inputs)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    way = np.array([(directions or {}).get(j, 0) for j in range(n_inputs)])
    raw = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node, lo, hi = np.zeros(len(y), np.int64), np.array([-np.inf]), np.array([np.inf])
        for level in range(depth):
            m, first = 1 << level, (1 << level) - 1
            gain = np.full((n_inputs, m, bins), -np.inf)
            left = np.zeros((n_inputs, m, bins)), np.zeros((n_inputs, m, bins))
            for j in range(n_inputs):
                at = node * bins + codes[j]
                gs, hs = (np.bincount(at, w, m * bins).reshape(m, bins) for w in (g, h))
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                wl, wr, w0 = (np.clip(-a / (b + l2), lo[:, None], hi[:, None]) for a, b in ((gl, hl), (gt - gl, ht - hl), (gt, ht)))
                value = lambda a, b, w: -(a * w + 0.5 * (b + l2) * w * w)
                own = value(gl, hl, wl) + value(gt - gl, ht - hl, wr) - value(gt, ht, w0)
                bad = (hl < least) | (ht - hl < least) | (np.arange(bins) >= len(edges[j])) | (way[j] * (wr - wl) < 0)
                gain[j], left[0][j], left[1][j] = np.where(bad, -np.inf, own), wl, wr
            best = gain.transpose(1, 0, 2).reshape(m, -1).argmax(1)
            j, b = best // bins, best % bins
            split = gain[j, np.arange(m), b] > 1e-7
            model.inputs[t, first : first + m] = np.where(split, j, 0)
            model.thresholds[t, first : first + m] = [edges[a][c] if s else np.inf for a, c, s in zip(j, b, split, strict=True)]
            mid = (left[0][j, np.arange(m), b] + left[1][j, np.arange(m), b]) / 2
            up, down = split & (way[j] > 0), split & (way[j] < 0)
            nlo, nhi = np.repeat(lo, 2), np.repeat(hi, 2)
            nhi[0::2], nlo[1::2] = np.where(up, mid, hi), np.where(up, mid, lo)
            nlo[0::2], nhi[1::2] = np.where(down, mid, nlo[0::2]), np.where(down, mid, nhi[1::2])
            lo, hi = nlo, nhi
            node = 2 * node + (split[node] & (codes[j[node], np.arange(len(y))] > b[node]))
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        model.values[t] = rate * np.clip(-gs / (hs + l2), lo, hi)
        raw += model.values[t][node]
    return model


def chosen_labels(labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """doc_id and y of at most about ``most`` labelled rows, chosen by a hash of the id. Ids whose labels contradict each other are left out."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z and doc_id is not null").select("doc_id", F.col("y").cast("double").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))


def labelled(stats: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and labels of the chosen rows (column ``inputs``)."""
    rows = stats.select("doc_id", "inputs").join(chosen_labels(labels, label, most), "doc_id").orderBy("doc_id").toArrow()
    y = rows.column("y").to_numpy()
    x = np.array(rows.column("inputs").combine_chunks().flatten().to_numpy()).reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    return x, y


def add_score(stats: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """``stats`` with the model's score of its column ``inputs``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stats.schema if f.name not in ('inputs', name))}, `{name}` double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("inputs").flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            kept = [c for c in b.schema.names if c not in ("inputs", name)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sent.value.score(x))], names=[*kept, name])

    return stats.mapInArrow(run, schema)
