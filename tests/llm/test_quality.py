import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.llm import doc_stats, gbt, quality_model, quality_rules


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in wins:
        seen[w] = seen.get(w, 0) + 1
    covered = {j for i, w in enumerate(wins) if seen[w] > 1 for j in range(i, i + 8)}
    lines, dup, before = t.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", "".join(words))), dup, len(covered)]


def test_counts_against_brute_force(spark, odd_documents):
    rng = np.random.default_rng(2)
    made = [" ".join(rng.choice(["a", "b", "é&", "c\n", "#d"], int(rng.integers(0, 120)))) for _ in range(150)]
    made += ["a b c d e f g h " * 3, "x " * 9, "x " * 8, "a b c d e f g h", "l\nl \nl\n\n\nl"]
    for t in [*made, *(r.text for r in odd_documents.where("doc_id <> 6").collect())]:
        assert doc_stats.statistics((t or "").encode())[0] == brute(t), t


def test_trees_learn_and_hold_directions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.4) ^ (rng.random(4000) < 0.1) | (x[:, 2] > 0.9)).astype(float)
    m = gbt.fit(x, y, directions={0: 1, 1: -1})
    at = np.tile(rng.random((50, 1, 3)), (1, 40, 1))
    for j, way in ((0, 1), (1, -1)):
        grid = at.copy()
        grid[:, :, j] = np.linspace(0, 1, 40)
        s = m.score(grid.reshape(-1, 3)).reshape(50, 40)
        assert (np.diff(s, axis=1) * way >= -1e-12).all()
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.85
    # flattened traversal against a walk, row by row
    for row in x[:20]:
        raw = m.base
        for which, thr, val in zip(m.inputs, m.thresholds, m.values, strict=True):
            node = 0
            while node < len(which):
                node = 2 * node + (2 if row[which[node]] > thr[node] else 1)
            raw += val[node - len(which)]
        assert raw == pytest.approx(m.raw(row[None])[0])
    assert gbt.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert len(set(gbt.fit(x, np.ones(4000)).score(x[:5]))) == 1


def made_tables(spark):
    rng = np.random.default_rng(5)
    calm = lambda: "\n".join(" ".join(f"word{k}" for k in rng.integers(0, 5000, 20)) + "." for _ in range(8))
    rows = [(i, calm() if i % 4 else calm().replace(" ", "%%% ")) for i in range(240)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 240)] + [(1, 1, 0), (999, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_and_model_on_held_out_rows(spark, odd_documents):
    docs, labels = made_tables(spark)
    rows = quality_model.classify(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all((r.predicted == 1) == (r.doc_id % 4 > 0) for r in held)
    got = {r.doc_id: r.kept for r in quality_rules.verdicts(docs, labels).collect()}
    assert got == {i: i % 4 > 0 for i in range(240)}
    kept = quality_rules.keep(docs.withColumn("score", F.lit("x")), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i]} and kept.columns == ["doc_id", "text", "score"]
    odd = quality_rules.verdicts(odd_documents, labels)
    assert odd.count() == 10 and {r.doc_id for r in odd.where("base_failed").collect()} >= {1, 2, 3, 4, 5, 6, 7, 9}
    assert quality_rules.keep(odd_documents, labels.where("doc_id < 0")).count() == 0
    assert quality_model.classify(docs.where("doc_id < 0"), labels).count() == 0
    assert {r.score for r in quality_model.classify(docs, labels.where("doc_id < 0")).collect()} == {0.5}


def test_labels_that_contradict_each_other_are_left_out(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    assert sorted(map(tuple, gbt.chosen_labels(labels, "quality").collect())) == [(2, 1.0), (4, 0.0)]
