import math
import zlib
from collections import Counter

import pytest

from landloom.llm import lm


def brute(rows, order, discounts):
    """Token by token, with dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in {r.doc_id for r in rows}}
    toks = [(r.doc_id, [w.decode() for w in (r.text or "").encode().lower().split()] + ["</s>"]) for r in rows]
    train = [t for i, t in toks if not held[i]]
    c = Counter(w for t in train for w in t)
    total, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (total + 0.5 * (v + 1))
    pad = ["<s>"] * (order - 1)
    arcs = Counter((*(pad + t)[j : j + order - 1], w) for t in train for j, w in enumerate(t))
    less = lambda n: discounts[min(n, 3) - 1]
    states, left = Counter(), Counter()
    for a, n in arcs.items():
        states[a[:-1]] += n
        left[a[:-1]] += less(n)

    def prob(h, w):
        if not states[h]:
            return p1(w)
        n = arcs[(*h, w)]
        return (n - less(n) if n else 0) / states[h] + left[h] / states[h] * p1(w)

    for h in list(states)[:5]:  # a state's probabilities sum to one: those of known words, and an unknown one's
        assert sum(prob(h, w) for w in c) + prob(h, "\0") == pytest.approx(1)
    out = []
    for i, t in toks:
        s = pad + t
        score = sum(math.log10(prob(tuple(s[j : j + order - 1]), w)) for j, w in enumerate(t))
        out.append((i, held[i], len(t), sum(c[w] > 0 for w in t), total, sum(math.log10(p1(w)) for w in t), score))
    return sorted(out)


def same(got, want):
    got = sorted(map(tuple, got))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-5)


@pytest.fixture(scope="module")
def some(spark):
    text = ["The cat sat on the mat", "the cat sat on the hat and THE cat ran", None, "", "a dog sat on the mat", "É é The cat sat", "one off words here"]
    rows = [(i, text[i % 7] if i % 3 else f"{text[i % 7] or ''} and the cat sat on {i}") for i in range(60)]
    return spark.createDataFrame([*rows, rows[4], rows[6]], "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("dealt", [{}, {"sent_words": 3, "bucket": 40, "sample": 0, "hot_from": 8}, {"sent_words": 0, "bucket": 7, "sample": 0, "hot_from": 1}, {"sent_words": 1000, "bucket": 100, "sample": 3, "hot_from": 2}])
def test_scores_against_brute_force(some, order, dealt):
    """The scores don't depend on which words are sent, how many buckets there are and which states are hot."""
    same(lm.train_and_score(some, order=order, **dealt).collect(), brute(some.collect(), order, lm.DISCOUNTS))


def test_odd_documents_and_none(spark, odd_documents):
    got = lm.train_and_score(odd_documents).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    same(got, brute(odd_documents.collect(), 3, lm.DISCOUNTS))
    assert lm.train_and_score(odd_documents.where("doc_id < 0")).count() == 0
    alone = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {r.score for r in lm.train_and_score(alone).collect()} == {0.0}
    nobody = spark.createDataFrame([(None, "a b c"), (1, "a b"), (None, "a b c")], "doc_id long, text string")
    assert lm.train_and_score(nobody).where("doc_id is null").count() == 2


def test_each_bucket_has_its_own_partition(spark):
    from pyspark.sql import functions as F

    for parts in (1, 7, 64):
        keys = spark.createDataFrame([(int(x),) for x in lm.own_partitions(spark, parts)], "k long")
        assert keys.repartition(parts, "k").select(F.spark_partition_id().alias("p")).distinct().count() == parts


def test_pack():
    import numpy as np

    cols = [np.array([5, 0, 1 << 63, 7], np.uint64), np.zeros(0, np.uint64), np.arange(300)]
    for a, b in zip(cols, lm.unpack(lm.pack(cols), 3), strict=True):
        assert a.tolist() == b.tolist()


def test_passages_seen_twice_score_higher(spark):
    """However small their share of the corpus: no n-gram is pruned."""
    filler = [(i, f"a b c d {i % 7} " * 800) for i in range(100)]
    twice = [(1000 + i, " ".join(f"w{(j * 7 + i // 2) % 97} v{j}" for j in range(20))) for i in range(40)]
    once = [(2000 + i, " ".join(f"w{(j * 5 + i) % 97} v{(j * 11 + i) % 20}" for j in range(20))) for i in range(40)]
    got = lm.train_and_score(spark.createDataFrame(filler + twice + once, "doc_id long, text string")).where("not held_out").collect()
    mean = lambda lo, hi: sum(r.score for r in got if lo <= r.doc_id < hi) / sum(r.n_tokens for r in got if lo <= r.doc_id < hi)
    assert mean(1000, 2000) > mean(2000, 3000) + 0.3
