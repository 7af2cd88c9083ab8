import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from landloom.llm import jaccard
from landloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, words=5, percent=80):
    """doc_id, set size and least reachable id by comparing all pairs of distinct sets."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()))
    distinct = {s: i for i, s in enumerate({s for _, s in sets if s})}
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (s, i), (t, j) in combinations(distinct.items(), 2):
        if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
            root[find(i)] = find(j)
    least = {}
    for d, s in sets:
        if s and d is not None:
            r = find(distinct[s])
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(find(distinct[s])) if s else d) for d, s in sets), key=str)


def family(rng, vocab):
    """Copies at similarities on both sides of the bound, chains of them, and a passage that many share."""
    passage, rows = " ".join(rng.choice(vocab, 80)), []
    for k in range(12):
        base = list(rng.choice(vocab, int(rng.integers(5, 300))))
        rows.append(" ".join(base))
        for _ in range(6):
            own = list(base)
            for at in rng.integers(0, len(own), max(1, len(own) // 40)):
                own[int(at)] = str(rng.choice(vocab))
            rows.append(" ".join(own))
            if rng.random() < 0.5:
                base = own
        rows += [" ".join(base), " ".join(base).upper() if k % 2 else "  ".join(base)]
    rows += [passage + " " + " ".join(rng.choice(vocab, int(rng.integers(3, 60)))) for _ in range(40)]
    return rows + ["a b c d", "a b c", "a b c d", "A  b c d", "a b c d e", "a a a a a a a", "a a a a a", "", " ", None]


@pytest.mark.parametrize("how", [{}, {"rounds": 0}, {"open_pairs": 0, "rounds": 2}])
def test_components_are_those_of_all_pairs(spark, how, monkeypatch):
    rng = np.random.default_rng(3 + len(how))
    texts = family(rng, [f"w{i}" for i in range(900)])
    docs = spark.createDataFrame([(i if i % 17 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, sig long").repartition(3)
    monkeypatch.setattr(jaccard, "HUB", 3)
    if how:
        monkeypatch.setattr(jaccard, "similar_pairs", lambda d, w, p, f=jaccard.similar_pairs: f(d, w, p, **how))
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark, odd_documents):
    got = sorted((tuple(r) for r in jaccard.near_duplicates(odd_documents).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd_documents.collect()])


def test_op13_over_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_jaccard"](spark, SF).collect()), key=str) == brute(docs)


def test_empty_table(spark, odd_documents):
    assert jaccard.near_duplicates(odd_documents.where("doc_id < 0")).count() == 0


def test_sets_hold_each_shingle_once():
    starts, h = jaccard.sets_of(pa.RecordBatch.from_pydict({"text": ["a b c d e a b c d e a", None, "x", "a b c d e", "A B\tC\n d e"]}), "text", 5)
    assert np.diff(starts).tolist() == [5, 0, 1, 1, 1] and h[6] == h[7] and h[6] in h[:5]


def test_runs_of_sizes_become_lists(monkeypatch):
    rows = [(1, 10, 8), (1, 11, 10), (1, 11, 10), (1, 12, 30), (2, 13, 5), (3, 14, 5), (3, 15, 6), (3, 16, 7), (4, 10, 8), (4, 11, 10), *((5, 100 + i, 50) for i in range(9)), (6, 17, 4)]
    rows += [(7, 20, 50, 8), (7, 21, 50, 9), (8, 22, 50, 8), (8, 23, 50, 2), (9, 22, 50, 1), (9, 23, 50, 7)]  # both tight; one list at two places
    batch = lambda part: pa.RecordBatch.from_pydict({"element": pa.array([r[0] for r in part], pa.int64()), "g": pa.array([r[1] for r in part], pa.int64()), "n": pa.array([r[2] for r in part], pa.int32()), "pos": pa.array([r[3] if len(r) > 3 else 0 for r in part], pa.int32()), "sig": pa.nulls(len(part), pa.binary()), "odd": pa.nulls(len(part), pa.list_(pa.int64()))})
    monkeypatch.setattr(jaccard, "TOLD", 5)
    for size in (1, 2, 3, 4, 8, 30):
        out = [r for b in jaccard._lister(80)(batch(rows[i : i + size]) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        lists = {}
        for r in out:
            lists.setdefault(r["list"], set()).add(r["g"])
        assert sorted(sorted(x) for x in lists.values()) == [[10, 11], [14, 15, 16], [22, 23], list(range(100, 109))]
        assert {r["g"]: min(x["pos"] for x in out if x["g"] == r["g"]) for r in out if r["g"] in (22, 23)} == {22: 1, 23: 2}


def test_bitmaps_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(9)
    for n in (1, 5, 200, 5000):
        x, y = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[: n // 2], y[n // 2 :]]))
        a, b = jaccard._parities(np.array([0, len(x), len(x) + len(y)]), np.concatenate([x, y])).view(np.uint64)
        assert len(a) * 64 == jaccard.BITS and np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y)) and (a == jaccard._parities(np.array([0, len(x)]), x).view(np.uint64)[0]).all()


def test_pairs_are_distinct_before_they_meet_tested_ones(spark, monkeypatch):
    """A pair stands in many lists: the anti join with tested pairs has each once, and isn't moved below the step that makes them distinct."""
    plans = []

    def staged(df, name, f=jaccard.stage):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return f(df, name)

    monkeypatch.setattr(jaccard, "stage", staged)
    texts = family(np.random.default_rng(3), [f"w{i}" for i in range(900)])
    jaccard.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rounds=1, open_pairs=0)
    anti = [p for p in plans if re.search(r"LeftAnti, \(+lo#", p)]
    assert anti and not any("Aggregate" in p for p in anti)


def test_chunks_of_lists_connect_what_all_pairs_do(spark, monkeypatch):
    texts = family(np.random.default_rng(8), [f"w{i}" for i in range(900)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "RUN", 5)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute(list(enumerate(texts)))


def test_a_large_family_gives_few_pairs_a_member(spark, monkeypatch):
    """Copies with three changed words each are mostly similar to one another: pairs to compare grow with the members, not with their square."""
    rng, rows, seen = np.random.default_rng(4), [], []
    base = [f"v{i}" for i in range(120)]
    for i in range(300):
        own = list(base)
        for at in rng.integers(0, 120, 3):
            own[int(at)] = f"n{i}"
        rows.append((i, " ".join(own)))

    def counted(known, pairs, words, percent, f=jaccard.compared):
        seen.append(pairs.count())
        return f(known, pairs, words, percent)

    monkeypatch.setattr(jaccard, "compared", counted)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows) and 0 < sum(seen) <= 6 * len(rows)
