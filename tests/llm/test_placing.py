"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.llm import kd_shards, mixing


def test_shards_hold_near_equal_bytes_and_whole_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "x" * int(rng.integers(1, 400)) + str(i % 900), ["en", "de", None][i % 3], f"s{min(i % 40, 12)}", 1, 5) for i in range(3000)]
    rows += [(10_000 + i, "a hot text of a third of all rows" * 4, "en", "s0", 2, 5) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, slot int")
    for shards in (16, 5, 1):
        got = kd_shards.shard(docs, shards).collect()
        sizes, slots = Counter(), defaultdict(list)
        for r in got:
            sizes[r.shard] += r.size
            slots[r.shard].append(r.slot)
        mean = sum(sizes.values()) / shards
        assert len(sizes) == shards and max(abs(x - mean) for x in sizes.values()) < 0.03 * mean
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        by_id = {r[0]: r for r in rows}
        assert sorted(r.doc_id for r in got) == sorted(by_id)
        assert all(r.size == len(by_id[r.doc_id][1].encode()) + 1 and r.text_crc32 == zlib.crc32(by_id[r.doc_id][1].encode()) for r in got)
        where = defaultdict(set)
        for r in got:
            where[by_id[r.doc_id][1]].add(r.shard)
        assert sum(len(x) > 1 for t, x in where.items() if not t.startswith("a hot")) <= 15
    assert len({r.shard for r in kd_shards.shard(docs, target_bytes=40_000).collect()}) > 16


def test_odd_documents_and_none(spark, odd_documents):
    got = kd_shards.shard(odd_documents, 4).collect()
    assert len(got) == odd_documents.count() and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert kd_shards.shard(odd_documents.where("doc_id < 0"), 4).count() == 0
    far = spark.createDataFrame([(i, "t" * 9, "en", "s") for i in (-(1 << 63), -1, 0, 5, (1 << 63) - 1, None)], "doc_id long, text string, lang string, source string")
    assert kd_shards.shard(far, 3).count() == 6


def test_more_shards_than_a_tree_has_leaves(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") % 50 + 100).cast("int")).alias("t"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"))
    docs = rows.select("doc_id", F.concat("t", F.col("doc_id").cast("string")).alias("text"), "lang", "source")
    got = kd_shards.shard(docs, shards=50, leaves=6).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 50
    assert sorted(r.doc_id for r in got) == list(range(3000)) and set(sizes) == set(range(50))
    assert max(abs(x - mean) for x in sizes.values()) < 0.08 * mean


def brute_rake(cells, targets, sweeps=500):
    w = {k: v for k, v in cells.items()}
    total = sum(w.values())
    for _ in range(sweeps):
        for d, share in enumerate(targets):
            sums = Counter()
            for k, v in w.items():
                sums[k[d]] += v
            of = sum(share.get(v, 0) for v in sums if sums[v] > 0)
            w = {k: v * share.get(k[d], 0) / of * total / sums[k[d]] if sums[k[d]] > 0 else 0 for k, v in w.items()}
    return w


def test_rake_against_brute_force_and_marginals(spark):
    rng = np.random.default_rng(6)
    cells = {(s, la, t): float(rng.integers(1, 900)) for s in ("a", "b", None) for la in ("en", "de") for t in ("x", "y", "z") if rng.random() < 0.9}
    df = spark.createDataFrame([(*k, v, 1) for k, v in cells.items()], "source string, lang string, topic string, tokens double, docs long")
    shares = [{"a": 0.5, "b": 0.3, None: 0.2}, {"en": 0.6, "de": 0.4}, {"x": 0.2, "y": 0.3, "z": 0.4, "absent": 0.1}]
    targets = {d: spark.createDataFrame(list(s.items()), "value string, share double") for d, s in zip(mixing.DIMS, shares, strict=True)}
    joined = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, targets, collected=0).collect()}
    fitted = mixing.rake(df, targets)
    got = {(r.source, r.lang, r.topic): r.weight for r in fitted.collect()}
    want = brute_rake(cells, shares)
    assert got == pytest.approx(want, rel=1e-4) and joined == pytest.approx(want, rel=1e-4)
    assert sum(v for k, v in got.items() if k[0] == "a") == pytest.approx(0.5 * sum(cells.values()), rel=1e-5)
    prob = mixing.calibrated(df, targets, 0.4, 0.1).collect()
    assert sum(r.tokens * r.prob for r in prob) == pytest.approx(0.4 * sum(cells.values()), rel=1e-4)
    assert all(0 <= r.prob <= 1 for r in prob)


def expected_off(rows, targets):
    """By dimension and value, the share of the expected sample less the target among values with tokens."""
    out = {}
    for d, target in targets.items():
        got, held = Counter(), Counter()
        for r in rows:
            got[getattr(r, d)] += r.n_tokens * r.prob
            held[getattr(r, d)] += r.n_tokens
        of, all_ = sum(target.get(v, 0) for v in held if held[v]), sum(got.values())
        out |= {(d, v): got[v] / all_ - target.get(v, 0) / of for v in held if held[v]}
    return out


@pytest.mark.parametrize("sf,rate", [("0.01", 0.8), ("0.01", 0.95), ("0.001", 0.5)])
def test_the_expected_sample_has_the_target_shares(spark, sf, rate):
    rows = mixing.sample(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"), rate=rate).collect()
    targets = {}
    for d in mixing.DIMS:
        sums = Counter()
        for r in rows:
            sums[getattr(r, d)] += r.n_tokens
        powers = {v: n**0.7 for v, n in sums.items()}
        targets[d] = {v: p / sum(powers.values()) for v, p in powers.items()}
    off = expected_off(rows, targets)
    assert max(map(abs, off.values())) < 1e-3 and rows[0].misfit == pytest.approx(max(map(abs, off.values())), abs=1e-6) and {r.unmet for r in rows} == {""}
    for d in mixing.DIMS:  # the draw itself lies within five deviations
        drawn, want, spread = Counter(), Counter(), Counter()
        for r in rows:
            drawn[getattr(r, d)] += r.n_tokens * r.sampled
            want[getattr(r, d)] += r.n_tokens * r.prob
            spread[getattr(r, d)] += r.n_tokens**2 * r.prob * (1 - r.prob)
        assert all(abs(drawn[v] - n) <= 5 * spread[v] ** 0.5 + 1e-6 for v, n in want.items())


@pytest.mark.parametrize("least", [0.8, 0.05])
def test_rare_values_are_taken_whole_or_lower_the_rate(spark, least):
    """b has 2 % of the tokens and a target of 10 %: at 0.8 all of it is taken, and a and c share the rest as their targets do."""
    cells = spark.createDataFrame([("a", "x", "t", 600.0, 1), ("a", "y", "t", 80.0, 1), ("b", "x", "t", 20.0, 1), ("c", "y", "t", 300.0, 1)], "source string, lang string, topic string, tokens double, docs long")
    to = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": to({"a": 0.6, "b": 0.1, "c": 0.3}), "lang": to({"x": 0.62, "y": 0.38})}
    for collected in (mixing.BROADCAST_CELLS, 0):
        rows = {(r.source, r.lang): r for r in mixing.calibrated(cells, targets, 0.8, least, collected).collect()}
        got = {s: sum(r.tokens * r.prob for (v, _), r in rows.items() if v == s) for s in "abc"}
        total = sum(got.values())
        if least == 0.8:
            assert got["b"] == pytest.approx(20, rel=1e-3) and got["a"] / got["c"] == pytest.approx(2, rel=1e-3) and total == pytest.approx(800, rel=1e-3)
            assert rows["b", "x"].unmet == "source" and rows["b", "x"].misfit == pytest.approx(0.075, abs=1e-3)
        else:
            assert {s: n / total for s, n in got.items()} == pytest.approx({"a": 0.6, "b": 0.1, "c": 0.3}, abs=1e-3) and total == pytest.approx(200, rel=0.01) and rows["b", "x"].unmet == ""


def test_sampling(spark, odd_documents):
    got = mixing.sample(odd_documents).collect()
    assert len(got) == 10 and len({r.sampled for r in got if r.doc_id == 5}) == 1
    kept = mixing.keep(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.sampled)
    assert mixing.sample(odd_documents.where("doc_id < 0")).count() == 0
    words = {r.doc_id: r.n_tokens for r in got}
    assert words[4] == 6 and words[1] == words[2] == words[3] == 0


def test_topics_part_vocabularies_and_follow_the_rows(spark):
    rng = np.random.default_rng(3)
    vocab = [[f"{t}{i}" for i in range(60)] for t in ("tax", "sea", "oak")]
    rows = [(i, " ".join(rng.choice(vocab[i % 3], 80)), "en", f"s{i % 2}") for i in range(240)] + [(300, None, "en", "s0"), (301, " ", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in mixing.sample(docs, rate=0.5).collect()}
    seen = [{got[i].topic for i in range(t, 240, 3)} for t in range(3)]
    assert not seen[0] & seen[1] and not seen[0] & seen[2] and not seen[1] & seen[2] and {got[300].topic, got[301].topic} == {"empty"}
    assert {i: got[i].n_tokens for i in (0, 300, 301)} == {0: 80, 300: 0, 301: 0}
    tokens = sum(r.n_tokens for r in got.values())
    assert 0.45 * tokens < sum(r.n_tokens * r.prob for r in got.values()) <= 0.5 * tokens + 1e-6  # a topic's tokens may lower the rate
    again = {r.doc_id: r.topic for r in mixing.sample(docs.repartition(7), rate=0.5).collect()}
    assert again == {i: r.topic for i, r in got.items()}


def test_targets_that_contradict_each_other_show_a_misfit(spark):
    rows = [(i, "a b c", "en" if i % 2 else "de", "x" if i % 2 else "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    to = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    fits = {"source": to({"x": 0.3, "y": 0.7}), "lang": to({"en": 0.3, "de": 0.7})}
    not_ = {"source": to({"x": 0.3, "y": 0.7}), "lang": to({"en": 0.7, "de": 0.3})}
    assert mixing.sample(docs, targets=fits).first().misfit < 1e-5 and mixing.sample(docs, targets=not_).first().misfit > 0.1
    one = {r.source: r.multiplier for r in mixing.sample(docs, targets=fits).collect()}
    assert one == pytest.approx({"x": 0.6, "y": 1.4})
