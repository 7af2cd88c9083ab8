import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from landloom.llm import simhash
from landloom.llm.components import components


def brute_fp(text, words=4):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, k):
    fps = sorted(set(fps))
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if ((x ^ y) % 2**64).bit_count() <= k:
                parent[max(find(x), find(y))] = min(find(x), find(y))
    return {x: find(x) for x in fps}


def test_fingerprints_against_spark_hash_and_brute_force(spark, odd_documents):
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(odd_documents).collect()}
    assert got == {r.doc_id: brute_fp(r.text) for r in odd_documents.collect()}
    assert spark.sql("select xxhash64('a b c d') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def made(rng, n):
    base = rng.integers(0, 2**63, n).astype(np.uint64)
    out = set(base.tolist())
    for x in base[: n // 3].tolist():
        for _ in range(int(rng.integers(1, 12))):
            x ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5)))
            out.add(x)
    hub = int(base[-1])
    out |= {hub ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}
    return sorted(out)


def test_links_connect_exactly(spark):
    fps = made(np.random.default_rng(3), 120)
    want = brute_roots([x - 2**64 if x >> 63 else x for x in fps], 4)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    for blocks, run in ((6, 4096), (7, 50), (8, 9)):
        links = simhash.links(df, len(fps), 4, blocks, run)
        assert all(((r.a ^ r.b) % 2**64).bit_count() <= 4 for r in links.collect())
        roots = {r.node: r.root for r in components(links).collect()}
        assert {x: roots.get(x, x) for x in want} == want


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 800)], "a long, b long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert {got[i] for i in range(201)} == {0} and got[900] == 800 and 500 not in got
    assert components(chain.where("a < 0")).count() == 0


def test_documents(spark, odd_documents):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_documents).collect()}
    rows = odd_documents.collect()
    signed = {r.doc_id: (brute_fp(r.text) + 2**63) % 2**64 - 2**63 for r in rows}
    roots = brute_roots(list(signed.values()), 4)
    want = {(d, min(e for e in signed if roots[signed[e]] == roots[f])) for d, f in signed.items()}
    assert got == want and {1, 2, 3} <= {d for d, c in got if c == 1} and (5, 4) in got
    assert simhash.near_duplicates(odd_documents).count() == len(rows)
    assert simhash.near_duplicates(odd_documents.where("doc_id < 0")).count() == 0


def brute_similar(texts, words, least):
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in ((t or "").encode().lower().split() for t in texts)]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def components_of(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("run", [4096, 5])
def test_similar_links_against_brute_force(spark, run):
    """Families of copies with a few changed words each: what brute force over all pairs connects is connected, and no more."""
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(1500)]
    texts = []
    for family in range(30):
        base = list(rng.choice(vocab, 120))
        texts.append(" ".join(base))
        for _ in range(family % 5):
            copy = list(base)
            for at in rng.choice(120, 1 + family % 3, replace=False):
                copy[at] = str(rng.choice(vocab))
            texts.append(" ".join(copy))
    texts += [None, "", " ", "one two", "One  two", texts[0], texts[0].upper(), "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.a, r.b) for r in simhash.similar_links(docs, run=run).collect()}
    want = brute_similar(texts, 5, 0.8)
    assert got <= want
    assert components_of(len(texts), got) == components_of(len(texts), want)
    assert simhash.similar_links(docs.where("doc_id < 0")).count() == 0


def test_tree_spans_by_nearest():
    rng = np.random.default_rng(2)
    wide = rng.integers(0, 1 << 62, (40, simhash.WIDE)).astype(np.uint64)
    wide[20:] = wide[:20] ^ np.uint64(5)
    a, b = simhash.tree(wide, 20)
    assert sorted(map(sorted, zip(a.tolist(), b.tolist(), strict=True))) == [[i, i + 20] for i in range(20)]


def test_one_group_of_half_of_all_rows(spark):
    """A fingerprint and a component that hold much of all rows stay where they are: no task reads most of them."""
    from landloom.llm.staging import split_join

    left = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = split_join(left, right, "k", "n", 20_000)
    assert out.count() == 20_000 and out.where("k = 0 and least <> 0").count() == 0
    assert out.where("k = 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2_000
