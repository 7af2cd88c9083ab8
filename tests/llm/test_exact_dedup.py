import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from landloom.llm import exact_dedup


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.FuseFilter.build(keys)
        assert f.may_hold(keys).all()
        if n >= 1000:
            assert f.may_hold(rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.008
            assert len(f.table) < 1.5 * n + 2000


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r.text or ""), []).append(r)
    out = []
    for norm, own in groups.items():
        keep = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id)).doc_id
        out += [(r.doc_id, keep, len(own), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in own]
    return sorted(out, key=str)


def test_against_brute_force(spark, odd_documents):
    for old in (F.col("doc_id") % 2 == 0, F.lit(True), F.lit(False), F.lit(None).cast("boolean")):
        got = exact_dedup.dedup(odd_documents, old).drop("matched_snapshot")
        assert sorted(map(tuple, got.collect()), key=str) == brute(odd_documents.collect())


def test_snapshot_matches_and_empty(spark, odd_documents):
    got = {r.doc_id: r.matched_snapshot for r in exact_dedup.dedup(odd_documents, F.col("doc_id") == 4).collect()}
    assert got[5] and got[4] and not got[8]
    assert exact_dedup.dedup(odd_documents.where("doc_id < 0"), F.lit(True)).count() == 0


def test_null_and_least_ids(spark):
    rows = [(None, "a b"), (None, "ab"), (-(1 << 63), " a"), (5, "a"), (None, "c"), (7, "d"), (8, "d ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for old in (F.col("doc_id") > 0, F.lit(False)):
        got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size) for r in exact_dedup.dedup(docs, old).collect()}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got == {(None, sha("ab")): (None, 2), (-(1 << 63), sha("a")): (-(1 << 63), 2), (5, sha("a")): (-(1 << 63), 2), (None, sha("c")): (None, 1), (7, sha("d")): (8, 2), (8, sha("d")): (8, 2)}


def test_snapshot_is_kept_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    exact_dedup.dedup(docs, F.col("doc_id") < 60, str(tmp_path / "snap")).count()
    digests, filters, buckets = exact_dedup.read_snapshot(spark, str(tmp_path / "snap"))
    assert (digests.count(), filters.count(), buckets) == (40, 1, 1)
    batch = exact_dedup.distinct_digests(exact_dedup.digests(spark.createDataFrame([(1, "text 3"), (2, "text 99")], "doc_id long, text string")))
    assert digests.select("sha").intersect(exact_dedup.screen(batch, filters, buckets).select("sha")).count() == 1
