import numpy as np
import pytest

import corpus_pipeline
from landloom.llm import byte_bpe, queries, staging
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import brute_similar, components_of


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(vocab, 150)) + "."
        rows.append((i, text if i % 6 else " ".join(f"{w}###" for w in text.split()), "en" if i % 3 else "de", f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[i + 1][1].replace(" ", "  "), "en", "s0", 1) for i in range(4)]
    rows += [(300 + i, rows[i + 13][1].replace("w1 ", "w2 ") + " extra", "en", "s0", 1) for i in range(5)]
    rows += [rows[7], rows[7], (400, None, None, None, None), (401, "", "en", "s1", 0), (402, "few words", "en", "s1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def test_stages_against_brute_force(spark, sf):
    from landloom.llm.staging import stage

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = []
    for name, f in corpus_pipeline.STAGES:
        got = stage(f(spark, docs, sf), name)
        if name != "byte_bpe":
            assert got.columns == docs.columns
        after.append((docs.collect(), got.collect()))
        docs = got
    (raw, good), (_, once), (_, apart), (_, mixed), (_, coded) = after
    assert {r.doc_id for r in good} == {r.doc_id for r in raw if brute_counts(r.text)[0] >= 20 and r.doc_id % 6 or 200 <= r.doc_id < 400}
    assert sorted(r.doc_id for r in once) == sorted({d for d, keep, *_ in brute_exact(good) if d == keep})
    once = sorted(once, key=lambda r: r.doc_id)
    root = components_of(len(once), brute_similar([r.text for r in once], 5, 0.8))
    assert {r.doc_id for r in apart} == {once[i].doc_id for i in root}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in apart} and len(mixed) > 0.3 * len(apart)
    enc = byte_bpe.encoding(*__import__("tests.llm.test_tokens", fromlist=["BYTE"]).__dict__["PAIR"])
    text = {r.doc_id: r.text for r in mixed}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in coded} == {d: enc.encode_ordinary(t) for d, t in text.items()}


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]


def test_ids_that_repeat_or_are_null(spark):
    """An id on two texts loses only the copy, and rows without an id lose theirs."""
    rng = np.random.default_rng(5)
    a, b, c, d, e = (" ".join(rng.choice([f"v{i}" for i in range(2000)], 200)) for _ in range(5))
    rows = [(1, a), (1, b), (2, c), (3, c), (3, d), (None, e), (None, e), (None, a), (4, d + " "), (5, b), (5, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    once = corpus_pipeline.exact(spark, docs, "")
    assert key(once) == sorted([(1, a), (1, b), (2, c), (0, e), (4, d + " ")])
    assert key(corpus_pipeline.exact(spark, docs.where("text = '" + e + "'"), "")) == [(0, e)]
    kept = [(7, a), (7, b), (6, a + " more"), (None, c), (None, c + " more"), (8, d), (None, d + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in kept], docs.schema)
    got = key(corpus_pipeline.near(spark, docs, ""))
    assert len(got) == 4 and {(7, b), (6, a + " more"), (8, d)} <= set(got) and sum(i == 0 for i, _ in got) == 1


def test_columns_whose_names_clash_pass_through(spark):
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(rng.choice([f"v{i}" for i in range(2000)], 200)) for _ in range(3))
    names = ("_row", "_sha", "_best", "_t", "_source", "_topic", "node", "root", "component", "Prob")
    rows = [(1, a, "en", "s", 1), (2, a + " ", "en", "s", 1), (3, b, "en", "s", 1), (4, b + " more", "en", "s", 1), (5, c, None, None, 1)]
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage, kept in ((corpus_pipeline.exact, {2, 3, 4, 5}), (corpus_pipeline.near, {1, 3, 5}), (corpus_pipeline.mixed, None)):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        found = got.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in found for n in names) and (kept is None or {r.doc_id for r in found} == kept)


def test_every_planted_near_copy_is_found(spark):
    """Short texts and skewed words, at similarities from 0.8 up: all pairs above the bound fall into one component."""
    rng = np.random.default_rng(12)
    words = np.array([f"k{i}" for i in range(400)])
    skew = 1 / np.arange(1, 401)
    texts = []
    for k in range(60):
        base = rng.choice(words, int(rng.choice([25, 60, 250])), p=skew / skew.sum()).tolist()
        copy = list(base)
        for at in rng.choice(len(base), max(1, len(base) // 60), replace=False):
            copy[int(at)] = f"new{k}"
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(components_of(len(texts), brute_similar(texts, 5, 0.8)))


def test_exact_leaves_texts_where_they_are(spark, sf):
    """Rows that go are broadcast by their keys, so whole texts aren't shuffled, with or without Spark's own broadcasts."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id <> 7")
        got = corpus_pipeline.exact(spark, docs, sf)
        assert got.count() < docs.count() and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("step", [corpus_pipeline.exact, corpus_pipeline.near])
def test_tables_that_the_result_does_not_read_are_gone(spark, sf, step, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = step(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    read = {p.split("/landloom/")[1].split("/")[0] for p in got.inputFiles() if "/landloom/" in p}
    assert read and {p.name for p in (tmp_path / "landloom").iterdir()} == read
    assert 0 < got.count() < 132
