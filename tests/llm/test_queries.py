"""Each numbered query over whole tables of sf0.001, against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from landloom.llm import byte_bpe, html_crf, lm
from landloom.llm.queries import QUERIES
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_lm import brute as brute_lm
from tests.llm.test_lm import same
from tests.llm.test_quality import brute as brute_counts
from tests.llm.test_simhash import brute_fp, brute_roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def rest(i):
    return zlib.crc32(str(i).encode()) % 5


def test_op1(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op1_mixing"](spark, SF).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    tokens, expected = sum(r.n_tokens for r in got.values()), sum(r.n_tokens * r.prob for r in got.values())
    assert 0.1 * tokens - 1 <= expected <= 0.8 * tokens + 1 and all(0 <= r.prob <= 1 for r in got.values())
    cells = defaultdict(set)
    for r in got.values():
        cells[r.source, r.lang, r.topic].add((r.multiplier, r.prob))
    assert all(len(x) == 1 for x in cells.values())


def test_op2(spark, docs):
    got = QUERIES["op2_exact_dedup"](spark, SF).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == brute_exact(docs)


def test_op3_and_op6(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, SF).collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in docs:
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute_counts(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
        assert g.base_failed == (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not (g.base_failed and g.kept)
    found = {r.doc_id: r for r in QUERIES["op6_quality_model"](spark, SF).collect()}
    assert set(found) == {r.doc_id for r in docs} and all(r.held_out == (rest(i) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in found.items())
    held = [i for i in quality if i in found and found[i].held_out]
    assert np.mean([found[i].predicted == quality[i] for i in held]) > 0.8  # some 60 labels to learn from, 19 rows


def test_op4(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op4_main_text"](spark, SF).collect()}
    assert set(got) == set(pages) and all(got[i].url == p.url and got[i].n_chars == len(got[i].text) for i, p in pages.items())
    for i, p in pages.items():  # every line is one of the page's blocks, in page order
        blocks = iter(b.text for b in html_crf.blocks(p.html or ""))
        assert all(any(line == b for b in blocks) for line in got[i].text.split("\n") if line)


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    got = {r.doc_id: r for r in QUERIES["op5_token_codes"](spark, SF).collect()}
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op7(spark, docs):
    got = QUERIES["op7_kd_shards"](spark, SF).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs}
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {(i, len(t) + 1, zlib.crc32(t), "bytes", None) for i, t in text.items()}
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op8(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op8_simhash"](spark, SF).collect()}
    fps = {r.doc_id: brute_fp(r.text) for r in docs}
    roots = brute_roots(list(fps.values()), 4)
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", least[roots[f]]) for i, f in fps.items()}


def test_op9(spark, docs):
    same(QUERIES["op9_lm_scores"](spark, SF).collect(), brute_lm(docs, 3, lm.DISCOUNTS))


def test_op10(spark, docs):
    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = set()
    for r in docs:
        ids = enc.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert {tuple(r)[:4] for r in QUERIES["op10_byte_bpe"](spark, SF).collect()} == want


def test_held_out_rows_are_scored_by_what_training_saw(spark):
    """At sf0.01: the model's log10 a token beats that of single words on held-out rows."""
    got = QUERIES["op9_lm_scores"](spark, SF.replace("0.001", "0.01")).where("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.2
    assert len(got) == sum(rest(i) == 1 for i in pq.read_table(f"{SF.replace('0.001', '0.01')}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist())
