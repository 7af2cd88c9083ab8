import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from landloom.llm import byte_bpe, dac

BYTE, WORD = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
PAIR = (BYTE, public_tokenizers.PATTERN)


def test_byte_bpe_is_that_of_whole_texts(spark, odd_documents):
    import tiktoken

    whole = byte_bpe.encoding(BYTE, public_tokenizers.PATTERN)
    assert isinstance(whole, tiktoken.Encoding)
    for chunk, overlap in ((64, 16), (1000, 100), (byte_bpe.CHUNK, byte_bpe.OVERLAP)):
        got = sorted((r.doc_id, bytes(r.ids)) for r in byte_bpe.encode(odd_documents, BYTE, public_tokenizers.PATTERN, chunk, overlap).collect())
        want = sorted((r.doc_id, np.array(whole.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in odd_documents.collect())
        assert got == want
        digests = sorted(tuple(r)[:4] for r in byte_bpe.encode_digests(odd_documents, BYTE, public_tokenizers.PATTERN, True, chunk, overlap).collect())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        ids = [(r.doc_id, whole.encode_ordinary(r.text or ""), r.text or "") for r in odd_documents.collect()]
        assert digests == sorted((d, len(x), sha(",".join(map(str, x)).encode()), sha(t.encode())) for d, x, t in ids)
        for r in odd_documents.where("doc_id = 8").collect():
            assert byte_bpe.decode(dict(got)[8], BYTE, public_tokenizers.PATTERN) == r.text.encode()


def test_resync_skips_boundaries_after_white_space():
    text = "aa bb\n\n\n  cc dd ee"
    at = byte_bpe.resync(text, 3, public_tokenizers.PATTERN)
    assert text[at - 1] != " " and at > 3
    assert byte_bpe.resync("x" * 50, 10, public_tokenizers.PATTERN) == -1


def test_codes_round_trip_and_address_every_token():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([0]), np.array([2**32 - 1, 5, 255, 256]), rng.integers(0, 49408, 5000), rng.integers(0, 2**20, 3000)):
        levels, bitmaps, ranks = dac.pack(ids)
        assert dac.unpack(levels, bitmaps).tolist() == ids.tolist()
        assert dac.tokens_at(levels, bitmaps, ranks, np.arange(0, len(ids), 7)).tolist() == ids[::7].tolist()
        assert dac.tokens_at(levels, bitmaps, ranks, np.arange(len(ids))[::-1]).tolist() == ids[::-1].tolist()


def test_files_hold_the_library_s_ids(spark, odd_documents, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in dac.write_and_read(odd_documents, WORD, 2).collect())
    start, want = 0, []
    for r in sorted(odd_documents.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark, odd_documents):
    none = odd_documents.where("doc_id < 0")
    assert dac.write_and_read(none, WORD, 2).count() == 0
    assert byte_bpe.encode(none, BYTE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("word", ["<|endoftext|>", "don't", "x'Re", "ÀÉ12..ab", "ß'", " ", "ΑΣ"])
def test_word_codes(word):
    codes = dac.WordCodes(WORD)
    texts = [word, f" a\t{word} {word}\r\n", "", None, "\n"]
    got = codes.encode(pa.RecordBatch.from_pydict({"text": texts}))
    assert [x.astype("<u4").tobytes() for x in got] == [codes.ids(t or "") for t in texts]


def test_lookup_by_random_access(spark, odd_documents, tmp_path):
    docs = odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    path = str(tmp_path / "tokens")
    dac.write(docs, WORD, 2, path, doc_bytes=60_000)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    wanted = [(d, p) for d, x in ids.items() for p in {0, len(x) - 1, len(x), -1, len(x) // 2}] + [(77, 0)]
    got = {(r.doc_id, r.position): r.id for r in dac.lookup(spark.createDataFrame(wanted, "doc_id long, position long"), path).collect()}
    assert got == {(d, p): ids[d][p] if d in ids and 0 <= p < len(ids[d]) else None for d, p in wanted}


def test_another_splitter_is_refused(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.BPE()).save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="splitter"):
        dac.WordCodes(str(tmp_path / "t.json"))
