import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from landloom.llm import alignment
from landloom.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def brute(rows):
    """Whole texts by both libraries, and every two tokens of a text that overlap (doc_id, text)."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    stand = {}
    for i in range(256):  # which character stands for a byte, as the library itself splits it
        if i < 128:
            stand[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0]] = i
    for lead in range(0xC2, 0xF5):
        for tail in range(0x80, 0xC0):
            raw = bytes([lead, tail]) if lead < 0xE0 else bytes([lead, 0x90 if lead in (0xF0, 0xE0) else 0x80, tail]) if lead < 0xF0 else bytes([lead, 0x90 if lead == 0xF0 else 0x80, 0x80, tail])
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]
            stand.update(zip(shown, raw, strict=True))
    out, every = [], []
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        ia = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ib = b.encode(text or "")
        ba = [bytes(stand[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            every.append((doc_id, [], [], [], []))
            continue
        spans = []
        for parts in (ba, bb):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = []
        low = 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(ib) and spans[1][j][0] < e:
                links.append((ia[i], ib[j]))
                j += 1
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ["|".join(",".join(str(x) for x, (s, e) in zip(ids, sp, strict=True) if lo <= s and e <= hi) for ids, sp in ((ia, spans[0]), (ib, spans[1]))) for lo, hi in zip([0, *common], common, strict=False)] if len(ia) < 3000 else None
        every.append((doc_id, ia, ib, common if groups is None else groups, links))
    count = Counter(x for *_, links in every for x in links)
    highest = defaultdict(int)
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    for doc_id, ia, ib, groups, links in every:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and isinstance(groups[0], str) else "" if not groups else None
        out.append((doc_id, len(ia), len(ib), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r[:7])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("sent", [0, alignment.BROADCAST_PAIRS])
def test_odd_texts(spark, odd_documents, sent):
    more = ["▁a b", "a  b   c\n d", " x", "  ", "<|endoftext|> </s> <s>", "<0x41> \x00", "tab\t x  y", "日本語 テキスト", "é ﬁ ａ", "x \x1c y", "don't  we'Ll  '", "a  b", "one two", "one two"]
    docs = odd_documents.select("doc_id", "text", "ids", "part").unionByName(spark.createDataFrame([(100 + i, t, "i", "p") for i, t in enumerate(more)] + [(None, "one two", "i", "p")], "doc_id long, text string, ids string, part string"))
    rows, pairs = alignment.align_corpus(docs, A, B, broadcast_pairs=sent)
    same([tuple(r) for r in rows.collect()], brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert pairs.where("best = 1").count() >= pairs.selectExpr("pair & 4294967295 AS b").distinct().count()


def test_a_space_at_the_end(spark):
    texts = ["a ", "one two ", "one two  ", " ", "é ", "! ", "a\n ", "x \n", "one ", "one", "▁ ", "one two ", "a b\t "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, _ = alignment.align_corpus(docs, A, B)
    got = [tuple(r) for r in rows.collect()]
    same(got, brute(list(enumerate(texts))))
    assert {r[0] for r in got if r[1] == 0} == {10}


def test_op12_over_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same([tuple(r) for r in QUERIES["op12_alignment"](spark, SF).collect()], brute(docs))


def test_empty_table(spark, odd_documents):
    rows, _ = alignment.align_corpus(odd_documents.where("doc_id < 0"), A, B)
    assert rows.count() == 0


@pytest.mark.parametrize("a,b,groups,links", [([3, 2, 2], [1, 4, 2], [(0, 2, 0, 2), (2, 3, 2, 3)], [(0, 0), (0, 1), (1, 1), (2, 2)]), ([5], [2, 3], [(0, 1, 0, 2)], [(0, 0), (0, 1)]), ([], [], [], [])])
def test_links_within_a_group(a, b, groups, links):
    got, (x, y) = alignment.align(np.array(a, int), np.array(b, int))
    assert list(zip(*(g.tolist() for g in got), strict=True)) == groups and list(zip(x.tolist(), y.tolist(), strict=True)) == links


def test_links_are_all_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        total = int(rng.integers(2, 60))
        a, b = (np.diff(np.unique([0, total, *rng.integers(1, total, int(rng.integers(0, 20)))])) for _ in range(2))
        ends_a, ends_b = np.cumsum(a), np.cumsum(b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if min(ends_a[i], ends_b[j]) > max(ends_a[i] - a[i], ends_b[j] - b[j])]
        assert sorted(zip(*(x.tolist() for x in alignment.align(a, b)[1]), strict=True)) == want
