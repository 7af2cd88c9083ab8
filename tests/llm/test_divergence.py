import re
from collections import Counter, defaultdict

import pytest

from landloom.llm import divergence
from landloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least_docs=divergence.LEAST_DOCS):
    """All figures by plain integers, from (text, lang, source)."""
    found, df = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        key = (lang or "", source or "")
        groups.add(key)
        found[key].update(terms)
        df[key[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least_docs]
        v = len(kept)

        def shares(count, kept=kept, v=v):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        own = {s: shares(found[lang, s]) for g, s in groups if g == lang}
        q = shares(sum((found[g] for g in groups if g[0] == lang), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in own.items():
            pairs = sorted(((-sum(f(p[t], r[t]) for t in kept), o.encode(), o) for o, r in own.items() if o != s))
            out += [(lang, s, "pair", o, -x, i) for i, (x, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[t], q[t]), t.encode(), t) for t in kept if found[lang, s][t] and p[t] > q[t])
            out += [(lang, s, "term", t, -x, i) for i, (x, _, t) in enumerate(terms[: divergence.RANKS], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("how", [{}, {"size": 2, "terms_of": 5}, {"size": 3, "terms_of": 40, "sent_groups": 0}])
def test_cells_sum_to_whole_divergences(spark, how):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [("Zebra zebra ZEBRA é É", "en", f"extra{i}") for i in range(9)] + [(None, "en", "none"), ("", "qq", "a"), ("only words here", "qq", "b"), ("x", None, None), ("x", None, "y")]
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")
    assert told(divergence.audit(docs, least_docs=4, **how)) == brute(rows, 4)


def test_odd_texts_and_none(spark, odd_documents):
    assert told(divergence.audit(odd_documents, least_docs=1)) == brute([(r.text, r.lang, r.source) for r in odd_documents.collect()], 1)
    assert divergence.audit(odd_documents.where("doc_id < 0")).count() == 0


def test_shares_of_huge_counts(spark):
    got = spark.sql("select 9000000000000000 as n, 90000000000000000 as total, 7 as kinds").select(divergence.share("n", "total", "kinds").alias("p")).first().p
    assert got == 1 + 10**9 * (9 * 10**15 + 2) // (9 * 10**16 + 14)


def test_op11_over_the_whole_table(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(QUERIES["op11_divergence"](spark, SF)) == brute(rows) and "op11_divergence" in ORACLES
