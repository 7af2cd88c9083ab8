"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm import alignment, byte_bpe, dac, divergence, exact_dedup, html_crf, jaccard, kd_shards, lm, mixing, quality_model, quality_rules, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability and whether it is sampled."""
    return mixing.sample(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal normalised texts; half of the ids are the immutable snapshot."""
    docs = _table(spark, sf_dir, "documents")
    return exact_dedup.dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).drop("matched_snapshot")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base rules and verdict of the monotonic trees."""
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = _table(spark, sf_dir, "pages")
    return html_crf.extract(pages, html_crf.train(pages))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written in directly addressable codes in doc_id order and read back from the files."""
    import public_tokenizers

    return dac.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by histogram trees; a fifth of the ids is held out."""
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards of near equal bytes."""
    dealt = kd_shards.shard(_table(spark, sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of four-word shingles and its component of links of at most four bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, k=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by a backoff automaton and by smoothed single tokens."""
    return lm.train_and_score(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the bytes decoded from them."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"), path, pattern)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distances to the others of its language, and the terms in which it exceeds its language."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between two tokenizers' ids, with the links' counts in the corpus."""
    import public_tokenizers

    rows, _ = alignment.align_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links of five-word shingles' similarity of 0.8 or more."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), words=5, percent=80)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_quality_rules, op4_main_text, op5_token_codes, op6_quality_model, op7_kd_shards, op8_simhash, op9_lm_scores, op10_byte_bpe, op11_divergence, op12_alignment, op13_jaccard)}

ORACLES = {
    "op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, k.n AS all_n, v.v, v.total
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + 2 * v) AS p, 1 + (1000000000 * (all_n + 2)) // (total + 2 * v) AS q FROM x),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
""",
}
