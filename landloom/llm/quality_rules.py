"""Quality rules: fixed base rules, then gradient-boosted trees with monotonic constraints.

Shares of repeated words and lines, symbols, marked words and twins can only lower the score. A document is kept if no base
rule fails and its score reaches ``threshold``. The trees learn from rows with a quality label whose
crc32(doc_id) mod 5 isn't 0 (at most ``gbt.FIT_ROWS`` of them). Without labels the score is constant 0.5, which keeps all that the
base rules keep. Null and empty texts fail the base rules. Null ids are scored like any; repeated rows get
equal results. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm import doc_stats, gbt
from landloom.llm.arrow import slices, small_batches, utf8
from landloom.llm.staging import crc_bucket, stage

LEAST_WORDS, MOST_REPEATED = 20, 30
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "twin_share", "symbol_word_share")
THRESHOLD = 0.3


def train(stats: DataFrame, labels: DataFrame, depth: int = 3) -> gbt.Trees:
    x, y = gbt.labelled(stats, labels, "quality")
    return gbt.fit(x, y, depth=depth, directions={doc_stats.INPUTS.index(c): -1 for c in FALLING})


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, depth: int = 3) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; no text is shuffled. The labelled rows, which are bounded, are read first."""
    chosen = F.broadcast(gbt.chosen_labels(labels, "quality"))  # FIT_ROWS ids at most
    learnt = stage(doc_stats.doc_stats(docs.where(crc_bucket() != 0).join(chosen.select("doc_id"), "doc_id", "left_semi")), "labelled")
    sent = docs.sparkSession.sparkContext.broadcast(train(learnt, labels, depth))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [doc_stats.statistics(t) for t in utf8(b)]
            score = sent.value.score(np.array([x for _, x in found]).reshape(len(found), -1))
            good = [c[0] >= LEAST_WORDS and 100 * c[4] <= MOST_REPEATED * c[0] for c, _ in found]
            yield b.filter(pa.array(np.array(good, bool) & (score >= threshold)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, depth: int = 3) -> DataFrame:
    """doc_id, the plain counts, base_failed, score and kept of every row of ``docs``."""
    stats = stage(doc_stats.doc_stats(docs), "stats")
    scored = gbt.add_score(stats, train(stats.where(crc_bucket() != 0), labels, depth))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
