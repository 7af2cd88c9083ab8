"""Quality classifier: histogram gradient-boosted trees over document statistics.

Learns ``quality`` labels from rows whose crc32(doc_id) mod 5 isn't 0 (at most ``gbt.FIT_ROWS`` of them) and
scores every row; the inputs are statistics of the text alone. Null and empty texts have zero statistics and
are scored like any other. Without labels the score is constant 0.5. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm import doc_stats, gbt
from landloom.llm.staging import crc_bucket, stage


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    stats = stage(doc_stats.doc_stats(docs).select("doc_id", "inputs").withColumn("held_out", crc_bucket() == 0), "stats")
    x, y = gbt.labelled(stats.where(~F.col("held_out")), labels, "quality")
    scored = gbt.add_score(stats, gbt.fit(x, y, trees=100, depth=5, rate=0.1, bins=128))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
