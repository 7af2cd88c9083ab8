import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    home = tempfile.mkdtemp(prefix="spark-")
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", home)
        .config("spark.checkpoint.dir", f"{home}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with computed ones."""
    rows = [
        (1, None, None, None, None, "x"),
        (2, "", "en", "a", 0, "x"),
        (3, " \t\n", "en", "a", 3, None),
        (4, "one two three four five six", "en", "b", 27, "y"),
        (5, "one  two three\nfour five six", "de", None, 28, "y"),
        (5, "one  two three\nfour five six", "de", None, 28, "y"),
        (6, "word " * 30_000 + "end", "en", "b", 150_003, "z"),
        (7, "x" * 70_000, "en", "b", 70_000, "z"),
        (8, "Ünïcode ❤ emoji nbsp 'tis 'S naïve line İstanbul ΑΣ é", "fr", "c", 40, "z"),
        (9, "\n\n\n  \n a  b\n\n" * 4000, "fr", "c", 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").withColumns({"sha": __import__("pyspark").sql.functions.lit(1), "part": __import__("pyspark").sql.functions.lit("p")})
