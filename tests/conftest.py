import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    home = tempfile.mkdtemp(prefix="spark-")
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", home).config("spark.checkpoint.dir", f"{home}/checkpoints").config("spark.sql.warehouse.dir", f"{home}/warehouse").getOrCreate()
    )
