"""Tables written below ``spark.checkpoint.dir`` and read again, to cut long plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only on a local master without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-landloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by four tasks a core, for reads inside: Spark's default gives a task to each folder, which takes longer than its listing."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/landloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _on_disk(spark: SparkSession, path: str) -> str | None:
    """A path of a mounted file system as Python opens it, None of any other store."""
    store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    whole = path if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path) else f"{store.rstrip('/')}{path}" if not store.startswith("file:") else f"file:{path}"
    return re.sub("^file:/*", "/", whole) if whole.startswith("file:") else None


def land_files(files: DataFrame, path: str, extension: str) -> None:
    """Small text files of rows (folder, content), one each: <path>/<folder>/part-0.<extension>. Folders are named key=value.

    On a mounted file system tasks write them through Python: Hadoop's local file system starts a process several times a file to set its mode,
    which takes far longer than the file. Other stores are written by Spark's own writer. A task that runs again writes the same files.
    """
    spark = files.sparkSession
    root = _on_disk(spark, path)
    if root is None:
        key = F.split("folder", "=")
        name = files.select(key[0].alias("k")).first()
        if name is not None:
            text = F.regexp_replace("content", "\\n\\z", "")  # the writer ends a line itself
            files.select(key[1].alias(name["k"]), text.alias("value")).write.option("extension", extension).partitionBy(name["k"]).text(path)
        return

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for folder, content in zip(b.column("folder").to_pylist(), b.column("content").to_pylist(), strict=True):
                os.makedirs(f"{root}/{folder}", exist_ok=True)
                own = f"{root}/{folder}/.{uuid.uuid4().hex}"  # a name that readers leave out, until the file is whole
                with open(own, "w", encoding="utf-8", newline="") as out:
                    out.write(content)
                os.replace(own, f"{root}/{folder}/part-0.{extension}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    files.select("folder", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row
