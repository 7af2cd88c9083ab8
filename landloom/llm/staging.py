"""Written tables that cut lineage, and small shared helpers.

Tables are staged as Parquet below ``spark.checkpoint.dir``, which every executor sees, so a lost
executor costs a re-read and not a re-computation. The setting is read from the session; only where it is
unset (tests on one machine) a temporary folder is made and set. Tables that a lazy result doesn't read are deleted
as soon as it is known which those are (``passing``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.arrow import small_batches


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a new temporary one only on a local master without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-landloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders written in each of the open ``passing`` blocks, the innermost last.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes, when left, the tables staged meanwhile but for ``lasting`` ones: nothing may read them from then on."""
    written: list[str] = []
    token = _PASSING.set((*_PASSING.get(), written))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for x in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to a new folder of the shared directory and read it back. ``lasting``: it outlives the innermost block of ``passing``."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/landloom/{uuid.uuid4().hex}"
    path, blocks = f"{top}/{name}", _PASSING.get()
    if blocks := blocks[:-1] if lasting else blocks:
        blocks[-1].append(top)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null counts as empty) alone: other columns can't clash with computed ones."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_bucket(doc_id: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the limit, else as it is (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def split_join(left: DataFrame, right: DataFrame, on: str, size: str, total: int, how: str = "inner", least: int = 2_000, most: int = 50_000) -> DataFrame:
    """``left`` joined with the rows of ``right`` (one a key, which holds in column ``size`` how many rows of ``left`` have it), whatever one key holds.

    Keys of a large part of all rows are at most ``most``: they are broadcast and their rows stay where they are. The others are shuffled.
    """
    hot = right.where(F.col(size) > max(least, total // most))
    keys = F.broadcast(hot.select(on))
    cold = left.join(keys, on, "left_anti").join(right.where(F.col(size) <= max(least, total // most)), on, how)
    return cold.unionByName(left.join(F.broadcast(hot), on))
