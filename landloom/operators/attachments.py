"""The store of boundary files: one per site, last write wins; bundles out and in."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from landloom.functions.text import content_hash
from landloom.sources.tables import written

FORMAT_VERSION = 2


def list_attachments(store: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Attachments without their bytes."""
    out = store.select(*(c for c in store.columns if c != "content"))
    return out if keys is None else out.join(keys.select("site_key"), "site_key", "left_semi")


def upsert_attachments(store: DataFrame, new: DataFrame) -> DataFrame:
    """The last of each site by uploaded_at, then seq; the new before the old on a tie. Unread files are kept as unparsed."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy("site_key").orderBy(F.desc("uploaded_at"), F.desc("_new"), F.desc("seq"))
    out = both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_new")
    return out.withColumn("parse_status", F.coalesce("parse_status", F.lit("unparsed")))


def remove_attachments(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("site_key"), "site_key", "left_anti")


def storage_usage(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("attachments"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def export_bundle(store: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (path, content), the manifest (an entry an attachment), and its head (version, totals, confidentiality)."""
    named = store.withColumn("path", F.concat(F.lit("files/"), "sha256", F.lit(".kmz")))
    files = named.groupBy("path").agg(F.any_value("content").alias("content"))
    carried = [c for c in ("parse_status", "parse_warnings", "point", "geometry", "seq") if c in store.columns]
    manifest = named.select("site_key", "path", "filename", "size_bytes", "sha256", "uploaded_at", *carried)
    head = store.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")).select(F.lit(FORMAT_VERSION).alias("format_version"), "entries", "total_bytes", F.lit(True).alias("confidential"))
    return files, manifest, head


def write_bundle(store: DataFrame, path: str) -> None:
    """The bundle below a folder: files and manifest as Parquet (contents are bytes), the head as JSON."""
    files, manifest, head = export_bundle(store)
    files.write.mode("overwrite").parquet(f"{path}/files")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    head.write.mode("overwrite").json(f"{path}/head")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, manifest and head of a written bundle; an unknown format version is refused."""
    head = spark.read.schema("format_version int, entries long, total_bytes long, confidential boolean").json(f"{path}/head")
    version = head.first()["format_version"]
    if version != FORMAT_VERSION:
        raise ValueError(f"unknown bundle format {version}")
    return spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/manifest"), head


def import_bundle(manifest: DataFrame, files: DataFrame, store: DataFrame, policy: str = "keep-existing", version: int = FORMAT_VERSION) -> DataFrame:
    """Each entry with its outcome: missing-file, checksum-mismatch, skipped (conflict), imported or replaced."""
    if version != FORMAT_VERSION:
        raise ValueError(f"unknown bundle format {version}")
    if policy not in ("keep-existing", "replace"):
        raise ValueError(f"unknown policy {policy}")
    sums = files.select("path", content_hash("content").alias("actual"))
    held = store.select("site_key").distinct().withColumn("held", F.lit(True))
    joined = manifest.join(sums, "path", "left").join(held, "site_key", "left")
    outcome = F.when(F.col("actual").isNull(), "missing-file").when(F.col("actual") != F.col("sha256"), "checksum-mismatch").when(F.col("held") & F.lit(policy == "keep-existing"), "skipped").when(F.col("held"), "replaced").otherwise("imported")
    return joined.withColumn("outcome", outcome).drop("held")


def applied(outcomes: DataFrame, manifest: DataFrame, files: DataFrame, store: DataFrame) -> DataFrame:
    """The store with the accepted entries of a bundle (outcomes: site_key, outcome) put into it: theirs replace what a site had."""
    accepted = outcomes.where("outcome in ('imported', 'replaced')").select("site_key")
    named = manifest.join(accepted, "site_key", "left_semi").join(files, "path").drop("path")
    more = [c for c in store.columns if c not in named.columns]
    new = named.select(*(F.lit(None).cast(store.schema[c].dataType).alias(c) if c in more else F.col(c).cast(store.schema[c].dataType) for c in store.columns))
    if "parse_status" in store.columns:
        new = new.withColumn("parse_status", F.coalesce("parse_status", F.lit("unparsed")))
    return remove_attachments(store, accepted).unionByName(new)


class VersionedStore:
    """Attachments below a shared folder, as whole versions.

    A version is a Parquet table in a folder of its own; it exists once its number is committed, which one small file does (``commits/n=<number>``, refused if
    the number was taken meanwhile). Readers take the highest committed number, or any earlier one, so they never see half a version, and a writer
    that dies leaves a folder that nobody reads. Contents are rewritten only for what a version changes and keeps: as one table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def versions(self) -> dict[int, str]:
        """Committed numbers and the folders of their tables; one row a version."""
        try:
            rows = self.spark.read.schema("n int, folder string").json(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return {r["n"]: r["folder"] for r in rows}

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or an earlier one; an empty table before the first."""
        known = self.versions()
        if not known and version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(known[max(known) if version is None else version])

    def commit(self, content: DataFrame) -> int:
        """``content`` as the next version."""
        number, folder = max(self.versions(), default=0) + 1, f"{self.path}/data/{uuid.uuid4().hex}"
        content.select(*self.schema.names).write.parquet(folder)
        entry = self.spark.range(1).select(F.lit(folder).alias("folder"))
        entry.coalesce(1).write.mode("errorifexists").json(f"{self.path}/commits/n={number}")
        return number

    def put(self, new: DataFrame) -> int:
        return self.commit(upsert_attachments(self.read(), new))

    def remove(self, keys: DataFrame) -> int:
        return self.commit(remove_attachments(self.read(), keys))

    def clear(self) -> int:
        return self.commit(self.read().where("false"))

    def load_bundle(self, path: str, policy: str = "keep-existing") -> DataFrame:
        """Import a written bundle: the accepted entries become a new version. Returns each entry's outcome."""
        files, manifest, head = read_bundle(self.spark, path)
        store = self.read()
        outcomes = written(import_bundle(manifest, files, store, policy, head.first()["format_version"]), "outcomes")
        self.commit(applied(outcomes, manifest, files, store))
        return outcomes


def import_summary(outcomes: DataFrame) -> DataFrame:
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return outcomes.agg(n("imported").alias("imported"), n("replaced").alias("replaced"), n("skipped").alias("skipped"), n("missing-file", "checksum-mismatch").alias("rejected"))


def orphaned_imports(outcomes: DataFrame, index: DataFrame) -> DataFrame:
    """Imported site keys that no present record has: kept, and reported."""
    return outcomes.where("outcome in ('imported', 'replaced')").select("site_key").join(index.select("site_key"), "site_key", "left_anti")
