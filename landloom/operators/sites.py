"""Sites, and matching boundary files to them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions.text import filename_stem, match_key, site_key, site_label
from landloom.operators.places import BROADCAST_ROWS
from landloom.sources.tables import written

#: Tiers of a match, in order.
TIERS = {1: "filename", 2: "filename-contains", 3: "sheet-column"}


def site_index(records: DataFrame, with_members: bool = False) -> DataFrame:
    """site_key, label (of the first record), first_row, records; records without a site are left out.

    ``with_members`` adds record_ids and source_rows, arrays of a whole site; ``site_members`` has them as rows.
    """
    # names as they stand are grouped first, so that keys are made once a name and not once a record
    lists = {"record_ids": "record_id", "source_rows": "source_row_number"} if with_members else {}
    raw = records.groupBy("state", "district", "site").agg(F.min("source_row_number").alias("first"), F.count("*").alias("n"), *(F.collect_list(c).alias(to) for to, c in lists.items()))
    keyed = raw.withColumn("site_key", site_key("state", "district", "site")).where("site_key is not null")
    gathered = [F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in lists]
    return keyed.groupBy("site_key").agg(F.min_by(site_label("site", "first"), "first").alias("label"), F.min("first").alias("first_row"), F.sum("n").alias("records"), *gathered)


def site_members(records: DataFrame) -> DataFrame:
    """site_key, record_id, source_row_number of every record with a site."""
    return records.select(site_key("state", "district", "site").alias("site_key"), "record_id", "source_row_number").where("site_key is not null")


def unsited(records: DataFrame) -> DataFrame:
    return records.where(site_key("state", "district", "site").isNull()).agg(F.count("*").alias("records"))


def site_collisions(index: DataFrame) -> DataFrame:
    return index.where("records > 1")


def hint_column_report(records: DataFrame, column: str | None) -> DataFrame:
    """present, populated, usable and a note on the column that names files."""
    if column is None:
        return records.sparkSession.createDataFrame([(False, 0, False, "No column names files; they are matched by file name.")], "present boolean, populated long, usable boolean, note string")
    n = F.count_if(F.coalesce(F.trim(F.col(column)), F.lit("")) != "")
    out = records.agg(n.alias("populated"), F.count("*").alias("rows"))
    note = F.when(F.col("populated") == 0, F.lit("The column that names files is empty; they are matched by file name.")).otherwise(F.format_string("The column names files in %d of %d rows; they are hints only.", "populated", "rows"))
    return out.select(F.lit(True).alias("present"), "populated", (F.col("populated") > 0).alias("usable"), note.alias("note"))


def _phrases(stems: DataFrame, most: int, shortest: int, longest: int) -> DataFrame:
    """filename and phrase: every run of a stem from one word boundary to another, of at most ``most`` pieces and as long as a label may be."""
    # pieces between word boundaries; a first or last piece of other characters has no boundary at the stem's own begin or end
    parts = stems.select("filename", F.split("stem", "\\b").alias("p")).where(F.size("p") > 0)
    first = F.when(F.regexp_like(F.get("p", F.lit(0)), F.lit("^\\b")), 0).otherwise(1)
    last = F.size("p") - F.when(F.regexp_like(F.element_at("p", -1), F.lit("\\b\\z")), 0).otherwise(1)
    starts = parts.withColumn("last", last).where(first < F.col("last")).withColumn("i", F.explode(F.sequence(first, F.col("last") - 1)))
    runs = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("last") - F.col("i")))))
    phrases = runs.select("filename", F.array_join(F.slice("p", F.col("i") + 1, F.col("n")), "").alias("phrase"))
    return phrases.where(F.char_length("phrase").between(shortest, longest)).distinct()


def match_files(files: DataFrame, index: DataFrame, records: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """filename, site_key, strategy, label, candidates, ambiguous of every file.

    Tiers: the stem is a site's label; a label stands in the stem as a phrase; a record names the file. The
    first tier with a hit decides: one hit binds, several are ambiguous and end the search.

    Sites of one label are one row with their number, and a stem meets labels by its whole phrases (runs of its words no longer than the longest
    label), so neither a label that many sites share nor a word that all labels begin with brings files and sites together in pairs.
    """
    stems = files.select("filename").distinct().withColumn("stem", match_key(filename_stem("filename")))
    one = F.min(F.struct("site_key", "label")).alias("one")
    labels = written(index.select("site_key", "label", match_key("label").alias("lkey")).where("lkey <> ''").groupBy("lkey").agg(F.count("*").alias("n"), one), "labels")
    size = F.char_length("lkey")
    bounds = labels.agg(F.max(F.size(F.split("lkey", "\\b"))).alias("pieces"), F.min(size).alias("least"), F.max(size).alias("most"), F.count("*").alias("n")).first()
    sent = F.broadcast(labels) if bounds["n"] <= BROADCAST_ROWS else labels
    hits = stems.join(sent, stems.stem == sent.lkey).select("filename", F.lit(1).alias("tier"), "n", "one")
    if bounds["n"]:
        near = _phrases(stems, bounds["pieces"], bounds["least"], bounds["most"])
        hits = hits.unionByName(near.join(sent, near.phrase == sent.lkey).select("filename", F.lit(2).alias("tier"), "n", "one"))
    if records is not None and hint is not None:
        named = records.select(site_key("state", "district", "site").alias("site_key"), F.explode(F.split(F.col(hint), "[,;|\\n]")).alias("piece")).where("site_key is not null")
        named = named.select("site_key", match_key(filename_stem(F.trim("piece"))).alias("stem")).where("stem <> ''").distinct()
        named = named.join(index.select("site_key", "label"), "site_key").groupBy("stem").agg(F.count("*").alias("n"), one)
        hits = hits.unionByName(stems.join(named, "stem").select("filename", F.lit(3).alias("tier"), "n", "one"))
    found = hits.groupBy("filename", "tier").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    found = found.groupBy("filename").agg(F.min(F.struct("tier", "n", "one")).alias("x")).select("filename", "x.*")
    strategy = F.element_at(F.array(*(F.lit(TIERS[i]) for i in (1, 2, 3))), F.col("tier"))
    only = F.col("n") == 1
    return stems.join(found, "filename", "left").select("filename", F.when(only, F.col("one.site_key")).alias("site_key"), F.when(only, strategy).alias("strategy"), F.when(only, F.col("one.label")).alias("label"), F.coalesce("n", F.lit(0)).alias("candidates"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def sites_without_file(index: DataFrame, matches: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    out = index.join(matches.where("site_key is not null").select("site_key"), "site_key", "left_anti")
    return out if attachments is None else out.join(attachments.select("site_key"), "site_key", "left_anti")


def site_coverage(index: DataFrame, attachments: DataFrame) -> DataFrame:
    """Sites, with a file, unreadable, plottable, and per cent with a file."""
    a = attachments.select("site_key", "parse_status", "point")
    c = index.select("site_key").join(a, "site_key", "left").agg(F.count("*").alias("sites"), F.count_if(F.col("parse_status").isNotNull()).alias("with_file"), F.count_if(F.col("parse_status") == "unparseable").alias("unreadable"), F.count_if((F.col("parse_status") == "parsed") & F.col("point").isNotNull()).alias("plottable"))
    return c.withColumn("percent", F.when(F.col("sites") > 0, F.col("with_file") / F.col("sites") * 100).otherwise(0.0))


def plottable_sites(index: DataFrame, attachments: DataFrame) -> DataFrame:
    return index.select("site_key", "label").join(attachments.where("parse_status = 'parsed' and point is not null").select("site_key", "point"), "site_key")
