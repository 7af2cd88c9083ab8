"""Records, dirty names and other inputs that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.text import place_key
from landloom.operators import places, rollup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks by a key: a small file is read by one task, and what is made of its rows is far larger. With a number, Spark doesn't join the parts again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record an order: business, state (region), district (nation), site (customer), area (price)."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.select(F.concat(F.lit("row-"), "o_orderkey").alias("record_id"), F.col("o_orderkey").alias("source_row_number"), F.col("c_mktsegment").alias("business"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("c_name").alias("site"), F.col("o_totalprice").alias("area"), F.col("o_orderdate").alias("loaded"))


def blanked(df: DataFrame, every: int, column: str, key: str = "source_row_number") -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) % every != 0, F.col(column)))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a total and its parts by return flag, and used and unused by line status; some changed, some null."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    on = lambda c, v: F.coalesce(F.sum(F.when(F.col(c) == v, price)), F.lit(0.0))
    sums = li.groupBy("l_orderkey").agg(F.sum(price).alias("total"), on("l_returnflag", "A").alias("sale"), on("l_returnflag", "N").alias("lease"), on("l_returnflag", "R").alias("govt"), on("l_linestatus", "O").alias("used"), on("l_linestatus", "F").alias("unused"))
    k = F.col("l_orderkey")
    sums = sums.withColumns({"total": F.when(k % 7 == 0, F.col("total") + 5).otherwise(F.col("total")), "sale": F.when(k % 11 != 0, F.col("sale")), "used": F.when(k % 13 != 0, F.col("used"))})
    rec = records(spark, sf_dir)
    return rec.join(sums, rec.source_row_number == sums.l_orderkey).drop("l_orderkey")


NBSP = " "
STATE_ALIASES = [("std", "STANDARD"), ("broken", "ATLANTIS")]
DISTRICT_ALIASES = [(0, "crimson ring", "red ring", None), (1, "crimson bolt", "red bolt", "SMALL"), (2, "crimson gear", "purple gear", None), (3, "crimson ring", "red rod", "LARGE")]


def dirty_state(k: Column, s: Column) -> Column:
    m = k % 13
    return F.when((m == 0) & (s == "STANDARD"), "Std").when(m == 1, "Nowhere").when(m == 2, F.concat(F.lower(s), F.lit(NBSP))).when(m == 3, "N/A").when(m == 4, "BROKEN").when(m == 5, F.concat(s, F.right(s, F.lit(1)))).otherwise(s)


def dirty_district(k: Column, s: Column) -> Column:
    m = k % 11
    return (
        F.when(m == 0, F.upper(s)).when(m == 1, F.concat(F.replace(s, F.lit(" "), F.lit("  ")), F.lit(NBSP))).when(m == 2, F.concat(s, F.right(s, F.lit(1)))).when(m == 3, F.concat(F.lit("x"), F.substr(s, F.lit(2))))
        .when(m == 4, F.lit(None)).when(m == 5, "tbd").when(m == 6, F.replace(s, F.lit("red "), F.lit("crimson "))).otherwise(s)
    )


def dirty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a part, with its type as state and its name as district, both dirtied by its key."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.cast("string").alias("record_id"), k.alias("source_row_number"), dirty_state(k, F.col("p_type")).alias("state"), dirty_district(k, F.col("p_name")).alias("district"), F.col("p_brand").alias("site"), F.col("p_retailprice").alias("area"))


def part_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s = p.select(F.lit("state").alias("level"), F.lit(None).cast("string").alias("state"), F.col("p_type").alias("name")).distinct()
    d = p.select(F.lit("district").alias("level"), F.col("p_type").alias("state"), F.col("p_name").alias("name")).distinct()
    return places.boundary_dim(s.unionByName(d).withColumn("ordinal", F.crc32(F.col("name").cast("binary"))))


def nation_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = r.select(F.col("r_regionkey").alias("ordinal"), F.lit("state").alias("level"), F.lit(None).cast("string").alias("state"), F.col("r_name").alias("name"))
    d = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("ordinal"), F.lit("district").alias("level"), F.col("r_name").alias("state"), F.col("n_name").alias("name"))
    return places.boundary_dim(s.unionByName(d))


def aliases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(STATE_ALIASES, "from_key string, to string"), spark.createDataFrame(DISTRICT_ALIASES, "ordinal int, from_key string, to string, state string")


def no_aliases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "from_key string, to string"), spark.createDataFrame([], "ordinal int, from_key string, to string, state string")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records joined exactly to the region dimension; some have no district, some a misspelt one."""
    rec = records(spark, sf_dir)
    k = F.col("source_row_number")
    rec = rec.withColumn("district", F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.concat(F.lit("Lost "), "district")).otherwise(F.col("district")))
    dim = nation_dim(spark, sf_dir)
    s = dim.where("level = 'state'").select(F.col("key").alias("s_key"), F.col("name").alias("state_match"))
    d = dim.where("level = 'district'").select(F.col("state").alias("state_match"), F.col("key").alias("d_key"), F.col("name").alias("district_match"))
    joined = rec.withColumn("s_key", place_key("state")).withColumn("d_key", place_key("district")).join(F.broadcast(s), "s_key", "left").join(F.broadcast(d), ["state_match", "d_key"], "left")
    reason = F.when(F.col("state_match").isNull(), "state_unmatched").when(F.col("district_match").isNull(), "district_unmatched")
    return joined.drop("s_key", "d_key").withColumn("reason", reason)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region totals at both levels with the unmapped total beside them, and whether area is conserved."""
    rec = placed(spark, sf_dir)
    regions = rollup.rollup_levels(rec, F.sum("area").alias("value"), *rollup.region_counts())
    totals = rollup.mapped_totals(rec, "district")
    kept = (F.abs(F.col("area_mapped") + F.col("area_unmapped") - F.col("area_total")) < 0.01).alias("conserved")
    return regions.crossJoin(F.broadcast(totals.select("area_unmapped", "unmapped_share", kept)))
