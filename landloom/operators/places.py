"""Resolving dirty place names onto a two-level region dimension: exact, alias, fuzzy, or refused.

Names are resolved once each, not once a record. The boundary dimension is read from files of bounded size (states and
districts of one country); its size is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions.text import is_place_name, place_key
from landloom.sources.tables import written

THRESHOLD, CANDIDATES = 0.88, 5
#: Rows of a dimension that are broadcast at most; larger ones go by a shuffle join.
BROADCAST_ROWS = 200_000
#: Names of a pool that come to a name as one array, and such arrays (some 40 KB each) that are broadcast at most.
POOL, POOLS = 1_000, 2_000
#: Parts that records are dealt in where they meet more pairs of names than are broadcast.
SALTS = 16


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def boundary_dim(features: DataFrame) -> DataFrame:
    """Features (ordinal, level, state, name) with a key; the first of a (level, state, key) wins."""
    keyed = features.withColumn("key", place_key("name"))
    state = F.when(F.col("level") == "district", F.col("state"))
    first = W.partitionBy("level", state, "key").orderBy("ordinal")
    return keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _refused(stage: Column) -> Column:
    return F.coalesce(stage, F.lit(4))


def _fuzzy(names: DataFrame, pool: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """For each (on..., key): the number of candidates at the threshold, the best name, the best five.

    A block's names (a state's districts, or all states) come to a name as arrays of some ``POOL`` names, are scored and ranked within the row, and only
    each array's best five go on: no pairs are written, shuffled or sorted, and no array grows with the dimension.
    """
    blocks = max(1, -(-pool.count() // POOL))
    pools = pool.groupBy(*on, F.pmod(F.xxhash64("key", "name"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("key", "name")).alias("pool")).drop("_block")
    sent = small(pools, POOLS)
    with_pool = names.join(sent, on) if on else names.join(sent, F.lit(True))
    scored = F.transform("pool", lambda p: F.struct((-similarity(F.col("key"), p["key"])).alias("minus"), p["name"].alias("name")))
    ranked = with_pool.select(*on, "key", F.array_sort(scored).alias("ranked"))
    ranked = ranked.select(*on, "key", F.size(F.filter("ranked", lambda x: -x["minus"] >= threshold)).alias("clear"), F.slice("ranked", 1, CANDIDATES).alias("ranked"))
    if blocks > 1:
        ranked = ranked.groupBy(*on, "key").agg(F.sum("clear").cast("int").alias("clear"), F.slice(F.array_sort(F.flatten(F.collect_list("ranked"))), 1, CANDIDATES).alias("ranked"))
    top = F.transform("ranked", lambda x: F.struct((-F.round(-x["minus"], 3)).alias("minus"), x["name"].alias("name")))
    return ranked.select(
        *on, "key", "clear", F.col("ranked")[0]["name"].alias("best"), (-F.col("ranked")[0]["minus"]).alias("best_score"),
        F.transform(F.array_sort(top), lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("score"))).alias("candidates"),
    )


def _detail(label: Column, reason: Column) -> Column:
    return (
        F.when(reason == "no_name", "No usable name.")
        .when(reason == "state_unmatched", "Its state is not resolved, so no district is searched.")
        .when(reason == "broken_alias", F.format_string("The alias of \"%s\" names no known region.", label))
        .when(reason == "ambiguous", F.format_string("\"%s\" is as near to several regions.", label))
        .when(reason == "below_threshold", F.format_string("No region is near enough to \"%s\".", label))
    )


def _settle(df: DataFrame, label: str) -> DataFrame:
    """Stage, match, confidence and reason from the columns exact, alias_to, alias_hit, clear, best, best_score, usable, parent_ok."""
    usable, parent = F.col("usable"), F.col("parent_ok")
    stage = (
        F.when(~usable | ~parent, 4).when(F.col("exact").isNotNull(), 1).when(F.col("alias_to").isNotNull(), F.when(F.col("alias_hit").isNotNull(), 2).otherwise(4)).when(F.col("clear") == 1, 3).otherwise(4)
    )
    reason = F.when(~usable, "no_name").when(~parent, "state_unmatched").when(F.col("exact").isNotNull(), None).when(F.col("alias_to").isNotNull(), F.when(F.col("alias_hit").isNull(), "broken_alias")).when(F.col("clear") > 1, "ambiguous").when(F.coalesce("clear", F.lit(0)) == 0, "below_threshold")
    df = df.withColumn("stage", stage).withColumn("reason", reason)
    match = F.when(F.col("stage") == 1, F.col("exact")).when(F.col("stage") == 2, F.col("alias_hit")).when(F.col("stage") == 3, F.col("best"))
    confidence = F.when(F.col("stage") <= 2, 1.0).when(F.col("stage") == 3, F.round("best_score", 3)).otherwise(0.0)
    none = F.array().cast("array<struct<name:string,score:double>>")
    candidates = F.when(usable & parent & F.col("exact").isNull() & F.col("alias_to").isNull(), F.coalesce("candidates", none)).otherwise(none)
    return df.withColumn("match", match).withColumn("confidence", confidence).withColumn("candidates", candidates).withColumn("detail", _detail(F.col(label), F.col("reason")))


OUT = ["stage", "match", "confidence", "reason", "detail", "candidates"]


def resolve_states(names: DataFrame, dim: DataFrame, aliases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct names (column ``state``) with their resolution. aliases: from_key, to, ordinal; of equal keys the last wins (without an ordinal the greatest target)."""
    states = small(dim.where("level = 'state'").select("key", "name"))
    keyed = names.select("state").distinct().withColumn("key", place_key("state")).withColumn("usable", is_place_name("state")).withColumn("parent_ok", F.lit(True))
    keyed = keyed.join(states.withColumnRenamed("name", "exact"), "key", "left")
    to = aliases.groupBy(F.col("from_key").alias("key")).agg((F.max_by("to", "ordinal") if "ordinal" in aliases.columns else F.max("to")).alias("alias_to"))
    keyed = keyed.join(small(to), "key", "left").withColumn("alias_key", place_key("alias_to"))
    keyed = keyed.join(states.select(F.col("key").alias("alias_key"), F.col("name").alias("alias_hit")), "alias_key", "left")
    left = keyed.where("usable and exact is null and alias_to is null").select("key").distinct()
    settled = keyed.join(_fuzzy(left, states, [], threshold), "key", "left")
    return _settle(settled, "state").select("state", "key", *OUT)


def resolve_districts(names: DataFrame, dim: DataFrame, aliases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (in_state, district) with their resolution; in_state is canonical or null. aliases: from_key, to, state, ordinal.

    An alias of this state goes before one of no state; one of another state is never used. The search is
    never widened beyond the state.
    """
    pool = small(dim.where("level = 'district'").select(F.col("state").alias("in_state"), "key", "name"))
    keyed = names.where("district is not null").select("in_state", "district").distinct().withColumn("key", place_key("district")).withColumn("usable", is_place_name("district")).withColumn("parent_ok", F.col("in_state").isNotNull())
    keyed = keyed.join(pool.withColumnRenamed("name", "exact"), ["in_state", "key"], "left")
    a = small(aliases.select(F.col("from_key").alias("a_key"), F.col("to").alias("alias_to"), F.col("state").alias("a_state"), F.col("ordinal").alias("a_ordinal")))
    own = W.partitionBy("in_state", "district").orderBy(F.col("a_state").isNull(), F.col("a_ordinal").asc_nulls_last())
    keyed = keyed.join(a, (F.col("key") == F.col("a_key")) & (F.col("a_state").isNull() | (F.col("a_state") == F.col("in_state"))), "left")
    keyed = keyed.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r", "a_key", "a_state", "a_ordinal").withColumn("alias_key", place_key("alias_to"))
    keyed = keyed.join(pool.select("in_state", F.col("key").alias("alias_key"), F.col("name").alias("alias_hit")), ["in_state", "alias_key"], "left")
    left = keyed.where("usable and parent_ok and exact is null and alias_to is null").select("in_state", "key").distinct()
    settled = keyed.join(_fuzzy(left, pool, ["in_state"], threshold), ["in_state", "key"], "left")
    return _settle(settled, "district").select("in_state", "district", "key", *OUT)


def _by_pair(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records joined with their (state, district) pair's row (_s, _d), nulls equal: broadcast if the pairs are few, else salted, as one pair may hold much of all records."""
    few = small(pairs)
    on = records.state.eqNullSafe(F.col("_s")) & records.district.eqNullSafe(F.col("_d"))
    if few is not pairs:
        return records.join(few, on).drop("_s", "_d")
    dealt = records.withColumn("_salt", F.pmod(F.xxhash64(*records.columns), F.lit(SALTS)))
    copies = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, on & (F.col("_salt") == F.col("_copy"))).drop("_s", "_d", "_salt", "_copy")


def resolve_records(records: DataFrame, dim: DataFrame, state_aliases: DataFrame, district_aliases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Records (state, district) with state_match, state_stage, district_match, district_stage, stage and reason. The distinct pairs are resolved once and written."""
    pairs = records.select("state", "district").distinct()
    s = resolve_states(pairs, dim, state_aliases, threshold).select("state", F.col("match").alias("state_match"), F.col("stage").alias("state_stage"), F.col("reason").alias("state_reason"))
    pairs = written(pairs.join(s, pairs.state.eqNullSafe(s.state), "left").drop(s.state), "pairs")
    d = resolve_districts(pairs.withColumnRenamed("state_match", "in_state"), dim, district_aliases, threshold)
    d = d.select(F.col("in_state").alias("_in"), F.col("district").alias("_d"), F.col("match").alias("district_match"), F.col("stage").alias("district_stage"), F.col("reason").alias("district_reason"))
    pairs = pairs.join(d, pairs.state_match.eqNullSafe(F.col("_in")) & (pairs.district == F.col("_d")), "left").drop("_in", "_d")
    no_state = F.when(F.col("state_reason") == "no_name", "no_state").when(F.col("state_reason") == "below_threshold", "state_unmatched").otherwise(F.col("state_reason"))
    no_district = F.when(F.col("district_reason").isin("ambiguous", "broken_alias"), F.col("district_reason")).otherwise("district_unmatched")
    reason = F.coalesce(F.when(F.col("state_stage") == 4, no_state), F.when(F.col("district_stage") == 4, no_district))
    pairs = pairs.withColumn("stage", F.greatest("state_stage", "district_stage")).withColumn("reason", reason).withColumnsRenamed({"state": "_s", "district": "_d"})
    return _by_pair(records, written(pairs, "resolved_pairs"))


def resolution_report(records: DataFrame, dim: DataFrame, state_aliases: DataFrame, district_aliases: DataFrame) -> DataFrame:
    """One row per distinct (level, parent state, normalised name): resolution, records, needs_review; unordered."""
    counts = records.groupBy("state", "district").agg(F.count("*").alias("records"))
    counts = written(counts, "pairs")
    s = resolve_states(counts, dim, state_aliases)
    rows = written(counts.join(s.withColumnRenamed("state", "_s"), counts.state.eqNullSafe(F.col("_s")), "left").drop("_s"), "states")
    level = lambda df, lev, parent, label: df.select(F.lit(lev).alias("level"), parent.alias("parent_state"), F.coalesce(F.nullif("key", F.lit("")), label, F.lit("")).alias("norm"), label.alias("input"), "stage", "match", "confidence", "detail", "candidates", "records")
    states = level(rows, "state", F.lit(None).cast("string"), F.col("state"))
    d = resolve_districts(rows.withColumnRenamed("match", "in_state"), dim, district_aliases).withColumnsRenamed({"in_state": "_in", "district": "_dd"})
    districts = rows.select(F.col("match").alias("in_state"), "district", "records").join(d, F.col("in_state").eqNullSafe(F.col("_in")) & (F.col("district") == F.col("_dd")))
    districts = level(districts, "district", F.col("in_state"), F.col("district"))
    both = states.unionByName(districts)
    merged = both.groupBy("level", "parent_state", "norm").agg(F.min("input").alias("input"), F.min("stage").alias("stage"), F.min("match").alias("match"), F.max("confidence").alias("confidence"), F.min("detail").alias("detail"), F.min("candidates").alias("candidates"), F.sum("records").alias("records"))
    label = F.element_at(F.array(*map(F.lit, ("exact", "alias", "fuzzy", "unresolved"))), F.col("stage"))
    return merged.withColumn("label", label).withColumn("needs_review", F.col("stage") >= 3)


def report_order(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("stage"), F.desc("records"), "input")


def resolution_summary(report: DataFrame, resolved: DataFrame) -> DataFrame:
    """Names a stage, and records resolved to a district, to a state only, or not at all."""
    names = report.agg(*(F.count_if(F.col("stage") == i).alias(f"names_stage_{i}") for i in (1, 2, 3, 4)))
    found = resolved.agg(F.count_if(F.col("district_match").isNotNull()).alias("to_district"), F.count_if(F.col("state_match").isNotNull() & F.col("district_match").isNull()).alias("to_state"), F.count_if(F.col("state_match").isNull()).alias("to_none"))
    return names.crossJoin(found)


def assert_scope(resolved: DataFrame, dim: DataFrame) -> DataFrame:
    """Records whose district isn't one of their state: none, if all is well."""
    own = dim.where("level = 'district'").select(F.col("state").alias("state_match"), F.col("name").alias("district_match"))
    return resolved.where("district_match is not null").join(own, ["state_match", "district_match"], "left_anti")


def boundary_checks(dim: DataFrame, state_aliases: DataFrame, district_aliases: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """check, problems: counts by level, unique keys, parents, alias targets."""
    states, districts = dim.where("level = 'state'"), dim.where("level = 'district'")
    doubled = dim.groupBy("level", F.when(F.col("level") == "district", F.col("state")), "key").count().where("count > 1")
    orphans = districts.join(states.select(F.col("name").alias("state")), "state", "left_anti")
    lost = state_aliases.select(place_key("to").alias("key")).join(states.select("key"), "key", "left_anti")
    d = district_aliases.select(place_key("to").alias("key"), F.col("state").alias("s"))
    own = districts.select("key", F.col("state").alias("s"))
    lost_d = d.where("s is not null").join(own, ["key", "s"], "left_anti").select("key").union(d.where("s is null").join(own, "key", "left_anti").select("key"))
    parts = {"unique_keys": doubled, "parents": orphans, "state_alias_targets": lost, "district_alias_targets": lost_d}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("problems")).select(F.lit(name).alias("check"), "problems")
        out = row if out is None else out.unionByName(row)
    for level, n in (expected or {}).items():
        out = out.unionByName(dim.where(F.col("level") == level).agg(F.abs(F.count("*") - n).alias("problems")).select(F.lit(f"count_{level}").alias("check"), "problems"))
    return out
