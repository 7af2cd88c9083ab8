"""Row-local operators and dimension look-ups over a stream of records.

They hold no state, so the batch expressions are used as they are; this module only names the composition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions.text import clean_cell, place_key
from landloom.functions.values import parse_measure


def clean_and_place(records: DataFrame, dim: DataFrame) -> DataFrame:
    """A stream (record_id, state, district, amount) cleaned and joined exactly to the dimension."""
    states = F.broadcast(dim.where("level = 'state'").select(F.col("key").alias("s_key"), F.col("name").alias("state_match")))
    districts = F.broadcast(dim.where("level = 'district'").select(F.col("state").alias("state_match"), F.col("key").alias("d_key"), F.col("name").alias("district_match")))
    cleaned = records.select("record_id", place_key(clean_cell("state")).alias("s_key"), place_key(clean_cell("district")).alias("d_key"), parse_measure("amount").alias("amount"))
    return cleaned.join(states, "s_key", "left").join(districts, ["state_match", "d_key"], "left").select("record_id", "state_match", "district_match", "amount")
