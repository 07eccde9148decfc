"""How far each policy is, and in what condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def condition(lag: Column, dead_letters: Column) -> Column:
    """Degraded before Working before CaughtUp."""
    return F.when(dead_letters > 0, "Degraded").when(lag > 0, "Working").otherwise("CaughtUp")


def status(log: DataFrame, cursors: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """name, position, head, lag, dead_letters, last_dead_letter and condition of every policy that has a cursor, by name."""
    head = log.agg(F.coalesce(F.max("global_position"), F.lit(0)).alias("head"))
    letters = dead_letters.groupBy("policy_name").agg(F.count("*").alias("dead_letters"), F.max("created_at").alias("last_dead_letter"))
    met = cursors.crossJoin(F.broadcast(head)).join(letters, cursors["name"] == letters["policy_name"], "left").withColumn("dead_letters", F.coalesce("dead_letters", F.lit(0)))
    lag = F.greatest(F.col("head") - F.col("position"), F.lit(0))
    return met.select("name", "position", "head", lag.alias("lag"), "dead_letters", "last_dead_letter", condition(lag, F.col("dead_letters")).alias("condition")).orderBy("name")
