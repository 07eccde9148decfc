"""The write side in bulk: versions for new events, expected versions, idempotent reactions, and guarded commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.operators.numbering import numbered


def conflicts(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """Requests (stream_id, expected_version) with the stream's head and whether they conflict. No expectation never does; an unknown stream is at 0."""
    met = requests.join(heads.select(F.col("id").alias("__id"), F.col("version").alias("head")), F.col("stream_id") == F.col("__id"), "left").drop("__id")
    return met.withColumn("head", F.coalesce("head", F.lit(0))).withColumn("conflict", F.coalesce(F.col("expected_version") != F.col("head"), F.lit(False)))


def versioned(new: DataFrame, heads: DataFrame, order: str, span: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """`new` events with versions that go on from their streams' heads, in the order of the integer column `order`, then of `ties`."""
    own = numbered(new, ["stream_id"], order, "__n", span, ties)
    met = own.join(heads.select(F.col("id").alias("__id"), F.col("version").alias("__head")), F.col("stream_id") == F.col("__id"), "left")
    return met.withColumn("version", F.col("__n") + F.coalesce("__head", F.lit(0))).drop("__n", "__id", "__head")


def first_of_cause(reactions: DataFrame, cause: str, order: str) -> DataFrame:
    """The first reaction to each cause; later ones are deliveries of the same event again."""
    first = reactions.groupBy(cause).agg(F.min(order).alias("__first"))
    return reactions.join(first.withColumnRenamed(cause, "__cause"), (F.col(cause) == F.col("__cause")) & (F.col(order) == F.col("__first")), "left_semi")


def first_per(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; a partial limit runs before the shuffle, so hot keys stay small."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
