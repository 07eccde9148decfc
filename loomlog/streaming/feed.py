"""The ordered feed of a log: how far it is contiguous, and what comes after a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def contiguous_mark(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """`mark`: the largest H with all positions 1 .. H present; 0 without position 1.

    Positions are unique (an invariant of the log). Blocks of them are counted first, with map-side sums; only the first one that isn't full is looked at row by row. So
    there is no window over all rows, and the ordered table has one row a block.
    """
    gp = F.col("global_position")
    blocks = log.where(gp >= 1).groupBy(F.floor((gp - 1) / block).alias("b")).agg(F.count("*").alias("n"))
    placed = blocks.withColumn("at", F.row_number().over(W.orderBy("b")) - 1)
    first = placed.agg(F.coalesce(F.min(F.when((F.col("b") != F.col("at")) | (F.col("n") < block), F.col("at"))), F.count("*")).cast("bigint").alias("open"))
    inside = log.crossJoin(F.broadcast(first)).where(F.floor((gp - 1) / block) == F.col("open")).select("open", gp.alias("p"))
    own = inside.withColumn("n", F.row_number().over(W.orderBy("p"))).where(F.col("p") == F.col("open") * block + F.col("n")).agg(F.max("p").alias("last"))
    return first.crossJoin(own).select(F.coalesce("last", F.col("open") * block).cast("bigint").alias("mark"))


def batch(log: DataFrame, cursor: int | None, limit: int, where: Column | None = None) -> DataFrame:
    """The next `limit` rows after `cursor`, up to the contiguous mark, by position; what `where` leaves out is passed by.

    The mark is of the whole log: a filter never makes a gap. Copies that compaction made are in the feed
    with `advance_only`, so that the cursor moves on without a reaction.
    """
    mark = contiguous_mark(log)
    rows = log.where(F.col("global_position") > (cursor or 0)).crossJoin(F.broadcast(mark)).where("global_position <= mark").drop("mark")
    if where is not None:
        rows = rows.where(where)
    return rows.withColumn("advance_only", F.col("compacted_snapshot")).orderBy("global_position").limit(limit)


def start_position(log: DataFrame, start_at: str) -> int:
    """Where a new subscriber begins: at 0, or now, at the highest position whether contiguous or not."""
    if start_at == "beginning":
        return 0
    return log.agg(F.coalesce(F.max("global_position"), F.lit(0))).first()[0]
