"""Reading a log through a lens and a filter, up to a version or a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators import filters

#: raw: every row; live: rows of no archive; true_log: what really happened, archived or not, without compaction's copies.
LENSES = {
    "raw": lambda: F.lit(True),
    "live": lambda: F.col("aggregate_version").isNull(),
    "true_log": lambda: ~F.col("compacted_snapshot"),
}
#: The order of reads across streams: (created, version) as events of one append tie, and the position as the last word.
ORDER = ("created", "version", "global_position")


def scan(log: DataFrame, where: Column | None = None, lens: str = "raw", ordered: bool = False) -> DataFrame:
    """The rows of `log` under a lens that meet a filter; in ORDER, if that is asked for."""
    own = log.where(LENSES[lens]()).where(where if where is not None else filters.everything())
    return own.orderBy(*ORDER) if ordered else own


def stream_at(log: DataFrame, aggregate_version: int | None = None, at_version: int | None = None, at_time: datetime | None = None) -> DataFrame:
    """Time travel for all streams at once: live rows (or those of an archive) up to a version and a time, both inclusive."""
    return log.where(filters.with_aggregate_version(aggregate_version) & filters.up_to_version(at_version) & filters.created_before(at_time))


def heads(log: DataFrame) -> DataFrame:
    """id, type and version of every stream, from its live rows; an archived stream without live rows is at 0."""
    live = F.when(F.col("aggregate_version").isNull(), F.col("version"))
    return log.groupBy(F.col("stream_id").alias("id")).agg(F.max("stream_type").alias("type"), F.coalesce(F.max(live), F.lit(0)).cast("bigint").alias("version"))


def event_by_id(log: DataFrame, event_id: str) -> DataFrame:
    return log.where(F.col("id") == event_id)
