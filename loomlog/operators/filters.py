"""The filter algebra over a log: every filter is a Column, combined with &, | and ~.

~ is two-valued: the one column of a log that may be null is aggregate_version, whose leaf is null-safe (a live row
is not in archive 2, and `~with_aggregate_version(2)` keeps it). All others are plain comparisons, which reach the
Parquet scan as pushed filters, negated or not.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.json import contains, equals


def everything() -> Column:
    return F.lit(True)


def with_stream_id(stream_id: str) -> Column:
    return F.col("stream_id") == stream_id


def for_stream_types(types: Iterable[str]) -> Column:
    """False for no types at all."""
    own = list(types)
    return F.col("stream_type").isin(own) if own else F.lit(False)


def of_stream_types(log: DataFrame, streams: DataFrame, types: Iterable[str]) -> DataFrame:
    """The same for a log without stream_type: a semi join with the heads."""
    return log.join(streams.where(F.col("type").isin(list(types))).select(F.col("id").alias("__stream")), F.col("stream_id") == F.col("__stream"), "left_semi")


def with_metadata(pattern: object) -> Column:
    """Metadata holds `pattern`, deeply, anchored at the root."""
    return contains(F.col("metadata"), pattern)


def with_metadata_equal(value: object) -> Column:
    return equals(F.col("metadata"), value)


def after_version(n: int) -> Column:
    return F.col("version") > n


def up_to_version(n: int | None) -> Column:
    """None: no limit."""
    return everything() if n is None else F.col("version") <= n


def created_after(t: datetime) -> Column:
    """Exclusive."""
    return F.col("created") > F.lit(t)


def created_before(t: datetime | None) -> Column:
    """Inclusive. None: no limit."""
    return everything() if t is None else F.col("created") <= F.lit(t)


def with_aggregate_version(n: int | None) -> Column:
    """None: live rows; a number: that archive."""
    return F.col("aggregate_version").isNull() if n is None else F.col("aggregate_version").eqNullSafe(n)


def after_position(cursor: int) -> Column:
    return F.col("global_position") > cursor
