"""Logs as files: a CSV source, and an append-only Parquet log whose batches are published whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.errors import conflict
from loomlog.operators.commands import conflicts, versioned
from loomlog.operators.numbering import numbered
from loomlog.operators.scan import heads
from loomlog.schema import EVENT_LOG
from loomlog.sources.publish import Folder


def payments(spark: SparkSession, path: str) -> DataFrame:
    """operation_date and amount of a CSV file with a header, read in parallel."""
    return spark.read.csv(path, header=True, schema="operation_date date, amount double", mode="FAILFAST")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log at `path`: what has been published. An absent one is empty."""
    folder = Folder(spark, path)
    folder.recover()
    if not folder.names("from-"):
        return spark.createDataFrame([], EVENT_LOG)
    return spark.read.schema(EVENT_LOG).option("recursiveFileLookup", True).parquet(path)


def placed(log: DataFrame, new: DataFrame, order: str = "n") -> DataFrame:
    """`new` events as log rows: versions go on from their streams' heads, positions from the log's highest without a gap, both in the
    order of `order` (an integer), then of stream and id."""
    top = log.agg(F.coalesce(F.max("global_position"), F.lit(0)).alias("__top"))
    rows = numbered(versioned(new, heads(log), order, ties=("id",)), [], order, "__place", 1 << 16, ("stream_id", "id")).crossJoin(F.broadcast(top))
    rows = rows.withColumns({"global_position": F.col("__top") + F.col("__place"), "aggregate_version": F.lit(None).cast("int"), "compacted_snapshot": F.lit(False)})
    return rows.select(*(x.split()[0] for x in EVENT_LOG.split(", ")))


def check_expected(log: DataFrame, new: DataFrame, expected: DataFrame) -> None:
    """Raises a conflict where a stream of `new` isn't at its expected version."""
    bad = conflicts(expected.join(new.select("stream_id").distinct(), "stream_id", "left_semi"), heads(log)).where("conflict").limit(1).collect()
    if bad:
        raise conflict(bad[0]["stream_id"], bad[0]["expected_version"], bad[0]["head"])


def append(log: DataFrame, new: DataFrame, path: str, expected: DataFrame | None = None, order: str = "n", views: Callable[[DataFrame, Folder], dict[str, str]] | None = None) -> DataFrame:
    """Appends `new` (id, data, metadata, stream_id, stream_type, type, created and an integer `order`) to the log at `path`; returns the rows.

    All or nothing: the batch is written aside, then published under the position that it follows, which one writer only can
    claim; a second one that read the same log raises a conflict. `expected` (stream_id, expected_version) is compared with the
    heads first; a mismatch raises a conflict and writes nothing. A batch of no events never conflicts and writes nothing.
    `views` may write more folders aside from the batch (projections do); they are published with it, or not at all.
    """
    if new.isEmpty():
        return placed(log, new, order)
    if expected is not None:
        check_expected(log, new, expected)
    top = log.agg(F.coalesce(F.max("global_position"), F.lit(0))).first()[0]
    folder = Folder(log.sparkSession, path)
    aside = folder.aside(placed(log, new, order))
    rows = log.sparkSession.read.schema(EVENT_LOG).parquet(f"{folder.path}/{aside}")
    moves = {aside: f"from-{top:020}"}
    try:
        moves |= views(rows, folder) if views else {}
    except Exception:
        folder.remove(aside)
        raise
    folder.publish(top, moves)
    return log.sparkSession.read.schema(EVENT_LOG).parquet(f"{folder.path}/from-{top:020}")


def observed(new: DataFrame, name: str):
    """`new` with an observation of its number of rows and its types, filled as it is written: what a sink sees."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return new.observe(seen, F.count("*").alias("events"), F.approx_count_distinct("type").alias("types")), seen
