"""Event-time windows, and the streaming forms of folds and policies (Structured Streaming)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlog.streaming.runner import Runner


def tumbling(log: DataFrame, width: str) -> DataFrame:
    """Events per type and window of event time; the same on a batch and on a stream with a watermark."""
    return log.groupBy(F.window("created", width).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def sliding(log: DataFrame, width: str, every: str) -> DataFrame:
    return log.groupBy(F.window("created", width, every).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def sessions(log: DataFrame, gap: str, cell: int = 86400) -> DataFrame:
    """Runs of a stream's events with no pause of `gap` or more; events without a time are in none.

    On a stream these are Spark's session windows, which go on after a pause of just their gap (so it is made shorter). On a batch a stream's events are cut into cells of `cell` seconds: an event
    begins a run if the one before it, in its cell or at the end of the cell before, is too far back, and runs are numbered by
    the sums of such beginnings. So no task sorts a whole hot stream; the table of cells has one row a stream and cell.
    """
    if log.isStreaming:
        return log.groupBy("stream_id", F.session_window("created", f"{gap} -1 microseconds").alias("w")).agg(F.count("*").alias("n")).select("stream_id", F.col("w.start").alias("start"), "n")
    pause = F.expr(f"INTERVAL {gap}")
    rows = log.where(F.col("created").isNotNull()).select("stream_id", "created", F.floor(F.unix_seconds("created") / cell).alias("cell"))
    ordered, cells = W.partitionBy("stream_id", "cell").orderBy("created"), W.partitionBy("stream_id").orderBy("cell")
    since = F.lag("created").over(ordered)
    marked = rows.withColumn("opens", F.when(since.isNull(), 0).when(F.col("created") >= since + pause, 1).otherwise(0))
    ends = marked.groupBy("stream_id", "cell").agg(F.min("created").alias("first"), F.max("created").alias("last"), F.sum("opens").alias("inside"))
    parted = ends.withColumn("apart", F.when(F.col("first") < F.lag("last").over(cells) + pause, 0).otherwise(1))
    before = F.sum(F.col("apart") + F.col("inside")).over(cells) - F.col("inside")
    numbered = marked.withColumn("k", F.sum("opens").over(ordered)).join(parted.select("stream_id", "cell", before.alias("before")), ["stream_id", "cell"])
    return numbered.groupBy("stream_id", (F.col("k") + F.col("before")).alias("run")).agg(F.min("created").alias("start"), F.count("*").alias("n")).select("stream_id", "start", "n")


def late_after(stream: DataFrame, delay: str) -> DataFrame:
    """Rows more than `delay` behind the newest are dropped by the aggregations that follow."""
    return stream.withWatermark("created", delay)


def balances(stream: DataFrame, plus: str, minus: str) -> DataFrame:
    """Guarded balances as they change: a stream's events are applied in order of version; state is (cents, version, early).

    All of a stream's events must come. One whose version was applied before is a second delivery and changes nothing; one that
    comes before its turn waits in the state (as JSON) for those before it. Needs columns stream_id, version, type, cents.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cents, seen, early = state.get if state.exists else (0, 0, "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for rows in batches:
            for version, kind, amount in zip(rows["version"], rows["type"], rows["cents"], strict=True):
                if version > seen:
                    waiting[int(version)] = [kind, None if amount != amount else int(amount)]
        while seen + 1 in waiting:
            kind, amount = waiting.pop(seen + 1)
            seen += 1
            if kind == plus:
                cents += amount
            elif kind == minus and cents >= amount:
                cents -= amount
        state.update((int(cents), int(seen), json.dumps(waiting)))
        yield pd.DataFrame({"stream_id": [key[0]], "cents": [cents], "version": [seen]})

    own = stream.select("stream_id", "version", "type", "cents")
    return own.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, cents bigint, version bigint", "cents bigint, version bigint, early string", "update", GroupStateTimeout.NoTimeout)


def policy_stream(stream: DataFrame, runner: Runner, checkpoint: str):
    """Policies on a log that grows: the stream of its files only says that something came. What is delivered is the log's feed,
    in order of position, from each policy's saved cursor up to the contiguous mark, so late files make no difference.

    Delivery is at least once: a batch that fails before a cursor is saved comes again, and dispatches name their cause.
    """
    return each_batch(stream, lambda rows, number: runner.catch_up(), checkpoint)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `apply` on every micro-batch until the available data is used up."""
    return stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
