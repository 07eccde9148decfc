"""Folds of a log's events into states, each as the Spark operation that its algebra allows.

Additive, counting, last-write-wins and set folds are aggregates with map-side combining, so a stream that
holds a third of all events costs one partial row per task. A checkpoint fold needs the last checkpoint
first: two aggregates and a join. Prefix states are running sums over cells (numbering). Only a guarded
fold, whose next step depends on the state, is sequential in a stream; it runs over sorted rows with one
state in memory. Streams of few events may be folded as arrays instead.

Amounts are summed as DECIMAL(18,2), so the order of rows never shows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators.numbering import running_sum

MONEY = "decimal(18,2)"
#: Events of a stream that are gathered into one array at most.
ARRAY_ROWS = 1 << 14


def money(x: Column) -> Column:
    return x.cast(MONEY)


def signed(amount: Column, plus: str, minus: str) -> Column:
    """Amount of a `plus` event, minus that of a `minus` event, null otherwise."""
    return F.when(F.col("type") == plus, money(amount)).when(F.col("type") == minus, -money(amount))


def additive(log: DataFrame, key: list[str], amount: Column, name: str) -> DataFrame:
    """The sum of `amount` (null: nothing) per key."""
    return log.groupBy(*key).agg(F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias(name))


def last_write(log: DataFrame, key: list[str], value: Column, order: list[str], name: str) -> DataFrame:
    """The value of the last row by `order` per key."""
    return log.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(name))


def checkpointed(log: DataFrame, checkpoint: Column, base: Column, change: Column, name: str) -> DataFrame:
    """Per stream the `base` of its last checkpoint plus the changes after it (all changes, if there is none).

    Streams with no rows of either kind have 0.
    """
    rows = log.select("stream_id", "version", checkpoint.alias("__is"), base.alias("__base"), change.alias("__change"))
    last = rows.groupBy("stream_id").agg(F.max(F.when(F.col("__is"), F.col("version"))).alias("__at"))
    met = rows.join(last, "stream_id")
    total = F.coalesce(F.max(F.when(F.col("version") == F.col("__at"), F.col("__base"))), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("version") > F.coalesce("__at", F.lit(0)), F.col("__change"))), F.lit(0))
    return met.groupBy("stream_id").agg(total.cast("double").alias(name), F.coalesce(F.max("__at"), F.lit(0)).alias("checkpoint_version"))


def set_of(log: DataFrame, key: list[str], value: Column, name: str) -> DataFrame:
    """How many distinct values each key has seen: distinct first, so no set is held in memory."""
    return log.select(*key, value.alias("__value")).where("__value is not null").distinct().groupBy(*key).agg(F.count("*").alias(name))


def history(log: DataFrame, key: list[str], value: Column, order: list[str], name: str) -> DataFrame:
    """All values per key in order; the list is the state, so it is as long as the key has events."""
    item = F.struct(*order, value.alias("__value"))
    return log.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["__value"]).alias(name))


def running(log: DataFrame, amount: Column, name: str, span: int) -> DataFrame:
    """The additive state of a stream after each of its events."""
    return running_sum(log, ["stream_id"], "version", F.coalesce(amount, F.lit(0).cast(MONEY)), name, span)


Step = Callable[[int, str, int], tuple[int, bool]]


def withdraw_if_covered(plus: str, minus: str) -> Step:
    """State in cents: `plus` adds; `minus` subtracts if the state covers it and is rejected otherwise."""

    def step(state: int, kind: str, cents: int) -> tuple[int, bool]:
        if kind == plus:
            return state + cents, True
        if kind == minus and state >= cents:
            return state - cents, True
        return state, kind != minus

    return step


def reject_at_first(minus: str, step: Step) -> Step:
    """`step` for a stream's first row, where `minus` is rejected whatever its amount: nothing came before it."""
    return lambda state, kind, cents: (state, False) if kind == minus else step(state, kind, cents)


def guarded(log: DataFrame, step: Step, cents: Column, opening: Step | None = None) -> DataFrame:
    """The log's rows (stream_id, version, type, cents) with the state after each and whether it was accepted.

    Streams are dealt to tasks whole and sorted by version; a task streams through its rows with one state,
    so a long stream takes time, not memory. `opening` (None: `step`) is the step of a stream's first row.
    """
    rows = log.select("stream_id", "version", "type", cents.cast("bigint").alias("cents")).repartition("stream_id").sortWithinPartitions("stream_id", "version")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, 0
        for batch in batches:
            states, accepted = [], []
            for own, kind, amount in zip(batch["stream_id"], batch["type"], batch["cents"], strict=True):
                now = step
                if own != stream:
                    stream, state, now = own, 0, opening or step
                state, good = now(state, kind, amount)
                states.append(state)
                accepted.append(good)
            yield batch.assign(state=states, accepted=accepted)

    return rows.mapInPandas(run, "stream_id string, version bigint, type string, cents bigint, state bigint, accepted boolean")


def guarded_by_array(log: DataFrame, amount: Column, plus: str, minus: str, most: int = ARRAY_ROWS, reject_first: bool = False) -> DataFrame:
    """The same end states, for streams of at most `most` such events inside the JVM: a sorted array, folded by a
    higher-order function. Longer streams (counted first) go through guarded(), so no row grows with a stream.
    With `reject_first`, a stream's first such event is rejected if it is a `minus`, whatever its amount."""
    kept = log.where(F.col("type").isin(plus, minus)).select("stream_id", "version", "type", money(amount).alias("a"))
    void = F.min(F.when((F.col("type") == plus) & F.col("a").isNull(), F.col("version")))  # from here on the balance is null
    long = kept.groupBy("stream_id").agg(F.count("*").alias("__n"), void.alias("__void"), F.min("version").alias("__first")).where(F.col("__n") > most).select(F.col("stream_id").alias("__long"), "__void", "__first")
    met = kept.join(long, F.col("stream_id") == F.col("__long"), "left")
    own = met.where("__long is null").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("version", F.col("type").alias("t"), "a"))).alias("rows"))
    start = F.struct(F.lit(0).cast(MONEY).alias("balance"), F.lit(0).cast("bigint").alias("rejected"), F.lit(reject_first).alias("first"))

    def merge(acc: Column, x: Column) -> Column:
        covered = ~acc["first"] & (acc["balance"] >= x["a"])
        balance = F.when(x["t"] == plus, acc["balance"] + x["a"]).when(covered, acc["balance"] - x["a"]).otherwise(acc["balance"]).cast(MONEY)
        return F.struct(balance.alias("balance"), (acc["rejected"] + F.when((x["t"] == minus) & ~covered, 1).otherwise(0)).cast("bigint").alias("rejected"), F.lit(False).alias("first"))

    short = own.select("stream_id", F.aggregate("rows", start, merge).alias("s")).select("stream_id", F.col("s.balance").cast("double").alias("balance"), F.col("s.rejected").alias("rejected"))
    step = withdraw_if_covered(plus, minus)
    told = F.col("a").isNotNull() | (F.lit(reject_first) & (F.col("version") == F.col("__first")))  # a first `minus` is rejected without an amount too
    steps = guarded(met.where(told & F.expr("__long is not null and (__void is null or version < __void)")), step, F.coalesce("a", F.lit(0).cast(MONEY)) * 100, reject_at_first(minus, step) if reject_first else None)
    ends = steps.groupBy("stream_id").agg((F.max_by("state", "version").cast("double") / 100).alias("balance"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).cast("bigint").alias("rejected"))
    all_ = long.join(ends, F.col("__long") == F.col("stream_id"), "left")
    return short.unionByName(all_.select(F.col("__long").alias("stream_id"), F.when(F.col("__void").isNull(), F.coalesce("balance", F.lit(0.0))).alias("balance"), F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected")))
