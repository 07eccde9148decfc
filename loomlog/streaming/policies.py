"""Policies: ordered subscribers that turn events into commands (dispatches), as Spark jobs over batches of the feed.

A policy's reaction is a function from a DataFrame of feed rows to a DataFrame of dispatches (target,
stream_id, command), so it runs on the executors. Per batch: feed, depth limit, reaction, causation stamp,
idempotence by cause, dead letters for targets that nobody executes; then the cursor moves. Delivery is
at least once: a batch that fails before the cursor is written comes again, and the cause tells.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.errors import KINDS
from loomlog.functions.json import causation_depth, causation_stamp, merge
from loomlog.operators.commands import first_per
from loomlog.stages import cut
from loomlog.streaming import feed

MAX_DEPTH = 10
BATCH = 100
TRIES, BACKOFF_MS = 3, (100, 200, 400)  # fixed values: further tries of a temporary failure, and the waits before them


@dataclass(frozen=True)
class Policy:
    """`react`: feed rows -> rows with the feed's columns plus target, to_stream, command and, if an event can ask for several
    things, `ordinal` (their order; without it equal commands of one event to one stream are one). None for the limits: see limits().
    """

    name: str
    react: Callable[[DataFrame], DataFrame]
    where: Column | None = None
    start_at: str = "now"
    max_depth: int | None = None
    batch: int | None = None
    checkpoint: int | None = None


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.strip().isdigit() else None


def limits(policy: Policy, env: Mapping[str, str] = os.environ) -> tuple[int, int, int]:
    """(depth, events of a checkpoint, events of a read): the policy's own, else the environment's, else the defaults; 1 at least, and a read is no less than a checkpoint."""
    own = [(policy.max_depth, "LOOMLOG_MAX_CAUSATION_DEPTH", MAX_DEPTH), (policy.checkpoint, "LOOMLOG_CHECKPOINT_BATCH", BATCH), (policy.batch, "LOOMLOG_READ_BATCH", BATCH)]
    found = [x if x is not None else said if (said := _whole(env.get(name))) is not None else default for x, name, default in own]
    depth, checkpoint, read = found[0], max(1, found[1]), max(1, found[2])
    if policy.checkpoint is None and policy.batch is not None:
        checkpoint = min(checkpoint, read)  # a small read asks for a small checkpoint
    return depth, checkpoint, max(read, checkpoint)


def dispatches(rows: DataFrame, policy: Policy) -> DataFrame:
    """What a policy asks for on feed rows: policy, global_position, event_id, ordinal, target, to_stream, command, metadata.

    Copies of compaction and rows at the depth limit cause nothing. The metadata is the policy's own, if it has any
    (`own_metadata`), merged with the causation block; a collision fails the query.
    """
    depth = causation_depth(F.col("metadata"))
    due = rows.withColumn("depth", depth).where(~F.col("compacted_snapshot") & (F.col("depth") < limits(policy)[0]))
    asked = policy.react(due)
    stamp = causation_stamp(F.lit(policy.name), F.col("id"), F.col("stream_id"), F.col("global_position"), F.col("depth"))
    if "own_metadata" in asked.columns:
        stamp = F.when(F.col("own_metadata").isNull(), stamp).otherwise(F.coalesce(merge(F.col("own_metadata"), stamp), F.raise_error(F.lit("metadata collides with causation")).cast("string")))
    return asked.select(F.lit(policy.name).alias("policy"), "global_position", F.col("id").alias("event_id"), (F.col("ordinal") if "ordinal" in asked.columns else F.lit(0)).cast("int").alias("ordinal"), "target", "to_stream", "command", stamp.alias("metadata"))


def broken(rows: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows that the depth limit stops."""
    return rows.withColumn("depth", causation_depth(F.col("metadata"))).where(F.col("depth") >= max_depth)


def unserved(asked: DataFrame, targets: list[str]) -> DataFrame:
    """Dead letters of dispatches whose target nobody executes, in the table's columns (id and created_at to be given)."""
    lost = asked.where(~F.coalesce(F.col("target").isin(targets), F.lit(False)))
    return lost.select(F.col("policy").alias("policy_name"), "global_position", "event_id", F.lit(KINDS["invalid_input"][0]).alias("error_kind"), F.concat(F.lit("no executor for "), F.coalesce("target", F.lit("null"))).alias("error_message"))


def served_once(asked: DataFrame, targets: list[str]) -> DataFrame:
    """The dispatches to execute, in order: every one that an event asks for, once, however often the event was delivered."""
    own = first_per(asked.where(F.col("target").isin(targets)), ["policy", "event_id", "ordinal", "target", "to_stream", "command"], [F.col("global_position")])
    return own.orderBy("global_position", "ordinal", "target", "to_stream", "command")


def drain(log: DataFrame, policy: Policy, cursor: int | None, targets: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """One batch: dispatches to execute, new dead letters, and the cursor after it.

    The cursor passes rows that the filter leaves out: up to the batch's last row, or to the mark if the batch was not full.
    """
    at = feed.start_position(log, policy.start_at) if cursor is None else cursor
    size = limits(policy)[2]
    rows = feed.batch(log, at, size, policy.where)
    n, last = rows.agg(F.count("*"), F.max("global_position")).first()
    after = last if n == size else max(at, feed.contiguous_mark(log).first()[0])
    asked = dispatches(rows, policy)
    return served_once(asked, targets), unserved(asked, targets), after


def next_step(kind: Column, tries: Column) -> Column:
    """struct<action, wait_ms> after a dispatch ended in an error of `kind` (null: none) at its `tries`-th try, from 1.

    A broken business rule is an answer: the cursor moves on. Temporary errors are tried again three times, after
    rising waits. Everything else is a dead letter.
    """
    temporary = kind.isin(*(k for k, (_, again) in KINDS.items() if again))
    wait = F.get(F.array(*map(F.lit, BACKOFF_MS)), tries - 1)
    action = F.when(kind.isNull(), "done").when(kind == "business_rule", "advance").when(temporary & (tries <= TRIES), "retry").otherwise("dead_letter")
    return F.struct(action.alias("action"), F.when(temporary & (tries <= TRIES), wait).alias("wait_ms"))


def retried(dead_letters: DataFrame, log: DataFrame, policy: Policy, targets: list[str]) -> DataFrame:
    """Reacts again to the events of dead letters: id and outcome, resolved or still_failing (a target without executor, or an event that is gone)."""
    pinned = dead_letters.select("id", F.col("event_id").alias("__event"))
    asked = dispatches(log.join(pinned.select("__event").distinct(), F.col("id") == F.col("__event"), "left_semi"), policy)
    lost = asked.where(~F.coalesce(F.col("target").isin(targets), F.lit(False))).select("event_id").distinct()
    there = log.select(F.col("id").alias("__id")).join(pinned.select("__event").distinct(), F.col("__id") == F.col("__event"), "left_semi").select("__id").distinct()
    met = pinned.join(there, F.col("__event") == F.col("__id"), "left").join(lost, F.col("__event") == F.col("event_id"), "left")
    return met.select("id", F.when(F.col("__id").isNotNull() & F.col("event_id").isNull(), "resolved").otherwise("still_failing").alias("outcome"))


def retry_order(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.orderBy("global_position", "created_at", "id")


def archive_move(dead_letters: DataFrame, done: DataFrame, reason: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left of `dead_letters` after those in `done` (id) moved, and the archive's new rows. Unknown ids move nothing."""
    left = dead_letters.join(done.select("id"), "id", "left_anti")
    moved = dead_letters.join(done.select("id"), "id", "left_semi").select(F.col("id").alias("dead_letter_id"), "policy_name", "global_position", "event_id", "error_kind", "error_message", "created_at", F.lit(reason).alias("reason"), (now if now is not None else F.current_timestamp()).alias("discarded_at"))
    return left, moved


def lineage(log: DataFrame) -> DataFrame:
    """Each event with the event at the root of its causes and the number of steps to it.

    All pointers are doubled in each round (an event's root becomes its root's root) until none moves, so a chain of
    d causes takes log2(d) joins. A cause that isn't in the log is a root.
    """
    parent = F.try_variant_get(F.try_parse_json(F.col("metadata")), "$.causation.event_id", "string")
    steps = log.select(F.col("id").alias("event_id"), parent.alias("parent"))
    out = cut(steps.select("event_id", F.coalesce("parent", "event_id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps")))
    for _ in range(63):  # 2^63 steps; a ring of causes, which has no root, ends here
        up = out.where("steps > 0").select(F.col("event_id").alias("__id"), F.col("root").alias("__root"), F.col("steps").alias("__steps"))
        met = out.join(up, F.col("root") == F.col("__id"), "left")
        moved = cut(met.select("event_id", F.coalesce("__root", "root").alias("root"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__id").isNotNull().alias("moved")))
        out = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return out
