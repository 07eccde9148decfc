"""Running policies on a stored log: cursors, dispatches, retries, dead letters; every state is a table beside the log.

A drain takes one batch of the feed per policy, a bounded number of events, so the loop is on the driver while the
reaction, the executors and the append are Spark jobs on the batch. What a reaction appends is seen by the next drain.
Delivery is at least once: events are appended before the cursor is saved, and executors know dispatches by their cause.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.errors import KINDS, LogError
from loomlog.schema import DEAD_LETTERS, DISCARDED_DEAD_LETTERS, POLICY_CURSORS
from loomlog.sources import files
from loomlog.sources.tables import Table
from loomlog.streaming import feed, policies, status

#: Executes numbered dispatches (n, to_stream, command, metadata, event_id) on the log: verdicts (n, error_kind: null if it was
#: done, error_message) and the events to append, with an integer `n` as their order.
Executor = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
LETTER = "policy_name string, global_position bigint, event_id string, error_kind string, error_message string"
RESULTS = "n int, error_kind string, error_message string"


class Runner:
    def __init__(self, spark: SparkSession, path: str, own: Sequence[policies.Policy], executors: dict[str, Executor], wait: Callable[[float], None] = time.sleep) -> None:
        self.spark, self.path, self.executors, self.wait = spark, path.rstrip("/"), executors, wait
        self.policies = {p.name: p for p in own}
        if len(self.policies) < len(own):
            raise LogError("invalid_input", "two policies have one name", "register")
        self.cursors = Table(spark, f"{self.path}/cursors", POLICY_CURSORS)
        self.letters = Table(spark, f"{self.path}/dead_letters", DEAD_LETTERS)
        self.archive = Table(spark, f"{self.path}/discarded", DISCARDED_DEAD_LETTERS)

    def log(self) -> DataFrame:
        return files.read_log(self.spark, f"{self.path}/log")

    def cursor(self, name: str) -> int | None:
        found = self.cursors.read().where(F.col("name") == name).first()
        return found["position"] if found else None

    def save_cursor(self, name: str, position: int) -> None:
        now = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(position).cast("bigint").alias("position"), F.current_timestamp().alias("updated_at"))
        self.cursors.replace(self.cursors.read().where(F.col("name") != name).union(now))

    def drain(self) -> int:
        """One batch for each policy; how many dispatches were executed (a declined one is not counted)."""
        return sum(self.drain_policy(p) for p in self.policies.values())

    def catch_up(self) -> int:
        """Drains each policy up to the mark as it is now; what reactions append is left for the next time."""
        mark, done = feed.contiguous_mark(self.log()).first()[0], 0
        for p in self.policies.values():
            while (before := self.cursor(p.name)) is None or before < mark:
                done += self.drain_policy(p)
                if self.cursor(p.name) == before:
                    break
        return done

    def drain_policy(self, policy: policies.Policy) -> int:
        log, at = self.log(), self.cursor(policy.name)
        if at is None:
            at = feed.start_position(log, policy.start_at)
            self.save_cursor(policy.name, at)
        depth, checkpoint, size = policies.limits(policy)
        rows = feed.batch(log, at, size, policy.where).toPandas()  # `size` rows at most
        mark = feed.contiguous_mark(log).first()[0]
        done, positions = 0, rows["global_position"].tolist()
        for lo in range(0, len(positions), checkpoint):
            part = positions[lo : lo + checkpoint]
            own = log.where(F.col("global_position").isin(part))
            asked = policies.dispatches(own, policy)
            done += self._execute(policy, policies.served_once(asked, list(self.executors)))
            self._park(policies.unserved(asked, list(self.executors)))
            self.save_cursor(policy.name, part[-1])
        if len(positions) < size and mark > max([at, *positions[-1:]]):  # what the filter left out is passed
            self.save_cursor(policy.name, mark)
        return done

    def _run(self, asked: DataFrame) -> list[tuple[int, str | None, str | None]]:
        """(n, error_kind, error_message) of numbered dispatches; their events are appended, all or none. A target that raises fails for all of its own."""
        log, said, new = self.log(), [], None
        for (target,) in asked.select("target").distinct().collect():
            own = asked.where(F.col("target") == target)
            try:
                verdicts, events = self.executors[target](own, log)
                found = [tuple(r) for r in verdicts.select("n", "error_kind", "error_message").collect()]
            except LogError as e:
                said += [(r["n"], e.kind, e.detail) for r in own.select("n").collect()]
                continue
            said += found
            new = events if new is None else new.unionByName(events)
        if new is not None:
            try:
                files.append(log, new, f"{self.path}/log")
            except LogError as e:  # another writer was first
                said = [(n, kind or e.kind, message or e.detail) for n, kind, message in said]
        return said

    def _execute(self, policy: policies.Policy, served: DataFrame) -> int:
        order = W.orderBy("global_position", "ordinal", "target", "to_stream", "command")  # a batch's dispatches
        numbered = served.withColumn("n", F.row_number().over(order)).toPandas()
        if not len(numbered):
            return 0
        asked = self.spark.createDataFrame(numbered, "policy string, global_position bigint, event_id string, ordinal int, target string, to_stream string, command string, metadata string, n int")
        left, done, dead = asked, 0, []
        for tries in range(1, policies.TRIES + 2):
            said = self.spark.createDataFrame(self._run(left), RESULTS)
            steps = said.select("*", policies.next_step(F.col("error_kind"), F.lit(tries)).alias("step")).collect()
            done += sum(r["step"]["action"] == "done" for r in steps)
            dead += [r for r in steps if r["step"]["action"] == "dead_letter"]
            again = [r["n"] for r in steps if r["step"]["action"] == "retry"]
            if not again:
                break
            self.wait(max(r["step"]["wait_ms"] or 0 for r in steps) / 1000)
            left = asked.where(F.col("n").isin(again))
        if dead:
            kinds = self.spark.createDataFrame([(r["n"], *_shown(r["error_kind"], r["error_message"])) for r in dead], RESULTS)
            self._park(asked.join(kinds, "n").select(F.lit(policy.name).alias("policy_name"), "global_position", "event_id", "error_kind", "error_message"))
        return done

    def _park(self, lost: DataFrame) -> None:
        """Adds dead letters, numbered on from the highest id ever given."""
        new = self.spark.createDataFrame(lost.orderBy("global_position", "error_message").toPandas(), LETTER)  # a batch's
        if new.isEmpty():
            return
        letters, archive = self.letters.read(), self.archive.read()
        top = max(letters.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], archive.agg(F.coalesce(F.max("dead_letter_id"), F.lit(0))).first()[0])
        ids = (F.row_number().over(W.orderBy("global_position", "error_message")) + top).cast("bigint")
        self.letters.replace(letters.union(new.select(ids.alias("id"), "policy_name", "global_position", "event_id", "error_kind", "error_message", F.current_timestamp().alias("created_at"))))

    def retry_dead_letter(self, id: int) -> str:
        """Reacts again to the letter's event: resolved (moved to the archive), still_failing (the letter tells the new error), or not_found.

        A policy or executor that isn't registered, or an event that is gone, is the caller's error; a declined dispatch is a resolution.
        """
        letter = self.letters.read().where(F.col("id") == id).first()
        if letter is None:
            return "not_found"
        policy = self.policies.get(letter["policy_name"])
        if policy is None:
            raise LogError("invalid_input", "no such policy", "retry_dead_letter", policy=letter["policy_name"])
        event = self.log().where(F.col("id") == letter["event_id"])
        if event.isEmpty():
            raise LogError("not_found", "the event is gone", "retry_dead_letter", event_id=letter["event_id"])
        asked = policies.dispatches(event, policy).orderBy("ordinal", "target").toPandas()
        missing = set(asked["target"]) - set(self.executors)
        if missing:
            raise LogError("invalid_input", f"no executor for {min(missing)}", "retry_dead_letter", policy=policy.name)
        failed = None
        if len(asked):
            rows = self.spark.createDataFrame(asked.assign(n=range(1, len(asked) + 1)), "policy string, global_position bigint, event_id string, ordinal int, target string, to_stream string, command string, metadata string, n int")
            failed = next(((kind, message) for _, kind, message in sorted(self._run(rows)) if kind and kind != "business_rule"), None)
        if failed is None:
            return "resolved" if self._move(id, "retried") else "not_found"
        shown, message = _shown(*failed)
        own = F.col("id") == id
        self.letters.replace(self.letters.read().withColumns({"error_kind": F.when(own, shown).otherwise(F.col("error_kind")), "error_message": F.when(own, message).otherwise(F.col("error_message"))}))
        return "still_failing"

    def discard_dead_letter(self, id: int) -> str:
        """discarded or not_found."""
        return "discarded" if self._move(id, "discarded") else "not_found"

    def retry_policy_dead_letters(self, name: str) -> dict[str, int]:
        """Retries all letters of a policy, oldest first; how many had each outcome."""
        out = {"resolved": 0, "still_failing": 0, "not_found": 0}
        for r in policies.retry_order(self.letters.read().where(F.col("policy_name") == name)).select("id").toLocalIterator():
            out[self.retry_dead_letter(r["id"])] += 1
        return out

    def _move(self, id: int, reason: str) -> bool:
        letters, archive = self.letters.read(), self.archive.read()
        left, moved = policies.archive_move(letters, letters.where(F.col("id") == id), reason)
        if moved.isEmpty():
            return False
        top = archive.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # the archive first: a letter that is in both was moved
        self.archive.replace(archive.unionByName(moved.withColumn("id", F.lit(top + 1).cast("bigint"))))
        self.letters.replace(left)
        return True

    def status(self) -> DataFrame:
        return status.status(self.log(), self.cursors.read(), self.letters.read())


def _shown(kind: str, message: str | None) -> tuple[str, str]:
    """What a dead letter says of an error: its kind's text, and the error's own (an internal error keeps its message to itself)."""
    return KINDS[kind][0], str(LogError(kind, message or ""))
