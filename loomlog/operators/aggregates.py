"""Aggregates: what a stream is (state, events, commands), and how commands become events, for all streams of a batch at once.

A state is a dict, of any shape; `apply` and `handle` are small Python functions on one event or command. Spark deals whole
streams to tasks, in order, and a task streams through them with one state in memory: a long stream takes time, not memory.
Folds that have an algebra should use operators/folds.py, which stays in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.errors import LogError
from loomlog.functions.urn import kebab, new
from loomlog.operators.merged import Family, decoded
from loomlog.operators.scan import stream_at
from loomlog.sources import files

State = dict[str, Any]
Event = tuple[str, dict | None]  # variant and fields; None for one without fields
VERDICTS = "stream_id string, n bigint, accepted boolean, error_kind string, error_message string, version bigint, state string, events array<struct<type:string,data:string>>"


@dataclass(frozen=True)
class Aggregate:
    """`apply`: (state, variant, fields) -> state; `handle`: (state, variant, fields, services) -> events, or it raises a LogError.

    `events` is the family that its streams' payloads must decode as, `start` the state of a stream without events.
    """

    name: str
    events: Family
    apply: Callable[[State, str, dict], State]
    handle: Callable[[State, str, dict, Any], list[Event]]
    start: State = field(default_factory=dict, hash=False)
    namespace: str | None = None
    services: Any = field(default=None, hash=False)

    def namespace_column(self) -> Column:
        """The namespace of its URNs: as given, else its name in kebab case (acronyms are one word)."""
        return F.lit(self.namespace) if self.namespace else kebab(F.lit(self.name), True)

    def stream_id(self, id: Column, namespace: str) -> Column:
        return new(id, namespace)


def payload_of(kind: str, fields: dict | None) -> str:
    return json.dumps(kind) if fields is None else json.dumps({kind: fields})


def _read(data: str) -> tuple[str, dict]:
    said = json.loads(data)
    return (said, {}) if isinstance(said, str) else next(iter(said.items()))


def handle_and_apply(aggregate: Aggregate, state: State, command: str) -> tuple[State, list[Event]]:
    """The events of a command on a state, and the state after them; `command` is a payload. What handle() raises is raised."""
    made = aggregate.handle(state, *_read(command), aggregate.services)
    for kind, fields in made:
        state = aggregate.apply(state, kind, fields or {})
    return state, made


def _history(log: DataFrame, aggregate: Aggregate) -> DataFrame:
    """The live events of its streams; one that doesn't decode fails the query."""
    return decoded(stream_at(log), [aggregate.events], "error").select("stream_id", F.lit(0).alias("part"), F.col("version").alias("n"), "data", F.lit(None).cast("bigint").alias("expected_version"))


def _streamed(rows: DataFrame, aggregate: Aggregate, only_states: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state, version = None, dict(aggregate.start), 0

        def told(stream: str, n: int, error: LogError | None, made: list[Event]) -> tuple:
            events = [{"type": kind, "data": payload_of(kind, fields)} for kind, fields in made]
            return stream, n, error is None, error and error.kind, error and error.detail, version, json.dumps(state), events

        for batch in batches:
            out = []
            for own, part, n, data, expected in zip(batch["stream_id"], batch["part"], batch["n"], batch["data"], batch["expected_text"], strict=True):
                if own != stream:
                    if only_states and stream is not None:
                        out.append(told(stream, 0, None, []))
                    stream, state, version = own, dict(aggregate.start), 0
                if part == 0:
                    state, version = aggregate.apply(state, *_read(data)), int(n)
                    continue
                error, made = None, []
                try:
                    if expected is not None and expected == expected and int(expected) != version:
                        raise LogError("conflict", "Stream version mismatch")
                    state, made = handle_and_apply(aggregate, state, data)
                    version += len(made)
                except LogError as e:
                    error = e
                out.append(told(own, n, error, made))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in VERDICTS.split("events")[0].rstrip(", ").split(", ")] + ["events"])
        if only_states and stream is not None:
            yield pd.DataFrame([told(stream, 0, None, [])], columns=["stream_id", "n", "accepted", "error_kind", "error_message", "version", "state", "events"])

    dealt = rows.select("stream_id", "part", "n", "data", F.col("expected_version").cast("string").alias("expected_text")).repartition("stream_id").sortWithinPartitions("stream_id", "part", "n")
    return dealt.mapInPandas(run, VERDICTS)


def states(log: DataFrame, aggregate: Aggregate) -> DataFrame:
    """stream_id, version and state (JSON) of every stream of the log. A stream that isn't there is at version 0 in the `start` state: it has no row."""
    return _streamed(_history(log, aggregate), aggregate, True).select("stream_id", "version", "state")


def execute_batch(log: DataFrame, commands: DataFrame, aggregate: Aggregate) -> DataFrame:
    """Runs commands (stream_id, n, command, expected_version) in order of n per stream, each on the state that the log and the
    commands before it made.

    Returns VERDICTS: was it accepted, else the error's kind and detail; version and state after it; its events. A command whose
    expected version (null: any) is not its stream's is a conflict. A rejected command changes nothing.
    """
    asked = commands.select("stream_id", F.lit(1).alias("part"), F.col("n").cast("bigint").alias("n"), F.col("command").alias("data"), F.col("expected_version").cast("bigint").alias("expected_version"))
    met = _history(log.join(commands.select("stream_id").distinct(), "stream_id", "left_semi"), aggregate)
    return _streamed(met.unionByName(asked), aggregate, False)


def events_of(done: DataFrame, aggregate: Aggregate, metadata: Column, created: Column) -> DataFrame:
    """The events of a batch's accepted commands, ready for files.append(): ordered by command, then by event."""
    own = done.where("accepted").select("stream_id", F.col("n").alias("command_n"), F.posexplode("events").alias("k", "e"), metadata.alias("metadata"), created.alias("created"))
    order = (F.col("command_n") * (1 << 20) + F.col("k")).cast("bigint")
    return own.select(F.concat_ws("/", "stream_id", F.col("command_n").cast("string"), F.col("k").cast("string"), F.expr("uuid()")).alias("id"), F.col("e.data").alias("data"), "metadata", "stream_id", F.lit(aggregate.name).alias("stream_type"), F.col("e.type").alias("type"), "created", order.alias("n"))


def execute(log: DataFrame, path: str, aggregate: Aggregate, stream_id: str, command: str, metadata: str = "null", expected: int | None = None, views=None) -> State:
    """One command on one stream of the log at `path`: loads the state, handles the command, appends its events; returns the state after it.

    A rejection, a wrong `expected` version and a writer that was faster raise a LogError, and nothing is written. A command
    that yields no events never conflicts.
    """
    own = log.where(F.col("stream_id") == stream_id)
    asked = log.sparkSession.createDataFrame([(stream_id, 1, command, None)], "stream_id string, n bigint, command string, expected_version bigint")
    kept = own if expected is None else stream_at(own, at_version=expected)
    done = execute_batch(kept, asked, aggregate).first()
    if not done["accepted"]:
        raise LogError(done["error_kind"], done["error_message"] or "", "execute", stream_id=stream_id)
    if done["events"]:
        rows = log.sparkSession.createDataFrame([done], VERDICTS)
        wanted = None if expected is None else log.sparkSession.createDataFrame([(stream_id, expected)], "stream_id string, expected_version bigint")
        files.append(log, events_of(rows, aggregate, F.lit(metadata), F.current_timestamp()), path, wanted, views=views)
    return json.loads(done["state"])
