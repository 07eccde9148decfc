"""Policies run on a stored log: cursors, feedback, dead letters, and a stream as the clock."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomlog.errors import LogError
from loomlog.functions.json import causation_depth
from loomlog.operators import compaction
from loomlog.schema import EVENT_LOG
from loomlog.sources import files
from loomlog.stages import cut
from loomlog.streaming import policies, windows
from loomlog.streaming.runner import Runner


def events(spark, *kinds, stream="a", meta="null"):
    rows = [(f"{stream}{k}{kind}{datetime.now().timestamp()}", json.dumps({kind: {"amount": 100.0}}), meta, stream, "BankAccount", kind, datetime(2025, 1, 1), k) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "id string, data string, metadata string, stream_id string, stream_type string, type string, created timestamp, n bigint")


def react(target="Fee", kind="Deposited"):
    return lambda rows: rows.where(F.col("type") == kind).select("*", F.lit(target).alias("target"), F.col("stream_id").alias("to_stream"), F.lit('{"FeeCharged":{"amount":5.0}}').alias("command"))


def charging(kind="FeeCharged", verdict=None, once=True):
    """Appends an event of `kind` for each dispatch, unless its cause was charged before; `verdict` (event_id, tries) may name an error."""
    tried = {}

    def execute(asked, log):
        said = []
        for r in asked.collect():
            tried[r["event_id"]] = tried.get(r["event_id"], 0) + 1
            error = verdict(r["event_id"], tried[r["event_id"]]) if verdict else None
            said.append((r["n"], error, error and "no luck"))
        verdicts = asked.sparkSession.createDataFrame(said, "n int, error_kind string, error_message string")
        good = asked.join(verdicts.where("error_kind is null").select("n"), "n", "left_semi")
        if once:
            cause = F.get_json_object("metadata", "$.causation.event_id")
            before = log.where(F.col("type") == kind).select(cause.alias("cause")).distinct()
            good = good.join(before, F.col("event_id") == F.col("cause"), "left_anti")
        new = good.select(F.concat("event_id", F.lit(f"-{kind}-"), F.col("n").cast("string")).alias("id"), F.lit(json.dumps({kind: {"amount": 5.0}})).alias("data"), "metadata", F.col("to_stream").alias("stream_id"), F.lit("BankAccount").alias("stream_type"), F.lit(kind).alias("type"), F.current_timestamp().alias("created"), F.col("n").cast("bigint").alias("n"))
        return verdicts, new

    return execute


@pytest.fixture
def store(spark, tmp_path):
    path = f"{tmp_path}/store"

    def append(*kinds, **of):
        files.append(files.read_log(spark, f"{path}/log"), events(spark, *kinds, **of), f"{path}/log")

    return path, append


def count(runner, kind):
    return runner.log().where(F.col("type") == kind).count()


def test_fee_once_and_the_cursor_passes_what_it_made(spark, store):
    path, append = store
    append("Deposited")
    runner = Runner(spark, path, [policies.Policy("fee", react(), start_at="beginning")], {"Fee": charging()})
    assert (runner.drain(), runner.cursor("fee"), count(runner, "FeeCharged")) == (1, 1, 1)
    assert (runner.drain(), runner.cursor("fee")) == (0, 2)
    runner.save_cursor("fee", 0)  # the cursor was lost: the event comes again, and is charged once
    assert (runner.drain(), runner.cursor("fee"), count(runner, "FeeCharged")) == (1, 2, 1)
    assert [tuple(r) for r in runner.status().select("name", "lag", "condition").collect()] == [("fee", 0, "CaughtUp")]


def test_start_now_or_at_the_beginning(spark, store):
    path, append = store
    append("Deposited", "Deposited")
    runner = Runner(spark, path, [policies.Policy("now", react()), policies.Policy("old", react("Other"), start_at="beginning")], {"Fee": charging(), "Other": charging("Noted")})
    assert runner.drain() == 2 and runner.cursor("now") == 2
    append("Deposited", stream="b")
    assert runner.drain_policy(runner.policies["now"]) == 1 and runner.catch_up() == 1


def test_reads_in_batches(spark, store):
    path, append = store
    append(*["Deposited"] * 5)
    runner, seen = Runner(spark, path, [policies.Policy("fee", react(kind="None"), start_at="beginning", batch=2)], {}), []
    for _ in range(3):
        runner.drain()
        seen.append(runner.cursor("fee"))
    assert seen == [2, 4, 5]


def test_feedback_stops_at_the_depth_limit(spark, store):
    path, append = store
    append("Deposited")
    runner = Runner(spark, path, [policies.Policy("loop", react("Loop"), start_at="beginning", max_depth=3)], {"Loop": charging("Deposited", once=False)})
    assert [runner.drain() for _ in range(4)] == [1, 1, 1, 0]
    last = runner.log().orderBy(F.desc("global_position")).select("type", causation_depth(F.col("metadata")).alias("depth")).collect()
    assert [tuple(r) for r in last] == [("Deposited", k) for k in (3, 2, 1, 0)] and runner.cursor("loop") == 4


def test_drain_over_a_compacted_log(spark, store):
    """Deposited, closed, compacted to the closing's copy, deposited again: two dispatches, cursor 4."""
    path, append = store
    append("Deposited", "MonthlyClosed")
    log = files.read_log(spark, f"{path}/log")
    after = cut(compaction.compact(log, compaction.tail_after_checkpoint(log, F.col("type") == "MonthlyClosed")))
    spark.createDataFrame(after.collect(), EVENT_LOG).write.parquet(f"{path}2/log/from-0")
    files.append(files.read_log(spark, f"{path}2/log"), events(spark, "Deposited"), f"{path}2/log")
    runner = Runner(spark, f"{path}2", [policies.Policy("fee", react(), start_at="beginning")], {"Fee": charging()})
    assert (runner.drain(), runner.cursor("fee")) == (2, 4)


def test_a_declined_dispatch_is_an_answer(spark, store):
    path, append = store
    append("Deposited")
    runner = Runner(spark, path, [policies.Policy("fee", react(), start_at="beginning")], {"Fee": charging(verdict=lambda *_: "business_rule")})
    assert (runner.drain(), runner.letters.read().count(), runner.cursor("fee")) == (0, 0, 1)


def test_temporary_errors_are_tried_again(spark, store):
    path, append = store
    append("Deposited", "Deposited")
    first, waits = f"{path}", []
    ids = [r["id"] for r in files.read_log(spark, f"{path}/log").orderBy("global_position").collect()]
    hopeless = charging(verdict=lambda event, tries: "unavailable" if event == ids[1] or tries < 3 else None)
    runner = Runner(spark, first, [policies.Policy("fee", react(), start_at="beginning")], {"Fee": hopeless}, waits.append)
    assert runner.drain() == 1 and waits == [0.1, 0.2, 0.4] and runner.cursor("fee") == 2
    assert [tuple(r) for r in runner.letters.read().select("id", "event_id", "error_kind").collect()] == [(1, ids[1], "Unavailable")]
    assert runner.status().first()["condition"] == "Degraded"


def test_dead_letters_retry_discard_and_bulk(spark, store):
    path, append = store
    append("Deposited", "Deposited", "Deposited")
    policy = policies.Policy("fee", react(), start_at="beginning")
    runner = Runner(spark, path, [policy, policies.Policy("other", react("Other"), start_at="beginning")], {"Other": charging("Noted")})
    assert runner.drain() == 3 and runner.cursor("fee") == 3  # nobody serves Fee; the other policy goes on
    letters = runner.letters.read().orderBy("id").collect()
    assert [(r["id"], r["global_position"], r["error_kind"]) for r in letters] == [(k, k, "Invalid Input") for k in (1, 2, 3)]
    with pytest.raises(LogError, match="no executor for Fee"):
        runner.retry_dead_letter(1)
    with pytest.raises(LogError, match="no such policy"):
        Runner(spark, path, [], {}).retry_dead_letter(1)
    failing = Runner(spark, path, [policy], {"Fee": charging(verdict=lambda event, _: "internal" if event == letters[1]["event_id"] else None)})
    assert failing.retry_dead_letter(99) == failing.discard_dead_letter(99) == "not_found"
    assert failing.retry_policy_dead_letters("nobody") == {"resolved": 0, "still_failing": 0, "not_found": 0}
    assert failing.retry_policy_dead_letters("fee") == {"resolved": 2, "still_failing": 1, "not_found": 0}
    assert [(r["id"], r["error_kind"], r["error_message"]) for r in failing.letters.read().collect()] == [(2, "Internal server error", "Internal server error")]
    assert count(failing, "FeeCharged") == 2 and failing.discard_dead_letter(2) == "discarded" and failing.letters.read().count() == 0
    assert sorted((r["dead_letter_id"], r["reason"]) for r in failing.archive.read().collect()) == [(1, "retried"), (2, "discarded"), (3, "retried")]
    assert failing.archive.read().select("id").distinct().count() == 3


def test_a_stream_of_files_drives_the_feed_in_order(spark, store, tmp_path):
    path, append = store
    for _ in range(3):
        append("Deposited", "Withdrawn")
    runner = Runner(spark, path, [policies.Policy("fee", react(), start_at="beginning", batch=1)], {"Fee": charging()})
    stream = spark.readStream.schema(EVENT_LOG).option("recursiveFileLookup", True).parquet(f"{path}/log")
    windows.policy_stream(stream, runner, f"{tmp_path}/checkpoint").awaitTermination(300)
    assert runner.cursor("fee") == 6 and count(runner, "FeeCharged") == 3
    causes = [json.loads(r["metadata"])["causation"]["global_position"] for r in runner.log().where("type = 'FeeCharged'").orderBy("global_position").collect()]
    assert causes == [1, 3, 5]
