"""Batch and stream give the same."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.schema import EVENT_LOG
from loomlog.operators import folds
from loomlog.streaming import windows


@pytest.fixture
def stored(spark, make_log, tmp_path):
    rows = [("a", "Deposited", {"amount": 5}), ("b", "Deposited", {"amount": 9}), ("a", "Withdrawn", {"amount": 7}), ("a", "Deposited", {"amount": 4}), ("a", "Withdrawn", {"amount": 7})]
    log = make_log(*rows)
    for k in (0, 3):
        log.where(f"global_position > {k} and global_position <= {k + 3}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return f"{tmp_path}/log", log


def cents():
    return F.round(F.regexp_extract("data", r'"amount":\s*([0-9.]+)', 1).cast("double") * 100).cast("bigint")


def test_guarded_balances(spark, stored, tmp_path):
    path, log = stored
    stream = spark.readStream.schema(EVENT_LOG).option("maxFilesPerTrigger", 1).parquet(path).withColumn("cents", cents())
    seen = {}
    windows.each_batch(windows.balances(stream, "Deposited", "Withdrawn"), lambda df, _: seen.update({r["stream_id"]: r["cents"] for r in df.collect()}), f"{tmp_path}/checkpoint").awaitTermination(120)
    batch = folds.guarded(log, folds.withdraw_if_covered("Deposited", "Withdrawn"), cents()).groupBy("stream_id").agg(F.max_by("state", "version").alias("s"))
    assert seen == {r["stream_id"]: r["s"] for r in batch.collect()} == {"a": 200, "b": 900}


def test_tumbling_windows(spark, stored, tmp_path):
    path, log = stored
    stream = windows.late_after(spark.readStream.schema(EVENT_LOG).parquet(path), "1 hour")
    query = windows.tumbling(stream, "10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, windows.tumbling(log, "10 minutes").collect()))


def test_late_versions_wait_for_their_turn(spark, make_log, tmp_path):
    rows = [("a", "Deposited", {"amount": 5}), ("a", "Withdrawn", {"amount": 7}), ("a", "Deposited", {"amount": 4}), ("a", "Withdrawn", {"amount": 7})]
    log = make_log(*rows)
    for k, own in enumerate(("version in (2, 4)", "version = 4", "version in (1, 3)")):
        log.where(own).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        time.sleep(1.1 if k < 2 else 0)  # files are taken in order of their times
    stream = spark.readStream.schema(EVENT_LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log").withColumn("cents", cents())
    seen = []
    windows.each_batch(windows.balances(stream, "Deposited", "Withdrawn"), lambda df, _: seen.extend((r["cents"], r["version"]) for r in df.collect()), f"{tmp_path}/checkpoint").awaitTermination(120)
    assert seen == [(0, 0), (0, 0), (200, 4)]


def test_sessions_and_sliding(make_log):
    log = make_log(*[("a", "Deposited", {"amount": 1}, None, d) for d in (1, 1, 3)])
    assert sorted(r["n"] for r in windows.sessions(log, "6 hours").collect()) == [1, 2]
    assert sum(r["n"] for r in windows.sliding(log, "2 hours", "1 hour").collect()) == 6


def test_sessions_in_cells(spark):
    """Many events of one stream, with ties, long runs over several cells and pauses of just the gap, equal Spark's session windows."""
    rng = random.Random(4)
    at, rows = 0, []
    for k in range(3000):
        at += rng.choice((0, 1, 59, 60, 61, 600))
        rows.append((rng.choice("aaab"), datetime(2025, 1, 1) + timedelta(seconds=at)))
    log = spark.createDataFrame([*rows, ("a", None), ("c", None)], "stream_id string, created timestamp")
    want = log.groupBy("stream_id", F.session_window("created", "60 seconds -1 microseconds").alias("w")).agg(F.count("*").alias("n")).select("stream_id", "w.start", "n")
    for cell in (50, 1000, 86400):
        assert sorted(map(tuple, windows.sessions(log, "60 seconds", cell).collect())) == sorted(map(tuple, want.collect()))
