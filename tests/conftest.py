from __future__ import annotations

import json
import os
import sys
import tempfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """A log from (stream, type, fields or None, ...) in order; metadata from an optional fourth, day of January 2025 from a fifth item."""
    from loomlog.schema import EVENT_LOG

    def make(*events):
        rows, versions = [], {}
        for k, (stream, kind, fields, *more) in enumerate(events, 1):
            versions[stream] = versions.get(stream, 0) + 1
            data = json.dumps(kind) if fields is None else json.dumps({kind: fields})
            created = datetime(2025, 1, 1) + timedelta(days=(more[1] - 1) if len(more) > 1 else 0, seconds=k)
            rows.append((f"e{k}", data, json.dumps(more[0]) if more else "null", stream, "BankAccount", kind, versions[stream], created, None, k, False))
        return spark.createDataFrame(rows, EVENT_LOG)

    return make
