"""Guarded folds against GUARDED on streams whose first movement is a withdrawal that nothing has to cover."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from loomlog.operators import folds
from loomlog.plans import catalog
from tests.test_oracle import plain

#: (user, event type, value) in order; the second half begins at 6.
MOVEMENTS = [
    (1, "purchase", 0.0), (2, "purchase", 5.0), (2, "purchase", 0.0), (3, "click", 0.0), (3, "purchase", 0.0), (4, "purchase", 5.0), (5, "view", 9.0), (1, "click", 7.5),
    (1, "purchase", 7.5), (4, "purchase", 0.0), (5, "purchase", 0.0), (5, "purchase", 0.0), (6, "purchase", 0.0), (6, "click", 2.0), (1, "purchase", 0.0), (3, "purchase", 0.01),
]


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("opened"))
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=k), *x, None) for k, x in enumerate(MOVEMENTS)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["execute_batch", "guarded_withdrawals", "guarded_withdrawals_by_array"])
def test_opening_withdrawals_as_in_sql(spark, opened, name):
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{opened}/events.parquet/*.parquet')")
        wanted = duck.execute(f"SELECT stream_id, balance, rejected FROM ({catalog.ORACLES[name]})").fetchall()
    assert plain(wanted)[0] == ("urn:user:1", "0.000000", "1.000000")
    assert plain(catalog.QUERIES[name](spark, opened).select("stream_id", "balance", "rejected").collect()) == plain(wanted)


def test_opening_withdrawals_of_long_streams(make_log):
    log = make_log(*((f"s{user}", kind, {"amount": x}) for user, kind, x in [*MOVEMENTS, (7, "purchase", None), (7, "click", 3.0), (7, "purchase", None), (7, "purchase", 1.0)]))
    value = F.coalesce(*(F.get_json_object("data", f"$.{kind}.amount") for kind in ("click", "purchase"))).cast("double")
    arrays, steps = (folds.guarded_by_array(log.withColumn("x", value), F.col("x"), "click", "purchase", most, True).select("stream_id", "balance", "rejected").collect() for most in (100, 1))
    assert plain(arrays) == plain(steps)
    assert plain(arrays)[-1] == ("s7", "2.000000", "1.000000")
