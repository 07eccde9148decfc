"""The scenarios of the log's behaviour with their expected numbers."""

from __future__ import annotations

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomlog import schema
from loomlog.errors import LogError
from loomlog.functions import json, urn
from loomlog.operators import aggregates, commands, compaction, filters, folds, merged
from loomlog.operators.aggregates import payload_of
from loomlog.operators.numbering import numbered, running_sum
from loomlog.operators.query import Query
from loomlog.operators.scan import heads, scan, stream_at
from loomlog.plans import projections
from loomlog.schema import STREAMS
from loomlog.sources import files
from loomlog.sources.publish import Folder
from loomlog.stages import cut
from loomlog.streaming import feed, policies, status

def moved():
    return F.coalesce(merged.payload(F.col("data"), "Deposited", "amount", "double"), merged.payload(F.col("data"), "Withdrawn", "amount", "double"))


def closed():
    return merged.payload(F.col("data"), "MonthlyClosed", "closing_balance", "double")


def amount(x):
    return {"amount": x}


def values(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def one(df):
    return df.first()[0]


def test_balance_and_rejected_command(make_log):
    log = make_log(("a", "Deposited", amount(100), None, 1), ("a", "Withdrawn", amount(40), None, 2), ("a", "Withdrawn", amount(100), None, 3), ("a", "Deposited", amount(20), None, 5), ("a", "Withdrawn", amount(40), None, 6))
    out = folds.guarded(log, folds.withdraw_if_covered("Deposited", "Withdrawn"), F.round(moved() * 100))
    assert values(out, "version", "state", "accepted") == [(1, 10000, True), (2, 6000, True), (3, 6000, False), (4, 8000, True), (5, 4000, True)]
    by_array = folds.guarded_by_array(log.withColumn("x", moved()), F.col("x"), "Deposited", "Withdrawn").first()
    assert (by_array["balance"], by_array["rejected"]) == (40.0, 1)


def test_long_streams_are_no_arrays(make_log):
    events = [(f"s{k % 3 if k % 4 else 0}", "Withdrawn" if k % 5 in (1, 3) else "Deposited", amount(k * 7 % 50)) for k in range(90)]
    events += [("void", kind, amount(x)) for kind, x in (("Deposited", 9), ("Withdrawn", None), ("Withdrawn", 20), ("Deposited", None), ("Withdrawn", 1))] + [("none", "Withdrawn", amount(None))] * 2
    log = make_log(*events, ("short", "Deposited", amount(5)), ("short", "Withdrawn", amount(7))).withColumn("x", moved())
    out = [folds.guarded_by_array(log, F.col("x"), "Deposited", "Withdrawn", *most) for most in ((), (1,), (20,))]
    first, *rest = (values(x.na.fill(-1.0), "stream_id", "balance", "rejected") for x in out)
    assert rest == [first, first]
    spread = folds.guarded_by_array(log, F.col("x"), "Deposited", "Withdrawn", 20)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in spread and "LeftOuter" in spread


def test_statement_is_inclusive(make_log):
    log = make_log(("a", "Deposited", amount(100), None, 1), ("a", "Deposited", amount(20), None, 5), ("a", "Withdrawn", amount(40), None, 6))
    own = log.where(F.dayofmonth("created").between(5, 6))
    assert own.agg(F.count("*"), F.sum(folds.signed(moved(), "Deposited", "Withdrawn")).cast("double")).first() == (2, -20.0)


def test_expected_versions(make_log, spark):
    log = make_log(("a", "Deposited", amount(1)), ("a", "Deposited", amount(1)))
    asked = spark.createDataFrame([("a", 2), ("a", 0), ("b", 0), ("a", None)], "stream_id string, expected_version bigint")
    assert values(commands.conflicts(asked, heads(log)).na.fill(-1), "stream_id", "expected_version", "conflict") == [("a", -1, False), ("a", 0, True), ("a", 2, False), ("b", 0, False)]


def test_append_is_whole_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    new = spark.range(1, 4).select(F.col("id").alias("n"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"), F.lit('{"Deposited":{"amount":1.0}}').alias("data"), F.lit("null").alias("metadata"), F.lit("a").alias("stream_id"), F.lit("A").alias("stream_type"), F.lit("Deposited").alias("type"), F.lit(datetime(2025, 1, 1)).cast("timestamp").alias("created"))
    expected = spark.createDataFrame([("a", 0)], "stream_id string, expected_version bigint")
    files.append(files.read_log(spark, path), new, path, expected)
    log = files.read_log(spark, path)
    assert values(log, "version", "global_position") == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(LogError, match="Stream version mismatch"):
        files.append(log, new, path, expected)
    assert files.read_log(spark, path).count() == 3
    files.append(log, new.limit(0), path, expected)  # no events: no conflict
    broken = new.withColumn("metadata", F.raise_error(F.lit("producer")).cast("string"))
    with pytest.raises(Exception, match="producer"):
        files.append(log, broken, path)
    assert files.read_log(spark, path).count() == 3
    files.append(files.read_log(spark, path), new, path)
    assert values(files.read_log(spark, path), "version", "global_position")[-1] == (6, 6)
    with pytest.raises(LogError, match="another writer was first"):
        files.append(log, new, path)  # read before the last append
    assert files.read_log(spark, path).count() == 6


def new_events(spark, *rows):
    """Events for append() from (n, stream, type, payload or None, metadata)."""
    out = [(f"{s}-{n}-{k}-{uuid.uuid4().hex}", payload_of(kind, fields), meta, s, "BankAccount", kind, datetime(2025, 1, 1), n) for k, (n, s, kind, fields, meta) in enumerate(rows)]
    return spark.createDataFrame(out, "id string, data string, metadata string, stream_id string, stream_type string, type string, created timestamp, n bigint")


def test_append_is_dense_whatever_the_order(spark, tmp_path):
    path = f"{tmp_path}/log"
    files.append(files.read_log(spark, path), new_events(spark, *((n, s, "Deposited", amount(1), "null") for n in (1, 3, 70_000, 200_000) for s in ("a", "b"))), path)
    log = files.read_log(spark, path)
    assert [r[0] for r in values(log, "global_position")] == list(range(1, 9)) and one(feed.contiguous_mark(log)) == 8
    assert values(log, "stream_id", "version") == [(s, v) for s in "ab" for v in range(1, 5)]


def test_a_claim_is_finished_by_the_next_reader(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/log")
    rows = files.placed(files.read_log(spark, folder.path), new_events(spark, (1, "a", "Deposited", amount(1), "null")))
    aside = folder.aside(rows)
    folder._finish = lambda moves: None  # the writer is lost after its claim
    folder.publish(0, {aside: "from-0"})
    assert files.read_log(spark, folder.path).count() == 1


def test_csv_payments(spark, tmp_path):
    (tmp_path / "p.csv").write_text("operation_date,amount\n" + "".join(f"2025-01-0{k},{x}\n" for k, x in enumerate((100.5, 200.25, 300, 400, 500, 437.25), 1)))
    assert files.payments(spark, str(tmp_path / "p.csv")).agg(F.count("*"), F.sum("amount")).first() == (6, 1938.0)


@pytest.fixture(scope="module")
def months(make_log):
    return make_log(
        ("a", "Deposited", amount(1000)), ("a", "Withdrawn", amount(200)), ("a", "Deposited", amount(500)), ("a", "MonthlyClosed", {"month": "2025-01-31", "closing_balance": 1300}), ("a", "Deposited", amount(400)), ("a", "Withdrawn", amount(100))
    )


def balance(log):
    return folds.checkpointed(log, F.col("type") == "MonthlyClosed", folds.money(closed()), folds.signed(moved(), "Deposited", "Withdrawn"), "balance").first()["balance"]


def test_compaction_keeps_the_state(months):
    kept = compaction.tail_after_checkpoint(compaction.live(months), F.col("type") == "MonthlyClosed")
    after = cut(compaction.compact(months, kept, metadata='{"by":"compact"}'))
    assert values(compaction.live(after), "global_position", "metadata") == [(k, '{"by":"compact"}') for k in (7, 8, 9)]
    assert balance(months) == balance(compaction.live(after)) == 1600.0
    assert values(compaction.live(after), "version", "type") == [(1, "MonthlyClosed"), (2, "Deposited"), (3, "Withdrawn")]
    assert stream_at(after, aggregate_version=1).count() == 6
    assert [scan(after, lens=x).count() for x in ("raw", "live", "true_log")] == [9, 3, 6]
    assert values(heads(after), "id", "version") == [("a", 3)]
    assert after.select("global_position").distinct().count() == 9
    again = compaction.tail_after_checkpoint(compaction.live(after), F.col("type") == "MonthlyClosed")
    assert values(compaction.outcomes(after, again, compaction.unchanged(after, again)), "outcome", "watermark") == [("skipped", 3)]
    assert compaction.compact(after, again, minimal=compaction.unchanged(after, again)).exceptAll(after).count() == 0
    twice = cut(compaction.compact(after, again))  # a compactor that doesn't say so is obeyed
    assert twice.count() == 12 and one(feed.contiguous_mark(twice)) == 12 and values(compaction.outcomes(after, again), "outcome", "archive") == [("compacted", 2)]
    assert one(compaction.next_archive(after).select("archive")) == 2


def test_archive_all_is_not_skipped(months):
    none = months.limit(0)
    assert values(compaction.outcomes(months, none), "outcome", "archive", "watermark") == [("compacted", 1, 0)]
    after = compaction.compact(months, none)
    assert compaction.live(after).count() == 0 and after.count() == 6


def test_needs_compaction(spark):
    streams = spark.createDataFrame([("new", "A", 4, None), ("done", "A", 3, 3), ("more", "A", 4, 1), ("empty", "A", 0, None)], "id string, type string, version bigint, last_compacted_version bigint")
    assert values(compaction.needs_compaction(streams), "id", "needs_compaction") == [("done", False), ("empty", False), ("more", True), ("new", True)]


def streams_of(log, marks=None):
    none = log.sparkSession.createDataFrame([], STREAMS) if marks is None else marks
    return compaction.current(none, heads(log))


def snapshots(log):
    total = F.coalesce(merged.payload(F.col("data"), "Bumped", "by", "bigint"), merged.payload(F.col("data"), "Snapshot", "total", "bigint"))
    kept, lone = compaction.to_snapshot(log, F.sum(total), "Snapshot")
    done = compaction.outcomes(log, kept, lone)
    return cut(compaction.compact(log, kept, minimal=lone)), cut(done)


def test_watermarks_over_compactions(make_log, spark):
    """Fresh, compacted, appended to, and compacted again; unknown streams have no row."""
    log = make_log(*[("a", "Bumped", {"by": k}) for k in (1, 2, 3, 4)], ("minimal", "Snapshot", {"total": 7}))
    marks = streams_of(log)
    assert values(compaction.needs_compaction(marks), "id", "needs_compaction") == [("a", True), ("minimal", True)]
    after, done = snapshots(log)
    assert values(done, "stream_id", "outcome", "watermark") == [("a", "compacted", 1), ("minimal", "skipped", 1)]
    marks = compaction.settled(marks, done)
    assert values(marks, "id", "version", "last_compacted_version") == [("a", 1, 1), ("minimal", 1, 1)]
    assert values(compaction.live(after), "stream_id", "version", "data") == [("a", 1, '{"Snapshot":{"total":10}}'), ("minimal", 1, '{"Snapshot": {"total": 7}}')]
    assert after.where("stream_id = 'minimal'").exceptAll(log.where("stream_id = 'minimal'")).count() == 0
    more = cut(after.unionByName(files.placed(after, new_events(spark, *((n, "a", "Bumped", {"by": n}, "null") for n in (1, 2, 3))))))
    marks = compaction.current(marks, heads(more))
    assert values(marks, "id", "version", "last_compacted_version") == [("a", 4, 1), ("minimal", 1, 1)]
    assert values(compaction.needs_compaction(marks), "id", "needs_compaction") == [("a", True), ("minimal", False)]
    again, done = snapshots(more)
    assert values(done, "stream_id", "archive") [0] == ("a", 2) and one(compaction.live(again).where("stream_id = 'a'").select("data")) == '{"Snapshot":{"total":16}}'
    assert schema.assert_log_invariants(again).count() == 0 and one(feed.contiguous_mark(again)) == again.count()


def test_a_single_event_can_be_rewritten(make_log):
    after, done = snapshots(make_log(("a", "Bumped", {"by": 5})))
    assert values(done, "outcome", "archive", "watermark") == [("compacted", 1, 1)] and after.count() == 2


def test_not_is_two_valued(months):
    after = compaction.compact(months, months.limit(1))
    assert after.where(~filters.with_aggregate_version(2)).count() == after.count()


def test_stream_types(months):
    assert months.where(filters.for_stream_types([])).count() == 0
    assert months.where(filters.for_stream_types(["BankAccount", "Other"])).count() == 6


def test_filters_reach_the_scan(spark, months, tmp_path):
    months.write.parquet(f"{tmp_path}/log")
    log = spark.read.schema(schema.EVENT_LOG).parquet(f"{tmp_path}/log")
    day = datetime(2025, 1, 15)
    pushed = {
        "EqualTo(stream_id,a)": filters.with_stream_id("a"), "In(stream_type, [A,B])": filters.for_stream_types(["A", "B"]), "GreaterThan(version,3)": filters.after_version(3), "LessThanOrEqual(version,3)": filters.up_to_version(3),
        "GreaterThan(created,2025-01-15": filters.created_after(day), "LessThanOrEqual(created,2025-01-15": filters.created_before(day), "IsNull(aggregate_version)": filters.with_aggregate_version(None), "EqualNullSafe(aggregate_version,1)": filters.with_aggregate_version(1),
        "GreaterThan(global_position,9)": filters.after_position(9), "LessThanOrEqual(version,7)": ~filters.after_version(7), "GreaterThan(created,2025-01-15 00": ~filters.created_before(day), "Or(GreaterThan(version,20),EqualTo(stream_id,b))": filters.after_version(20) | filters.with_stream_id("b"),
    }
    for want, own in pushed.items():
        plan = scan(log, own).select("id")._jdf.queryExecution().executedPlan().toString()
        assert want in plan.split("PushedFilters: ")[1].split("]\n")[0], (want, plan)
    read = scan(log, filters.after_version(1), ordered=True).select("version").collect()
    assert [r[0] for r in read] == [2, 3, 4, 5, 6]


def test_containment(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":[1,2,{"d":"x"}]},"n":null}',), ('{"x":{"a":1}}',), ("null",), ("[1]",), (None,), ("broken",)], "m string")
    has = lambda p: [r[0] for r in df.select(json.contains(F.col("m"), p)).collect()]
    assert has({"a": 1}) == [True, False, False, False, False, False]
    assert has({"b": {"c": [{"d": "x"}, 2]}}) == [True, False, False, False, False, False]
    assert has({"a": "1"}) == [False] * 6
    big = spark.createDataFrame([('{"n":9007199254740993}',), ('{"n":9007199254740992}',), ('{"n":1.5}',), ('{"n":2.0}',), ('{"n":18446744073709551615}',)], "m string")
    held = lambda n: [r[0] for r in big.select(json.contains(F.col("m"), {"n": n})).collect()]
    assert [held(n) for n in (9007199254740993, 2, 1.5, 18446744073709551615)] == [[k == at for k in range(5)] for at in (0, 3, 2, 4)]
    assert has({"n": None}) == [True, False, False, False, False, False]
    assert has({}) == [True, True, False, False, False, False]
    assert has(None) == [False, False, True, False, False, False]
    assert [r[0] for r in df.select(json.matches(F.col("m"), {"a": 1})).collect()][:2] == [True, False]
    assert [r[0] for r in df.select(json.equals(F.col("m"), {"x": {"a": 1}})).collect()][:2] == [False, True]


def test_decoding(spark):
    family = merged.Family("f", {"Reset": {}, "Deposited": {"amount": "double", "note": "string?"}, "Bumped": {"by": "bigint"}, "Closed": {"on": "date"}})
    good = ['"Reset"', '{"Deposited":{"amount":1}}', '{"Deposited":{"amount":1.5,"more":[1],"note":null}}', '{"Bumped":{"by":3}}', '{"Closed":{"on":"2025-01-31"}}']
    bad = ['"Other"', '{"Reset":{}}', '{"Deposited":{"amount":"1"}}', '{"Deposited":{}}', '{"Deposited":{"amount":1},"x":1}', '{"Bumped":{"by":1.5}}', '{"Closed":{"on":"soon"}}', "broken", None, "null"]
    df = spark.createDataFrame([(x,) for x in good + bad], "data string")
    assert [r[0] for r in df.select(merged.valid(F.col("data"), family)).collect()] == [True] * len(good) + [False] * len(bad)


def test_decode_orders_and_modes(make_log):
    log = make_log(("a", "Deposited", amount(1)), ("a", "Notified", {"message": "x"}), ("a", "Deposited", amount("bad")), ("a", "Deposited", amount(2)))
    deposits, notes = merged.Family("deposits", {"Deposited": {"amount": "double"}}), merged.Family("notes", {"Notified": {"message": "string"}})
    assert values(merged.decoded(log, [deposits, notes]), "version", "event_family") == [(1, "deposits"), (2, "notes"), (4, "deposits")]
    assert merged.decoded(log, [deposits, notes], "truncate").count() == 2
    assert merged.decoded(log, [deposits, notes])._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") + merged.decoded(log, [deposits, notes])._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 1
    with pytest.raises(Exception, match="undecodable event e3"):
        merged.decoded(log, [deposits, notes], "error").collect()


def test_contiguous_mark(spark):
    log = lambda *p: spark.createDataFrame([(x,) for x in p], "global_position bigint")
    for positions, mark in (((), 0), ((1, 2, 3), 3), ((1, 3), 1), ((2, 3), 0), (range(1, 9), 8), ((*range(1, 9), 10), 8), (range(5, 20), 0), ((*range(1, 5), *range(9, 12)), 4)):
        assert one(feed.contiguous_mark(log(*positions), 4)) == mark, positions


def test_filter_makes_no_gap(make_log):
    log = make_log(*[("a", "Deposited" if k % 2 else "Withdrawn", amount(1)) for k in range(1, 6)])
    assert values(feed.batch(log, 0, 2, F.col("type") == "Withdrawn"), "global_position") == [(2,), (4,)]


def fee(rows):
    return rows.where(F.col("type") == "Deposited").select("*", F.lit("Fee").alias("target"), F.col("stream_id").alias("to_stream"), F.lit("{}").alias("command"))


def test_policy_batches_and_cursor(make_log):
    log = make_log(*[("a", "Deposited", amount(1)) for _ in range(5)])
    cursor, seen = 0, []
    for _ in range(3):
        asked, lost, cursor = policies.drain(log, policies.Policy("p", fee, batch=2), cursor, ["Fee"])
        seen.append((asked.count(), lost.count(), cursor))
    assert seen == [(2, 0, 2), (2, 0, 4), (1, 0, 5)]


def test_start_now_or_at_the_beginning(make_log):
    log = make_log(("a", "Deposited", amount(1)), ("a", "Deposited", amount(1)))
    drained = lambda at: policies.drain(log, policies.Policy("p", fee, start_at=at), None, ["Fee"])[0].count()
    assert (drained("now"), drained("beginning")) == (0, 2)


def test_unserved_targets_become_dead_letters(make_log):
    asked, lost, cursor = policies.drain(make_log(("a", "Deposited", amount(1)), ("a", "Deposited", amount(1))), policies.Policy("p", fee), 0, [])
    assert (asked.count(), lost.count(), cursor) == (0, 2, 2)


def test_copies_cause_nothing(months):
    kept = compaction.tail_after_checkpoint(compaction.live(months), F.col("type") == "MonthlyClosed")
    after = compaction.compact(months, kept)
    asked = policies.dispatches(after.orderBy("global_position"), policies.Policy("p", fee))
    assert asked.count() == 3  # the three deposits, once


def test_depth_limit_and_stamp(make_log, spark):
    block = lambda d: {"causation": {"policy": "p", "event_id": "x", "stream_id": "a", "global_position": 1, "depth": d}}
    log = make_log(("a", "Deposited", amount(1), None), ("a", "Deposited", amount(1), block(1)), ("a", "Deposited", amount(1), block(3)), ("a", "Deposited", amount(1), {"causation": {"depth": 9}}))
    policy = policies.Policy("p", fee, max_depth=3)
    asked = policies.dispatches(log, policy).withColumn("d", json.causation_depth(F.col("metadata")))
    assert values(asked, "global_position", "d") == [(1, 1), (2, 2), (4, 1)]
    assert values(policies.broken(log, 3), "global_position") == [(3,)]


def test_metadata_merge(spark):
    df = spark.createDataFrame([('{"a":1}', '{"b":{"c":2}}'), ('{"a":1}', '{"a":2}'), ("{}", '{"b":1}'), ("[1]", '{"b":1}')], "l string, r string")
    assert [r[0] for r in df.select(json.merge(F.col("l"), F.col("r"))).collect()] == ['{"a":1,"b":{"c":2}}', None, '{"b":1}', None]


def test_duplicate_delivery_is_dispatched_once(make_log):
    log = make_log(("a", "Deposited", amount(1)))
    asked = policies.dispatches(log.union(log), policies.Policy("p", fee))
    assert (asked.count(), policies.served_once(asked, ["Fee"]).count()) == (2, 1)


def test_every_command_of_an_event_is_served_in_order(make_log):
    log = make_log(("a", "Deposited", amount(1)), ("b", "Deposited", amount(1)))
    charges = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("command")) for k, c in enumerate(["one", "two", "two"])))
    policy = policies.Policy("p", lambda rows: rows.select("*", F.lit("Fee").alias("target"), F.lit("x").alias("to_stream"), F.inline(charges)))
    asked = policies.dispatches(log.union(log), policy)
    served = [(r["global_position"], r["ordinal"], r["command"]) for r in policies.served_once(asked, ["Fee"]).collect()]
    assert served == [(p, k, c) for p in (1, 2) for k, c in enumerate(["one", "two", "two"])]
    assert {r["error_kind"] for r in policies.unserved(asked, []).collect()} == {"Invalid Input"}


def test_lineage_of_a_long_chain(make_log):
    block = lambda k: {"causation": {"policy": "p", "event_id": f"e{k}", "stream_id": "a", "global_position": k, "depth": k}}
    log = make_log(("a", "Deposited", amount(1)), *(("a", "Deposited", amount(1), block(k)) for k in range(1, 40)), ("b", "Deposited", amount(1), block(900)))
    found = {r["event_id"]: (r["root"], r["steps"]) for r in policies.lineage(log).collect()}
    assert found == {**{f"e{k}": ("e1", k - 1) for k in range(1, 41)}, "e41": ("e900", 1)}


def test_limits():
    own = lambda env=(), **of: policies.limits(policies.Policy("p", fee, **of), dict(env))
    assert own() == (10, 100, 100) and own({"LOOMLOG_MAX_CAUSATION_DEPTH": "4", "LOOMLOG_READ_BATCH": "x"}) == (4, 100, 100)
    assert own({"LOOMLOG_MAX_CAUSATION_DEPTH": "4", "LOOMLOG_CHECKPOINT_BATCH": "300"}, max_depth=2) == (2, 300, 300)
    assert own(batch=2) == (10, 2, 2) and own(batch=0, checkpoint=0) == (10, 1, 1) and own(batch=2, checkpoint=5) == (10, 5, 5)


def test_dead_letters_move(spark):
    letters = spark.createDataFrame([(k, "p", 10 - k, f"e{k}", "Invalid Input", "m", datetime(2025, 1, 1)) for k in range(3)], "id bigint, policy_name string, global_position bigint, event_id string, error_kind string, error_message string, created_at timestamp")
    assert [r["id"] for r in policies.retry_order(letters).collect()] == [2, 1, 0]
    left, moved = policies.archive_move(letters, letters.where("id = 1 or id = 99"), "discarded")
    assert values(left, "id") == [(0,), (2,)] and values(moved, "dead_letter_id", "reason") == [(1, "discarded")]


@pytest.mark.parametrize(("lag", "letters", "said"), [(0, 0, "CaughtUp"), (5, 0, "Working"), (0, 3, "Degraded"), (10, 2, "Degraded")])
def test_conditions(spark, lag, letters, said):
    assert one(spark.range(1).select(status.condition(F.lit(lag), F.lit(letters)))) == said


def test_projection_versions(spark):
    stored = spark.createDataFrame([("same", 2), ("old", 1), ("newer", 3)], "name string, version int")
    planned = projections.plan(stored, spark.createDataFrame([(x, 2) for x in ("first", "same", "old", "newer")], "name string, version int"))
    assert values(planned, "name", "action") == [("first", "init"), ("newer", "invalid"), ("old", "rebuild"), ("same", "keep")]
    with pytest.raises(LogError, match="newer"):
        projections.check(planned)


def test_rebuild_equals_incremental(months):
    view = projections.balances("Deposited", "Withdrawn", moved())
    grown = view.rebuild(months.limit(0))
    for k in range(1, 7):
        grown = view.apply(grown, months.where(F.col("version") == k))
    assert values(grown, "stream_id", "balance") == values(view.rebuild(months), "stream_id", "balance")


def test_owner_totals_ignore_what_came_before(make_log, spark):
    log = make_log(("x", "Deposited", amount(7)), ("x", "Deposited", amount(5)), ("y", "Deposited", amount(9)))
    opened = spark.createDataFrame([("x", "alice", 1)], "stream_id string, owner string, opened_at bigint")
    assert values(projections.owner_totals(log, opened, moved()).withColumn("total", F.col("total").cast("double")), "owner", "total", "movements") == [("alice", 5.0, 1)]


def test_urns(spark):
    say = lambda c: one(spark.range(1).select(c))
    lit = F.lit
    assert say(urn.at(lit("urn:bank-account:acct-1"), lit("urn:branch:london"))) == "urn:bank-account:acct-1@branch:london"
    assert say(urn.scope_of(lit("urn:bank-account:acct-1@branch:london"))) == "urn:branch:london"
    assert say(urn.at(lit("urn:a:b@c:d"), lit("urn:e:f"))) is None
    assert say(urn.new(lit("urn:customer:urn:customer:urn:customer:peter@example.com"), "customer")) == "urn:customer:peter@example.com"
    assert say(urn.new(lit("urn:other:x"), "customer")) is None
    assert say(urn.parse(lit("urn:customer:urn:customer:x"), "customer")) == "urn:customer:urn:customer:x"
    assert [say(urn.scope_of(lit(x))) for x in ("urn:a:b", "urn:a:b@c", "urn:a:b@c:", "urn:a:b@:d", "urn:a:@c:d", "urn:a:b@c:d@e:f")] == [None] * 6
    assert [say(urn.kebab(lit("HTTPServerLog"), x)) for x in (True, False)] == ["http-server-log", "h-t-t-p-server-log"]
    with pytest.raises(Exception, match="not a URN of customer"):
        say(urn.parse_strict(lit("x"), "customer"))


def test_numbering_of_a_hot_key(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    own = numbered(df, ["k"], "n", "v", 64)
    plain = df.selectExpr("n", "k", "row_number() over (partition by k order by n) v")
    assert own.select("n", "k", F.col("v").cast("int")).exceptAll(plain).count() == 0
    sums = running_sum(df, ["k"], "n", F.col("n"), "s", 100)
    assert sums.select("n", "s").exceptAll(df.selectExpr("n", "sum(n) over (partition by k order by n) s")).count() == 0


def test_errors():
    e = LogError("internal", "secret", "append")
    assert str(e) == "Internal server error" and e.detail == "secret" and not e.temporary
    assert LogError("conflict", "x").temporary and e.within("outer", k=1).context == {"k": 1}


def bank_apply(state, kind, fields):
    own = {**state, "log": [*state["log"], kind]}
    return {**own, "balance": state["balance"] + (fields["amount"] if kind == "Deposited" else -fields["amount"] if kind == "Withdrawn" else 0)}


def bank_handle(state, kind, fields, services):
    if kind == "Import":
        return [("Deposited", {"amount": 1.0})] * fields["rows"]
    if kind == "Break":
        raise LogError("internal", "producer")
    if kind == "Withdraw" and state["balance"] < fields["amount"] + (services or {}).get("fee", 0):
        raise LogError("business_rule", "not covered")
    return [] if kind == "Nothing" else [({"Deposit": "Deposited", "Withdraw": "Withdrawn"}[kind], fields)]


def account(**of):
    family = merged.Family("bank", {"Deposited": {"amount": "double"}, "Withdrawn": {"amount": "double"}, "Reset": {}})
    return aggregates.Aggregate("BankAccount", family, bank_apply, bank_handle, {"balance": 0, "log": []}, **of)


def test_commands_in_bulk(spark, make_log):
    log = make_log(("a", "Deposited", amount(10.0)), ("z", "Deposited", amount(5.0)), ("a", "Reset", None))
    rows = [("a", 1, "Withdraw", 7.0, None), ("a", 2, "Withdraw", 7.0, None), ("a", 3, "Deposit", 5.0, 3), ("a", 4, "Withdraw", 7.0, 3), ("b", 1, "Withdraw", 1.0, None), ("b", 2, "Deposit", 1.0, 0)]
    asked = spark.createDataFrame([(s, n, payload_of(kind, amount(x)), e) for s, n, kind, x, e in rows], "stream_id string, n bigint, command string, expected_version bigint")
    done = aggregates.execute_batch(log, asked, account())
    assert [tuple(r) for r in done.na.fill("").select("stream_id", "n", "accepted", "error_kind", "version").orderBy("stream_id", "n").collect()] == [
        ("a", 1, True, "", 3), ("a", 2, False, "business_rule", 3), ("a", 3, True, "", 4), ("a", 4, False, "conflict", 4), ("b", 1, False, "business_rule", 0), ("b", 2, True, "", 1),
    ]
    events = aggregates.events_of(done, account(), F.lit("null"), F.current_timestamp())
    assert values(files.placed(log, events), "stream_id", "version", "type", "global_position") == [("a", 3, "Withdrawn", 4), ("a", 4, "Deposited", 6), ("b", 1, "Deposited", 5)]
    assert values(aggregates.states(log, account()), "stream_id", "version") == [("a", 2), ("z", 1)]
    assert one(spark.range(1).select(account().namespace_column())) == "bank-account"
    with pytest.raises(Exception, match="undecodable"):
        aggregates.states(make_log(("a", "Other", {})), account()).collect()


def test_one_command(spark, tmp_path):
    path = f"{tmp_path}/log"
    run = lambda kind, fields, **of: aggregates.execute(files.read_log(spark, path), path, account(services={"fee": 1}), "a", payload_of(kind, fields), **of)
    assert run("Deposit", amount(100.0), expected=0)["balance"] == 100
    assert run("Withdraw", amount(40.0), expected=1) == {"balance": 60, "log": ["Deposited", "Withdrawn"]}
    for kind, fields, of, said in (("Withdraw", amount(60.0), {}, "not covered"), ("Deposit", amount(1.0), {"expected": 1}, "Stream version mismatch"), ("Break", {}, {}, "Internal")):
        with pytest.raises(LogError, match=said):
            run(kind, fields, **of)
    assert run("Nothing", {}, expected=1)["balance"] == 100  # no events, no conflict; the state is as of that version
    assert files.read_log(spark, path).count() == 2
    assert len(run("Import", {"rows": 1000})["log"]) == 1002
    log = files.read_log(spark, path)
    assert [r[0] for r in values(log, "version")] == list(range(1, 1003)) and one(feed.contiguous_mark(log)) == 1002


def test_handle_and_apply():
    state, made = aggregates.handle_and_apply(account(), {"balance": 3, "log": []}, payload_of("Withdraw", amount(2)))
    assert made == [("Withdrawn", amount(2))] and state == {"balance": 1, "log": ["Withdrawn"]}


def deposits_view(version, calls=None, broken=False):
    def partial(rows):
        if calls is not None:
            calls.append(sorted(r["amount"] for r in rows.select(moved().alias("amount")).collect()))
        if broken:
            raise LogError("internal", "projection")
        return rows.select("stream_id", folds.money(moved()).alias("balance"))

    return projections.Projection("deposits", version, F.col("type") == "Deposited", partial, lambda rows: rows.groupBy("stream_id").agg(F.sum("balance").alias("balance")))


def test_stored_views(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = lambda: files.read_log(spark, path)
    batch = lambda *of: new_events(spark, *((n, "a", kind, amount(x), "null") for n, (kind, x) in enumerate(of)))
    files.append(log(), batch(("Deposited", 100.0), ("Withdrawn", 40.0)), path)
    balance, calls = lambda views: float(views.read("deposits").first()["balance"]), []
    views = projections.Views(spark, path, [deposits_view(1, calls)])
    assert views.build(log()) == {"deposits": "init"} and balance(views) == 100 and values(views.registry.read(), "name", "version") == [("deposits", 1)]
    files.append(log(), batch(("Deposited", 7.0), ("Withdrawn", 4.0), ("Deposited", 25.0)), path, views=views.updates)
    assert balance(views) == 132 and calls[-1] == [7.0, 25.0]
    seen = len(calls)
    files.append(log(), batch(("Withdrawn", 4.0)), path, views=views.updates)  # nothing for the view
    assert len(calls) == seen and balance(views) == 132 and views.build(log()) == {"deposits": "keep"}
    with pytest.raises(LogError):
        files.append(log(), batch(("Deposited", 1.0)), path, views=projections.Views(spark, path, [deposits_view(1, broken=True)]).updates)
    assert log().count() == 6 and balance(views) == 132  # neither events nor view
    files.append(log(), batch(("Deposited", 1.0)), path)  # past the view
    newer = projections.Views(spark, path, [deposits_view(2)])
    assert newer.build(log()) == {"deposits": "rebuild"} and balance(newer) == 133 and values(newer.registry.read(), "name", "version") == [("deposits", 2)]
    with pytest.raises(LogError, match="deposits"):
        views.build(log())


def test_query_object(months):
    kept = compaction.tail_after_checkpoint(compaction.live(months), F.col("type") == "MonthlyClosed")
    after = cut(compaction.compact(months, kept))
    count = lambda rows: rows.agg(F.count("*"))
    money = merged.Family("m", {"Deposited": {"amount": "double"}, "Withdrawn": {"amount": "double"}})
    assert [one(Query(count, lens=x).run(after)) for x in ("true_log", "raw", "live")] == [6, 9, 3]
    assert one(Query(count, families=(money,)).run(after)) == 5 and one(Query(count, filters.after_version(2), (money,), on_undecodable="truncate").run(after)) == 1
    with pytest.raises(Exception, match="undecodable"):
        Query(count, families=(money,), on_undecodable="error").run(after).collect()


def test_long_conversations_keep_their_positions(spark):
    talk = spark.range(0, 9000).select(F.when(F.col("id") < 5000, 1).otherwise(2 + F.col("id") % 3).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    log = schema.log_from_conversations(talk, span=100)
    assert schema.assert_log_invariants(log).count() == 0 and one(feed.contiguous_mark(log)) == 9000
    assert log.where("stream_id = 'urn:conversation:1'").agg(F.max("version")).first()[0] == 5000


def test_observed_batches(spark, months, tmp_path):
    batch, seen = files.observed(months, "batch")
    batch.write.parquet(f"{tmp_path}/x")
    assert seen.get["events"] == 6
