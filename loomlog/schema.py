"""The log's schema, the operational tables' schemas, and logs made from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators.numbering import numbered, running_sum

EVENT_LOG = "id string, data string, metadata string, stream_id string, stream_type string, type string, version bigint, created timestamp, aggregate_version int, global_position bigint, compacted_snapshot boolean"
STREAMS = "id string, type string, version bigint, last_compacted_version bigint"
PROJECTIONS = "name string, version int, updated_at timestamp"
POLICY_CURSORS = "name string, position bigint, updated_at timestamp"
DEAD_LETTERS = "id bigint, policy_name string, global_position bigint, event_id string, error_kind string, error_message string, created_at timestamp"
DISCARDED_DEAD_LETTERS = "id bigint, dead_letter_id bigint, policy_name string, global_position bigint, event_id string, error_kind string, error_message string, created_at timestamp, reason string, discarded_at timestamp"

#: Positions of a cell when versions are numbered: a stream's events within so many positions are sorted by one task.
SPAN = 1 << 16


def log_of(df: DataFrame, *, stream_id: Column, stream_type: str, position: Column, created: Column, type: Column, data: Column, metadata: Column, versions: bool = True, span: int = SPAN, typed: dict[str, Column] | None = None) -> DataFrame:
    """A log from any table with a position that is unique and grows with time: versions count a stream's rows.

    Without `versions` they are null, and the log is a mere projection of the table: no shuffle. `typed` columns stand
    beside the payload, with what it says: only a log that is stored has to be parsed.
    """
    rows = df.select(
        F.concat(F.lit(f"{stream_type}-"), position.cast("string")).alias("id"),
        data.alias("data"),
        metadata.alias("metadata"),
        stream_id.alias("stream_id"),
        F.lit(stream_type).alias("stream_type"),
        type.alias("type"),
        created.cast("timestamp").alias("created"),
        F.lit(None).cast("int").alias("aggregate_version"),
        position.cast("bigint").alias("global_position"),
        F.lit(False).alias("compacted_snapshot"),
        *(x.alias(name) for name, x in (typed or {}).items()),
    )
    names = [*(x.split()[0] for x in EVENT_LOG.split(", ")), *(typed or {})]
    counted = numbered(rows, ["stream_id"], "global_position", "version", span) if versions else rows.withColumn("version", F.lit(None).cast("bigint"))
    return counted.select(*names)


def log_from_events(events: DataFrame, versions: bool = True, typed: bool = False) -> DataFrame:
    """The log of the `events` table: a stream per user, positions from 1; `typed` adds value."""
    payload = F.to_json(F.create_map(F.col("event_type"), F.struct(F.col("value").alias("value"))))
    return log_of(events, stream_id=F.concat(F.lit("urn:user:"), F.col("user_id").cast("string")), stream_type="User", position=F.col("event_id") + 1, created=F.col("ts"), type=F.col("event_type"), data=payload, metadata=F.coalesce("props", F.lit("null")), versions=versions, typed={"value": F.col("value")} if typed else None)


def log_from_orders(orders: DataFrame, versions: bool = True, typed: bool = False) -> DataFrame:
    """A second family: one OrderPlaced per order, its own stream; `typed` adds total and owner."""
    own = {"total": F.col("o_totalprice"), "owner": F.concat(F.lit("urn:customer:"), F.col("o_custkey").cast("string"))}
    payload = F.to_json(F.create_map(F.lit("OrderPlaced"), F.struct(*(x.alias(name) for name, x in own.items()))))
    return log_of(orders, stream_id=F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")), stream_type="Order", position=F.col("o_orderkey") + 1, created=F.col("o_orderdate"), type=F.lit("OrderPlaced"), data=payload, metadata=F.lit("null"), versions=versions, typed=own if typed else None)


def log_from_lineitem(lineitem: DataFrame, versions: bool = True, typed: bool = False) -> DataFrame:
    """LineAdded events on the orders' streams; positions leave room for a line's number; `typed` adds quantity and price."""
    own = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice")}
    payload = F.to_json(F.create_map(F.lit("LineAdded"), F.struct(*(x.alias(name) for name, x in own.items()))))
    return log_of(lineitem, stream_id=F.concat(F.lit("urn:order:"), F.col("l_orderkey").cast("string")), stream_type="Order", position=F.col("l_orderkey") * 16 + F.col("l_linenumber"), created=F.col("l_shipdate"), type=F.lit("LineAdded"), data=payload, metadata=F.lit("null"), versions=versions, typed=own if typed else None)


def log_from_conversations(conversations: DataFrame, versions: bool = True, span: int = SPAN) -> DataFrame:
    """A stream per conversation, an event per turn; positions are dense, by conversation and turn, however many turns there are."""
    long = conversations.groupBy(F.col("conv_id").alias("__conv")).agg(F.count("*").alias("__turns"))
    begun = running_sum(long, [], "__conv", F.col("__turns"), "__upto", span).withColumn("__before", F.col("__upto") - F.col("__turns"))
    turned = numbered(conversations, ["conv_id"], "turn", "__turn", span).join(begun.select("__conv", "__before"), F.col("conv_id") == F.col("__conv"))
    payload = F.to_json(F.create_map(F.lit("Said"), F.struct(F.col("role").alias("role"), F.length("text").alias("length"))))
    return log_of(turned, stream_id=F.concat(F.lit("urn:conversation:"), F.col("conv_id").cast("string")), stream_type="Conversation", position=F.col("__before") + F.col("__turn"), created=F.timestamp_seconds(F.col("conv_id")), type=F.col("role"), data=payload, metadata=F.lit("null"), versions=versions)


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_LOG)


def assert_log_invariants(log: DataFrame) -> DataFrame:
    """Rows that break the log's uniqueness: of (stream_id, aggregate_version, version), and of positions. None in a good log."""
    versions = log.groupBy("stream_id", "aggregate_version", "version").count().where("count > 1").select(F.lit("version").alias("rule"), "stream_id", F.col("version").alias("at"))
    positions = log.groupBy("global_position").count().where("count > 1").select(F.lit("position").alias("rule"), F.lit(None).cast("string").alias("stream_id"), F.col("global_position").alias("at"))
    return versions.union(positions)
