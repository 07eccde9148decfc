"""Compaction of all streams at once: what was live becomes an archive, and a shorter log takes its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators.numbering import numbered


def live(log: DataFrame) -> DataFrame:
    return log.where("aggregate_version is null")


def tail_after_checkpoint(rows: DataFrame, checkpoint: Column) -> DataFrame:
    """The last checkpoint of each stream and everything after it; all rows of a stream without one."""
    last = rows.groupBy("stream_id").agg(F.max(F.when(checkpoint, F.col("version"))).alias("__at"))
    return rows.join(last, "stream_id").where(F.col("version") >= F.coalesce("__at", F.lit(0))).drop("__at")


def next_archive(log: DataFrame) -> DataFrame:
    """The number that each stream's next archive gets."""
    return log.groupBy("stream_id").agg((F.coalesce(F.max("aggregate_version"), F.lit(0)) + 1).alias("archive"))


def needs_compaction(streams: DataFrame) -> DataFrame:
    """Has a stream events beyond its watermark. A stream that isn't there has no row: false."""
    return streams.select("id", (F.col("version") > F.coalesce("last_compacted_version", F.lit(0))).alias("needs_compaction"))


def unchanged(log: DataFrame, kept: DataFrame) -> DataFrame:
    """The streams (stream_id) of which `kept` has every live event, by id, and nothing else: what a compactor calls already compacted."""
    rows = live(log).select("stream_id", "id", F.lit(1).alias("n")).union(kept.select("stream_id", "id", F.lit(-1)))
    each = rows.groupBy("stream_id", "id").agg(F.sum("n").alias("n"))
    return each.groupBy("stream_id").agg(F.bool_and(F.col("n") == 0).alias("same")).where("same").select("stream_id")


def compact(log: DataFrame, kept: DataFrame, due: DataFrame | None = None, minimal: DataFrame | None = None, metadata: str | None = None, span: int = 1 << 16) -> DataFrame:
    """The log after compaction: live rows of due streams (all, if not given) become an archive, `kept` their new live rows.

    Streams in `minimal` (stream_id) are already compacted, says the compactor: nothing of them is written. A due stream
    of which nothing is kept is archived whole. `kept` has log rows; they are numbered from 1 by version and marked as
    copies; `metadata`, if given, is theirs. Their positions follow all others without a gap, in the order of the originals.
    `log`, `kept` and `minimal` are read several times: stored tables (stages.cut) are what to hand in.
    """
    out = minimal.select("stream_id") if minimal is not None else log.select("stream_id").limit(0)
    chosen = live(log).select("stream_id").distinct() if due is None else due.select("stream_id").distinct()
    chosen = chosen.join(out, "stream_id", "left_anti")
    archived = live(log).join(chosen, "stream_id", "left_semi").join(next_archive(log), "stream_id").withColumn("aggregate_version", F.col("archive").cast("int")).select(*log.columns)
    others = log.where("aggregate_version is not null").unionByName(live(log).join(chosen, "stream_id", "left_anti").select(*log.columns))
    top = log.agg(F.coalesce(F.max("global_position"), F.lit(0)).alias("__top"))
    new = numbered(kept.join(chosen, "stream_id", "left_semi").withColumnRenamed("version", "__from"), ["stream_id"], "__from", "version", span)
    placed = numbered(new, [], "global_position", "__place", span, ("stream_id", "version")).crossJoin(F.broadcast(top))
    copies = placed.withColumns({"global_position": F.col("__top") + F.col("__place"), "id": F.concat(F.col("id"), F.lit("-copy")), "aggregate_version": F.lit(None).cast("int"), "compacted_snapshot": F.lit(True)})
    if metadata is not None:
        copies = copies.withColumn("metadata", F.lit(metadata))
    return others.unionByName(archived).unionByName(copies.drop("__from", "__place", "__top"), allowMissingColumns=True).select(*log.columns)


def outcomes(log: DataFrame, kept: DataFrame, minimal: DataFrame | None = None) -> DataFrame:
    """Per live stream: compacted with its archive's number, or skipped where the compactor called it `minimal`; and its new watermark.

    A stream of which nothing is kept is archived whole (watermark 0), which is not the same as skipped (watermark at its head).
    """
    before = live(log).groupBy("stream_id").agg(F.max("version").alias("head"))
    after = kept.groupBy("stream_id").agg(F.count("*").alias("after"))
    out = minimal.select("stream_id") if minimal is not None else log.select("stream_id").limit(0)
    both = before.join(after, "stream_id", "left").join(next_archive(log), "stream_id").join(out.distinct().withColumn("skipped", F.lit(True)), "stream_id", "left")
    skipped = F.coalesce("skipped", F.lit(False))
    return both.select("stream_id", F.when(skipped, "skipped").otherwise("compacted").alias("outcome"), F.when(~skipped, F.col("archive")).alias("archive"), F.when(skipped, F.col("head")).otherwise(F.coalesce("after", F.lit(0))).alias("watermark"))


def settled(streams: DataFrame, done: DataFrame) -> DataFrame:
    """The streams table after a compaction with these outcomes: heads and watermarks, both moved by what was compacted or skipped."""
    met = streams.join(done.select(F.col("stream_id").alias("__id"), "outcome", "watermark"), F.col("id") == F.col("__id"), "left")
    version = F.when(F.col("outcome") == "compacted", F.col("watermark")).otherwise(F.col("version"))
    return met.select("id", "type", version.cast("bigint").alias("version"), F.coalesce("watermark", "last_compacted_version").cast("bigint").alias("last_compacted_version"))


def current(streams: DataFrame, heads: DataFrame) -> DataFrame:
    """The streams table with the log's heads: watermarks stay, new streams have none."""
    marks = streams.select(F.col("id").alias("__id"), "last_compacted_version")
    return heads.join(marks, F.col("id") == F.col("__id"), "left").select("id", "type", "version", "last_compacted_version")


def to_snapshot(log: DataFrame, state: Column, kind: str) -> tuple[DataFrame, DataFrame]:
    """Folds each live stream to one event of type `kind` whose payload is its `state`: the rows to keep, and the streams that are such a lone event already."""
    folded = live(log).groupBy("stream_id").agg(F.count("*").alias("n"), F.max("type").alias("only"), state.alias("total"), F.max("stream_type").alias("stream_type"), F.max_by("id", "version").alias("last"), F.max("created").alias("created"), F.max("global_position").alias("global_position"))
    lone = (F.col("n") == 1) & (F.col("only") == kind)
    data = F.to_json(F.create_map(F.lit(kind), F.struct("total")))
    kept = folded.where(~lone).select(F.concat("last", F.lit("-snapshot")).alias("id"), data.alias("data"), F.lit("null").alias("metadata"), "stream_id", "stream_type", F.lit(kind).alias("type"), F.lit(1).cast("bigint").alias("version"), "created", F.lit(None).cast("int").alias("aggregate_version"), "global_position", F.lit(True).alias("compacted_snapshot"))
    return kept, folded.where(lone).select("stream_id")
