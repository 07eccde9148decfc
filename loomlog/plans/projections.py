"""Projections: views that are kept up with the log, batch by batch, and rebuilt when their code's version rises."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.errors import LogError
from loomlog.operators.folds import MONEY, money, signed
from loomlog.schema import PROJECTIONS
from loomlog.sources.publish import Folder
from loomlog.sources.tables import KEEP, Table


@dataclass(frozen=True)
class Projection:
    """`partial` turns events into rows of the view, `combine` adds up rows of one key; the filter holds on rebuilds and on appends alike."""

    name: str
    version: int
    where: Column
    partial: Callable[[DataFrame], DataFrame]
    combine: Callable[[DataFrame], DataFrame]

    def rebuild(self, log: DataFrame) -> DataFrame:
        return self.combine(self.partial(log.where(self.where)))

    def apply(self, view: DataFrame, batch: DataFrame) -> DataFrame:
        """The view after a batch: old rows and the batch's, added up. It equals a rebuild over both."""
        return self.combine(view.unionByName(self.partial(batch.where(self.where))))


def plan(registered: DataFrame, code: DataFrame) -> DataFrame:
    """For each projection in `code` (name, version) what to do: init, rebuild, keep, or invalid where the stored version is newer."""
    met = code.join(registered.select(F.col("name").alias("__name"), F.col("version").alias("stored")), F.col("name") == F.col("__name"), "left")
    action = F.when(F.col("stored").isNull(), "init").when(F.col("stored") < F.col("version"), "rebuild").when(F.col("stored") == F.col("version"), "keep").otherwise("invalid")
    return met.select("name", "stored", "version", action.alias("action"))


def check(planned: DataFrame) -> DataFrame:
    """The plan, or an error naming a projection whose stored version is newer than the code's."""
    if bad := planned.where("action = 'invalid'").limit(1).collect():
        raise LogError("invalid_input", f"projection {bad[0]['name']} is stored at a newer version", "build")
    return planned


class Views:
    """Stored views beside a log (in its folder, where no reader of the log looks), with a record of each one's version.

    A state of a view is a folder `v<version>-<position>`; the last by name is the view. build() brings all to their code's
    version, the record last. updates() is for files.append(): it writes the views' next states aside, and they are published
    with the events or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, all_: Sequence[Projection]) -> None:
        self.spark, self.all_ = spark, {x.name: x for x in all_}
        self.folder = Folder(spark, path)
        self.registry = Table(spark, f"{self.folder.path}/_projections", PROJECTIONS)

    def _states(self, name: str) -> list[str]:
        self.folder.recover()
        return Folder(self.spark, f"{self.folder.path}/_view-{name}").names("v")

    def read(self, name: str) -> DataFrame:
        """The view as it is stored."""
        return self.spark.read.parquet(f"{self.folder.path}/_view-{name}/{self._states(name)[-1]}")

    def build(self, log: DataFrame) -> dict[str, str]:
        """What was done for each projection: init or rebuild (from the whole log, what was there before goes), or keep. A stored
        version that is newer than the code's is an error, and nothing is written."""
        code = self.spark.createDataFrame([(x.name, x.version) for x in self.all_.values()], "name string, version int")
        planned = {r["name"]: r["action"] for r in check(plan(self.registry.read(), code)).collect()}
        todo = [x for x in self.all_.values() if planned[x.name] != "keep"]
        top = log.agg(F.coalesce(F.max("global_position"), F.lit(0))).first()[0]
        for x in todo:
            self.folder.move(self.folder.aside(x.rebuild(log)), f"_view-{x.name}/v{x.version:06}-{top:020}")
        if todo:
            now = code.where(F.col("name").isin([x.name for x in todo])).withColumn("updated_at", F.current_timestamp())
            self.registry.replace(self.registry.read().where(~F.col("name").isin([x.name for x in todo])).unionByName(now))
        return planned

    def updates(self, batch: DataFrame, folder: Folder) -> dict[str, str]:
        """Writes the next state of each view that the batch concerns; what is to be renamed. A projection without events for it isn't called."""
        top, moves = batch.agg(F.max("global_position")).first()[0], {}
        try:
            for x in self.all_.values():
                if batch.where(x.where).isEmpty():
                    continue
                states = self._states(x.name)
                moves[folder.aside(x.apply(self.read(x.name), batch))] = f"_view-{x.name}/v{x.version:06}-{top:020}"
                folder.remove(*(f"_view-{x.name}/{old}" for old in states[:-KEEP]))
        except Exception:
            folder.remove(*moves)
            raise
        return moves


def balances(plus: str, minus: str, amount: Column, version: int = 1) -> Projection:
    """Account balances: an upsert that adds."""

    def partial(log: DataFrame) -> DataFrame:
        return log.select("stream_id", F.coalesce(signed(amount, plus, minus), F.lit(0).cast(MONEY)).alias("balance"))

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy("stream_id").agg(F.sum("balance").alias("balance"))

    return Projection("account_balances", version, F.col("type").isin(plus, minus), partial, combine)


def owner_totals(movements: DataFrame, opened: DataFrame, amount: Column) -> DataFrame:
    """Totals per owner of the movements of accounts that were opened before them; those of unknown accounts, and earlier ones, count nothing.

    `opened`: stream_id, owner, opened_at (its position). `movements`: stream_id, global_position.
    """
    met = movements.select("stream_id", "global_position", money(amount).alias("__amount")).join(opened.select("stream_id", "owner", "opened_at"), "stream_id").where("global_position > opened_at")
    return met.groupBy("owner").agg(F.sum("__amount").alias("total"), F.count("*").alias("movements"))
