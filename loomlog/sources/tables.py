"""Small tables that are kept beside a log (cursors, dead letters, versions of views): each state is written whole and published under the next number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.sources.publish import Folder

#: States that stay readable behind the newest one, for readers that are at it.
KEEP = 4


class Table:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.schema, self.folder = spark, schema, Folder(spark, path)

    def _newest(self) -> tuple[int, list[str]]:
        self.folder.recover()
        states = self.folder.names("state-")
        return (int(states[-1].removeprefix("state-")) if states else 0), states

    def read(self) -> DataFrame:
        number, states = self._newest()
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{states[-1]}")

    def replace(self, df: DataFrame) -> None:
        """`df` (made from what read() gave) is the table from now on; a conflict if another writer replaced it meanwhile."""
        number, states = self._newest()
        aside = self.folder.aside(df)
        self.folder.publish(number + 1, {aside: f"state-{number + 1:020}"})
        self.folder.remove(*states[:-KEEP])
