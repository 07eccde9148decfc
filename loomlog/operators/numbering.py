"""Row numbers and running sums within a key, spread over many tasks for keys that hold a large share of all rows.

A key's rows are cut into cells by ranges of the order column. Windows run within (key, cell); what earlier
cells add comes from a table with one row a cell. So no task sorts a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cells(df: DataFrame, key: list[str], order: str, amount: Column, span: int) -> tuple[DataFrame, DataFrame]:
    celled = df.withColumn("__cell", F.floor(F.col(order) / span))
    before = W.partitionBy(*key).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    sums = celled.groupBy(*key, "__cell").agg(F.sum(amount).alias("__sum"))
    return celled, sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")


def numbered(df: DataFrame, key: list[str], order: str, name: str, span: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """`name`: 1, 2, ... within `key` by the integer column `order`; rows that are equal there are ordered by `ties`. Keys may not be null.

    Without a key all rows are numbered: only the table of cells, one row for `span` values of `order`, meets in one task.
    """
    celled, before = _cells(df, key, order, F.lit(1), span)
    own = F.row_number().over(W.partitionBy(*key, "__cell").orderBy(order, *ties))
    return celled.withColumn("__own", own).join(before, [*key, "__cell"]).withColumn(name, (F.col("__own") + F.col("__before")).cast("bigint")).drop("__cell", "__own", "__before")


def running_sum(df: DataFrame, key: list[str], order: str, amount: Column, name: str, span: int) -> DataFrame:
    """`name`: the sum of `amount` within `key` up to each row by `order`."""
    celled, before = _cells(df.withColumn("__amount", amount), key, order, F.col("__amount"), span)
    own = F.sum("__amount").over(W.partitionBy(*key, "__cell").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return celled.withColumn("__own", own).join(before, [*key, "__cell"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__cell", "__own", "__before", "__amount")
