"""Live queries as one object: which events (filter), how they are seen (lens), what becomes of undecodable ones, and the fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from loomlog.operators import filters
from loomlog.operators.merged import Family, decoded
from loomlog.operators.scan import scan


@dataclass(frozen=True)
class Query:
    """`fold` gets the events that pass `where` under `lens` and decode as one of `families` (all, if none are given).

    The true log is the default lens: after a compaction no event counts twice. `raw` gives archived events and copies alike.
    """

    fold: Callable[[DataFrame], DataFrame]
    where: Column = field(default_factory=filters.everything)
    families: tuple[Family, ...] = ()
    lens: str = "true_log"
    on_undecodable: str = "skip"

    def run(self, log: DataFrame) -> DataFrame:
        rows = scan(log, self.where, self.lens)
        return self.fold(decoded(rows, list(self.families), self.on_undecodable) if self.families else rows)
