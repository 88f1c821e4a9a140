"""Blocks of ids for several loaders: every block is one commit of a shared log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.row_index import with_row_index
from rowloom.sources.log import CommitLog


class IdBlocks:
    """Ids from ``start`` on in steps of ``step``; no id is given out twice, whoever asks."""

    def __init__(self, spark: SparkSession, path: str, start: int = 1, step: int = 1):
        if step < 1:
            raise ValueError("the step must be positive")
        self.step = step
        self._log = CommitLog(spark, path, {"next": start}, lambda state, commit: {"next": max(state["next"], commit["until"])})

    def take(self, n: int) -> int:
        """Reserve ``n`` ids and return the first. A block whose loader fails is a gap, never given out again."""
        if n < 0:
            raise ValueError("a block cannot be negative")
        if n == 0:
            return self._log.state()[1]["next"]
        state, _ = self._log.commit_next(lambda state: {"until": state["next"] + n * self.step})
        return state["next"]

    def number(self, df: DataFrame, order_by: Sequence[str], name: str = "id") -> DataFrame:
        """``df`` with ids of one block in the order of ``order_by``, which must be unique per row."""
        first = self.take(df.count())
        indexed = with_row_index(df, order_by, "_place")
        return indexed.withColumn(name, F.lit(first).cast("bigint") + F.col("_place") * F.lit(self.step).cast("bigint")).drop("_place")
