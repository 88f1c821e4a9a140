"""Key checks. Spark does not enforce keys, so they are verified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_primary_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Violations: keys with a null part or more than one row, with their row count."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    has_null = F.lit(False)
    for c in key:
        has_null = has_null | F.col(c).isNull()
    return counts.filter((F.col("n_rows") > 1) | has_null)


def check_foreign_key(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Child keys without a parent, with their row count; null keys do not refer to anything.

    Child rows are counted per key before the join, so a frequent key is one row by then.
    """
    names = [c for c, _ in on]
    counts = child.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))
    keys = parent.select(*[F.col(p).alias(f"_{c}") for c, p in on])
    # The count in the condition keeps the optimizer from moving the join below the grouping.
    match = F.col("n_rows") > 0
    for c in names:
        match = match & (F.col(c) == F.col(f"_{c}"))
    return counts.join(keys, match, "left_anti")
