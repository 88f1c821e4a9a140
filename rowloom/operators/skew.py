"""Joins against a frame that has one row per key.

A small side is broadcast after its size was checked. Otherwise both sides
are shuffled, and keys holding more rows than an average task are spread over
as many salts as they need, with only their single match repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.sizes import MAX_BROADCAST_ROWS, is_small

SALT = "_salt"
SALTS = "_salts"
REPEATED_AT_ONCE = 4096


def hot_keys(df: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """Keys with more than 1/parts of all rows, so never more than ``parts`` keys."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    share = max(1, total // parts)
    return counts.filter(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).cast("bigint").alias(SALTS))


def _repeated(df: DataFrame, copies: str) -> DataFrame:
    """Every row as often as ``copies`` says, in two steps, so that no row carries a long array."""
    n = F.col(copies)
    lots = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / REPEATED_AT_ONCE)), lambda lot: F.least(F.lit(REPEATED_AT_ONCE).cast("bigint"), n - lot * REPEATED_AT_ONCE)
    )
    return df.withColumn(copies, F.explode(lots)).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("bigint"), n))).drop(copies)


def salted_join(df: DataFrame, unique: DataFrame, on: Sequence[str], how: str, parts: int | None = None) -> DataFrame:
    on = list(on)
    if set(df.columns) <= set(on):
        # rows that are nothing but their key cannot be told apart by a salt: they are joined as counts
        counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_copies"))
        return _repeated(counted.join(unique, on, how), "_copies")
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(df, on, parts))
    nameless = F.lit(False)
    for c in on:
        nameless = nameless | F.col(c).isNull()
    # null keys match nothing and may go anywhere
    share = F.when(nameless, F.lit(parts).cast("bigint")).otherwise(F.coalesce(F.col(SALTS), F.lit(1).cast("bigint")))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), share)
    left = df.join(hot, on, "left").withColumn(SALT, spread).drop(SALTS)
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(SALTS), F.lit(1).cast("bigint")) - 1)
    right = unique.join(hot, on, "left").withColumn(SALT, F.explode(salts)).drop(SALTS)
    return left.join(right, [*on, SALT], how).drop(SALT)


def join_unique(
    df: DataFrame, unique: DataFrame, on: Sequence[str], how: str = "left", small: bool | None = None,
    limit: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join to a frame with at most one row per key; ``small`` skips the size check."""
    if is_small(unique, limit) if small is None else small:
        return df.join(F.broadcast(unique), list(on), how)
    return salted_join(df, unique, on, how)
