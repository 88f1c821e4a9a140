"""A dense row index, or running totals, over any frame in a given order.

Large frames are range-partitioned by the order, numbered inside each
partition, and shifted by the sizes of the partitions before. The placed rows
are kept by a reliable checkpoint, so numbering and sizes see the same
partitions even after an executor is lost. The order must name a key of the
frame; no task then holds more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.sizes import is_small
from rowloom.session import reliable_checkpoint

PART, AT = "_part", "_at"


def index_size(df: DataFrame) -> int:
    return df.count()


def _placed(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    part = F.spark_partition_id().cast("bigint")
    at = F.monotonically_increasing_id() - F.shiftleft(part, 33)
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return reliable_checkpoint(ranged.withColumn(PART, part).withColumn(AT, at))


def _with_offsets(placed: DataFrame, amounts: DataFrame) -> DataFrame:
    """Join the total of all earlier partitions; one row per task, so small by construction."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = amounts.select(PART, F.coalesce(F.sum("amount").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), PART)


def with_row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_index", small: bool | None = None
) -> DataFrame:
    """Add 0, 1, 2, ... in the order of ``order_by``, which must be unique per row."""
    if is_small(df) if small is None else small:
        window = Window.orderBy(*order_by)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    placed = _placed(df, order_by)
    sizes = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("amount"))
    shifted = _with_offsets(placed, sizes)
    return shifted.withColumn(name, F.col("_before") + F.col(AT)).drop(PART, AT, "_before")


def with_running_total(
    df: DataFrame, order_by: Sequence[str], amount: str, name: str, small: bool | None = None
) -> DataFrame:
    """Add the running sum of ``amount`` in the order of ``order_by``, which must be unique per row."""
    if is_small(df) if small is None else small:
        window = Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(amount).over(window))
    placed = _placed(df, order_by)
    totals = placed.groupBy(PART).agg(F.sum(amount).alias("amount"))
    inside = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifted = _with_offsets(placed.withColumn("_inside", F.sum(amount).over(inside)), totals)
    return shifted.withColumn(name, F.col("_before") + F.col("_inside")).drop(PART, AT, "_before", "_inside")
