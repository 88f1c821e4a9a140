"""Ingest metrics: summaries, percentiles, throughput and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.row_index import with_running_total
from rowloom.operators.skew import join_unique
from rowloom.session import reliable_checkpoint

PERCENTILES = {"p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def summarize(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )


def significant(value: Column, digits: int) -> Column:
    """Round down to so many significant digits, which bounds the number of distinct values."""
    magnitude = F.floor(F.log10(F.abs(value)))
    step = F.pow(F.lit(10.0), magnitude - (digits - 1))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(value / step) * step)


def percentiles(
    df: DataFrame, value: str, by: Sequence[str] = (), points: Mapping[str, float] | None = None,
    digits: int | None = None, small: bool | None = None,
) -> DataFrame:
    """Discrete percentiles: the smallest value that covers the share.

    Values are counted first, so a frequent value is one row; ranks are running
    totals over the ordered values, spread over tasks. ``digits`` keeps only so
    many significant digits, as a histogram would.
    """
    by, points = list(by), points or PERCENTILES
    measured = df.select(*by, F.col(value).alias("_v")).dropna(subset=["_v"])
    if digits is not None:
        measured = measured.withColumn("_v", significant(F.col("_v"), digits))
    counts = measured.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    if small is None:
        # Read the input once: the size check and the ranking both use the stored counts.
        counts = reliable_checkpoint(counts)
    running = with_running_total(counts, [*by, "_v"], "_n", "_cum", small)
    if by:
        running = running.withColumn("_group", F.struct(*by))  # a struct of nulls equals its like, so a group of nulls is joined too
    groups = running.groupBy(*(["_group"] if by else [])).agg(F.sum("_n").alias("_total"), F.min(F.col("_cum") - F.col("_n")).alias("_base"))
    if by:
        ranked = join_unique(running, groups, ["_group"])
    else:
        ranked = running.withColumn("_one", F.lit(1)).join(F.broadcast(groups.withColumn("_one", F.lit(1))), "_one")
    rank = F.col("_cum") - F.col("_base")
    wanted = [
        F.min(F.when(rank >= F.ceil(F.col("_total") * F.lit(p)), F.col("_v"))).alias(name) for name, p in points.items()
    ]
    return ranked.groupBy(*by).agg(*wanted)


def percentiles_sketch(
    df: DataFrame, value: str, by: Sequence[str] = (), points: Mapping[str, float] | None = None, accuracy: int = 10_000
) -> DataFrame:
    """Approximate percentiles in one pass and constant memory per group."""
    points = points or PERCENTILES
    return df.groupBy(*by).agg(*[F.percentile_approx(value, p, accuracy).alias(n) for n, p in points.items()])


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second; less than one second counts as one."""
    return rows / F.greatest(F.lit(1.0), seconds)


def reconcile(produced: DataFrame, consumed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose produced and consumed row counts differ."""
    by = list(by)
    left = produced.groupBy(*by).agg(F.count(F.lit(1)).alias("produced"))
    right = consumed.groupBy(*by).agg(F.count(F.lit(1)).alias("consumed"))
    zero = F.lit(0).cast("bigint")
    joined = left.join(right, by, "full_outer")
    both = joined.select(*by, F.coalesce("produced", zero).alias("produced"), F.coalesce("consumed", zero).alias("consumed"))
    return both.filter("produced <> consumed")


def reconcile_contents(produced: DataFrame, consumed: DataFrame, by: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Rows that one side holds more often than the other, with how often: the columns, produced, consumed.

    First both sides are reduced to a fingerprint for each bucket of the ``by`` columns: the
    number of rows and two sums over halves of a 64-bit hash of the row, whatever its place.
    Only rows of buckets whose fingerprints differ are compared as rows. Both sides have the
    same columns, of types that can be grouped; nulls equal nulls, repeated rows are counted.
    """
    columns = produced.columns
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    # a hash passes over nulls, so which columns are null goes into it as well
    row = F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))
    marks = [F.count(F.lit(1)), F.sum(row.bitwiseAND(F.lit((1 << 32) - 1))), F.sum(F.shiftrightunsigned(row, 32))]

    def fingerprints(df: DataFrame) -> DataFrame:
        return df.groupBy(bucket.alias("bucket")).agg(F.struct(*(m.alias(f"m{k}") for k, m in enumerate(marks))).alias("marks"))

    left, right = fingerprints(produced).alias("l"), fingerprints(consumed).alias("r")
    differing = left.join(right, "bucket", "full_outer").where(~F.col("l.marks").eqNullSafe(F.col("r.marks"))).select("bucket")
    differing = F.broadcast(reliable_checkpoint(differing))  # at most ``buckets`` numbers

    def suspects(df: DataFrame, sides: tuple[int, int]) -> DataFrame:
        counted = df.select("*", *(F.lit(n).cast("bigint").alias(c) for n, c in zip(sides, ("_produced", "_consumed"))))
        return counted.join(differing, bucket == F.col("bucket"), "left_semi")

    both = suspects(produced, (1, 0)).union(suspects(consumed.select(*columns), (0, 1)))
    counts = both.groupBy(*columns).agg(F.sum("_produced").alias("produced"), F.sum("_consumed").alias("consumed"))
    return counts.where("produced <> consumed")


def bucket_of(value: Column, bits: int = 8) -> Column:
    """Number of the log-linear bucket of a whole number: each doubling of the values has 2^(bits-1) buckets of one width.

    Numbers below 2^bits have a bucket of their own, greater ones share it with numbers that
    differ by less than 2^(1-bits) of their size. Negative numbers mirror the others: -1 goes
    with 0, -2 with 1. Buckets follow the order of the values. Null has no bucket.
    """
    value = value.cast("bigint")
    size = F.when(value < 0, F.bitwise_not(value)).otherwise(value)
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit(bits))
    # a shift by a column is a SQL function only
    index = F.shiftleft(shift.cast("bigint"), bits - 1) + F.call_function("shiftright", size, shift)
    return F.when(value < 0, F.bitwise_not(index)).otherwise(index)


def bucket_bounds(bucket: Column, bits: int = 8) -> tuple[Column, Column]:
    """The smallest and the greatest whole number of a bucket."""
    index = F.when(bucket < 0, F.bitwise_not(bucket)).otherwise(bucket)
    shift = F.greatest(F.lit(0), F.shiftright(index, bits - 1) - F.lit(1)).cast("int")
    low = F.call_function("shiftleft", index - F.shiftleft(shift.cast("bigint"), bits - 1), shift)
    high = low + (F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - F.lit(1))
    return F.when(bucket < 0, F.bitwise_not(high)).otherwise(low), F.when(bucket < 0, F.bitwise_not(low)).otherwise(high)


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """(by, bucket, count) of whole numbers in log-linear buckets; nulls are left out.

    A group has at most 2^bits * (65 - bits) buckets however many rows it has, and they are
    counted before the shuffle. Also for streams, in update or complete mode.
    """
    placed = df.where(F.col(value).isNotNull()).select(*by, bucket_of(F.col(value), bits).alias("bucket"))
    return placed.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("count"))


def merge_histograms(histograms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Histograms of parts (chunks, batches, finer groups) as one: equal to the histogram of all their rows."""
    return histograms.groupBy(*by, "bucket").agg(F.sum("count").alias("count"))


def pack_histograms(histograms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each group with its ``histogram``, an array of (bucket, count) in order, to be stored beside a chunk."""
    return histograms.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "count"))).alias("histogram"))


def unpack_histograms(packed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return packed.select(*by, F.inline("histogram"))


def histogram_percentiles(
    histograms: DataFrame, by: Sequence[str] = (), points: Mapping[str, float] | None = None, bits: int = 8
) -> DataFrame:
    """Percentiles from a histogram: the greatest number of the bucket that covers the share.

    For numbers from 0 on that is never below the exact percentile, and above it by less than
    2^(1-bits) of it. No rows, no percentiles: a group without values is missing, and without
    groups there is one row of nulls. A window holds the buckets of one group, whose number is bounded.
    """
    by, points = list(by), points or PERCENTILES
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = histograms.withColumns({"_cum": F.sum("count").over(group.orderBy("bucket")), "_total": F.sum("count").over(group)})
    high = bucket_bounds(F.col("bucket"), bits)[1]
    wanted = [F.min(F.when(F.col("_cum") >= F.ceil(F.col("_total") * F.lit(p)), high)).alias(n) for n, p in points.items()]
    return placed.groupBy(*by).agg(*wanted)
