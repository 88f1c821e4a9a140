"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 50_000


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when the frame has at most ``rows`` rows.

    ``take`` reads partitions until it has enough, so a large frame is not
    scanned to the end, and at most ``rows + 1`` one-column rows come back.
    """
    return len(df.select(F.lit(1).alias("one")).take(rows + 1)) <= rows
