"""Chunked ingest: chunks, conflict modes, error policies and update counts."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.draws import int_div
from rowloom.operators.row_index import with_row_index
from rowloom.operators.skew import join_unique
from rowloom.sources.log import CommitConflict
from rowloom.sources.target import FileTarget

logger = logging.getLogger(__name__)

CHUNK_SIZE = 16
STATEMENT_ROWS = 128  # most rows one multi-value statement may carry
MAX_UPSERT_SEGMENTS = 32  # after so many the target is compacted
COMMIT_TRIES = 16
MODES = ("error", "do_nothing", "upsert")
METHODS = ("batch", "array", "singleton")
POLICIES = ("IGNORE_AND_CONTINUE", "LOG_AND_CONTINUE", "RETHROW")


class KeyConflict(ValueError):
    """Incoming rows repeat a key, or use one the target already has."""


# -- chunks ------------------------------------------------------------------------


def chunk_of(row: Column, size: int = CHUNK_SIZE) -> Column:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return int_div(row, size)


def assign_chunks(df: DataFrame, order_by: Sequence[str], size: int = CHUNK_SIZE, small: bool | None = None) -> DataFrame:
    """Consecutive chunks of ``size`` rows in arrival order; the last one may be short."""
    indexed = with_row_index(df, order_by, "row_index", small)
    return indexed.withColumn("chunk_id", chunk_of(F.col("row_index"), size))


def pack_columns(df: DataFrame, chunk: str, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per chunk with one array per column. A chunk holds at most its size in rows."""
    rows = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], *columns)
    packed = df.groupBy(chunk).agg(F.sort_array(F.collect_list(rows)).alias("_rows"))
    return packed.select(chunk, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def unpack_columns(df: DataFrame, chunk: str, columns: Sequence[str]) -> DataFrame:
    """Back to rows, all arrays in lock-step."""
    return df.select(chunk, F.inline(F.arrays_zip(*columns)))


# -- conflicts ------------------------------------------------------------------------


def _one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # A row_number filter lets Spark cut every group before the shuffle, so a
    # frequent key reaches its task as one row per input partition.
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return _one_per_key(df, key, [F.col(c).asc() for c in order_by])


def last_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    return _one_per_key(df, key, [F.col(c).desc() for c in order_by])


def conflicts(df: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys an insert would be refused for, with how often they come in and whether the target has them."""
    incoming = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    known = target.select(*key).distinct().withColumn("in_target", F.lit(True))
    joined = incoming.join(known, list(key), "left")
    return joined.filter((F.col("n_rows") > 1) | F.col("in_target")).withColumn(
        "in_target", F.coalesce(F.col("in_target"), F.lit(False))
    )


def insert_rows(df: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of a plain insert; raises on the first conflict."""
    clash = conflicts(df, target, key).take(1)
    if clash:
        raise KeyConflict(f"duplicate key {clash[0].asDict()}")
    return df


def do_nothing_rows(df: DataFrame, target: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows to add when conflicting rows are skipped: the first arrival of each new key."""
    return first_per_key(df, key, order_by).join(target.select(*key), list(key), "left_anti")


def upsert_rows(df: DataFrame, target: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The whole table after an upsert: the last arrival of each key over the kept rows."""
    latest = last_per_key(df, key, order_by).select(*target.columns)
    return target.join(latest.select(*key), list(key), "left_anti").select(*target.columns).unionByName(latest)


def ingest(
    df: DataFrame, target: FileTarget, order_by: Sequence[str], mode: str = "error", batch_id: int | None = None
) -> bool:
    """Apply one batch to the target; a batch id seen before is skipped. Returns whether it was applied.

    Only files of the target that may hold a key of the batch are opened. When another writer
    commits in between, the batch is held against the table again.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    key = target.key
    whole_key = F.lit(True)
    for k in key:
        whole_key = whole_key & F.col(k).isNotNull()
    nameless = df.filter(~whole_key).take(1)
    for _ in range(COMMIT_TRIES):
        snapshot = target.snapshot()
        if snapshot.has_batch(batch_id):
            return False
        if nameless:
            raise KeyConflict(f"null key {nameless[0].asDict()}")
        try:
            if mode == "upsert":
                target.upsert(last_per_key(df, key, order_by), batch_id, snapshot)
                if len(snapshot.deletes) + 1 >= MAX_UPSERT_SEGMENTS:
                    target.compact()
            elif mode == "do_nothing":
                target.append(do_nothing_rows(df, target.known_keys(df, snapshot), key, order_by), batch_id, snapshot)
            else:
                target.append(insert_rows(df, target.known_keys(df, snapshot), key), batch_id, snapshot)
            return True
        except CommitConflict:
            logger.info("another writer was faster, batch %s is tried again", batch_id)
    raise CommitConflict(f"batch {batch_id} lost {COMMIT_TRIES} times")


# -- errors ------------------------------------------------------------------------------


def refused(bad: Column) -> Column:
    """A condition that cannot be judged counts against the row."""
    return F.coalesce(bad, F.lit(True))


def accepted_rows(df: DataFrame, bad: Column, method: str, chunk: str = "chunk_id", row: str = "row_index") -> DataFrame:
    """Rows that survive the bad ones.

    A batch or array chunk with any bad row is lost whole; single inserts keep
    the rows before the first bad one of their chunk. Only the bad rows are
    grouped, so the other chunks are not shuffled when few are bad.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    first_bad = df.filter(refused(bad)).groupBy(chunk).agg(F.min(row).alias("_first_bad"))
    if method in ("batch", "array"):
        return join_unique(df, first_bad.select(chunk), [chunk], "left_anti")
    joined = join_unique(df, first_bad, [chunk], "left")
    return joined.filter(F.col("_first_bad").isNull() | (F.col(row) < F.col("_first_bad"))).drop("_first_bad")


def apply_error_policy(
    df: DataFrame, bad: Column, policy: str = "RETHROW", method: str = "batch", chunk: str = "chunk_id", row: str = "row_index"
) -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    bad = refused(bad)
    if policy == "RETHROW":
        first = df.filter(bad).take(1)
        if first:
            raise ValueError(f"bad row {first[0].asDict()}")
        return df
    if policy == "LOG_AND_CONTINUE":
        logger.warning("%d bad rows are left out", df.filter(bad).count())
    return accepted_rows(df, bad, method, chunk, row)


def apply_error_policies(
    df: DataFrame, transient: Column, permanent: Column, transient_policy: str = "LOG_AND_CONTINUE",
    permanent_policy: str = "RETHROW", method: str = "batch", chunk: str = "chunk_id", row: str = "row_index",
) -> DataFrame:
    """One policy for rows that might succeed when sent again, another for those that never will."""
    kept = apply_error_policy(df, permanent, permanent_policy, method, chunk, row)
    return apply_error_policy(kept, transient, transient_policy, method, chunk, row)


def split_rejects(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows)."""
    flag = refused(bad)
    return df.filter(~flag), df.filter(flag)


def chunked_insert(
    df: DataFrame,
    target: FileTarget,
    order_by: Sequence[str],
    method: str = "batch",
    mode: str = "error",
    bad: Column | None = None,
    policy: str = "RETHROW",
    size: int = CHUNK_SIZE,
) -> DataFrame:
    """Ingest in chunks and report per chunk: rows offered and rows accepted.

    The array method carries each chunk as one row of arrays to the sink.
    """
    chunked = assign_chunks(df, order_by, size)
    kept = chunked if bad is None else apply_error_policy(chunked, bad, policy, method)
    offered = chunked.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows_in"))
    accepted = kept.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows_out"))
    if method == "array":
        carried = ["row_index", *df.columns]
        kept = unpack_columns(pack_columns(kept, "chunk_id", ["row_index"], carried), "chunk_id", carried)
    ingest(kept, target, ["row_index"], mode)
    return offered.join(accepted, "chunk_id", "left").select(
        "chunk_id", "rows_in", F.coalesce("rows_out", F.lit(0).cast("bigint")).alias("rows_out")
    )


def statements(df: DataFrame, method: str, chunk: str = "chunk_id", limit: int = STATEMENT_ROWS) -> DataFrame:
    """Statements each chunk takes: one per row, one per ``limit`` rows, or one array statement."""
    rows = F.count(F.lit(1))
    needed = {"singleton": rows, "batch": int_div(rows + (limit - 1), limit), "array": F.lit(1).cast("bigint")}[method]
    return df.groupBy(chunk).agg(rows.alias("n_rows"), needed.alias("n_statements"))


def update_counts(df: DataFrame, status: str, chunk: str = "chunk_id") -> DataFrame:
    """Rows affected per chunk: the reported counts, or the chunk's size when nothing was reported.

    Negative codes mean failed or no information.
    """
    reported = F.sum(F.when(F.col(status) >= 0, F.col(status)).otherwise(0))
    return df.groupBy(chunk).agg(
        F.when(reported > 0, reported).otherwise(F.count(F.lit(1))).cast("bigint").alias("n_updated")
    )
