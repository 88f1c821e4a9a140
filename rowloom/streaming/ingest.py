"""Structured Streaming into a keyed target, and streams of generated rows."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rowloom.operators.ingest import ingest
from rowloom.plans.columns import ROW
from rowloom.plans.generate import project, visible
from rowloom.plans.spec import TableSpec
from rowloom.sources.target import FileTarget

PROGRESS = "batch_id bigint, rows bigint, millis bigint"


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int, format: str = "parquet", **options) -> DataFrame:
    """Files as a stream; the file limit is the back-pressure."""
    return spark.readStream.schema(schema).format(format).options(maxFilesPerTrigger=files_per_batch, **options).load(path)


def stream_ingest(
    stream: DataFrame, target: FileTarget, order_by: Sequence[str], mode: str, checkpoint: str
) -> StreamingQuery:
    """Apply every micro-batch to the target until the available input is used up.

    A batch repeated after a failure carries the same id and is skipped. Each batch leaves a
    line (id, rows, milliseconds) beside the checkpoint, however long the stream runs.
    """
    log = f"{checkpoint.rstrip('/')}-progress"

    def apply(batch: DataFrame, batch_id: int) -> None:
        start = time.monotonic()
        batch.persist()  # counted, checked and written: three passes over the source otherwise
        try:
            rows = batch.count()
            ingest(batch, target, order_by, mode, batch_id)
        finally:
            batch.unpersist()
        spent = int(1000 * (time.monotonic() - start))
        line = batch.sparkSession.createDataFrame([(batch_id, rows, spent)], PROGRESS)
        line.coalesce(1).write.mode("append").json(log)

    query = (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    query.progress_log = log
    return query


def generated_stream(spark: SparkSession, spec: TableSpec, rows_per_batch: int, partitions: int | None = None) -> DataFrame:
    """The spec's rows as an endless stream, numbered from 0."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
    rate = rate.option("numPartitions", partitions or spark.sparkContext.defaultParallelism)
    index = rate.load().select(F.col("value").alias(ROW))
    return visible(spec, project(spec, index))


def progress_frame(query: StreamingQuery) -> DataFrame:
    """Rows and duration of every micro-batch of a finished ingest; of a batch that was repeated, the last try."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    log = spark.read.schema(PROGRESS).json(query.progress_log)
    last = F.max_by(F.struct("rows", "millis"), F.struct("rows", "millis")).alias("last")
    return log.groupBy("batch_id").agg(last).select("batch_id", "last.rows", "last.millis")
