"""Token counts of documents through a cache keyed by content and tokenizer digests.

The cache is a Parquet folder (version, digest, n_tokens). A run looks its documents up,
encodes each text that is missing once, appends the new counts and reads all counts from
the cache. Texts are matched byte for byte, null as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.tokens import ByteLevelCounts, version
from rowloom.session import scratch_path

CACHE_SCHEMA = "version string, digest string, n_tokens long"


def read_cache(spark: SparkSession, path: str, tokenizer_version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty before the first write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "digest string, n_tokens long")
    found = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == tokenizer_version)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have added the same text


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of (doc_id, text), whole texts.

    ``tokenizer_path`` is a byte-level BPE file of ``tokenizers``, readable by the driver and
    all executors. Without ``cache_path`` the run begins with an empty cache of its own.
    Special strings in a text become the special token, as is the library's default; none
    are added. Null and empty texts have no bytes and no tokens. Repeated rows and null ids
    stay; further columns are ignored.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token_counts")
    name = version(tokenizer_path)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = docs.withColumn("digest", F.sha2("text", 256))

    # one document of each missing text; a text with very many copies arrives here as one row a task
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("first"))
    missing = missing.join(read_cache(spark, cache_path, name), "digest", "left_anti")
    k, m = keyed.alias("k"), missing.alias("m")
    chosen = k.join(m, (F.col("k.digest") == F.col("m.digest")) & F.col("k.doc_id").eqNullSafe(F.col("m.first")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = ByteLevelCounts(tokenizer_path)
        for batch in batches:
            n = [counts.count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(n), pa.string()), batch.column(0), pa.array(n, pa.int64())], ["version", "digest", "n_tokens"]
            )

    chosen.select("k.digest", "k.text").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = read_cache(spark, cache_path, name)
    counted = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(known, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens")
