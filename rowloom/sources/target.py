"""A keyed table on plain files: immutable segments in hash buckets of the key, named by a commit log.

Each commit writes its files first and then one entry of the log, so a failed write is never
visible, a repeated batch id is recognised, and of two writers the slower one sees that it has
to look again. Beside a segment lies its index: for each bucket a Bloom filter of the keys as
rows of bitmaps (each key has all its bits in one), with the smallest and largest key of each. ``touched`` finds the few
buckets of the few segments that may hold keys of a batch, as a join of the batch's keys with
the bitmaps; only their files are opened.

An upsert writes its rows as a new segment, and the keys it found in older files as a list of
deletions for just those files. Readers take files without deletions as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowloom.sources.log import CommitConflict, CommitLog

SEGMENT_VERSION = r"/segment-(\d+)-[0-9a-f]{32}/"
BUCKETS = 8
BITS_PER_KEY, PROBES = 12, 3  # a key not in a bucket passes its filter about once in a hundred times
SLICE_BITS = 32768  # bits of one bitmap of bitmap_construct_agg
SENT_BITMAPS = 2048  # so many bitmaps of 4 KB at most are sent to all tasks


def _after(state: dict, commit: dict) -> dict:
    segments = [] if commit["kind"] == "replace" else state["segments"]
    deletes = [] if commit["kind"] == "replace" else state["deletes"]
    ranges = [list(r) for r in state["batches"]]
    batch = commit["batch_id"]
    if batch is not None:
        if ranges and ranges[-1][1] == batch - 1:
            ranges[-1][1] = batch
        else:
            ranges.append([batch, batch])
    return {
        "version": commit["version"], "batches": ranges,
        "segments": segments + ([commit["segment"]] if commit["segment"] else []),
        "deletes": deletes + ([commit["deletes"]] if commit["deletes"] else []),
    }


@dataclass(frozen=True)
class Snapshot:
    """The table at one moment. Segments and deletions are entries of the log, as many as commits since the last compaction."""

    at: int
    version: int
    segments: tuple[dict, ...]
    deletes: tuple[dict, ...]
    batches: tuple[tuple[int, int], ...]

    @property
    def batch_ids(self) -> frozenset[int]:
        return frozenset(b for low, high in self.batches for b in range(low, high + 1))

    def has_batch(self, batch_id: int | None) -> bool:
        return batch_id is not None and any(low <= batch_id <= high for low, high in self.batches)


@dataclass(frozen=True)
class FileTarget:
    spark: SparkSession
    path: str
    schema: StructType
    key: tuple[str, ...]
    buckets: int = BUCKETS

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], buckets: int = BUCKETS) -> FileTarget:
        """A new, empty target. ``buckets`` should grow with the table; a bucket of a segment is what a lookup opens."""
        target = cls(spark, path.rstrip("/"), schema, tuple(key), buckets)
        target._log.commit(-1, {"version": 0, "kind": "replace", "segment": None, "deletes": None, "batch_id": None})
        return target

    @property
    def _log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/log", {"version": 0, "segments": [], "deletes": [], "batches": []}, _after)

    def snapshot(self) -> Snapshot:
        at, state = self._log.state()
        return Snapshot(at, state["version"], tuple(state["segments"]), tuple(state["deletes"]), tuple(tuple(r) for r in state["batches"]))

    # -- reading ---------------------------------------------------------------------------

    def _files(self, paths: Sequence[str], schema: StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{p}" for p in paths])

    def _key_schema(self) -> StructType:
        return StructType([self.schema[k] for k in self.key])

    def keys(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Every key in the table, some more than once; nothing has to be resolved for that."""
        snapshot = snapshot or self.snapshot()
        return self._files([s["name"] for s in snapshot.segments]).select(*self.key)

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The rows; only files that a later upsert found keys in are held against its deletions."""
        snapshot = snapshot or self.snapshot()
        marked = {(f["segment"], b) for d in snapshot.deletes for f in d["files"] for b in f["buckets"]}
        clean, changed = [], []
        for s in snapshot.segments:
            hit = [b for b in s["buckets"] if (s["name"], b) in marked]
            if not hit:
                clean.append(s["name"])
                continue
            changed += [f"{s['name']}/_bucket={b}" for b in hit]
            clean += [f"{s['name']}/_bucket={b}" for b in s["buckets"] if b not in hit]
        plain = self._files(clean)
        if not changed:
            return plain
        version = lambda c: F.regexp_extract(c, SEGMENT_VERSION.replace("segment", "(?:segment|deletes)"), 1).cast("bigint")
        rows = self._files(changed).withColumn("_version", version(F.col("_metadata.file_path")))
        gone = self._files([d["name"] for d in snapshot.deletes], self._key_schema()).withColumn("_gone", version(F.col("_metadata.file_path")))
        gone = gone.groupBy(*self.key).agg(F.max("_gone").alias("_gone"))
        match = F.col("r._version") < F.col("g._gone")
        for k in self.key:
            match = match & (F.col(f"r.`{k}`") == F.col(f"g.`{k}`"))
        left = rows.alias("r").join(gone.alias("g"), match, "left_anti")
        return plain.unionByName(left.select(*self.schema.fieldNames()))

    # -- key index --------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _spots(self, keys: DataFrame, slices: Column) -> DataFrame:
        """The bitmap (slice of the bucket) that holds a key, and the bits its probes look at there."""
        bits = F.array(*[F.pmod(F.xxhash64(F.lit(n), *self.key), F.lit(SLICE_BITS)).cast("bigint") for n in range(PROBES)])
        slice_ = F.pmod(F.xxhash64(F.lit("slice"), *self.key), slices).cast("int")
        return keys.select(*self.key, self._bucket().alias("_bucket"), slices.alias("_slices"), slice_.alias("_slice"), bits.alias("_bits"))

    def _write_index(self, segment: str, rows: int) -> int:
        """Write the key filters of a segment; returns into how many bitmaps each bucket is spread."""
        slices = max(1, -(-rows * BITS_PER_KEY // (self.buckets * SLICE_BITS)))
        spots = self._spots(self._files([segment]).select(*self.key), F.lit(slices).cast("bigint"))
        filters = spots.withColumn("_bit", F.explode("_bits")).groupBy("_slices", "_bucket", "_slice").agg(
            F.bitmap_construct_agg("_bit").alias("bitmap"), F.min(F.struct(*self.key)).alias("low"), F.max(F.struct(*self.key)).alias("high")
        )
        filters.write.parquet(f"{self.path}/index-{segment}")
        return slices

    def touched(self, keys: DataFrame, snapshot: Snapshot | None = None) -> list[tuple[str, int]]:
        """(segment, bucket) of all files that may hold one of ``keys``: all that do, and about one file in a hundred by mistake for every key."""
        snapshot = snapshot or self.snapshot()
        if not snapshot.segments:
            return []
        index = self.spark.read.parquet(*[f"{self.path}/index-{s['name']}" for s in snapshot.segments])
        index = index.withColumn("_segment", F.regexp_extract(F.col("_metadata.file_path"), r"/index-(segment-\d+-[0-9a-f]{32})/", 1))
        if sum(s["slices"] * len(s["buckets"]) for s in snapshot.segments) <= SENT_BITMAPS:
            index = F.broadcast(index)
        sizes = F.array(*[F.lit(n).cast("bigint") for n in sorted({s["slices"] for s in snapshot.segments})])  # segments of one size are asked at once
        asked = keys.select(*self.key).dropna(subset=list(self.key)).withColumn("_n", F.explode(sizes))
        met = self._spots(asked, F.col("_n")).join(index, ["_slices", "_bucket", "_slice"])
        own, hit = F.struct(*self.key), F.lit(True)
        for n in range(PROBES):
            bit = F.col("_bits")[n]
            byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.get(F.array(*[byte.bitwiseAND(1 << k) for k in range(8)]), (bit % 8).cast("int")) > 0)
        met = met.where((own >= F.col("low")) & (own <= F.col("high"))).where(hit)
        return sorted((r[0], r[1]) for r in met.select("_segment", "_bucket").distinct().collect())

    def known_keys(self, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        """Keys of the table as far as ``keys`` can be among them: only files that may hold one are opened."""
        snapshot = snapshot or self.snapshot()
        return self._files([f"{s}/_bucket={b}" for s, b in self.touched(keys, snapshot)]).select(*self.key)

    # -- writing ----------------------------------------------------------------------------

    def _commit(self, df: DataFrame, kind: str, batch_id: int | None, snapshot: Snapshot | None, old_keys: bool = False) -> None:
        snapshot = snapshot or self.snapshot()
        version = snapshot.version + 1
        name = f"segment-{version}-{uuid.uuid4().hex}"
        seen = Observation()
        rows = df.select(*self.schema.fieldNames()).withColumn("_bucket", self._bucket())
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.xxhash64(F.lit("file"), *self.key), F.lit(max(1, parts // self.buckets)))  # large buckets are written by several tasks
        rows.observe(seen, F.count(F.lit(1)).alias("n")).repartition("_bucket", spread).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        segment = deletes = None
        if seen.get["n"]:
            segment = {"name": name, "buckets": self._written_buckets(name), "slices": self._write_index(name, seen.get["n"])}
            if old_keys:
                deletes = self._write_deletes(name, version, snapshot)
        entry = {"version": version, "kind": kind, "segment": segment, "deletes": deletes, "batch_id": batch_id}
        if not self._log.commit(snapshot.at, entry):
            raise CommitConflict(f"{self.path}: version {version} was written by another writer")

    def _written_buckets(self, segment: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{segment}")
        names = [s.getPath().getName() for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        return sorted(int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket="))

    def _write_deletes(self, segment: str, version: int, snapshot: Snapshot) -> dict | None:
        """The keys of the new segment that older files hold."""
        own = self._files([segment]).select(*self.key)
        files = self.touched(own, snapshot)
        if not files:
            return None
        old = self._files([f"{s}/_bucket={b}" for s, b in files]).select(*self.key)
        name = f"deletes-{version}-{uuid.uuid4().hex}"
        old.join(own, list(self.key), "left_semi").distinct().write.parquet(f"{self.path}/{name}")
        segments = sorted({s for s, _ in files})
        return {"name": name, "files": [{"segment": s, "buckets": [b for t, b in files if t == s]} for s in segments]}

    def append(self, df: DataFrame, batch_id: int | None = None, snapshot: Snapshot | None = None) -> None:
        """Add rows with keys the table does not have."""
        self._commit(df, "append", batch_id, snapshot)

    def upsert(self, df: DataFrame, batch_id: int | None = None, snapshot: Snapshot | None = None) -> None:
        """Add rows that replace those of the same key; one row per key."""
        self._commit(df, "upsert", batch_id, snapshot, old_keys=True)

    def replace(self, df: DataFrame, batch_id: int | None = None, snapshot: Snapshot | None = None) -> None:
        self._commit(df, "replace", batch_id, snapshot)

    def compact(self) -> None:
        """Write the resolved table as one segment."""
        snapshot = self.snapshot()
        if snapshot.deletes or len(snapshot.segments) > 1:
            self.replace(self.read(snapshot), None, snapshot)
