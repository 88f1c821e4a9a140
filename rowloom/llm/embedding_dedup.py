"""Near-duplicate vectors by binary codes of randomised rotations, exact where the codes cannot tell.

A unit vector is turned by a random rotation; its code is the signs of the coordinates, and
its stored correction factor the inner product of the vector and its code. From the code of
one vector and the turned other one follows an unbiased estimate of their inner product with
a confidence bound. Only pairs whose upper bound reaches the threshold are computed exactly.

Which pairs meet at all is decided by short stretches of code bits: vectors of one label that
agree in all bits of a stretch share a bucket. Two vectors at the threshold differ in a bit
with probability angle / pi, so the number of stretches follows from the recall asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import keep, linked_groups

SEED = 11
BUCKET_ROWS = 512  # vectors in a bucket, on average
BLOCK_ROWS = 2048  # a larger bucket is compared in blocks of so many
MISSED = 0.001  # chance that a pair at the threshold shares no bucket
BOUND = 4.0  # standard deviations between estimate and bound
ROWS_AT_ONCE = 512

CLASS = "label string, dim int, digest string, id long, copies long, vector binary"
DEALT = "label string, dim int, stretch int, bucket long, id long, copies long, vector binary"


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of ``dim`` dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def stretches(rows: int, threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """(bits, number) of the stretches for so many vectors of a label."""
    bits = min(62, max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if together == 1 else math.ceil(math.log(missed) / math.log(1 - together))


def buckets(unit: np.ndarray, bits: int, number: int) -> np.ndarray:
    """Bucket of each vector in each stretch; a stretch takes the next unused signs, of further rotations as needed."""
    dim = unit.shape[1]
    signs = np.concatenate([unit @ rotation(dim, k) >= 0 for k in range(-(-bits * number // dim) or 1)], axis=1)
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)
    return np.stack([signs[:, t * bits:(t + 1) * bits] @ powers for t in range(number)], axis=1).astype(np.int64).reshape(len(unit), number)


def units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # norms of huge or tiny values neither overflow nor vanish
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def block_links(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with cosine at or above ``threshold``: codes first, then exactly."""
    dim = a.shape[1]
    turn = rotation(dim, 0)
    turned_a, turned_b = a @ turn, b @ turn
    correction = np.abs(turned_a).sum(axis=1) / math.sqrt(dim)
    slack = BOUND * np.sqrt(np.maximum(1 - correction**2, 0)) / correction / math.sqrt(max(dim - 1, 1)) + 1e-9
    code = np.where(turned_a >= 0, 1.0, -1.0) / math.sqrt(dim)
    for at in range(0, len(a), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        estimate = (code[part] @ turned_b.T) / correction[part, None]
        i, j = np.nonzero(estimate + slack[part, None] >= threshold)
        exact = np.einsum("ij,ij->i", a[i + at], b[j]) >= threshold
        yield i[exact] + at, j[exact]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, missed: float = MISSED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine, in double precision, is at
    least ``threshold``. Null labels, null, empty and zero vectors and such with null or
    non-finite components link with nothing. ``n_links`` counts the other rows linked
    directly, equal vectors included. Vectors of different lengths never link. Rows with the
    same id count as one node of the graph. Null ids are counted but name no component.
    No rows in, no rows out; further columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = np.dtype("<f4" if isinstance(element, T.FloatType) else "<f8")
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"),
        F.col("embedding").cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("embedding"),
    )
    usable = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(x, dtype=kind) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in data], pa.int32()), pa.array([(x + kind.type(0)).tobytes() for x in data])],
                ["vec_id", "label", "dim", "vector"],
            )

    members = rows.where(usable).mapInArrow(packed, "vec_id long, label string, dim int, vector binary")
    members = members.withColumn("digest", F.sha2("vector", 256))
    classes = members.groupBy("label", "dim", "digest").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    classes = keep(classes.where("id is not null").select("label", "dim", "digest", "id", "copies", "vector"), "vectors")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, number = stretches(largest, threshold, missed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                own = buckets(units(matrix(part.column(4), dim)), bits, number)
                for t in range(number):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(np.full(len(at), t, np.int32)), pa.array(own[:, t]), *part.columns[2:]],
                        ["label", "dim", "stretch", "bucket", "id", "copies", "vector"],
                    )

    def matrix(column, dim: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)

    dealt = classes.select("label", "dim", "id", "copies", "vector").mapInArrow(deal, DEALT)
    place = ["label", "dim", "stretch", "bucket"]
    # a bucket beyond BLOCK_ROWS is split, and every pair of its blocks is a group of its own
    large = dealt.groupBy(*place).count().where(F.col("count") > BLOCK_ROWS)
    large = keep(large.select(*place, F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "large")
    split = dealt.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def link(key: tuple, group: pa.Table) -> pa.Table:
        _, dim, stretch, _, low, high = (k.as_py() for k in key)
        block, ids, copies = (np.asarray(group[c]) for c in ("block", "id", "copies"))
        unit = units(matrix(group["vector"], dim))
        own = buckets(unit, bits, number)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        counts, up, edges = np.zeros(len(ids), np.int64), {}, []

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for i, j in block_links(unit[left], unit[right], threshold):
            i, j = left[i], right[j]
            fresh = i < j if low == high else np.ones(len(i), bool)
            # a pair that shares an earlier bucket is counted there
            fresh &= ~(own[i, :stretch] == own[j, :stretch]).any(axis=1)
            i, j = i[fresh], j[fresh]
            counts += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            for x, y in zip(i.tolist(), j.tolist()):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    edges.append((x, y))
        hit = np.flatnonzero(counts)
        a = np.concatenate((ids[hit], ids[[x for x, _ in edges]] if edges else ids[:0]))
        b = [None] * len(hit) + [int(ids[y]) for _, y in edges]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(np.append(counts[hit], np.zeros(len(edges), np.int64)), pa.int64())})

    columns = [*place, "low", "high", "block", "id", "copies", "vector"]
    found = keep(split.select(columns).groupBy(*place, "low", "high").applyInArrow(link, "a long, b long, n long"), "links")
    linked = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = linked_groups(found.where("b is not null")).withColumnRenamed("node", "id")
    classes = classes.select("label", "dim", "digest", "id", "copies").join(linked, "id", "left").join(groups, "id", "left")
    classes = keep(classes.select(
        "label", "dim", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    ), "classes")
    good = members.select("vec_id", "label", "dim", "digest").join(classes, ["label", "dim", "digest"], "left")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return good.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id").union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
