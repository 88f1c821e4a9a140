"""Hard negatives by angular triangle filtering.

With every vector its norm and its angles to a few reference directions are stored. For an
anchor at angle p and a vector at angle x to the same reference, the angle between the two is
at least |p - x| and at most p + x (and 2 pi - p - x); the tightest of all references gives an
interval of the cosine, and times both norms, rounded to the safe side, one of the score.
Vectors are stored in blocks of one label and neighbouring angles, with the range of angles and
norms of the block, so the same inequality holds for a whole block. Only blocks (windows)
whose interval overlaps the scores that are still asked for get integer inner products.

Anchors are a stated query set. They go to the tasks in batches of at most BATCH anchors, and
every batch reads the stored blocks without a shuffle; a task returns at most the asked number
of rows for each anchor (and positive), which are then merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import keep
from rowloom.operators.row_index import with_row_index

SEED = 17
REFERENCES = 8
SCALE = 256
BLOCK = 256  # most vectors of one stored block
BATCH = 4096  # most anchors that are sent to the tasks at once
EXACT = 1 << 53  # below this inner products in double precision are exact integers
SLACK = 1e-6  # share of both norms by which bounds are widened against rounding
LONG = (1 << 63) - 1

BLOCKS = "label long, dim int, ids binary, vectors binary, norms binary, low binary, high binary"


def references(dim: int) -> np.ndarray:
    found = np.random.default_rng([SEED, dim]).normal(size=(REFERENCES, dim))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def angles(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Angle of each vector to each reference; right angles for zero vectors."""
    top = np.abs(vectors).max(axis=1, keepdims=True, initial=1.0)
    small = vectors / top
    size = np.linalg.norm(small, axis=1, keepdims=True)
    return np.arccos(np.clip(small @ references(vectors.shape[1]).T / np.where(size == 0, 1, size), -1, 1))


def norms_of(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True, initial=1.0)
    return np.linalg.norm(vectors / top, axis=1) * top[:, 0]


def score_bounds(anchor_angles, anchor_norms, low, high, least_norm, most_norm) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of every anchor's score with any vector of a block."""
    near = np.maximum(np.maximum(low - anchor_angles, anchor_angles - high), 0).max(axis=1)
    far = np.minimum(anchor_angles + high, 2 * math.pi - anchor_angles - low).min(axis=1)
    upper, lower = np.cos(near), np.cos(np.minimum(far, math.pi))
    slack = SLACK * anchor_norms * most_norm + 1
    return (
        anchor_norms * lower * np.where(lower < 0, most_norm, least_norm) - slack,
        anchor_norms * upper * np.where(upper < 0, least_norm, most_norm) + slack,
    )


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond exact doubles in integers of any size, held to 64 bits."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
        return np.clip(whole, -LONG - 1, LONG).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(id, label, dim, vector): rows that take part, components times 256, not yet rounded down."""
    finite = F.forall("v", lambda x: x.isNotNull() & (x < float("inf")) & (x > float("-inf")))  # NaN is above infinity
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("label is not null and v is not null and size(v) > 0").where(finite)
    return rows.select("id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: x * SCALE).alias("vector"))


def stored_blocks(rows: DataFrame) -> DataFrame:
    """The vectors of ``rows`` (id, label, dim, vector) in blocks, stored."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in set(batch.column(2).to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column(2), dim))
                matrix = np.floor(np.asarray(part.column(3).flatten()).reshape(-1, dim))
                theta = angles(matrix, norms_of(matrix))
                nearest = theta.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(nearest, pa.int32()),
                     pa.array(theta[np.arange(len(theta)), nearest]), pa.array([r.tobytes() for r in matrix], pa.binary())],
                    ["id", "label", "dim", "nearest", "angle", "vector"],
                )

    order = ["dim", "label", "nearest", "angle", "id"]
    placed = rows.mapInArrow(place, "id long, label long, dim int, nearest int, angle double, vector binary")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "dim", "vector")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            _, label, dim, _ = held[0]
            matrix = np.frombuffer(b"".join(h[3] for h in held), np.float64).reshape(-1, dim)
            norms = norms_of(matrix)
            theta = angles(matrix, norms)
            ids = np.array([LONG if h[0] is None else h[0] for h in held], np.int64)
            columns = [ids, matrix, norms, theta.min(axis=0), theta.max(axis=0)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([label], pa.int64()), pa.array([dim], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
                ["label", "dim", "ids", "vectors", "norms", "low", "high"],
            )

        before = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row == before:  # repeated rows have come next to each other
                    continue
                before = row
                if held and (len(held) == BLOCK or held[0][1:3] != row[1:3]):
                    yield packed()
                held.append(row)
        if held:
            yield packed()

    return keep(dealt.mapInArrow(block, BLOCKS), "vector_blocks")


class Best:
    """The best ``k`` rows of each of ``n`` slots so far: highest score, then smallest id."""

    def __init__(self, n: int, k: int):
        self.k, self.slots, self.ids, self.scores, self.held = k, [], [], [], 0
        self.floor = np.full(n, -LONG - 1, np.int64)  # rows below are not needed any more

    def add(self, slots: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        self.slots.append(slots)
        self.ids.append(ids)
        self.scores.append(found)
        self.held += len(slots)
        if self.held > 64 * len(self.floor) + (1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.empty(0, np.int64),) * 3
        slots, ids, found = (np.concatenate(x) for x in (self.slots, self.ids, self.scores))
        order = np.lexsort((ids, ~found, slots))  # ~ turns the order of all 64-bit integers
        slots, ids, found = slots[order], ids[order], found[order]
        rank = np.arange(len(slots)) - np.searchsorted(slots, slots)
        last = rank == self.k - 1
        self.floor[slots[last]] = found[last]
        slots, ids, found = (x[rank < self.k] for x in (slots, ids, found))
        self.slots, self.ids, self.scores, self.held = [slots], [ids], [found], len(slots)
        return slots, ids, found


def _stored(batch: pa.RecordBatch, k: int) -> tuple:
    label, dim = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
    ids = np.frombuffer(batch.column(2)[k].as_buffer(), np.int64)
    arrays = [np.frombuffer(batch.column(c)[k].as_buffer(), np.float64) for c in range(3, 7)]
    return label, dim, ids, arrays[0].reshape(-1, dim), *arrays[1:]


def nearest_of_label(blocks: DataFrame, anchors: dict, k: int) -> DataFrame:
    """(anchor, id, score): per task the best ``k`` other vectors of each anchor's label."""
    ids, labels, vectors = anchors["ids"], anchors["labels"], anchors["vectors"]
    norms = norms_of(vectors)
    theta = angles(vectors, norms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            for n in range(batch.num_rows):
                label, dim, other, matrix, size, low, high = _stored(batch, n)
                mine = np.flatnonzero(labels == label) if dim == vectors.shape[1] else []
                if not len(mine):
                    continue
                _, upper = score_bounds(theta[mine], norms[mine], low, high, size.min(), size.max())
                mine = mine[upper >= best.floor[mine]]
                if not len(mine):
                    continue
                found = scores(vectors[mine], matrix)
                i, j = np.nonzero((found >= best.floor[mine, None]) & (other[None, :] != ids[mine, None]))
                best.add(mine[i], other[j], found[i, j])
                best.cut()
        slots, near, found = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(ids[slots]), pa.array(labels[slots]), pa.array(near), pa.array(found)], ["anchor", "label", "id", "score"])

    return blocks.mapInArrow(search, "anchor long, label long, id long, score long")


def negatives_in_windows(blocks: DataFrame, anchors: dict, positives: dict, k: int, low_share: int, high_share: int) -> DataFrame:
    """(slot, id, score): per task the best ``k`` of other labels inside each positive's window of scores.

    A positive's window is ``low_share`` to ``high_share`` hundredths of its score.
    """
    ids, labels, vectors = anchors["ids"], anchors["labels"], anchors["vectors"]
    norms = norms_of(vectors)
    theta = angles(vectors, norms)
    owner, good = positives["anchor"], positives["score"]
    floor = np.array([-(-low_share * int(s) // 100) for s in good], object)
    ceiling = np.array([high_share * int(s) // 100 for s in good], object)
    floor, ceiling = (np.clip(x, -LONG - 1, LONG).astype(np.int64) if len(x) else np.empty(0, np.int64) for x in (floor, ceiling))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(owner), k)
        for batch in batches:
            for n in range(batch.num_rows):
                label, dim, other, matrix, size, low, high = _stored(batch, n)
                if dim != vectors.shape[1]:
                    continue
                lower, upper = score_bounds(theta, norms, low, high, size.min(), size.max())
                least = np.maximum(floor, best.floor)
                live = np.flatnonzero((labels[owner] != label) & (least <= ceiling) & (upper[owner] >= least) & (lower[owner] <= ceiling))
                if not len(live):
                    continue
                who, place = np.unique(owner[live], return_inverse=True)
                found = scores(vectors[who], matrix)
                for at in range(0, len(live), 1024):
                    part, mine = live[at:at + 1024], found[place[at:at + 1024]]
                    i, j = np.nonzero((mine >= least[part, None]) & (mine <= ceiling[part, None]))
                    best.add(part[i], other[j], mine[i, j])
                best.cut()
        slots, near, found = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(near), pa.array(found)], ["slot", "id", "score"])

    return blocks.mapInArrow(search, "slot long, id long, score long")


def first_rows(df: DataFrame, key: list[str], k: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.asc("id"))))
    return ranked.where(F.col("rank") <= k)


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, low_share: int = 80, high_share: int = 100, batch: int = BATCH
) -> DataFrame:
    """Hard negatives of the rows of (vec_id, embedding, label) that the SQL condition ``anchor`` names.

    Components count as floor(256 x), scores are integer inner products, higher first, ties by
    the smaller id. An anchor's positives are its first rows of the same label with another id,
    a positive's negatives its first rows of other labels whose score is within
    ``low_share`` to ``high_share`` hundredths of the positive's. Rows with a null label, a null or empty
    vector or a null or non-finite component take no part. Vectors of unequal length never meet.
    Rows with the same id, label and vector are one; an id with several labels or vectors is an anchor for
    each of them. Null ids come last among ties, as an id of 2^63 - 1. Scores beyond 64 bits are
    held to their ends. No rows in, no rows out; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors)
    blocks = stored_blocks(rows)
    asked = rows.where(F.expr(anchor.replace("vec_id", "id"))).where("id is not null").distinct()
    asked = keep(with_row_index(asked, ["dim", "label", "id", "vector"], "place"), "anchors")
    sizes = {r["dim"]: (r["low"], r["high"]) for r in asked.groupBy("dim").agg(F.min("place").alias("low"), F.max("place").alias("high")).collect()}
    found = spark.createDataFrame([], FOUND)
    for dim, (low, high) in sorted(sizes.items()):
        for start in range(low, high + 1, batch):
            some = asked.where(F.col("place").between(start, min(start + batch - 1, high))).orderBy("place").toPandas()
            own = {"ids": some["id"].to_numpy(np.int64), "labels": some["label"].to_numpy(np.int64),
                   "vectors": np.floor(np.array(some["vector"].tolist(), np.float64)).reshape(len(some), dim)}
            near = keep(first_rows(nearest_of_label(blocks, own, positives), ["anchor", "label"], positives), "positives").toPandas()
            at = {(a, b): n for n, (a, b) in enumerate(zip(own["ids"].tolist(), own["labels"].tolist()))}
            slots = {"anchor": np.array([at[a, b] for a, b in zip(near["anchor"].tolist(), near["label"].tolist())], np.int64), "score": near["score"].to_numpy(np.int64)}
            windows = spark.createDataFrame(
                [(n, *r) for n, r in enumerate(zip(near["anchor"].tolist(), near["id"].tolist(), near["score"].tolist()))],
                "slot long, anchor_id long, positive_id long, positive_score long",
            )
            hits = negatives_in_windows(blocks, own, slots, negatives, low_share, high_share)
            hits = first_rows(hits, ["slot"], negatives).join(F.broadcast(windows), "slot")
            found = found.union(keep(hits.select(
                "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ), "negatives"))
    null_id = lambda c: F.when(F.col(c) != LONG, F.col(c)).alias(c)
    return found.select("anchor_id", null_id("positive_id"), "rank", null_id("negative_id"), "positive_score", "negative_score")
