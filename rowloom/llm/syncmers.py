"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest hash among its inner s-mers is
that of its first or its last one. Whether a k-mer is chosen depends on the k-mer alone, so
a passage has the same anchors wherever it stands. Texts are compared by the 32-bit hashes of
all their distinct anchors. Of these a printed fingerprint has the ANCHORS smallest, ascending,
eight hex digits each: a sketch. ``document_anchors`` gives all anchors with their positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.texts import CHARS_AT_ONCE, code_points

K, S = 24, 8
ANCHORS = 64
PART_ROWS = 1000  # documents of neighbouring ids that are put in order together, on average
MAX_PARTS = 1 << 14  # the bounds of the parts go to all tasks

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_hash(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n code points; n is a power of two times 1 or 3."""
    h, width = mix(points.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)), 1
    while width < n:
        step = 2 if n % (2 * width) == 0 and n // width != 3 else 3
        joined = h[: len(h) - (step - 1) * width] * np.uint64(0xD6E8FEB86659FD93)
        for k in range(1, step):
            joined = joined * np.uint64(3) + h[k * width:len(h) - (step - 1 - k) * width] * np.uint64(2 * k + 5)
        h, width = mix(joined), width * step
    return h


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text."""
    if len(points) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = window_hash(points, s)
    span, low, width = k - s + 1, inner, 1
    while width < span:
        step = min(width, span - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    last = inner[span - 1:]
    at = np.flatnonzero((low == inner[: len(low)]) | (low == last))
    whole = window_hash(points, k)
    return at, whole[at]


def placed_anchors(points: np.ndarray, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and 32-bit hashes of all anchors, piece by piece. A text without anchors is one as a whole; an empty one has none."""
    none = True
    for at in range(0, len(points) - k + 1, CHARS_AT_ONCE):
        where, found = anchors(points[at:at + CHARS_AT_ONCE + k - 1], k)
        none = none and not len(where)
        yield where + at, (mix(found) >> np.uint64(32)).astype(np.uint32)
    if none and len(points):
        yield np.zeros(1, np.int64), np.array([int.from_bytes(sha256(points.tobytes()).digest()[:4])], np.uint32)


def fingerprint(points: np.ndarray, k: int = K) -> np.ndarray:
    """All distinct 32-bit anchor hashes of a text, ascending."""
    found = [np.unique(hashes) for _, hashes in placed_anchors(points, k)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the two texts' distinct anchors that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = len(np.union1d(a, b))
    return (len(a) + len(b) - union) / union


def text_of(mark: np.ndarray) -> str:
    return mark[:ANCHORS].astype(">u4").tobytes().hex()


def document_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, hash) of every anchor of every text, positions in code points from 0; for matching passages by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for where, hashes in placed_anchors(code_points(text.as_py() or "")):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(where), pa.int64()), pa.array(where, pa.int64()), pa.array(hashes.astype(np.int64))],
                        ["doc_id", "position", "hash"],
                    )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, position long, hash long")


def in_order(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(part, copy, doc_id, text): parts of neighbouring ids, each with a copy of what follows its last row.

    Only the bounds of the parts and their first ids come to the driver. Null ids come first.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    parts = min(MAX_PARTS, max(1, n // part_rows))
    bounds = [] if parts == 1 else ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts))
    bounds = sorted({int(b) for b in bounds})
    low = np.array(bounds, dtype=np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0)
            part = np.searchsorted(low, at.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), at, batch.column(1)], ["part", "doc_id", "text"])

    placed = docs.mapInArrow(number, "part int, doc_id long, text string")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    firsts = ids.mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(low, b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)), b.column(0)],
                ["part", "doc_id"],
            )
            for b in batches
        ),
        "part int, doc_id long",
    ).groupBy("part").agg(F.min(key).alias("first"))
    firsts = sorted((r["part"], r["first"]) for r in firsts.collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the last part goes on with the first
    rows = [(first, part) for first, part in before.items()]
    heads = docs.sparkSession.createDataFrame(rows, "first long, before int")
    copies = docs.join(F.broadcast(heads), key == F.col("first")).select(
        F.col("before").alias("part"), F.lit(1).alias("copy"), "doc_id", "text"
    )
    count = max(1, min(len(firsts), 4096))
    all_rows = placed.select("part", F.lit(0).alias("copy"), "doc_id", "text").union(copies)
    return all_rows.repartition(count, "part").sortWithinPartitions("part", "copy", "doc_id", "text")


def document_fingerprints(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the second half gives way to the next document's start.

    The next document is the one after in ascending order of doc_id (then text), after the last
    the first; a document alone is its own next. Null texts are empty, null ids come first.
    Repeated rows follow each other. Likenesses are between 0 and 1, 1 for two empty texts.
    No rows in, no rows out. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, code points and fingerprint of the row whose next one is awaited
        for batch in batches:
            rows = []
            for part, copy, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if copy and (held is None or held[0] != part):
                    continue  # the part's last row has its next one already
                points = code_points(text)
                mark = fingerprint(points)
                if held is not None and held[0] == part:
                    rows.append(compare(held, points, mark))
                held = None if copy else (part, doc, points, mark)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2])],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return in_order(docs, part_rows).mapInArrow(run, SCHEMA)


def compare(held: tuple, following: np.ndarray, mark: np.ndarray) -> tuple:
    _, doc, points, own = held
    n = len(points)
    edited = np.concatenate((points[: n - n // 2], following[: n // 2]))
    changed = fingerprint(edited)
    text = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return (
        doc, n, sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(changed),
        likeness(own, changed), likeness(own, mark),
    )
