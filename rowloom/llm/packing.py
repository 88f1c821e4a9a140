"""Packing of tokenised documents into sequences of bounded length by sum of squares.

A document goes to the open sequence (or a new one) for which the sum, over all residual
gaps, of the squared number of open sequences with that gap becomes smallest. That keeps
gaps of many sizes at hand, so that later documents find one they fill.

Documents are dealt at random into shards of bounded size, each packed by one task. Within
a shard they come in random order, but for the shortest, which come last, longest first, and
close the gaps that are left. The tail of a shard's open sequences is what sharding costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import keep
from rowloom.llm.tokens import WordIds

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 1 << 15  # pieces that one task packs, on average
CLOSING = 0.1  # share of a shard's pieces, the shortest, that come last

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The documents' pieces of at most ``capacity`` ids, each document ended by id 1.

    Null texts count as empty; every document has a piece. ``with_ids`` adds the ids
    themselves as little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer_path), np.uint32(END_ID).tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, crc32(part), part if with_ids else None))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(kinds)])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of items packed in the given order; no length may exceed ``capacity``."""
    gaps = np.zeros(capacity + 1, np.int64)  # open bins by residual gap; full bins do not count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        # change of the sum of squares: one bin of gap g becomes one of gap g - size
        here = gaps[size:]
        after = gaps[: capacity + 1 - size].copy()
        change = np.where(here > 0, 2 * (after - here) + 2, far)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]
        g = int(change.argmin()) + size
        fresh = 2 * gaps[capacity - size] + 1 if size < capacity else 0
        if change[g - size] <= fresh:
            b = open_bins[g].pop()
            gaps[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        bins[k], offsets[k] = b, capacity - g
        if g > size:
            gaps[g - size] += 1
            open_bins[g - size].append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with the sequence each is placed in and where. Sequences are filled gaplessly from 0."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    names = [f.name for f in pieces.schema.fields]

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values(["length", "place", "doc_id", "piece"], ascending=[False, True, True, True])
        early = len(group) - int(len(group) * CLOSING)
        group = pd.concat([group[:early].sort_values(["place", "doc_id", "piece"]), group[early:]])
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        return group[names].assign(sequence_id=bins + (shard << 32), offset=offsets)

    place_of = F.xxhash64("doc_id", "piece", "ids_crc32")
    sharded = pieces.withColumn("place", place_of).withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return sharded.groupBy("shard").applyInPandas(fill, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Tokenise (doc_id, text) and pack: one row per piece, columns as PACKED.

    Only documents longer than ``capacity`` are cut. Null texts are empty documents of one
    id. Repeated rows are documents of their own; a null id stays null. No rows in, no rows
    out. Further columns are ignored.
    """
    return pack(keep(tokenise(docs, tokenizer_path, capacity), "pieces"), capacity, shard_pieces)
