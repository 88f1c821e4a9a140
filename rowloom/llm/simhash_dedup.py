"""Near-duplicate documents by SimHash fingerprints and a self-join over their binary trie.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
text's word shingles. Two fingerprints link when at most ``budget`` bits differ.

The trie of all distinct fingerprints is cut into nodes of bounded size. Every pair of
nodes whose prefixes differ in at most ``budget`` bits is one piece of work, done by one
of the two nodes' tasks: the pair is walked down together, differing bits add up, and a
pair of subtrees is left as soon as the budget is exceeded. Each task returns a spanning
forest of the links it found, so that a dense group gives no more rows than it has members.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import keep, linked_groups

SEED = 42
NODE_ROWS = 2048  # fingerprints in a node of the cut trie, on average
MAX_NODES_LOG2 = 14  # the cut has at most about this many nodes, whatever the input; beyond, nodes grow
SHINGLES_AT_ONCE = 1 << 16
FRONTIER = 1 << 20  # node pairs walked at once


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are those set in over half of ``n`` hashes."""
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a whole text; 0 for null or a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends, digest = ends[size - 1:].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(k, k + SHINGLES_AT_ONCE)
        ones += set_bits(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[part], ends[part])], dtype="<u8"))
    return majority(ones, len(starts))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted distinct fingerprints that differ in at most ``budget`` bits.

    ``b`` is None for the links inside ``a``, each then given once. The two tries are
    walked together as ranges of the sorted arrays; small range pairs are compared outright.
    """
    same, b = b is None, a if b is None else b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    zero = np.zeros(1, np.int64)
    stack = [(63, zero, zero + len(a), zero, zero + len(b), zero)]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        small = ((ah - al) * (bh - bl) <= 32) | (bit < 0)
        if small.any():
            l0, l1, r0, r1 = al[small], ah[small], bl[small], bh[small]
            wide = r1 - r0
            n = (l1 - l0) * wide
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = l0[which] + k // wide[which], r0[which] + k % wide[which]
            good = popcount(a[i] ^ b[j]) <= budget
            if same:
                good &= i < j
            found.append((i[good], j[good]))
            al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        one = np.uint64(1) << np.uint64(bit)
        above = ~((one << np.uint64(1)) - np.uint64(1)) if bit < 63 else np.uint64(0)
        am = np.clip(np.searchsorted(a, (a[al] & above) | one), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & above) | one), bl, bh)
        mirrored = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        steps = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, None),
                 (am, ah, bl, bm, err + 1, ~mirrored)]
        kept = [(l0 < l1) & (r0 < r1) & (e <= budget) & (True if m is None else m) for l0, l1, r0, r1, e, m in steps]
        nxt = [np.concatenate([s[x][k] for s, k in zip(steps, kept)]) for x in range(5)]
        for at in range(0, len(nxt[0]), FRONTIER):
            stack.append((bit - 1, *(x[at:at + FRONTIER] for x in nxt)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


class Forest:
    """Union-find that says whether a link joins two groups."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def cut_trie(fps: DataFrame, budget: int, node_rows: int = NODE_ROWS) -> tuple[np.ndarray, list[list[int]]]:
    """Where the nodes of the cut start, in ascending order, and for each node the nodes that work on it.

    The cut is even in depth, and deeper where a prefix holds more than four times its
    share. Only counts of prefixes come to the driver: at most one for each node.
    """
    n = fps.count()
    depth = min(max(0, (n // node_rows).bit_length()), MAX_NODES_LOG2)
    limit = 4 * max(node_rows, n >> depth)

    def prefix(bits: int):
        return F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")

    level, nodes = depth, defaultdict(list)
    counts = {int(p): int(c) for p, c in fps.groupBy(prefix(depth).alias("p")).count().collect()}
    open_nodes = {p for p, c in counts.items() if c > limit}
    for p in range(1 << depth):
        if p not in open_nodes:
            nodes[p].append((p, depth))
    while open_nodes:
        upper, level = level, min(64, level + 4)
        parts = fps.where(prefix(upper).isin(sorted(open_nodes))).groupBy(prefix(level).alias("p")).count()
        counts = {int(p) & (1 << level) - 1: int(c) for p, c in parts.collect()}
        deeper = {p for p, c in counts.items() if c > limit and level < 64}
        for p in counts:
            if p not in deeper:
                nodes[p >> (level - depth)].append((p, level))
        open_nodes = deeper
    for p in range(1 << depth):  # a refined prefix starts where its even node would
        nodes[p].sort(key=lambda x: x[0] << (64 - x[1]))
    cut = [x for p in range(1 << depth) for x in nodes[p]]
    place = {x: k for k, x in enumerate(cut)}
    masks = [sum(1 << b for b in bits) for r in range(budget + 1) for bits in combinations(range(depth), r)]
    workers: list[list[int]] = [[] for _ in cut]
    for p in range(1 << depth):
        for q in (p ^ m for m in masks if p ^ m >= p):
            for x in nodes[p]:
                for y in nodes[q]:
                    common = min(x[1], y[1])
                    i, j = place[x], place[y]
                    if (p != q or i <= j) and ((x[0] >> (x[1] - common)) ^ (y[0] >> (y[1] - common))).bit_count() <= budget:
                        owner, other = (i, j) if (i * 31 + j) & 1 else (j, i)
                        workers[other].append(owner)
    return np.array([p << (64 - d) for p, d in cut], dtype=np.uint64), workers


def fingerprint_links(fps: DataFrame, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): a spanning set of the links between the rows (fp, id) of distinct fingerprints."""
    starts, workers = cut_trie(fps, budget, node_rows)
    size = np.array([len(w) for w in workers])
    first, flat = np.cumsum(size) - size, np.array([x for w in workers for x in w], dtype=np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            node = np.searchsorted(starts, fp.view(np.uint64), side="right") - 1
            n = size[node]
            row = np.repeat(np.arange(len(fp)), n)
            task = flat[first[node][row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(task, pa.int32()), pa.array(node[row].astype(np.int32)), pa.array(fp[row]), batch.column(1).take(pa.array(row))],
                ["task", "node", "fp", "id"],
            )

    def walk(key: tuple, group: pa.Table) -> pa.Table:
        own, node = key[0].as_py(), np.asarray(group["node"])
        fp, ids = np.asarray(group["fp"]).view(np.uint64), np.asarray(group["id"])
        order = np.lexsort((fp, node))
        node, fp, ids = node[order], fp[order], ids[order]
        parts = {int(k): slice(s, e) for k, s, e in zip(*_runs(node))}
        forest, left, right = Forest(), [], []
        for other, part in parts.items():
            # the task's own node comes along even if it only meets other nodes
            if other == own:
                if own not in workers[own]:
                    continue
                i, j = trie_links(fp[part], None, budget)
                a, b = ids[part][i], ids[part][j]
            elif own in parts:
                i, j = trie_links(fp[parts[own]], fp[part], budget)
                a, b = ids[parts[own]][i], ids[part][j]
            else:
                continue
            for x, y in zip(a.tolist(), b.tolist()):
                if forest.join(x, y):
                    left.append(x)
                    right.append(y)
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    dealt = fps.select("fp", "id").mapInArrow(deal, "task int, node int, fp long, id long")
    return dealt.groupBy("task").applyInArrow(walk, "a long, b long")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[starts], starts, np.append(starts[1:], len(x))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have fingerprint zero, linked like any other. Rows repeated
    or with the same id are rows of their own in the result. A null id never becomes a
    component's id; a group without any id has a null component. No rows in, no rows out.
    Further columns are ignored.
    """
    fps = keep(fingerprints(docs, shingle), "fingerprints")
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "distinct")
    groups = keep(linked_groups(fingerprint_links(distinct, budget, node_rows)), "groups")
    labels = distinct.join(groups.withColumnRenamed("node", "id"), "id", "left")
    labels = keep(labels.select("fp", F.coalesce("component", "id").alias("component_id")), "labels")
    return fps.join(labels, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
