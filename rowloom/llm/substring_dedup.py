"""Long repeats of words across documents by recompression.

A text is a row of words. A first round names runs of one word, each later round names pairs:
by a bit of its hash every symbol is a left or a right one, and a left symbol followed by a
right one becomes one symbol whose name is a hash of the two. Names say what they stand for,
so all tasks name alike, and equal stretches of words get equal symbols except at their ends.

What of a window of WINDOW words is the same wherever the window stands can be told from the
window alone: in each round a first symbol of the right kind and a last one of the left kind
are given up (in the round of runs the first and last run), as they might join a neighbour. The
first symbol left over in the highest round that leaves any is the window's anchor. Equal windows
have the same anchor at the same offset, and there is always one, since round zero is the words.

Windows next to each other mostly share their anchor. Spark brings together (anchor name, digest of
the stretch of those windows, text) once. A name met in one place only holds no repeat. Where
name and stretch are met again all windows of the stretch are repeats. Where only the name is,
the windows themselves are compared by 128-bit digests, one text for each stretch. So copies of
any number never meet in pairs, and only names met again cause further work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import keep

WINDOW = 35
WORDS_AT_ONCE = 1 << 18
SENT_ROWS = 1_000_000  # so many ids of texts at most are sent to all tasks
SPACE = r"[\x20\x09-\x0D]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
U = np.uint64


def mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """A 64-bit hash of two 64-bit values in order."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> U(32))) * _M1 + U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> U(29))) * _M2 ^ (np.asarray(b, np.uint64) * _M1 + U(salt))
        x = (x ^ (x >> U(30))) * _M1
        x = (x ^ (x >> U(27))) * _M2
        return x ^ (x >> U(31))


def word_names(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def window_digests(names: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A digest of the ``size`` words from each place on: doubling, then two overlapping parts."""
    span, found = 1, mix(names, 0, salt)
    while span * 2 <= size:
        found, span = mix(found[:-span], found[span:], salt + span), span * 2
    return mix(found[:len(found) - (size - span)], found[size - span:], salt + size) if span < size else found


def anchors(names: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, place of the first word) of the anchor of the window at each of ``starts``."""
    name, place = mix(names[starts], 0, 1), starts.copy()
    live = np.arange(len(starts))
    # round of runs
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(names)))
    run = np.cumsum(first) - 1
    symbol = mix(names[begin], length.astype(np.uint64), 2)
    low, high = run[starts] + 1, run[starts + size - 1]
    level = 2
    while True:
        good = low < high
        live, low, high = live[good], low[good], high[good]
        if not len(live):
            return name, place
        name[live], place[live] = mix(symbol[low], level, 3), begin[low]
        # round of pairs
        right = (mix(symbol, level, 4) & U(1)).astype(bool)
        joined = ~right[:-1] & right[1:] & (length[:-1] + length[1:] < size)
        fresh = np.append(True, ~joined)
        number = np.append(np.cumsum(fresh) - 1, int(fresh.sum()))
        low, high = number[low + right[low]], number[high - ~right[high - 1]]
        head = np.flatnonzero(fresh)
        pair = np.append(joined, False)[head]
        symbol = np.where(pair, mix(symbol[head], symbol[np.minimum(head + 1, len(symbol) - 1)], 5), symbol[head])
        begin = begin[head]
        length = np.diff(np.append(begin, len(names)))
        level += 1


class Stretches:
    """Anchored stretches of windows of several texts, laid one after the other."""

    def __init__(self, texts: list[list[bytes]], size: int):
        counts = np.array([len(t) for t in texts])
        offsets = np.cumsum(counts) - counts
        names = word_names([w for t in texts for w in t])
        windows = np.maximum(counts - size + 1, 0)
        owner = np.repeat(np.arange(len(texts)), windows)
        starts = offsets[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.size, self.offsets, self.counts = size, offsets, counts
        self.high, self.low = window_digests(names, size, 100), window_digests(names, size, 200)
        name, place = anchors(names, starts, size) if len(starts) else (np.empty(0, np.uint64), starts)
        new = np.ones(len(starts), bool)
        new[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(starts)) - 1
        self.owner, self.first, self.last = owner[at], starts[at], starts[end]  # first and last window of each
        self.name = name[at]
        # a stretch is all words of its windows; at most size - 1 windows follow the first, so two digests cover it
        before, after = (place[at] - self.first).astype(np.uint64), (place[at] - self.last).astype(np.uint64)
        self.stretch = mix(mix(self.high[self.first], self.high[self.last], 6), mix(before, after, 7), 8) if len(at) else self.name


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space only


def grouped(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[tuple[list[list], list[list[bytes]]]]:
    """(rows without text, words) in lots of about WORDS_AT_ONCE words, so that short texts share the array work."""
    rows, texts, held = [], [], 0
    for batch in batches:
        others = [c for k, c in enumerate(batch.columns) if k != text_column]
        for k in range(batch.num_rows):
            words = split(batch.column(text_column)[k].as_py())
            rows.append([c[k].values if pa.types.is_nested(c.type) else c[k].as_py() for c in others])
            texts.append(words)
            held += len(words)
            if held >= WORDS_AT_ONCE:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def listed_fields(lists: list[pa.StructArray | None], fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(index of the list, each field) of all entries of ``lists`` one after the other."""
    sizes = [0 if x is None else len(x) for x in lists]
    some = [x for x in lists if x is not None and len(x)]
    columns = [np.concatenate([np.empty(0, np.int64), *[x.field(f).to_numpy(zero_copy_only=False) for x in some]]) for f in range(fields)]
    return np.repeat(np.arange(len(lists)), sizes), [c.astype(np.int64) for c in columns]


def matches(mine: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of ``mine`` that stand among ``asked``, their indexes there); rows of three integers each."""
    keys = [mix(mix(a.view(np.uint64), b.view(np.uint64), 9), c.astype(np.uint64), 10) for a, b, c in (mine, asked)]
    if not len(keys[1]):
        return (np.empty(0, np.int64),) * 2
    order = np.argsort(keys[1])
    at = order[np.minimum(np.searchsorted(keys[1][order], keys[0]), len(order) - 1)]
    same = np.logical_and.reduce([m == a[at] for m, a in zip(mine, asked)])
    return np.flatnonzero(same), at[same]


def _chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The row of ``docs`` (doc_id, text), or more equal ones, for each of ``wanted`` (rep, raw)."""
    if wanted.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"]) & (F.xxhash64(docs["text"]) == wanted["raw"]))


def drop_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, kept, n_words, n_removed) for each row of (doc_id, text): texts without long repeats.

    Words are divided by ASCII white space. A word goes if a window of ``size`` words over it stands
    anywhere else too, in the same text or another; windows are judged on the input. ``kept`` are
    the other words, joined by one space; it is null for texts that lose nothing, whose words
    are all kept, and comes with ``kept_sha256`` for every row. Texts shorter than ``size`` words,
    empty and null ones lose nothing. Repeated rows count as further places, null ids are allowed.
    No rows in, no rows out; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("raw"), F.trim(F.regexp_replace("text", SPACE, " ")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    n_words = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1)
    members = keep(rows.select("doc_id", "raw", "digest", n_words.cast("long").alias("n_words")), "members")
    texts = members.where(F.col("n_words") >= size).groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("one"), F.count("*").alias("copies"))
    texts = texts.select("digest", F.col("one.doc_id").alias("rep"), F.col("one.raw").alias("raw"), "copies", F.monotonically_increasing_id().alias("node"))
    texts = keep(texts, "texts")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, words in grouped(batches, 1):
            s = Stretches(words, size)
            order = np.lexsort((s.stretch, s.name, s.owner))
            owner, name, stretch = s.owner[order], s.name[order], s.stretch[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (name[1:] != name[:-1]) | (stretch[1:] != stretch[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(order)))
            nodes = np.array([r[0] for r in own], np.int64)
            yield pa.RecordBatch.from_arrays(
                [signed(name[at]), signed(stretch[at]), pa.array(nodes[owner[at]]), pa.array(np.minimum(times, 2).astype(np.int8))],
                ["name", "stretch", "node", "times"],
            )

    found = _chosen(docs, texts.select("node", "rep", "raw")).select("node", "text").mapInArrow(places, "name long, stretch long, node long, times byte")
    # one shuffle; rows of a name lie together for all that follows. Equal rows of one text chosen twice are folded.
    found = found.repartition("name").groupBy("name", "stretch", "node").agg(F.max("times").alias("times"))
    name, both = Window.partitionBy("name"), Window.partitionBy("name", "stretch")
    found = found.select(
        "*", F.sum("times").over(both).alias("met"), F.min("node").over(both).alias("first"),
        F.sum("times").over(name).alias("named"), F.min("stretch").over(name).alias("a"), F.max("stretch").over(name).alias("b"),
    ).where("named > 1")
    shared = keep(found.select("name", "stretch", "node", (F.col("met") > 1).alias("whole"), (F.col("a") < F.col("b")).alias("differ"),
                               (F.col("node") == F.col("first")).alias("speaks")), "shared")

    def listed(df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(F.collect_list(F.struct("name", "stretch", "whole")).alias("stretches"))  # as many as the text has

    compared = listed(shared.where("differ and speaks"))
    ask = compared.join(texts.select("node", "rep", "raw", "copies"), "node")
    speakers = _chosen(docs, keep(ask.select("node", "rep", "raw", "copies"), "speakers")).select("node", "text", "copies").dropDuplicates(["node"])

    def lookup(s: Stretches, lists: list[pa.StructArray | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index into the stretches, whole) of the listed stretches."""
        owner, (name, stretch, whole) = listed_fields(lists, 3)
        hit, at = matches((s.name.view(np.int64), s.stretch.view(np.int64), s.owner), (name, stretch, owner))
        return hit, whole[at].astype(bool)

    def expanded(s: Stretches, at: np.ndarray) -> np.ndarray:
        """The windows of the stretches ``at``."""
        n = s.last[at] - s.first[at] + 1
        return np.repeat(s.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, words in grouped(batches, 1):
            s = Stretches(words, size)
            at, whole = lookup(s, [r[2] for r in own])
            starts = expanded(s, at)
            n = s.last[at] - s.first[at] + 1
            twice = np.repeat(whole | np.array([own[o][1] > 1 for o in s.owner[at]], bool), n)
            nodes = np.array([r[0] for r in own], np.int64)[np.repeat(s.owner[at], n)]
            yield pa.RecordBatch.from_arrays(
                [signed(s.high[starts]), signed(s.low[starts]), pa.array(nodes), pa.array(np.where(twice, 2, 1).astype(np.int8))], ["high", "low", "node", "times"]
            )

    spoken = speakers.join(compared, "node").select("node", "text", "copies", "stretches")
    spoken = spoken.mapInArrow(windows, "high long, low long, node long, times byte")
    same = Window.partitionBy("high", "low")
    spoken = spoken.repartition("high").select("high", "low", "node", F.sum("times").over(same).alias("met")).where("met > 1")
    again = keep(spoken.select("high", "low", "node"), "repeated_windows").groupBy("node").agg(F.collect_set(F.struct("high", "low")).alias("windows"))

    # texts met more than once lose all words; of the others those with a repeat are read again
    touched = listed(shared.where("whole")).join(again, "node", "full_outer")
    touched = touched.join(texts.where("copies = 1").select("node", "rep", "raw"), "node")
    touched = keep(touched, "touched")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, words in grouped(batches, 1):
            s = Stretches(words, size)
            at, _ = lookup(s, [r[1] for r in own])
            marks = np.zeros(int(s.counts.sum()) + 1, np.int64)
            starts = [expanded(s, at)]
            owner, (high, low) = listed_fields([r[2] for r in own], 2)
            asking = np.flatnonzero(np.bincount(owner, minlength=len(own)) * (s.counts >= size))
            n = s.counts[asking] - size + 1
            mine = np.repeat(s.offsets[asking], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit, _ = matches((s.high[mine].view(np.int64), s.low[mine].view(np.int64), np.repeat(asking, n)), (high, low, owner))
            starts.append(mine[hit])
            begin = np.concatenate(starts)
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + size, -1)
            gone = np.cumsum(marks)[:-1] > 0
            texts_kept, removed = [], []
            for o, text in enumerate(words):
                mask = gone[s.offsets[o]:s.offsets[o] + len(text)]
                removed.append(int(mask.sum()))
                texts_kept.append(b" ".join([text[k] for k in np.flatnonzero(~mask)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in own], pa.int64()), pa.array([t.decode("utf-8", "surrogatepass") for t in texts_kept], pa.string()),
                 pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts_kept], pa.string())],
                ["node", "kept", "n_removed", "kept_sha256"],
            )

    again = _chosen(docs, touched.select("node", "rep", "raw")).select("node", "text").dropDuplicates(["node"])
    cut = again.join(touched.select("node", "stretches", "windows"), "node").select("node", "text", "stretches", "windows")
    cut = cut.mapInArrow(kept, "node long, kept string, n_removed long, kept_sha256 string").join(texts.select("node", F.col("digest").alias("wanted")), "node")
    cut = cut.select("wanted", "kept", "n_removed", "kept_sha256")
    empty = hashlib.sha256().hexdigest()
    copied = texts.where("copies > 1").select(F.col("digest").alias("wanted"), F.lit("").alias("kept"), F.lit(-1).cast("long").alias("n_removed"), F.lit(empty).alias("kept_sha256"))
    results = keep(cut.union(copied), "kept")
    joined = members.join(results, members["digest"] == results["wanted"], "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return joined.select("doc_id", "kept", "n_words", removed.cast("long").alias("n_removed"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"))
