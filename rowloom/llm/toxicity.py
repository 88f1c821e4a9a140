"""Toxicity of a text by a bag of subword embeddings averaged into a linear softmax.

A word is embedded as the mean of the vectors of its character n-grams, a text as the
mean of its distinct words, which weigh 1 + ln(how often they occur). The hashed n-gram vectors and the two softmax rows are trained jointly
in numpy on a bounded sample of labelled rows. Since the model is linear in the vectors,
scoring needs one number per bucket: the difference of the two logits that it adds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import bounded_rows, held_out
from rowloom.llm.texts import pieces

BUCKETS_LOG2 = 19
SIZES = (3, 4, 5)
WIDTH = 8
ROWS_PER_LABEL = {0: 4000, 1: 2000}  # bound of the training sample
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 800, 64, 0.5, 0.0005
THRESHOLD = 0.3
PAD = 40  # a text is averaged with so many empty words, or few words would speak too loud
MIN_TEXTS = 5  # an n-gram has a vector only if so many texts of the sample hold it
EDGE = np.uint32(32)


@dataclass(frozen=True)
class ToxicityModel:
    effect: np.ndarray  # what each n-gram bucket adds to the logit of label 1 over label 0
    bias: float


def letters(points: np.ndarray) -> np.ndarray:
    """Code points with ASCII marks and digits turned into spaces: words are what lies between."""
    keep = np.zeros(128, dtype=bool)
    keep[97:123] = True
    low = points < 128
    return np.where(low & ~keep[np.where(low, points, 0)], EDGE, points)


def word_grams(points: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Index of each code point's word (from 0), and for each n the starts and buckets of the
    n-grams that lie within one word and the spaces around it; they belong to the word of their second point."""
    inside = points != EDGE
    word = np.cumsum(inside & ~np.concatenate(([False], inside[:-1]))) - 1
    grams = []
    h = points * np.uint32(0x9E3779B1)
    held = np.ones(len(points), dtype=bool)
    for k in range(1, max(SIZES)):
        if len(h) <= 1:
            break
        h = (h[:-1] ^ (points[k:] * np.uint32(2 * k + 1))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        held = held[:-1] & (inside[1:len(h) + 1] if k == 1 else inside[k - 1:k - 1 + len(h)])
        if k + 1 in SIZES:
            at = np.flatnonzero(held)
            grams.append((at, (h[at] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS_LOG2)))
    return word, grams


def learn(docs: DataFrame, labels: DataFrame, rows_per_label: dict[int, int] | None = None) -> ToxicityModel:
    """A model from (doc_id, text) and (doc_id, toxic); held-out rows and rows without text or label teach nothing.

    At most about ``rows_per_label[label]`` rows of each label are used, chosen by a hash of
    the id. These few ids are sent to all tasks, which turn their documents into n-gram
    weights; training runs on the driver over that bounded sample. With only one label
    present every score is near it, with none every score is near 0.
    """
    rows_per_label = rows_per_label or ROWS_PER_LABEL
    marked = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    marked = marked.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    chosen = bounded_rows(marked.where("toxic = 1"), "toxic", rows_per_label[1]).union(
        bounded_rows(marked.where("toxic = 0"), "toxic", rows_per_label[0])
    )

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                ids, weights = features(text)
                if len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc]), pa.array([toxic], pa.int32()), pa.array([ids.tobytes()]), pa.array([weights.tobytes()])],
                        ["doc_id", "toxic", "ids", "weights"],
                    )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    made = rows.mapInArrow(featurise, "doc_id long, toxic int, ids binary, weights binary")
    return fit(made.select("toxic", "doc_id", "ids", "weights").toLocalIterator())


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their weights: n-grams averaged within words, words within the text."""
    found: list[np.ndarray] = []
    shares: list[np.ndarray] = []
    weight = 0.0
    for _, starts, points in pieces([text.lower()]):
        word, grams = word_grams(letters(points))
        if not len(word) or word[-1] < 0:
            continue
        own = np.concatenate([word[at + 1] for at, _ in grams])
        ids = np.concatenate([g for _, g in grams])
        size = np.bincount(own)
        _, first, damped = distinct_words(np.zeros(len(size), np.int64), own, ids)
        per_word = np.zeros(len(size))
        per_word[first] = damped / size[first]
        used = per_word[own] > 0
        found.append(ids[used])
        shares.append(per_word[own][used])
        weight += damped.sum()
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    ids, back = np.unique(np.concatenate(found), return_inverse=True)
    return ids.astype(np.int32), (np.bincount(back, np.concatenate(shares)) / (weight + PAD)).astype(np.float32)


def distinct_words(text: np.ndarray, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words of each text: the text, the place of the first one, and the damped count.

    ``text`` is the text of each word; ``own`` and ``ids`` are the words and buckets of the n-grams.
    """
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    low = np.bincount(own, (mixed & np.uint64(0xFFFFFF)).astype(float), minlength=len(text))
    high = np.bincount(own, (mixed >> np.uint64(40)).astype(float), minlength=len(text))
    key = (low.astype(np.uint64) << np.uint64(32) ^ high.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    key += text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return text[first], first, 1 + np.log(count)


def gathered(rows: Iterable[tuple[int, int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label, first and last place of each row (toxic, doc_id, ids, weights) in two flat arrays of its ids and weights.

    Rows come in any order and go by label, id and content. Each is appended to the flat
    arrays as it arrives, so that the driver holds the sample once.
    """
    ids, weights, keys, ends = bytearray(), bytearray(), [], []
    for toxic, doc, i, w in rows:
        keys.append((toxic, doc, blake2b(bytes(i) + bytes(w), digest_size=8).digest()))
        ids += i
        weights += w
        ends.append(len(ids) // 4)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    y, ends = np.array([keys[k][0] for k in order], dtype=float), np.array(ends, np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return y, starts[order], ends[order], np.frombuffer(ids, np.int32), np.frombuffer(weights, np.float32)


def fit(rows: Iterable[tuple[int, int, bytes, bytes]]) -> ToxicityModel:
    y, starts, ends, flat, shares = gathered(rows)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(np.zeros(1 << BUCKETS_LOG2, np.float32), 20.0 if len(y) and y[0] else -20.0)
    texts = np.zeros(1 << BUCKETS_LOG2, np.int32)
    for s, e in zip(starts, ends):
        texts[flat[s:e]] += 1  # a text's ids are distinct
    used = np.flatnonzero(texts >= MIN_TEXTS)
    compact = np.full(1 << BUCKETS_LOG2, -1, np.int32)
    compact[used] = np.arange(len(used), dtype=np.int32)
    # the ids that stay move to the front of their row, in place
    for k, (s, e) in enumerate(zip(starts, ends)):
        new = compact[flat[s:e]]
        held = new >= 0
        ends[k] = s + held.sum()
        flat[s:ends[k]], shares[s:ends[k]] = new[held], shares[s:e][held]
    ids = [flat[s:e] for s, e in zip(starts, ends)]
    weights = [shares[s:e] for s, e in zip(starts, ends)]
    draw = np.random.default_rng(7)
    vectors = draw.normal(0, 0.1, (len(used), WIDTH))
    softmax = draw.normal(0, 0.1, (WIDTH, 2))
    bias = np.zeros(2)
    seen_v, seen_s, seen_b = np.full(len(used), 1e-8), np.full((WIDTH, 2), 1e-8), np.full(2, 1e-8)
    balance = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for _ in range(max(EPOCHS, STEPS * BATCH // len(y))):  # few rows are seen more often
        order = draw.permutation(len(y))
        for at in range(0, len(y), BATCH):
            part = order[at:at + BATCH]
            i = np.concatenate([ids[k] for k in part])
            w = np.concatenate([weights[k] for k in part])
            doc = np.repeat(np.arange(len(part)), [len(ids[k]) for k in part])
            # with two classes the errors of both logits are opposite, so each n-gram's
            # gradient is one number times the difference of the two softmax rows
            across = softmax[:, 1] - softmax[:, 0]
            z = np.bincount(doc, w * (vectors @ across)[i], minlength=len(part)) + bias[1] - bias[0]
            err = (1 / (1 + np.exp(-z)) - y[part]) * balance[part] / len(part)
            pull = np.bincount(i, w * err[doc], minlength=len(used))
            hit = np.flatnonzero(pull)
            pull = pull[hit]
            g_soft = np.outer(vectors[hit].T @ pull, [-1, 1])
            g_bias = err.sum() * np.array([-1, 1])
            seen_v[hit] += pull**2 * (across**2).mean()
            vectors[hit] -= np.outer(RATE * pull / np.sqrt(seen_v[hit]), across) + DECAY * vectors[hit]
            seen_s += g_soft**2
            softmax -= 0.1 * g_soft / np.sqrt(seen_s)
            seen_b += g_bias**2
            bias -= 0.1 * g_bias / np.sqrt(seen_b)
    effect = np.zeros(1 << BUCKETS_LOG2, np.float32)
    effect[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return ToxicityModel(effect, float(bias[1] - bias[0] - np.log(balance.max())))


def logits(texts: list[str], model: ToxicityModel) -> np.ndarray:
    sums, weight = np.zeros(len(texts)), np.full(len(texts), float(PAD))
    for owner, starts, points in pieces(t.lower() for t in texts):
        word, grams = word_grams(letters(points))
        n = int(word[-1]) + 1
        if not n:
            continue
        own = np.concatenate([word[at + 1] for at, _ in grams])
        ids = np.concatenate([g for _, g in grams])
        effect = np.bincount(own, model.effect[ids], minlength=n) / np.bincount(own, minlength=n)
        text = np.repeat(np.arange(len(owner)), np.diff(np.append(word[starts] + 1, n)))
        text, first, damped = distinct_words(text, own, ids)
        sums += np.bincount(owner[text], damped * effect[first], minlength=len(texts))
        weight += np.bincount(owner[text], damped, minlength=len(texts))
    return sums / weight + model.bias


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row of (doc_id, text), by its whole text alone.

    ``score`` is the probability of label 1; null, empty and letterless texts get that of
    an empty bag. Further columns are ignored; repeated rows stay.
    """
    effect = docs.sparkSession.sparkContext.broadcast(model.effect)
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(effect.value, bias)
        for batch in batches:
            z = logits([x.as_py() or "" for x in batch.column(1)], own)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; judged where they lie, without a shuffle."""
    effect = docs.sparkSession.sparkContext.broadcast(model.effect)
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(effect.value, bias)
        for batch in batches:
            z = logits([x.as_py() or "" for x in batch.column("text")], own)
            clean = 1 / (1 + np.exp(-np.clip(z, -500, 500))) < threshold
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
