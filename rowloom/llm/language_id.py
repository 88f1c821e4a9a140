"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled rows as a Spark aggregation;
the matrix of log-probabilities (languages x buckets, a fixed number of buckets) goes to
the tasks, which score whole texts in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import bounded_rows
from rowloom.llm.texts import code_points, pieces

BUCKETS_LOG2 = 16
SIZES = (1, 2, 3)
ROWS_PER_LANGUAGE = 4000  # bound of the training sample
SMOOTHING = 0.5
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log-probabilities


def plain(points: np.ndarray) -> np.ndarray:
    """Code points with everything in ASCII that is no letter turned into a space."""
    keep = np.zeros(128, dtype=bool)
    keep[65:91] = keep[97:123] = True
    low = points < 128
    return np.where(low & ~keep[np.where(low, points, 0)], np.uint32(32), points)


def gram_buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each code point, for each n of SIZES."""
    for n in SIZES:
        h = np.full(max(0, len(points) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k:len(points) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        yield (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS_LOG2)


def learn(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """A model from (doc_id, text, lang); rows without text or language teach nothing.

    At most about ``rows_per_language`` rows of each language are used, chosen by a hash
    of the id. Every language counts as equally likely beforehand.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = bounded_rows(rows, "lang", rows_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            sums = {lang: np.zeros(1 << BUCKETS_LOG2, np.int64) for lang in set(langs)}
            for owner, starts, points in pieces((x.as_py().lower() for x in batch.column(0)), gap="  "):
                points, ends = plain(points), np.append(starts[1:] + 2, len(points))
                for k, s, e in zip(owner, starts, ends):
                    for ids in gram_buckets(points[s:e]):
                        sums[langs[k]] += np.bincount(ids, minlength=1 << BUCKETS_LOG2)
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"]
                )

    counted = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    n = np.full((1 << BUCKETS_LOG2, len(languages)), SMOOTHING)
    n[table["bucket"].to_numpy(int), np.searchsorted(languages, table["lang"])] += table["n"].to_numpy(float)
    weights = np.log(n / n.sum(axis=0)).astype(np.float32)
    for ids in gram_buckets(code_points("   ")):  # spaces alone say nothing
        weights[ids] = 0
    return LanguageModel(languages, weights)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of (doc_id, text), by its whole text alone.

    ``score`` is the posterior of the predicted language. ``und`` with score 0 for a null
    text, a text without letters, and when nothing was learned. Ties go to the language
    first in the alphabet. Further columns are ignored; repeated rows stay.
    """
    languages = model.languages
    broadcast = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = broadcast.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            sums = np.zeros((len(texts), max(1, len(languages))))
            if languages:
                size = max(1 << 14, (1 << 22) // len(languages))
                for owner, starts, points in pieces((t.lower() for t in texts), size, gap="  "):
                    points = plain(points)
                    for ids in gram_buckets(points):
                        np.add.at(sums, owner, np.add.reduceat(weights[ids], starts, axis=0, dtype=np.float64))
            best = sums.argmax(axis=1)
            score = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            known = [bool(languages) and LETTER.search(t) is not None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([languages[b] if ok else UNDETERMINED for b, ok in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0), pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
