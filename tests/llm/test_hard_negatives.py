"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from rowloom.llm import hard_negatives


def brute(rows, shares=(80, 100)):
    good = {}
    for vec_id, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v):
            good[vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    ids, found = list(good), set()

    def first(pool, k=5):
        return sorted(pool, key=lambda x: (-x[0], math.inf if x[1] is None else x[1]))[:k]

    for a, label, v in ids:
        if a is None or a % 100:
            continue
        scored = [(max(min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), -2**63), b, m) for b, m, w in ids if len(w) == len(v)]
        for ps, p, _ in first([s for s in scored if s[2] == label and s[1] != a]):
            hits = first([s for s in scored if s[2] != label and shares[0] * ps <= 100 * s[0] <= shares[1] * ps])
            found |= {(a, p, n + 1, b, ps, s) for n, (s, b, _) in enumerate(hits)}
    return found


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + draw.normal(0, 0.4, 16)).tolist(), k % 4) for k in range(420)]
    rows += [(k, [0.25] * 16, k % 3) for k in range(500, 560)]  # ties
    rows += [rows[100], rows[7], (600, [0.0] * 16, 1), (700, None, 1), (701, [1.0, None] * 8, 1), (800, [math.nan] * 16, 1), (900, rows[0][1], None)]
    rows += [(None, rows[3][1], 0), (None, rows[3][1], 1), (1000, [3e19] * 16, 1), (1001, [2.9e19] * 16, 1), (1002, [2.8e19] * 16, 2), (1100, [1.0, 2.0], 1)]
    return rows + [(1101, [1.0, 2.5], 1), (1102, [1.0, 2.2], 2), (1200, [], 1), (1300, [-1.0] * 16, 2)]


@pytest.mark.parametrize("block, batch", [(256, 4096), (8, 3)])
def test_hard_negatives(spark, monkeypatch, rows, block, batch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rank string, dim int")
    found = hard_negatives.hard_negatives(frame.repartition(4), "vec_id % 100 = 0", batch=batch).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute(rows)
    if block == 256:
        assert hard_negatives.hard_negatives(frame.limit(0), "vec_id % 100 = 0").count() == 0


def test_bounds_hold_every_score():
    draw = np.random.default_rng(6)
    for scale in (1e-3, 1, 1e6):
        block = np.floor(256 * scale * (draw.normal(size=16) + draw.normal(0, 0.1, (50, 16))))
        anchors = np.floor(256 * draw.normal(size=(20, 16)))
        anchors = np.concatenate((anchors, block[:5], np.zeros((1, 16))))
        theta, size = hard_negatives.angles(block, hard_negatives.norms_of(block)), hard_negatives.norms_of(block)
        low, high = hard_negatives.score_bounds(
            hard_negatives.angles(anchors, hard_negatives.norms_of(anchors)), hard_negatives.norms_of(anchors), theta.min(axis=0), theta.max(axis=0), size.min(), size.max()
        )
        exact = hard_negatives.scores(anchors, block)
        assert (low <= exact.min(axis=1)).all() and (high >= exact.max(axis=1)).all()
