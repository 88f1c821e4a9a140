"""Long repeats against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import substring_dedup


def brute(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    met = Counter(tuple(w[k:k + size]) for w in split for k in range(len(w) - size + 1))
    out = []
    for words in split:
        gone = set()
        for k in range(len(words) - size + 1):
            if met[tuple(words[k:k + size])] > 1:
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts_with_repeats(seed, vocabulary):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["é", "日本"]
    say = lambda n: draw.choices(words, k=n)
    passages = [say(n) for n in (34, 35, 36, 50, 120)] + [["run"] * 40, ["a", "b"] * 30, ["x", *["run"] * 34]]
    texts = []
    for _ in range(120):
        parts = [say(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            cut = draw.randint(0, max(0, len(p) - 36))
            parts += [p[cut:] if draw.random() < 0.3 else p, say(draw.randint(0, 50))]
        texts.append(draw.choice([" ", "\n", "  \t"]).join(w for p in parts for w in p))
    near = texts[0].split() + say(300)
    texts += [" ".join([*near[:k], "changed", *near[k + 1:]]) for k in range(0, 300, 30)]
    texts += [texts[5], texts[5], " ".join(texts[5].split()), None, "", " \n", "one", " ".join(["same"] * 500), " ".join(say(35)), "\x0b".join(["p", "q", "r"] * 40)]
    return texts + [None, "", " ".join(say(40_000))]


@pytest.mark.parametrize("vocabulary, size", [(5000, 35), (3, 35), (12, 4)])
def test_repeats(spark, vocabulary, size):
    texts = texts_with_repeats(vocabulary, vocabulary)
    rows = [(None if k == 3 else k, t, "x", k, "y") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, node long, kept string").repartition(4)
    found = substring_dedup.drop_repeats(frame, size).collect()
    want = brute(texts, size)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == Counter((r[0], *w) for r, w in zip(rows, want))
    assert all(r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)
    if size == 4:
        assert substring_dedup.drop_repeats(frame.limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(8)
    for vocabulary in (2, 5, 1000):
        passage = draw.integers(0, vocabulary, 80, dtype=np.uint64)
        found = []
        for _ in range(30):
            before = draw.integers(0, vocabulary, draw.integers(0, 50), dtype=np.uint64)
            names = np.concatenate((before, passage, draw.integers(0, vocabulary, 40, dtype=np.uint64)))
            starts = np.arange(len(before), len(before) + 46)
            name, place = substring_dedup.anchors(names, starts, 35)
            assert ((place >= starts) & (place < starts + 35)).all()
            found.append((name.tobytes(), (place - len(before)).tobytes()))
        assert len(set(found)) == 1
