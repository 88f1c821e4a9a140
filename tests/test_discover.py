"""Keys and references against brute force."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from rowloom.plans import discover


def brute_keys(rows, n, most=3):
    keys = []
    for size in range(1, most + 1):
        for c in combinations(range(n), size):
            if not any(set(k) <= set(c) for k in keys) and all(r[k] is not None for r in rows for k in c):
                if len({tuple(r[k] for k in c) for r in rows}) == len(rows):
                    keys.append(c)
    return keys


def test_unique_keys(spark):
    for seed in range(4):
        draw = random.Random(seed)
        rows = [(k // 20, k % 20, draw.randint(0, 30), draw.choice("abcdef"), draw.randint(0, 2000), draw.choice([None, *range(9000)]), 1.5) for k in range(200)]
        if seed == 3:
            rows.append(rows[0])  # nothing is unique any more
        frame = spark.createDataFrame(rows, "a int, b long, `c.d` int, e string, f long, g int, h double")
        found = discover.discover_unique_keys(frame)
        assert found == [tuple(frame.columns[k] for k in c) for c in brute_keys(rows, 7)]
        assert seed == 3 or ("a", "b") in found
    assert discover.discover_unique_keys(frame.limit(0)) == [(c,) for c in frame.columns]
    assert discover.discover_unique_keys(frame, columns=["none"]) == []
    one = spark.sql("SELECT id, array(1) AS x, null AS y FROM range(3)")
    assert discover.discover_unique_keys(one) == [("id",)]


def test_unique_keys_shuffle_few_digests_at_once(spark, monkeypatch):
    rows = [(k // 50, k % 50, k // 20, k % 20, k, k % 7, None if k else 1) for k in range(1000)]
    frame = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int, g int").where("e >= 0")
    stored = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum("shuffle" in stored.getAllFiles().apply(k).getName() for k in range(stored.getAllFiles().size()))
    whole = []
    real = discover._passes

    def counted(candidates, n):
        passes = real(candidates, n)
        whole.extend(len(c) for c in passes if n >= 1000)
        return passes

    want = [tuple(frame.columns[k] for k in c) for c in brute_keys(rows, 7)]
    assert ("e",) in want and len(want) > 2
    monkeypatch.setattr(discover, "_passes", counted)
    before = shuffles()
    assert discover.discover_unique_keys(frame) == want and max(whole) > 2
    assert shuffles() <= before  # none stays
    whole.clear()
    monkeypatch.setattr(discover, "PASS_ROWS", 2500)
    assert discover.discover_unique_keys(frame) == want and max(whole) == 2
    # digests that meet by chance do not refute a key
    digest = discover._digest
    monkeypatch.setattr(discover, "_digest", lambda c: [F.pmod(digest(c)[0], F.lit(100_000)), digest(c)[1]])
    assert discover._fewer_digests(frame, [("e",)], 1000) == [("e",)]
    assert discover.discover_unique_keys(frame.select("e"), 1) == [("e",)]


def test_references(spark):
    draw = random.Random(7)
    tables = {
        "p": [(k, f"n{k}", k % 3) for k in range(50)],
        "c": [(draw.choice([None, *range(50)]), draw.choice(["n1", "n2", None]), draw.randint(40, 60)) for _ in range(300)],
        "e": [(None, None, 5)],
    }
    frames = {n: spark.createDataFrame(r, "x int, y string, z long") for n, r in tables.items()}
    values = {f"{n}.{'xyz'[k]}": (k == 1, {r[k] for r in rows} - {None}) for n, rows in tables.items() for k in range(3)}
    want = {(a, b, len(u)) for a, (s, u) in values.items() for b, (t, v) in values.items() if a != b and s == t and u and u <= v}
    assert {tuple(r) for r in discover.discover_references(frames).collect()} == want and ("c.x", "p.x", len(values["c.x"][1])) in want
