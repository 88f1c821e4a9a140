"""The keyed target: pruning, shared log, id blocks."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowloom.operators import ingest as I
from rowloom.session import scratch_path
from rowloom.sources import log
from rowloom.sources.ids import IdBlocks
from rowloom.sources.target import FileTarget

ROWS = "k long, part string, v long"


def loaded(spark, segments, rows, buckets=4):
    """Segments of consecutive keys, as a table grows over time."""
    t = FileTarget.create(spark, scratch_path(spark, "t"), StructType.fromDDL(ROWS), ["k", "part"], buckets)
    for n in range(segments):
        t.append(spark.range(n * rows, (n + 1) * rows).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id") % 3).alias("part"), F.lit(0).cast("long").alias("v")))
    return t


def test_a_small_upsert_opens_few_files(spark):
    t = loaded(spark, 25, 400)
    files = {(s["name"], b) for s in t.snapshot().segments for b in s["buckets"]}
    assert len(files) == 100
    batch = spark.range(2040, 2140, 25).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id") % 3).alias("part"), F.lit(7).cast("long").alias("v"))
    batch = batch.unionByName(spark.createDataFrame([(10**9, "p0", 7)], ROWS))
    found = t.touched(batch)
    opened = t.known_keys(batch).inputFiles()
    assert set(found) <= files and len(found) < 5 and len(opened) <= len(found)
    I.ingest(batch, t, ["v"], "upsert")
    assert sorted((f["segment"], b) for f in t.snapshot().deletes[0]["files"] for b in f["buckets"]) == found
    got = {r.k: r.v for r in t.read().collect()}
    want = {k: 0 for k in range(10_000)} | {k: 7 for k in [*range(2040, 2140, 25), 10**9]}
    assert got == want and t.read().count() == len(want)


def test_no_key_is_missed_and_few_are_met_by_mistake(spark):
    t = loaded(spark, 3, 30_000, buckets=2)
    assert all(s["slices"] > 1 for s in t.snapshot().segments)
    everything = {(s["name"], b) for s in t.snapshot().segments for b in s["buckets"]}
    assert set(t.touched(t.keys())) == everything
    for k in (0, 29_999, 30_000, 89_999):
        own = spark.createDataFrame([(k, f"p{k % 3}", 1)], ROWS)
        assert t.snapshot().segments[k // 30_000]["name"] in {s for s, _ in t.touched(own)}
        assert t.known_keys(own).where(F.col("k") == k).count() == 1
    wrong = sum(len(t.touched(spark.createDataFrame([(k, "other", 1)], ROWS))) for k in range(40_000, 40_020))
    assert wrong <= 4
    assert t.touched(spark.createDataFrame([(None, "p0", 1), (1, None, 1)], ROWS)) == []


def test_modes_agree_with_a_dictionary(spark):
    t = FileTarget.create(spark, scratch_path(spark, "t"), StructType.fromDDL(ROWS), ["k", "part"], 3)
    held = {}
    for n, mode in enumerate(["upsert", "do_nothing", "upsert", "upsert", "do_nothing", "upsert"]):
        rows = [((n * 7 + i * 5) % 23, "ab"[i % 2], n * 100 + i) for i in range(12)]
        I.ingest(spark.createDataFrame(rows, ROWS), t, ["v"], mode, batch_id=n)
        for k, part, v in rows:
            if mode == "upsert" or (k, part) not in held:
                held[k, part] = v
        assert {(r.k, r.part): r.v for r in t.read().collect()} == held and t.read().count() == len(held)
    t.compact()
    assert {(r.k, r.part): r.v for r in t.read().collect()} == held and t.snapshot().batches == ((0, 5),)
    with pytest.raises(I.KeyConflict):
        I.ingest(spark.createDataFrame([(*next(iter(held)), 1)], ROWS), t, ["v"])


def test_two_writers_lose_nothing(spark):
    t = loaded(spark, 1, 10)
    failed = []

    def write(who):
        try:
            for n in range(3):
                rows = [(who * 1000 + n * 10 + i, "p", who) for i in range(5)] + [(5, "shared", who)]
                I.ingest(spark.createDataFrame(rows, ROWS), t, ["v"], "do_nothing", batch_id=who * 10 + n)
        except Exception as error:  # shown by the test
            failed.append(error)

    threads = [threading.Thread(target=write, args=(who,)) for who in (1, 2)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not failed
    assert t.read().count() == 10 + 30 + 1 and t.snapshot().version == 1 + 6
    assert t.snapshot().batch_ids == {10, 11, 12, 20, 21, 22}


def test_a_late_writer_is_refused(spark):
    t = loaded(spark, 1, 10)
    before = t.snapshot()
    t.append(spark.createDataFrame([(100, "x", 1)], ROWS), snapshot=before)
    with pytest.raises(log.CommitConflict):
        t.append(spark.createDataFrame([(100, "x", 2)], ROWS), snapshot=before)
    assert t.read().count() == 11


def test_id_blocks_of_several_loaders(spark):
    path, taken = scratch_path(spark, "ids"), []

    def load(n):
        ids = IdBlocks(spark, path, start=100, step=5)
        for _ in range(10):
            first = ids.take(n)
            taken.extend(range(first, first + 5 * n, 5))

    threads = [threading.Thread(target=load, args=(n,)) for n in (1, 3, 4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert sorted(taken) == list(range(100, 100 + 5 * 80, 5))
    again = IdBlocks(spark, path, start=100, step=5)
    assert again.take(0) == again.take(2) == 500 and again.take(1) == 510
    with pytest.raises(ValueError):
        again.take(-1)
    found = again.number(spark.range(3), ["id"], "key").collect()
    assert sorted(tuple(r) for r in found) == [(0, 515), (1, 520), (2, 525)]


def test_the_log_is_folded(spark, tmp_path):
    path = str(tmp_path / "log")
    shared = log.CommitLog(spark, path, {"n": 0}, lambda state, entry: {"n": state["n"] + entry["add"]})
    for k in range(40):
        assert shared.commit(k - 1, {"add": k})
        assert not shared.commit(k - 1, {"add": 1})
    assert shared.state() == (39, {"n": sum(range(40))})
    assert len([f for f in (tmp_path / "log").iterdir() if f.name.startswith("fold-")]) == 2
    for f in (tmp_path / "log").glob("0000000000000000001*.json"):
        f.unlink()  # the fold stands for them
    assert shared.state() == (39, {"n": sum(range(40))})
