"""Skewed keys, large paths, graphs, conflicts and error policies on small frames."""

from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowloom.operators import ingest as I
from rowloom.operators import metrics as M
from rowloom.operators.dependency import adjacent, cyclic_nodes, dependency_levels, load_order, one_cycle
from rowloom.operators.lookup import cross_product, dictionary_pick, lookup_one, weighted_choice
from rowloom.operators.row_index import with_row_index, with_running_total
from rowloom.operators.sizes import is_small
from rowloom.operators.skew import hot_keys, join_unique, salted_join
from rowloom.plans.spec import ColumnSpec, Identity, TableSpec
from rowloom.session import scratch_path, shared_dir
from rowloom.sources import text as X
from rowloom.sources.jdbc import jdbc_options
from rowloom.sources.target import FileTarget
from rowloom.streaming.ingest import generated_stream


def skewed(spark, rows=9000):
    """A third of the rows share one key."""
    return spark.range(rows).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k"))


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    df = skewed(spark)
    ref = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert same(salted_join(df, ref, ["k"], how), df.join(ref, ["k"], how))
    assert hot_keys(df, ["k"], 8).select("k").collect() == [(7,)]


def test_size_check_decides_the_join(spark):
    df, ref = skewed(spark), spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert is_small(ref, 100) and not is_small(ref, 99)
    assert same(join_unique(df, ref, ["k"], limit=10), join_unique(df, ref, ["k"]))


def test_row_index_large_equals_small(spark):
    df = skewed(spark).repartition(5)
    large = with_row_index(df, ["k", "id"], small=False)
    assert same(large, with_row_index(df, ["k", "id"], small=True))
    assert large.agg(F.min("row_index"), F.max("row_index"), F.countDistinct("row_index")).first()[:] == (0, 8999, 9000)


def test_running_total_large_equals_small(spark):
    df = skewed(spark).withColumn("w", F.col("id") % 7)
    large = with_running_total(df, ["k", "id"], "w", "total", small=False)
    assert same(large, with_running_total(df, ["k", "id"], "w", "total", small=True))


def test_percentiles_large_equals_small(spark):
    df = skewed(spark)
    for by in ([], ["k"]):
        assert same(M.percentiles(df, "id", by, small=False), M.percentiles(df, "id", by))
    coarse = M.percentiles(df.filter("id > 0"), "id", digits=2).first()
    exact = M.percentiles(df.filter("id > 0"), "id").first()
    assert all(0.9 * exact[n] <= coarse[n] <= exact[n] for n in M.PERCENTILES)


def test_histogram_buckets(spark):
    numbers = sorted({s * (x + d) for b in range(63) for x in [1 << b] for d in (-1, 0, 1, x // 3) for s in (1, -1)} | {2**63 - 1, -(2**63)})
    for bits in (2, 8):
        low, high = M.bucket_bounds(F.col("bucket"), bits)
        df = spark.createDataFrame([(x,) for x in numbers], "v long").withColumn("bucket", M.bucket_of(F.col("v"), bits))
        rows = df.select("v", "bucket", low.alias("low"), high.alias("high")).orderBy("v").collect()
        assert all(r.low <= r.v <= r.high for r in rows)
        assert all(a.bucket <= b.bucket and (a.bucket == b.bucket) == (a.low == b.low) for a, b in zip(rows, rows[1:]))
        assert all(r.high - r.low < max(1, abs(r.v)) * 2.0 ** (1 - bits) for r in rows if r.v >= 0)
        assert rows[-1].bucket - rows[0].bucket < 2**bits * (65 - bits)


def test_histograms_merge_and_bound_percentiles(spark):
    df = skewed(spark).select("k", (F.col("id") * F.col("id") % 99991).alias("v"), (F.col("id") % 5).alias("chunk"))
    df = df.union(spark.createDataFrame([(7, None, 0), (None, 5, 1), (501, None, 1)], "k long, v long, chunk long"))
    for by in ([], ["k"]):
        packed = M.pack_histograms(M.histogram(df, "v", [*by, "chunk"]), [*by, "chunk"])
        merged = M.merge_histograms(M.unpack_histograms(packed, [*by, "chunk"]), by)
        assert same(merged, M.histogram(df, "v", by))
        found = {tuple(r[:-4]): r[-4:] for r in M.histogram_percentiles(merged, by).collect()}
        exact = {tuple(r[:-4]): r[-4:] for r in M.percentiles(df, "v", by).collect()}
        assert found.keys() == exact.keys() and (501,) not in found
        assert all(x <= y < x + max(1, x / 128) for key in exact for x, y in zip(exact[key], found[key]))
    assert M.histogram(df.limit(0), "v", ["k"]).count() == 0
    assert list(M.histogram_percentiles(M.histogram(df.limit(0), "v")).first()) == [None] * 4


def test_lookup_one_is_strict(spark):
    df = spark.range(3).select(F.col("id").alias("k"))
    twice = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (2, "d")], "k long, v string")
    with pytest.raises(Exception, match="found 2 rows"):
        lookup_one(df, twice, ["k"], "v").collect()
    with pytest.raises(Exception, match="found 0 rows"):
        lookup_one(df, twice.filter("k = 0"), ["k"], "v").collect()
    assert lookup_one(df, twice, ["k"], "v", strict=False).filter("v IS NULL").count() == 1


def test_weighted_choice_large_and_small_agree(spark, monkeypatch):
    import rowloom.operators.lookup as L

    items = spark.range(50).select("id", (F.col("id") % 5).alias("w"))
    df = spark.range(2000).select(F.col("id").alias("row"))
    draw = F.xxhash64("row")
    literal = weighted_choice(df, draw, items, "id", "w", ["id"], "item")
    picked = dictionary_pick(df, draw, items, "id", ["id"], "item")
    monkeypatch.setattr(L, "MAX_LITERALS", 10)
    assert same(weighted_choice(df, draw, items, "id", "w", ["id"], "item"), literal)
    assert same(dictionary_pick(df, draw, items, "id", ["id"], "item"), picked)
    assert literal.join(items.filter("w = 0"), literal["item"] == items["id"]).isEmpty()


def test_cross_product(spark):
    numbers = spark.range(20).select(F.col("id").alias("n"))
    texts = spark.createDataFrame([(t,) for t in "abcde"], "t string")
    letters = spark.createDataFrame([(c,) for c in "xyz"], "c string")
    made = cross_product(spark, (numbers, "n"), (texts, "t"), (letters, "c"))
    assert made.count() == 300 and made.distinct().count() == 300


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


TREE = [("leaf1", "twig"), ("leaf2", "twig"), ("twig", "branch"), ("branch", "trunk"), ("bird", "branch")]
DIAMOND = [("roof", "wall_e"), ("roof", "wall_w"), ("wall_e", "floor"), ("wall_w", "floor"), ("roof", "floor"), ("floor", "ground")]
LADDER = [(f"r{k}", f"r{j}") for k in range(9) for j in (k - 1, k - 3) if j >= 0]


@pytest.mark.parametrize("pairs", [TREE, DIAMOND, LADDER])
def test_parents_come_before_children(spark, pairs):
    order = [r["node"] for r in load_order(edges(spark, pairs)).collect()]
    assert all(order.index(p) < order.index(c) for c, p in pairs) and len(order) == len({n for e in pairs for n in e})
    back = [r["node"] for r in load_order(edges(spark, pairs), parents_first=False).collect()]
    assert all(back.index(c) < back.index(p) for c, p in pairs)


def test_levels_and_neighbours(spark):
    levels = dict(dependency_levels(edges(spark, DIAMOND)).collect())
    assert levels == {"ground": 0, "floor": 1, "wall_e": 2, "wall_w": 2, "roof": 3}
    assert {r[0] for r in adjacent(edges(spark, DIAMOND), "roof").collect()} == {"wall_e", "wall_w", "floor"}


def test_cycles(spark):
    cyclic = edges(spark, DIAMOND + [("ground", "roof"), ("moss", "stone")])
    with pytest.raises(ValueError, match="cycle"):
        dependency_levels(cyclic)
    assert {r[0] for r in cyclic_nodes(cyclic).collect()} == {"roof", "wall_e", "wall_w", "floor", "ground"}
    with pytest.raises(ValueError, match="self reference: category"):
        dependency_levels(edges(spark, [("category", "category")]))


def test_one_cycle(spark):
    ring = [(f"n{k:02}", f"n{(k + 1) % 23:02}") for k in range(23)]
    below, above = [("a", "b"), ("b", "n05"), ("n07", "z")], [("q", "r"), ("r", "q"), ("n03", "q")]
    found = one_cycle(edges(spark, ring + below)).collect()
    assert {tuple(r) for r in found} == set(ring)
    # the walk from n00 goes on to n04, not to q, as it takes the smallest parent
    assert {tuple(r) for r in one_cycle(edges(spark, ring + below + above)).collect()} == set(ring)
    assert {tuple(r) for r in one_cycle(edges(spark, above)).collect()} == {("q", "r"), ("r", "q")}
    assert one_cycle(edges(spark, DIAMOND)).count() == 0
    assert [tuple(r) for r in one_cycle(edges(spark, [("s", "s")])).collect()] == [("s", "s")]


def target(spark, rows="id long, v string", key=("id",)):
    return FileTarget.create(spark, scratch_path(spark, "t"), StructType.fromDDL(rows), key)


def test_conflict_modes_and_batch_ids(spark):
    t = target(spark)
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (2, "c", 2)], "id long, v string, at long")
    with pytest.raises(I.KeyConflict):
        I.ingest(rows, t, ["at"], "error")
    assert t.read().count() == 0
    assert I.ingest(rows, t, ["at"], "do_nothing", batch_id=0)
    assert not I.ingest(rows, t, ["at"], "do_nothing", batch_id=0)
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "b")}
    assert I.ingest(rows.withColumn("id", F.col("id") + 1), t, ["at"], "upsert", batch_id=1)
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "a"), (3, "c")}
    assert t.snapshot().batch_ids == {0, 1}
    with pytest.raises(ValueError):
        I.ingest(rows, t, ["at"], "merge")


def test_frequent_keys_are_cut_before_the_shuffle(spark):
    plan = I.first_per_key(skewed(spark), ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_error_policies(spark):
    df = spark.range(40).select(F.col("id").alias("row_index"), I.chunk_of(F.col("id"), 16).alias("chunk_id"))
    bad = F.col("row_index").isin(3, 20)
    kept = {m: I.apply_error_policy(df, bad, "IGNORE_AND_CONTINUE", m).count() for m in I.METHODS}
    assert kept == {"batch": 8, "array": 8, "singleton": 3 + 4 + 8}
    with pytest.raises(ValueError, match="bad row"):
        I.apply_error_policy(df, bad, "RETHROW")
    assert I.apply_error_policy(df, F.lit(False), "RETHROW").count() == 40
    good, rejected = I.split_rejects(df, bad)
    assert (good.count(), rejected.count()) == (38, 2)


def test_chunks(spark):
    chunked = I.assign_chunks(spark.range(32), ["id"], 16)
    assert chunked.groupBy("chunk_id").count().count() == 2
    packed = I.pack_columns(chunked, "chunk_id", ["row_index"], ["id"])
    assert packed.count() == 2 and same(I.unpack_columns(packed, "chunk_id", ["id"]), chunked.select("chunk_id", "id"))
    counts = {m: I.statements(I.assign_chunks(spark.range(300), ["id"], 200), m).agg(F.sum("n_statements")).first()[0] for m in I.METHODS}
    assert counts == {"batch": 3, "array": 2, "singleton": 300}


def test_width_check(spark):
    df = spark.range(1).select("id", F.lit(1).alias("v"))
    assert X.check_width(df, ["ID", "v"]) is df
    with pytest.raises(ValueError, match="2 columns in the stream, 3"):
        X.check_width(df, ["id", "v", "w"])
    with pytest.raises(ValueError, match="not in the table"):
        X.check_width(df, ["id", "w"])


def test_load_options(spark):
    path = scratch_path(spark, "csv")
    spark.range(5).select("id", F.lit("x").alias("v")).coalesce(1).write.csv(path)
    ddl = "id bigint, v string"
    assert X.load(spark, path, {"schema": ddl, "row_limit": "3"}).count() == 3
    assert X.load(spark, path, {"schema": ddl, "nullif": "x"}).filter("v IS NULL").count() == 5
    assert X.load(spark, path, {"schema": ddl, "skip": "4"}).count() == 1
    with pytest.raises(ValueError, match="unknown load options"):
        X.load(spark, path, {"schema": ddl, "odd": "1"})
    with pytest.raises(Exception):
        X.load(spark, path, {"schema": "id bigint, v bigint", "strict_validation": "true"}).collect()


def test_jdbc_options():
    assert jdbc_options("jdbc:x", "t")["batchsize"] == "128"
    assert jdbc_options("jdbc:x", "t", "singleton")["batchsize"] == "1"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "odd")


def test_generated_stream(spark):
    spec = TableSpec("s", (ColumnSpec("n", identity=Identity("sequence", 1, None, 1)), ColumnSpec("u", identity=Identity("uuid"))))
    stream = generated_stream(spark, spec, rows_per_batch=50, partitions=2)
    query = stream.writeStream.format("memory").queryName("generated").trigger(availableNow=True).start()
    query.awaitTermination()
    n, low, high = spark.table("generated").agg(F.count("n"), F.min("n"), F.max("n")).first()
    assert n > 0 and n % 50 == 0 and low == 1 and high == n


def test_shared_folder_setting_wins(spark):
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/named/"})
    assert shared_dir(named) == "/shared/named"
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(ValueError, match="shared by all executors"):
        shared_dir(cluster)
    local = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="local[2]", applicationId="b"))
    assert shared_dir(local) == shared_dir(local)


def test_upserts_are_resolved_and_compacted(spark, monkeypatch):
    monkeypatch.setattr(I, "MAX_UPSERT_SEGMENTS", 3)
    t = target(spark)
    t.append(spark.createDataFrame([(i, "base") for i in range(6)], "id long, v string"))
    expected = {i: "base" for i in range(6)}
    for n in range(4):
        batch = [(i, f"b{n}-{at}", at) for at, i in enumerate((n, n + 1, n, 10 + n))]
        I.ingest(spark.createDataFrame(batch, "id long, v string, at long"), t, ["at"], "upsert", batch_id=n)
        expected.update({i: v for i, v, _ in batch})
        assert dict(t.read().collect()) == expected
        assert {r[0] for r in t.keys().collect()} == set(expected)
    assert len(t.snapshot().segments) == 2 and len(t.snapshot().deletes) == 1 and t.snapshot().batch_ids == {0, 1, 2, 3}


def test_two_error_policies(spark):
    df = spark.range(48).select(F.col("id").alias("row_index"), I.chunk_of(F.col("id"), 16).alias("chunk_id"))
    transient, permanent = F.col("row_index") == 3, F.col("row_index") == 20
    assert I.apply_error_policies(df, transient, permanent, permanent_policy="IGNORE_AND_CONTINUE").count() == 16
    with pytest.raises(ValueError, match="bad row"):
        I.apply_error_policies(df, transient, permanent)


def test_reconcile_contents(spark):
    rows = [(k, str(k % 7), None if k % 5 else k) for k in range(300)] + [(1, "1", None)] * 2 + [(None, None, None)]
    other = [r for r in rows if r[0] != 40] + [(40, None, 40), (1, "1", None), (999, "new", 1)]
    shape = "id long, v string, n long"
    want = Counter(rows), Counter(other)
    for buckets in (1, 16, 4096):
        found = M.reconcile_contents(spark.createDataFrame(rows, shape), spark.createDataFrame(other, shape), ["id"], buckets)
        assert {tuple(r) for r in found.collect()} == {(*k, want[0][k], want[1][k]) for k in {*rows, *other} if want[0][k] != want[1][k]}
    # a null that changes its column, and no rows at all
    shape = "id long, a string, b string"
    left, right = spark.createDataFrame([(1, "x", None)], shape), spark.createDataFrame([(1, None, "x")], shape)
    assert M.reconcile_contents(left, right, ["id"]).count() == 2
    assert M.reconcile_contents(left, left, ["id"]).count() == M.reconcile_contents(left.limit(0), left.limit(0), ["id"]).count() == 0
