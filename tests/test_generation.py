"""Invariants of generated data: the same rows whatever the partitioning, keys, ranges, weights."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowloom.draws import cell_draw, unit
from rowloom.functions import random_values as rv
from rowloom.functions import temporal
from rowloom.plans.database import generate_database, spec_order
from rowloom.plans.generate import generate, parallel_load, preview, row_index
from rowloom.plans.spec import Call, ColumnSpec, ForeignKey, Identity, Range, TableSpec, ValueSet

MIXED = TableSpec("mixed", (
    ColumnSpec("id", identity=Identity("unordered")), ColumnSpec("uuid", identity=Identity("uuid")),
    ColumnSpec("name", call=Call("randomFullName")), ColumnSpec("code", call=Call("randomString", (5, 90))),
    ColumnSpec("amount", call=Call("randomBigDecimal", (-5, 5, 3))),
    ColumnSpec("text", call=Call("randomLoreIpsum", (1, 5, True))),
    ColumnSpec("day", range=Range("date", "2020-01-31", None, 1, "MONTHS")),
    ColumnSpec("kind", value_set=ValueSet(("a", "b"), (1, 3))), ColumnSpec("calc", expression="row_number * 2"),
), "2k")


@pytest.mark.parametrize("partitions", [4, 13])
def test_rows_do_not_depend_on_partitions(spark, partitions):
    one = generate(spark, MIXED, partitions=1)
    many = generate(spark, MIXED, partitions=partitions)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_a_column_does_not_depend_on_the_others(spark):
    alone = generate(spark, TableSpec("mixed", (MIXED.column("name"),), "2k"))
    assert alone.exceptAll(generate(spark, MIXED).select("name")).isEmpty()


def test_seed_and_label_matter(spark):
    frame = spark.range(1000).select(*[cell_draw(F.col("id"), label, seed).alias(f"c{i}")
                                       for i, (label, seed) in enumerate([("a", 1), ("a", 2), ("b", 1)])])
    assert frame.filter("c0 = c1 OR c0 = c2").isEmpty()


def test_keys_are_unique(spark):
    made = generate(spark, MIXED, rows=50_000)
    row = made.agg(F.countDistinct("id").alias("ids"), F.countDistinct("uuid").alias("uuids")).first()
    assert (row["ids"], row["uuids"]) == (50_000, 50_000)
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    assert made.filter(~F.col("uuid").rlike(shape)).isEmpty()


def test_unordered_ids_stay_unique_across_blocks(spark):
    ids = spark.range(2**31 - 1000, 2**31 + 1000).select(rv.row_id_unordered(F.col("id")).alias("v"))
    assert ids.distinct().count() == 2000


def test_draws_are_uniform(spark):
    row = spark.range(200_000).select(unit(cell_draw(F.col("id"), "u")).alias("u")).agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u")).first()
    assert abs(row[0] - 0.5) < 0.005 and abs(row[1] - 0.2887) < 0.005 and row[2] >= 0 and row[3] < 1


def test_weights_hold(spark):
    draw = cell_draw(F.col("id"), "w")
    counts = dict(spark.range(100_000).groupBy(rv.weighted_pick(draw, ["x", "y", "z"], [1, 2, 7]).alias("v")).count().collect())
    assert abs(counts["x"] - 10_000) < 600 and abs(counts["y"] - 20_000) < 800 and abs(counts["z"] - 70_000) < 1000


@pytest.mark.parametrize("length", [0, 1, 7, 16, 64, 65, 255, 700])
def test_string_lengths(spark, length):
    made = spark.range(300).select(rv.string(cell_draw(F.col("id"), "s"), length).alias("s"))
    assert made.filter(~F.col("s").rlike(f"^[0-9A-Za-z]{{{length}}}$")).isEmpty()


def test_string_letters_are_uniform(spark):
    for length in (60, 300):
        made = spark.range(4000).select(rv.string(cell_draw(F.col("id"), "s"), length).alias("s"))
        counts = [r["count"] for r in made.select(F.explode(F.split("s", ""))).groupBy("col").count().collect()]
        expected = 4000 * length / 62
        assert len(counts) == 62 and all(abs(c - expected) < 0.1 * expected for c in counts)


def test_value_shapes(spark):
    draw = cell_draw(F.col("id"), "v")
    shapes = {
        "phone": (rv.phone_number(draw), r"^\([1-9]\d\d\) [1-9]\d\d-\d{4}$"),
        "zip": (rv.zip_code(draw), r"^\d{5}$"),
        "email": (rv.email(draw), r"^[a-z]+\.[a-z]+@example\.com$"),
        "ipv4": (rv.ipv4(draw), r"^(\d{1,3}\.){3}\d{1,3}$"),
        "ipv6": (rv.ipv6(draw), r"^([0-9a-f]{4}:){7}[0-9a-f]{4}$"),
        "word": (rv.word(draw, 9), r"^([aeiou][b-df-hj-np-tv-z]){4}[aeiou]$"),
        "city": (rv.city(draw), r"^[A-Z]"),
        "time": (temporal.time_text(temporal.random_time(draw, F.lit(0))), r"^\d\d:\d\d:\d\d$"),
    }
    made = spark.range(2000).select(*[c.alias(n) for n, (c, _) in shapes.items()])
    for name, (_, pattern) in shapes.items():
        assert made.filter(~F.col(name).rlike(pattern)).isEmpty(), name


@pytest.mark.parametrize("lo,hi,scale", [(0, 18, 2), (-3, 4, 0), (0, 10**17, 2), (0, 10**28, 9), (0, 10**36, 2)])
def test_decimal_ranges(spark, lo, hi, scale):
    made = spark.range(500).select(rv.decimal(cell_draw(F.col("id"), "d"), lo, hi, scale).alias("d"))
    low, high, n = made.agg(F.min("d"), F.max("d"), F.countDistinct("d")).first()
    assert lo <= low and high < hi and n > 5


def test_empty_ranges_are_refused(spark):
    draw = cell_draw(F.col("id"), "x")
    for make in (lambda: rv.integer(draw, 5, 5), lambda: rv.decimal(draw, 2, 1), lambda: rv.double(draw, 1.0, 0.0),
                 lambda: rv.pick(draw, []), lambda: rv.weighted_pick(draw, ["a"], [])):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(Exception, match="empty range"):
        spark.range(3).select(rv.integer(draw, F.col("id"), F.col("id"))).collect()


def test_month_steps_stay_clamped(spark):
    days = [r[0] for r in spark.range(4).select(temporal.date_range(F.col("id"), dt.date(2024, 1, 31), None, 1, "MONTHS")).collect()]
    assert days == [dt.date(2024, 2, 29), dt.date(2024, 3, 29), dt.date(2024, 4, 29), dt.date(2024, 5, 29)]
    far = spark.range(4799, 4800).select(temporal.date_range(F.col("id"), dt.date(2024, 1, 31), None, 1, "MONTHS")).first()[0]
    assert far == dt.date(2424, 1, 28)


def test_ranges_start_over(spark):
    values = [r[0] for r in spark.range(4).select(temporal.date_range(F.col("id"), dt.date(2024, 1, 1), dt.date(2024, 1, 3))).collect()]
    assert values == [dt.date(2024, 1, d) for d in (2, 3, 1, 2)]
    with pytest.raises(ValueError):
        temporal.date_range(F.col("id"), dt.date(2024, 1, 2), dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        temporal.date_range(F.col("id"), dt.date(2024, 1, 2), unit="HOURS")


def test_parallel_load_numbers_run_on(spark):
    spec = TableSpec("t", (ColumnSpec("n", identity=Identity("sequence", 1, None, 1)),), "10k")
    made = parallel_load(spark, spec, 6)
    assert made.rdd.getNumPartitions() == 6
    assert made.agg(F.count("n"), F.countDistinct("n"), F.max("n")).first()[:] == (60_000, 60_000, 60_000)


def test_database_has_no_orphans(spark):
    specs = [
        TableSpec("transaction_item", (
            ColumnSpec("transaction_id", foreign_key=ForeignKey("transaction", "id")),
            ColumnSpec("account_id", foreign_key=ForeignKey("account", "id")),
        ), 5000),
        TableSpec("transaction", (ColumnSpec("id", identity=Identity("uuid")),), 400),
        TableSpec("account", (
            ColumnSpec("id", identity=Identity("uuid")), ColumnSpec("owner", foreign_key=ForeignKey("owner", "code")),
        ), 100),
        TableSpec("owner", (ColumnSpec("code", expression="concat('o', row_number)"),), 20),
    ]
    made = generate_database(spark, specs)
    order = list(made)
    assert order.index("owner") < order.index("account") < order.index("transaction_item")
    items = made["transaction_item"]
    for child, column, parent, key in (("transaction_item", "transaction_id", "transaction", "id"),
                                       ("transaction_item", "account_id", "account", "id"), ("account", "owner", "owner", "code")):
        keys = made[parent].select(F.col(key).alias(column))
        assert made[child].join(keys, column, "left_anti").isEmpty()
    assert items.count() == 5000


def test_formula_keys_need_no_join(spark):
    specs = [
        TableSpec("p", (ColumnSpec("id", identity=Identity("uuid")),), 100),
        TableSpec("c", (ColumnSpec("p_id", foreign_key=ForeignKey("p", "id")),), 1000),
    ]
    plan = generate_database(spark, specs)["c"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_cycles_are_refused():
    def table(name, parent):
        return TableSpec(name, (ColumnSpec("k", foreign_key=ForeignKey(parent, "k")),), 1)

    with pytest.raises(ValueError, match="cycle"):
        spec_order([table("a", "b"), table("b", "a")])
    with pytest.raises(ValueError, match="self reference"):
        spec_order([table("a", "a")])


def test_unused_columns_are_pruned(spark):
    plan = generate(spark, MIXED).select("name")._jdf.queryExecution().executedPlan().toString()
    assert "lorem" not in plan and "Exchange" not in plan


def test_preview_and_row_index(spark):
    assert preview(generate(spark, MIXED), 7).count() == 7
    assert preview(row_index(spark, 5), 5, transpose=True).count() == 5
