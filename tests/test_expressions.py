"""Expression cases as Spark SQL, and the functions of the catalogue."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowloom.functions import money as M
from rowloom.functions import registry as R
from rowloom.functions.scalar import count_of, divide_keep_scale, integer_power, parse_count, parse_count_decimal, trim
from rowloom.functions.temporal import parse_time, plus_date, plus_datetime, plus_time, time_text

# One case per rule: each operator, what binds tighter, grouping, signs, functions inside each other.
ARITHMETIC = [
    ("17 + 25", 42), ("17 - 25", -8), ("6 * 7", 42), ("45 / 8", 5.625), ("45 % 8", 5), ("-45 % 8", -5), ("7 - 3 - 2", 2),
    ("64 / 4 / 2", 8), ("3 + 4 * 5", 23), ("(3 + 4) * 5", 35), ("20 - 6 / 3", 18), ("((9 - 4) * (1 + 1)) % 7", 3),
    ("-(8 - 11)", 3), ("12.75 + 0.3", 13.05), ("least(31, 13, 22)", 13), ("greatest(least(4, 9), 6) * 2", 12),
    ("pow(5, 3) - sqrt(81)", 116), ("abs(-2.5) * 4", 10),
]
CONDITIONS = [
    ("if(y between 9 and 11, y * y, 0)", 100), ("if(x >= y or y = 10, 'one', 'two')", "one"),
    ("if(x >= y and y = 10, 'one', 'two')", "two"), ("if(not (x > y), x, y)", 5), ("if(x <> 5, 'far', 'near')", "near"),
    ("if(date'2023-03-01' > date'2023-02-28' and 'b' < 'c', 7, 8)", 7), ("if('pear' in ('fig', 'pear'), 3, 4)", 3),
    ("if(x in (1, 2, 3), 3, 4)", 4), ("concat(if(y > x, 'up', 'down'), '-', y)", "up-10"),
    ("case when x > y then 1 when x = y then 2 else 3 end", 3), ("coalesce(nullif(x, 5), y)", 10),
]
REFUSED = ["7 +", "* 7", "(7", "7)", "7 7 7", "'seven' * true", "noSuchName + 1", "if(1, 2, 3)", "pow(2)"]


@pytest.mark.parametrize("text,expected", ARITHMETIC + CONDITIONS)
def test_expression(spark, text, expected):
    value = spark.range(1).select(F.lit(5).alias("x"), F.lit(10).alias("y")).select(F.expr(text)).first()[0]
    assert value == expected if isinstance(expected, str) else abs(float(value) - expected) < 1e-9


@pytest.mark.parametrize("text", REFUSED)
def test_refused_expression(spark, text):
    with pytest.raises(Exception):
        spark.range(1).select(F.expr(text)).collect()


@pytest.mark.parametrize("text,expected", [
    ("42", 42), (".25", ".25"), ("-.75", "-.75"), ("+3.5", "3.5"), ("2.25k", 2250), ("0.125m", 125000), ("7 G", 7 * 10**9),
    ("12.M", 12 * 10**6), ("1.2345678G", 1234567800), ("1_500.5 K", 1500500), ("-8k", -8000), ("0.123456789", "0.123456789"),
])
def test_decimal_counts(spark, text, expected):
    assert spark.range(1).select(parse_count_decimal(F.lit(text), 9)).first()[0] == Decimal(str(expected))


@pytest.mark.parametrize("text", ["3KK", "3T", "G", "", ".", "k 3"])
def test_bad_counts(spark, text):
    with pytest.raises(ValueError):
        count_of(text)
    for parse in (parse_count, parse_count_decimal):
        with pytest.raises(Exception, match="not a count"):
            spark.range(1).select(parse(F.lit(text))).collect()


def test_counts_on_the_driver(spark):
    given = ["10k", "2 M", "1G", "1_5", "-5k"]
    assert [count_of(t) for t in given] == [10_000, 2 * 10**6, 10**9, 15, -5000] and count_of(7) == 7
    assert [r[0] for r in spark.createDataFrame([(t,) for t in given], "t string").select(parse_count(F.col("t"))).collect()] == [count_of(t) for t in given]


@pytest.mark.parametrize("left,right,expected", [
    ("1", "2", "0"), ("3", "2", "2"), ("1.0", "2.0", "0.5"), ("5", "2", "2"), ("7", "2", "4"), ("-3", "2", "-2"), ("-7", "2", "-4"),
    ("10.00", "3", "3.33"), ("20.00", "3", "6.67"), ("0.125", "1", "0.125"), ("1.05", "0.1", "10.50"),
])
def test_division_keeps_the_left_scale(spark, left, right, expected):
    df = spark.range(1).select(F.lit(Decimal(left)).alias("l"), F.lit(Decimal(right)).alias("r"))
    value = df.select(divide_keep_scale(df, "l", "r")).first()[0]
    assert value == Decimal(expected) and value.as_tuple().exponent == Decimal(left).as_tuple().exponent


def test_division_by_zero_raises(spark):
    df = spark.range(1).select(F.lit(Decimal("1")).alias("l"), F.lit(Decimal("0")).alias("r"))
    with pytest.raises(Exception, match="ZERO"):
        df.select(divide_keep_scale(df, "l", "r")).collect()


def test_powers_take_whole_exponents(spark):
    one = spark.range(1).select(integer_power(F.lit(Decimal("1.5")), 3, "decimal(38,6)")).first()[0]
    assert one == Decimal("3.375")
    with pytest.raises(ValueError):
        integer_power(F.lit(2), -1, "decimal(38,0)")


def test_temporal_units(spark):
    with pytest.raises(ValueError):
        plus_date(F.current_date(), 1, "HOURS")
    with pytest.raises(ValueError):
        plus_time(F.lit(0), 1, "DAYS")
    with pytest.raises(ValueError):
        plus_time(F.lit(0), 500, "MILLIS")  # would be lost
    row = spark.range(1).select(
        plus_date(F.lit("2024-01-31").cast("date"), 1, "MONTHS"), time_text(plus_time(F.lit(parse_time("23:30:00")), 1, "HOURS")),
        plus_datetime(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 10**10, "SECONDS"), trim(F.lit("\t a \x01\n")),
    ).first()
    assert str(row[0]) == "2024-02-29" and row[1] == "00:30:00" and row[3] == "a"
    assert row[2] == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=10**10)


SQL_FORMS = [
    ("randomString", "randomString(draw, 12)", (12,)), ("randomString", "randomString(draw, 200)", (200,)),
    ("randomString", "randomString(draw, 3, 41)", (3, 41)), ("randomWord", "randomWord(draw, 30)", (30,)), ("randomWord", "randomWord(draw, 200)", (200,)),
    ("randomBytes", "randomBytes(draw, 20)", (20,)), ("randomLoreIpsum", "randomLoreIpsum(draw, 3, 9)", (3, 9)),
    ("randomLoreIpsum", "randomLoreIpsum(draw, 1, 3, true)", (1, 3, True)), ("randomJson", "randomJson(draw, 2, 2)", (2, 2)),
    ("randomDate", "randomDate(draw, date'2024-01-01')", ("2024-01-01",)),
    ("randomTime", "randomTime(draw, timestamp_ntz'2024-01-01 10:20:30')", ("10:20:30",)),
    ("randomDateTime", "randomDateTime(draw, timestamp_ntz'2024-01-01 10:20:30')", ("2024-01-01 10:20:30",)),
    ("selectRandom", "selectRandom(draw, array('a', 'b'))", ("a", "b")), ("randomBytesBase64", "randomBytesBase64(draw, 90)", (90,)),
    ("randomBigDecimal", "randomBigDecimal(draw, 3, 77)", (3, 77)), ("randomInt", "randomInt(draw, -5, 5)", (-5, 5)),
    ("randomBigDecimal", "randomBigDecimal(draw, 0.5, 1.75)", ("0.5", "1.75")),
] + [(n, f"{n}(draw)", ()) for n in (
    "randomFirstName", "randomLastName", "randomFullName", "randomCity", "randomCountry", "randomEmail", "randomPhoneNumber",
    "randomState", "randomStateCode", "randomZipCode", "randomCurrency", "randomMoney", "randomBoolean", "randomInt", "randomLong",
    "randomDouble", "randomUUID", "randomIPv4", "randomIPv6", "randomFact", "randomBigDecimal",
)]


def test_sql_functions_equal_column_builders(spark):
    R.register_functions(spark)
    drawn = spark.range(200).selectExpr("id", "xxhash64(id) AS draw")
    for name, text, args in SQL_FORMS:
        pair = drawn.select(F.expr(text).alias("a"), R.build_call(F.col("draw"), name, *args).alias("b"))
        assert pair.filter("NOT (a <=> b)").isEmpty(), text


@pytest.mark.parametrize("text", ["randomInt(draw, 10, 5)", "randomLong(draw, 3, 3)", "randomDouble(draw, 10, 5)", "randomBigDecimal(draw, 2, 1)"])
def test_empty_ranges_raise_in_sql(spark, text):
    R.register_functions(spark)
    with pytest.raises(Exception, match="empty range"):
        spark.range(3).selectExpr("xxhash64(id) AS draw").select(F.expr(text)).collect()


def test_decimal_bounds_finer_than_the_scale(spark):
    drawn = spark.range(500).selectExpr("xxhash64(id) AS draw")
    found = {r[0] for r in drawn.select(R.build_call(F.col("draw"), "randomBigDecimal", "0.005", "0.045", 2)).collect()}
    assert found == {Decimal("0.01"), Decimal("0.02"), Decimal("0.03"), Decimal("0.04")}
    with pytest.raises(ValueError, match="no value"):
        R.build_call(F.col("draw"), "randomBigDecimal", "0.011", "0.019", 2)


def test_money_by_fractions(spark):
    usd = F.lit("USD")
    amount = spark.range(1).select(
        M.money_divide_round(F.lit(Decimal("100")), usd, F.lit(Decimal("2.5"))), M.money_divide_round(F.lit(Decimal("100")), usd, F.lit(Decimal("0.4"))),
        M.money_divide_round(F.lit(Decimal("-7.01")), usd, F.lit(3.125)), M.money_divide(F.lit(Decimal("100")), usd, F.lit(Decimal("2.5"))),
        M.money_multiply(F.lit(Decimal(10**9)), usd, F.lit(Decimal("1.000000001"))), M.money_multiply(F.lit(Decimal("9.99")), usd, F.lit(Decimal("0.123456789012"))),
    ).first()
    assert list(amount) == [Decimal(x) for x in ("40", "250", "-2.24", "40", "1000000001", "1.23")]
    with pytest.raises(Exception, match="too many digits"):
        spark.range(1).select(M.money_multiply(F.lit(Decimal("1")), usd, F.lit(Decimal("0.1234567890123")))).collect()
    with pytest.raises(Exception, match="not exact"):
        spark.range(1).select(M.money_divide(F.lit(Decimal("100")), usd, F.lit(Decimal("3")))).collect()


def test_catalogue(spark):
    listed = R.functions_df(spark)
    assert listed.columns == ["name", "category", "args", "returns", "doc"]
    assert listed.select("name").distinct().count() == listed.count()
    with pytest.raises(ValueError, match="unknown function"):
        R.build_call(F.lit(1), "noSuchFunction")
