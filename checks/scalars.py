"""Temporal, text, math and conditional functions over the given tables' columns."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from checks import duck as D
from checks.registry import Tables, check
from rowloom.draws import cell_draw
from rowloom.functions import scalar as S
from rowloom.functions import temporal as T
from rowloom.functions.registry import register_functions, register_sql_function

# -- temporal ------------------------------------------------------------------


def signed(draw: str, n: int) -> str:
    size = f"({D.bits(draw)}//2)%{n}"
    return f"(CASE WHEN {D.bits(draw)}%2=0 THEN {size} ELSE -({size}) END)"


EVENTS = ("events", "event_id")


@check("random_date", f"SELECT id, ts::DATE + {signed('d', 90)}::INT AS value FROM {D.rows(*EVENTS, 'e.date', 'ts')}")
def random_date(t: Tables):
    value = T.random_date(cell_draw(F.col("event_id"), "e.date"), F.col("ts").cast("date"))
    return t.events.select(F.col("event_id").alias("id"), value.alias("value"))


@check(
    "random_time",
    f"""SELECT id, strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(((hour(ts)*3600+minute(ts)*60+second(ts)
        + {signed('d', 24)}*3600) % 86400 + 86400) % 86400), '%H:%M:%S') AS value
        FROM {D.rows(*EVENTS, 'e.time', 'ts')}""",
)
def random_time(t: Tables):
    value = T.random_time(cell_draw(F.col("event_id"), "e.time"), T.seconds_of_day(F.col("ts")))
    return t.events.select(F.col("event_id").alias("id"), T.time_text(value).alias("value"))


@check(
    "random_datetime",
    f"""SELECT id, ts + to_days({signed(D.slot('d', 1), 90)}::INT) + to_hours({signed(D.slot('d', 2), 24)}) AS value
        FROM {D.rows(*EVENTS, 'e.moment', 'ts')}""",
)
def random_datetime(t: Tables):
    value = T.random_datetime(cell_draw(F.col("event_id"), "e.moment"), F.col("ts"))
    return t.events.select(F.col("event_id").alias("id"), value.alias("value"))


@check("current_values")
def current_values(t: Tables):
    return t.customer.select(
        "c_custkey", T.current_date().alias("day"), T.time_text(T.current_time()).alias("clock"),
        T.current_datetime().alias("moment"),
    )


@check(
    "plus_date",
    """SELECT o_orderkey, day + (o_orderkey % 40)::INT AS plus_days, day + ((o_orderkey % 9) * 7)::INT AS plus_weeks,
        (day + to_months((o_orderkey % 25)::INT))::DATE AS plus_months,
        (day + to_years((o_orderkey % 5)::INT))::DATE AS plus_years,
        (day + to_years(10 * (o_orderkey % 3)::INT))::DATE AS plus_decades
        FROM (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders) src""",
)
def plus_date(t: Tables):
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", T.plus_date(day, key % 40, "DAYS").alias("plus_days"),
        T.plus_date(day, key % 9, "WEEKS").alias("plus_weeks"), T.plus_date(day, key % 25, "MONTHS").alias("plus_months"),
        T.plus_date(day, key % 5, "YEARS").alias("plus_years"), T.plus_date(day, key % 3, "DECADES").alias("plus_decades"),
    )


@check(
    "plus_time",
    """SELECT event_id, (s + event_id % 500 * 60) % 86400 AS plus_minutes,
        ((s - event_id % 30 * 3600) % 86400 + 86400) % 86400 AS minus_hours,
        (s + event_id % 3 * 43200) % 86400 AS plus_half_days
        FROM (SELECT event_id, hour(ts)*3600+minute(ts)*60+second(ts) AS s FROM events) src""",
)
def plus_time(t: Tables):
    s, key = T.seconds_of_day(F.col("ts")), F.col("event_id")
    return t.events.select(
        "event_id", T.plus_time(s, key % 500, "MINUTES").alias("plus_minutes"),
        T.plus_time(s, -(key % 30), "HOURS").alias("minus_hours"),
        T.plus_time(s, key % 3, "HALF_DAYS").alias("plus_half_days"),
    )


@check(
    "plus_datetime",
    """SELECT event_id, ts + to_seconds(event_id % 100000) AS plus_seconds, ts - to_hours(event_id % 77) AS minus_hours,
        ts + to_days((event_id % 50)::INT) AS plus_days, ts + to_months((event_id % 30)::INT) AS plus_months,
        ts + to_milliseconds(event_id % 5000) AS plus_millis FROM events""",
)
def plus_datetime(t: Tables):
    ts, key = F.col("ts"), F.col("event_id")
    return t.events.select(
        "event_id", T.plus_datetime(ts, key % 100000, "SECONDS").alias("plus_seconds"),
        T.plus_datetime(ts, -(key % 77), "HOURS").alias("minus_hours"),
        T.plus_datetime(ts, key % 50, "DAYS").alias("plus_days"),
        T.plus_datetime(ts, key % 30, "MONTHS").alias("plus_months"),
        T.plus_datetime(ts, key % 5000, "MILLIS").alias("plus_millis"),
    )


# -- text -------------------------------------------------------------------------


def text_query(name: str, make, sql: str, table: str = "documents", key: str = "doc_id", column: str = "text"):
    @check(name, f"SELECT {key}, {sql} AS value FROM {table}")
    def run(t: Tables):
        return getattr(t, table).select(key, make(F.col(column)).alias("value"))


text_query("lower_case", S.lower_case, "lower(p_name)", "part", "p_partkey", "p_name")
text_query("upper_case", S.upper_case, "upper(p_name)", "part", "p_partkey", "p_name")
text_query("capitalize", S.capitalize, "upper(substr(text, 1, 1)) || substr(text, 2)")
text_query("capitalize_lower", lambda c: S.capitalize(c, lower_all=True), "lower(c_name)", "customer", "c_custkey", "c_name")
text_query("trim", lambda c: S.trim(F.concat(F.lit("\t \n"), c, F.lit(" \r\n"))),
           r"regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')")
text_query("trim_lower", lambda c: S.trim(F.concat(F.lit("\t "), c, F.lit(" \n")), lower_all=True), "lower(p_name)",
           "part", "p_partkey", "p_name")
text_query("base64", lambda c: S.to_base64(c.cast("binary")), "to_base64(encode(text))")
text_query("from_base64", lambda c: S.from_base64(S.to_base64(c.cast("binary"))).cast("string"), "text")
text_query("concat_text", lambda c: S.concat_text(c, F.lit(" #")), "c_name || ' #'", "customer", "c_custkey", "c_name")

# -- math ---------------------------------------------------------------------------


@check("pow", "SELECT l_orderkey, l_linenumber, pow(l_linenumber::DOUBLE, 3) AS cubed, pow(l_quantity, 2) AS squared FROM lineitem")
def pow_(t: Tables):
    cubed = S.power(F.col("l_linenumber").cast("double"), F.lit(3))
    return t.lineitem.select("l_orderkey", "l_linenumber", cubed.alias("cubed"), S.power(F.col("l_quantity"), F.lit(2)).alias("squared"))


@check("sqrt", "SELECT o_orderkey, sqrt(o_totalprice) AS value FROM orders")
def sqrt(t: Tables):
    return t.orders.select("o_orderkey", S.root(F.col("o_totalprice")).alias("value"))


@check("constants_pi_e", "SELECT p_partkey, pi() * p_size AS half_turns, 2.718281828459045::DOUBLE * p_size AS e_times FROM part")
def constants(t: Tables):
    return t.part.select(
        "p_partkey", (S.pi() * F.col("p_size")).alias("half_turns"), (S.euler() * F.col("p_size")).alias("e_times")
    )


PRICE, COUNT = "decimal(12,2)", "decimal(5,0)"
LINES = """(SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12,2) AS price, l_tax::DECIMAL(12,2) AS tax,
    l_quantity::DECIMAL(5,0) AS n FROM lineitem) src"""


def lines(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(PRICE).alias("price"),
        F.col("l_tax").cast(PRICE).alias("tax"), F.col("l_quantity").cast(COUNT).alias("n"),
    )


@check("plus_minus", f"SELECT l_orderkey, l_linenumber, price + tax AS total, price - tax AS net FROM {LINES}")
def plus_minus(t: Tables):
    return lines(t).select(
        "l_orderkey", "l_linenumber", (F.col("price") + F.col("tax")).alias("total"), (F.col("price") - F.col("tax")).alias("net")
    )


@check("multiply", f"SELECT l_orderkey, l_linenumber, (price * n)::DECIMAL(18,2) AS value FROM {LINES}")
def multiply(t: Tables):
    return lines(t).select("l_orderkey", "l_linenumber", (F.col("price") * F.col("n")).cast("decimal(18,2)").alias("value"))


@check(
    "divide_keep_scale",
    f"""WITH whole AS (SELECT l_orderkey, l_linenumber, (price * 100)::BIGINT AS a, n::BIGINT AS b FROM {LINES}),
        parts AS (SELECT *, a // b AS q, a % b AS r FROM whole)
        SELECT l_orderkey, l_linenumber,
          ((q + CASE WHEN 2 * r > b OR (2 * r = b AND q % 2 = 1) THEN 1 ELSE 0 END) * 0.01::DECIMAL(2,2))::DECIMAL(13,2)
          AS value FROM parts""",
)
def divide_keep_scale(t: Tables):
    df = lines(t)
    return df.select("l_orderkey", "l_linenumber", S.divide_keep_scale(df, "price", "n").alias("value"))


@check(
    "divide_whole_numbers",
    """WITH parts AS (SELECT p_partkey, p_size // 4 AS q, p_size % 4 AS r FROM part)
       SELECT p_partkey, (q + CASE WHEN r > 2 OR (r = 2 AND q % 2 = 1) THEN 1 ELSE 0 END)::DECIMAL(6,0) AS value FROM parts""",
)
def divide_whole(t: Tables):
    df = t.part.select("p_partkey", F.col("p_size").cast("decimal(5,0)").alias("a"), F.lit(Decimal(4)).cast("decimal(3,0)").alias("b"))
    return df.select("p_partkey", S.divide_keep_scale(df, "a", "b").alias("value"))


@check("integer_power", f"SELECT l_orderkey, l_linenumber, (tax * tax * tax)::DECIMAL(38,6) AS value FROM {LINES}")
def integer_power(t: Tables):
    return lines(t).select("l_orderkey", "l_linenumber", S.integer_power(F.col("tax"), 3, "decimal(38,6)").alias("value"))


@check("min_max", "SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem")
def min_max(t: Tables):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", S.smaller(a, b).alias("lo"), S.larger(a, b).alias("hi"))


@check("modulo", "SELECT l_orderkey, l_linenumber, (l_suppkey - l_partkey) % 7 AS value FROM lineitem")
def modulo(t: Tables):
    value = S.remainder(F.col("l_suppkey") - F.col("l_partkey"), F.lit(7))
    return t.lineitem.select("l_orderkey", "l_linenumber", value.alias("value"))


@check(
    "unary_and_precedence",
    """SELECT p_partkey, -(p_size + 2) AS negated_sum, +p_size AS same, p_size % (4 - 2) AS modulo_of_difference,
       least(p_size, 5 - 2) AS min_of_difference, (p_size + 1) * 2 AS grouped FROM part""",
)
def unary(t: Tables):
    return t.part.select("p_partkey", *[F.expr(e) for e in (
        "-(p_size + 2) AS negated_sum", "+p_size AS same", "p_size % (4 - 2) AS modulo_of_difference",
        "least(p_size, 5 - 2) AS min_of_difference", "(p_size + 1) * 2 AS grouped",
    )])


# -- comparisons and conditions --------------------------------------------------------


COMPARED = ("gt", "ge", "lt", "le", "eq", "ne")
SIGNS = (">", ">=", "<", "<=", "=", "<>")


def compared(left, right):
    pairs = (left > right, left >= right, left < right, left <= right, left == right, left != right)
    return [p.alias(n) for n, p in zip(COMPARED, pairs)]


def compared_sql(left: str, right: str) -> str:
    return ", ".join(f"({left} {s} {right}) AS {n}" for n, s in zip(COMPARED, SIGNS))


@check("compare_numbers", f"SELECT l_orderkey, l_linenumber, {compared_sql('l_quantity', '25')} FROM lineitem")
def compare_numbers(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", *compared(F.col("l_quantity"), F.lit(25)))


@check("compare_dates", f"SELECT o_orderkey, {compared_sql('o_orderdate::DATE', 'DATE ' + repr('1996-06-15'))} FROM orders")
def compare_dates(t: Tables):
    return t.orders.select("o_orderkey", *compared(F.col("o_orderdate").cast("date"), F.lit(dt.date(1996, 6, 15))))


@check("compare_times", f"SELECT event_id, {compared_sql('ts::TIME', 'TIME ' + repr('12:00:00'))} FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) src")
def compare_times(t: Tables):
    return t.events.select("event_id", *compared(T.seconds_of_day(F.col("ts")), F.lit(T.parse_time("12:00:00"))))


@check("compare_datetimes", f"SELECT event_id, {compared_sql('ts', 'TIMESTAMP ' + repr('2024-01-15 12:00:05'))} FROM events")
def compare_datetimes(t: Tables):
    return t.events.select("event_id", *compared(F.col("ts"), F.lit("2024-01-15 12:00:05").cast("timestamp_ntz")))


@check("compare_text", f"SELECT c_custkey, {compared_sql('c_mktsegment', repr('FURNITURE'))} FROM customer")
def compare_text(t: Tables):
    return t.customer.select("c_custkey", *compared(F.col("c_mktsegment"), F.lit("FURNITURE")))


@check("in_list", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS value FROM customer")
def in_list(t: Tables):
    return t.customer.select("c_custkey", S.member(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("value"))


@check("in_array_column", "SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS value FROM documents")
def in_array(t: Tables):
    return t.documents.select("doc_id", S.member(F.lit("the"), F.split("text", " ")).alias("value"))


@check(
    "and_or_not",
    """SELECT l_orderkey, l_linenumber, (l_quantity > 10 AND l_discount < 0.05) OR l_returnflag = 'R' AS either,
       NOT (l_quantity > 10) AS small FROM lineitem""",
)
def and_or_not(t: Tables):
    big, cheap, back = F.col("l_quantity") > 10, F.col("l_discount") < 0.05, F.col("l_returnflag") == "R"
    return t.lineitem.select("l_orderkey", "l_linenumber", ((big & cheap) | back).alias("either"), (~big).alias("small"))


@check(
    "if_then_else",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN CASE WHEN p_retailprice > 1000 THEN 'big dear' ELSE 'big' END
       ELSE 'small' END AS value FROM part""",
)
def if_then_else(t: Tables):
    dear = S.choose(F.col("p_retailprice") > 1000, F.lit("big dear"), F.lit("big"))
    return t.part.select("p_partkey", S.choose(F.col("p_size") > 25, dear, F.lit("small")).alias("value"))


@check(
    "literals",
    """SELECT c_custkey, 27.25::DECIMAL(4,2) AS number, true AS flag, 'plum' AS text, DATE '2023-08-19' AS day,
       73844::BIGINT AS clock, TIMESTAMP '2023-08-19 20:30:44' AS moment FROM customer""",
)
def literals(t: Tables):
    return t.customer.select(
        "c_custkey", F.lit(Decimal("27.25")).alias("number"), F.lit(True).alias("flag"), F.lit("plum").alias("text"),
        F.lit(dt.date(2023, 8, 19)).alias("day"), F.lit(T.parse_time("20:30:44")).cast("bigint").alias("clock"),
        F.expr("timestamp_ntz'2023-08-19 20:30:44'").alias("moment"),
    )


@check("variables", "SELECT s_suppkey, s_suppkey * 10 + 5 AS value, 2 * pi() * s_suppkey AS circle FROM supplier")
def variables(t: Tables):
    params = {"x": F.lit(5), "y": F.lit(10)}
    with_params = t.supplier.select("s_suppkey", *[v.alias(n) for n, v in params.items()])
    return with_params.select("s_suppkey", F.expr("s_suppkey * y + x AS value"), F.expr("2D * pi() * s_suppkey AS circle"))


@check("user_function", "SELECT s_suppkey, 3 * s_suppkey - 2 AS stretched, (3 * s_suppkey - 2) % 7 AS wrapped FROM supplier")
def user_function(t: Tables):
    register_sql_function(t.spark, "stretch;widen", "n BIGINT", "BIGINT", "3 * n - 2")
    return t.supplier.select("s_suppkey", F.expr("stretch(s_suppkey)").alias("stretched"), F.expr("widen(s_suppkey) % 7").alias("wrapped"))


@check(
    "sql_functions",
    f"""SELECT id, (10+{D.bits('d')}%90)::INTEGER AS number, lower(c_name) AS lowered,
        lpad(({D.bits(D.slot('d', 1))}%100000)::VARCHAR,5,'0') AS zip, {D.bits('d')}%2=0 AS flag
        FROM {D.rows('customer', 'c_custkey', 'customer.sql', 'c_name')}""",
)
def sql_functions(t: Tables):
    register_functions(t.spark)
    drawn = t.customer.withColumn("draw", cell_draw(F.col("c_custkey"), "customer.sql"))
    return drawn.selectExpr(
        "c_custkey AS id", "randomInt(draw, 10, 100) AS number", "lowerCase(c_name) AS lowered",
        "randomZipCode(drawSlot(draw, 1)) AS zip", "randomBoolean(draw) AS flag",
    )


@check("eval_filter", "SELECT * FROM orders WHERE o_totalprice > 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def eval_filter(t: Tables):
    return S.eval_filter(t.orders, "o_totalprice > 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
