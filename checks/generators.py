"""Column generators and whole-table generation over the given tables' rows."""

from pyspark.sql import functions as F

from checks import duck as D
from checks.registry import Tables, check
from rowloom.draws import cell_draw
from rowloom.functions import dictionaries as words
from rowloom.functions.registry import register_functions
from rowloom.functions.scalar import parse_count, parse_count_decimal
from rowloom.operators.lookup import dictionary_pick, weighted_choice
from rowloom.plans.generate import generate, high_water_mark, parallel_load, preview, project, visible
from rowloom.plans.spec import Call, ColumnSpec, Identity, Range, TableSpec, ValueSet


def from_orders(t: Tables, spec: TableSpec, **options):
    """The spec over one row per order, numbered by the order key."""
    index = t.orders.select(F.col("o_orderkey").alias("row_number"))
    return project(spec, index, **options)


def one_column(name: str, column: ColumnSpec, value_sql: str):
    """A single generated column; ``value_sql`` sees the row number as ``id`` and the draw as ``d``."""
    spec = TableSpec(name, (column,))

    @check(name, f"SELECT id AS row_number, {value_sql} AS value FROM {D.rows('orders', 'o_orderkey', f'{name}.value')}")
    def run(t: Tables):
        return from_orders(t, spec)


one_column("constant", ColumnSpec("value", constant="fixed text"), "'fixed text'")
one_column("uuid_key", ColumnSpec("value", identity=Identity("uuid")),
           "list_transform([{'a': " + D.hex64(D.slot("d", 1)) + ", 'b': " + D.hex64(D.slot("d", 2))
           + f", 'v': substr('89ab',(1+(({D.slot('d', 2)})>>62))::INT,1)" + "}], lambda x: substr(x.a,1,8)||'-'||"
           "substr(x.a,9,4)||'-4'||substr(x.a,14,3)||'-'||x.v||substr(x.b,2,3)||'-'||substr(x.b,5,12))[1]")
one_column("sequence", ColumnSpec("value", identity=Identity("sequence", 100, 1000, 7)), "100+(id%129)*7")
one_column("sequence_unbounded", ColumnSpec("value", identity=Identity("sequence", 5, None, 3)), "5+id*3")
one_column("value_set", ColumnSpec("value", value_set=ValueSet(("red", "amber", "green", "blue"))),
           D.pick("d", ["red", "amber", "green", "blue"]))
one_column("value_set_weighted", ColumnSpec("value", value_set=ValueSet(("north", "east", "south"), (5, 1, 2))),
           f"CASE WHEN 5.0>={D.unit('d')}*8.0 THEN 'north' WHEN 6.0>={D.unit('d')}*8.0 THEN 'east' ELSE 'south' END")
one_column("date_range_days",
           ColumnSpec("value", range=Range("date", "2020-01-01", "2020-12-31", 3, "DAYS")),
           "DATE '2020-01-01'+(((id+1)%122)*3)::INT")
one_column("date_range_weeks", ColumnSpec("value", range=Range("date", "2020-01-01", "2024-12-31", 2, "WEEKS")),
           "DATE '2020-01-01'+(((id+1)%131)*14)::INT")


def month_walk_sql(start: str, step: str, end: str, id_sql: str = "id") -> str:
    """Month steps taken one at a time, which is what makes a clamped day stick."""
    return f"""WITH RECURSIVE walk(n, day) AS (
        SELECT 0::BIGINT, DATE '{start}'
        UNION ALL SELECT n+1, (day + INTERVAL {step})::DATE FROM walk WHERE (day + INTERVAL {step})::DATE <= DATE '{end}')
        SELECT o_orderkey AS row_number, day AS value
        FROM orders JOIN walk ON n = (o_orderkey + 1) % (SELECT count(*) FROM walk)"""


@check("date_range_months", month_walk_sql("2019-01-31", "1 MONTH", "2030-06-30"))
def date_range_months(t: Tables):
    spec = TableSpec("dates", (ColumnSpec("value", range=Range("date", "2019-01-31", "2030-06-30", 1, "MONTHS")),))
    return from_orders(t, spec)


@check("date_range_years", month_walk_sql("2000-02-29", "1 YEAR", "2090-01-01"))
def date_range_years(t: Tables):
    spec = TableSpec("dates", (ColumnSpec("value", range=Range("date", "2000-02-29", "2090-01-01", 1, "YEARS")),))
    return from_orders(t, spec)


one_column("time_range", ColumnSpec("value", range=Range("time", "08:00:00", "17:30:00", 7, "MINUTES")),
           "strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds((28800+((id+1)%82)*420)::BIGINT), '%H:%M:%S')")
one_column("time_range_wrapping", ColumnSpec("value", range=Range("time", "22:15:05", None, 41, "SECONDS")),
           "strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds((80105+(id+1)*41)%86400), '%H:%M:%S')")
one_column("datetime_range",
           ColumnSpec("value", range=Range("datetime", "2024-02-28T23:30:00", "2024-12-01T00:00:00", 90, "MINUTES")),
           "TIMESTAMP '2024-02-28 23:30:00' + to_seconds(((id+1)%4417)*5400)")


@check(
    "datetime_range_months",
    """WITH RECURSIVE walk(n, ts) AS (
        SELECT 0::BIGINT, TIMESTAMP '2020-08-31 10:15:00'
        UNION ALL SELECT n+1, ts + INTERVAL 3 MONTH FROM walk WHERE ts + INTERVAL 3 MONTH <= TIMESTAMP '2049-05-31 09:00:00')
        SELECT o_orderkey AS row_number, ts AS value
        FROM orders JOIN walk ON n = (o_orderkey + 1) % (SELECT count(*) FROM walk)""",
)
def datetime_range_months(t: Tables):
    when = Range("datetime", "2020-08-31T10:15:00", "2049-05-31T09:00:00", 3, "MONTHS")
    return from_orders(t, TableSpec("moments", (ColumnSpec("value", range=when),)))


@check("row_number", "SELECT o_orderkey AS row_number, o_orderkey % 10 AS value FROM orders")
def row_number(t: Tables):
    return from_orders(t, TableSpec("rows", (ColumnSpec("value", expression="row_number % 10"),)))


@check(
    "database_sequence",
    "SELECT c_custkey AS row_number, (SELECT max(o_orderkey) FROM orders) + c_custkey + 1 AS o_orderkey FROM customer",
)
def database_sequence(t: Tables):
    spec = TableSpec("orders", (ColumnSpec("o_orderkey", identity=Identity("database_sequence", sequence="orders")),))
    return project(spec, t.customer.select(F.col("c_custkey").alias("row_number")), targets={"orders": t.orders})


@check("high_water_mark", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders) - c_custkey AS gap FROM customer")
def high_water(t: Tables):
    return t.customer.select("c_custkey", (high_water_mark(t.orders, "o_orderkey") - F.col("c_custkey")).alias("gap"))


@check(
    "expression",
    f"""SELECT id AS row_number, (18+{D.bits('d')}%48)::INTEGER AS age,
        CASE WHEN 18+{D.bits('d')}%48 < 30 THEN 'young' ELSE 'old' END AS band
        FROM {D.rows('orders', 'o_orderkey', 'people.age')}""",
)
def expression(t: Tables):
    register_functions(t.spark)
    spec = TableSpec("people", (
        ColumnSpec("age", "int", expression="randomInt(draw, 18, 66)"),
        ColumnSpec("band", expression="CASE WHEN age < 30 THEN 'young' ELSE 'old' END"),
    ))
    return from_orders(t, spec)


@check(
    "hidden_columns",
    f"SELECT 'P-'||lpad((100+{D.bits('d')}%900)::VARCHAR,6,'0') AS label "
    f"FROM {D.rows('orders', 'o_orderkey', 'labels.code')}",
)
def hidden_columns(t: Tables):
    spec = TableSpec("labels", (
        ColumnSpec("code", "int", call=Call("randomInt", (100, 1000)), hidden=True),
        ColumnSpec("label", expression="concat('P-', lpad(CAST(code AS STRING), 6, '0'))"),
    ))
    return visible(spec, from_orders(t, spec))


@check(
    "generator_precedence",
    "SELECT o_orderkey AS row_number, DATE '2020-01-01'+((o_orderkey+1)%10)::INT AS a, 1+o_orderkey AS b, 'c' AS c, "
    "o_orderkey*2 AS d FROM orders",
)
def generator_precedence(t: Tables):
    values = ValueSet(("x", "y"))
    spec = TableSpec("mixed", (
        ColumnSpec("a", range=Range("date", "2020-01-01", "2020-01-10", 1), identity=Identity("sequence"), constant="no"),
        ColumnSpec("b", identity=Identity("sequence"), constant="no", expression="'no'"),
        ColumnSpec("c", constant="c", expression="'no'", value_set=values),
        ColumnSpec("d", expression="row_number * 2", value_set=values),
    ))
    return from_orders(t, spec)


CUSTOMER = TableSpec("customer", (
    ColumnSpec("id", "bigint", identity=Identity("unordered", batch_size=512)),
    ColumnSpec("first_name", call=Call("randomFirstName")),
    ColumnSpec("zip", call=Call("randomZipCode")),
    ColumnSpec("balance", "decimal(8,2)", call=Call("randomBigDecimal", (0, 100000, 2))),
    ColumnSpec("created", "date", call=Call("randomDate", ("2024-06-30",))),
    ColumnSpec("type", value_set=ValueSet(("A", "L"))),
))


def _customer_sql(ids: str) -> str:
    def draw(column: str) -> str:
        return D.cell(f"customer.{column}", "id")

    size = f"({D.bits(draw('created'))}//2)%90"
    return f"""SELECT (id//2147483647)*2147483648+((id%2147483647)*1103515245)%2147483647 AS id,
        {D.pick(draw('first_name'), words.FIRST_NAMES)} AS first_name,
        lpad(({D.bits(draw('zip'))}%100000)::VARCHAR,5,'0') AS zip,
        (({D.bits(draw('balance'))}%10000000)::DECIMAL(8,0)*0.01::DECIMAL(2,2))::DECIMAL(7,2) AS balance,
        DATE '2024-06-30'+(CASE WHEN {D.bits(draw('created'))}%2=0 THEN {size} ELSE -({size}) END)::INT AS created,
        {D.pick(draw('type'), ['A', 'L'])} AS type
        FROM (SELECT unnest(range(0, {ids}))::BIGINT AS id) rows"""


@check("generate_table", _customer_sql("(SELECT count(*) FROM customer)"))
def generate_table(t: Tables):
    return generate(t.spark, CUSTOMER, rows=t.customer.count())


@check("parallel_load", _customer_sql("6*(SELECT count(*) FROM supplier)"))
def parallel(t: Tables):
    return parallel_load(t.spark, CUSTOMER.with_rows(t.supplier.count()), 6)


@check("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def preview_rows(t: Tables):
    return preview(t.orders.orderBy("o_orderkey"), 100)


@check(
    "preview_transposed",
    """WITH head AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS record FROM customer
                     ORDER BY c_custkey LIMIT 20)
       SELECT record, 'c_custkey' AS key, c_custkey::VARCHAR AS value FROM head
       UNION ALL SELECT record, 'c_name', c_name FROM head
       UNION ALL SELECT record, 'c_nationkey', c_nationkey::VARCHAR FROM head
       UNION ALL SELECT record, 'c_mktsegment', c_mktsegment FROM head""",
)
def preview_transposed(t: Tables):
    columns = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return preview(columns.orderBy("c_custkey"), 20, transpose=True)


@check(
    "dictionary",
    f"""WITH words AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)
        SELECT id AS o_orderkey, p_name AS word FROM {D.rows('orders', 'o_orderkey', 'orders.word')}
        JOIN words ON pos = {D.bits('d')} % (SELECT count(*) FROM part)""",
)
def dictionary(t: Tables):
    draw = cell_draw(F.col("o_orderkey"), "orders.word")
    return dictionary_pick(t.orders.select("o_orderkey"), draw, t.part, "p_name", ["p_partkey"], "word")


@check(
    "dictionary_with_repeats",
    f"""WITH words AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
        SELECT id AS o_orderkey, c_mktsegment AS word FROM {D.rows('orders', 'o_orderkey', 'orders.segment')}
        JOIN words ON pos = {D.bits('d')} % (SELECT count(*) FROM customer)""",
)
def dictionary_with_repeats(t: Tables):
    draw = cell_draw(F.col("o_orderkey"), "orders.segment")
    return dictionary_pick(t.orders.select("o_orderkey"), draw, t.customer, "c_mktsegment", ["c_custkey"], "word")


@check(
    "weighted_choice_table",
    f"""WITH runs AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey)::BIGINT AS e FROM part)
        SELECT id AS o_orderkey, p_partkey AS part FROM
          (SELECT id, {D.bits('d')} % (SELECT sum(p_size) FROM part)::BIGINT AS unit
           FROM {D.rows('orders', 'o_orderkey', 'orders.part')}) drawn
        JOIN runs ON unit >= e - p_size AND unit < e""",
)
def weighted_choice_table(t: Tables):
    draw = cell_draw(F.col("o_orderkey"), "orders.part")
    return weighted_choice(t.orders.select("o_orderkey"), draw, t.part, "p_partkey", "p_size", ["p_partkey"], "part")


@check(
    "parse_count",
    "SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END) * c_custkey "
    "* [1, 1000, 1000000, 1000, 1000000000, 1000][1 + c_custkey % 6] AS value FROM customer",
)
def parse_counts(t: Tables):
    suffixes = F.array(*[F.lit(s) for s in ("", "k", "M", "_000", "G", "K")])
    suffix = F.element_at(suffixes, (1 + F.col("c_custkey") % 6).cast("int"))
    sign = F.when(F.col("c_custkey") % 2 == 0, "+").otherwise("-")
    return t.customer.select("c_custkey", parse_count(F.concat(sign, F.col("c_custkey").cast("string"), suffix)).alias("value"))


@check(
    "parse_count_decimal",
    "SELECT c_custkey, ((c_custkey + 0.5::DECIMAL(2,1)) * [1, 1000, 1000000][1 + c_custkey % 3])::DECIMAL(28,6) AS value "
    "FROM customer",
)
def parse_counts_decimal(t: Tables):
    suffixes = F.array(*[F.lit(s) for s in ("", "K", "m")])
    suffix = F.element_at(suffixes, (1 + F.col("c_custkey") % 3).cast("int"))
    text = F.concat(F.col("c_custkey").cast("string"), F.lit(".5"), suffix)
    return t.customer.select("c_custkey", parse_count_decimal(text).alias("value"))
