"""Money over order totals, with a currency drawn from each order's key.

Amounts are whole hundredths, so the oracles work in whole units: ``c`` is the
amount in hundredths and ``digits`` the digits of the currency.
"""

from pyspark.sql import functions as F

from checks.registry import Tables, check
from rowloom.functions import money as M
from rowloom.functions.dictionaries import NO_DIGIT_CURRENCIES, THREE_DIGIT_CURRENCIES

CODES = ["USD", "EUR", "JPY", "KWD", "SEK"]


def _listed(codes: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


BASE = f"""(SELECT *, CASE WHEN currency IN ({_listed(NO_DIGIT_CURRENCIES)}) THEN 0
      WHEN currency IN ({_listed(THREE_DIGIT_CURRENCIES)}) THEN 3 ELSE 2 END AS digits
    FROM (SELECT o_orderkey, o_custkey, [{_listed(CODES)}][1 + o_custkey % 5] AS currency,
      round(o_totalprice * 100)::BIGINT * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS c FROM orders) o)"""
# The amount at currency scale, in ten-thousandths.
SCALED = "CASE WHEN digits = 0 THEN c // 100 * 10000 ELSE c * 100 END"
AMOUNTS = f"(SELECT *, {SCALED} AS a FROM {BASE} b)"


def as_amount(units: str) -> str:
    return f"(({units})::HUGEINT::DECIMAL(34,0) * 0.0001::DECIMAL(4,4))::DECIMAL(38,4)"


def half_even(numerator: str, denominator: str) -> str:
    """Whole quotient rounded half-even, for a positive denominator."""
    return (
        f"list_transform([{{'n': abs({numerator})::HUGEINT, 'd': ({denominator})::HUGEINT}}], lambda x: "
        "x.n // x.d + CASE WHEN 2 * (x.n % x.d) > x.d OR (2 * (x.n % x.d) = x.d AND (x.n // x.d) % 2 = 1) THEN 1 ELSE 0 END)[1]"
        f" * sign({numerator})::INT"
    )


def orders(t: Tables):
    codes = F.array(*[F.lit(c) for c in CODES])
    sign = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    raw = t.orders.select(
        "o_orderkey", "o_custkey", F.element_at(codes, (1 + F.col("o_custkey") % 5).cast("int")).alias("currency"),
        (F.col("o_totalprice").cast("decimal(12,2)") * sign).alias("raw"),
    )
    return raw.withColumn("amount", M.rescale(F.col("raw"), F.col("currency")))




def A():
    return F.col("amount")


def C():
    return F.col("currency")


@check("money_construct", f"SELECT o_orderkey, {as_amount('a')} AS amount FROM {AMOUNTS} m")
def construct(t: Tables):
    return orders(t).select("o_orderkey", "amount")


@check(
    "money_rescale_half_even",
    f"""SELECT o_orderkey, {as_amount(half_even('c * 25', "CASE digits WHEN 2 THEN 100 ELSE 10 END")
        + " * CASE digits WHEN 2 THEN 100 ELSE 10 END")} AS amount FROM {BASE} b WHERE digits > 0""",
)
def rescale_half_even(t: Tables):
    # Quarter hundredths make ties at two digits.
    quarter = (F.col("raw") * F.lit(25) / F.lit(100)).cast("decimal(20,4)")
    rows = orders(t).filter(~C().isin(NO_DIGIT_CURRENCIES))
    return rows.select("o_orderkey", M.rescale(quarter, C()).alias("amount"))


FORMATTED = (
    "(CASE digits WHEN 0 THEN (a // 10000)::VARCHAR WHEN 3 THEN (a * 0.0001::DECIMAL(4,4))::DECIMAL(18,3)::VARCHAR "
    "ELSE (a * 0.0001::DECIMAL(4,4))::DECIMAL(18,2)::VARCHAR END || ' ' || currency)"
)


@check("money_format", f"SELECT o_orderkey, {FORMATTED} AS text FROM {AMOUNTS} m")
def money_format(t: Tables):
    return orders(t).select("o_orderkey", M.money_format(A(), C()).alias("text"))


@check("money_parse", f"SELECT o_orderkey, {as_amount('a')} AS amount, currency FROM {AMOUNTS} m")
def money_parse(t: Tables):
    parsed = orders(t).select("o_orderkey", M.money_parse(M.money_format(A(), C())).alias("m"))
    return parsed.select("o_orderkey", "m.amount", "m.currency")


@check("money_zero", f"SELECT o_orderkey, 0::DECIMAL(38,4) AS amount, currency FROM {BASE} b")
def money_zero(t: Tables):
    return orders(t).select("o_orderkey", M.money_zero(C()).alias("m")).select("o_orderkey", "m.amount", "m.currency")


@check("money_plus_minus", f"SELECT o_orderkey, {as_amount('a + a + 10000')} AS total, {as_amount('a - 20000')} AS net FROM {AMOUNTS} m")
def plus_minus(t: Tables):
    total = M.money_plus(A(), C(), (A(), C()), (F.lit(1), C()))
    return orders(t).select("o_orderkey", total.alias("total"), M.money_minus(A(), C(), (F.lit(2), C())).alias("net"))


@check("money_sum_per_currency", f"SELECT currency, {as_amount('sum(a)')} AS total FROM {AMOUNTS} m GROUP BY currency")
def money_sum(t: Tables):
    return orders(t).groupBy("currency").agg(M.money_sum(A()).alias("total"))


STEP = "CASE digits WHEN 0 THEN 10000 WHEN 3 THEN 10 ELSE 100 END"


@check("money_multiply", f"SELECT o_orderkey, {as_amount(half_even('a * 125', f'1000 * ({STEP})') + f' * ({STEP})')} AS amount FROM {AMOUNTS} m")
def multiply(t: Tables):
    return orders(t).select("o_orderkey", M.money_multiply(A(), C(), F.lit(0.125)).alias("amount"))


TO_16 = half_even("a::HUGEINT * 1000000000000", "7")


@check(
    "money_divide_round",
    f"""SELECT o_orderkey, {as_amount(half_even('q', f'1000000000000::HUGEINT * ({STEP})') + f' * ({STEP})')} AS amount
        FROM (SELECT *, {TO_16} AS q FROM {AMOUNTS} m) s""",
)
def divide_round(t: Tables):
    return orders(t).select("o_orderkey", M.money_divide_round(A(), C(), F.lit(7)).alias("amount"))


@check("money_divide", f"SELECT o_orderkey, {as_amount('a')} AS amount FROM {AMOUNTS} m")
def divide(t: Tables):
    return orders(t).select("o_orderkey", M.money_divide((A() * 8).cast(M.AMOUNT), C(), F.lit(8)).alias("amount"))


@check("money_remainder", f"SELECT o_orderkey, {as_amount('a % 70000')} AS amount FROM {AMOUNTS} m")
def remainder(t: Tables):
    return orders(t).select("o_orderkey", M.money_remainder(A(), F.lit(7)).alias("amount"))


@check(
    "money_compare",
    f"""SELECT o_orderkey, CASE WHEN a < 1000000000 THEN -1 WHEN a > 1000000000 THEN 1 ELSE 0 END AS sign,
        a > 1000000000 AS gt, a >= 1000000000 AS ge, a < 1000000000 AS lt, a <= 1000000000 AS le FROM {AMOUNTS} m""",
)
def compare(t: Tables):
    sign = M.money_compare(A(), C(), F.lit(100000), C())
    return orders(t).select(
        "o_orderkey", sign.alias("sign"), (sign > 0).alias("gt"), (sign >= 0).alias("ge"), (sign < 0).alias("lt"),
        (sign <= 0).alias("le"),
    )


@check(
    "money_signs",
    f"""SELECT o_orderkey, {as_amount('-a')} AS negated, a < 0 AS negative, a >= 0 AS positive, currency = 'EUR' AS euro,
        a = c * 100 AND currency = currency AS unchanged FROM {AMOUNTS} m""",
)
def signs(t: Tables):
    return orders(t).select(
        "o_orderkey", M.money_negate(A()).alias("negated"), M.is_negative(A()).alias("negative"), M.is_positive(A()).alias("positive"),
        M.same_currency(C(), F.lit("EUR")).alias("euro"), M.money_equal(A(), C(), F.col("raw"), C()).alias("unchanged"),
    )
